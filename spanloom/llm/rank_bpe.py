"""BPE encoding and decoding over contiguous rank arrays.

A word is a row of parts, each with the rank of its join to the next. The least rank of a word is found by a scan, the boundary behind each of
its places is deleted and the ranks beside them are looked up again, until no join is left. All new words of a batch lie in one
pair of arrays, so that a scan serves them all; words that are done leave the arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.textvec import slices

#: White space of the vocabulary's patterns; Python's own also counts U+001C to U+001F, which the patterns take for signs.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
NONE = np.iinfo(np.int64).max
#: Stretches that a worker remembers before it begins anew.
REMEMBERED = 300_000
_loaded: dict[str, "RankTable"] = {}


class Learned:
    """Stretches with their ids, one after the other."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self._ids, self._counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, texts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.number.update(zip(texts, range(len(self.number), len(self.number) + len(texts)), strict=True))
        self._ids.append(ids)
        self._counts.append(counts)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each stretch has)."""
        self._ids, self._counts = [np.concatenate(self._ids)], [np.concatenate(self._counts)]
        return self._ids[0], self._counts[0]


class RankTable:
    """The joins of a tokenizers file by pairs of ids, its ids by signs, and its rules for cutting texts into words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        odd = [x for x in added if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or spec["decoder"] or odd:
            raise ValueError("only plain BPE files without a decoder and with literal added tokens are read")
        vocab = model["vocab"]
        rules = Tokenizer.from_file(path)
        self.normalizer, self.cutter = rules.normalizer, rules.pre_tokenizer
        suffix = model.get("end_of_word_suffix") or ""
        codes = [(ord(t[0]), i, t != t[0]) for t, i in vocab.items() if t and t in (t[0], t[0] + suffix)]
        # ids of single signs by code point, within a word and at its end
        self.within, self.final = np.full((2, max(c for c, _, _ in codes) + 1), -1, dtype=np.int64)
        for c, i, last in codes:
            if not last:
                self.within[c] = i
            if last or not suffix:
                self.final[c] = i
        self.added = {x["content"]: x["id"] for x in added}
        self.literal = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.joined = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        # all places of the least rank can be joined at once if no join makes a part that an earlier one takes
        last, first = {}, {}
        for k, (a, b) in enumerate(pairs):
            last[a + b] = k
            first.setdefault(a, k), first.setdefault(b, k)
        self.at_once = all(k < first.get(t, NONE) for t, k in last.items())
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.added.items()}}
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())

    @classmethod
    def load(cls, path: str) -> RankTable:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], NONE)

    def join(self, part: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """part: ids of single signs, word after word; word: the rising number of each one's word. Returns both once all joins are done."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(part), NONE)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same] = self.ranks(part[same], part[same + 1])
        while len(part):
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(part)))
            still = np.repeat(least < NONE, size)
            if not still.all():
                done.append((part[~still], word[~still]))
                part, word, rank, least, size = part[still], word[still], rank[still], least[least < NONE], size[least < NONE]
                if not len(part):
                    break
            hit = rank == np.repeat(least, size)
            at = np.flatnonzero(hit)
            first = np.concatenate([[True], word[at][1:] != word[at][:-1]])
            if not self.at_once:
                at = at[first]
            else:  # of places that overlap, every other one from the left
                fresh = first | np.concatenate([[True], at[1:] != at[:-1] + 1])
                run = at - np.repeat(at[fresh], np.diff(np.append(np.flatnonzero(fresh), len(at))))
                at = at[run % 2 == 0]
            part[at] = self.joined[rank[at]]
            keep = np.ones(len(part), dtype=bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # the places once the boundaries are gone
            part, word, rank = part[keep], word[keep], rank[keep]
            mark = np.zeros(len(part), dtype=bool)
            mark[at] = mark[at[at > 0] - 1] = True
            stale = np.flatnonzero(mark)
            inner = stale[stale + 1 < len(part)]
            inner = inner[word[inner] == word[inner + 1]]
            rank[stale] = NONE
            rank[inner] = self.ranks(part[inner], part[inner + 1])
        if not done:
            return part, word
        part, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return part[order], word[order]

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each text has) of texts that have neither white space nor added tokens; all are normalised and cut at once, as no rule reaches
        over white space."""
        whole = self.normalizer.normalize_str(" ".join(texts))
        words = self.cutter.pre_tokenize_str(whole)
        gaps = np.flatnonzero(np.frombuffer(whole.encode("utf-32-le"), np.uint32) == 32)
        if len(gaps) != len(texts) - 1:
            raise ValueError("white space isn't what the vocabulary's rules take it for")
        owner = np.searchsorted(gaps, np.fromiter((s for _, (s, _) in words), dtype=np.int64, count=len(words)))
        size = np.fromiter((len(w) for w, _ in words), dtype=np.int64, count=len(words))
        codes = np.frombuffer("".join([w for w, _ in words]).encode("utf-32-le"), np.uint32).astype(np.int64)
        part, last = self.within[codes], np.cumsum(size) - 1
        part[last] = self.final[codes[last]]
        word, known = np.repeat(np.arange(len(words)), size), part >= 0  # signs without an id are left out, as the library does
        part, word = self.join(part[known], word[known])
        return part, np.bincount(owner[word], minlength=len(texts)).astype(np.int64)

    def stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each stretch has) of stretches without white space."""
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = [self.literal.split(t) if self.literal and self.literal.search(t) else None for t in texts]
        if not any(cut):
            return self.plain(texts)
        between = [p for t, pieces in zip(texts, cut, strict=True) for p in (pieces or [t]) if p and p not in self.added]
        ids, counts = self.plain(between) if between else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        found = iter(np.split(ids, np.cumsum(counts)[:-1]))
        mine = [[np.array([self.added[p]]) if p in self.added else next(found) for p in (pieces or [t]) if p] for t, pieces in zip(texts, cut, strict=True)]
        return np.concatenate([x for m in mine for x in m]), np.array([sum(map(len, m)) for m in mine], dtype=np.int64)

    def encode(self, texts: list[str], known: Learned) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text). known: stretches encoded before."""
        cut = [[s for s in _SPACE.split(t) if s] if _SEPARATORS.search(t) else t.split() for t in texts]
        number = known.number
        new = list(dict.fromkeys(s for stretches in cut for s in stretches if s not in number))
        lo, room = 0, 0
        for i, s in enumerate(new):
            room += len(s) + 1
            if room > 1 << 19 or i == len(new) - 1:
                known.add(new[lo : i + 1], *self.stretches(new[lo : i + 1]))
                lo, room = i + 1, 0
        which = np.fromiter((number[s] for stretches in cut for s in stretches), dtype=np.int64)
        flat, counts = known.flat()
        start, count = (np.cumsum(counts) - counts)[which], counts[which]
        at = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        ids = flat[np.arange(at[-1]) + np.repeat(start - at[:-1], count)]
        return ids, at[np.concatenate([[0], np.cumsum([len(s) for s in cut])]).astype(np.int64)]


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with token_ids (array of int) added, as the tokenizers file at `path` gives them without special tokens around; a column of this
    name is replaced.

    Null and empty texts have no ids. The strings of added tokens within a text are those tokens, as in the library. Texts are cut at white
    space, and a worker remembers the ids of some 300,000 stretches. Any text works, however long: a text takes some 40 bytes a byte while it is
    encoded, and a word without white space is joined in as many scans as it has kinds of joins. Rows are on their own, so that repeats, ties,
    null ids and empty tables need no care; other columns pass through."""
    rest = docs.drop("token_ids")
    place = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = RankTable.load(path), Learned()
        for b in batches:
            for lo, hi in slices(b.column(place), 2 << 20):
                if len(known.number) > REMEMBERED:
                    known = Learned()
                ids, offsets = table.encode([t or "" for t in b.column(place).slice(lo, hi - lo).to_pylist()], known)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in b.columns], lists], names=[*b.schema.names, "token_ids"])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """encoded with the ids' tokens added, joined by single spaces as the library joins them where a file has no decoder.

    Null ids give null, no ids the empty text; a null or unknown id among others is left out; special tokens are written out. A column named
    text_col is replaced."""
    rest = encoded.drop(text_col)
    place = rest.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = RankTable.load(path).names
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(place)), 0).to_numpy(zero_copy_only=False)
            lo, ends = 0, np.cumsum(sizes)
            while lo < len(b):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
                lists = b.column(place).slice(lo, hi - lo)
                ids = lists.flatten()
                good = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(names)))
                tokens = names.take(pc.if_else(good, ids, None))
                live = pc.is_valid(tokens).to_numpy(zero_copy_only=False)
                upto = np.concatenate([[0], np.cumsum(live)])[np.concatenate([[0], np.cumsum(sizes[lo:hi])]).astype(np.int64)]
                kept = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), tokens.drop_null())
                text = pc.if_else(pc.is_valid(lists), pc.binary_join(kept, " "), None)
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in b.columns], text], names=[*b.schema.names, text_col])
                lo = hi

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(text_col, T.StringType())]))


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode and decode."""
    both = decode(encode(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path).drop("text"), path)
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
