"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct words are laid end to end and indexed by a suffix array; every piece of the vocabulary is found by binary search as a range
of the array, which gives all its occurrences; the occurrences, sorted by place, are the edges over which words are
relaxed: of the adjacent edges that join to an edge, the best-scored and then leftmost joins first, until none does."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.textvec import slices

MARK = "▁"  # stands for a space
_WORD = re.compile(f"{MARK}*[^{MARK}]*")
_loaded: dict[str, "Vocabulary"] = {}
SHORT = 40


class Known:
    """Words with their ids, one after the other."""

    def __init__(self):
        self.number, self._ids, self._counts = {}, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, words: list[str], ids: list[np.ndarray]) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self._ids.append(np.concatenate(ids))
        self._counts.append(np.array([len(x) for x in ids], dtype=np.int64))

    def flat(self) -> np.ndarray:
        self._ids = [np.concatenate(self._ids)]
        return self._ids[0]

    def counts(self) -> np.ndarray:
        self._counts = [np.concatenate(self._counts)]
        return self._counts[0]

    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts()) - self.counts()


class Vocabulary:
    """The pieces of a model file: normal pieces by their bytes, with ranks (0 joins first), and the ids of single bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.texts = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.full(256, sp.unk_id(), dtype=np.int64)
        self.unk, self.special = sp.unk_id(), {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.byte_of, normal = {}, []
        for i, t in enumerate(self.texts):
            if sp.is_byte(i):
                self.byte_ids[int(t[3:5], 16)] = i
                self.byte_of[i] = int(t[3:5], 16)
            elif i not in self.special and not sp.is_unused(i):
                normal.append(i)
        raw = {i: self.texts[i].encode() for i in normal}
        self.ids = np.array(normal, dtype=np.int64)
        self.lengths = np.array([len(raw[i]) for i in normal], dtype=np.int64)
        score = np.array([sp.get_score(i) for i in normal])
        self.rank = np.zeros(n, dtype=np.int64)
        self.rank[self.ids] = np.unique(-score, return_inverse=True)[1]
        self.steps = -(-int(self.lengths.max()) // 8)
        flat = np.zeros((len(normal), self.steps * 8), dtype=np.uint8)
        for row, i in zip(flat, normal, strict=True):
            row[: len(raw[i])] = np.frombuffer(raw[i], np.uint8)
        self.keys = flat.view(">u8").astype(np.uint64)  # (pieces, steps)
        inner = [t for t in (self.texts[i] for i in normal) if MARK in t.lstrip(MARK)]
        if inner:
            raise ValueError(f"pieces hold a space inside, so words can't be told apart: {inner[:3]}")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    # --- suffix array ---

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place * 128 + length, id) of all occurrences of pieces in data, sorted. Pieces end before a 0 byte."""
        n, pad = len(data), self.steps * 8
        wide = np.concatenate([data, np.zeros(pad + 8, dtype=np.uint8)])
        word = np.zeros(n + pad, dtype=np.uint64)  # the eight bytes from each place on
        for j in range(8):
            word = (word << np.uint64(8)) | wide[j : j + n + pad]
        for j in range(1, 8):  # pieces end before a 0 byte, so nothing after it counts
            word = np.where((word >> np.uint64(64 - 8 * j)) & np.uint64(255) == 0, (word >> np.uint64(64 - 8 * j)) << np.uint64(64 - 8 * j), word)
        order = np.argsort(word[:n])
        head = word[order]
        # suffixes that agree in eight bytes and go on: sorted by the next eight, and so on
        group = np.cumsum(np.concatenate([[0], head[1:] != head[:-1]])) if n else order
        depth, last = 8, head
        at = np.arange(n)
        while depth < pad and len(at):
            tied = np.concatenate([[False], group[at][1:] == group[at][:-1]])
            tied |= np.concatenate([tied[1:], [False]])
            at = at[tied & (last & np.uint64(255) != 0)]
            if not len(at):
                break
            nxt = word[order[at] + depth]
            sort = np.lexsort((nxt, group[at]))
            order[at], last = order[at][sort], nxt[sort]
            new = np.concatenate([[True], (group[at][1:] != group[at][:-1]) | (last[1:] != last[:-1])])
            group[at] = np.maximum.accumulate(np.where(new, at + n, 0))
            depth += 8
        # binary search of all pieces: by their first eight bytes, and where they are longer by the rest within that range
        low = self.keys[:, 0]
        rest = np.where(self.lengths >= 8, np.uint64(0), ~np.uint64(0) >> (np.minimum(self.lengths, 7) * 8).astype(np.uint64))
        first, end = np.searchsorted(head, low), np.searchsorted(head, low | rest, "right")
        bounds = [first.copy(), end.copy()]
        more = np.flatnonzero((self.lengths > 8) & (first < end))
        tail = np.clip(self.lengths[more][:, None] - np.arange(self.steps)[None] * 8, 0, 8)
        mask = np.where(tail == 0, np.uint64(0), ~np.uint64(0) << ((8 - np.maximum(tail, 1)) * 8).astype(np.uint64))
        for above in (False, True):
            lo, hi = first[more], end[more]
            while (lo < hi).any():
                mid = (lo + hi) >> 1
                place = order[np.minimum(mid, n - 1)]
                less, level = np.zeros(len(lo), dtype=bool), np.ones(len(lo), dtype=bool)
                for s in range(1, self.steps):
                    own = word[place + s * 8] & mask[:, s]
                    less |= level & (own < self.keys[more, s])
                    level &= own == self.keys[more, s]
                right = (less | level if above else less) & (lo < hi)
                lo, hi = np.where(right, mid + 1, lo), np.where(right | (lo >= hi), hi, mid)
            bounds[above][more] = lo
        count = bounds[1] - bounds[0]
        which = np.repeat(np.arange(len(self.ids)), count)
        place = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - bounds[0], count)]
        packed = np.sort(((place << 7) | self.lengths[which]) << 20 | self.ids[which])
        return packed >> 20, packed & ((1 << 20) - 1)

    # --- relaxing ---

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, all in one index."""
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        key, ids = self.edges(data)
        if self.lengths.max() >= 128:
            raise ValueError("pieces of 128 bytes or more")
        # symbols: the characters of all words
        lead = (data & 0xC0) != 0x80
        ends_word = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
        begins = np.concatenate([[0], ends_word[:-1]]).astype(np.int64) if raw else np.zeros(0, np.int64)
        stop = np.zeros(len(data), dtype=bool)
        stop[ends_word - 1] = True
        start = np.flatnonzero(lead & ~stop)
        nxt = np.flatnonzero(lead | stop)
        size = nxt[np.searchsorted(nxt, start, "right")] - start if len(start) else start
        word = np.searchsorted(ends_word, start, "right")
        long = np.bincount(word, minlength=len(words))[word] > SHORT if len(start) else np.zeros(0, bool)
        out: list = [None] * len(words)
        for w in np.unique(word[long]).tolist():
            mine = word == w
            out[w] = self._heap(start[mine].tolist(), size[mine].tolist(), key, ids, data)
        start, size, word = start[~long], size[~long], word[~long]
        done_s, done_n, done_w = [], [], []
        big = np.iinfo(np.int64).max
        while len(start):
            same = np.zeros(len(start), dtype=bool)
            same[:-1] = word[1:] == word[:-1]
            both = np.zeros(len(start), dtype=np.int64)
            both[:-1] = size[:-1] + size[1:]
            want = start * 128 + np.minimum(both, 127)
            at = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
            hit = same & (key[at] == want) if len(key) else same & False
            cost = np.where(hit, self.rank[ids[at]] if len(key) else 0, big)
            edge = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(cost, edge)
            of = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(start))))
            live = (least < big)[of]
            if not live.all():
                done_s.append(start[~live]), done_n.append(size[~live]), done_w.append(word[~live])
            # the leftmost of the best of each word
            best = np.flatnonzero(live & (cost == least[of]))
            best = best[np.concatenate([[True], of[best][1:] != of[best][:-1]])] if len(best) else best
            size = size.copy()
            size[best] = both[best]
            keep = live.copy()
            keep[best + 1] = False
            start, size, word = start[keep], size[keep], word[keep]
        if done_s:
            start, size, word = np.concatenate(done_s), np.concatenate(done_n), np.concatenate(done_w)
            sort = np.argsort(start, kind="stable")
            start, size, word = start[sort], size[sort], word[sort]
            flat, owner = self._name(start, size, word, key, ids, data)
            cut = np.searchsorted(owner, np.arange(len(words) + 1))
            for w in range(len(words)):
                if out[w] is None:
                    out[w] = flat[cut[w] : cut[w + 1]]
        return [x if x is not None else np.zeros(0, np.int64) for x in out]

    def _name(self, start, size, word, key, ids, data):
        """Ids of symbols; a character without a piece falls back to its bytes."""
        want = start * 128 + np.minimum(size, 127)
        at = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
        known = key[at] == want if len(key) else np.zeros(len(start), bool)
        many = np.where(known, 1, size)
        which = np.repeat(np.arange(len(start)), many)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        named = ids[at][which] if len(key) else which
        return np.where(known[which], named, self.byte_ids[data[start[which] + inner]]), word[which]

    def _heap(self, start, size, key, ids, data):
        """One long word, with a heap of the joins open."""
        n, prev, nxt, alive, heap = len(start), list(range(-1, len(start) - 1)), [*range(1, len(start)), -1], [True] * len(start), []

        def offer(i):
            j = nxt[i]
            if j >= 0 and size[i] + size[j] < 128:
                want = start[i] * 128 + size[i] + size[j]
                at = int(np.searchsorted(key, want))
                if at < len(key) and key[at] == want:
                    heapq.heappush(heap, (int(self.rank[ids[at]]), start[i], i, size[i], size[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or size[i] != a or size[j] != b:
                continue
            size[i] += size[j]
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        left = [i for i in range(n) if alive[i]]
        s, z = np.array([start[i] for i in left]), np.array([size[i] for i in left])
        return self._name(s, z, np.zeros(len(s), np.int64), key, ids, data)[0]

    # --- texts ---

    def encode(self, texts: list[str], known: Known) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text). known: words encoded before."""
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, f"^ | $|  |{MARK}|^$").to_numpy(zero_copy_only=False).astype(bool)
        # words of plain texts: told apart by single spaces, made distinct by Arrow
        plain = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        coded = plain.values.dictionary_encode()
        split = {int(i): _WORD.findall(MARK + texts[i].replace(" ", MARK))[:-1] if texts[i] else [] for i in np.flatnonzero(odd)}
        own = [MARK + w for w in coded.dictionary.to_pylist()]
        number = known.number
        new = list({w for w in own if w not in number} | {w for words in split.values() for w in words if w not in number})
        lo, room = 0, 0
        for i, w in enumerate(new):
            room += len(w) + 1
            if room > 1 << 19 or i == len(new) - 1:
                known.add(new[lo : i + 1], self.encode_words(new[lo : i + 1]))
                lo, room = i + 1, 0
        here = np.array([number[w] for w in own], dtype=np.int64)[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.int64)
        n_words = np.zeros(len(texts), dtype=np.int64)
        n_words[~odd] = np.diff(plain.offsets.to_numpy())
        for i, words in split.items():
            n_words[i] = len(words)
        first = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
        which = np.zeros(first[-1], dtype=np.int64)
        which[np.repeat(~odd, n_words)] = here
        for i, words in split.items():
            which[first[i] : first[i + 1]] = [number[w] for w in words]
        count = known.counts()[which]
        at = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        ids = known.flat()[np.arange(at[-1]) + np.repeat(known.starts()[which] - at[:-1], count)]
        return ids, at[first]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.special else self.texts[i].encode() for i in ids.tolist())
        text = out.decode(errors="replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """docs with piece_ids (array of int) added; a column of this name is replaced.

    Null and empty texts have no ids. Every text decodes to itself but for U+2581, which decodes to a space, and U+0000, which can't be indexed and is
    encoded like a byte of its own. Rows are on their own, so repeats and empty tables need no care. Very long words are joined with a heap."""
    rest = docs.drop("piece_ids")
    place = rest.columns.index(text_col)
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = Vocabulary.load(model_path), Known()
        for b in batches:
            for lo, hi in slices(b.column(place), 4 << 20):
                if len(known.number) > 200_000:
                    known = Known()
                ids, offsets = vocabulary.encode([t or "" for t in b.column(place).slice(lo, hi - lo).to_pylist()], known)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in b.columns], lists], names=[*b.schema.names, "piece_ids"])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, model_path: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """encoded with the ids' text added; null ids give null, no ids the empty text, special ids nothing."""
    from pyspark.sql import types as T

    rest = encoded.drop(text_col)
    place = rest.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(model_path)
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                texts = [None if not x.is_valid else vocabulary.decode(x.values.to_numpy(zero_copy_only=False)) for x in part.column(place)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text_col])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(text_col, T.StringType())]))


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip): the number of ids, their CRC-32 as little-endian unsigned 32-bit numbers, and
    whether decoding gives the text (null: empty) again."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(model_path)
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                n, crc, same = [], [], []
                for text, x in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    ids = x.values.to_numpy(zero_copy_only=False)
                    n.append(len(ids)), crc.append(ids_crc32(ids)), same.append(vocabulary.decode(ids) == text.replace(MARK, " "))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return encode(base, model_path).mapInArrow(run, f"doc_id {id_type}, n_pieces long, ids_crc32 long, round_trip boolean")
