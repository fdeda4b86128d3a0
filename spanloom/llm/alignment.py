"""Alignment of two tokenizers' tokens, and corpus-wide counts of linked id pairs by external spill counting.

While texts are read, every task gathers records (pair of ids, document, times), parts them by radix of the B id, sorts them side-major (B id,
A id, document) and spills them as runs of zstd blocks to the shared folder. Runs are then merged by a k-way heap, which counts
each pair; sums over all merges give each pair's count and each B id's highest. The runs are read side-major a second time beside
these counts and each record's share streams back to its document.

A merge takes the runs of few tasks, whatever ids they hold, so an id that holds a third of all links is spread like others."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import materialize
from spanloom.llm.packing import encoder
from spanloom.llm.pieces import MARK
from spanloom.llm.textvec import slices

#: Bits of an A id within a pair's code: b << A_BITS | a.
A_BITS = 20
#: Bits of a document's place within a spill.
DOC_BITS = 23
#: Tasks and spills whose runs are merged together.
MERGED_TASKS, MERGED_SPILLS = 8, 8
#: Stretches that a worker remembers before it begins anew.
REMEMBERED = 200_000
_AFTER_WORD = re.compile(r"(?<=\S) ")
_ODD = re.compile(r"^\s|\s ")
_loaded: dict[tuple[str, str], "Aligner"] = {}


class Stretches:
    """What is known of stretches of text: n_a, n_b, n_groups, n_links and whether it is broken; links one after the other; groups as text."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self._sizes, self._links, self._groups = [np.zeros((0, 5), np.int64)], [np.zeros(0, np.int64)], [pa.array([], pa.string())]

    def add(self, texts: list[str], sizes: np.ndarray, links: np.ndarray, groups: pa.Array) -> None:
        self.number.update(zip(texts, range(len(self.number), len(self.number) + len(texts)), strict=True))
        self._sizes.append(sizes), self._links.append(links), self._groups.append(groups)

    def flat(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        self._sizes, self._links, self._groups = [np.concatenate(self._sizes)], [np.concatenate(self._links)], [pa.concat_arrays(self._groups)]
        return self._sizes[0], self._links[0], self._groups[0]


def lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


class Aligner:
    """Both vocabularies, loaded once a worker."""

    def __init__(self, ranks_path: str, model_path: str):
        import sentencepiece

        self.a, self.b = encoder(ranks_path), sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(pieces)]
        self.bytes_a = [self.a.decode_single_token_bytes(i) if i != self.a.eot_token else b"" for i in range(self.a.n_vocab)]
        self.long_a, self.long_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.mark = self.b.piece_to_id(MARK)
        if any(MARK in t.lstrip(MARK) for t in pieces):
            raise ValueError("a piece holds a space inside, so stretches can't be told apart")
        if self.a.n_vocab > 1 << A_BITS:
            raise ValueError("ids of A don't fit a pair's code")
        self.named = pa.array([str(i) for i in range(max(self.a.n_vocab, len(pieces)))])

    @classmethod
    def load(cls, ranks_path: str, model_path: str) -> Aligner:
        if (ranks_path, model_path) not in _loaded:
            _loaded[ranks_path, model_path] = cls(ranks_path, model_path)
        return _loaded[ranks_path, model_path]

    @staticmethod
    def cut(text: str) -> list[str]:
        """Stretches of text, each to be read after a space: cut at every space behind a sign other than white space, where both
        vocabularies begin a new word."""
        return _AFTER_WORD.split(text) if _ODD.search(text) else text.split(" ")

    def learn(self, new: list[str], known: Stretches) -> None:
        """Tokens of both sides lie on one axis of bytes, stretch after stretch. Between two neighbouring ends, of whichever side, lies one A
        and one B token: that is a link. Ends of both sides at once are ends of groups."""
        # A reads all at once the stretches that end in a sign: a word of its begins at each space behind one
        tight, loose = [t for t in new if t and not t[-1].isspace()], [t for t in new if not t or t[-1].isspace()]
        new = tight + loose
        if not new:
            return
        raw = [(" " + t).encode() for t in new]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        apart = [self.a.encode_ordinary(" " + t) for t in loose]
        flat_a = np.array([*(self.a.encode_ordinary(" " + " ".join(tight)) if tight else []), *(i for x in apart for i in x)], dtype=np.int64)
        n_a = np.diff(np.searchsorted(np.cumsum(self.long_a[flat_a]), np.cumsum(sizes), "right"), prepend=0)
        ids_b = [b if t else [self.mark] for t, b in zip(new, self.b.encode(new, num_threads=1), strict=True)]
        n_b = np.fromiter(map(len, ids_b), dtype=np.int64, count=len(new))
        flat_b = np.fromiter((i for x in ids_b for i in x), dtype=np.int64, count=int(n_b.sum()))
        one = np.repeat(np.arange(len(new)), n_b)
        good = np.bincount(one, self.long_b[flat_b], len(new)) == sizes
        said = np.frombuffer(b"".join([self.bytes_b[i] for i in flat_b[good[one]].tolist()]), np.uint8)
        want = np.frombuffer(b"".join([r for r, ok in zip(raw, good.tolist(), strict=True) if ok]), np.uint8)
        good[np.flatnonzero(good)[np.searchsorted(np.cumsum(sizes[good]), np.flatnonzero(said != want), "right")]] = False
        flat_a, flat_b = flat_a[np.repeat(good, n_a)], flat_b[good[one]]
        n_a, n_b, sizes = n_a * good, n_b * good, sizes * good
        ends_a, ends_b = np.cumsum(self.long_a[flat_a]), np.cumsum(self.long_b[flat_b])
        axis = np.cumsum(sizes)
        ends, cuts = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b)
        links = flat_b[np.searchsorted(ends_b, ends)] << A_BITS | flat_a[np.searchsorted(ends_a, ends)]
        each = lambda at: np.diff(np.searchsorted(at, axis, "right"), prepend=0)
        n_groups = each(cuts)
        sides = [pc.binary_join(lists(np.diff(np.searchsorted(own, cuts, "right"), prepend=0), self.named.take(pa.array(flat))), ",") for own, flat in ((ends_a, flat_a), (ends_b, flat_b))]
        groups = pc.binary_join(lists(n_groups, pc.binary_join_element_wise(*sides, "|")), ";")
        known.add(new, np.stack([n_a, n_b, n_groups, each(ends), ~good], axis=1).astype(np.int64), links, groups)


def shuffled(x: np.ndarray, kind: str) -> bytes:
    """zstd of numbers, their bytes by place."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes())


def unshuffled(block: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_run(code: np.ndarray, doc: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes, bytes, bytes, bytes]:
    """Blocks of one run sorted by (code, doc): pairs, links a pair, documents a pair; documents, times."""
    head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    pairs = code[head]
    docs = np.diff(doc, prepend=0).astype(np.uint32)  # differences, which wrap where a pair ends
    return shuffled(np.diff(pairs, prepend=0), "<u8"), shuffled(np.add.reduceat(times, head), "<u8"), shuffled(np.diff(np.append(head, len(code))), "<u4"), shuffled(docs, "<u4"), shuffled(times, "<u4")


def merge_counts(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """(pairs, counts) of runs (pairs rising, counts), merged by a heap in side-major order."""
    columns = [(p.tolist(), c.tolist()) for p, c in runs if len(p)]
    place, heap = [0] * len(columns), [(p[0], i) for i, (p, _) in enumerate(columns)]
    heapq.heapify(heap)
    pairs, counts = [], []
    while heap:
        pair, n = heap[0][0], 0
        while heap and heap[0][0] == pair:
            i = heap[0][1]
            codes, c = columns[i]
            n += c[place[i]]
            place[i] += 1
            if place[i] < len(codes):
                heapq.heapreplace(heap, (codes[place[i]], i))
            else:
                heapq.heappop(heap)
        pairs.append(pair), counts.append(n)
    return pairs, counts


def spill(docs: DataFrame, ranks_path: str, model_path: str, radix: int, records: int, with_groups: bool) -> DataFrame:
    """docs (doc_id, text) -> rows of two kinds: documents (part null) and runs."""
    id_type = docs.schema["doc_id"].dataType
    long, binary = T.LongType(), T.BinaryType()
    fields = [("key", long), ("doc_id", id_type), ("n_a", long), ("n_b", long), ("n_groups", long), ("n_links", long), ("groups_sha256", T.StringType()), *([("groups", T.StringType())] if with_groups else [])]
    blocks = [("part", long), ("merge", T.StringType()), ("pairs", binary), ("links", binary), ("sizes", binary), ("docs", binary), ("times", binary)]
    schema = T.StructType([T.StructField(*f) for f in fields + blocks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, known, task = Aligner.load(ranks_path, model_path), Stretches(), TaskContext.get().partitionId()
        key, base, spills, held, size = task << 33, task << 33, 0, [], 0

        def runs() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, spills, base
            code, doc, times = (np.concatenate(x) for x in zip(*held, strict=True))
            part = (code >> A_BITS) % radix
            order = np.argsort(code << DOC_BITS | doc, kind="stable")
            order = order[np.argsort(part[order].astype(np.uint16), kind="stable")]
            code, doc, times, part = code[order], doc[order], times[order], part[order]
            cut = np.searchsorted(part, np.arange(radix + 1))
            merge = f"{task // MERGED_TASKS}-{spills // MERGED_SPILLS}"
            for r in range(radix):
                lo, hi = cut[r], cut[r + 1]
                if lo < hi:
                    row = {"key": base, "part": r, "merge": merge} | dict(zip(("pairs", "links", "sizes", "docs", "times"), pack_run(code[lo:hi], doc[lo:hi], times[lo:hi]), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], t) for f, t in zip(schema.fields, types, strict=True)], names=schema.fieldNames())
            held, size, spills, base = [], 0, spills + 1, key

        types = None
        for b in batches:
            if types is None:
                types = [pa.int64(), b.column(0).type, *[pa.int64()] * 4, *[pa.string()] * (1 + with_groups), pa.int64(), pa.string(), *[pa.binary()] * 5]
            for lo, hi in slices(b.column(1), 2 << 20):
                if len(known.number) > REMEMBERED:
                    known = Stretches()
                texts = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                cut = [aligner.cut(t) if t else [] for t in texts]
                aligner.learn(list(dict.fromkeys(s for c in cut for s in c if s not in known.number)), known)
                which = np.fromiter((known.number[s] for c in cut for s in c), dtype=np.int64)
                owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
                sizes, known_links, known_groups = known.flat()
                total = np.stack([np.bincount(owner, sizes[which, k], len(cut)).astype(np.int64) for k in range(5)]) if len(which) else np.zeros((5, len(cut)), np.int64)
                bad = total[4] > 0
                total[:, bad] = 0
                live = ~bad[owner] if len(owner) else np.zeros(0, bool)
                which, owner = which[live], owner[live]
                groups = pc.binary_join(lists(np.bincount(owner, minlength=len(cut)), known_groups.take(pa.array(which))), ";").to_pylist()
                said = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                arrays = [np.arange(key, key + len(cut)), b.column(0).slice(lo, hi - lo), *total[:4], pa.array(said), *([pa.array(groups)] if with_groups else [])]
                arrays = [pa.array(x) if isinstance(x, np.ndarray) else x for x in arrays]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.nulls(len(cut), t) for t in types[len(fields) :]]], names=schema.fieldNames())
                # links of all documents of the slice, those of one pair and document added up
                many = sizes[which, 3]
                ends = np.cumsum(many)
                start = (np.cumsum(sizes[:, 3]) - sizes[:, 3])[which]
                code = known_links[np.arange(many.sum()) + np.repeat(start - ends + many, many)]
                place = np.repeat(owner, many) + (key - base)
                joint, times = np.unique(place.astype(np.int64) << 40 | code, return_counts=True)
                held.append((joint & ((1 << 40) - 1), joint >> 40, times))
                size += len(joint)
                key += len(cut)
                if size >= records or key - base >= 1 << (DOC_BITS - 1):
                    yield from runs()
        if held:
            yield from runs()

    return docs.mapInArrow(run, schema)


def align(docs: DataFrame, ranks_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", radix: int = 8, records: int = 1 << 21, with_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, with with_groups, groups: one row a row of docs.

    A's tokens are those of space and text by a byte-level rank file, B's those of a sentencepiece model, which adds the space itself. Offsets
    where both end cut them into groups, written `a1,a2|b1;a3|b2,b3`; A and B tokens whose bytes overlap are links. A pair's count is how many links
    hold it in all texts; n_best counts the links whose count is the highest of their B id (ties all count), count_sum adds the counts.
    Null and empty texts, and texts that either vocabulary doesn't give back byte by byte (such as those with U+2581), have no tokens: zeros and
    an empty text. Rows that repeat an id are documents of their own, null ids are returned as they are, an empty table gives no
    rows. A very long text is read whole, some 60 bytes a byte of it in its task; its records spill like others."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(spill(base, ranks_path, model_path, radix, records, with_groups), "align-runs")
    runs = rows.where("part is not null")

    def count(t: pa.Table) -> pa.Table:
        made = merge_counts([(np.cumsum(unshuffled(p, "<u8").astype(np.int64)), unshuffled(n, "<u8").astype(np.int64)) for p, n in zip(t["pairs"].to_pylist(), t["links"].to_pylist(), strict=True)])
        one = len(made[0])
        return pa.table({"part": pa.array([t["part"][0].as_py()] * one, pa.int64()), "merge": [t["merge"][0].as_py()] * one, "pair": pa.array(made[0], pa.int64()), "n": pa.array(made[1], pa.int64())})

    merged = materialize(runs.select("part", "merge", "pairs", "links").groupBy("part", "merge").applyInArrow(count, "part long, merge string, pair long, n long"), "align-counts")
    total = merged.groupBy("pair").agg(F.sum("n").alias("count"))
    side = F.shiftright("pair", A_BITS)
    highest = total.groupBy(side.alias("b")).agg(F.max("count").alias("highest"))
    total = total.withColumn("b", side).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    counts = merged.select("part", "merge", "pair").join(total, "pair")

    def back(t: pa.Table, c: pa.Table) -> pa.Table:
        order = np.argsort(c["pair"].to_numpy())
        pair, number, best = (c[x].to_numpy()[order] for x in ("pair", "count", "best"))
        out = []
        for row in range(len(t)):
            p, _, s, d, n = (t[x][row].as_py() for x in ("pairs", "links", "sizes", "docs", "times"))
            at = np.repeat(np.searchsorted(pair, np.cumsum(unshuffled(p, "<u8").astype(np.int64))), unshuffled(s, "<u4"))
            doc = np.cumsum(unshuffled(d, "<u4"), dtype=np.uint32).astype(np.int64)
            times = unshuffled(n, "<u4").astype(np.int64)
            all_, most = times * number[at], times * best[at]
            # sums of whole numbers: in two halves, each of which a double holds
            add = lambda x: np.bincount(doc, x & ((1 << 26) - 1)).astype(np.int64) + (np.bincount(doc, x >> 26).astype(np.int64) << 26)  # noqa: B023, E731
            sums, hits = add(all_), add(most)
            seen = np.flatnonzero(sums)
            out.append(pa.table({"key": seen + t["key"][row].as_py(), "n_best": hits[seen], "count_sum": sums[seen]}))
        return pa.concat_tables(out) if out else pa.table({x: pa.array([], pa.int64()) for x in ("key", "n_best", "count_sum")})

    shares = runs.select("part", "merge", "key", "pairs", "links", "sizes", "docs", "times").groupBy("part", "merge").cogroup(counts.groupBy("part", "merge")).applyInArrow(back, "key long, n_best long, count_sum long")
    shares = shares.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.where("part is null").join(shares, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", *(["groups"] if with_groups else []))
