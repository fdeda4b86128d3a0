"""Substring dedup by recompression.

Every text's words are named, then compressed in rounds: runs of one word get a name from (word, length), and
adjacent symbols whose names fall left and right in the round's partition of all names get a name from the pair.
A name is a hash of what it stands for, so all tasks give equal substrings equal names without asking
each other, and only symbols at a repeat's edges can differ. Spark then finds the high-level symbols that occur
more than once; a window that repeats holds at least one such group of symbols, so windows around shared symbols are
all that has to be verified, by two hashes of the window's words, 128 bits in all.

Why nothing is missed (window of 35 words, two rounds): a round's pairing depends on the two symbols alone, so a window loses at most one
symbol at each edge in a round; a run that the edge cuts loses its two words and the neighbour that pairs with its name, so one word more,
and windows with a run of three or more inside are verified in any case. That leaves 35 - 2 * (4 + 1) = 25 words parsed alike, in symbols
of at most 4 words. Anchors span at least 10 words, so at most 13, and the first 13 words of those 25 hold 4 starts of anchors; the
smallest of every 4 consecutive ones is kept. `geometry` does this sum for other lengths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import delete_tables, materialize
from spanloom.llm.textvec import PLACE, Words, mix, slices

U = np.uint64
ROUNDS = 2
_P1, _P2 = U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
_I1, _I2 = (U(pow(int(p), -1, 2**64)) for p in (_P1, _P2))


def geometry(window: int) -> tuple[int, int, int]:
    """(rounds, words of an anchor at least, consecutive starts of which one is kept) that miss no window."""
    for rounds in range(ROUNDS, -1, -1):
        longest = 2**rounds
        inside = window - 2 * (2**rounds + 1 if rounds else 0)
        span = max(1, min(10, inside - longest + 1))
        starts = (inside - (span + longest - 1)) // longest + 1
        if inside >= span + longest - 1 and starts >= 1:
            return rounds, span, starts
    return 0, window, 1


def powers(base: U, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def spans(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: U, inverse: U) -> np.ndarray:
    """A hash of x[lo:hi] for each pair, the same wherever the values stand."""
    total = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * powers(base, len(x))[: len(x)], out=total[1:])
    return mix((total[hi] - total[lo]) * powers(inverse, len(x))[lo] + (hi - lo).astype(np.uint64))


def recompress(words: Words, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first word, text) after the rounds; texts never merge."""
    sym, text = words.hashes, words.text_of()
    at = np.arange(len(sym))
    for r in range(rounds):
        if r == 0 and len(sym):  # runs of a word; equal neighbours never pair, so later rounds need no runs
            new = np.ones(len(sym), dtype=bool)
            new[1:] = (sym[1:] != sym[:-1]) | (text[1:] != text[:-1])
            head = np.flatnonzero(new)
            length = np.diff(np.append(head, len(sym)))
            named = np.where(length >= 3, mix(sym[head] * PLACE[60] + length.astype(np.uint64)), sym[head])
            keep = new | np.repeat(length < 3, length)
            sym, at, text = np.repeat(named, np.where(length >= 3, 1, length)), at[keep], text[keep]
        right = (mix(sym ^ PLACE[40 + r]) >> U(63)).astype(bool)
        pair = np.zeros(len(sym), dtype=bool)
        if len(sym) > 1:
            pair[:-1] = ~right[:-1] & right[1:] & (text[1:] == text[:-1])
        first = np.flatnonzero(pair)
        sym = sym.copy()
        sym[first] = mix(sym[first] * PLACE[50] + sym[first + 1] * PLACE[51] + U(r))
        keep = np.ones(len(sym), dtype=bool)
        keep[first + 1] = False
        sym, at, text = sym[keep], at[keep], text[keep]
    return sym, at, text


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, text, first word in the text, words) of the anchors kept."""
    rounds, span, keep = geometry(window)
    sym, at, text = recompress(words, rounds)
    ends = np.append(at[1:], len(words.hashes))  # symbols lie side by side
    lo = np.arange(len(sym))
    hi = np.searchsorted(ends, at + span)  # the last symbol of each anchor
    ok = hi < len(sym)
    ok[ok] = text[hi[ok]] == text[lo[ok]]
    length = np.where(ok, ends[np.minimum(hi, len(sym) - 1)] - at, 0) if len(sym) else at
    ok &= length <= window
    name = spans(sym, lo, np.where(ok, hi + 1, lo), _P1, _I1)
    # kept: the smallest of any `keep` consecutive starts of a text; starts that are no anchor count as largest
    rank = np.where(ok, name, np.iinfo(np.uint64).max)
    chosen = np.zeros(len(sym), dtype=bool)
    for back in range(keep if len(sym) >= keep else 0):
        # is start i the smallest of the window that begins at i - back?
        w = np.lib.stride_tricks.sliding_window_view(rank, keep)
        begins = np.arange(len(w))
        whole = text[begins] == text[begins + keep - 1]
        least = w.min(axis=1)
        mine = begins + back
        chosen[mine[whole & (rank[mine] == least)]] = True
    short = np.bincount(text, minlength=len(words.first) - 1)[text] < keep if len(sym) else chosen
    chosen = (chosen | short) & ok
    return name[chosen], text[chosen], at[chosen] - words.first[text[chosen]], length[chosen]


def _emit_anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            for lo, hi in slices(texts):
                name, text, first, length = anchors(Words(texts.slice(lo, hi - lo)), window)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(rid[lo:hi][text]), pa.array((first * 64 + length).astype(np.int64))], names=["name", "rid", "place"])

    return run


def _emit_windows(window: int):
    """Of each text the windows that hold a shared anchor or a run of three, with their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, shared = b.column(1), b.column(2)
            for lo, hi in slices(texts):
                words = Words(texts.slice(lo, hi - lo), lanes=2)
                first, h, total = words.first, words.hashes, len(words.hashes)
                mark = np.zeros(total + 1, dtype=np.int64)
                part = shared.slice(lo, hi - lo)
                text = np.repeat(np.arange(hi - lo), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                place = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                a, length = first[text] + place // 64, place % 64
                np.add.at(mark, np.maximum(first[text], a + length - window), 1)
                np.add.at(mark, a + 1, -1)
                of = words.text_of()
                if total > 2:
                    run3 = np.flatnonzero((h[2:] == h[1:-1]) & (h[1:-1] == h[:-2]) & (of[2:] == of[:-2]))
                    np.add.at(mark, np.maximum(first[of[run3]], run3 + 3 - window), 1)
                    np.add.at(mark, run3 + 1, -1)
                start = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                start = start[start + window <= first[of[start] + 1]]
                h1, h2 = spans(h, start, start + window, _P1, _I1), spans(words.others, start, start + window, _P2, _I2)
                offsets = pa.array(np.searchsorted(start, first).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((start - first[of[start]]).astype(np.int32), h1.view(np.int64), h2.view(np.int64))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *lists], names=["rid", "starts", "h1", "h2"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            for lo, hi in slices(texts):
                words = Words(texts.slice(lo, hi - lo), lanes=0)
                n = np.diff(words.first)
                whole = b.column(3).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                gone, kept = [], []
                data = words.data.tobytes()
                for t, starts in enumerate(b.column(2).slice(lo, hi - lo).to_pylist()):
                    cover = np.zeros(n[t] + 1, dtype=np.int64)
                    if whole[t] and n[t] >= window:
                        cover[0] = 1
                    elif starts:
                        s = np.array(starts, dtype=np.int64)
                        np.add.at(cover, s, 1)
                        np.add.at(cover, s + window, -1)
                    stay = np.flatnonzero(np.cumsum(cover)[: n[t]] == 0)
                    gone.append(n[t] - len(stay))
                    i = stay + words.first[t]
                    kept.append(b" ".join([data[x:y] for x, y in zip(words.starts[i].tolist(), words.ends[i].tolist(), strict=True)]))
                texts_out = pa.array(kept, pa.binary()).cast(pa.string())
                sha = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(np.array(gone, dtype=np.int64)), sha, texts_out], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row: kept are the words that no repeated window covers, joined
    by a space. A window is `window` (at most 60) consecutive words of one text; it is repeated when its words also start anywhere else,
    in the same text too. All is judged on the input.

    Null counts as empty: no words, kept "". Texts shorter than the window lose nothing. Rows that repeat an id count as
    texts of their own; texts that are equal as a whole are found first, lose all their words if long enough, and
    take part once. A null id is returned as null. An empty table gives no rows. Other columns are ignored."""
    if not 1 <= window <= 60:
        raise ValueError("window: 1 to 60 words")
    id_type = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("rid", F.xxhash64("doc_id", "text"))

    # texts that are one symbol as a whole
    prints = base.select("rid", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(3), "text").alias("t2"))
    copies = prints.groupBy("t1", "t2").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = materialize(copies, "sub-groups")  # a table of its own, so that Spark can split the join's hot keys
    copied = materialize(prints.join(copies, ["t1", "t2"]).select("rid", (F.col("rid") == F.col("rep")).alias("is_rep")).distinct(), "sub-copies")
    delete_tables(copies)

    found = base.select("rid", "text").mapInArrow(_emit_anchors(window), "name long, rid long, place long")
    shared = found.groupBy("name").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("name")
    shared = materialize(shared, "sub-names")
    spots = materialize(found.join(shared, "name").groupBy("rid").agg(F.collect_set("place").alias("places")), "sub-spots")

    todo = base.select("rid", "text").join(spots, "rid", "left").join(copied.where("not is_rep").select("rid"), "rid", "left_anti")
    windows = todo.select("rid", "text", "places").mapInArrow(_emit_windows(window), "rid long, starts array<int>, h1 array<long>, h2 array<long>")
    windows = materialize(windows.where(F.size("starts") > 0), "sub-windows")
    delete_tables(shared, spots)
    each = windows.select("rid", F.explode(F.arrays_zip("starts", "h1", "h2")).alias("w")).select("rid", F.col("w.starts").alias("start"), "w.h1", "w.h2")
    twice = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "h2")
    twice = materialize(twice, "sub-twice")
    repeated = materialize(each.join(twice, ["h1", "h2"]).groupBy("rid").agg(F.collect_set("start").alias("starts")), "sub-repeated")
    delete_tables(windows, twice)

    marks = repeated.join(copied.select("rid", F.lit(True).alias("whole")), "rid", "full_outer").select("rid", "starts", F.coalesce("whole", F.lit(False)).alias("whole"))
    out = base.join(marks, "rid", "left").select("doc_id", "text", "starts", F.coalesce("whole", F.lit(False)).alias("whole"))
    return out.mapInArrow(_cut(window), f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, kept string")
