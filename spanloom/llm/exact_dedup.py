"""Exact dedup by an extendible-hash index kept in shared files.

The index holds one entry for each distinct normalised text. A bucket holds the entries whose 64-bit keys begin with its prefix and is one
folder of the shared index; the directory lists the buckets. Where a batch would bring a bucket over its capacity the directory doubles
there: the bucket splits by further bits until all parts fit. An owner task then takes a bucket's entries and the batch's rows in order of
key, chains the texts that share a key, compares their bytes, and writes the bucket anew. Later batches probe the same files; buckets
that they don't meet stay as they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import WHITE, delete_folders, materialize, shared_path

#: Further bits by which overfull buckets are counted in one go.
STEP = 8
#: Characters of distinct texts that a task holds while it combines copies before they move.
HELD = 1 << 25


def normalise(text: Column) -> Column:
    """The text without any of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def directory(counts: dict[int, int], depth: int, capacity: int) -> list[tuple[int, int]]:
    """Doubles from one bucket on: a bucket over capacity splits by its next bit, `depth` bits at most.
    counts: entries by the first `depth` bits. Returns (local depth, prefix) of each bucket, in key order."""
    buckets, todo = [], [(0, 0)]
    while todo:
        bits, prefix = todo.pop()
        lo, hi = prefix << (depth - bits), (prefix + 1) << (depth - bits)
        inside = sum(n for k, n in counts.items() if lo <= k < hi) if bits else sum(counts.values())
        if inside > capacity and bits < depth:
            todo += [(bits + 1, prefix * 2 + 1), (bits + 1, prefix * 2)]
        else:
            buckets.append((bits, prefix))
    return buckets


# --- inside tasks ------------------------------------------------------------------------------------------------


def _meet(chain: dict, text: tuple[int, str], n: int, who, members: int) -> int:
    """Takes a row into the entry of its text: the longest original stays, then the smallest id, null first. Returns the
    characters that a new entry adds."""
    entry = chain.get(text)
    if entry is None:
        chain[text] = [n, who, members]
        return len(text[1])
    if n > entry[0] or (n == entry[0] and entry[1] is not None and (who is None or who < entry[1])):
        entry[:2] = n, who
    entry[2] += members
    return 0


def _rows(chains: list[tuple], starts: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """Entries ((key, norm), [n, keep_id, members]) as a batch, with the bucket whose range of keys has the key."""
    key = np.array([k for (k, _), _ in chains], dtype=np.int64)
    bucket = (np.searchsorted(starts, key.view(np.uint64), "right") - 1).astype(np.int32)
    n, who, members = zip(*(e for _, e in chains), strict=True) if chains else ((), (), ())
    columns = [pa.array(bucket), pa.array(key), pa.array([t for (_, t), _ in chains], pa.string()), pa.array(n, pa.int32()), pa.array(who, kind), pa.array(members, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "key", "norm", "n", "keep_id", "members"])


def _listed(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(b.column(c).to_pylist() for c in ("key", "norm", "n", "keep_id", "members")), strict=True)


def _combine(starts: np.ndarray):
    """Copies that a task has met become one row, with its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, kind = {}, 0, None
        for b in batches:
            kind = b.schema.field("keep_id").type
            for key, norm, *row in _listed(b):
                held += _meet(seen, (key, norm), *row)
            if held > HELD:
                yield _rows(list(seen.items()), starts, kind)
                seen, held = {}, 0
        if seen:
            yield _rows(list(seen.items()), starts, kind)

    return run


def _own(starts: np.ndarray):
    """Rows in order of key become entries; only one key's chain is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, now, kind = {}, None, None
        for b in batches:
            kind, done = b.schema.field("keep_id").type, []
            for key, norm, *row in _listed(b):
                if key != now:
                    done += chain.items()
                    chain, now = {}, key
                _meet(chain, (key, norm), *row)
            yield _rows(done, starts, kind)
        if chain:
            yield _rows(list(chain.items()), starts, kind)

    return run


def _place(starts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((np.searchsorted(starts, key, "right") - 1).astype(np.int32)), b.column(1)], names=["bucket", "new"])

    return run


# --- the index -----------------------------------------------------------------------------------------------------


class ExtendibleIndex:
    """Buckets of entries (key, text_sha256, norm, n, keep_id, members), n being the code points of the original text of keep_id.

    The driver holds the directory alone, a row a bucket: keys / capacity rows at most times two. Choose a larger capacity for very
    large corpora, so that a bucket is a file of some 100 MB."""

    def __init__(self, spark: SparkSession, id_type: str = "long", capacity: int = 1 << 12):
        self.spark, self.capacity = spark, capacity
        self.row = f"key long, norm string, n int, keep_id {id_type}, members long"
        self.entry = f"key long, text_sha256 string, norm string, n int, keep_id {id_type}, members long"
        #: (bits, prefix) of each bucket: its folder, or None while it is empty
        self.buckets: dict[tuple[int, int], str | None] = {(0, 0): None}
        self.old: list[str] = []

    def read(self, buckets: list[tuple[int, int]]) -> DataFrame:
        """The entries of some buckets."""
        folders = [self.buckets[b] for b in buckets if self.buckets[b]]
        return self.spark.read.schema(self.entry).parquet(*folders) if folders else self.spark.createDataFrame([], self.entry)

    def entries(self) -> DataFrame:
        return self.read(list(self.buckets))

    def doubled(self, keys: DataFrame) -> list[tuple[int, int]]:
        """The directory, in order of key, that holds these distinct keys; counts only grow, so it refines every earlier one."""
        buckets, level, over = [], 0, [0] if keys.count() > self.capacity else []
        if not over:
            return list(self.buckets) if len(self.buckets) > 1 else [(0, 0)]
        while over:  # ends at 64 bits at the latest, where a bucket is one key
            step = min(STEP, 64 - level)
            inside = keys
            if level:
                full = F.broadcast(self.spark.createDataFrame([(p,) for p in over], "p long"))  # keys / capacity rows at most
                inside = keys.join(full, F.shiftrightunsigned("key", 64 - level) == F.col("p"), "left_semi")
            counts = {p: {} for p in over}
            for slot, c in inside.groupBy(F.shiftrightunsigned("key", 64 - level - step)).count().collect():
                slot %= 1 << 64
                counts[slot >> step][slot % (1 << step)] = c
            more = []
            for p in over:
                for bits, prefix in directory(counts[p], step, self.capacity):
                    whole = (p << bits) | prefix
                    if bits == step and counts[p].get(prefix, 0) > self.capacity:
                        more.append(whole)
                    else:
                        buckets.append((level + bits, whole))
            over, level = more, level + step
        return sorted(buckets, key=self.start)

    @staticmethod
    def start(bucket: tuple[int, int]) -> int:
        bits, prefix = bucket
        return prefix << (64 - bits)

    def add(self, rows: DataFrame, keys: DataFrame) -> None:
        """rows: (key, norm, n, keep_id, members), a text in any number of rows; keys: the same rows' keys alone."""
        new = keys.select("key", F.lit(1).alias("new")).unionByName(self.entries().select("key", F.lit(0).alias("new")))
        known = materialize(new.groupBy("key").agg(F.max("new").alias("new")), "exact-known")
        names = self.doubled(known)
        starts = np.array([self.start(b) for b in names], dtype=np.uint64)
        held = dict(known.mapInArrow(_place(starts), "bucket int, new int").groupBy("bucket").agg(F.max("new")).collect())
        stay = {b: self.buckets[b] for i, b in enumerate(names) if b in self.buckets and not held.get(i)}
        move = [b for b in self.buckets if b not in stay]

        placed = f"bucket int, {self.row}"
        both = rows.mapInArrow(_combine(starts), placed)
        if any(self.buckets[b] for b in move):
            both = both.unionByName(self.read(move).drop("text_sha256").mapInArrow(_combine(starts), placed))
        owned = both.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(_own(starts), placed)
        path = shared_path(self.spark, "exact-index")
        owned.withColumn("text_sha256", F.sha2("norm", 256)).write.partitionBy("bucket").parquet(path)
        self.old += [self.buckets[b] for b in move if self.buckets[b]]
        self.buckets = {b: stay[b] if b in stay else f"{path}/bucket={i}" if i in held else None for i, b in enumerate(names)}

    def vacuum(self) -> None:
        """Deletes the folders of buckets written anew since; results that were read from them must have been used by then."""
        delete_folders(self.spark, self.old)
        self.old = []


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1 << 12, index: ExtendibleIndex | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of docs.

    With an index, docs are its next batch: keep_id and group_size take in all batches so far, and docs' rows alone come back.
    What doubling can't part, texts of one key, chains in its bucket, which is always right. Each task combines its copies before the
    shuffle, so a hot group moves some rows a task.

    Null and empty texts, and texts of white space, are one group (equal to ""). Ties on length go to the
    smallest id; rows that repeat an id and text are members each and count as often as they stand, and the row of
    that id is marked kept each time. A null id sorts first. An empty table gives no rows. Other columns are ignored."""
    index = index or ExtendibleIndex(docs.sparkSession, docs.schema[id_col].dataType.simpleString(), capacity)
    base = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), normalise(F.col(text_col)).alias("norm"))
    base = base.withColumn("key", F.xxhash64("norm"))
    keys = materialize(base.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "exact-keys")
    index.add(base.select("key", "norm", "n", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("members")), keys.select("key"))
    found = keys.join(index.entries().select("key", "text_sha256", "keep_id", F.col("members").alias("group_size")), ["key", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that exact_dedup doesn't keep, all columns as they were."""
    keep = exact_dedup(docs, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias("__keep"), F.col("text_sha256").alias("__sha")).distinct()
    mine = F.col(id_col).eqNullSafe(F.col("__keep")) & (F.sha2(normalise(F.col(text_col)), 256) == F.col("__sha"))
    return docs.join(keep, mine, "left_semi")
