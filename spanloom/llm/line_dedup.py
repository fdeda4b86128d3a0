"""Line dedup with levelled sorted runs of line hashes in the shared folder."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import WHITE, delete_tables, materialize, shared_path
from spanloom.llm.textvec import slices

_WHITE = WHITE.encode()
KEY = ["h1", "h2"]
#: Frequent keys up to which cutting takes them along to the texts (16 bytes each); beyond, they are joined.
MOST_SHIPPED = 1 << 18


def line_hash(line: bytes) -> bytes | None:
    """128 bits of a line's key (stripped, A-Z in lower case); None for an empty key, which never counts."""
    key = line.strip(_WHITE).lower()
    return hashlib.blake2b(key, digest_size=16).digest() if key else None


def _pairs(hashes: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


class LevelledRuns:
    """Sorted runs of (h1, h2, n); every key is an entry of exactly one run, n being the documents that have the line.

    A new batch is merge-anti-joined with the runs: keys that no run has become a run of level 0; those that a run has are
    kept beside that run as additions to its counts. When a level has `fanout` runs, they are compacted to one run of the
    next level, the additions taken in, so N batches leave about fanout * log(N) runs. Runs are tables in the shared folder,
    bucketed and sorted by key alike, so that these joins merge files as they lie and move nothing."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.levels = spark, fanout, {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _keep(self, rows: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        whole = rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        whole.option("path", shared_path(self.spark, "line-run")).saveAsTable(name)
        kept = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the catalog's entry alone: the files are ours to delete
        return kept

    def runs(self) -> list[dict]:
        """{"entries": table, "more": tables of additions} of each run, the newest level first."""
        return [r for level in sorted(self.levels) for r in self.levels[level]]

    def add(self, lines: DataFrame) -> None:
        """lines: (h1, h2, n), n documents of the batch having the line; a key may stand in several rows."""
        batch = self._keep(lines.groupBy(*KEY).agg(F.sum("n").alias("n")))
        for run in self.runs():
            run["more"].append(self._keep(batch.join(run["entries"].select(*KEY), KEY, "left_semi")))
        self._open(0, self.unseen(batch))
        delete_tables(batch)

    def _open(self, level: int, entries: DataFrame) -> None:
        self.levels.setdefault(level, []).append({"entries": self._keep(entries), "more": []})
        if len(self.levels[level]) >= self.fanout:
            old = self.levels.pop(level)
            self._open(level + 1, self._whole(old))
            for run in old:
                delete_tables(run["entries"], *run["more"])

    def _whole(self, runs: list[dict]) -> DataFrame:
        """The entries of runs with their additions."""
        out = None
        for run in runs:
            one = run["entries"]
            if run["more"]:
                more = run["more"][0]
                for m in run["more"][1:]:
                    more = more.unionByName(m)
                more = more.groupBy(*KEY).agg(F.sum("n").alias("m"))
                one = one.join(more, KEY, "left").select(*KEY, (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
            out = one if out is None else out.unionByName(one)
        return out

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows of lines that no run has."""
        for run in self.runs():
            lines = lines.join(run["entries"].select(*KEY), KEY, "left_anti")
        return lines

    def counts(self) -> DataFrame:
        """(h1, h2, n) over all batches so far, one row a key."""
        return self._whole(self.runs()) if self.levels else self.spark.createDataFrame([], "h1 long, h2 long, n long")


def frequent_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, batches: int = 4, fanout: int = 4) -> DataFrame:
    """(h1, h2) of the line keys in at least min_docs documents. A document counts once for a key. Batches are chunks of
    whole documents as they are read, each chunk's counts combined before anything moves."""
    spark = docs.sparkSession

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId()
        for b in rows:
            for lo, hi in slices(b.column(0), 4 << 20):
                seen = Counter()
                for text in b.column(0).slice(lo, hi - lo).cast(pa.large_binary()).to_pylist():
                    seen.update({line_hash(x) for x in (text or b"").split(b"\n")})
                seen.pop(None, None)
                n = pa.array(list(seen.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([*_pairs(list(seen)), n, pa.array([batch % batches] * len(n), pa.int32())], names=[*KEY, "n", "batch"])
                batch += 1

    path = shared_path(spark, "line-hashes")
    docs.select(F.col(text_col).alias("text")).mapInArrow(count, "h1 long, h2 long, n long, batch int").write.partitionBy("batch").parquet(path)
    table = spark.read.schema("h1 long, h2 long, n long, batch int").parquet(path)
    runs = LevelledRuns(spark, fanout)
    for b in range(batches):
        runs.add(table.where(F.col("batch") == b).select(*KEY, "n"))
    return runs.counts().where(F.col("n") >= min_docs).select(*KEY)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, batches: int = 4, most_shipped: int = MOST_SHIPPED) -> DataFrame:
    """docs with its own columns, text rewritten, and n_lines, n_dropped: lines whose key is in at least min_docs
    documents go everywhere, the others stay, joined by \\n.

    Null and empty texts are one empty line (kept, text ""); a text that loses every line becomes ""; lines of
    white space alone have no key and stay. Rows that repeat a document count as documents of their own. Rows with a
    null id are kept like others. An empty table stays empty. Columns of any name are kept, but n_lines and n_dropped,
    which are replaced. Up to most_shipped frequent keys go along to where the texts lie; more are joined to each document's own
    keys, with the same result."""
    frequent = materialize(frequent_lines(docs, text_col, min_docs, batches), "line-frequent")
    rest = docs.drop("n_lines", "n_dropped")
    at = rest.columns.index(text_col)
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in rest.schema.fields])
    schema = T.StructType([*schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def parted(text: bytes | None, gone) -> tuple[int, list[bytes]]:
        lines = (text or b"").split(b"\n")
        return len(lines), [x for x in lines if line_hash(x) not in gone] if gone else lines

    def cut(column: pa.Array, gone: list) -> list[pa.Array]:
        """The new texts, the lines before and the lines dropped; gone: the set of each text."""
        done = [parted(t, g) for t, g in zip(column.cast(pa.large_binary()).to_pylist(), gone, strict=True)]
        texts = pa.array([b"\n".join(kept) for _, kept in done], pa.large_binary()).cast(pa.large_string()).cast(pa.string())
        return [texts, pa.array([n for n, _ in done], pa.int64()), pa.array([n - len(kept) for n, kept in done], pa.int64())]

    if frequent.count() <= most_shipped:
        keys = frequent.toArrow().to_pydict()
        shipped = docs.sparkSession.sparkContext.broadcast(np.column_stack([np.array(keys[k], dtype=np.int64) for k in KEY]))

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gone = {x.tobytes() for x in shipped.value}
            for b in rows:
                for lo, hi in slices(b.column(at), 4 << 20):
                    part = b.slice(lo, hi - lo)
                    text, *more = cut(part.column(at), [gone] * len(part))
                    columns = [*part.columns[:at], text, *part.columns[at + 1 :], *more]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return rest.mapInArrow(run, schema)

    def own(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for lo, hi in slices(b.column(1), 4 << 20):
                found = [{line_hash(x) for x in (t or b"").split(b"\n")} - {None} for t in b.column(1).slice(lo, hi - lo).cast(pa.large_binary()).to_pylist()]
                ids = b.column(0).take(pa.array(np.repeat(np.arange(lo, hi), [len(x) for x in found])))
                yield pa.RecordBatch.from_arrays([ids, *_pairs([h for x in found for h in x])], names=["id", *KEY])

    def run_joined(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for lo, hi in slices(b.column(1), 4 << 20):
                part = b.slice(lo, hi - lo)
                gone = [{np.array([x["h1"], x["h2"]], dtype=np.int64).tobytes() for x in g or ()} for g in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *cut(part.column(1), gone)], names=["row", text_col, "n_lines", "n_dropped"])

    id_type = docs.schema[id_col].dataType.simpleString()
    mine = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(own, f"id {id_type}, h1 long, h2 long")
    # rows of one id share their keys: what one of them may lose, the others may, wherever they have it
    hits = mine.join(frequent, KEY).groupBy("id").agg(F.collect_set(F.struct(*KEY)).alias("gone"))
    whole = rest.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("own"))
    joined = whole.join(hits, F.col("own").eqNullSafe(F.col("id")), "left").select("row", "text", "gone")
    inner = T.StructType([T.StructField("row", rest.schema), *[f for f in schema.fields if f.name in (text_col, "n_lines", "n_dropped")]])
    done = joined.mapInArrow(run_joined, inner)
    pick = [F.col(text_col) if c == text_col else F.col("row").getField(c).alias(c) for c in rest.columns]
    return done.select(*pick, "n_lines", "n_dropped")
