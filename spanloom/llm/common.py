"""What the operators of this subpackage share: shared-folder tables and connected components."""

from __future__ import annotations

import gc
import hashlib
import io
import os
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.shared import shared_dir

#: White space of the word and line contracts: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, by way of the shared folder, and bounds the bytes of a batch that
    they get, as texts may be long."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # the default; other values are the user's
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    files = sorted(os.path.join(folder, name) for folder, _, names in os.walk(os.path.join(REPO, "spanloom")) for name in names if name.endswith(".py"))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, os.path.relpath(f, REPO))
    name = f"spanloom-{hashlib.sha256(packed.getvalue()).hexdigest()[:16]}.zip"
    sc = spark.sparkContext
    if not files or any(f.endswith(name) for f in sc.listFiles):  # no files: imported from a package that was sent already
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(path.toString())


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage so that lost executors cost
    a reread, and lets Spark drop the shuffle files behind it."""
    spark = df.sparkSession
    path = path or shared_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    schema = df.schema
    del df
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more; it works on its own thread."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete_tables(*tables: DataFrame) -> None:
    """Deletes tables made by materialize() that no later step reads."""
    for df in tables:
        delete_folders(df.sparkSession, {p.rsplit("/", 1)[0] for p in df.inputFiles()})


def delete_folders(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b longs): root is the smallest node of its component.

    Each round hooks every node to the first of itself and its neighbours, jumps pointers once and contracts the edges, until no edge
    is left. One end of every edge hooks to another node, so nodes fall with every round. The first two rounds go by id, which ends
    stars; from the third on each round orders the nodes anew by a hash, so that chains of rising ids and the like take about
    log(nodes) rounds too. Every step is a join or an aggregate;
    each round's tables are written to the shared folder. Edges with a null end and loops are ignored."""
    spark = edges.sparkSession
    left = materialize(edges.selectExpr("least(a, b) a", "greatest(a, b) b").where("a < b").distinct(), "cc-edges")
    labels, r = None, 0
    while not left.isEmpty():
        both, place = left.unionByName(left.selectExpr("b a", "a b")), lambda c, r=r: F.col(c) if r < 2 else F.xxhash64(F.col(c), F.lit(r))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", place("b")).alias("b"))
        hook = materialize(first.select("node", F.when(place("b") < place("node"), F.col("b")).otherwise(F.col("node")).alias("p")), "cc-hook")
        up = hook.selectExpr("node p", "p pp")
        jump = materialize(hook.join(up, "p", "left").selectExpr("node", "coalesce(pp, p) root"), "cc-jump")
        if labels is None:
            labels = jump
        else:
            after = jump.selectExpr("node root", "root r2")
            labels = materialize(labels.join(after, "root", "left").selectExpr("node", "coalesce(r2, root) root"), "cc-labels")
        ja, jb = jump.selectExpr("node a", "root ra"), jump.selectExpr("node b", "root rb")
        left = materialize(
            left.join(ja, "a").join(jb, "b").selectExpr("least(ra, rb) a", "greatest(ra, rb) b").where("a < b").distinct(), "cc-edges"
        )
        r += 1
    if labels is None:
        return spark.createDataFrame([], "node long, root long")
    least = materialize(labels.groupBy("root").agg(F.min("node").alias("least")), "cc-least")
    return labels.join(least, "root").selectExpr("node", "least root")
