"""Append-and-resume as a stream: new files of rows are scored once each under a checkpoint."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.sources.shared import exists

ROWS, KEYS = "rows", "keys"


def scored(spark: SparkSession, sink: str) -> DataFrame:
    """What score_new_rows() has written so far."""
    return spark.read.parquet(f"{sink}/{ROWS}").drop("run", "batch")


def write_batch(batch: DataFrame, number: int, run: str, score: Callable[[DataFrame], DataFrame], sink: str, key: str, buckets: int) -> None:
    """One batch of a run. It owns sink/rows/run=<run>/batch=<number>, written whole, so that a batch that is killed and runs again leaves no
    repeat. Its keys go to sink/keys beside it, by bucket, after its rows; other batches' keys are probed there, in the buckets that this one
    meets, and their rows are never read again."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")
    null, known = batch.where(F.col(key).isNull()), batch.where(F.col(key).isNotNull()).dropDuplicates([key])
    if exists(spark, f"{sink}/{KEYS}"):
        met = [r[0] for r in known.select(bucket).distinct().collect()]  # buckets: at most as many as the index has
        old = spark.read.parquet(f"{sink}/{KEYS}").where((F.col("run") != run) | (F.col("batch") != number)).where(F.col("bucket").isin(met))
        known = known.join(old.select(key), key, "left_anti")
    rows = known.unionByName(null)  # a row without a key is none of the others
    out = f"{sink}/{ROWS}/run={run}/batch={number}"
    score(rows).write.mode("overwrite").parquet(out)
    keys = spark.read.parquet(out).where(F.col(key).isNotNull()).select(key, bucket)
    keys = keys.withColumn("run", F.lit(run)).withColumn("batch", F.lit(number))
    keys.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch", "bucket").parquet(f"{sink}/{KEYS}")


def score_new_rows(spark: SparkSession, source: str, schema: str, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "row_id", buckets: int = 64) -> StreamingQuery:
    """Reads what has come to `source` since the last call and writes the rows whose key the sink doesn't have, scored; of rows that repeat a
    key one stays, rows with a null key all stay. No state is kept between batches but the index of keys; score() must keep the key
    column. A new checkpoint is a new run: its batches don't overwrite those of another."""

    def write(batch: DataFrame, number: int) -> None:
        meta = batch.sparkSession.read.text(f"{checkpoint}/metadata").first()
        write_batch(batch, number, json.loads(meta.value)["id"], score, sink, key, buckets)

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
