"""Positions and percentiles without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.sources.shared import written

BEFORE = (Window.unboundedPreceding, -1)


def positions(rows: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """rows with their place (from 0) in the order of any key that tells them apart: rows are parted into ranges of the key, as many as Spark
    shuffles into, and written to the shared folder with their range; the rows of the ranges before are added to the place within a range."""
    d = written(rows.repartitionByRange(F.col(key)).withColumn("__range", F.spark_partition_id()), "positions")
    per = d.groupBy("__range").count()  # a row a range
    before = per.select("__range", F.coalesce(F.sum("count").over(Window.orderBy("__range").rowsBetween(*BEFORE)), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return d.join(before, "__range").withColumn(name, place.cast("long")).drop("__range", "__before")


def value_ranks(rows: DataFrame, value: str, *by: str, width: float | None = None) -> DataFrame:
    """(by, value, c, upto, n): how often each value stands, how many rows are at or below it, and all rows of the group.

    Where values that differ are few, one task a group adds them up. With `width`, values are added up within ranges of that width first, so
    that a group may have as many values as rows; a width should leave some thousand ranges."""
    per = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    if width is None:
        upto = F.sum("c").over(Window.partitionBy(*by).orderBy(value))
        return per.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    per = per.withColumn("__range", F.floor(F.col(value) / width))
    inner = per.withColumn("__within", F.sum("c").over(Window.partitionBy(*by, "__range").orderBy(value)))
    ranges = per.groupBy(*by, "__range").agg(F.sum("c").alias("__c"))
    own = Window.partitionBy(*by)
    ranges = ranges.select(*by, "__range", F.coalesce(F.sum("__c").over(own.orderBy("__range").rowsBetween(*BEFORE)), F.lit(0)).alias("__before"), F.sum("__c").over(own).alias("n"))
    return inner.join(ranges, [*by, "__range"]).withColumn("upto", F.col("__before") + F.col("__within")).select(*by, value, "c", "upto", "n")


def at_rank(value: str, index: Column) -> Column:
    """Aggregate over value_ranks: the value at a 0-based rank."""
    return F.min(F.when(F.col("upto") > index, F.col(value)))


def between_ranks(value: str, share: float) -> Column:
    """Aggregate over value_ranks: the percentile by linear interpolation between the two ranks beside share * (n - 1)."""
    at = F.lit(share) * (F.max("n") - 1)
    low, high = at_rank(value, F.floor(F.lit(share) * (F.col("n") - 1))), at_rank(value, F.ceil(F.lit(share) * (F.col("n") - 1)))
    return low + (high - low) * (at - F.floor(at))
