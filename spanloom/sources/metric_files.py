"""Metric files of evaluation runs: read whole, whatever fields they have, and turned into reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "precision double, recall double, f1 double, tp long, fp long, fn long"
HITS = "map<string,struct<row_hit_rate_start:double,row_hit_rate_end:double,row_hit_rate_both:double,row_hit_rate_both_overlap:double>>"


def metric_files(spark: SparkSession, paths: str | list[str], prefix: str = "benchmark_", suffix: str = "_metrics", inner: str = "row_metrics") -> DataFrame:
    """One row a JSON file (of write_runs(), by the run's name): file, run_id, model, fields (map of the metrics' names to their JSON), whole (the text), broken.

    A byte-order mark is left out. Metrics stand under `inner` or, where that is missing, at the root. run_id falls back to the file's name without
    its ending, model to that name without prefix and suffix. A file that isn't a JSON object is marked broken and has no fields."""
    raw = spark.read.text(paths, wholetext=True).select(F.coalesce(F.nullif(F.regexp_extract(F.col("_metadata.file_path"), "/name=([^/]+)/[^/]+$", 1), F.lit("")), F.col("_metadata.file_name")).alias("file"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("whole"))
    top = F.from_json("whole", "map<string,string>")
    stem = F.regexp_replace("file", "\\.[^.]*$", "")
    d = raw.withColumn("top", top).withColumn("broken", F.col("top").isNull())
    fields = F.coalesce(F.from_json(F.col("top")[inner], "map<string,string>"), F.col("top"))
    name = lambda key, other: F.coalesce(F.col("top")[key], other).alias(key)
    kind = F.coalesce(F.col("top")["model_kind"], F.replace(F.replace(stem, F.lit(prefix), F.lit("")), F.lit(suffix), F.lit("")))
    return d.select("file", name("run_id", stem), kind.alias("model"), fields.alias("fields"), "whole", "broken")


def blocks(files: DataFrame) -> DataFrame:
    """(file, model, metric, precision, recall, f1, tp, fp, fn): the metrics that are blocks with an f1; others and null ones are left out."""
    each = files.select("file", "model", F.explode("fields").alias("metric", "json")).where(F.col("json").startswith("{"))
    return each.withColumn("b", F.from_json("json", BLOCK)).where("b.f1 is not null").select("file", "model", "metric", "b.*")


def pct(x: Column) -> Column:
    """A share as a percentage of two decimals; n/a for null."""
    return F.when(x.isNull(), F.lit("n/a")).otherwise(F.format_string("%.2f%%", F.round(x * 100, 6)))


def delta(x: Column) -> Column:
    """A difference of shares in percentage points with its sign; n/a for null."""
    return F.when(x.isNull(), F.lit("n/a")).otherwise(F.format_string("%+.2f pp", F.round(x * 100, 6)))


def in_order(d: DataFrame, order: list[str]) -> DataFrame:
    """d with place: models in the given order, then the others by name. Rows are one a run, so that one task ranks them."""
    from pyspark.sql import Window

    known = F.array_position(F.array(*map(F.lit, order)) if order else F.array().cast("array<string>"), F.col("model"))
    return d.withColumn("place", F.row_number().over(Window.orderBy(F.when(known > 0, known).otherwise(F.lit(1 << 30)), "model", "file")).cast("long"))


def leaderboard(files: DataFrame, metrics: list[str], order: list[str]) -> DataFrame:
    """One row a run in order: model, rows, each metric's F1 as a percentage, the share of parse failures and the mean time a row, n/a where
    a file has none; a run without any metric keeps its row."""
    f1 = blocks(files).groupBy("file").pivot("metric", metrics).agg(F.first("f1")) if metrics else blocks(files).select("file").distinct()
    own = lambda key: F.col("fields")[key]
    d = files.where("not broken").join(f1, "file", "left")
    d = d.select("file", "model", own("rows_evaluated").cast("long").alias("rows"), *[pct(F.col(m)).alias(m) for m in metrics], pct(own("parse_fail_rate").cast("double")).alias("parse_fail"), F.coalesce(F.get_json_object(own("timing"), "$.mean_ms_per_row"), F.lit("n/a")).alias("mean_ms"))
    return in_order(d, order)


def side_by_side(files: DataFrame, candidate: str, baseline: str, metrics: list[str]) -> DataFrame:
    """One row a metric: both models' F1 and their difference; a metric that either lacks is n/a."""
    b = blocks(files)
    one = lambda model, name: F.max(F.when(F.col("model") == model, F.col("f1"))).alias(name)
    got = b.where(F.col("metric").isin(metrics)).groupBy("metric").agg(one(candidate, "c"), one(baseline, "b"))
    want = files.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    return want.join(got, "metric", "left").select("metric", pct(F.col("c")).alias("candidate"), pct(F.col("b")).alias("baseline"), delta(F.col("c") - F.col("b")).alias("gain"))


def offset_table(files: DataFrame) -> DataFrame:
    """(model, tolerance, start, end, both, both_overlap): the hit rates of files' offset diagnostics, a row a tolerance, as percentages."""
    hits = F.from_json(F.get_json_object(F.col("fields")["offset"], "$.tolerances"), HITS)
    each = files.where("not broken").select("model", F.explode(hits).alias("tolerance", "h"))
    return each.select("model", F.col("tolerance").cast("long").alias("tolerance"), *[pct(F.col(f"h.row_hit_rate_{c}")).alias(c) for c in ("start", "end", "both", "both_overlap")])


def markdown(table: DataFrame, columns: list[str]) -> DataFrame:
    """(place, line): table rows as Markdown, a row each; the heading comes first (-1), then its rule (0)."""
    head = table.sparkSession.createDataFrame([(-1, "| " + " | ".join(columns) + " |"), (0, "|" + "---|" * len(columns))], "place long, line string")
    cell = [F.coalesce(F.col(c).cast("string"), F.lit("n/a")) for c in columns]
    return head.unionByName(table.select("place", F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")).alias("line")))


def write_report(lines: DataFrame, path: str) -> None:
    """(place, line) as one text file; a report has a line a run."""
    lines.coalesce(1).sortWithinPartitions("place").select("line").write.text(path)


def write_runs(runs: DataFrame, path: str) -> None:
    """runs (name, json): a file a run, path/name=<name>/part-*.json, each a whole JSON text."""
    runs.select("name", "json").repartition("name").write.partitionBy("name").text(path)
