"""Sources and sinks: Parquet folders, JSON Lines with a fixed schema, JDBC, and resumable appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("span_start", T.LongType()), T.StructField("span_end", T.LongType()), T.StructField("text", T.StringType())])
INDEX = "doc_id string, filename string, content_length long, text_path string, annotations_path string, segment_count long, annotation_count long, has_title boolean, has_author boolean"
PAYLOAD = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("segments", T.ArrayType(T.StructType([T.StructField("segment_id", T.StringType()), T.StructField("segment_index", T.IntegerType()), T.StructField("segment_label", T.StringType()), T.StructField("span_start", T.LongType()), T.StructField("span_end", T.LongType()), T.StructField("text", T.StringType()), T.StructField("annotations", T.ArrayType(SPAN))]))),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON Lines with a fixed schema; lines that can't be parsed are kept in _corrupt_record for the caller to drop or raise on."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if "_corrupt_record" not in schema.fieldNames():
        schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).json(path)


def jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database query, read in ranges of a numeric key where its bounds are given; filters and columns are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if key and bounds:
        return reader.options(dbtable=f"({query}) q", partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts).load()
    return reader.option("query", query).load()


def unnest_segments(payload: DataFrame) -> DataFrame:
    """One row a segment of nested documents, with the defaults 0, "TEXT" and "" for what is missing."""
    s = payload.select("doc_id", "filename", F.explode("segments").alias("s"))
    has = lambda label: F.coalesce(F.exists("s.annotations", lambda a: a["label"] == label), F.lit(False))
    return s.select("doc_id", "filename", "s.segment_id", F.coalesce("s.segment_index", F.lit(0)).alias("segment_index"), F.coalesce("s.segment_label", F.lit("TEXT")).alias("segment_label"), F.coalesce("s.text", F.lit("")).alias("text"), has("title").alias("has_title"), has("author").alias("has_author"))


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys an earlier run hasn't written yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def append(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Appends what `path` doesn't have yet, so that a run can be taken up again; keys are compared null-safe."""
    from spanloom.sources.shared import exists

    spark = rows.sparkSession
    if exists(spark, path):
        done = spark.read.parquet(path).select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        rows = rows.join(done, same, "left_anti")
    rows.write.mode("append").parquet(path)


def shards(rows: DataFrame, path: str, per_file: int = 75) -> None:
    """Snappy Parquet of at most per_file rows a file."""
    rows.write.option("maxRecordsPerFile", per_file).option("compression", "snappy").parquet(path)


def dataset(spark: SparkSession, path: str, columns: list[str], most: int | None = None, key: str | None = None, seed: int = 42) -> DataFrame:
    """The model's columns of a data set (JSON Lines where the path says so, else Parquet); with `most`, that many rows in the keyed order of `key`."""
    rows = spark.read.json(path) if ".json" in path else spark.read.parquet(path)
    if most is not None:
        from spanloom.functions.spans import keyed_order

        rows = rows.orderBy(keyed_order(seed, F.col(key)), key).limit(most)
    return rows.select(*columns)


def with_texts(rows: DataFrame, texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """rows with their text: their own, or where it is null or empty that of `texts` (keys, text), if there is one."""
    other = texts.select(*keys, F.col(text).alias("__text"))
    both = rows.join(other, keys, "left").withColumn(text, F.coalesce(F.nullif(F.col(text), F.lit("")), "__text", F.col(text)))
    return both.drop("__text")
