"""Nested documents: built from segment rows, written, read back, and indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.operators.text import span_text
from spanloom.sources.lines import blank
from spanloom.sources.tables import PAYLOAD, SPAN

FLAT = T.StructType([*SPAN.fields, T.StructField("segment_id", T.StringType()), T.StructField("segment_index", T.IntegerType())])
DOCUMENT = T.StructType([*PAYLOAD.fields, T.StructField("annotations", T.ArrayType(FLAT))])
SEGMENT = DOCUMENT["segments"].dataType.elementType.simpleString()
TASKS = ("title", "author")


def segment_records(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments with annotations, each as a struct, and the same annotations in document coordinates.

    docs: doc_id, content. segments: doc_id, segment_id, segment_index, segment_label, span_start, span_end, text and, for title and author,
    the field's text and its bounds <field>_start, <field>_end in the document. A null or empty text falls back to the slice of content. Each field
    whose bounds are both there becomes an annotation relative to the segment; its text is cut from the segment (clamped to it) and falls back
    to the field's own where that is blank. Segments without an annotation are left out."""
    d = segments.join(docs.select("doc_id", "content"), "doc_id")
    own = F.coalesce(F.nullif(F.col("text"), F.lit("")), span_text(F.col("content"), F.col("span_start"), F.col("span_end")), F.lit(""))
    d = d.withColumn("text", own).drop("content")

    def one(label: str) -> Column:
        start, end = F.col(f"{label}_start"), F.col(f"{label}_end")
        cut = span_text(F.col("text"), start - F.col("span_start"), end - F.col("span_start"))
        said = F.when(blank(cut) & (F.coalesce(F.col(label), F.lit("")) != ""), F.col(label)).otherwise(cut)
        return F.when(start.isNotNull() & end.isNotNull(), F.struct(F.lit(label).alias("label"), start.cast("long").alias("span_start"), end.cast("long").alias("span_end"), said.alias("text"), F.col("segment_id"), F.col("segment_index").cast("int").alias("segment_index")))

    d = d.withColumn("flat", F.array_compact(F.array(*map(one, TASKS)))).where(F.size("flat") > 0)
    local = F.transform("flat", lambda a: F.struct(a["label"].alias("label"), (a["span_start"] - F.col("span_start")).alias("span_start"), (a["span_end"] - F.col("span_start")).alias("span_end"), a["text"].alias("text")))
    record = F.struct("segment_id", F.col("segment_index").cast("int").alias("segment_index"), "segment_label", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"), "text", local.alias("annotations"))
    return d.select("doc_id", record.alias("segment"), "flat")


def payloads(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, filename, content, segments, annotations): a row a document; segments in order of start, annotations of start and label."""
    r = segment_records(docs, segments)
    per = r.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("segment.span_start").alias("at"), F.col("segment.segment_id").alias("id"), "segment")).alias("s"), F.flatten(F.collect_list("flat")).alias("a"))
    inner = F.transform(F.array_sort("s"), lambda x: x["segment"])
    flat = F.transform(F.array_sort(F.transform("a", lambda x: F.struct(x["span_start"].alias("s"), x["label"].alias("l"), x["segment_id"].alias("i"), x.alias("x")))), lambda x: x["x"])
    none = lambda name: F.array().cast(DOCUMENT[name].dataType)
    d = docs.select("doc_id", "filename", F.coalesce("content", F.lit("")).alias("content")).join(per, "doc_id", "left")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), "filename", "content", F.coalesce(inner.cast(DOCUMENT["segments"].dataType), none("segments")).alias("segments"), F.coalesce(flat.cast(DOCUMENT["annotations"].dataType), none("annotations")).alias("annotations"))


def write(rows: DataFrame, path: str) -> None:
    """Texts and nested annotations as JSON Lines, side by side: path/texts and path/annotations."""
    rows.select("doc_id", "content").write.json(f"{path}/texts")
    rows.select("doc_id", "filename", "segments", "annotations").write.json(f"{path}/annotations", ignoreNullFields=False)


def parsed(raw: DataFrame, value: str = "value") -> DataFrame:
    """raw with d (the nested document) and broken: whether the text isn't such a document."""
    schema = T.StructType([*DOCUMENT.fields, T.StructField("_corrupt_record", T.StringType())])
    d = raw.withColumn("d", F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return d.withColumn("broken", F.col("d").isNull() | F.col("d._corrupt_record").isNotNull())


def read(spark: SparkSession, path: str) -> DataFrame:
    """What write() wrote: doc_id, content, d, broken; each document once, those with an empty text left out."""
    texts = spark.read.schema("doc_id string, content string").json(f"{path}/texts").where("length(content) > 0").dropDuplicates(["doc_id"])
    notes = parsed(spark.read.text(f"{path}/annotations")).withColumn("doc_id", F.col("d.doc_id")).dropDuplicates(["doc_id"])
    return notes.where("not broken").join(texts, "doc_id").select("doc_id", "content", "d", "broken")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of one text and one annotation file a document (path/texts/<id>.txt, path/annotations/<id>.json): doc_id, content, d, broken.

    Whole files are read; a document without either file, or with an empty one, is left out; broken ones are marked for the caller to
    count or drop. Of files of one name the first by path counts."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)\\.[^./]*$", 1)

    def whole(glob: str, name: str) -> DataFrame:
        d = spark.read.text(glob, wholetext=True, recursiveFileLookup=True).select(stem.alias("doc_id"), F.col("_metadata.file_path").alias("p"), F.col("value"))
        return d.groupBy("doc_id").agg(F.min_by("value", "p").alias(name)).where(F.length(name) > 0)

    both = whole(f"{path}/annotations", "value").join(whole(f"{path}/texts", "content"), "doc_id")
    return parsed(both).select("doc_id", "content", "d", "broken")


def index(rows: DataFrame) -> DataFrame:
    """One entry a document of read() or read_files(), broken ones left out."""
    has = lambda label: F.coalesce(F.exists("d.annotations", lambda a: a["label"] == label), F.lit(False)).alias(f"has_{label}")
    many = lambda c: F.coalesce(F.size(f"d.{c}"), F.lit(0)).cast("long")
    size = lambda c: F.greatest(many(c), F.lit(0))
    good = rows.where("not broken")
    path = lambda folder, end: F.concat(F.lit(folder + "/"), F.col("doc_id"), F.lit(end))
    return good.select("doc_id", F.coalesce("d.filename", "doc_id").alias("filename"), F.length("content").cast("long").alias("content_length"), path("texts", ".txt").alias("text_path"), path("annotations", ".json").alias("annotations_path"), size("segments").alias("segment_count"), size("annotations").alias("annotation_count"), has("title"), has("author"))


def completed(rows: DataFrame) -> DataFrame:
    """doc_id of what an earlier run left whole."""
    return rows.where("not broken").select("doc_id").distinct()
