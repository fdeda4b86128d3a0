"""The stand-ins for annotations and predictions over lines of text, as functions of a row, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.operators.text import span_text

SPANS = "array<struct<span_start:bigint,span_end:bigint,label:string,text:string>>"


def span(start: Column, end: Column, label: str | Column) -> Column:
    name = F.lit(label) if isinstance(label, str) else label
    said = span_text(F.col("text"), start, end)
    return F.struct(start.cast("long").alias("span_start"), end.cast("long").alias("span_end"), name.alias("label"), said.alias("text"))


def gold() -> Column:
    """The first three tokens of every third segment (title), the last two of every fifth (author), of segment_index, offsets and text."""
    n = F.size("offsets")
    at = lambda i, c: F.get("offsets", i)[c]
    title = F.when((F.col("segment_index") % 3 == 0) & (n > 0), span(at(F.lit(0), "start"), at(F.least(F.lit(3), n) - 1, "end"), "title"))
    author = F.when((F.col("segment_index") % 5 == 0) & (n > 0), span(at(F.greatest(n - 2, F.lit(0)), "start"), at(n - 1, "end"), "author"))
    return F.array_compact(F.array(title, author)).cast(SPANS)


def predicted(spans: Column) -> Column:
    """Spans dropped or shifted by fixed rules, and a spurious one in every seventh document."""
    shift, more = F.col("doc_id") % 13 - 6, F.col("segment_index") % 5 - 2
    start = lambda s: F.greatest(F.lit(0), s["span_start"] + shift)
    moved = F.transform(spans, lambda s: span(start(s), F.greatest(start(s) + 1, s["span_end"] + shift + more), s["label"]))
    kept = F.when((F.col("doc_id") + F.col("segment_index")) % 4 != 0, moved).otherwise(F.array().cast(SPANS))
    extra = F.array_compact(F.array(F.when((F.col("doc_id") % 7 == 0) & (F.col("segment_index") == 0), span(F.lit(5), F.lit(9), "title"))))
    return F.concat(kept, extra).cast(SPANS)
