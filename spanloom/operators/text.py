"""Segments, tokens, windows and annotations as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.operators import labels
from spanloom.operators.adapters import delimiter_tokenizer, pieces_of

def segments(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a line of docs (doc_id, text): doc_id, segment_index, segment_id, span_start, span_end, text; offsets within the document; the columns
    `keep` of docs come behind. Lines are found and placed as rows are read, without a shuffle; a null text has no lines, an empty one has one."""
    names = [("segment_index", T.IntegerType()), ("segment_id", T.StringType()), ("span_start", T.LongType()), ("span_end", T.LongType()), ("text", T.StringType())]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(*f) for f in names], *[docs.schema[c] for c in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces_of(batch, pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), 1 << 20):
                lines = [[] if t is None else t.split("\n") for t in b.column(1).to_pylist()]
                count = np.array([len(x) for x in lines], dtype=np.int64)
                place = np.concatenate([np.arange(n) for n in count] or [np.zeros(0)]).astype(np.int32)
                size = np.fromiter((len(x) for own in lines for x in own), dtype=np.int64)
                ends = np.cumsum(size + 1)
                begin = ends - size - 1 - np.repeat(np.concatenate([[0], ends])[np.cumsum(count) - count], count)
                which = pa.array(np.repeat(np.arange(len(b)), count))
                owner = b.column(0).take(which)
                named = pc.binary_join_element_wise(pc.cast(owner, pa.string()), pc.cast(pa.array(place), pa.string()), ":")
                yield pa.RecordBatch.from_arrays([owner, pa.array(place), named, pa.array(begin), pa.array(begin + size), pa.array([x for own in lines for x in own], pa.string()), *[b.column(2 + k).take(which) for k in range(len(keep))]], names=schema.fieldNames())

    return docs.select("doc_id", "text", *keep).mapInArrow(run, schema)


def tokens(segs: DataFrame, delimiters: str = " ") -> DataFrame:
    """Pieces of text up to and with one delimiter, with offsets (doc_id, segment_index, segment_id, tok, piece, start, end), found as rows are read;
    pieces of white space and lone delimiters are dropped, offsets stay true."""
    names = [("tok", T.IntegerType()), ("piece", T.StringType()), ("start", T.LongType()), ("end", T.LongType())]
    schema = T.StructType([*[segs.schema[c] for c in ("doc_id", "segment_index", "segment_id")], *[T.StructField(*f) for f in names]])
    factory = delimiter_tokenizer(delimiters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = factory()
        for batch in batches:
            for b in pieces_of(batch, pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy(zero_copy_only=False), 1 << 20):
                texts = [t or "" for t in b.column(3).to_pylist()]
                spans = [x for _, x in cut(texts)]
                count = [len(x) for x in spans]
                owner = pa.array(np.repeat(np.arange(len(b)), count))
                tok = np.concatenate([np.arange(n) for n in count] or [np.zeros(0)]).astype(np.int32)
                edge = np.array([x for own in spans for x in own], dtype=np.int64).reshape(-1, 2)
                said = pa.array([t[s:e] for t, own in zip(texts, spans, strict=True) for s, e in own], pa.string())
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(owner) for k in range(3)], pa.array(tok), said, pa.array(edge[:, 0].copy()), pa.array(edge[:, 1].copy())], names=schema.fieldNames())

    return segs.select("doc_id", "segment_index", "segment_id", "text").mapInArrow(run, schema)


def text_windows(rows: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """rows (text, offsets: array<struct<start, end>>) with windows of text from either end: name, char_start, char_end, n_tokens, window_text.

    Up to 2 * size tokens: one window "full" with the whole text, from the first token to the last; a text without a token has an empty one. Else
    "begin" and "end" of `size` tokens each, whose text is that of their tokens, one after the other."""
    n = F.size("offsets")
    edge = lambda toks, i, c: F.coalesce(F.get(toks, i)[c].cast("long"), F.lit(0).cast("long"))

    def window(name: str, toks: Column, whole: bool) -> Column:
        start, end = edge(toks, F.lit(0), "start"), edge(toks, F.size(toks) - 1, "end")
        # the text is cut once from the first token to the last, and tokens from that: each cut reads its string from the beginning
        lo = F.greatest(start, F.lit(0))
        part = F.struct(toks.alias("toks"), lo.alias("lo"), F.substring(text_col, (lo + 1).cast("int"), (end - lo).cast("int")).alias("part"))
        said = labels.let(part, lambda x: F.array_join(F.transform(x["toks"], lambda t: span_text(x["part"], t["start"] - x["lo"], t["end"] - x["lo"])), ""))
        return F.struct(F.lit(name).alias("name"), start.alias("char_start"), end.alias("char_end"), F.size(toks).cast("long").alias("n_tokens"), (F.when(n > 0, F.col(text_col)).otherwise(F.lit("")) if whole else said).alias("window_text"))

    full = F.array(window("full", F.col("offsets"), True))
    two = F.array(window("begin", F.slice("offsets", 1, size), False), window("end", F.slice("offsets", n - size + 1, F.lit(size)), False))
    kept = [c for c in rows.columns if c not in (text_col, "offsets")]
    w = rows.select(*kept, F.explode(F.when(n <= 2 * size, full).otherwise(two)).alias("w"))
    return w.select(*kept, "w.*")


def with_text(spans: DataFrame, segs: DataFrame) -> DataFrame:
    text = segs.select("segment_id", F.col("text").alias("segment_text"))
    return spans.join(text, "segment_id").withColumn("text", span_text(F.col("segment_text"), F.col("span_start"), F.col("span_end"))).drop("segment_text")


def span_text(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with both ends clamped to the text."""
    lo = F.least(F.greatest(start, F.lit(0)), F.length(text))
    hi = F.least(F.greatest(end, lo), F.length(text))
    return F.substring(text, (lo + 1).cast("int"), (hi - lo).cast("int"))


def with_windows(rows: DataFrame, window: int, step: int, slides: int, keep: str = "reference", n: str = "n_tok") -> DataFrame:
    """rows with ws, the token windows from either end of each row's n tokens: array<struct<side, slide_index, start_tok, end_tok>>.

    keep="reference": a window that lies in another goes, so two equal ones go both; "first": the first of equals stays."""
    def both(n: Column) -> Column:
        index = F.sequence(F.lit(0), F.lit(slides - 1))
        begin = F.filter(F.transform(index, lambda i: F.struct(F.lit("begin").alias("side"), i.alias("slide_index"), (i * step).alias("start_tok"), F.least(i * step + window, n).alias("end_tok"))), lambda w: w["start_tok"] < n)
        end = F.filter(F.transform(index, lambda i: F.struct(F.lit("end").alias("side"), i.alias("slide_index"), F.greatest(n - i * step - window, F.lit(0)).alias("start_tok"), (n - i * step).alias("end_tok"))), lambda w: w["end_tok"] > 0)
        full = F.array(F.struct(F.lit("full").alias("side"), F.lit(0).alias("slide_index"), F.lit(0).alias("start_tok"), n.alias("end_tok")))
        return F.when(n <= window, full).otherwise(F.concat(begin, end))

    def place(w: Column) -> Column:
        return F.when(w["side"] == "end", w["slide_index"] + slides).otherwise(w["slide_index"])

    def covered(w: Column, v: Column) -> Column:
        inside = (v["start_tok"] <= w["start_tok"]) & (w["end_tok"] <= v["end_tok"]) & (place(v) != place(w))
        return inside if keep == "reference" else inside & ((v["start_tok"] != w["start_tok"]) | (v["end_tok"] != w["end_tok"]) | (place(v) < place(w)))

    ws = rows.withColumn("ws", both(F.col(n).cast("int")))
    return ws.withColumn("ws", F.filter("ws", lambda w: ~F.exists("ws", lambda v: covered(w, v))))


def slide_windows(n_tokens: DataFrame, window: int, step: int, slides: int, keep: str = "reference") -> DataFrame:
    """with_windows(), one row a window: segment_id, n_tok, side, slide_index, start_tok, end_tok."""
    ws = with_windows(n_tokens, window, step, slides, keep)
    return ws.select("segment_id", "n_tok", F.explode("ws").alias("w")).select("segment_id", "n_tok", "w.*")


def as_arrays(toks: DataFrame, anns: DataFrame) -> DataFrame:
    """One row a segment: offsets (array<struct<start, end>>, in order of tok) and its annotations (in order of start, end, label)."""
    t = toks.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("tok", "start", "end"))).alias("t"))
    a = anns.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", "label"))).alias("annotations"))
    none = F.array().cast("array<struct<span_start:bigint,span_end:bigint,label:string>>")
    rows = t.join(a, "segment_id", "left").withColumn("annotations", F.coalesce("annotations", none))
    return rows.select("segment_id", F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("offsets"), "annotations")


def bio_tags(toks: DataFrame, anns: DataFrame) -> DataFrame:
    """Each token's tag (segment_id, tok, start, end, tag), found in place on arrays of a segment's tokens and annotations. Of the annotations
    over a token, in order of start and then length, the first gives the entity; the last of that entity gives the prefix: B on its own first
    token, else I."""
    rows = as_arrays(toks, anns)
    rows = rows.withColumn("x", F.arrays_zip("offsets", labels.tags(F.col("offsets"), F.col("annotations")).alias("tag")))
    return rows.select("segment_id", F.posexplode("x").alias("tok", "x")).select("segment_id", "tok", "x.offsets.start", "x.offsets.end", "x.tag")


def bio_spans(tags: DataFrame) -> DataFrame:
    """Spans of tags: B opens, following I of its entity go on, an I without one is left out."""
    own = Window.partitionBy("segment_id").orderBy("tok")
    kind, entity = F.substring("tag", 1, 1), F.expr("substring(tag, 3)")
    t = tags.withColumn("kind", kind).withColumn("entity", entity)
    joins = (F.col("kind") == "I") & (F.lag("entity").over(own) == F.col("entity")) & (F.lag("kind").over(own) != "O")
    t = t.withColumn("island", F.sum(F.when(joins, 0).otherwise(1)).over(own))
    spans = t.where("kind != 'O'").groupBy("segment_id", "island").agg(F.min_by("kind", "tok").alias("lead"), F.lower(F.min("entity")).alias("label"), F.min("start").alias("span_start"), F.max("end").alias("span_end"))
    return spans.where("lead = 'B'").drop("island", "lead")
