"""Matching of gold and predicted spans, and what is summed up from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import spans as S


def span_rows(segs: DataFrame, gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row a segment with its gold and predicted spans as arrays in order of start, end, label."""
    pack = lambda df, name: df.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", "label", "text"))).alias(name))
    rows = segs.select("doc_id", "segment_index", "segment_id").join(pack(gold, "gold"), "segment_id", "left").join(pack(pred, "pred"), "segment_id", "left")
    none = F.array().cast("array<struct<span_start:bigint,span_end:bigint,label:string,text:string>>")
    return rows.withColumn("gold", F.coalesce("gold", none)).withColumn("pred", F.coalesce("pred", none)).where((F.size("gold") > 0) | (F.size("pred") > 0))


def counts(rows: DataFrame, match: str) -> DataFrame:
    """tp, fp, fn of each row by one match family ("exact" works on sets)."""
    if match == "exact":
        tp, fp, fn = S.exact_hits(F.col("gold"), F.col("pred"))
        return rows.select("doc_id", "segment_index", "segment_id", tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"))
    tp = S.greedy(F.col("gold"), F.col("pred"), S.MATCHES[match]).cast("long")
    out = rows.select("doc_id", "segment_index", "segment_id", tp.alias("tp"), F.size("gold").alias("g"), F.size("pred").alias("p"))
    return out.select("doc_id", "segment_index", "segment_id", "tp", (F.col("p") - F.col("tp")).cast("long").alias("fp"), (F.col("g") - F.col("tp")).cast("long").alias("fn"))


def totals(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    return [F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn")]


def with_prf(sums: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumn("precision", F.round(S.precision(tp, fp), 6)).withColumn("recall", F.round(S.recall(tp, fn), 6)).withColumn("f1", F.round(S.f1(tp, fp, fn), 6))


def offset_rows(rows: DataFrame, keys: list[str], tolerances: tuple[int, ...] = (10, 50)) -> DataFrame:
    """keys, has_gold, has_pred, paired, iou, start_err, end_err and, for each tolerance, start_N, end_N, both_N and overlap_N, of rows of gold
    and pred arrays. Errors are signed and come from the pair of one label with the largest IoU, the first on ties; a row without
    such a pair has IoU 0, null errors and false flags. Nothing is shuffled: pairs are compared within the row."""
    pairs = F.flatten(F.transform("gold", lambda g, i: F.transform(F.col("pred"), lambda p, j: F.struct(S.iou(g, p).alias("iou"), (-i).alias("i"), (-j).alias("j"), (p["span_start"] - g["span_start"]).alias("ds"), (p["span_end"] - g["span_end"]).alias("de"), S.same_label(g, p).alias("same")))))
    d = rows.select(*keys, (F.size("gold") > 0).alias("has_gold"), (F.size("pred") > 0).alias("has_pred"), F.array_max(F.filter(pairs, lambda x: x["same"])).alias("best"))
    d = d.select(*keys, "has_gold", "has_pred", F.col("best").isNotNull().alias("paired"), F.coalesce("best.iou", F.lit(0.0)).alias("iou"), F.col("best.ds").alias("start_err"), F.col("best.de").alias("end_err"))
    for t in tolerances:
        start, end = (F.coalesce(F.abs(f"{c}_err") <= t, F.lit(False)) for c in ("start", "end"))
        d = d.withColumns({f"start_{t}": start, f"end_{t}": end, f"both_{t}": start & end, f"overlap_{t}": start & end & (F.col("iou") > 0)})
    return d


def last_hit_rows(per_row: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """One row of each key (doc and segment), in the order of pos: the last with tp > 0, else the first; rows whose first key is null or empty
    are left out."""
    hit = F.col("tp") > 0
    best = F.max_by(F.struct(*per_row.columns), F.struct(hit, F.when(hit, F.col(pos)).otherwise(-F.col(pos))))
    named = per_row.where(F.coalesce(F.col(keys[0]).cast("string"), F.lit("")) != "")
    return named.groupBy(*keys).agg(best.alias("r")).select("r.*")


def emitted(rows: DataFrame) -> DataFrame:
    """Sums over rows of gold and pred arrays by their texts alone: text_equal and text_norm as multisets, text_contained by greedy one-to-one
    matching of a text that holds the other (empty ones match nothing), each with tp, fp, fn; and how many rows with gold have a
    prediction, or any exact, normalised or contained hit."""
    texts = lambda c, f: F.transform(c, lambda s: f(F.coalesce(s["text"], F.lit(""))))
    r = rows.select("gold", "pred", texts("gold", lambda t: t).alias("g"), texts("pred", lambda t: t).alias("p"))
    r = r.select("*", texts("gold", S.normal_text).alias("gn"), texts("pred", S.normal_text).alias("pn"))
    hold = lambda a, b: (a != "") & (b != "") & (a.contains(b) | b.contains(a))
    n_gold, n_pred = F.size("g"), F.size("p")
    tps = {"text_equal": S.multiset_hits(F.col("g"), F.col("p")), "text_norm": S.multiset_hits(F.col("gn"), F.col("pn")), "text_contained": S.one_to_one(F.col("gn"), F.col("pn"), hold)}
    r = r.select(n_gold.alias("n_gold"), n_pred.alias("n_pred"), *[t.cast("long").alias(k) for k, t in tps.items()], F.arrays_overlap("g", "p").alias("exact"), F.arrays_overlap("gn", "pn").alias("norm"), F.exists("gn", lambda a: F.exists("pn", lambda b: hold(a, b))).alias("contained"))
    has = F.col("n_gold") > 0
    sums = [c for k in tps for c in (F.sum(k).alias(f"{k}_tp"), F.sum(F.col("n_pred") - F.col(k)).alias(f"{k}_fp"), F.sum(F.col("n_gold") - F.col(k)).alias(f"{k}_fn"))]
    return r.agg(F.count(F.lit(1)).alias("rows_total"), F.count_if(has).alias("rows_gold"), F.count_if(has & (F.col("n_pred") > 0)).alias("rows_pred"), *sums, *[F.count_if(has & F.col(k)).alias(f"rows_{k}") for k in ("exact", "norm", "contained")])


def first_spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first gold against the first predicted span of each row: text_match, start_match, end_match, iou, start_delta, end_delta. Both
    missing: all match, IoU 1, no distance; one missing: nothing matches, IoU 0, null distances."""
    g, p = F.get("gold", F.lit(0)), F.get("pred", F.lit(0))
    none, one = g.isNull() & p.isNull(), g.isNull() | p.isNull()
    pick = lambda both, x: F.when(none, both).when(one, F.lit(False)).otherwise(x)
    same = S.stripped(F.coalesce(g["text"], F.lit(""))) == S.stripped(F.coalesce(p["text"], F.lit("")))
    gap = lambda c: F.when(none, F.lit(0).cast("long")).otherwise((p[c] - g[c]).cast("long"))
    yes = F.lit(True)
    return rows.select(*keys, pick(yes, same).alias("text_match"), pick(yes, g["span_start"] == p["span_start"]).alias("start_match"), pick(yes, g["span_end"] == p["span_end"]).alias("end_match"), F.when(none, F.lit(1.0)).when(one, F.lit(0.0)).otherwise(S.iou(g, p)).alias("iou"), gap("span_start").alias("start_delta"), gap("span_end").alias("end_delta"))
