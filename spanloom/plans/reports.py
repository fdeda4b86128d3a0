"""Queries of reports: balancing, generated spans, stored counts, positions of spans, timing."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.functions.prompts import token_stats
from spanloom.operators import sampling, text
from spanloom.operators.ranks import at_rank, between_ranks, positions, value_ranks
from spanloom.plans.more import _EXAMPLES, _IDS, ask
from spanloom.plans.registry import _WINDOWS
from spanloom.sources.shared import fresh_path

_FLAGS = {
    "w_flags": f"SELECT e.segment_id, e.side, e.slide_index, max(CASE WHEN e.tag <> 'O' AND e.tok < e.start_tok + 14 THEN 1 ELSE 0 END) = 1 OR count(a.label) > 0 AS ent, max(CASE WHEN {_IDS.replace('tag', 'e.tag')} >= 3 AND e.tok < e.start_tok + 14 THEN 1 ELSE 0 END) = 1 AS own FROM w_all e LEFT JOIN w_ann a ON a.segment_id = e.segment_id AND a.side = e.side AND a.slide_index = e.slide_index GROUP BY 1, 2, 3",
    "w_kinds": "SELECT w.segment_id, ent, own OR (ent AND w.segment_id IN (SELECT segment_id FROM anns WHERE label = 'author')) AS aut FROM w_flags w",
    "w_per": "SELECT segment_id, count(*) AS n, count(*) FILTER (ent) AS e, count(*) FILTER (NOT ent) AS o, count(*) FILTER (ent AND aut) AS d, least(count(*) FILTER (NOT ent), CAST(round_even(count(*) FILTER (ent) * 2.0, 0) AS BIGINT)) AS k FROM w_kinds GROUP BY 1",
}


@ask("SELECT CAST(sum(n) AS BIGINT) AS input_examples, CAST(sum(e + k + d) AS BIGINT) AS output_examples, CAST(sum(o - k) AS BIGINT) AS o_only_dropped, CAST(sum(d) AS BIGINT) AS author_duplicates_added, count(*) AS segments FROM w_per", **_WINDOWS, **_EXAMPLES, **_FLAGS)
def balance_report(v):
    """Training windows before and after balancing. A window has an entity if a label within its first 14 tokens or one of its annotations says so;
    entity windows of a segment with an author stand twice. A window's labels come from annotations that lie whole in it, so that these alone
    tell both."""
    at = lambda i, c: F.get("offsets", i)[c]
    holds = lambda w: F.exists("annotations", lambda a: (a["span_start"] >= at(w["start_tok"], "start")) & (a["span_end"] <= at(w["end_tok"] - 1, "end")))
    author = F.exists("annotations", lambda a: a["label"] == "author")
    w = text.with_windows(v.arrays, 16, 8, 4).select("segment_id", author.alias("author"), F.explode(F.transform("ws", holds)).alias("entity"))
    return sampling.balance_counts(w.select("segment_id", F.col("entity").alias("has_entity"), (F.col("author") & F.col("entity")).alias("has_author")))


_GEN = {
    "gen": "SELECT segment_id, w, w * 24 AS a, least(w * 24 + 32, n_tok) AS b FROM (SELECT segment_id, n_tok, unnest(range(0, CASE WHEN n_tok <= 32 THEN 1 ELSE (n_tok - 32 + 23) // 24 + 1 END)) AS w FROM n_toks)",
    "gen_edge": "SELECT g.segment_id, w, min(start) AS s, max(\"end\") AS e FROM gen g JOIN toks t ON t.segment_id = g.segment_id AND tok >= a AND tok < b GROUP BY 1, 2",
}


@ask("SELECT DISTINCT p.segment_id, span_start, span_end, text FROM preds p JOIN gen_edge g ON g.segment_id = p.segment_id AND span_start >= s AND span_end <= e", **_GEN)
def dedupe_spans(v):
    """Spans emitted window by window (32 tokens, every 24), moved to the segment's coordinates; what two windows both emit stands once."""
    n = F.size("offsets")
    most = F.when(n <= 32, F.lit(0)).otherwise(F.floor((n - 32 + 23) / 24)).cast("int")
    d = v.seg_rows.where(n > 0).select("segment_id", "offsets", "pred", F.explode(F.sequence(F.lit(0), most)).alias("w"))
    at = lambda i, c: F.get("offsets", i.cast("int"))[c].cast("long")
    d = d.select("segment_id", "pred", "w", at(F.col("w") * 24, "start").alias("s"), at(F.least(F.col("w") * 24 + 32, n) - 1, "end").alias("e"))
    said = S.rebased(F.filter("pred", lambda x: (x["span_start"] >= F.col("s")) & (x["span_end"] <= F.col("e"))), -F.col("s"))
    said = d.select("segment_id", "w", "s", said.alias("said"))  # as a model would emit them, relative to the window
    back = said.select("segment_id", "w", S.rebased(F.col("said"), F.col("s")).alias("x")).groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("w", "x"))).alias("ws"))
    spans = F.flatten(F.transform("ws", lambda w: w["x"]))
    return back.select("segment_id", F.explode(S.distinct_spans(spans)).alias("s")).select("segment_id", "s.span_start", "s.span_end", "s.text")


@ask("SELECT g.segment_id, count(*) AS num_windows, CAST(sum(b - a + 3) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(said, 0)) AS BIGINT) AS output_tokens, max(b - a + 3 + coalesce(said, 0)) AS longest, min(40 - (b - a + 3)) AS remaining, bool_or(n_tok > 32 AND x.e - x.s < length(t.text)) AS cropped FROM gen g JOIN gen_edge x USING (segment_id, w) JOIN segs t ON t.segment_id = g.segment_id JOIN n_toks n ON n.segment_id = g.segment_id LEFT JOIN (SELECT y.segment_id, y.w, count(*) AS said FROM gen_edge y JOIN preds p ON p.segment_id = y.segment_id AND p.span_start >= y.s AND p.span_end <= y.e GROUP BY 1, 2) o ON o.segment_id = g.segment_id AND o.w = g.w GROUP BY 1", **_GEN)
def context_budget(v):
    """What the windows of each segment add up to: prompts of 3 tokens of instruction and the window's, a token of output for each span in it, in a
    context of 40."""
    n = F.size("offsets")
    most = F.when(n <= 32, F.lit(0)).otherwise(F.floor((n - 32 + 23) / 24)).cast("int")
    at = lambda i, c: F.get("offsets", i.cast("int"))[c].cast("long")

    def window(w):
        first, last = w * 24, F.least(w * 24 + 32, n) - 1
        s, e = at(first, "start"), at(last, "end")
        said = F.size(F.filter("pred", lambda x: (x["span_start"] >= s) & (x["span_end"] <= e)))
        return F.struct(F.when(n <= 32, F.length("text")).otherwise(e - s).cast("long").alias("chars"), (last - first + 4).cast("long").alias("prompt"), said.cast("long").alias("output"))

    d = v.seg_rows.where(n > 0).select("segment_id", F.length("text").cast("long").alias("chars"), F.transform(F.sequence(F.lit(0), most), window).alias("ws"))
    return d.select("segment_id", token_stats(F.col("ws"), F.col("chars"), 40).alias("x")).select("segment_id", "x.*")


_MAP = {"title_tp": "SELECT segment_id, count(DISTINCT label) AS tp FROM pairs2 WHERE label = 'title' AND gs = ps AND ge = pe GROUP BY 1", "title_n": "SELECT doc_id, segment_id, sum(g) AS g, sum(p) AS p FROM (SELECT doc_id, segment_id, 1 AS g, 0 AS p FROM anns WHERE label = 'title' UNION ALL SELECT doc_id, segment_id, 0, 1 FROM (SELECT DISTINCT doc_id, segment_id, span_start, span_end FROM preds WHERE label = 'title')) GROUP BY 1, 2", "logged": "SELECT s.segment_id, s.doc_id, coalesce(n.g, 0) AS g, coalesce(n.p, 0) AS p, coalesce(t.tp, 0) AS tp FROM gp s0 JOIN segs s USING (segment_id) LEFT JOIN title_n n ON n.segment_id = s.segment_id LEFT JOIN title_tp t ON t.segment_id = s.segment_id"}


@ask("SELECT 'exact' AS family, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 7 ELSE tp END) AS BIGINT) AS tp, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE p - tp END) AS BIGINT) AS fp, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE g - tp END) AS BIGINT) AS fn FROM logged", **_MAP)
def metrics_from_map(v):
    """Counts of a prediction log: as stored with a row (here every even document's row says 7, 2, 1), computed anew where a row has none."""
    stored = F.create_map(F.lit("exact"), F.struct(F.lit(7).alias("tp"), F.lit(2).alias("fp"), F.lit(1).alias("fn")))
    path = fresh_path(v.spark, "log")
    v.rows.select("doc_id", "segment_id", "gold", "pred", F.when(F.col("doc_id") % 2 == 0, stored).alias("title_eval")).write.json(path)
    spans = "array<struct<span_start:bigint,span_end:bigint,label:string,text:string>>"
    log = v.spark.read.schema(f"doc_id long, gold {spans}, pred {spans}, title_eval map<string,struct<tp:bigint,fp:bigint,fn:bigint>>").json(path)
    mine = lambda c: F.filter(c, lambda s: s["label"] == "title")
    tp, fp, fn = (x.cast("long") for x in S.exact_hits(mine("gold"), mine("pred")))
    fresh = F.create_map(F.lit("exact"), F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")))
    each = log.select(F.explode(F.coalesce("title_eval", fresh)).alias("family", "x"))
    return each.groupBy("family").agg(*[F.sum(f"x.{c}").alias(c) for c in ("tp", "fp", "fn")])


@ask("SELECT label, count(*) AS n, round(median(length(s.text)), 6) AS input_length, round(median(a.span_start), 6) AS start, round(median(round(a.span_start / length(s.text), 9)), 6) AS relative FROM anns a JOIN segs s USING (segment_id) GROUP BY 1")
def span_position_profile(v):
    """Medians of input length, of where spans start, and of that as a share, which may differ in every row: ranked within ranges."""
    d = v.seg_rows.select(F.length("text").alias("length"), F.explode("gold").alias("s")).select("s.label", F.col("length").cast("double").alias("input_length"), F.col("s.span_start").cast("double").alias("start"), F.round(F.col("s.span_start") / F.col("length"), 9).alias("relative"))
    out = d.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    for name, width in (("input_length", None), ("start", None), ("relative", 1 / 1024)):
        r = value_ranks(d, name, "label", width=width)
        out = out.join(r.groupBy("label").agg(F.round(between_ranks(name, 0.5), 6).alias(name)), "label")
    return out


_SLICES = {"ms": "SELECT doc_id, n_chars % 97 AS ms, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents WHERE n_chars % 97 <> 0", "slices": "SELECT part, ms, row_number() OVER (PARTITION BY part ORDER BY ms) - 1 AS r, count(*) OVER (PARTITION BY part) AS n FROM (SELECT 'all' AS part, ms FROM ms UNION ALL SELECT 'first50', ms FROM ms WHERE pos < 50 UNION ALL SELECT 'rows600-650', ms FROM ms WHERE pos >= 600 AND pos < 650 UNION ALL SELECT 'last50', ms FROM ms WHERE pos >= n - 50)"}


@ask("SELECT part, count(*) AS n, round(avg(ms), 6) AS mean, round(median(ms), 6) AS median, max(CASE WHEN r = greatest(CAST(floor(0.95 * n) AS BIGINT) - 1, 0) THEN ms END) AS p95 FROM slices GROUP BY 1", **_SLICES)
def timing_slices(v):
    """Times by place among the rows that have one (0 counts as none): all, the first 50, 600 to 649, the last 50."""
    t = v.docs.select("doc_id", (F.col("n_chars") % 97).alias("ms")).where("ms <> 0")
    d = positions(t, "doc_id").crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("rows"))))  # one row
    parts = (("all", F.lit(True)), ("first50", F.col("pos") < 50), ("rows600-650", (F.col("pos") >= 600) & (F.col("pos") < 650)), ("last50", F.col("pos") >= F.col("rows") - 50))
    each = d.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in parts]))).alias("part"), F.col("ms").cast("double").alias("ms"))
    r = value_ranks(each, "ms", "part")
    p95 = at_rank("ms", F.greatest(F.floor(F.lit(0.95) * F.col("n")) - 1, F.lit(0)))
    return r.groupBy("part").agg(F.max("n").alias("n"), F.round(F.sum(F.col("ms") * F.col("c")) / F.max("n"), 6).alias("mean"), F.round(between_ranks("ms", 0.5), 6).alias("median"), p95.alias("p95"))
