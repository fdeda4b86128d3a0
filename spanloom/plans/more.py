"""Further registered queries: training examples, merged predictions, crops, views of matching, reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions import spans as S
from spanloom.operators import evaluate, labels, text
from spanloom.operators.ranks import at_rank, positions, value_ranks
from spanloom.plans.registry import _PRF, _TAGS, _WINDOWS, query


def longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f.name) for f in df.schema.fields])


def ask(body: str, name: str | None = None, **more: str):
    def add(f):
        query(body, name or f.__name__, **more)(lambda v: longs(f(v)))
        return f

    return add


# --- scans and lookups ---


@ask("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 1 OFFSET 5")
def row_at(v):
    return v.docs.select("doc_id", "n_chars").orderBy("doc_id").offset(5).limit(1)


_KEYS = {"keys": "SELECT doc_id, segment_index, segment_id, row_number() OVER (PARTITION BY doc_id ORDER BY segment_index DESC) AS pos FROM (SELECT DISTINCT doc_id, segment_index, segment_id FROM preds)"}


@ask("SELECT k.doc_id, pos, segment_id, span_start FROM keys k JOIN segs USING (segment_id)", **_KEYS)
def ordered_key_lookup(v):
    """Segments in the order of a list of keys; a key without a segment raises."""
    keys = v.preds.select("doc_id", "segment_index", "segment_id").distinct()
    keys = keys.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("segment_index"))))
    found = keys.join(v.segs.select("segment_id", "span_start"), "segment_id", "left")
    sure = F.when(F.col("span_start").isNull(), F.raise_error(F.concat(F.lit("no segment "), "segment_id")).cast("long")).otherwise(F.col("span_start"))
    return found.select("doc_id", "pos", "segment_id", sure.alias("span_start"))


@ask("SELECT shard, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT doc_id % 2 AS shard, text FROM segs) GROUP BY 1")
def union_shards(v):
    even, odd = (v.segs.where(F.col("doc_id") % 2 == k).select(F.lit(k).cast("long").alias("shard"), "text") for k in (0, 1))
    return even.unionByName(odd).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@ask("SELECT s.segment_id, 'TEXT' AS segment_label, length(text) AS char_length, coalesce(n_tok, 0) AS token_length, CASE WHEN coalesce(n_tok, 0) <= 16 THEN 'short' WHEN n_tok <= 64 THEN 'medium' ELSE 'long' END AS tier, coalesce(t, false) AS has_title, coalesce(a, false) AS has_author FROM segs s LEFT JOIN n_toks USING (segment_id) LEFT JOIN (SELECT segment_id, bool_or(label = 'title') AS t, bool_or(label = 'author') AS a FROM anns GROUP BY 1) x USING (segment_id)")
def segment_records(v):
    has = v.anns.groupBy("segment_id").agg(F.bool_or(F.col("label") == "title").alias("t"), F.bool_or(F.col("label") == "author").alias("a"))
    n, no = F.coalesce("n_tok", F.lit(0)), F.lit(False)
    d = v.segs.join(v.n_toks, "segment_id", "left").join(has, "segment_id", "left")
    return d.select("segment_id", F.lit("TEXT").alias("segment_label"), F.length("text").alias("char_length"), n.alias("token_length"), S.tier(n, 16, 64).alias("tier"), F.coalesce("t", no).alias("has_title"), F.coalesce("a", no).alias("has_author"))


@ask("SELECT (SELECT count(*) FROM documents) AS documents, count(*) FILTER (label = 'title') AS titles, count(*) FILTER (label = 'author') AS authors, (SELECT count(*) FROM documents) - count(DISTINCT CASE WHEN label = 'title' THEN doc_id END) AS without_title, (SELECT count(*) FROM documents) - count(DISTINCT CASE WHEN label = 'author' THEN doc_id END) AS without_author FROM anns")
def extract_stats(v):
    per = v.anns.groupBy("doc_id").agg(F.count_if(F.col("label") == "title").alias("t"), F.count_if(F.col("label") == "author").alias("a"))
    d = v.docs.select("doc_id").join(per, "doc_id", "left").fillna(0)
    return d.agg(F.count(F.lit(1)).alias("documents"), F.sum("t").alias("titles"), F.sum("a").alias("authors"), F.count_if(F.col("t") == 0).alias("without_title"), F.count_if(F.col("a") == 0).alias("without_author"))


# --- text and windows ---


_BOUNDS = {"bounds_tok": "SELECT a.segment_id, a.label, min(tok) AS lo, max(tok) AS hi FROM anns a JOIN toks t ON t.segment_id = a.segment_id AND start < span_end AND \"end\" > span_start GROUP BY ALL", "spans_n": "SELECT * FROM bounds_tok JOIN n_toks USING (segment_id)"}


def bounds(v) -> DataFrame:
    """(segment_id, label, lo, hi, n_tok): first and last token of each annotation."""
    d = v.arrays.select("segment_id", "n_tok", F.explode(labels.token_ranges(F.col("offsets"), F.col("annotations"))).alias("r"))
    return d.select("segment_id", F.lower("r.entity").alias("label"), F.col("r.lo").alias("lo"), (F.col("r.hi") - 1).alias("hi"), "n_tok")


@ask("SELECT segment_id, label, lo, hi FROM bounds_tok", **_BOUNDS)
def span_token_bounds(v):
    return bounds(v).select("segment_id", "label", "lo", "hi")


@ask("SELECT count(*) AS segments, round(median(n_tok), 6) AS median, max(CASE WHEN r = least(n - 1, CAST(floor(n * 0.9) AS BIGINT)) THEN n_tok END) AS p90, count(*) FILTER (n_tok > 16) AS over FROM (SELECT n_tok, row_number() OVER (ORDER BY n_tok) - 1 AS r, count(*) OVER () AS n FROM n_toks)")
def token_length_profile(v):
    d = value_ranks(v.n_toks.withColumn("g", F.lit(0)), "n_tok", "g")
    q = lambda i: at_rank("n_tok", i)
    mid = (q(F.floor((F.col("n") - 1) / 2)) + q(F.floor(F.col("n") / 2))) / 2
    return d.groupBy("g").agg(F.sum("c").alias("segments"), F.round(mid, 6).alias("median"), q(F.least(F.col("n") - 1, F.floor(F.col("n") * 0.9))).alias("p90"), F.sum(F.when(F.col("n_tok") > 16, F.col("c")).otherwise(0)).alias("over")).drop("g")


# --- labels and examples ---

_IDS = "CASE tag WHEN 'B-TITLE' THEN 1 WHEN 'I-TITLE' THEN 2 WHEN 'B-AUTHOR' THEN 3 WHEN 'I-AUTHOR' THEN 4 ELSE 0 END"
_WTAGS = {
    "w_edge": "SELECT w.segment_id, w.side, w.slide_index, w.n_tok, w.start_tok, w.end_tok, min(start) AS s, max(\"end\") AS e FROM windows w JOIN toks t ON t.segment_id = w.segment_id AND tok >= start_tok AND tok < end_tok GROUP BY ALL",
    "w_ann": "SELECT w.*, a.label, a.span_start, a.span_end FROM w_edge w JOIN anns a ON a.segment_id = w.segment_id AND a.span_start >= w.s AND a.span_end <= w.e",
    "w_over": "SELECT w.segment_id, side, slide_index, tok, start, \"end\", label, span_start, span_end, row_number() OVER (PARTITION BY w.segment_id, side, slide_index, tok ORDER BY span_start, span_start - span_end, label) AS o, tok = min(tok) OVER (PARTITION BY w.segment_id, side, slide_index, label, span_start, span_end) AS first FROM w_ann w JOIN toks t ON t.segment_id = w.segment_id AND tok >= start_tok AND tok < end_tok AND start < span_end AND \"end\" > span_start",
    "w_tag": "SELECT segment_id, side, slide_index, tok, arg_max((CASE WHEN first THEN 'B-' ELSE 'I-' END) || upper(label), o) AS tag FROM (SELECT *, first_value(label) OVER (PARTITION BY segment_id, side, slide_index, tok ORDER BY o) AS lead FROM w_over) WHERE label = lead GROUP BY ALL",
    "w_all": "SELECT w.segment_id, w.side, w.slide_index, w.n_tok, w.start_tok, t.tok, t.start, t.\"end\", length(t.piece) + 2 AS id, coalesce(x.tag, 'O') AS tag FROM w_edge w JOIN toks t ON t.segment_id = w.segment_id AND t.tok >= w.start_tok AND t.tok < w.end_tok LEFT JOIN w_tag x ON x.segment_id = w.segment_id AND x.side = w.side AND x.slide_index = w.slide_index AND x.tok = t.tok",
}
_EXAMPLES = _WTAGS | {
    "content": f"SELECT segment_id, side, slide_index, n_tok, count(*) AS n, CAST(sum(id * (tok - start_tok + 2)) AS BIGINT) AS id_sum, CAST(sum({_IDS}) AS BIGINT) AS label_sum, CAST(sum(CASE WHEN tag = 'O' THEN 0 ELSE 1 END) AS BIGINT) AS entity FROM w_all WHERE tok < start_tok + 14 GROUP BY ALL",
    "examples": "SELECT segment_id, side, CAST(slide_index AS BIGINT) AS slide_index, n_tok, n + 2 AS mask_sum, CAST(16 AS BIGINT) AS length, 16 - n AS ignored, id_sum + 0 * 1 + 2 * (n + 2) + (16 - n - 2) AS id_sum, label_sum, entity FROM content",
}


def window_rows(v) -> DataFrame:
    """One row a window of 16 tokens, every 8, up to 4 from either end, with its own annotations, offsets and tags."""
    return labels.window_labels(text.with_windows(v.arrays, 16, 8, 4))


def examples(v) -> DataFrame:
    """Fixed-length examples of windows: (segment_id, side, slide_index, n_tok, input_ids, attention_mask, labels), 16 places each.

    Content is clipped to 14 tokens; a begin and an end sign (ids 0 and 2) go around it; padding has id 1 and mask 0; labels are -100 on
    signs and padding. A token's stand-in id is its length + 2."""
    label = F.create_map(*[x for i, t in enumerate(("O", "B-TITLE", "I-TITLE", "B-AUTHOR", "I-AUTHOR")) for x in (F.lit(t), F.lit(i))])
    w = window_rows(v)
    part = F.slice(F.transform("window_offsets", lambda t, i: F.struct((t["end"] - t["start"] + 2).cast("int").alias("id"), F.coalesce(label[F.get("tags", i)], F.lit(0)).alias("label"))), 1, 14)
    w = w.withColumn("p", part).withColumn("pad", F.lit(14) - F.size("p"))
    fill = lambda x: F.array_repeat(F.lit(x), F.col("pad"))
    ids = F.concat(F.array(F.lit(0)), F.transform("p", lambda x: x["id"]), F.array(F.lit(2)), fill(1))
    mask = F.concat(F.array_repeat(F.lit(1), F.size("p") + 2), fill(0))
    labels = F.concat(F.array(F.lit(-100)), F.transform("p", lambda x: x["label"]), F.array(F.lit(-100)), fill(-100))
    return w.select("segment_id", "side", "slide_index", "n_tok", ids.alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels"))


@ask("SELECT segment_id, side, slide_index, mask_sum, length, ignored, id_sum, label_sum FROM examples", **_WINDOWS, **_EXAMPLES)
def training_examples(v):
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    placed = total(F.transform("input_ids", lambda x, i: x * F.when(F.get("labels", i) >= 0, i + 1).when(F.get("attention_mask", i) == 1, F.size(F.filter("labels", lambda y: y >= 0)) + 2).otherwise(1)))
    kept = F.filter("labels", lambda x: x >= 0)
    return examples(v).select("segment_id", "side", "slide_index", total(F.col("attention_mask")).alias("mask_sum"), F.size("input_ids").alias("length"), (F.lit(16) - F.size(kept)).alias("ignored"), placed.alias("id_sum"), total(kept).alias("label_sum"))


@ask("SELECT segment_id, count(*) AS windows, bool_and(length = 16) AS lengths_ok, bool_and(ignored >= 2) AS signs_ok, CASE WHEN n_tok <= 16 THEN count(*) = 1 ELSE count(*) <= 8 END AS count_ok FROM examples GROUP BY segment_id, n_tok", **_WINDOWS, **_EXAMPLES)
def verify_windows(v):
    e = examples(v)
    ends = (F.get("labels", F.lit(0)) == -100) & (F.get("labels", F.expr("aggregate(attention_mask, 0, (s, x) -> s + x) - 1")) == -100)
    per = e.groupBy("segment_id", "n_tok").agg(F.count(F.lit(1)).alias("windows"), F.bool_and((F.size("input_ids") == 16) & (F.size("labels") == 16)).alias("lengths_ok"), F.bool_and(ends).alias("signs_ok"))
    return per.select("segment_id", "windows", "lengths_ok", "signs_ok", F.when(F.col("n_tok") <= 16, F.col("windows") == 1).otherwise(F.col("windows") <= 8).alias("count_ok"))


# --- merging predictions ---

def merge_votes(votes: DataFrame) -> DataFrame:
    """votes: segment_id, start, end, tag, conf, place (the window's order) -> spans. At each start the most confident tag
    wins, the earliest window on ties; then tags chain in the order of starts, whatever lies between; a span ends with its last token."""
    best = votes.groupBy("segment_id", "start").agg(F.max("end").alias("end"), F.max_by("tag", F.struct("conf", -F.col("place"))).alias("tag"))
    return text.bio_spans(best.withColumnRenamed("start", "tok").withColumn("start", F.col("tok")))


def escaped(s):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def _esc(s: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        s = f"replace({s}, '{a}', '{b}')"
    return s


_MARK = {"one": "SELECT a.segment_id, span_start AS s, span_end AS e, label, row_number() OVER (PARTITION BY a.segment_id ORDER BY span_start, span_end, label) AS r, max(span_end) OVER (PARTITION BY a.segment_id ORDER BY span_start, span_end, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM anns a", "kept": "SELECT *, lag(e) OVER (PARTITION BY segment_id ORDER BY r) AS cursor, lead(s) OVER (PARTITION BY segment_id ORDER BY r) AS nxt FROM one WHERE coalesce(upto, 0) <= s"}


@ask(f"SELECT k.segment_id, string_agg({_esc('substring(t.text, coalesce(cursor, 0) + 1, s - coalesce(cursor, 0))')} || '<mark class=\"' || label || '\">' || {_esc('substring(t.text, s + 1, e - s)')} || '</mark>' || CASE WHEN nxt IS NULL THEN {_esc('substring(t.text, e + 1)')} ELSE '' END, '' ORDER BY r) AS html FROM kept k JOIN segs t ON t.segment_id = k.segment_id GROUP BY 1", **_MARK)
def highlight_html(v):
    """Segments with their annotations marked in order of start; one that begins within another is left out."""
    spans = v.anns.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", "label"))).alias("a"))
    d = v.segs.select("segment_id", "text").join(spans, "segment_id")
    cut = lambda a, b: escaped(F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    fold = F.aggregate("a", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), lambda s, x: F.when(x["span_start"] < s["at"], s).otherwise(F.struct(x["span_end"].alias("at"), F.concat(s["out"], cut(s["at"], x["span_start"]), F.lit('<mark class="'), x["label"], F.lit('">'), cut(x["span_start"], x["span_end"]), F.lit("</mark>")).alias("out"))), lambda s: F.concat(s["out"], cut(s["at"], F.length("text").cast("long"))))
    return d.select("segment_id", fold.alias("html"))


# --- matching ---

_TOL = {f"{k}{t}": c.replace("@", str(t)) for t in (10, 50) for k, c in {"start": "abs(gs - ps) <= @", "end": "abs(ge - pe) <= @", "both": "abs(gs - ps) <= @ AND abs(ge - pe) <= @", "relaxed": "abs(gs - ps) <= @ AND abs(ge - pe) <= @ AND inter > 0"}.items()}
_FAMILIES = {"exact": "gs = ps AND ge = pe", "iou50": "iou >= 0.5", "iou80": "iou >= 0.8", "text": "same", **_TOL}
_VIEWS = {
    "by_label": "SELECT label, CAST(sum(g) AS BIGINT) AS g, CAST(sum(p) AS BIGINT) AS p FROM (SELECT label, count(*) AS g, 0 AS p FROM anns GROUP BY 1 UNION ALL SELECT label, 0, count(*) FROM preds GROUP BY 1) GROUP BY 1",
    "label_hits": " UNION ALL ".join(f"SELECT '{k}' AS family, label, count(DISTINCT segment_id) AS tp FROM pairs2 WHERE {c} GROUP BY 2" for k, c in _FAMILIES.items()),
    "label_counts": "SELECT f.family, b.label, coalesce(tp, 0) AS tp, p - coalesce(tp, 0) AS fp, g - coalesce(tp, 0) AS fn FROM by_label b CROSS JOIN (SELECT unnest([" + ", ".join(f"'{k}'" for k in _FAMILIES) + "]) AS family) f LEFT JOIN label_hits h ON h.family = f.family AND h.label = b.label",
}


def label_counts(v) -> DataFrame:
    """(family, label, tp, fp, fn) by greedy matching (exact on sets) within each label, all families in one pass over the rows."""
    rows = v.rows.withColumn("label", F.explode(F.array(F.lit("title"), F.lit("author"))))
    mine = lambda c: F.filter(c, lambda s: s["label"] == F.col("label"))
    rows = rows.withColumn("g", mine("gold")).withColumn("p", mine("pred")).where((F.size("g") > 0) | (F.size("p") > 0))
    tp = {"exact": S.exact_hits(F.col("g"), F.col("p"))[0]}
    tp |= {n: S.greedy(F.col("g"), F.col("p"), m) for n, m in S.match_families((10, 50)).items()}
    each = rows.select("label", F.size("g").alias("n_gold"), F.size("p").alias("n_pred"), F.explode(F.array(*[F.struct(F.lit(n).alias("family"), t.alias("tp")) for n, t in tp.items()])).alias("x"))
    return each.groupBy("x.family", "label").agg(F.sum("x.tp").alias("tp"), F.sum(F.col("n_pred") - F.col("x.tp")).alias("fp"), F.sum(F.col("n_gold") - F.col("x.tp")).alias("fn"))


@ask("SELECT family, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM label_counts GROUP BY 1", **_VIEWS)
def span_eval_counts(v):
    return label_counts(v).groupBy("family").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


@ask(f"SELECT *, {_PRF} FROM (SELECT family, coalesce(label, 'overall') AS view, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM label_counts GROUP BY GROUPING SETS ((family), (family, label)))", **_VIEWS)
def segment_eval_views(v):
    """Overall and by label, each family."""
    sums = label_counts(v).groupingSets([["family"], ["family", "label"]], "family", "label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return evaluate.with_prf(sums.select("family", F.coalesce("label", F.lit("overall")).alias("view"), "tp", "fp", "fn"))


# --- generative windows ---


@ask("SELECT segment_id, w, w * 24 AS start_tok, least(w * 24 + 32, n_tok) AS end_tok FROM (SELECT segment_id, n_tok, unnest(range(0, CASE WHEN n_tok <= 32 THEN 1 ELSE (n_tok - 32 + 23) // 24 + 1 END)) AS w FROM n_toks)")
def gen_windows(v):
    """Windows of 32 tokens, every 24, until one reaches the end."""
    n = F.col("n_tok")
    most = F.when(n <= 32, F.lit(0)).otherwise(F.floor((n - 32 + 23) / 24)).cast("int")
    return v.n_toks.select("segment_id", "n_tok", F.explode(F.sequence(F.lit(0), most)).alias("w")).select("segment_id", "w", (F.col("w") * 24).alias("start_tok"), F.least(F.col("w") * 24 + 32, F.col("n_tok")).alias("end_tok"))


# --- generative rows and reports ---


@ask("SELECT segment_id, span_start AS start, span_end AS \"end\" FROM anns WHERE doc_id % 4 <> 0")
def gold_from_output(v):
    """Spans of a JSON answer; entries without both ends are left out."""
    s = F.struct("label", F.col("span_start").cast("string").alias("start"), F.when(F.col("doc_id") % 4 != 0, F.col("span_end")).alias("end"))
    said = v.anns.groupBy("segment_id").agg(F.to_json(F.struct(F.collect_list(s).alias("spans"))).alias("raw"))
    parsed = F.from_json("raw", "struct<spans:array<struct<start:string,end:string>>>")["spans"]
    ends = said.select("segment_id", F.explode(parsed).alias("s")).where("s.start is not null and s.end is not null")
    return ends.select("segment_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


_MS = {"ms": "SELECT doc_id, 10 + n_chars % 97 AS ms, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents", "ranked_ms": "SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS r, count(*) OVER () AS n FROM ms"}


def times(v) -> DataFrame:
    return v.docs.select("doc_id", (F.lit(10) + F.col("n_chars") % 97).alias("ms"), F.lit(0).alias("g"))


@ask("SELECT count(*) AS n, round(sum(ms) / 1000.0, 2) AS total_s, round(avg(ms), 2) AS mean_ms, round(median(ms), 2) AS median_ms FROM ms", **_MS)
def timing_summary(v):
    return times(v).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ms") / 1000.0, 2).alias("total_s"), F.round(F.avg("ms"), 2).alias("mean_ms"), F.round(F.percentile("ms", 0.5), 2).alias("median_ms"))


@ask("SELECT max(CASE WHEN r = round_even(0.5 * (n - 1), 0) THEN ms END) AS p50, max(CASE WHEN r = round_even(0.95 * (n - 1), 0) THEN ms END) AS p95 FROM ranked_ms", **_MS)
def timing_percentiles(v):
    """The nearest rank, half to even."""
    q = lambda p: at_rank("ms", F.bround(F.lit(p) * (F.col("n") - 1)))
    return value_ranks(times(v), "ms", "g").groupBy("g").agg(q(0.5).alias("p50"), q(0.95).alias("p95")).drop("g")


