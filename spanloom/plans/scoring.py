"""Queries that score rows with several spans of a label: pages of 16 lines, some of whose spans stand twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.operators import evaluate as E
from spanloom.operators.ranks import between_ranks, value_ranks
from spanloom.plans.more import ask
from spanloom.plans.registry import _PRF

SPANS = "array<struct<span_start:bigint,span_end:bigint,label:string,text:string>>"
TOLERANCES = (10, 50)

_SIDE = "SELECT s.doc_id, s.segment_index // 16 AS page, s.span_start + a.span_start AS s, s.span_start + a.span_end AS e, label AS l, a.text AS t FROM {0} a JOIN segs s USING (segment_id)"
_PAGES = {
    "g_all": f"{_SIDE.format('anns')} UNION ALL {_SIDE.format('anns')} WHERE s.doc_id % 3 = 0",
    "p_all": f"{_SIDE.format('preds')} UNION ALL {_SIDE.format('preds')} WHERE s.doc_id % 5 = 0",
    "pages": "SELECT d.doc_id, d.page, d.doc_id || '/' || d.page AS page_id, coalesce(g, []) AS gold, coalesce(p, []) AS pred FROM (SELECT DISTINCT doc_id, segment_index // 16 AS page FROM segs) d LEFT JOIN (SELECT doc_id, page, list({'s': s, 'e': e, 'l': l, 't': t} ORDER BY s, e, l, t) AS g FROM g_all GROUP BY 1, 2) USING (doc_id, page) LEFT JOIN (SELECT doc_id, page, list({'s': s, 'e': e, 'l': l, 't': t} ORDER BY s, e, l, t) AS p FROM p_all GROUP BY 1, 2) USING (doc_id, page)",
}
_INTER = "greatest(0, least(gold[i].e, pred[j].e) - greatest(gold[i].s, pred[j].s))"
_IOU = f"CASE WHEN {_INTER} > 0 THEN {_INTER} / (gold[i].e - gold[i].s + pred[j].e - pred[j].s - {_INTER}) ELSE 0.0 END"


def _bare(t: str) -> str:
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


_CONDS = {"iou50": f"{_IOU} >= 0.5", "iou80": f"{_IOU} >= 0.8", "text": f"{_bare('gold[i].t')} = {_bare('pred[j].t')}"}
for _t in TOLERANCES:
    _near = {"start": f"abs(gold[i].s - pred[j].s) <= {_t}", "end": f"abs(gold[i].e - pred[j].e) <= {_t}"}
    _CONDS |= {f"start{_t}": _near["start"], f"end{_t}": _near["end"], f"both{_t}": " AND ".join(_near.values()), f"relaxed{_t}": " AND ".join(_near.values()) + f" AND {_INTER} > 0"}


def _greedy(name: str, cond: str, rows: str = "pages", key: str = "page_id") -> dict[str, str]:
    """A walk over each row's gold spans with the list of predictions used so far; one row a row with tp at its end."""
    walk = f"SELECT {key}, CAST(1 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used FROM {rows} UNION ALL SELECT {key}, i + 1, CASE WHEN len(x) > 0 THEN list_append(used, x[1]) ELSE used END FROM (SELECT {key}, i, used, list_filter(range(1, len(pred) + 1), lambda j: NOT list_contains(used, j) AND {cond}) AS x FROM walk_{name} JOIN {rows} USING ({key}) WHERE i <= len(gold))"
    return {f"walk_{name}": walk, f"tp_{name}": f"SELECT {key}, max(len(used)) AS tp FROM walk_{name} GROUP BY 1"}


_EXACT = "SELECT page_id, len(list_intersect(g, p)) AS tp, len(p) AS p, len(g) AS g FROM (SELECT page_id, list_distinct(list_transform(gold, lambda x: x.l || ':' || x.s || ':' || x.e)) AS g, list_distinct(list_transform(pred, lambda x: x.l || ':' || x.s || ':' || x.e)) AS p FROM pages)"
_WALKS = {k: v for name, cond in _CONDS.items() for k, v in _greedy(name, f"gold[i].l = pred[j].l AND {cond}").items()}


def _sums(family: str) -> str:
    return f"SELECT '{family}' AS family, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(len(pred) - tp) AS BIGINT) AS fp, CAST(sum(len(gold) - tp) AS BIGINT) AS fn FROM pages JOIN tp_{family} USING (page_id)"


def page_rows(v) -> DataFrame:
    """(doc_id, page, page_id, gold, pred): spans in document coordinates, in order of start, end, label, text."""

    def side(spans: DataFrame, each: int, name: str) -> DataFrame:
        base = v.segs.select("segment_id", F.col("span_start").alias("base"))
        d = spans.join(base, "segment_id").select("doc_id", F.floor(F.col("segment_index") / 16).alias("page"), F.struct((F.col("span_start") + F.col("base")).alias("span_start"), (F.col("span_end") + F.col("base")).alias("span_end"), "label", "text").alias("x"))
        twice = F.array_repeat("x", F.when(F.col("doc_id") % each == 0, 2).otherwise(1))
        return d.select("doc_id", "page", F.explode(twice).alias("x")).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("x")).alias(name))

    pages = v.segs.select("doc_id", F.floor(F.col("segment_index") / 16).alias("page")).distinct()
    d = pages.join(side(v.anns, 3, "gold"), ["doc_id", "page"], "left").join(side(v.preds, 5, "pred"), ["doc_id", "page"], "left")
    full = lambda c: F.coalesce(c, F.array().cast(SPANS)).alias(c)
    return d.select("doc_id", "page", F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page").cast("string")).alias("page_id"), full("gold"), full("pred"))


def hits(families: tuple[int, ...] = TOLERANCES) -> dict[str, Column]:
    return {n: S.greedy(F.col("gold"), F.col("pred"), m) for n, m in S.match_families(families).items()}


@ask(f"SELECT *, {_PRF} FROM (SELECT 'exact' AS family, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(p - tp) AS BIGINT) AS fp, CAST(sum(g - tp) AS BIGINT) AS fn FROM exact_pages UNION ALL {' UNION ALL '.join(map(_sums, _CONDS))})", **_PAGES, exact_pages=_EXACT, **_WALKS)
def page_metrics(v):
    """All match families where rows hold several spans of a label and repeats: exact on sets, the others one to one in order."""
    tp, fp, fn = S.exact_hits(F.col("gold"), F.col("pred"))
    rest = lambda t, c: (F.size(c) - t).alias("x")
    each = [F.struct(F.lit("exact").alias("family"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))]
    each += [F.struct(F.lit(n).alias("family"), t.alias("tp"), rest(t, "pred").alias("fp"), rest(t, "gold").alias("fn")) for n, t in hits().items()]
    d = page_rows(v).select(F.explode(F.array(*each)).alias("x")).select("x.*")
    return E.with_prf(d.groupBy("family").agg(*E.totals()))


_DIAG = {
    "page_pairs": f"SELECT page_id, i, j, {_IOU} AS iou, pred[j].s - gold[i].s AS ds, pred[j].e - gold[i].e AS de FROM pages, unnest(range(1, len(gold) + 1)) a(i), unnest(range(1, len(pred) + 1)) b(j) WHERE gold[i].l = pred[j].l",
    "page_best": "SELECT page_id, iou, ds, de FROM page_pairs QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY iou DESC, i, j) = 1",
    "page_diag": "SELECT page_id, len(gold) > 0 AS has_gold, len(pred) > 0 AS has_pred, ds IS NOT NULL AS paired, coalesce(iou, 0.0) AS iou, ds AS start_err, de AS end_err, " + ", ".join(f"coalesce(abs(ds) <= {t}, false) AS start_{t}, coalesce(abs(de) <= {t}, false) AS end_{t}, coalesce(abs(ds) <= {t} AND abs(de) <= {t}, false) AS both_{t}, coalesce(abs(ds) <= {t} AND abs(de) <= {t} AND iou > 0, false) AS overlap_{t}" for t in TOLERANCES) + " FROM pages LEFT JOIN page_best USING (page_id)",
}


@ask("SELECT * REPLACE (round(iou, 6) AS iou) FROM page_diag", **_PAGES, **_DIAG)
def row_offset_diag(v):
    """Errors of each row's best pair and whether they lie within 10 and 50."""
    return E.offset_rows(page_rows(v), ["page_id"], TOLERANCES).withColumn("iou", F.round("iou", 6))


_FLAGS = [f"{k}_{t}" for t in TOLERANCES for k in ("start", "end", "both", "overlap")]
_MICRO = {k: v for k, v in _CONDS.items() if k.rstrip("0123456789") in ("start", "end", "both", "relaxed")}
_STAT = ", ".join(f"round(avg({x}) FILTER (paired), 6) AS {n}_mean, round(quantile_cont({x}, 0.5) FILTER (paired), 6) AS {n}_median, round(quantile_cont({x}, 0.9) FILTER (paired), 6) AS {n}_p90" for n, x in {"iou": "iou", "start": "abs(start_err)", "end": "abs(end_err)"}.items())


@ask(f"SELECT * FROM (SELECT count(*) AS rows_total, count(*) FILTER (has_gold) AS rows_gold, count(*) FILTER (has_pred) AS rows_pred, count(*) FILTER (paired) AS rows_paired, {_STAT}, {', '.join(f'round(count(*) FILTER ({f}) / count(*) FILTER (paired), 6) AS hit_{f}' for f in _FLAGS)} FROM page_diag), {', '.join(f'(SELECT round(2 * sum(tp) / (sum(len(pred)) + sum(len(gold))), 6) AS f1_{k} FROM pages JOIN tp_{k} USING (page_id)) f_{k}' for k in _MICRO)}", **_PAGES, **_DIAG, **_WALKS)
def offset_diagnostics(v):
    """Rows with gold, predictions and pairs; mean, median and 90th percentile of IoU and of absolute errors, and hit rates, over paired
    rows; micro F1 of the offset families over all rows."""
    rows = page_rows(v)
    d = E.offset_rows(rows, ["page_id"], TOLERANCES)
    one = F.lit(0).alias("one")
    sums = d.agg(F.count(F.lit(1)).alias("rows_total"), *[F.count_if(c).alias(n) for n, c in (("rows_gold", "has_gold"), ("rows_pred", "has_pred"), ("rows_paired", "paired"))], *[F.count_if(f).alias(f"n_{f}") for f in _FLAGS]).withColumn("one", F.lit(0))
    paired = d.where("paired").select(one, "iou", F.abs("start_err").cast("double").alias("start"), F.abs("end_err").cast("double").alias("end"))
    out = sums
    for name, width in (("iou", 1 / 1024), ("start", None), ("end", None)):
        r = value_ranks(paired, name, "one", width=width)
        mean = F.sum(F.col(name) * F.col("c")) / F.sum("c")
        q = r.groupBy("one").agg(F.round(mean, 6).alias(f"{name}_mean"), F.round(between_ranks(name, 0.5), 6).alias(f"{name}_median"), F.round(between_ranks(name, 0.9), 6).alias(f"{name}_p90"))
        out = out.join(q, "one", "left")
    tps = rows.agg(F.sum(F.size("gold") + F.size("pred")).alias("spans"), *[F.sum(t).alias(f"tp_{n}") for n, t in hits().items() if n in _MICRO]).withColumn("one", F.lit(0))
    rates = [F.round(F.col(f"n_{f}") / F.nullif(F.col("rows_paired"), F.lit(0)), 6).alias(f"hit_{f}") for f in _FLAGS]
    f1 = [F.round(2 * F.col(f"tp_{n}") / F.col("spans"), 6).alias(f"f1_{n}") for n in _MICRO]
    stats = [f"{n}_{x}" for n in ("iou", "start", "end") for x in ("mean", "median", "p90")]
    return out.join(tps, "one").select("rows_total", "rows_gold", "rows_pred", "rows_paired", *stats, *rates, *f1)


_HALVES = {
    "halves": "SELECT doc_id, page, l AS label, CASE l WHEN 'title' THEN 0 ELSE 1 END AS pos, list_filter(gold, lambda x: x.l = l) AS gold, list_filter(pred, lambda x: x.l = l) AS pred FROM pages, (VALUES ('title'), ('author')) t(l)",
    "half_sets": "SELECT doc_id, page, pos, list_distinct(list_transform(gold, lambda x: x.s || ':' || x.e)) AS g, list_distinct(list_transform(pred, lambda x: x.s || ':' || x.e)) AS p FROM halves",
    "half_hits": "SELECT *, len(list_intersect(g, p)) AS tp FROM half_sets",
}


@ask(f"SELECT *, {_PRF} FROM (SELECT count(*) AS segments, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(len(p) - tp) AS BIGINT) AS fp, CAST(sum(len(g) - tp) AS BIGINT) AS fn FROM (SELECT * FROM half_hits QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY tp > 0 DESC, CASE WHEN tp > 0 THEN -pos ELSE pos END) = 1))", **_PAGES, **_HALVES)
def segment_dedup_metrics(v):
    """Of the rows of one document and page (one a label) the last with an exact hit, else the first."""
    each = page_rows(v).withColumn("x", F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.lit(k).alias("pos")) for k, label in enumerate(("title", "author"))])))
    mine = lambda c: F.filter(c, lambda s: s["label"] == F.col("x.label"))
    tp, fp, fn = S.exact_hits(mine("gold"), mine("pred"))
    rows = each.select("doc_id", "page", F.col("x.pos").alias("pos"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return E.with_prf(E.last_hit_rows(rows, ["doc_id", "page"], "pos").agg(F.count(F.lit(1)).alias("segments"), *E.totals()))


def _norm(t: str) -> str:
    return f"regexp_replace({_bare(t)}, '[\\s་།]+$', '')"


_EMIT = {
    "said": f"SELECT page_id, list_transform(gold, lambda x: x.t) AS g, list_transform(pred, lambda x: x.t) AS p, list_transform(gold, lambda x: {_norm('x.t')}) AS gn, list_transform(pred, lambda x: {_norm('x.t')}) AS pn FROM pages",
    "said_norm": "SELECT page_id, gn AS gold, pn AS pred FROM said",
    **{f"many_{k}": f"SELECT page_id, CAST(sum(least(a, b)) AS BIGINT) AS tp FROM (SELECT page_id, t, count(*) FILTER (who = 'g') AS a, count(*) FILTER (who = 'p') AS b FROM (SELECT page_id, unnest({g}) AS t, 'g' AS who FROM said UNION ALL SELECT page_id, unnest({p}), 'p' FROM said) GROUP BY 1, 2) GROUP BY 1" for k, (g, p) in {"equal": ("g", "p"), "norm": ("gn", "pn")}.items()},
    **_greedy("held", "gold[i] <> '' AND pred[j] <> '' AND (contains(gold[i], pred[j]) OR contains(pred[j], gold[i]))", "said_norm"),
    "said_tp": "SELECT s.*, coalesce(a.tp, 0) AS e, coalesce(b.tp, 0) AS n, coalesce(c.tp, 0) AS h FROM said s LEFT JOIN many_equal a USING (page_id) LEFT JOIN many_norm b USING (page_id) LEFT JOIN tp_held c USING (page_id)",
}
_TEXT_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {k}_tp, CAST(sum(len(p) - {c}) AS BIGINT) AS {k}_fp, CAST(sum(len(g) - {c}) AS BIGINT) AS {k}_fn" for k, c in {"text_equal": "e", "text_norm": "n", "text_contained": "h"}.items())


@ask(f"SELECT count(*) AS rows_total, count(*) FILTER (len(g) > 0) AS rows_gold, count(*) FILTER (len(g) > 0 AND len(p) > 0) AS rows_pred, {_TEXT_SUMS}, count(*) FILTER (list_has_any(g, p)) AS rows_exact, count(*) FILTER (list_has_any(gn, pn)) AS rows_norm, count(*) FILTER (h > 0) AS rows_contained FROM said_tp", **_PAGES, **_EMIT)
def emitted_text_match(v):
    """Texts alone: as they are, normalised, and one holding the other."""
    return E.emitted(page_rows(v))


_FIRST = {"firsts": "SELECT page_id, list_filter(gold, lambda x: x.l = 'title')[1] AS g, list_filter(pred, lambda x: x.l = 'title')[1] AS p FROM pages", "first_inter": "SELECT *, greatest(0, least(g.e, p.e) - greatest(g.s, p.s)) AS inter FROM firsts"}


@ask(f"SELECT page_id, CASE WHEN g IS NULL AND p IS NULL THEN true WHEN g IS NULL OR p IS NULL THEN false ELSE {_bare('g.t')} = {_bare('p.t')} END AS text_match, CASE WHEN g IS NULL AND p IS NULL THEN true WHEN g IS NULL OR p IS NULL THEN false ELSE g.s = p.s END AS start_match, CASE WHEN g IS NULL AND p IS NULL THEN true WHEN g IS NULL OR p IS NULL THEN false ELSE g.e = p.e END AS end_match, round(CASE WHEN g IS NULL AND p IS NULL THEN 1.0 WHEN g IS NULL OR p IS NULL OR inter = 0 THEN 0.0 ELSE inter / (g.e - g.s + p.e - p.s - inter) END, 6) AS iou, CASE WHEN g IS NULL AND p IS NULL THEN 0 ELSE p.s - g.s END AS start_delta, CASE WHEN g IS NULL AND p IS NULL THEN 0 ELSE p.e - g.e END AS end_delta FROM first_inter", **_PAGES, **_FIRST)
def compare_first_span(v):
    """The first title of each page against the first predicted one; pages without either agree."""
    mine = lambda c: F.filter(c, lambda s: s["label"] == "title").alias(c)
    return E.first_spans(page_rows(v).select("page_id", mine("gold"), mine("pred")), ["page_id"]).withColumn("iou", F.round("iou", 6))


@ask("SELECT count(*) AS rows_evaluated, count(*) FILTER (doc_id % 4 = 0) AS parse_failures, round(count(*) FILTER (doc_id % 4 = 0) / count(*), 6) AS parse_fail_rate, CAST(sum(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE tp END) AS BIGINT) AS tp, CAST(sum(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE p - tp END) AS BIGINT) AS fp, CAST(sum(CASE WHEN doc_id % 4 = 0 THEN g ELSE g - tp END) AS BIGINT) AS fn FROM pages JOIN exact_pages USING (page_id)", **_PAGES, exact_pages=_EXACT)
def row_report(v):
    """Rows of generated answers: how many don't look like JSON (every fourth document answers in prose), and exact counts of what was parsed."""
    answer = F.when(F.col("doc_id") % 4 == 0, F.lit("No spans here.")).otherwise(F.concat(F.lit("Spans: "), F.to_json(F.struct(F.col("pred").alias("spans"))), F.lit(" .")))
    d = page_rows(v).select("gold", answer.alias("raw"))
    json = F.regexp_extract("raw", "\\{[\\s\\S]*\\}", 0)
    spans = F.coalesce(F.from_json(json, f"struct<spans:{SPANS}>")["spans"], F.array().cast(SPANS))
    d = d.select("gold", (json != "").alias("parse_ok"), spans.alias("pred"))
    tp, fp, fn = S.exact_hits(F.col("gold"), F.col("pred"))
    bad = F.count_if(~F.col("parse_ok"))
    return d.agg(F.count(F.lit(1)).alias("rows_evaluated"), bad.alias("parse_failures"), F.round(bad / F.count(F.lit(1)), 6).alias("parse_fail_rate"), F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
