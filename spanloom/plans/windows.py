"""Queries over documents' text windows and the slides that capture annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import adapters, labels, text
from spanloom.plans.more import _BOUNDS, ask, bounds
from spanloom.plans.registry import _RUNS, _TAGS

# --- syllables and text windows ---

_SYL = {"syl_all": "SELECT segment_id, p, i, CAST(coalesce(sum(length(p)) OVER (PARTITION BY segment_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT segment_id, unnest(x) AS p, unnest(range(0, len(x))) AS i FROM (SELECT segment_id, regexp_extract_all(text, '[^ ,.]+[ ,.]?|[ ,.]') AS x FROM segs))"}


@ask("SELECT segment_id, row_number() OVER (PARTITION BY segment_id ORDER BY i) - 1 AS i, p AS syllable, start, start + length(p) AS \"end\" FROM syl_all WHERE NOT regexp_matches(p, '^[ ,.]') AND NOT regexp_full_match(p, '\\s*')", **_SYL)
def syllables(v):
    """Pieces up to and with one delimiter, with their offsets; lone delimiters and blank pieces are left out."""
    return text.tokens(v.segs, " ,.").select("segment_id", F.col("tok").alias("i"), F.col("piece").alias("syllable"), "start", "end")


_DOC = {
    "doc_pieces": "SELECT doc_id, unnest(x) AS p, unnest(range(0, len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^ ]+[ ]?|[ ]') AS x FROM documents)",
    "doc_placed": "SELECT doc_id, p, i, CAST(coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM doc_pieces",
    "doc_toks": "SELECT doc_id, p, start, start + length(p) AS \"end\", row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM doc_placed WHERE NOT regexp_full_match(p, '\\s*')",
    "doc_sizes": "SELECT d.doc_id, size, coalesce(max(n), 0) AS n FROM documents d CROSS JOIN (VALUES (8), (16), (64)) t(size) LEFT JOIN doc_toks USING (doc_id) GROUP BY ALL",
    "text_win": "SELECT s.doc_id, size, name, coalesce(min(start), 0) AS char_start, coalesce(max(\"end\"), 0) AS char_end, count(p) AS n_tokens, string_agg(p, '' ORDER BY k) AS said FROM (SELECT *, 'full' AS name FROM doc_sizes WHERE n <= 2 * size UNION ALL SELECT s.*, w FROM doc_sizes s, (VALUES ('begin'), ('end')) t(w) WHERE n > 2 * size) s LEFT JOIN doc_toks t ON t.doc_id = s.doc_id AND (name = 'full' OR (name = 'begin' AND k <= size) OR (name = 'end' AND k > t.n - size)) GROUP BY ALL",
    "doc_anns": "SELECT doc_id, label, s.span_start + a.span_start AS s, s.span_start + a.span_end AS e FROM anns a JOIN segs s USING (doc_id, segment_index, segment_id)",
}


def tokenized(v) -> DataFrame:
    return adapters.tokenize(v.docs.select("doc_id", "text"), adapters.delimiter_tokenizer(" ")).drop("token_ids")


def annotated(v) -> DataFrame:
    """(doc_id, annotations): in document coordinates."""
    a = v.anns.join(v.segs.select("segment_id", F.col("span_start").alias("base")), "segment_id")
    return a.groupBy("doc_id").agg(F.collect_list(F.struct("label", (F.col("span_start") + F.col("base")).alias("span_start"), (F.col("span_end") + F.col("base")).alias("span_end"))).alias("annotations"))


@ask("SELECT w.doc_id, name, char_start, char_end, n_tokens, md5(CASE WHEN name <> 'full' THEN said WHEN n_tokens > 0 THEN d.text ELSE '' END) AS text_md5 FROM text_win w JOIN documents d USING (doc_id) WHERE size = 64", **_DOC)
def text_windows(v):
    """The first and last 64 tokens of each document, or all of it up to twice as many."""
    return text.text_windows(tokenized(v), 64).select("doc_id", "name", "char_start", "char_end", "n_tokens", F.md5("window_text").alias("text_md5"))


@ask("SELECT w.doc_id, name, label, s - char_start AS span_start, e - char_start AS span_end FROM text_win w JOIN doc_anns a ON a.doc_id = w.doc_id AND s >= char_start AND e <= char_end WHERE size = 64", **_DOC)
def window_annotations_doc(v):
    """Annotations that lie whole in a text window, rebased in place."""
    w = text.text_windows(tokenized(v), 64).drop("window_text").join(annotated(v), "doc_id")
    inner = labels.rebased(F.col("annotations"), F.col("char_start"), F.col("char_end"))
    return w.select("doc_id", "name", F.explode(inner).alias("a")).select("doc_id", "name", "a.label", "a.span_start", "a.span_end")


@ask("SELECT size, coalesce(label, 'overall') AS label, count(*) AS total, count(*) FILTER (hit) AS captured, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM (SELECT z.size, a.label, EXISTS (SELECT 1 FROM text_win w WHERE w.doc_id = a.doc_id AND w.size = z.size AND a.s >= w.char_start AND a.e <= w.char_end) AS hit FROM doc_anns a, (VALUES (8), (16), (64)) z(size)) GROUP BY GROUPING SETS ((size), (size, label))", **_DOC)
def coverage_by_size(v):
    """How many annotations lie whole in a text window, by window size; overall and by label."""
    d = tokenized(v).join(annotated(v), "doc_id")
    n = F.size("offsets")
    at = lambda i, c: F.get("offsets", i)[c]
    inside = lambda a, lo, hi: (a["span_start"] >= at(lo, "start")) & (a["span_end"] <= at(hi, "end"))

    def flags(size):
        def hit(a):
            either = inside(a, F.lit(0), F.lit(size - 1)) | inside(a, n - size, n - 1)
            return F.when(n == 0, (a["span_start"] >= 0) & (a["span_end"] <= 0)).when(n <= 2 * size, inside(a, F.lit(0), n - 1)).otherwise(either)

        return F.transform("annotations", lambda a: F.struct(F.lit(size).alias("size"), a["label"].alias("label"), hit(a).alias("hit")))

    e = d.select(F.explode(F.concat(*map(flags, (8, 16, 64)))).alias("x")).select("x.*")
    total, got = F.count(F.lit(1)), F.count_if("hit")
    s = e.groupingSets([["size"], ["size", "label"]], "size", "label").agg(total.alias("total"), got.alias("captured"), F.round(got / total, 6).alias("rate"))
    return s.withColumn("label", F.coalesce("label", F.lit("overall")))


_FAIL = {
    "seg_expected": "SELECT a.segment_id, label, min(start) AS s, max(\"end\") AS e FROM anns a JOIN toks t ON t.segment_id = a.segment_id AND start < span_end AND \"end\" > span_start GROUP BY a.segment_id, label, span_start, span_end",
    "seg_decoded": "SELECT segment_id, lower(substring(min(tag), 3)) AS label, min(start) AS s, max(\"end\") AS e FROM cuts WHERE tag <> 'O' GROUP BY segment_id, island HAVING arg_min(left(tag, 1), tok) = 'B'",
}


@ask("SELECT segment_id FROM ((SELECT * FROM seg_expected EXCEPT ALL SELECT * FROM seg_decoded) UNION ALL (SELECT * FROM seg_decoded EXCEPT ALL SELECT * FROM seg_expected)) GROUP BY 1", **_TAGS, **_RUNS, **_FAIL)
def roundtrip_failures(v):
    """Segments whose tags don't decode to their annotations, stretched to tokens (multisets), or that have an annotation without a token."""
    rows = v.arrays

    def whole(x):
        return (F.size(labels.token_ranges(x["o"], x["a"])) == F.size(x["a"])) & labels.comes_back(x["o"], labels.tags(x["o"], x["a"]), x["a"])

    return rows.where(~labels.let(F.struct(F.col("offsets").alias("o"), F.col("annotations").alias("a")), whole)).select("segment_id")


# --- slides ---

_SLIDE = {
    "span_slides": "SELECT label, n_tok, lo, hi, (SELECT min(i) FROM range(40) r(i) WHERE CASE WHEN n_tok <= 16 THEN i = 0 ELSE i * 8 < n_tok AND i * 8 <= lo AND hi < least(i * 8 + 16, n_tok) END) + 1 AS nb, (SELECT min(i) FROM range(40) r(i) WHERE CASE WHEN n_tok <= 16 THEN i = 0 ELSE n_tok - i * 8 > 0 AND greatest(n_tok - i * 8 - 16, 0) <= lo AND hi < n_tok - i * 8 END) + 1 AS ne FROM spans_n",
}


def needed(v, window: int = 16, step: int = 8) -> DataFrame:
    """(label, nb, ne): how many slides from the beginning and from the end it takes until one holds the annotation, in closed form; null
    where no slide does. A slide from the beginning covers [i * step, i * step + window), one from the end [n - i * step - window, n - i * step)."""
    b = F.greatest(F.lit(0), F.ceil((F.col("hi") + 1 - window) / step))
    e = F.greatest(F.lit(0), F.ceil((F.col("n_tok") - window - F.col("lo")) / step))
    return bounds(v).select("label", F.when(b * step <= F.col("lo"), b + 1).alias("nb"), F.when(F.col("hi") < F.col("n_tok") - e * step, e + 1).alias("ne"))


@ask("SELECT n, coalesce(label, 'overall') AS label, count(*) AS total, count(*) FILTER (nb <= n) AS begin_hits, count(*) FILTER (ne <= n) AS end_hits, count(*) FILTER (nb <= n OR ne <= n) AS both_hits FROM span_slides, range(1, 31) r(n) GROUP BY GROUPING SETS ((n), (n, label))", **_BOUNDS, **_SLIDE)
def capture_curve(v):
    """Annotations held by the first n slides from either end, n up to 30, overall and by label: counts of how many slides each needs, added up
    over the slides before."""
    d = needed(v).select("label", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(c, F.lit(99)).alias("need")) for k, c in (("begin", F.col("nb")), ("end", F.col("ne")), ("both", F.least("nb", "ne")))])).alias("x"))
    per = d.select(F.explode(F.array("label", F.lit("overall"))).alias("label"), "x.kind", "x.need").groupBy("label", "need").pivot("kind", ["begin", "end", "both"]).count().fillna(0)
    each = per.select("label", "begin", "end", "both", F.explode(F.array_append(F.filter(F.sequence(F.lit(1), F.lit(30)), lambda n: n >= F.col("need")), F.lit(99))).alias("n"))
    s = each.groupBy("label", "n").agg(F.sum("begin").alias("b"), F.sum("end").alias("e"), F.sum("both").alias("c"))
    total = s.where("n = 99").select("label", F.col("b").alias("total"))
    grid = total.select("label", "total", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("n"))
    none = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return grid.join(s.where("n < 99"), ["label", "n"], "left").select("n", "label", "total", none("b", "begin_hits"), none("e", "end_hits"), none("c", "both_hits"))


@ask("SELECT target, (SELECT min(n) FROM range(1, 41) r(n) WHERE (SELECT count(*) FILTER (nb <= n) FROM span_slides) >= target * t.total) AS begin_only, (SELECT min(n) FROM range(1, 41) r(n) WHERE (SELECT count(*) FILTER (ne <= n) FROM span_slides) >= target * t.total) AS end_only, g.nb, g.ne, g.hits FROM (SELECT target, count(*) AS total FROM span_slides, (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) z(target) GROUP BY 1) t LEFT JOIN LATERAL (SELECT x.nb, y.ne, (SELECT count(*) FILTER (s.nb <= x.nb OR s.ne <= y.ne) FROM span_slides s) AS hits FROM range(1, 41) x(nb), range(1, 41) y(ne) WHERE hits >= t.target * t.total ORDER BY x.nb + y.ne, x.nb, y.ne LIMIT 1) g ON true", **_BOUNDS, **_SLIDE)
def min_slides_for_target(v):
    """The fewest slides that hold a share of the annotations: from one end alone, and from both, on the whole grid of 40 x 40. Each span needs nb
    slides from the beginning or ne from the end; a table of counts by (nb, ne) and its sums to either side give all 1600 cells at once."""
    most = 40
    need = needed(v).select(*[F.least(F.coalesce(c, F.lit(most + 1)), F.lit(most + 1)).alias(c) for c in ("nb", "ne")]).groupBy("nb", "ne").count()
    side = F.sequence(F.lit(1), F.lit(most + 1))
    grid = v.spark.range(1).select(F.explode(side).alias("nb")).select("nb", F.explode(side).alias("ne")).join(need, ["nb", "ne"], "left").fillna(0)
    # of the spans that need more than nb and more than ne, none is held
    after = lambda by, order: Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    missed = grid.withColumn("more", F.coalesce(F.sum("count").over(after("nb", "ne")), F.lit(0))).withColumn("missed", F.coalesce(F.sum("more").over(after("ne", "nb")), F.lit(0)))
    total = need.agg(F.sum("count").alias("total"))
    upto = lambda c: need.select(F.explode(F.sequence(F.col(c), F.lit(most + 1))).alias("n"), "count").groupBy("n").agg(F.sum("count").alias("held"))
    targets = F.explode(F.array(F.lit(0.5), F.lit(0.9))).alias("target")
    cells = missed.where(f"nb <= {most} and ne <= {most}").select("nb", "ne", "missed", F.lit(0).alias("one"))
    cells = cells.join(total.withColumn("one", F.lit(0)), "one").select("*", targets).withColumn("hits", F.col("total") - F.col("missed"))
    best = cells.where("hits >= target * total").groupBy("target").agg(F.min(F.struct((F.col("nb") + F.col("ne")).alias("s"), "nb", "ne", "hits")).alias("x"))

    def alone(c: str, name: str) -> DataFrame:
        d = upto(c).where(f"n <= {most}").withColumn("one", F.lit(0)).join(total.withColumn("one", F.lit(0)), "one").select("*", targets)
        return d.where("held >= target * total").groupBy("target").agg(F.min("n").alias(name))

    out = total.select(targets).join(alone("nb", "begin_only"), "target", "left").join(alone("ne", "end_only"), "target", "left").join(best, "target", "left")
    return out.select("target", "begin_only", "end_only", "x.nb", "x.ne", "x.hits")
