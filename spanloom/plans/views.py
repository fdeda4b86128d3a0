"""The views that the registered queries share, as DataFrames and, for the oracle, as SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import adapters, text
from spanloom.plans import marks
from spanloom.sources.tables import table


@dataclass
class Views:
    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def docs(self) -> DataFrame:
        return self.read("documents")

    @cached_property
    def docmeta(self) -> DataFrame:
        labels = self.read("labels").select("doc_id", "quality")
        status = F.when(F.col("quality") == 1, "approved").otherwise("pending")
        return self.docs.join(labels.withColumn("is_annotated", F.lit(True)), "doc_id", "left").select("doc_id", F.col("source").alias("filename"), F.col("text").alias("content"), status.alias("status"), F.coalesce("is_annotated", F.lit(False)).alias("is_annotated"))

    @cached_property
    def segs(self) -> DataFrame:
        return text.segments(self.docs.select("doc_id", "text"))

    @cached_property
    def seg_rows(self) -> DataFrame:
        """Segments with their tokens' offsets, gold spans and predictions as arrays: all found as rows are read, without a shuffle."""
        d = adapters.tokenize(self.segs, adapters.delimiter_tokenizer(" ")).drop("token_ids")
        return d.withColumn("gold", marks.gold()).withColumn("pred", marks.predicted(F.col("gold")))

    @cached_property
    def arrays(self) -> DataFrame:
        """Segments with tokens: segment_id, n_tok, offsets, and annotations in order of start, end, label."""
        a = F.array_sort(F.transform("gold", lambda s: F.struct(s["span_start"].alias("span_start"), s["span_end"].alias("span_end"), s["label"].alias("label"))))
        return self.seg_rows.where(F.size("offsets") > 0).select("segment_id", F.size("offsets").cast("long").alias("n_tok"), "offsets", a.alias("annotations"))

    @cached_property
    def toks(self) -> DataFrame:
        return text.tokens(self.segs)

    @cached_property
    def n_toks(self) -> DataFrame:
        return self.arrays.select("segment_id", "n_tok")

    def _spans(self, name: str) -> DataFrame:
        d = self.seg_rows.select("doc_id", "segment_index", "segment_id", F.explode(name).alias("s"))
        return d.select("doc_id", "segment_index", "segment_id", "s.label", "s.span_start", "s.span_end", "s.text")

    @cached_property
    def anns(self) -> DataFrame:
        return self._spans("gold")

    @cached_property
    def preds(self) -> DataFrame:
        return self._spans("pred")

    @cached_property
    def rows(self) -> DataFrame:
        """One row a segment with spans: gold and pred in order of start, end, label."""
        d = self.seg_rows.where((F.size("gold") > 0) | (F.size("pred") > 0))
        return d.select("doc_id", "segment_index", "segment_id", F.array_sort("gold").alias("gold"), F.array_sort("pred").alias("pred"))

    @cached_property
    def strata(self) -> DataFrame:
        has = self.anns.groupBy("doc_id").agg(F.bool_or(F.col("label") == "title").alias("t"), F.bool_or(F.col("label") == "author").alias("a"))
        d = self.docs.select("doc_id", F.length("text").alias("n")).join(has, "doc_id", "left")
        kind = F.when(F.col("t") & F.col("a"), "both").when(F.col("t"), "title_only").when(F.col("a"), "author_only").otherwise("neither")
        size = F.when(F.col("n") < 1000, "short").when(F.col("n") < 3000, "medium").otherwise("long")
        return d.select("doc_id", F.concat_ws("|", kind, size).alias("stratum"))


#: The same views for the oracle; each needs those before it.
SQL = {
    "docmeta": "SELECT d.doc_id, d.source AS filename, d.text AS content, CASE WHEN l.quality = 1 THEN 'approved' ELSE 'pending' END AS status, l.doc_id IS NOT NULL AS is_annotated FROM documents d LEFT JOIN labels l USING (doc_id)",
    "lines": "SELECT doc_id, unnest(range(0, len(l))) AS segment_index, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "starts": "SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_start FROM lines",
    "segs": "SELECT *, span_start + length(text) AS span_end, doc_id || ':' || segment_index AS segment_id FROM starts",
    "pieces": "SELECT doc_id, segment_index, segment_id, unnest(p) AS piece, unnest(range(0, len(p))) AS i FROM (SELECT *, regexp_extract_all(text, '[^ ]+[ ]?|[ ]') AS p FROM segs)",
    "placed": "SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY segment_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM pieces",
    "toks": "SELECT doc_id, segment_index, segment_id, piece, start, start + length(piece) AS \"end\", row_number() OVER (PARTITION BY segment_id ORDER BY i) - 1 AS tok FROM placed WHERE trim(piece) <> ''",
    "counted": "SELECT *, count(*) OVER (PARTITION BY segment_id) AS n_tok FROM toks",
    "n_toks": "SELECT segment_id, count(*) AS n_tok FROM toks GROUP BY 1",
    "marked": "SELECT *, 'title' AS label FROM counted WHERE segment_index % 3 = 0 AND tok < 3 UNION ALL SELECT *, 'author' FROM counted WHERE segment_index % 5 = 0 AND tok >= n_tok - 2",
    "bounds": "SELECT doc_id, segment_index, segment_id, label, min(start) AS span_start, max(\"end\") AS span_end FROM marked GROUP BY ALL",
    "anns": "SELECT b.*, substring(s.text, b.span_start + 1, b.span_end - b.span_start) AS text FROM bounds b JOIN segs s USING (segment_id)",
    "moved": "SELECT doc_id, segment_index, segment_id, label, greatest(0, span_start + doc_id % 13 - 6) AS span_start, span_end + doc_id % 13 - 6 + segment_index % 5 - 2 AS e FROM bounds WHERE (doc_id + segment_index) % 4 <> 0",
    "guessed": "SELECT doc_id, segment_index, segment_id, label, span_start, greatest(span_start + 1, e) AS span_end FROM moved UNION ALL SELECT doc_id, segment_index, segment_id, 'title', 5, 9 FROM segs WHERE doc_id % 7 = 0 AND segment_index = 0",
    "preds": "SELECT g.*, substring(s.text, least(g.span_start, length(s.text)) + 1, least(g.span_end, length(s.text)) - least(g.span_start, length(s.text))) AS text FROM guessed g JOIN segs s USING (segment_id)",
    "gp": "SELECT coalesce(g.segment_id, p.segment_id) AS segment_id, coalesce(g.n, 0) AS g, coalesce(p.n, 0) AS p FROM (SELECT segment_id, count(*) AS n FROM anns GROUP BY 1) g FULL JOIN (SELECT segment_id, count(*) AS n FROM preds GROUP BY 1) p USING (segment_id)",
    "pairs": "SELECT g.doc_id, g.segment_index, segment_id, label, g.span_start AS gs, g.span_end AS ge, p.span_start AS ps, p.span_end AS pe, trim(g.text) = trim(p.text) AS same, greatest(0, least(g.span_end, p.span_end) - greatest(g.span_start, p.span_start)) AS inter FROM anns g JOIN preds p USING (segment_id, label)",
    "pairs2": "SELECT *, CASE WHEN inter > 0 THEN inter / (ge - gs + pe - ps - inter) ELSE 0.0 END AS iou FROM pairs",
    "strata": "SELECT doc_id, (CASE WHEN t AND a THEN 'both' WHEN t THEN 'title_only' WHEN a THEN 'author_only' ELSE 'neither' END) || '|' || (CASE WHEN length(d.text) < 1000 THEN 'short' WHEN length(d.text) < 3000 THEN 'medium' ELSE 'long' END) AS stratum FROM documents d LEFT JOIN (SELECT doc_id, bool_or(label = 'title') AS t, bool_or(label = 'author') AS a FROM anns GROUP BY 1) x USING (doc_id)",
}


def sql(body: str, **more: str) -> str:
    """body with the views before it."""
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in {**SQL, **more}.items()) + "\n" + body
