"""Queries over plug-ins and labels in place: window labels, training examples, stub predictions, merged votes, entity F1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import adapters, labels, text
from spanloom.plans.more import _WTAGS, ask, examples, window_rows
from spanloom.plans.registry import _PRF, _WINDOWS

NAMES = ["O", "B-TITLE", "I-TITLE", "B-AUTHOR", "I-AUTHOR"]


def stub_model():
    """Scores from whole numbers of a place and its id alone: one label scores 1 to 9, the others 0."""
    import numpy as np

    names = np.array([1, 2, 2, 3, 4, 0, 0])

    def model(ids, mask):
        place = np.arange(ids.shape[1])[None]
        out = np.zeros((*ids.shape, 5))
        np.put_along_axis(out, names[(ids * 3 + place * 5) % 7][..., None], (1 + (ids * 7 + place * 3) % 9)[..., None].astype(float), axis=2)
        return out

    return model


_VOTE = {
    "said": "SELECT w.segment_id, w.side, w.slide_index, t.tok, t.start, t.\"end\", (ARRAY['B-TITLE', 'I-TITLE', 'I-TITLE', 'B-AUTHOR', 'I-AUTHOR', 'O', 'O'])[((length(piece) + 2) * 3 + (t.tok - start_tok + 1) * 5) % 7 + 1] AS tag, 1 + ((length(piece) + 2) * 7 + (t.tok - start_tok + 1) * 3) % 9 AS conf, CASE side WHEN 'end' THEN slide_index + 4 ELSE slide_index END AS place FROM windows w JOIN toks t ON t.segment_id = w.segment_id AND t.tok >= start_tok AND t.tok < least(end_tok, start_tok + 14)",
    "voted": "SELECT segment_id, start, max(\"end\") AS \"end\", arg_max(tag, conf * 100 - place) AS tag FROM said GROUP BY segment_id, start",
    "chained": "SELECT *, sum(CASE WHEN left(tag, 1) = 'I' AND substring(p, 3) = substring(tag, 3) THEN 0 ELSE 1 END) OVER (PARTITION BY segment_id ORDER BY start) AS island FROM (SELECT *, lag(tag) OVER (PARTITION BY segment_id ORDER BY start) AS p FROM voted)",
    "merged": "SELECT segment_id, lower(substring(min(tag), 3)) AS label, min(start) AS span_start, max(\"end\") AS span_end FROM chained WHERE tag <> 'O' GROUP BY segment_id, island HAVING arg_min(left(tag, 1), start) = 'B'",
}


def predicted(v) -> DataFrame:
    """Fixed-length examples of all windows, tokenized and labelled by plug-ins: offsets are the segment's, (0, 0) on signs and padding."""
    toks = adapters.tokenize(v.segs.select("segment_id", "text"), adapters.delimiter_tokenizer(" ")).drop("text").withColumn("n_tok", F.size("offsets")).where("n_tok > 0")
    w = text.with_windows(toks, 16, 8, 4).select("segment_id", "token_ids", "offsets", F.explode("ws").alias("w"))
    cut = lambda c: F.slice(c, F.col("w.start_tok") + 1, F.least(F.col("w.end_tok") - F.col("w.start_tok"), F.lit(14)))
    w = w.select("segment_id", "w.side", "w.slide_index", cut("token_ids").alias("ids"), cut("offsets").alias("own"))
    pad, sign = F.lit(14) - F.size("ids"), F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    w = w.select("segment_id", "side", "slide_index", F.concat(F.array(F.lit(0)), "ids", F.array(F.lit(2)), F.array_repeat(F.lit(1), pad)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), F.size("ids") + 2), F.array_repeat(F.lit(0), pad)).alias("attention_mask"), F.concat(sign, "own", F.array_repeat(sign[0], pad + 1)).alias("offsets"))
    return adapters.predict(w, lambda: stub_model())


def said_spans(v) -> DataFrame:
    """Segments with their tokens' offsets and the spans that a stub model finds in them, in place."""
    toks = adapters.tokenize(v.segs, adapters.delimiter_tokenizer(" ")).withColumn("n_tok", F.size("offsets"))
    return adapters.predict_spans(text.with_windows(toks, 16, 8, 4).drop("n_tok"), lambda: stub_model(), NAMES, 14)


@ask("SELECT * FROM merged", **_WINDOWS, **_VOTE)
def merge_predictions(v):
    """A stub model's labels of every window, merged to spans of the segment; both the tokenizer and the model are plug-ins."""
    return said_spans(v).select("segment_id", F.explode("spans").alias("s")).select("segment_id", "s.label", "s.span_start", "s.span_end")


@ask("SELECT segment_id, side, CAST(slide_index AS BIGINT) AS slide_index, tok, tag FROM w_all", **_WINDOWS, **_WTAGS)
def bio_tags_window(v):
    """Tags of each window's tokens from the annotations that lie whole in it."""
    w = window_rows(v)
    return w.select("segment_id", "side", "slide_index", "start_tok", F.posexplode("tags").alias("i", "tag")).select("segment_id", "side", "slide_index", (F.col("start_tok") + F.col("i")).alias("tok"), "tag")


_BACK = {
    "w_expected": "SELECT segment_id, side, slide_index, label, min(start) AS s, max(\"end\") AS e FROM w_over GROUP BY segment_id, side, slide_index, label, span_start, span_end",
    "w_cuts": "SELECT *, sum(CASE WHEN left(tag, 1) = 'I' AND substring(p, 3) = substring(tag, 3) THEN 0 ELSE 1 END) OVER (PARTITION BY segment_id, side, slide_index ORDER BY tok) AS island FROM (SELECT *, lag(tag) OVER (PARTITION BY segment_id, side, slide_index ORDER BY tok) AS p FROM w_all)",
    "w_decoded": "SELECT segment_id, side, slide_index, lower(substring(min(tag), 3)) AS label, min(start) AS s, max(\"end\") AS e FROM w_cuts WHERE tag <> 'O' GROUP BY segment_id, side, slide_index, island HAVING arg_min(left(tag, 1), tok) = 'B'",
}


@ask("SELECT segment_id, side, CAST(slide_index AS BIGINT) AS slide_index FROM ((SELECT * FROM w_expected EXCEPT ALL SELECT * FROM w_decoded) UNION ALL (SELECT * FROM w_decoded EXCEPT ALL SELECT * FROM w_expected)) GROUP BY ALL", **_WINDOWS, **_WTAGS, **_BACK)
def roundtrip_failures_window(v):
    """Windows whose tags don't decode to their annotations, stretched to tokens."""
    return window_rows(v).where(~labels.comes_back(F.col("window_offsets"), F.col("tags"), F.col("window_annotations"))).select("segment_id", "side", "slide_index")


_SEQ = {
    "gold_at": "SELECT segment_id, side, slide_index, tok, tag FROM w_all WHERE tok < start_tok + 14",
    "seq": "SELECT 'g' AS who, segment_id, side, slide_index, tok, tag FROM gold_at UNION ALL SELECT 'p', segment_id, side, slide_index, tok, tag FROM said",
    "seq_cut": "SELECT *, sum(CASE WHEN left(tag, 1) = 'I' AND substring(p, 3) = substring(tag, 3) THEN 0 ELSE 1 END) OVER (PARTITION BY who, segment_id, side, slide_index ORDER BY tok) AS island FROM (SELECT *, lag(tag) OVER (PARTITION BY who, segment_id, side, slide_index ORDER BY tok) AS p FROM seq)",
    "seq_chunks": "SELECT who, segment_id, side, slide_index, substring(min(tag), 3) AS type, min(tok) AS a, max(tok) AS b FROM seq_cut WHERE tag <> 'O' GROUP BY who, segment_id, side, slide_index, island",
    "seq_met": "SELECT type, segment_id, side, slide_index, a, b, count(*) FILTER (who = 'g') AS g, count(*) FILTER (who = 'p') AS p FROM seq_chunks GROUP BY ALL",
    "seq_type": "SELECT type, count(*) FILTER (g > 0 AND p > 0) AS tp, count(*) FILTER (g = 0) AS fp, count(*) FILTER (p = 0) AS fn FROM seq_met GROUP BY 1",
}


@ask(f"SELECT view, tp, fp, fn, {_PRF} FROM (SELECT coalesce(type, 'overall') AS view, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM seq_type GROUP BY GROUPING SETS ((), (type)))", **_WINDOWS, **_WTAGS, **_VOTE, **_SEQ)
def window_seq_f1(v):
    """Entity P/R/F1 of the stub model's labels on training windows, by the lenient chunk rule; overall and by type."""
    from spanloom.operators.evaluate import with_prf

    both = examples(v).select("segment_id", "side", "slide_index", "labels").join(predicted(v).select("segment_id", "side", "slide_index", "label_ids"), ["segment_id", "side", "slide_index"])
    c = labels.entity_counts(both, F.col("labels"), F.col("label_ids"), NAMES)
    s = c.groupingSets([[], ["type"]], "type").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    return with_prf(s.select(F.coalesce("type", F.lit("overall")).alias("view"), "tp", "fp", "fn"))
