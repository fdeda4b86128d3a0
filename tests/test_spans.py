"""Literal cases of span matching, windows and labels."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.operators import sampling, text


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def span(a, b, label="title", s=""):
    return F.struct(F.lit(a).cast("long").alias("span_start"), F.lit(b).cast("long").alias("span_end"), F.lit(label).alias("label"), F.lit(s).alias("text"))


@pytest.mark.parametrize("a, b, want", [((0, 3), (5, 8), 0.0), ((2, 8), (2, 8), 1.0), ((2, 8), (5, 10), 0.375)])
def test_iou(spark, a, b, want):
    assert one(spark, S.iou(span(*a), span(*b))) == want


@pytest.mark.parametrize("match, gold, pred, tp", [("iou50", (0, 10), (2, 9), 1), ("iou80", (0, 10), (2, 9), 0), ("both", (10, 20), (12, 22), 1), ("both", (10, 60), (40, 90), 0), ("start", (10, 20), (12, 30), 1), ("end", (10, 20), (12, 30), 0)])
def test_greedy(spark, match, gold, pred, tp):
    assert one(spark, S.greedy(F.array(span(*gold)), F.array(span(*pred)), S.MATCHES[match])) == tp


def test_greedy_is_one_to_one(spark):
    gold, pred = F.array(span(0, 10), span(0, 10)), F.array(span(0, 10))
    assert one(spark, S.greedy(gold, pred, S.MATCHES["iou50"])) == 1
    assert [one(spark, x) for x in S.exact_hits(gold, pred)] == [1, 0, 0]  # sets: duplicates count once


@pytest.mark.parametrize("n, count", [(512, 1), (513, 2), (768, 0), (1024, 0), (4096, 0), (4352, 2), (5000, 30), (8193, 30)])
def test_window_counts(spark, n, count):
    df = spark.createDataFrame([("s", n)], "segment_id string, n_tok int")
    assert text.slide_windows(df, 512, 256, 15).count() == count


def test_first_of_equal_windows_stays(spark):
    df = spark.createDataFrame([("s", 768)], "segment_id string, n_tok int")
    assert text.slide_windows(df, 512, 256, 15, keep="first").count() == 2


def test_tokens_keep_offsets_over_delimiters(spark):
    segs = spark.createDataFrame([(1, 0, "1:0", "ab་།  ་cd")], "doc_id long, segment_index int, segment_id string, text string")
    assert [(r.piece, r.start) for r in text.tokens(segs, "་།").orderBy("tok").collect()] == [("ab་", 0), ("  ་", 4), ("cd", 7)]


def test_bio_round_trip(spark):
    toks = spark.createDataFrame([("s", i, i * 4, i * 4 + 4) for i in range(10)], "segment_id string, tok int, start int, end int")
    anns = spark.createDataFrame([("s", "title", 4, 12), ("s", "author", 20, 24)], "segment_id string, label string, span_start int, span_end int")
    tags = text.bio_tags(toks, anns)
    assert [r.tag for r in tags.orderBy("tok").collect()] == ["O", "B-TITLE", "I-TITLE", "O", "O", "B-AUTHOR", "O", "O", "O", "O"]
    assert {(r.label, r.span_start, r.span_end) for r in text.bio_spans(tags).collect()} == {("title", 4, 12), ("author", 20, 24)}


@pytest.mark.parametrize("n, want", [(1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (50, (44, 1, 5))])
def test_split_sizes(spark, n, want):
    df = spark.createDataFrame([(i, "a") for i in range(n)], "doc_id long, stratum string")
    got = dict(sampling.stratified_split(df).groupBy("split").count().collect())
    assert (got.get("train", 0), got.get("val", 0), got.get("test", 0)) == want
