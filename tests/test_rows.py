"""Segments, tokens, passages, ranks, spans as arrays, samples and guards on literal and random cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.operators import evaluate, guards, ranks, sampling, text
from spanloom.operators.passages import passages
from spanloom.sources import tables


def test_segments_as_rows_are_read(spark):
    df = spark.createDataFrame([("d1", "ab\n\né😀c"), ("d2", ""), ("d3", None), (None, "x\n")], "doc_id string, text string")
    got = {(r.doc_id, r.segment_index): (r.segment_id, r.span_start, r.span_end, r.text) for r in text.segments(df).collect()}
    assert got == {("d1", 0): ("d1:0", 0, 2, "ab"), ("d1", 1): ("d1:1", 3, 3, ""), ("d1", 2): ("d1:2", 4, 7, "é😀c"), ("d2", 0): ("d2:0", 0, 0, ""), (None, 0): (None, 0, 1, "x"), (None, 1): (None, 2, 2, "")}
    assert text.segments(df.limit(0)).count() == 0


def test_tokens_cover_their_places(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab ,.\té"), int(n))) for n in rng.integers(0, 40, 60)]
    segs = spark.createDataFrame([(1, i, f"1:{i}", t) for i, t in enumerate(texts)], "doc_id long, segment_index int, segment_id string, text string")
    got = {}
    for r in text.tokens(segs, " ,.").orderBy("segment_index", "tok").collect():
        assert texts[r.segment_index][r.start : r.end] == r.piece and r.tok == len(got.setdefault(r.segment_index, []))
        got[r.segment_index].append((r.start, r.end))
    assert got == {i: x for i, t in enumerate(texts) if (x := [m.span() for m in re.finditer("[^ ,.]+[ ,.]?", t) if m.group().strip()])}


def test_passages_of_any_length(spark):
    texts = ["one two three four", "xone two threex", "aa b", "c aa", "abc\ndef ghi jkl", "", None, "two  spaces in it"]
    items = ["one two three", "two three", "aa", "a", "abc\ndef ghi", "ghi", "", None, "two  spaces in", "missing word here", "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = sorted(map(tuple, passages(docs, bench).collect()))
    assert got == sorted((i, d, t.find(p)) for i, p in enumerate(items) for d, t in enumerate(texts) if p and t and p in t)
    assert passages(docs, bench.where("length(text) > 10")).count() == len([1 for p in items for t in texts if p and t and len(p) > 10 and p in t])
    assert passages(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("keys", [[7, 10**15, -3, 5, 123456789], ["b", "a", "zz", "c"], []])
def test_positions_of_any_key(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], f"k {'string' if keys and isinstance(keys[0], str) else 'long'}").repartition(3)
    assert {r.k: r.pos for r in ranks.positions(df, "k").collect()} == {k: i for i, k in enumerate(sorted(keys))}


@pytest.mark.parametrize("width", [None, 0.05, 10.0])
def test_percentiles_by_ranges(spark, width):
    x = np.random.default_rng(6).normal(size=501)
    x[:50] = 0.25
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 3.0)], "g string, x double")
    r = ranks.value_ranks(df, "x", "g", width=width).groupBy("g").agg(*[ranks.between_ranks("x", q).alias(f"q{i}") for i, q in enumerate((0.0, 0.5, 0.9, 1.0))], ranks.at_rank("x", F.floor(F.col("n") / 2)).alias("m"))
    got = {row.g: tuple(row)[1:] for row in r.collect()}
    assert np.allclose(got["a"], [*np.percentile(x, [0, 50, 90, 100]), np.sort(x)[250]]) and got["b"] == (3.0,) * 5


def arr(spans):
    kind = "array<struct<span_start:bigint,span_end:bigint,label:string,text:string>>"
    return F.array(*[F.struct(F.lit(a).alias("span_start"), F.lit(b).alias("span_end"), F.lit(n).alias("label"), F.lit(t).alias("text")) for a, b, n, t in spans]).cast(kind)


def row(spark, gold, pred):
    return spark.range(1).select(F.lit(1).alias("k"), arr(gold).alias("gold"), arr(pred).alias("pred"))


def test_offset_rows(spark):
    r = evaluate.offset_rows(row(spark, [(10, 20, "title", ""), (40, 50, "title", "")], [(15, 25, "Title", ""), (15, 25, "author", "")]), ["k"]).first()
    assert (r.paired, r.start_err, r.end_err, r.start_10, r.both_10, r.overlap_50) == (True, 5, 5, True, True, True)
    r = evaluate.offset_rows(row(spark, [(10, 60, "title", "")], [(40, 90, "title", "")]), ["k"]).first()
    assert (r.both_10, r.both_50, r.overlap_50) == (False, True, True)
    r = evaluate.offset_rows(row(spark, [(1, 2, "title", "")], []), ["k"]).first()
    assert (r.has_gold, r.has_pred, r.paired, r.iou, r.start_err, r.start_10) == (True, False, False, 0.0, None, False)


def test_first_spans(spark):
    r = evaluate.first_spans(row(spark, [(0, 4, "title", "0123")], [(1, 5, "title", "1234")]), ["k"]).first()
    assert (r.text_match, r.start_delta, r.end_delta) == (False, 1, 1) and r.iou > 0.5
    r = evaluate.first_spans(row(spark, [], []), ["k"]).first()
    assert (r.text_match, r.start_match, r.end_match, r.iou, r.start_delta, r.end_delta) == (True, True, True, 1.0, 0, 0)
    r = evaluate.first_spans(row(spark, [(0, 4, "title", "")], []), ["k"]).first()
    assert (r.text_match, r.iou, r.start_delta) == (False, 0.0, None)


def test_emitted_texts(spark):
    gold = [(0, 1, "a", "abc་།"), (0, 1, "a", "abc་།"), (0, 1, "a", "xyz "), (0, 1, "a", "")]
    pred = [(0, 1, "a", "abc"), (0, 1, "a", "abc་།"), (0, 1, "a", "xy"), (0, 1, "a", "　xyz")]
    r = evaluate.emitted(row(spark, gold, pred)).first()
    assert (r.text_equal_tp, r.text_norm_tp, r.text_contained_tp, r.text_norm_fn) == (1, 3, 3, 1)
    assert (r.rows_total, r.rows_gold, r.rows_exact, r.rows_norm, r.rows_contained) == (1, 1, 1, 1, 1)


def test_last_hit_of_a_segment(spark):
    rows = [("d", "s", 0, 1), ("d", "s", 1, 2), ("d", "s", 2, 0), ("d", "t", 0, 0), ("d", "t", 1, 0), ("", "s", 0, 5), (None, "s", 0, 5)]
    got = evaluate.last_hit_rows(spark.createDataFrame(rows, "doc string, seg string, pos int, tp int"), ["doc", "seg"], "pos")
    assert sorted(map(tuple, got.collect())) == [("d", "s", 1, 2), ("d", "t", 0, 0)]


def test_greedy_uses_a_prediction_once_and_in_order(spark):
    near = S.near(10)["start"]
    gold, pred = [(10, 12, "a", ""), (12, 14, "a", ""), (100, 101, "a", "")], [(11, 13, "A", ""), (15, 17, "a", ""), (12, 14, "b", "")]
    assert row(spark, gold, pred).select(S.greedy(F.col("gold"), F.col("pred"), near)).first()[0] == 2
    assert row(spark, gold[:2] * 2, pred).select(S.greedy(F.col("gold"), F.col("pred"), near)).first()[0] == 2


def test_generated_spans_stand_once(spark):
    said = [(5, 7, "a", "x"), (0, 2, "a", "y"), (5, 7, "b", "x"), (5, 7, "a", "z")]
    got = row(spark, said, []).select(S.distinct_spans(S.rebased(F.col("gold"), F.lit(100).cast("long"))).alias("s")).first().s
    assert [(x.span_start, x.span_end, x.label, x.text) for x in got] == [(100, 102, "a", "y"), (105, 107, "a", "x"), (105, 107, "a", "z")]


def test_balance_counts(spark):
    rows = [(f"e{i}", "s", True, True) for i in range(3)] + [(f"o{i}", "s", False, True) for i in range(9)] + [("x", "t", False, False)]
    r = sampling.balance_counts(spark.createDataFrame(rows, "key string, segment_id string, has_entity boolean, has_author boolean")).first()
    assert tuple(r) == (13, 12, 4, 3, 2)


def test_balance_counts_are_those_of_balance_without_ranks(spark):
    rng = np.random.default_rng(5)
    rows = [(f"k{i}", f"s{rng.integers(12)}", bool(rng.random() < 0.3), bool(rng.random() < 0.5)) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, segment_id string, has_entity boolean, has_author boolean")
    for ratio, oversample in ((2.0, 2), (0.5, 3)):
        counts, kept = sampling.balance_counts(df, ratio, oversample), sampling.balance(df, ratio, oversample)
        plain = df.where("not has_entity").count() - kept.where("not has_entity").count()
        assert tuple(counts.first()) == (300, kept.count(), plain, kept.where("copy > 1").count(), 12)
        assert "Window" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(sampling.balance_counts(df.limit(0)).first()) == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("check, args", [(guards.ratios, (0.5, 0.4, 0.2)), (guards.ratios, (1.2, -0.1, -0.1)), (guards.fraction, (0,)), (guards.fraction, (1.5,)), (guards.worker, (3, 3)), (guards.worker, (0, 0))])
def test_guards_raise(check, args):
    with pytest.raises(ValueError):
        check(*args)


def test_guards_pass():
    guards.ratios(0.89, 0.01, 0.1), guards.fraction(1), guards.worker(2, 3)


def test_older_documents_raise(spark):
    kind = "doc_id string, segments array<string>, annotations array<string>"
    good = [("a", ["s"], ["n"]), ("b", [], []), ("c", None, None)]
    assert guards.segmented(spark.createDataFrame(good, kind)).count() == 3
    with pytest.raises(Exception, match="annotations without segments: old"):
        guards.segmented(spark.createDataFrame([*good, ("old", None, ["n"])], kind)).collect()


def test_dataset_scan_and_texts(spark, tmp_path):
    df = spark.range(100).select("id", F.lit("x").alias("extra"))
    df.write.parquet(str(tmp_path / "p")), df.write.json(str(tmp_path / "d.jsonl"))
    a, b = (tables.dataset(spark, str(tmp_path / x), ["id"], most=10, key="id") for x in ("p", "d.jsonl"))
    assert a.columns == ["id"] and sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect()) and a.count() == 10
    rows = spark.createDataFrame([(1, "own"), (2, ""), (3, None), (4, "")], "k int, text string")
    other = spark.createDataFrame([(1, "no"), (2, "two"), (3, "three")], "k int, text string")
    assert {r.k: r.text for r in tables.with_texts(rows, other, ["k"]).collect()} == {1: "own", 2: "two", 3: "three", 4: ""}


def test_prompts_and_windows_of_tokens(spark):
    from spanloom.functions.prompts import prompt, token_stats

    p = spark.range(1).select(*[prompt(F.lit("I"), F.lit("x\ny"), f).alias(f) for f in ("llama", "qwen", "other")], prompt(F.lit("I"), F.lit("t"), template=lambda u: F.concat(F.lit("<u>"), u)).alias("own")).first()
    assert (p.llama, p.qwen, p.other, p.own) == ("<s>[INST] I\n\nx\ny [/INST]", "<|im_start|>user\nI\n\nx\ny\n<|im_start|>assistant\n", p.llama, "<u>I\n\nt")
    kind = "array<struct<chars:bigint,prompt:bigint,output:bigint>>"
    d = spark.createDataFrame([([(10, 5, 2), (8, 9, 1)], 10), ([], 4), ([(4, 3, 0)], 4)], f"w {kind}, chars long")
    got = [tuple(r.x) for r in d.select(token_stats(F.col("w"), F.col("chars"), 20, 12).alias("x")).collect()]
    assert got == [(2, 14, 3, 10, 3, True), (0, 0, 0, 0, 12, False), (1, 3, 0, 3, 9, False)]
