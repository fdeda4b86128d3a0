"""Plug-ins, labels in place, crops and entity chunks on literal cases."""

import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanloom.operators import adapters, crops, labels, text

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module


def four(n):
    """n tokens of four characters each."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 4).alias("start"), (i * 4 + 4).alias("end")))


def anns(*spans):
    return F.array(*[F.struct(F.lit(name).alias("label"), F.lit(a).cast("long").alias("span_start"), F.lit(b).cast("long").alias("span_end")) for name, a, b in spans]).cast("array<struct<label:string,span_start:bigint,span_end:bigint>>")


def window(spark, n, start, end, *spans):
    ws = F.array(F.struct(F.lit("begin").alias("side"), F.lit(1).alias("slide_index"), F.lit(start).alias("start_tok"), F.lit(end).alias("end_tok")))
    rows = spark.range(1).select(four(n).alias("offsets"), anns(*spans).alias("annotations"), ws.alias("ws"))
    return labels.window_labels(rows).first()


def test_window_rebases_annotations(spark):
    w = window(spark, 600, 256, 600, ("title", 1100, 1120))
    assert [(a.span_start, a.span_end) for a in w.window_annotations] == [(76, 96)]
    assert w.tags[19] == "B-TITLE" and w.tags[20:24] == ["I-TITLE"] * 4 and set(w.tags[:19] + w.tags[24:]) == {"O"}
    assert w.char_start == 1024 and w.window_offsets[0] == (0, 4)


def test_window_at_the_start(spark):
    w = window(spark, 600, 0, 512, ("author", 16, 32))
    assert w.tags[4:8] == ["B-AUTHOR", "I-AUTHOR", "I-AUTHOR", "I-AUTHOR"]


@pytest.mark.parametrize("span", [("title", 100, 120), ("title", 1020, 1030)])
def test_outside_or_cut_annotations_give_no_labels(spark, span):
    w = window(spark, 600, 256, 600, span)
    assert w.window_annotations == [] and set(w.tags) == {"O"}


def tags_of(spark, n, *spans):
    d = spark.range(1).select(four(n).alias("o"), anns(*spans).alias("a"))
    d = d.withColumn("t", labels.tags(F.col("o"), F.col("a")))
    return d.select("t", labels.decoded(F.col("o"), F.col("t")).alias("d"), labels.comes_back(F.col("o"), F.col("t"), F.col("a")).alias("ok")).first()


def brute_tags(n, spans):
    out = ["O"] * n
    for name, s, e in sorted(spans, key=lambda x: (x[1], x[1] - x[2])):
        first = True
        for i in range(n):
            if i * 4 < e and i * 4 + 4 > s:
                if out[i] == "O" or out[i].endswith(name.upper()):
                    out[i] = ("B-" if first else "I-") + name.upper()
                first = False
    return out


def test_tags_equal_a_loop(spark):
    rng = np.random.default_rng(1)
    for _ in range(25):
        spans = [(str(rng.choice(["title", "author"])), int(a), int(a + rng.integers(1, 30))) for a in rng.integers(0, 70, int(rng.integers(0, 5)))]
        assert tags_of(spark, 20, *spans).t == brute_tags(20, spans), spans


def test_shadowed_annotation_leaves_an_orphan(spark):
    got = tags_of(spark, 6, ("title", 0, 8), ("author", 4, 16))
    assert got.t == ["B-TITLE", "I-TITLE", "I-AUTHOR", "I-AUTHOR", "O", "O"]
    assert [d.label for d in got.d] == ["title"] and not got.ok
    assert tags_of(spark, 6, ("title", 1, 7), ("author", 12, 13)).ok


@pytest.mark.parametrize(
    "tags, want",
    [
        (["O", "B-A", "I-A", "O"], [("A", 1, 2)]),
        (["I-A", "I-A", "I-B", "B-B"], [("A", 0, 1), ("B", 2, 2), ("B", 3, 3)]),  # an I without a B opens, a change of type cuts, a B opens anew
        (["B-A", "O", "I-A"], [("A", 0, 0), ("A", 2, 2)]),
        (["O", "O"], []),
    ],
)
def test_lenient_chunks(spark, tags, want):
    got = spark.range(1).select(labels.chunks(F.array(*map(F.lit, tags))).alias("c")).first().c
    assert [tuple(c) for c in got] == want


def test_entity_counts(spark):
    rows = spark.createDataFrame([([-100, 1, 2, 0, -100], [3, 1, 2, 0, 0]), ([-100, 0, 4, -100], [0, 3, 4, 1]), ([-100], [1])], "g array<int>, p array<int>")
    got = {r.type: (r.tp, r.fp, r.fn) for r in labels.entity_counts(rows, F.col("g"), F.col("p"), ["O", "B-T", "I-T", "B-A", "I-A"]).collect()}
    assert got == {"T": (1, 0, 0), "A": (0, 1, 1)}
    assert labels.entity_counts(rows.limit(0), F.col("g"), F.col("p"), ["O"]).count() == 0


# --- plug-ins ---


def odd_tokenizer():
    def cut(texts):
        return [([10, 11, 12], [(0, 1), (1, 1), (1, 2)]) if t == "zero" else ([1, 2], [(0, 1)]) if t == "bad" else ([], []) for t in texts]

    return cut


def test_tokens_of_no_width(spark):
    df = spark.createDataFrame([(1, "zero"), (2, None), (3, ""), (1, "zero")], "id int, text string")
    by_count = adapters.tokenize(df, odd_tokenizer).orderBy("id").collect()
    assert [r.token_ids for r in by_count] == [[10, 11], [10, 11], None, []] and by_count[0].offsets == [(0, 1), (1, 2)]
    assert [r.token_ids for r in adapters.tokenize(df, odd_tokenizer, ids="aligned").orderBy("id").collect()][0] == [10, 12]
    assert adapters.tokenize(df.limit(0), odd_tokenizer).count() == 0


def test_ids_and_offsets_must_agree(spark):
    df = spark.createDataFrame([("bad",)], "text string")
    with pytest.raises(Exception, match="2 ids and 1 offsets"):
        adapters.tokenize(df, odd_tokenizer).collect()


@pytest.mark.parametrize("delimiters", [" ", " ,."])
def test_all_texts_are_cut_at_once_as_one_by_one(delimiters):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("ab ,.\té😀\u3000\x1f\xa0"), int(n))) for n in rng.integers(0, 30, 200)] + ["", " ", "a", "", " a", "a "]
    cut = adapters.delimiter_tokenizer(delimiters)()
    for some in (texts, texts[:1], ["", ""], []):
        for got, want in zip(cut.flat(some), adapters.flattened(cut(some)), strict=True):
            assert got.tolist() == want.tolist()


def test_tokenizers_file(spark):
    import public_tokenizers

    df = spark.createDataFrame([("Ab é",)], "text string")
    got = adapters.tokenize(df, adapters.file_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), most_bytes=1).first()
    assert len(got.token_ids) == len(got.offsets) and got.offsets[0].start == 0 and got.offsets[-1].end == 4


def score_model():
    def model(ids, mask):
        out = np.zeros((*ids.shape, 3))
        out[..., 1] = ids
        out[..., 2] = 2
        return out

    return model


def test_predictions(spark):
    df = spark.createDataFrame([([0, 2, 5],), ([1],), (None,), ([],)], "input_ids array<int>").withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
    got = adapters.predict(df, score_model, most_places=2).collect()
    assert [r.label_ids for r in got] == [[2, 1, 1], [2], None, []]  # the first of equal scores
    e = np.exp(np.array([0, 5, 2.0]))
    assert abs(got[0].confidences[2] - e.max() / e.sum()) < 1e-12


def test_wrong_scores_raise(spark):
    df = spark.createDataFrame([([0, 2],)], "input_ids array<int>").withColumn("attention_mask", F.col("input_ids"))
    with pytest.raises(Exception, match="scores of"):
        adapters.predict(df, lambda: lambda ids, mask: np.zeros((1, 1, 2))).collect()


def test_windows_are_merged_in_place_as_votes_are(spark):
    from spanloom.plans.more import merge_votes

    rng = np.random.default_rng(9)
    names = ["O", "B-TITLE", "I-TITLE", "B-AUTHOR", "I-AUTHOR"]
    data = [(f"s{i}", " ".join("x" * int(k) for k in rng.integers(1, 6, int(n)))) for i, n in enumerate([0, 1, 2, 15, 16, 17, 18, 40, *rng.integers(1, 90, 30)])]
    toks = adapters.tokenize(spark.createDataFrame([*data, ("null", None)], "segment_id string, text string"), adapters.delimiter_tokenizer(" ")).withColumn("n_tok", F.size("offsets"))

    def model():
        return lambda ids, mask: np.eye(5)[(ids * 3 + np.arange(ids.shape[1]) * 5) % 5] * (1 + ids[..., None] * 7 % 4)

    rows = text.with_windows(toks, 16, 8, 4).drop("n_tok")
    whole = {r.segment_id: r.spans for r in adapters.predict_spans(rows, model, names, 14).collect()}
    assert whole["null"] is None and whole["s0"] == []
    few = {r.segment_id: r.spans for r in adapters.predict_spans(rows, model, names, 14, most_places=40).collect()}
    w = rows.select("segment_id", "token_ids", "offsets", F.explode("ws").alias("w"))
    part = F.slice(F.arrays_zip("token_ids", "offsets"), F.col("w.start_tok") + 1, F.least(F.col("w.end_tok") - F.col("w.start_tok"), F.lit(14)))
    w = w.select("segment_id", F.when(F.col("w.side") == "end", F.col("w.slide_index") + 4).otherwise(F.col("w.slide_index")).alias("place"), part.alias("p")).where(F.size("p") > 0)
    ids = F.concat(F.array(F.lit(0)), F.transform("p", lambda x: x["token_ids"]), F.array(F.lit(2)), F.array_repeat(F.lit(1), F.lit(14) - F.size("p")))
    said = adapters.predict(w.withColumn("input_ids", ids).withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1))), model)
    own = F.arrays_zip("p", F.slice("label_ids", F.lit(2), F.size("p")).alias("l"), F.slice("confidences", F.lit(2), F.size("p")).alias("c"))
    votes = said.select("segment_id", "place", F.explode(own).alias("x")).select("segment_id", "place", "x.p.offsets.start", "x.p.offsets.end", F.get(F.array(*map(F.lit, names)), F.col("x.l")).alias("tag"), F.round("x.c", 9).alias("conf"))
    want: dict = {}
    for r in merge_votes(votes).collect():
        want.setdefault(r.segment_id, set()).add((r.span_start, r.span_end, r.label))
    assert len(want) > 20
    for got in (whole, few):
        assert {k: set(map(tuple, x)) for k, x in got.items() if x} == want and all(x is None or x == sorted(x) for x in got.values())


# --- text windows and crops ---


def test_text_windows(spark):
    df = spark.createDataFrame([(1, "a b c d e "), (2, "a b "), (3, "")], "doc_id int, text string")
    rows = adapters.tokenize(df, adapters.delimiter_tokenizer(" ")).drop("token_ids")
    got = {(r.doc_id, r.name): (r.char_start, r.char_end, r.window_text) for r in text.text_windows(rows, 2).collect()}
    assert got == {(1, "begin"): (0, 4, "a b "), (1, "end"): (6, 10, "d e "), (2, "full"): (0, 4, "a b "), (3, "full"): (0, 0, "")}


def test_text_windows_of_a_long_text_are_cut_once(spark):
    # gaps between tokens aren't part of a window's text; no token is cut from the whole text, which is read from its beginning for each cut
    words = [f"w{i % 7}é" for i in range(20_000)]
    long = "  " + "   ".join(words)
    df = spark.createDataFrame([(1, long)], "doc_id int, text string")
    windows = text.text_windows(adapters.tokenize(df, adapters.delimiter_tokenizer(" ")).drop("token_ids"), 64)
    got = {r.name: (r.char_start, r.char_end, r.n_tokens, r.window_text) for r in windows.collect()}
    assert got["begin"] == (2, 2 + 63 * 6 + 4, 64, "".join(w + " " for w in words[:64]))
    assert got["end"] == (len(long) - 63 * 6 - 3, len(long), 64, "".join(w + " " for w in words[-64:])[:-1])
    assert not re.search(r"lambdafunction\(substring\(text#", windows._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.parametrize("span, want", [((0, 3), (0, 0)), ((2, 5), (0, 1)), ((8, 8), (1, 1)), ((10, 11), (1, 1)), ((15, 15), (2, 2)), ((40, 41), (2, 2))])
def test_token_range_falls_back_to_the_nearest(spark, span, want):
    offsets = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 4), (4, 8), (16, 20))])
    got = spark.range(1).select(crops.token_range_of(offsets, F.lit(span[0]), F.lit(span[1])).alias("x")).first().x
    assert tuple(got) == want


def segments(spark, *rows):
    """(segment_id, tokens, spans): tokens of four characters, spans inclusive."""
    data = [("d", s, "abc " * n, [(i * 4, i * 4 + 4) for i in range(n)], [("title", a, b) for a, b in spans]) for s, n, spans in rows]
    return spark.createDataFrame(data, "doc_id string, segment_id string, text string, offsets array<struct<start:int,end:int>>, spans array<struct<label:string,start:bigint,end:bigint>>")


def test_crops_of_each_kind(spark):
    rows = segments(spark, ("short", 8, [(0, 3)]), ("none", 8, []), ("long", 200, [(400, 411)]), ("empty", 200, []), ("wide", 200, [(0, 500)]), ("two", 200, [(40, 43), (700, 703)]))
    made = crops.generate(rows, ["title"], most=32, presets=((50, 100), (10, 140), (0, 0)))
    got = made.collect()
    kinds = {s: [r.kind for r in got if r.segment_id == s] for s in ("short", "none", "long", "empty", "wide")}
    assert kinds == {"short": ["full"], "none": ["full"], "long": ["positive"] * 3, "empty": ["negative"], "wide": ["positive"] * 3}
    for r in got:
        if r.kind != "full":
            assert r.tok_end - r.tok_start == 32 and (r.char_start, r.char_end) == (r.tok_start * 4, r.tok_end * 4)
        if r.segment_id == "long":
            assert r.char_start <= 400 and 411 < r.char_end
    out = {r.id: r for r in crops.training_rows(made, {"title": "T"}).collect()}
    assert out["d:short:title:0"].error is None and out["d:none:title:0"].error == "without its span"
    assert out["d:empty:title:0"].error is None and out["d:wide:title:0"].error == "without its span"
    assert {r.input[400 - r.crop_char_start : 412 - r.crop_char_start] for r in out.values() if r.segment_id == "long"} == {"abc abc abc "}
    assert made.count() == crops.generate(rows.repartition(5), ["title"], most=32, presets=((50, 100), (10, 140), (0, 0))).intersect(made).count()


def test_crop_without_slack_is_nearest_to_its_preset(spark):
    rows = segments(spark, ("s", 200, [(400, 403)]))
    got = crops.generate(rows, ["title"], most=32, per_positive=2, presets=((60, 64), (8, 116)), slack=False).orderBy("crop_index").collect()
    assert [r.char_start for r in got] == [340, 392]


def test_starts_are_spread(spark):
    rows = segments(spark, *[(f"s{i}", 100, []) for i in range(300)])
    starts = [r.tok_start for r in crops.generate(rows, ["title"], most=20).collect()]
    assert min(starts) < 8 and max(starts) > 72 and all(0 <= s <= 80 for s in starts)
