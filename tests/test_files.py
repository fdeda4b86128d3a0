"""Files by line, nested documents, metric files, paired outputs, and the stream's sink."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.sources import lines, metric_files, paired, payloads, tables
from spanloom.sources.shared import exists, shared_dir
from spanloom.streaming import score


def rows_of(df):
    return sorted(map(tuple, df.collect()))


# --- lines ---


def test_lines_by_number_over_files_and_splits(spark, tmp_path):
    texts = {"a.txt": "one\n\ntwo\n" + "x" * 50 + "\n", "b.txt": "", "c.txt": "\n \nlast\r\nend"}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7")  # many splits a file
    try:
        got = rows_of(lines.numbered_lines(spark, str(tmp_path)))
        kept = rows_of(lines.numbered_lines(spark, str(tmp_path), skip_blank=True))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = ["one", "", "two", "x" * 50, "", " ", "last", "end"]
    assert got == list(enumerate(want))
    assert kept == list(enumerate(w for w in want if w.strip()))


def test_zip_counts_blank_data_lines_but_not_blank_meta_lines(spark, tmp_path):
    (tmp_path / "d").mkdir(), (tmp_path / "m").mkdir()
    line = lambda k: json.dumps({"input": f"in{k}", "output": {"spans": []}})
    (tmp_path / "d/x.jsonl").write_text(line(0) + "\n\n" + line(2) + "\n" + line(3) + "\n")
    meta = [{"id": "doc1:seg1:title:0", "doc_id": "doc1", "segment_id": "seg1"}, {"id": "second"}, {"id": ""}]
    (tmp_path / "m/x.jsonl").write_text("\n" + "\n \n".join(map(json.dumps, meta)) + "\n")
    got = lines.zip_rows(spark, str(tmp_path / "d"), str(tmp_path / "m"), instruction="I").orderBy("line_idx").collect()
    assert [(r.row_id, r.line_idx, r.doc_id, r.segment_id, r.instruction, r.input) for r in got] == [("doc1:seg1:title:0", 0, "doc1", "seg1", "I", "in0"), ("line_2", 2, "", "", "I", "in2"), ("line_3", 3, "", "", "I", "in3")]
    assert json.loads(got[0].output) == {"spans": []}
    assert [r.row_id for r in lines.zip_rows(spark, str(tmp_path / "d")).orderBy("line_idx").collect()] == ["line_0", "line_2", "line_3"]
    (tmp_path / "d/x.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="MALFORMED"):
        lines.zip_rows(spark, str(tmp_path / "d")).collect()


# --- nested documents ---


def test_segment_records(spark):
    docs = spark.createDataFrame([("d", "f", "0123456789abcdef")], "doc_id string, filename string, content string")
    s = [
        ("d", "s1", 0, "TEXT", 0, 8, None, "t", 1, 4, "who", 4, None),  # text from the slice; the author lacks an end
        ("d", "s2", None, "TEXT", 8, 16, "   defgh", "said", 8, 11, None, 12, 14),  # a blank cut falls back to the field
        ("d", "s3", 2, "TEXT", 2, 4, "", None, None, None, None, None, None),  # no annotation: left out
        ("d", "s4", 3, "TEXT", 4, 6, "", None, 2, 30, None, None, None),  # bounds outside are clamped in the text
    ]
    names = "doc_id string, segment_id string, segment_index int, segment_label string, span_start long, span_end long, text string, title string, title_start long, title_end long, author string, author_start long, author_end long"
    p = payloads.payloads(docs, spark.createDataFrame(s, names)).first()
    assert [x.segment_id for x in p.segments] == ["s1", "s4", "s2"] and [x.text for x in p.segments] == ["01234567", "45", "   defgh"]
    assert [(a.label, a.span_start, a.span_end, a.text, a.segment_id) for a in p.annotations] == [("title", 1, 4, "123", "s1"), ("title", 2, 30, "45", "s4"), ("title", 8, 11, "said", "s2"), ("author", 12, 14, "ef", "s2")]
    assert [(a.span_start, a.span_end) for a in p.segments[1].annotations] == [(-2, 26)]


def test_index_of_written_documents(spark, tmp_path):
    docs = spark.createDataFrame([("a", "fa", "x y"), ("b", None, "é\nz"), ("c", "fc", ""), ("n", "fn", None)], "doc_id string, filename string, content string")
    names = "doc_id string, segment_id string, segment_index int, segment_label string, span_start long, span_end long, text string, title string, title_start long, title_end long, author string, author_start long, author_end long"
    s = spark.createDataFrame([("a", "a0", 0, "TEXT", 0, 3, None, None, 0, 1, None, None, None)], names)
    payloads.write(payloads.payloads(docs, s), str(tmp_path / "p"))
    got = {r.doc_id: r for r in payloads.index(payloads.read(spark, str(tmp_path / "p"))).collect()}
    assert {k: (r.filename, r.content_length, r.segment_count, r.annotation_count, r.has_title, r.has_author) for k, r in got.items()} == {"a": ("fa", 3, 1, 1, True, False), "b": ("b", 3, 0, 0, False, False)}


def test_a_folder_of_files(spark, tmp_path):
    for folder in ("texts", "annotations/old"):
        (tmp_path / folder).mkdir(parents=True)
    note = {"doc_id": "a", "filename": "fa", "segments": [{"segment_id": "s", "text": "x", "annotations": []}], "annotations": [{"label": "author", "span_start": 0, "span_end": 1}]}
    files = {"texts/a.txt": "some\ntext", "annotations/a.json": json.dumps(note, indent=2), "annotations/old/a.json": "{}", "texts/b.txt": "t", "annotations/b.json": "{broken", "texts/c.txt": "", "annotations/c.json": "{}", "texts/d.txt": "no notes", "annotations/e.json": "{}"}
    for name, t in files.items():
        (tmp_path / name).write_text(t)
    got = payloads.read_files(spark, str(tmp_path))
    assert rows_of(got.select("doc_id", "broken")) == [("a", False), ("b", True)]
    assert [(r.doc_id, r.filename, r.content_length, r.segment_count, r.has_title, r.has_author) for r in payloads.index(got).collect()] == [("a", "fa", 9, 1, False, True)]
    assert rows_of(payloads.completed(got)) == [("a",)]


# --- metric files ---


def test_metric_files_of_many_shapes(spark, tmp_path):
    block = {"precision": 0.5, "recall": 0.25, "f1": 1 / 3, "tp": 1, "fp": 1, "fn": 3}
    files = {
        "benchmark_one_metrics.json": "﻿" + json.dumps({"run_id": "r1", "model_kind": "one", "row_metrics": {"rows_evaluated": 4, "parse_fail_rate": 0.125, "exact_title": block, "text_equal_title": {}, "timing": {"mean_ms_per_row": 12.5}, "offset": {"tolerances": {"10": {"row_hit_rate_start": 0.5}, "50": {"row_hit_rate_both": 1.0}}}}}),
        "benchmark_two_metrics.json": json.dumps({"rows_evaluated": 2, "exact_title": {**block, "f1": 0.5}, "other": [1, 2]}, indent=1),
        "benchmark_bad_metrics.json": "{oops",
        "benchmark_none_metrics.json": json.dumps({"row_metrics": {"exact_title": {"f1": None}}}),
        "elsewhere.json": "{}",
    }
    for name, t in files.items():
        (tmp_path / name).write_text(t, encoding="utf-8")
    m = metric_files.metric_files(spark, str(tmp_path / "benchmark_*_metrics.json"))
    assert rows_of(m.select("run_id", "model", "broken")) == [("benchmark_bad_metrics", "bad", True), ("benchmark_none_metrics", "none", False), ("benchmark_two_metrics", "two", False), ("r1", "one", False)]
    board = metric_files.leaderboard(m, ["exact_title", "text_equal_title"], ["two", "one"]).orderBy("place").collect()
    assert [(r.place, r.model, r.rows, r.exact_title, r.text_equal_title, r.parse_fail, r.mean_ms) for r in board] == [(1, "two", 2, "50.00%", "n/a", "n/a", "n/a"), (2, "one", 4, "33.33%", "n/a", "12.50%", "12.5"), (3, "none", None, "n/a", "n/a", "n/a", "n/a")]
    assert rows_of(metric_files.side_by_side(m, "two", "one", ["exact_title", "gone"])) == [("exact_title", "50.00%", "33.33%", "+16.67 pp"), ("gone", "n/a", "n/a", "n/a")]
    assert rows_of(metric_files.offset_table(m)) == [("one", 10, "50.00%", "n/a", "n/a", "n/a"), ("one", 50, "n/a", "n/a", "100.00%", "n/a")]
    said = [r.line for r in metric_files.markdown(metric_files.leaderboard(m, ["exact_title"], ["two"]), ["model", "exact_title"]).orderBy("place").collect()]
    assert said[:3] == ["| model | exact_title |", "|---|---|", "| two | 50.00% |"]


# --- paired outputs ---


@pytest.mark.parametrize("per_file", [3, 1000])
def test_pairs_correspond_by_number(spark, tmp_path, per_file):
    data = [(f"id{i}", t, s, "say", f"in\n{i}", f"out{i}", None) for i in range(40) for t in ("title", "author") for s in ("train", "val") if i % 4 or s == "train"]
    rows = spark.createDataFrame(data, "id string, task string, split string, instruction string, input string, output string, note string").repartition(7)
    path = str(tmp_path / "out")
    paired.write_pairs(rows, path, ["instruction", "input", "output"], ["id"], per_file=per_file)
    assert paired.registry(spark, path)["title_val"] == {"file_name": "data/task=title/split=val", "columns": {"prompt": "instruction", "query": "input", "response": "output"}}
    for task in ("title", "author"):
        for split, n in (("train", 40), ("val", 30)):
            got = paired.read_pairs(spark, path, task, split).orderBy("line_idx").collect()
            assert [r.line_idx for r in got] == list(range(n))
            for r in got:
                meta = json.loads(r.meta)
                assert (meta["input"], meta["task"], meta["split"]) == (r.input, task, split) and r.row_id == meta["id"] and r.input == f"in\n{r.row_id[2:]}"


def test_pairs_leave_their_files_alone_on_disk(spark, tmp_path, monkeypatch):
    """Written in several passes and read again, compressed; no table or copy of lines stays beside them."""
    monkeypatch.setattr("spanloom.sources.shared.shared_dir", lambda _: f"file://{tmp_path}/shared")
    rows = spark.range(500).select(F.concat(F.lit("id"), "id").alias("id"), F.lit("title").alias("task"), F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"), F.lit("say").alias("instruction"), F.repeat(F.col("id").cast("string"), F.lit(50)).alias("input"), F.lit("o").alias("output"))
    path = str(tmp_path / "out")
    paired.write_pairs(rows, path, ["instruction", "input", "output"], ["id"], per_file=7, at_once=150)
    want = {s: [r.id for r in rows.where(F.col("split") == s).orderBy(F.md5(F.to_json(F.struct("id")))).collect()] for s in ("train", "val")}
    for split, ids in want.items():
        got = paired.read_pairs(spark, path, "title", split).orderBy("line_idx").collect()
        assert [r.row_id for r in got] == ids and [r.line_idx for r in got] == list(range(len(ids)))
        assert all(r.input == r.row_id[2:] * 50 for r in got)
    size = lambda p, suffix="": sum(f.stat().st_size for f in p.rglob(f"*{suffix}") if f.is_file() and not f.name.endswith(".crc"))
    assert size(tmp_path / "shared") < 20_000 and 0 < size(tmp_path / "out", ".gz") < 500 * 300 and not list((tmp_path / "out").rglob("*.txt"))[3:]


# --- the stream's sink ---


def test_killed_batch_leaves_no_repeat(spark, tmp_path):
    sink = str(tmp_path / "sink")
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "x"), (None, "y")], "row_id long, t string")
    seen = []

    def scorer(df):
        seen.append(df.count())
        return df.withColumn("n", F.length("t"))

    write = lambda df, number: score.write_batch(df, number, "r", scorer, sink, "row_id", 4)
    write(batch, 0)
    write(batch, 0)  # the batch was killed after its write and runs again
    assert rows_of(score.scored(spark, sink).select(F.coalesce("row_id", F.lit(-1)), "t")) == [(-1, "x"), (-1, "y"), (1, "a"), (2, "b")]
    write(spark.createDataFrame([(2, "b"), (3, "c"), (None, "z")], "row_id long, t string"), 1)
    assert rows_of(score.scored(spark, sink).select(F.coalesce("row_id", F.lit(-1)), "t")) == [(-1, "x"), (-1, "y"), (-1, "z"), (1, "a"), (2, "b"), (3, "c")]
    assert seen == [4, 4, 2]


def test_stream_scores_each_row_once(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "row_id long, t string").write.parquet(src)
    run = lambda c=ck: score.score_new_rows(spark, src, "row_id long, t string", lambda d: d.withColumn("n", F.length("t")), sink, c).awaitTermination()
    run()
    spark.createDataFrame([(2, "b"), (3, "c"), (None, "m")], "row_id long, t string").write.mode("append").parquet(src)
    run()
    got = rows_of(score.scored(spark, sink).select(F.coalesce("row_id", F.lit(-1))))
    assert got == [(-1,), (-1,), (1,), (2,), (3,)]
    run(str(tmp_path / "new"))  # another run reads all again: rows with keys are known, the others come once more
    assert score.scored(spark, sink).where("row_id is not null").count() == 3


# --- tables ---


def test_append_is_null_safe(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, None), (None, 2)], "a long, b long")
    for _ in range(2):
        tables.append(rows, path, ["a", "b"])
    assert spark.read.parquet(path).count() == 2 and exists(spark, path)


def test_json_lines_keep_broken_ones(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"doc_id": "a", "segment_count": 3}\n{oops\n')
    got = tables.json_lines(spark, str(tmp_path), tables.INDEX).select("doc_id", "segment_count", "_corrupt_record").collect()
    assert [tuple(r) for r in got] == [("a", 3, None), (None, None, "{oops")]


def test_shards(spark, tmp_path):
    tables.shards(spark.range(0, 160, 1, 1), str(tmp_path / "s"), per_file=75)
    assert sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "s")).groupBy(F.input_file_name()).count().collect()) == [10, 75, 75]


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://elsewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
