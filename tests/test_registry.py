"""Every registered query of the library against its SQL."""

import math

import pandas as pd
import pytest
from conftest import DATA

from spanloom.plans import registry


def canon(df):
    def value(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(x, 6) if isinstance(x, float) else x if isinstance(x, (bool, str)) else float(x)

    return sorted((tuple(value(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_oracle(spark, oracle, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = oracle.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def on_texts(spark, tmp_path, name, texts):
    """What the query and its SQL give on documents of these texts by id."""
    import duckdb

    rows = [(k, t, "en", f"s{k}", len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(tmp_path)).toPandas()
    return canon(got), canon(con.sql(registry.oracle_sql()[name]).df()[list(got.columns)])


def test_exact_match_counts_a_repeated_prediction_twice(spark, tmp_path):
    # of document 63 the title at 0 to 6 is moved to 5 to 9, where every seventh document has one more
    got, want = on_texts(spark, tmp_path, "exact_match", {63: "a b c d e f g", 1: "one two three four"})
    assert got == want and (2.0, 3.0, "63:0", 0.0) in got


@pytest.mark.parametrize("name", ["side_by_side", "leaderboard"])
def test_two_runs_are_scored_without_a_shuffle_of_tokens(spark, monkeypatch, name):
    from spanloom.sources import metric_files

    plans = []
    write = metric_files.write_runs
    monkeypatch.setattr(metric_files, "write_runs", lambda runs, path: (plans.append(runs._jdf.queryExecution().optimizedPlan().toString()), write(runs, path)))
    assert registry.queries()[name](spark, DATA).count() > 0
    assert len(plans) == 1 and plans[0].count("Relation [") == 1 and "Join" not in plans[0] and "Window" not in plans[0]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8
