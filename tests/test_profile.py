import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtide.operators import profile as p
from voxtide.plans import core_queries

RULES = [("t", "txt", "^[a-c]$", None, None), ("t", "num", None, 0.0, 10.0), ("t", "cnt", None, 0.0, float("nan")), ("u", "txt", "^x$", None, None)]


def tables(spark, rows, runs):
    df = spark.createDataFrame(rows, "load_id long, txt string, num double, cnt long, n long, s string")
    rules = spark.createDataFrame(RULES, "table_name string, column_name string, value_pattern string, min_value double, max_value double")
    return df, rules, spark.createDataFrame(runs, "load_id long, stream_name string, seq int")


def test_findings(spark):
    rows = [(1, "a", float(i % 5), i, 0, "") for i in range(20)] + [(2, "b", 50.0 + i, None, 0, "") for i in range(20)] + [(2, "A\n", float("nan"), None, 0, "")] + [(None, "z", 99.0, 1, 0, "")]
    df, rules, runs = tables(spark, rows, [(1, "s", 0), (2, "s", 1), (2, "s", 1), (3, "s", 2), (1, None, None)])
    got = {tuple(r) for r in p.findings(p.profile({"t": df}, "load_id", rules, runs)).collect()}
    have = {(load, c, f) for _, load, c, f in got}
    assert {(2, "txt", "pattern"), (2, "num", "range"), (2, "cnt", "null_rate"), (2, "num", "centre"), (2, "num", "spread"), (2, "txt", "mix"), (2, "num", "distinct"), (2, "cnt", "distinct")} <= have
    assert not [x for x in have if x[0] not in (1, 2)] and not [x for x in have if x[0] == 1]
    assert (2, "txt", "mix") not in {(load, c, f) for _, load, c, f in map(tuple, p.findings(p.profile({"t": df}, "load_id", rules, runs), ["txt"]).collect())}


def test_null_rate_of_exactly_a_tenth_is_none(spark):
    rows = [(1, "a", 1.0, 1, 0, "")] * 10 + [(2, "a", 1.0, 1, 0, "")] * 9 + [(2, None, 1.0, 1, 0, "")]
    df, rules, runs = tables(spark, rows, [(1, "s", 0), (2, "s", 1)])
    assert p.findings(p.profile({"t": df}, "load_id", rules, runs)).count() == 0


def test_empty_table_and_all_null(spark):
    df, rules, runs = tables(spark, [], [(1, "s", 0)])
    assert p.profile({"t": df}, "load_id", rules, runs).count() == 0
    df, rules, runs = tables(spark, [(1, None, None, None, None, None)] * 3, [(1, "s", 0)])
    r = {x.column_name: x for x in p.profile({"t": df}, "load_id", rules, runs).collect()}
    assert r["num"].n_null == 3 and r["num"].q1 is None and r["txt"].n_distinct == 0


@pytest.mark.parametrize("seed", range(3))
def test_quartiles_are_exact(spark, seed):
    rng = random.Random(seed)
    groups = {i: [rng.choice([rng.gauss(0, 1), rng.randrange(-3, 3), 0.0, -0.0, 1e300, -1e-300, 5.0, rng.gauss(1e6, 1)]) for _ in range(rng.choice([1, 2, 3, 50, 301]))] for i in range(6)}
    df = spark.createDataFrame([(i, None, float(x), 1, 0, "") for i, xs in groups.items() for x in xs], "load_id long, txt string, num double, cnt long, n long, s string")
    counts = p.value_counts(df, "t", "load_id", [p.Rule("t", "num")])
    got = {r.load_id: (r.q1, r.q2, r.q3) for r in p.quartiles(counts).collect()}
    for i, xs in groups.items():
        assert np.allclose(got[i], np.percentile(xs, [25, 50, 75]), rtol=1e-12, atol=1e-12)


def test_quartiles_of_values_close_together(spark, monkeypatch):
    """One per cent of a value, one bucket: it is cut until no part holds many values; other loads stay as they are."""
    monkeypatch.setattr(p, "BUCKET_VALUES", 20)
    monkeypatch.setattr(p, "CUTS", 7)
    rng = random.Random(6)
    groups = {1: [1.7e12 + rng.randrange(10**7) for _ in range(700)], 2: [1.0 + rng.random() / 100 for _ in range(301)], 3: [5.0] * 40, 4: [-rng.random() for _ in range(90)], 5: [float("inf"), 1.0, 2.0, -float("inf")]}
    df = spark.createDataFrame([(i, x) for i, xs in groups.items() for x in xs], "load_id long, num double")
    got = {r.load_id: (r.q1, r.q2, r.q3) for r in p.quartiles(p.value_counts(df, "t", "load_id", [p.Rule("t", "num")])).collect()}
    assert set(got) == set(groups)
    for i in (1, 2, 3, 4):
        assert np.allclose(got[i], np.percentile(groups[i], [25, 50, 75]), rtol=1e-12, atol=1e-12)
    assert got[5][1] == 1.5


def test_drift_against_brute_force(spark):
    rng = random.Random(1)
    a, b = [rng.choice("aab") for _ in range(50)], [rng.choice("abbc") for _ in range(80)]
    df, rules, runs = tables(spark, [(1, x, 1.0, 1, 0, "") for x in a] + [(2, x, 1.0, 1, 0, "") for x in b], [(1, "s", 0), (2, "s", 1)])
    r = p.profile({"t": df}, "load_id", rules, runs).where("load_id = 2 and column_name = 'txt'").first()
    pa, pb = ({k: xs.count(k) / len(xs) for k in "abc"} for xs in (a, b))
    assert math.isclose(r.tv, sum(abs(pa[k] - pb[k]) for k in "abc") / 2)
    fl = lambda x: max(x, 1e-4)
    assert math.isclose(r.psi, sum((fl(pb[k]) - fl(pa[k])) * math.log(fl(pb[k]) / fl(pa[k])) for k in "abc"))
    k = math.sqrt(len(a) / len(b))
    assert math.isclose(r.chi2, sum((k * b.count(x) - a.count(x) / k) ** 2 / (a.count(x) + b.count(x)) for x in "abc"))


def test_repeated_rows_count_and_extra_names(spark):
    df, rules, runs = tables(spark, [(1, "a", 1.0, 1, 0, "")] * 4, [(1, "s", 0)])
    df = df.withColumn("column_name", F.lit("clash")).withColumn("table_name", F.lit("clash"))
    assert {r.n_rows for r in p.profile({"t": df}, "load_id", rules, runs).collect()} == {4}


DATA = os.environ.get("VOXTIDE_TESTDATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_every_column_of_the_tables_against_sql(spark):
    import duckdb

    got = {(r.table_name, r.load_id, r.column_name): r for r in core_queries.p2_profile(spark, DATA).collect()}
    before = {r.load_id: r.prev_id for r in p.previous_loads(spark.read.parquet(f"{DATA}/load_run.parquet")).collect()}
    want = {}
    for t in core_queries.PROFILED:
        rel = duckdb.sql(f"select * from '{DATA}/{t}.parquet'")
        for c, kind in zip(rel.columns, rel.types):
            if c != "load_id":
                v, no = (c, "NULL") if kind == "VARCHAR" else (f"CASE WHEN {c}::VARCHAR <> 'nan' THEN {c}::DOUBLE END", "NULL")
                text, num = ("v", no) if kind == "VARCHAR" else (no, "v")
                for load, *x in duckdb.sql(f"SELECT load_id, count(*), count(*) - count(v), count(DISTINCT v), min({num}), max({num}), min({text}), max({text}) FROM (SELECT load_id, {v} AS v FROM rel WHERE load_id IS NOT NULL) GROUP BY 1").fetchall():
                    want[t, load, c] = tuple(x)
    names = ["n_rows", "n_null", "n_distinct", "min_value", "max_value", "min_text", "max_text"]
    assert {k: tuple(r[n] for n in names) for k, r in got.items()} == want
    assert {("feature_recording", "row_id"), ("feature_recording", "recording_id"), ("feature_issue", "message"), ("feature_issue", "issue_id")} <= {(t, c) for t, _, c in want}
    for (t, load, c), r in got.items():
        assert tuple(r[f"prev_{n}"] for n in names) == want.get((t, before.get(load), c), (None,) * len(names))
        assert c not in {"row_id", "message", "issue_id"} or r.n_pattern == r.n_range == 0
    drift = {(r.table_name, r.column_name) for r in core_queries.p2_drift(spark, DATA).collect()}
    assert drift == {(t, c) for t, _, c in want}
