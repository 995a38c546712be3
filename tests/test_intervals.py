import random

import pytest

from voxtide.operators import intervals
from voxtide.operators.intervals import periods_and_gaps

SCHEMA = "k string, s long, e long, kind string, island string"


def brute(rows, max_gap=None):
    out = set()
    by = {}
    for k, s, e, *_ in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    for k, iv in by.items():
        merged = []
        for s, e in sorted(iv):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if max_gap is None or b[0] - a[1] <= max_gap}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = periods_and_gaps(df, ["k"], "s", "e", **kw).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_cases(spark):
    rows = [("a", 0, 10), ("a", 10, 20), ("a", 12, 15), ("a", 30, 40), ("a", 30, 40), ("a", 50, 50), ("a", 70, 60), ("a", None, 5), ("a", 5, None), (None, 1, 2), (None, 4, 6), ("b", 100, 101)]
    assert run(spark, rows) == brute(rows)
    assert ("a", "gap", 20, 30) in run(spark, rows) and (None, "gap", 2, 4) in run(spark, rows)
    assert run(spark, rows, max_gap=9) == brute(rows, 9)


def test_empty(spark):
    assert run(spark, []) == set()


@pytest.mark.parametrize("seed", range(3))
def test_random_across_buckets(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), s := rng.randrange(0, 3000), s + rng.choice([0, 1, 3, 20, 900])) for _ in range(400)]
    assert run(spark, rows, bucket_width=50) == brute(rows)


def test_random_across_buckets_of_ranks(spark, monkeypatch):
    monkeypatch.setattr(intervals, "RANKS", 7)
    rng = random.Random(9)
    rows = [("hot", s := rng.randrange(0, 30_000), s + rng.choice([1, 20, 90])) for _ in range(300)]
    assert run(spark, rows, bucket_width=1000) == brute(rows)


def test_negative_and_long(spark):
    rows = [("a", -500, -400), ("a", -450, 10**12), ("a", 10**12 + 5, 10**12 + 6)]
    assert run(spark, rows) == brute(rows)
