import random

import pytest

from voxtide.llm import nearest

R, I = "id long, rec string, at long, turn string", "id long, rec string, a long, b long, slice string"


def brute(recs, ivs, tol):
    out = {}
    for i, r, t in set(recs):
        if t is None:
            continue
        best = min(((max(a - t, t - b, 0), abs(a - t), j) for j, r2, a, b in ivs if r2 == r and r is not None and a is not None and b is not None and b > a), default=None)
        out[i] = best[2] if best and best[0] <= tol else None
    return out


def run(spark, recs, ivs, tol, **kw):
    r = spark.createDataFrame([(*r, "x") for r in recs], R)
    v = spark.createDataFrame([(*v, "x") for v in ivs], I).withColumnRenamed("id", "turn")
    got = nearest.nearest_interval(r, v, entity="rec", record_id="id", time="at", interval_id="turn", start="a", end="b", tolerance=tol, **kw)
    rows = got.collect()
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1] for r in rows}


def test_cases(spark):
    recs = [(1, "r", 100), (1, "r", 100), (2, "r", 1000), (3, "r", None), (4, None, 100), (5, "q", 5), (6, "r", 650), (7, "r", 300)]
    ivs = [(1, "r", 0, 200), (2, "r", 50, 150), (3, "r", 50, 120), (4, "r", 300, 300), (5, "r", 400, 300), (6, "r", 800, 900), (7, None, 0, 500), (8, "r", None, 5), (9, "r", 400, 500), (9, "r", 400, 500)]
    got = run(spark, recs, ivs, 150)
    assert got == brute(recs, ivs, 150) and got[1] == 2 and got[4] is None and got[5] is None and 3 not in got
    assert run(spark, recs, ivs, 150, matched_only=True) == {k: v for k, v in got.items() if v is not None}


def test_empty(spark):
    assert run(spark, [], [], 5) == {} and run(spark, [(1, "r", 5)], [], 5) == {1: None} and run(spark, [], [(1, "r", 0, 5)], 5) == {}


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(nearest, "SLICE", 100)  # many slices, and intervals over more of them than WIDE
    monkeypatch.setattr(nearest, "WIDE", 4)
    span = rng.choice([300, 3000])
    recs = [(i, rng.choice(["hot", "hot", "b"]), rng.randrange(-50, span)) for i in range(300)]
    ivs = [(i, rng.choice(["hot", "hot", "b"]), s := rng.randrange(-50, span), s + rng.choice([0, 1, 2, 5, 40, 90, 2000])) for i in rng.sample(range(10_000), 120)]
    tol = rng.choice([0, 3, 30])
    assert run(spark, recs, ivs, tol) == brute(recs, ivs, tol)


def test_wide_interval_meets_only_slices_with_records(spark):
    assert run(spark, [(1, "r", 5), (2, "r", 10**13)], [(1, "r", 0, 2 * 10**13)], 5) == {1: 1, 2: 1}
