import random

import pytest

from voxtide.llm import splits

ROW = "id long, p string, s string, split string, component string, group_id string"


def brute(rows):
    import re

    canon = lambda x: None if x is None or re.sub(r"[\s_-]", "", x.lower()) in splits.MISSING or not re.search(r"\w", x.replace("_", "")) else re.sub(r"[\s_-]", "", x.lower())
    ids = sorted({r[0] for r in rows if r[0] is not None})
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    seen = {}
    for i, p, s, *_ in rows:
        for k in (("p", canon(p)), ("s", canon(s))):
            if i is not None and k[1] is not None:
                if k in seen:
                    a, b = sorted((top(i), top(seen[k])))
                    up[b] = a
                seen[k] = i
    return {i: top(i) for i in ids}


def groups(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], ROW)
    return splits.groups(df.drop("group_id", "component"), "id", ["p", "s"])


def test_ties_and_stand_ins(spark):
    rows = [(5, "P-1", "S1", "dev"), (3, "p1 ", None, "Held out"), (7, None, "s_1", "held_out"), (7, None, "s_1", "held_out"), (9, "N/A", "?", "dev"), (8, "n/a", "", "dev"), (4, "unknown", None, None), (6, "P2", "S2", "dev"), (2, "P2", "--", "DEV "), (None, "P1", "S1", "x")]
    g = groups(spark, rows)
    assert {r.id: r.group_id for r in g.collect()} == brute(rows) == {5: 3, 3: 3, 7: 3, 9: 9, 8: 8, 4: 4, 6: 2, 2: 2}
    assert {tuple(r) for r in splits.mixed_groups(g, "id", "split").collect()} == {(5, 3), (3, 3), (7, 3)}


def test_empty(spark):
    g = groups(spark, [])
    assert g.count() == 0 and splits.mixed_groups(g, "id", "split").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_random_with_a_giant_group_and_a_long_chain(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "HOT" if rng.random() < 0.3 else f"P{rng.randrange(300)}", f"S{rng.randrange(400)}", rng.choice(["a", "b"])) for i in range(300)]
    rows += [(1000 + i, f"C{(i + 1) // 2}", f"D{i // 2}", "a") for i in range(60)]
    rng.shuffle(rows)
    assert {r.id: r.group_id for r in groups(spark, rows).collect()} == brute(rows)


def test_shares(spark):
    g = spark.range(20_000).withColumnRenamed("id", "group_id")
    n = {r.assigned_split: r["count"] for r in splits.assign_splits(g, {"train": 0.8, "val": 0.1, "test": 0.1}).groupBy("assigned_split").count().collect()}
    assert abs(n["train"] / 20_000 - 0.8) < 0.01 and abs(n["val"] / 20_000 - 0.1) < 0.01
    # A new split only takes groups, it moves none between the others.
    a = splits.assign_splits(g, {"train": 0.8, "val": 0.1}).withColumnRenamed("assigned_split", "a").join(splits.assign_splits(g, {"train": 0.8, "val": 0.1, "test": 0.1}), "group_id")
    assert a.where("a <> assigned_split and assigned_split <> 'test'").count() == 0
    with pytest.raises(ValueError):
        splits.assign_splits(g, {"x": 0.0})


def test_report_and_a_list_of_stand_ins(spark):
    rows = [(1, "Nil", "S1", "a"), (2, "nil", "S2", "a"), (3, "none", "S3", "a"), (4, "none", "S4", "a")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], ROW).drop("group_id", "component")
    ids = lambda g: {r.id: r.group_id for r in g.collect()}
    assert ids(splits.groups(df, "id", ["p", "s"])) == {1: 1, 2: 2, 3: 3, 4: 4} and ids(splits.groups(df, "id", ["p", "s"], missing=["none"])) == {1: 1, 2: 1, 3: 3, 4: 4}
    g = spark.range(100).selectExpr("id", "if(id < 40, 0, id) as group_id")
    r = {x.split: x for x in splits.split_report(splits.assign_splits(g, {"a": 0.9, "b": 0.1, "c": 0.0}), {"a": 0.9, "b": 0.1, "c": 0.0}).collect()}
    assert r["a"].records + r["b"].records == 100 and r["a"].groups + r["b"].groups == 61 and max(r["a"].largest_group, r["b"].largest_group) == 40 and (r["c"].records, r["c"].actual_share) == (0, 0.0)
