import itertools
import os
import random

import numpy as np
import pytest

from voxtide.llm import mixing, packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


def test_hilbert_is_a_path():
    side = 8
    cells = np.array(list(itertools.product(range(side), repeat=3)))
    key = packing.hilbert_key(cells, bits=3)
    assert sorted(key) == list(range(side**3))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()  # each step goes to a neighbour


def texts(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["water", "stone", "mây", "trời", "table", "line"]) for _ in range(rng.choice([5, 30, 100, 300, 900]))), "x") for i in range(n)]


def check(got, sizes, specs):
    for name, cap in specs.items():
        rows = [r for r in got if r.spec_name == name]
        room = {}
        for r in rows:
            room[r.container_id] = room.get(r.container_id, 0) + r.n_tokens
        assert max(room.values(), default=0) <= cap
        for k, n in sizes.items():
            parts = sorted((r.part_no, r.first_token, r.n_tokens) for r in rows if r.k == k)
            assert sum(p[2] for p in parts) == n and [p[0] for p in parts] == list(range(1, max(1, -(-n // cap)) + 1))
            assert all(f == (i - 1) * cap for i, f, _ in parts) and (len(parts) == 1 or all(m == cap for _, _, m in parts[:-1]))
        if sum(sizes.values()) > 50 * cap:
            assert sum(room.values()) / (len(room) * cap) > 0.95


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE", 1000)  # items, of which these documents are some 1,500
    rows = texts(300) + [(1000, None, "x"), (1001, "", "x"), (1002, "stone " * 5000, "x"), (5, texts(6)[5][1], "x"), (None, "a", "x")]
    enc = tokens.encoding()
    sizes = {k: len(enc.encode_ordinary(t)) if t else 0 for k, t, _ in rows if k is not None}
    specs = {"s": 128, "m": 512}
    got = packing.pack(spark.createDataFrame(rows, "k long, t string, place string"), "k", "t", specs).collect()
    assert len({(r.spec_name, r.k, r.part_no) for r in got}) == len(got)
    check(got, sizes, specs)


def test_neighbours_share_containers(spark, monkeypatch):
    """Documents of one vocabulary lie together far more often than by chance, which the curve does: without it they don't."""
    rng = random.Random(5)
    vocab = [[f"{a}{b}" for a in letters for b in letters] for letters in ("abc", "def", "ghi", "klm", "nop", "rst", "uvw", "xyz")]
    rows = [(i, " ".join(rng.choice(vocab[i % 8]) for _ in range(rng.randrange(20, 60)))) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, t string")

    def together():
        by = {}
        for r in packing.pack(df, "k", "t", {"s": 400}).collect():
            by.setdefault(r.container_id, []).append(r.k % 8)
        return sum(a == b for ks in by.values() for a, b in itertools.combinations(ks, 2)) / sum(len(ks) * (len(ks) - 1) // 2 for ks in by.values())

    assert together() > 0.35
    monkeypatch.setattr(packing, "on_curve", lambda d: d.selectExpr("k", "n_tokens", "xxhash64(k) as place"))
    assert together() < 0.16


def test_ranges_count_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE", 100)
    df = spark.createDataFrame([(i, "stone " * 3000) for i in range(4)], "k long, t string")
    out = packing.pack(df, "k", "t", {"s": 10})
    assert out.rdd.getNumPartitions() >= 8 and out.count() > 1000


def test_pack_empty_and_bad_specs(spark):
    assert packing.pack(spark.createDataFrame([], "k long, t string"), "k", "t", {"s": 10}).count() == 0
    with pytest.raises(ValueError):
        packing.read_specs(spark.createDataFrame([("a", 0)], "spec_name string, capacity_tokens int"))


def test_packer_closes_the_fullest():
    p = packing.Packer(10)
    assert p.pack([6, 4, 7, 3, 10, 1]) == [2, 2, 1, 1, 0, 3] and p.open == [(9, 3)]


T = mixing.Target


def test_rates():
    r = mixing.rates({"a": 1000, "b": 100, "c": 0}, [T("a", 0.5, 1), T("b", 0.3, 4), T("c", 0.2, 2)])
    assert r["b"] == 4 and abs(r["a"] * 1000 / (r["b"] * 100) - 0.5 / 0.3) < 1e-9 and "c" not in r and r["a"] <= 1
    assert mixing.rates({}, [T("a", 1, 1)]) == {} and mixing.rates({"a": 5}, [T("a", 1, float("inf"))]) == {"a": 1.0}


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["big"] * 8 + ["small", "other"]), "stone water " * rng.randrange(5, 30), 0) for i in range(3000)] + [(-1, None, "x", 0), (-2, "big", None, 0), (None, "big", "x", 0), (7, *(r for r in [("big", "dup", 0)][0]))]
    df = spark.createDataFrame(rows, "k long, src string, t string, copies int")
    chosen, report = mixing.mix(df, "k", "src", "t", [T("big", 0.7, 1), T("small", 0.3, 3), T("none", 0.1, 2)])
    r = {x.source: x for x in report.collect()}
    assert r["small"].rate == 3.0 and abs(r["small"].actual_share - 0.3) < 0.02 and abs(r["big"].actual_share - 0.7) < 0.02 and r["none"].selected_tokens == 0 and r["none"].actual_share == 0
    c = chosen.collect()
    per = {}
    for x in c:
        per.setdefault(x.k, []).append(x.copy_no)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per.values()) and {x.src for x in c} == {"big", "small"} and max(map(len, per.values())) == 3
    assert sorted(map(str, c)) == sorted(map(str, mixing.mix(df, "k", "src", "t", [T("big", 0.7, 1), T("small", 0.3, 3), T("none", 0.1, 2)])[0].collect()))
    none, rep = mixing.mix(df.where("false"), "k", "src", "t", [T("big", 1.0, 1)])
    assert none.count() == 0 and rep.first().actual_share is None
