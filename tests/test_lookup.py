from voxtide.operators.lookup import lookup


def test_hot_and_null_keys(spark):
    big = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(100)] + [(None, 1), ("none", 2)], "k string, i int")
    small = spark.createDataFrame([("hot", "H")] + [(f"k{i}", f"v{i}") for i in range(100)] + [(None, "null")], "k string, v string")
    for hot_keys in (4, 256):
        got = {(r.k, r.i, r.v) for r in lookup(big, small.where("k is not null"), "k", hot_keys).collect()}
        assert len(got) == 402 and ("hot", 7, "H") in got and ("k3", 3, "v3") in got and (None, 1, None) in got and ("none", 2, None) in got
    assert lookup(big.where("false"), small, "k").count() == 0
