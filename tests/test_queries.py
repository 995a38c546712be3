"""Every core query against its SQL on the smallest test data, where that is there."""

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import pytest

from voxtide.plans import registry

DATA = os.environ.get("VOXTIDE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    v = float(v) if isinstance(v, Decimal) else v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v if isinstance(v, int) else str(v)


def same(spark, duck, f, sql):
    df = f(spark, DATA)
    cols = sorted(df.columns)
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    a = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    b = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_query(spark, duck, name):
    same(spark, duck, registry.queries()[name], registry.sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.sql())))
def test_runs(spark, duck, name):
    """Queries without SQL have tests of their operators; here they must give rows."""
    assert registry.queries()[name](spark, DATA).count() > 0
