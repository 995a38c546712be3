"""The queries of this subpackage against their SQL on the smallest test data, where that is there."""

import pytest

from tests.test_queries import DATA, duck, same  # noqa: F401
from voxtide.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):  # noqa: F811
    same(spark, duck, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, duck, name):  # noqa: F811
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_labelled_documents(spark, duck):  # noqa: F811
    """Subjects agree with most of the hand labels, some of which are wrong."""
    d = DATA.replace("sf0.001", "sf0.01")
    got = {tuple(r) for r in queries.QUERIES["p9_found"](spark, d).collect()}
    labels = {tuple(r) for r in spark.read.parquet(f"{d}/doc_label.parquet").where("subject <> 'none'").select("doc_id", "subject").collect()}
    docs = {k for k, _ in labels}
    assert len(labels & got) / len(labels) >= 0.9 and len({g for g in got if g[0] in docs} - labels) / len(labels) < 0.15
