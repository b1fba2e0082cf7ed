"""Every query of the reference's operators against its DuckDB twin, on the smallest tables."""

import os

import pytest
from comparison import database, differences

from spandrel.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_twin(spark, con, name):
    df = registry.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name in registry.ORACLES:
        assert differences(rows, df.columns, con, registry.ORACLES[name]) == ""
    else:
        assert rows and len(set(df.columns)) == len(df.columns)


def test_dealing_rows_anew_changes_nothing(spark):
    from spandrel.operators import chunking, receipts
    from spandrel.plans import document_queries as q

    lines = q.lines(spark, FOLDER)
    spans = lambda df: sorted(map(tuple, df.selectExpr("doc_id").withColumn("n", df["doc_id"]).collect()))
    assert spans(lines) == spans(lines.repartition(5))
    one = lambda df: {r[0]: r[1] for r in df.select("doc_id", chunking.fixed_chunks(df["texts"]).alias("s")).collect()}
    assert one(lines) == one(lines.repartition(7))
    scores = q.table(spark, FOLDER, "events").select("event_type", "ts", "event_id", "value")
    summary = lambda df: sorted(map(tuple, receipts.latency(df, "event_type", ["ts", "event_id"], "value").collect()))
    assert summary(scores) == summary(scores.repartition(6))
