"""Items listed and scored in their record's row, and tables dealt by key: the same results, with fewer sorts and bounded parts."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spandrel.operators import item_matching
from spandrel.operators import receipts as O
from spandrel.plans import receipt_queries as q
from spandrel.sources.tables import dealt

FOLDER = "/root/testdata/sf0.001"
ITEMS = "array<struct<name:string,amount:double>>"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b):
    if a is None or b is None:
        return float(a is b)
    return 1 - edits(a, b) / max(len(a), len(b)) if a or b else 1.0


def matched(gt, pred):
    found = sorted((-alike(g[0], p[0]), i, j) for i, g in enumerate(gt or []) for j, p in enumerate(pred or []) if alike(g[0], p[0]) >= 0.6)
    out = []
    for s, i, j in found:
        if all(i != m[0] and j != m[1] for m in out):
            out.append((i, j, -s, gt[i][1] == pred[j][1]))
    return out


def some_records():
    r = random.Random(3)
    name = lambda: r.choice([None, "", "tea", "teas", "green tea", "green teas", "TEA", "茶", "茶葉蛋", "pear", "peer"])
    side = lambda: None if r.random() < 0.1 else [(name(), r.choice([None, 1.0, 2.0])) for _ in range(r.randrange(6))]
    return [(k, side(), side()) for k in range(300)]


def test_record_scores_are_those_of_aligned_rows(spark):
    records = some_records()
    df = spark.createDataFrame(records, f"k int, gt {ITEMS}, pred {ITEMS}")
    found = {r.k: [tuple(m) for m in r.m] for r in df.select("k", O.matched_items(F.col("gt"), F.col("pred")).alias("m")).collect()}
    assert found == {k: matched(gt, pred) for k, gt, pred in records}
    aligned = df.select("k", F.explode(O.align_items(F.col("gt"), F.col("pred"))).alias("m")).select("k", "m.*")
    rows = lambda x: {r.k: tuple(r) for r in x.collect()}
    assert rows(O.record_scores(df, "k", "gt", "pred")) == rows(O.item_scores(aligned, "k"))


def test_listed_items_are_in_order(spark):
    rows = [(k, n, f"v{n}") for k in range(20) for n in range(k % 5 + 1)] + [(99, None, "first"), (99, 0, "second")]
    random.Random(1).shuffle(rows)
    got = {r.k: r.all for r in O.listed(spark.createDataFrame(rows, "k int, n int, v string").repartition(4), "k", ["n"], F.col("v"), "all").collect()}
    assert got == {**{k: [f"v{n}" for n in range(k % 5 + 1)] for k in range(20)}, 99: ["first", "second"]}


def test_parts_grow_with_the_table(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(20_000).withColumn("k", F.col("id") % 5_000)
    parts = dealt(df, "k", 20_000, most=1000)
    sizes = [r.n for r in parts.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert parts.rdd.getNumPartitions() % cores == 0 and 20_000 / parts.rdd.getNumPartitions() <= 1000 and max(sizes) < 2000
    assert parts.groupBy("k", F.spark_partition_id()).count().count() == 5_000  # a key is in one part
    assert dealt(df, "k", 20_000, most=20_000).rdd.getNumPartitions() == df.rdd.getNumPartitions()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_item_scores_sort_lines_once(spark, capsys):
    q.a2_item_prf(spark, FOLDER).explain()
    plan = capsys.readouterr().out
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_item_means_group_only_by_configuration(spark, capsys):
    q.a3_item_means(spark, FOLDER).explain()
    plan = capsys.readouterr().out
    assert plan.count("Sort [") == 1 and plan.count("Aggregate(") == 2 and "ObjectHashAggregate" not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_item_means_match_a_batch_at_a_time(spark, capsys):
    q.a3_item_means(spark, FOLDER).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "levenshtein" not in plan and "lambdafunction" not in plan


@pytest.mark.parametrize("pairs, cells, few", [(500_000, 100_000, 256), (3, 20, 1), (1, 1, 10**6)])
def test_batches_match_as_rows_do_whatever_is_held_at_once(monkeypatch, pairs, cells, few):
    for name, value in (("PAIRS_AT_ONCE", pairs), ("CELLS_AT_ONCE", cells), ("FEW", few)):
        monkeypatch.setattr(item_matching, name, value)
    records = [*some_records(), (300, [(c * n, 1.0) for c in "ab" for n in range(9)], [(c * n, 1.0) for n in range(9) for c in "aab"])]
    sides = [[r[k] or [] for r in records] for k in (1, 2)]
    sizes = [np.array([*map(len, side)]) for side in sides]
    g, p, s = item_matching.matches(*sizes, *(pa.array([n for items in side for n, _ in items], pa.string()) for side in sides), 0.6)
    of = np.repeat(np.arange(len(records)), sizes[0])[g]
    first = [np.cumsum(n) - n for n in sizes]
    got = {r[0]: [] for r in records}
    for r, i, j, x in zip(of.tolist(), g.tolist(), p.tolist(), s.tolist(), strict=True):
        got[r].append((i - int(first[0][r]), j - int(first[1][r]), x))
    assert got == {k: [m[:3] for m in matched(gt, pred)] for k, gt, pred in records}
    assert all(len(x) == 0 for x in item_matching.matches(*(np.zeros(1, dtype=np.int64),) * 2, *(pa.array([], pa.string()),) * 2, 0.6))


def test_amounts_are_equal_as_spark_sees_it(spark):
    nan, item = float("nan"), "array<struct<name:string,amount:{}>>"
    records = [("k", [("a", 0.0), ("b", nan), ("c", None), ("d", 1.0), None], [None, ("a", -0.0), ("b", nan), ("c", None), ("d", 2.0)]), ("n", None, [("a", 1.0)]), ("e", [], []), ("o", [("a", 1.0)], [])]
    scores = lambda df: {r.k: tuple(r)[1:] for r in O.record_scores(df, "k", "gt", "pred").collect()}
    got = scores(spark.createDataFrame(records, f"k string, gt {item.format('double')}, pred {item.format('double')}"))
    assert got == {"k": (1.0, 1.0, 1.0, 0.8, 1.0, 1.0), "n": (0.0, 1.0, 0.0, None, None, None), "o": (1.0, 0.0, 0.0, None, None, None)}
    mixed = spark.createDataFrame([("k", [("a", 2), ("b", 3)], [("a", 2.0), ("b", 3.5)])], f"k string, gt {item.format('int')}, pred {item.format('double')}")
    assert scores(mixed)["k"][3] == 0.5
