"""Tables continued over pages: chains against a plain loop, in one sort a step, and boxes of lines in bounded parts."""

import os
import random

import pytest

from spandrel.operators import geometry as G
from spandrel.plans import document_queries as q
from spandrel.sources import tables

FOLDER = "/root/testdata/sf0.001"


def some_tables():
    r = random.Random(5)
    rows = []
    for doc in range(60):
        for page in range(1, 9):
            for tab in range(r.choice([0, 1, 1, 1, 2, 3])):
                rows.append((doc, page, tab, 0.1, r.choice([0.0, 0.1, 0.1, 0.5]), 0.9, r.choice([0.5, 0.8, 0.8, 0.9]), r.choice([4, 4, 5, 9]), r.choice([None, "", None, "", "new"])))
    return rows


def chains(rows):
    """(doc, page, tab, continuity) by a loop over the pages of each document."""
    out = []
    for doc in {x[0] for x in rows}:
        pages = {}
        for x in rows:
            if x[0] == doc:
                pages.setdefault(x[1], []).append(x)
        last = None  # page and table that the last link ends at, and its chain
        for page in sorted(pages):
            if page + 1 not in pages:
                continue
            a, b = max(pages[page], key=lambda x: (x[6], -x[2])), min(pages[page + 1], key=lambda x: (x[4], x[2]))
            if a[6] < 0.75 or b[4] > 0.2 or abs(a[7] - b[7]) / max(a[7], b[7]) > 0.3 or b[8]:
                continue
            chain = last[2] if last and last[:2] == (page, a[2]) else page
            out += [(doc, page, a[2], chain), (doc, page + 1, b[2], chain)]
            last = (page + 1, b[2], chain)
    return sorted(set(out))


def test_chains_are_those_of_a_loop(spark, capsys):
    rows = some_tables()
    df = G.continued_tables(spark.createDataFrame(rows, "doc int, page int, tab int, x0 double, y0 double, x1 double, y1 double, columns int, caption string").repartition(3), "doc", "page", "tab")
    got = sorted(map(tuple, df.collect()))
    assert got == chains(rows) and any(page > c + 1 for _, page, _, c in got)
    df.explain()
    assert "HashAggregate" not in capsys.readouterr().out  # no row is made twice, so none has to be found equal


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_boxes_of_many_lines_are_in_bounded_parts(spark, monkeypatch):
    few = sorted(map(tuple, q.t8_cross_page(spark, FOLDER).collect()))
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    many = q.t8_cross_page(spark, FOLDER)
    assert sorted(map(tuple, many.collect())) == few and many.rdd.getNumPartitions() >= 6000 / 100
