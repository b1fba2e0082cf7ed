"""Receipts from images at size: an order meets its line items once, batches of images are read at once, and the rules say what a
plain reading of the reference says."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from spandrel.functions import receipts as R
from spandrel.operators import extraction as X
from spandrel.plans import extraction_queries as q
from spandrel.sources import tables

FOLDER = "/root/testdata/sf0.001"
AMOUNT = re.compile(r"-?\d{1,3}(,\d{3})*(\.\d+)?|-?\d+(\.\d+)?", re.A)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def box_amount(text):
    """Of ASCII texts."""
    bare = re.sub(r"(?i)^(NT\$|NTD|TWD|RM|MYR|\$)\s*", "", text.strip())
    return float(bare.replace(",", "")) if AMOUNT.fullmatch(bare) else None


def plain_total(lines):
    for line in lines:
        if any(w in "".join(line).upper() for w in X.TOTAL_WORDS):
            found = [a for a in map(box_amount, line) if a is not None]
            if found:
                return found[-1]
    return None


def plain_items(lines):
    says = lambda line, words: sum(w in "".join(line).upper() for w in words)
    start = next((i + 1 for i, x in enumerate(lines) if says(x, X.HEADER_WORDS) >= 2), 0)
    out = []
    for line in lines[start : next((i for i, x in enumerate(lines) if says(x, X.TOTAL_WORDS)), len(lines))]:
        kept = list(line)
        while kept and box_amount(kept[-1]) is not None:
            kept.pop()
        name = re.sub(r"\s+", " ", "".join(kept)).strip(" ").upper()
        if kept and len(kept) < len(line) and name:
            out.append((name, box_amount(line[-1])))
    return out


def test_rules_on_odd_images(spark):
    r = random.Random(7)
    words = ["total", "Due", "amount", "Qty", "ßdue", "合計", "品名", "數量", "tea", "green  tea", "", "-5.50", "1,234", "12,34", "NT$ 7", "rm1,000.5", "1.2.3", "9", " 12", "free"]
    images = {k: [[r.choice(words) for _ in range(r.randrange(1, 5))] for _ in range(r.randrange(1, 8))] for k in range(400)}
    rows = [(k, 100 * i + j, t, 50.0 * j, 30.0 * i, 50.0 * j + 40, 30.0 * i + 20) for k, lines in images.items() for i, line in enumerate(lines) for j, t in enumerate(line)]
    boxes = spark.createDataFrame(rows, "image_id long, box_id long, text string, x0 double, y0 double, x1 double, y1 double")
    got = {x.image_id: x for x in X.assembled(X.image_lines(boxes)).collect()}
    assert {k: x.total_amount for k, x in got.items()} == {k: plain_total(v) for k, v in images.items()}
    assert {k: [tuple(i) for i in x["items"]] for k, x in got.items()} == {k: plain_items(v) for k, v in images.items()}


def test_amounts_that_are_plain_to_see_are_those_of_the_rule(spark):
    texts = ["1,234", "-5.50", "007", "1,23", "1.", "-", "tea", "", None, "１２", "NT$5", "5元", " 5", "5\n", "٣", "1" * 400]
    df = spark.createDataFrame([(1, i, t, 50.0 * i, 0.0, 50.0 * i + 40, 20.0) for i, t in enumerate(texts)], "image_id long, box_id long, text string, x0 double, y0 double, x1 double, y1 double")
    line = X.image_lines(df).select(F.explode("lines").alias("l")).select(X.amounts(F.col("l.boxes")).alias("a"), F.transform("l.boxes", lambda b: R.amount(F.when(b["text"].rlike(r"^-?[0-9]"), b["half"]), ascii_only=True)).alias("b")).first()
    assert line.a[:8] == [1234.0, -5.5, 7.0, None, None, None, None, None] and line.a[9:14] == [12.0, 5.0, 5.0, 5.0, 5.0] and line.a[8] is None and line.a[15] == line.b[15]


def test_names_hold_any_sign_in_canonical_form(spark):
    record = ("receipt", "店\x1f１", "2024/05/12", None, None, None, 5.0, [("a\x1fb", 1.0), ("　", 2.0), (None, 3.0), ("ｃ", None)])
    rows = spark.createDataFrame([(1, *record), (2, *([None] * 8))], f"k int, doc_type string, seller_name string, date string, invoice_number string, seller_tax_id string, buyer_tax_id string, total_amount double, items {X.ITEMS}")
    one, none = X.canonical(rows, "k").orderBy("k").collect()
    assert (one.seller_name, one.date, one.total_amount, [tuple(i) for i in one["items"]]) == ("店\x1f1", "2024-05-12", 5.0, [("A\x1fB", 1.0), ("C", None)])
    assert none["items"] == [] and [none[c] for c in none.asDict() if c not in ("k", "items")] == [None] * 7


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", ["t12_header_fields", "t14_assemble", "t15_pipeline"])
def test_images_take_one_shuffle_and_lines_one_look(spark, name):
    plan = plan_of(q.QUERIES[name](spark, FOLDER))
    met = plan[plan.index("_read(") :]
    assert met.count("Exchange hashpartitioning") == 1 and "explode" not in plan
    # words of totals and headers are looked for in a batch, not once a word and line
    assert "TOTAL SALES" not in plan and "DESCRIPTION" not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_images_are_dealt_into_bounded_parts(spark, monkeypatch):
    whole = sorted(map(tuple, q.t15_pipeline(spark, FOLDER).collect()), key=repr)
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    df = q.t15_pipeline(spark, FOLDER)
    assert df.rdd.getNumPartitions() * 100 >= 7500 and sorted(map(tuple, df.collect()), key=repr) == whole
