"""Receipt extraction, canonical forms in full width, records at rest, merges and gates on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from spandrel.functions import receipts as R
from spandrel.operators import captions, evaluation, extraction, gates, merging, records, retrieval


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


def text(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    ("form", "raw", "want"),
    [
        (R.date, "２０２４／０５／１２", "2024-05-12"), (R.date, "中華民國１１３年５月１２日", "2024-05-12"), (R.date, "12-13-2024", None), (R.amount, "ＮＴ＄１，２３４", 1234.0), (R.amount, "1.2.3", None), (R.tax_id, "２２５５５００３", "22555003"), (R.tax_id, "2255500", None),
        (R.invoice_number, "ＡＢ－１２３４５６７８", "AB12345678"), (R.invoice_number, "ab 1234—5678", "AB12345678"), (R.invoice_number, "ABC12345678", None), (R.date, None, None), (R.amount, None, None), (R.invoice_number, None, None),
    ],
)
def test_full_width_forms(spark, form, raw, want):
    assert one(spark, form(text(raw))) == want


def boxes(spark, *lines):
    rows = [(1, 100 * i + j, t, 50.0 * j, 30.0 * i, 50.0 * j + 40, 30.0 * i + 20) for i, line in enumerate(lines) for j, t in enumerate(line)]
    return extraction.image_lines(spark.createDataFrame(rows, "image_id long, box_id long, text string, x0 double, y0 double, x1 double, y1 double"))


def test_receipt_of_nine_lines(spark):
    lines = [["全家便利商店"], ["2024-05-12"], ["AB-12345678"], ["賣方 22555003"], ["品名", "數量", "金額"], ["茶", "2", "60"], ["飯", "糰", "1", "NT$35"], ["無價"], ["總計", "3", "95元"], ["謝謝", "7"]]
    r = extraction.assembled(boxes(spark, *lines)).first()
    assert (r.doc_type, r.seller_name, r.date, r.invoice_number, r.seller_tax_id, r.buyer_tax_id, r.total_amount) == ("e_invoice", "全家便利商店", "2024-05-12", "AB-12345678", "22555003", None, 95.0)
    assert [(i.name, i.amount) for i in r["items"]] == [("茶", 60.0), ("飯糰", 35.0)]


def test_receipt_without_total_or_header(spark):
    r = extraction.assembled(boxes(spark, ["shop"], ["tea", "60"], ["60"], ["cake"])).first()
    assert r.doc_type == "receipt" and r.total_amount is None and [(i.name, i.amount) for i in r["items"]] == [("TEA", 60.0)]
    helper = spark.createDataFrame([(1, [("asked", 5.0)])], f"image_id long, items {extraction.ITEMS}")
    assert extraction.assembled(boxes(spark, ["shop"]), helper=helper).first()["items"][0].name == "asked"
    assert extraction.assembled(boxes(spark, ["shop"])).first()["items"] == []


def test_schema_errors(spark):
    rows = [("e_invoice", "2024-05-12", "AB12345678", "22555003", None, [("a", 1.0)]), (None, "12/05/2024", "AB1", "1", "2", [("", None)]), ("receipt", None, None, None, None, None)]
    table = spark.createDataFrame(rows, f"doc_type string, date string, invoice_number string, seller_tax_id string, buyer_tax_id string, items {extraction.ITEMS}")
    got = [r[0] for r in table.select(extraction.schema_errors()).collect()]
    assert got[0] == [] and [e.split(":")[0] for e in got[1]] == ["doc_type", "date", "invoice_number", "seller_tax_id", "buyer_tax_id", "items/0/name"] and got[2] == ["items: is missing"]


def test_records_at_rest(spark, tmp_path):
    record = {"doc_type": "receipt", "seller_name": "店", "date": None, "total_amount": 5, "items": [{"name": "茶", "amount": None}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.b.json").write_text(json.dumps(record, indent=1))
    back = records.read_records(spark, f"file://{tmp_path}/in")
    r = back.first()
    assert (r.name, r.seller_name, r.date, r.total_amount, r["items"][0].name) == ("a.b", "店", None, 5.0, "茶")
    records.write_records(back, f"file://{tmp_path}/out")
    line = next((tmp_path / "out").glob("part-*")).read_text()
    assert "店" in line and '"date":null' in line
    rows = spark.createDataFrame([("a/b", "p 1", 1), ("c", "p 1", 2)], "document_id string, parser string, n int")
    records.write_layer(rows, f"file://{tmp_path}", "ir")
    assert (tmp_path / "ir" / "document_id=a_b" / "parser=p_1").is_dir()
    assert records.definition_sha256({"b": 1, "a": "é"}) == records.definition_sha256({"a": "é", "b": 1})


def test_what_is_missing_is_an_error(spark):
    gold, some = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    for broken in (evaluation.gold_decisions(gold, some, ["k"]), records.required(gold, some, ["k"])):
        with pytest.raises(Exception, match="no decision|not stored"):
            broken.collect()
    assert evaluation.gold_decisions(gold.filter("k = 1"), some, ["k"]).first()["v"] == "x"
    with pytest.raises(Exception, match="no such dimension"):
        one(spark, evaluation.scored(F.lit("odd"), {"a": F.lit(1.0)}))
    with pytest.raises(Exception, match="no such mode"):
        one(spark, captions.known_mode(F.lit("odd")))
    with pytest.raises(Exception, match="no original crop"):
        captions.with_crop(spark.createDataFrame([(None,)], "crop_ref string")).collect()
    with pytest.raises(Exception, match="outside the document"):
        one(spark, records.selected_pages(F.array(F.lit(9)), F.lit(3)))
    with pytest.raises(Exception, match="out of range"):
        one(spark, records.finite(F.lit(1.5), "rate", rate=True))
    with pytest.raises(ValueError, match="not allowed"):
        records.exported(some, "k", [], [], ["k"])


def test_merges(spark):
    page = "doc int, page int, el int, type string, text string, x0 double, y0 double, x1 double, y1 double"
    base = spark.createDataFrame([(1, 1, 0, "heading", "Title", 0.0, 10.0, 50.0, 20.0), (1, 1, 1, "paragraph", "below", 0.0, 90.0, 50.0, 99.0), (2, 1, 0, "paragraph", "gone", 0.0, 0.0, 1.0, 1.0)], page)
    seen = spark.createDataFrame([(1, 1, 9, "figure", "chart", 0.1, 0.3, 0.5, 0.6), (2, 1, 9, "paragraph", "new", 0.1, 0.3, 0.5, 0.6), (3, 1, 9, "figure", "unasked", 0.0, 0.0, 1.0, 1.0)], page)
    modes = spark.createDataFrame([(1, 1, "enrich", 100.0, 100.0), (2, 1, "replace", 100.0, 100.0), (3, 1, "none", 100.0, 100.0)], "doc int, page int, mode string, width double, height double")
    got = sorted((r.doc, r.reading_order, r.source, r.text) for r in merging.vision_merged(base, seen, modes, ["doc", "page"], "el").collect())
    assert got == [(1, 0, "baseline", "Title"), (1, 1, "vision", "Title\nchart"), (1, 2, "baseline", "below"), (2, 0, "vision", "new")]
    assert one(spark, merging.envelope(F.array(F.array(F.lit(1.0), F.lit(5.0), F.lit(2.0), F.lit(6.0)), F.array(F.lit(0.0), F.lit(7.0), F.lit(1.0), F.lit(9.0))))) == [0.0, 5.0, 2.0, 9.0]


def test_comparator_and_gates(spark):
    row = spark.createDataFrame([(0.5, None)], "base_a double, cand_a double")
    assert gates.comparator(row, ("a",)).first()["recommendation"] == "PENDING"
    assert gates.decided(row, {"a": F.col("cand_a") > 0}).first()["recommendation"] == "NO-GO"


def test_windows_start_with_the_section(spark):
    chunks = spark.createDataFrame([(1, 0, "x" * 400 + " needle", "Heading words"), (2, 0, "y" * 400, "")], "doc_id long, chunk_idx int, text string, section string")
    asked = spark.createDataFrame([(1, "Heading words")], "item_id long, text string")
    w = retrieval.Windows(100, 20)
    best = lambda **k: retrieval.top_chunks(chunks, asked, k=1, windows=w, **k).first()["score"]
    assert best(section="section") > best() + 0.1
