"""Receipts from lines of text boxes: header fields, items, whole records, their canonical form and schema errors.

The lines of one image are one array of (text, half, kind, boxes) in reading order, with boxes an array of (text, half, sure,
amount) from left to right; half is the text in half width, kind what the line says, amount the box's where that is plain to see (sure). Rules look along the lines of their own row only, so nothing is shuffled
after its boxes have met; an image without lines gives a record of nulls without items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.functions import receipts as R
from spandrel.functions import text as TX
from spandrel.functions.text import bound
from spandrel.operators.layout import ends, line_starts, placed

#: Words of total rows and of item headers, compared with the upper-case line.
TOTAL_WORDS = ("總計", "合計", "合计", "應付金額", "应付金额", "應付總額", "消費金額", "TOTAL", "GRAND TOTAL", "AMOUNT DUE", "NET TOTAL", "TOTAL SALES", "DUE")
#: The fewer words by which an annotator's suggestion knows a total row, compared as written.
SUGGESTED_WORDS = ("總計", "合計", "應付金額", "應付總額", "消費金額")
HEADER_WORDS = ("品名", "品項", "數量", "数量", "金額", "金额", "QTY", "DESCRIPTION", "AMOUNT")
INVOICE = r"(?U)[A-Za-z]{2}\s?-?\s?\d{8}"
TAX_ID = r"(?U)\d{8}"
#: What may stand in an amount that a line suggests.
AMOUNT_SIGNS = r"(?U)[^\d,.$元 ]"
ITEMS = "array<struct<name:string,amount:double>>"
#: What a line says.
TOTAL, HEADER = 1, 2
_BOX = T.StructType([T.StructField("text", T.StringType()), T.StructField("half", T.StringType()), T.StructField("sure", T.BooleanType()), T.StructField("amount", T.DoubleType())])
LINES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("half", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("boxes", T.ArrayType(_BOX))]))


@F.arrow_udf(LINES)
def _read(boxes: pa.Array) -> pa.Array:
    """The lines of every image of a batch."""
    flat, number = boxes.flatten(), lambda c: pc.cast(flat.field(c), pa.float64())
    middle = lambda a, b: pc.divide(pc.add(number(a), number(b)), 2.0)
    own = {"yc": middle("y0", "y1"), "h": pc.subtract(number("y1"), number("y0")), "x": middle("x0", "x1"), "id": pc.cast(flat.field("box_id"), pa.int64()), "text": flat.field("text")}
    row, line, _, inner = placed(boxes, pa.StructArray.from_arrays(list(own.values()), list(own)))
    starts = line_starts(row, line)
    texts, spans = inner.field("text"), pa.array(np.append(starts, len(row)).astype(np.int32))
    both = [texts, TX.halves(texts)]
    joined = [pc.binary_join(pa.ListArray.from_arrays(spans, t.fill_null("")), "") for t in both]
    read = [*both, *_plain_amounts(texts)]
    of = pa.ListArray.from_arrays(spans, pa.StructArray.from_arrays(read, _BOX.fieldNames()))
    lines = pa.StructArray.from_arrays([*joined, _kinds(joined[0]), of], LINES.elementType.fieldNames())
    return pa.ListArray.from_arrays(pa.array(ends(row[starts], len(boxes))), lines, mask=boxes.is_null())


def _plain_amounts(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(sure, amount): an ASCII text without a digit is no amount, one that is a bare number is that; rules decide on others."""
    ascii_ = pc.string_is_ascii(texts).fill_null(False)
    plain = pc.and_(ascii_, pc.match_substring_regex(texts, R.PLAIN_AMOUNT).fill_null(False))
    bare = pc.and_(ascii_, pc.invert(pc.match_substring_regex(texts, "[0-9]")).fill_null(False))
    numbers = pc.cast(pc.replace_substring(texts.filter(plain), ",", ""), pa.float64())
    return pc.or_(plain, bare), pc.replace_with_mask(pa.nulls(len(texts), pa.float64()), plain, numbers)


def _kinds(texts: pa.Array) -> pa.Array:
    """What lines say, as a sum: TOTAL for a total row, HEADER for an item header, which has at least two of its words."""
    wide = pc.invert(pc.string_is_ascii(texts))
    upper = pc.replace_with_mask(pc.ascii_upper(texts), wide, pa.array([x.upper() for x in texts.filter(wide).to_pylist()], texts.type))
    says = lambda w: pc.match_substring(upper, w).to_numpy(zero_copy_only=False)
    total = np.logical_or.reduce([says(w) for w in TOTAL_WORDS if not any(o != w and o in w for o in TOTAL_WORDS)])
    header = sum(says(w).astype(np.int32) for w in HEADER_WORDS) >= 2
    return pa.array(TOTAL * total + HEADER * header, pa.int32())


def lines_of_boxes(boxes: Column) -> Column:
    """The lines of an image's array of boxes (box_id, text, x0, y0, x1, y1), grouped by their centres; a line's text is its
    boxes' without anything between. The grouping and half width, made for the images of a batch at once, are the only
    steps outside the JVM."""
    return _read(boxes)


def image_lines(boxes: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, lines) from boxes as rows (image, box_id, text, x0, y0, x1, y1), which meet by image first."""
    rows = boxes.groupBy(image).agg(F.collect_list(F.struct("box_id", "text", "x0", "y0", "x1", "y1")).alias("of"))
    return rows.select(image, lines_of_boxes(F.col("of")).alias("lines"))


def _first(values: Column) -> Column:
    """The first value that is not null."""
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def _first_of(values: Column, body, type_: str) -> Column:
    """The first body(value) that is not null; values after it are not looked at."""
    return F.aggregate(values, F.lit(None).cast(type_), lambda found, x: F.when(found.isNotNull(), found).otherwise(body(x)))


def amounts(boxes: Column) -> Column:
    return F.transform(boxes, lambda b: F.when(b["sure"], b["amount"]).otherwise(R.box_amount(b["text"], b["half"])))


def _found_date(lines: Column) -> Column:
    """The date of the first line that has one; any takes at least four digits."""
    return _first_of(lines["half"], lambda t: F.when(t.rlike(r"(?:\d\D*+){4}"), R.date(t, ascii_only=True)), "string")


def _found_invoice(lines: Column) -> Column:
    """The first invoice number of a line. Lines are joined by a sign that no number or id can hold, and looked through at once."""
    return F.nullif(F.regexp_extract(F.array_join(lines["text"], R.SEPARATOR), INVOICE, 0), F.lit(""))


def _ids(text: Column, invoice: Column) -> Column:
    """Runs of eight digits outside the invoice number."""
    return F.regexp_extract_all(F.when(invoice.isNull(), text).otherwise(F.replace(text, invoice, F.lit(""))), F.lit(TAX_ID), F.lit(0))


def _found_total(lines: Column) -> Column:
    """The right-most amount of the first total row that has any."""
    totals = F.filter(lines, lambda l: l["kind"].bitwiseAND(TOTAL) > 0)
    last = lambda found: F.element_at(F.concat(F.array(F.lit(None).cast("double")), F.filter(found, lambda a: a.isNotNull())), -1)
    return _first_of(totals, lambda l: last(amounts(l["boxes"])), "double")


def header_fields(lines: Column) -> Column:
    """(doc_type, seller_name, date, invoice_number, seller_tax_id, buyer_tax_id, total_amount): the first line, the
    first date, the first invoice number, runs of eight digits outside it, and the right-most amount of the first total
    row that has any."""

    def told(known: Column) -> Column:
        return F.struct(
            F.when(known["invoice"].isNotNull(), "e_invoice").otherwise("receipt").alias("doc_type"), F.get(lines["text"], F.lit(0)).alias("seller_name"), _found_date(lines).alias("date"), known["invoice"].alias("invoice_number"),
            F.get(known["ids"], F.lit(0)).alias("seller_tax_id"), F.get(known["ids"], F.lit(1)).alias("buyer_tax_id"), _found_total(lines).alias("total_amount"),
        )

    ids = lambda invoice: F.struct(invoice.alias("invoice"), _ids(F.array_join(lines["text"], R.SEPARATOR), invoice).alias("ids"))
    return bound(bound(_found_invoice(lines), ids), told)


def items(lines: Column) -> Column:
    """Items (name, amount) of the lines between the first header row (or the start) and the first total row (or the
    end): boxes that are amounts stand at a line's end, the right-most counts; what is left of them is the name."""

    def item(boxes: Column) -> Column:
        def read(paid: Column) -> Column:
            named = F.coalesce(F.array_max(F.transform(paid, lambda a, i: F.when(a.isNull(), i + 1))), F.lit(0))
            name = F.array_join(F.slice(boxes["half"], 1, named), "")
            return F.when((named > 0) & (named < F.size(paid)), F.struct(TX.normalize_text(name, ascii_only=True).alias("name"), F.get(paid, F.size(paid) - 1).alias("amount")))

        return bound(amounts(boxes), read)

    def between(ends: Column) -> Column:
        own = F.slice(lines["boxes"], ends["start"] + 1, F.greatest(ends["end"] - ends["start"], F.lit(0)))
        return F.filter(F.transform(own, item), lambda x: x.isNotNull() & x["name"].isNotNull())

    # the lines before an item header and before a total row, all of them if there is none
    start, end = (_first(F.transform(lines["kind"], lambda k, i: F.when(k.bitwiseAND(bit) > 0, i))) for bit in (HEADER, TOTAL))
    return bound(F.struct(F.coalesce(start + 1, F.lit(0)).alias("start"), F.coalesce(end, F.size(lines)).alias("end")), between)


def assembled(images: DataFrame, image: str = "image_id", helper: DataFrame | None = None) -> DataFrame:
    """(image, header fields, items) of `images` (image, lines). Where the rules find no item at all, those of `helper`
    (image, items: recorded answers of a model) stand in, if there are any."""
    rows = images.select(image, header_fields(F.col("lines")).alias("h"), items(F.col("lines")).cast(ITEMS).alias("items"))
    if helper is not None:
        asked = helper.select(image, F.col("items").cast(ITEMS).alias("asked"))
        rows = rows.join(asked, image, "left").withColumn("items", F.when(F.size("items") == 0, F.coalesce("asked", "items")).otherwise(F.col("items")))
    return rows.select(image, "h.*", "items")


def suggested(lines: Column) -> Column:
    """Header fields that an annotator is offered: as `header_fields`, but ids are sought in all lines joined by blanks,
    and the total is the first amount on a line with one of SUGGESTED_WORDS or on the line after it."""
    texts = F.transform(lines, lambda l: l["text"])

    def number(t: Column) -> Column:
        bare = F.trim(F.regexp_replace(t, AMOUNT_SIGNS, " "))
        return R.amount(F.when(bare != "", bare).otherwise(t), ascii_only=True)

    def found(invoice: Column) -> Column:
        ids = _ids(F.array_join(texts, " "), invoice)
        near = F.transform(lines, lambda l, i: F.when(F.greatest(*(F.contains(l["text"], F.lit(w)) for w in SUGGESTED_WORDS)), F.coalesce(number(l["half"]), number(F.get(lines, i + 1)["half"]))))
        return F.struct(F.get(texts, F.lit(0)).alias("seller_name"), _found_date(lines).alias("date"), invoice.alias("invoice_number"), F.get(ids, F.lit(0)).alias("seller_tax_id"), F.get(ids, F.lit(1)).alias("buyer_tax_id"), _first(near).alias("total_amount"))

    return bound(_found_invoice(lines), found)


def canonical(records: DataFrame, key: str) -> DataFrame:
    """Records in canonical form: unknown document types are null, items without a name go."""
    fields = ("seller_name", "date", "invoice_number", "seller_tax_id", "buyer_tax_id", "total_amount")
    rows = records.withColumn("items", F.coalesce("items", F.array().cast(ITEMS)))
    # all texts of a record are brought to half width together: the fields', then the items' names
    rows = rows.withColumn("half_", TX.to_halfwidth_each(F.concat(F.array(*(F.col(c).cast("string") for c in fields)), F.col("items")["name"])))
    half = {c: F.get("half_", F.lit(i)) for i, c in enumerate(fields)}
    names = F.slice("half_", len(fields) + 1, F.size("items"))
    named = F.zip_with("items", names, lambda i, n: F.struct(TX.normalize_text(n, ascii_only=True).alias("name"), i["amount"].cast("double").alias("amount")))
    return rows.select(
        key, F.when(F.col("doc_type").isin(*R.DOC_TYPES), F.col("doc_type")).alias("doc_type"), TX.normalize_text(half["seller_name"], ascii_only=True).alias("seller_name"),
        *(f(half[c], ascii_only=True).alias(c) for f, c in ((R.date, "date"), (R.invoice_number, "invoice_number"), (R.tax_id, "seller_tax_id"), (R.tax_id, "buyer_tax_id"), (R.amount, "total_amount"))),
        F.filter(named, lambda i: i["name"].isNotNull()).alias("items"),
    )


def schema_errors() -> Column:
    """What a record breaks of its schema, as "path: what"; empty for a valid one. A null document type is an error."""
    shaped = lambda f, p: F.when(F.col(f).isNotNull() & ~F.col(f).rlike(p), f"{f}: does not match {p}")
    known = F.coalesce(F.col("doc_type").isin(*R.DOC_TYPES), F.lit(False))
    unnamed = F.transform("items", lambda i, n: F.when(F.coalesce(F.length(i["name"]), F.lit(0)) == 0, F.concat(F.lit("items/"), n.cast("string"), F.lit("/name: is empty"))))
    own = F.array(F.when(~known, "doc_type: is not one of its values"), shaped("date", r"^\d{4}-\d{2}-\d{2}$"), shaped("invoice_number", r"^[A-Z]{2}\d{8}$"), shaped("seller_tax_id", r"^\d{8}$"), shaped("buyer_tax_id", r"^\d{8}$"), F.when(F.col("items").isNull(), "items: is missing"))
    return F.filter(F.concat(own, F.coalesce(unnamed, F.array().cast("array<string>"))), lambda e: e.isNotNull())
