"""Pages from several parsers: recorded outputs as elements, rebuilt tables, and merges of two parsers' pages.

Elements are flat rows (page keys, element, type, text, box); boxes of recorded vision output are normalized. Merges
meet on the page, and for boxes on grid cells within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions import text as TX
from spandrel.operators import geometry as G
from spandrel.operators.layout import lines_of

#: The element types, and those of visual content and of titles.
TYPES = ("heading", "paragraph", "list", "table", "figure", "caption", "footnote")
VISUAL = ("figure", "caption", "table")
TITLES = ("heading", "caption", "paragraph")
RECORDED = "struct<elements:array<struct<type:string,text:string,markdown:string,bbox:array<double>,confidence:double>>>"


def line_elements(boxes: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, reading_order, type, text, confidence, box): an element a line of boxes (image, box_id, text, score, box):
    the boxes' envelope, their mean score, and a type by the line's text."""
    box = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("yc"), (F.col("y1") - F.col("y0")).alias("h"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("box_id").cast("long").alias("id"), "text", F.col("score").cast("double").alias("score"), *G.BOX)
    placed = boxes.groupBy(image).agg(F.collect_list(box).alias("of")).select(image, "of", lines_of(F.col("of")).alias("lines"))
    rows = placed.select(image, F.posexplode(F.transform("lines", lambda line: F.transform(line, lambda i: F.get("of", i)))).alias("reading_order", "line"))
    all_ = lambda f: F.transform("line", lambda b: b[f])
    scores = F.filter(all_("score"), lambda x: x.isNotNull())
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0))
    least, most = ([f(all_(c)).alias(c) for c in names] for f, names in ((F.array_min, G.BOX[:2]), (F.array_max, G.BOX[2:])))
    own = rows.select(image, "reading_order", F.array_join(all_("text"), "").alias("text"), mean.alias("confidence"), *least, *most)
    return own.select(image, "reading_order", TX.classify(F.col("text")).alias("type"), "text", "confidence", *G.BOX)


def json_object(raw: Column) -> Column:
    """The first to the last brace of an answer in prose; null if there is none."""
    return F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))


def recorded_elements(responses: DataFrame, page: list[str], raw: str = "raw") -> DataFrame:
    """(page keys, reading_order, type, text, markdown, bbox, confidence) from a vision model's recorded answers. Unknown
    types are paragraphs; boxes and confidences are clipped to 0..1, boxes of other than four numbers go; a table without
    text takes its markdown; what has no text goes, unless it is a figure or table."""
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    trim = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")

    def element(e: Column) -> Column:
        kind = F.lower(F.coalesce(e["type"], F.lit("paragraph")))
        text = trim(e["text"])
        markdown = trim(F.coalesce(F.nullif(e["markdown"], F.lit("")), text))
        kind = F.when(kind.isin(*TYPES), kind).otherwise("paragraph")
        box = F.when(F.size(e["bbox"]) == 4, F.transform(e["bbox"], clip))
        return F.struct(kind.alias("type"), F.when((kind == "table") & (text == ""), markdown).otherwise(text).alias("text"), markdown.alias("markdown"), box.alias("bbox"), F.when(e["confidence"].isNotNull(), clip(e["confidence"])).alias("confidence"))

    told = F.from_json(json_object(F.col(raw)), RECORDED)["elements"]
    kept = F.filter(F.transform(told, element), lambda e: (e["text"] != "") | e["type"].isin("figure", "table"))
    return responses.select(*page, F.posexplode(kept).alias("reading_order", "e")).select(*page, "reading_order", "e.*")


def envelope(boxes: Column) -> Column:
    """The box around several, as an array (x0, y0, x1, y1); null without any."""
    side = lambda i, f: f(F.transform(boxes, lambda b: b[i]))
    return F.when(F.size(boxes) > 0, F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max)))


def rebuilt_tables(tables: DataFrame, elements: DataFrame, page: list[str], table: str, element: str) -> DataFrame:
    """(page keys, table, box, rows, columns, text, confidence, reading_order) of detected tables (page, table, box, cells,
    caption) with two rows and columns that hold something: caption and cells as text, the mean confidence and the least
    order of the elements whose centre they hold."""
    full = tables.withColumn("cells", G.clean_rows(F.col("cells"))).withColumn("rows", F.size(F.filter("cells", lambda r: F.exists(r, lambda c: c != "")))).withColumn("columns", F.coalesce(F.array_max(F.transform("cells", lambda r: F.size(r))), F.lit(0)))
    full = full.filter("rows >= 2 and columns >= 2")
    held = G.centre_in_box(elements, full, page, element, table).groupBy(*page, F.col(f"in_{table}").alias(table)).agg(F.avg("confidence").alias("confidence"), F.min("reading_order").alias("reading_order"))
    body = F.array_join(F.transform("cells", lambda r: F.array_join(r, "\t")), "\n")
    named = F.when(F.coalesce(F.col("caption"), F.lit("")) != "", F.concat_ws("\n", "caption", body)).otherwise(body)
    return full.join(held, [*page, table], "left").select(*page, table, *G.BOX, "rows", "columns", named.alias("text"), "confidence", "reading_order")


def vision_merged(baseline: DataFrame, vision: DataFrame, modes: DataFrame, page: list[str], element: str) -> DataFrame:
    """(page keys, element, source, type, text, box, reading_order) of pages (page, mode, width, height): "replace" takes
    the vision model's page, "enrich" adds its visual elements with the nearest title above them, else the page stays.

    A title is the lowest heading, caption or paragraph of at most 200 characters that ends above the visual's start
    (or 3 % of the page below it); of equal ends the first. Titles meet visual elements on their page."""
    names = [*page, element, "type", "text", *G.BOX]
    base = baseline.select(*names).join(modes.select(*page, "mode"), page).filter("mode <> 'replace'").select(*names, F.lit("baseline").alias("source"))
    own = vision.join(modes, page).filter("mode in ('replace', 'enrich')")
    sized = dict(zip(G.BOX, G.denormalised(G.box(), F.col("width"), F.col("height")), strict=True))
    whole = own.filter("mode = 'replace'").select(*names, F.lit("vision").alias("source"))
    seen = own.filter((F.col("mode") == "enrich") & F.col("type").isin(*VISUAL) & (F.trim(F.coalesce(F.col("text"), F.lit(""))) != "")).withColumns(sized)
    titles = baseline.filter(F.col("type").isin(*TITLES) & (F.trim("text") != "") & (F.length(F.trim("text")) <= 200) & F.col("y1").isNotNull()).select(*page, F.col("y1").alias("ty"), F.col(element).alias("te"), F.trim("text").alias("title"))
    above = seen.select(*page, element, "y0", "height").join(titles, page).filter("ty <= y0 + 0.03 * height").groupBy(*page, element).agg(F.max_by("title", F.struct("ty", -F.col("te"))).alias("title"))
    titled = F.when(F.col("type").isin("figure", "table") & F.col("title").isNotNull(), F.concat_ws("\n", "title", "text")).otherwise(F.col("text"))
    rich = seen.join(above, [*page, element], "left").withColumn("text", titled).select(*names, F.lit("vision").alias("source"))
    return G.renumbered(base.unionByName(whole).unionByName(rich), page, F.col("source") == "vision", element)
