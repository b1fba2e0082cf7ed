"""Page geometry: boxes, spatial joins, captions, nested and continued tables, routing of pages.

Boxes are flat columns x0, y0, x1, y1 (page points, or 0..1 where the space is "normalized"). Spatial joins meet on
(document, page, grid cell), so a crowded page is dealt over its cells instead of pairing all its boxes in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 64
#: Fixed values of the routers: least confidence of a table page; characters and raster areas of visual pages.
TABLE_CONFIDENCE = 0.62
SCAN_CHARS, SCAN_AREA, NATIVE_CHARS, VISUAL_AREA = 80, 0.5, 700, 0.15
BOX = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in BOX)


def normalised(b: tuple, width: Column, height: Column, space: Column | None = None) -> tuple:
    """The box over the page's size; boxes of normalized space stay, a missing box is zeros."""
    size = (width, height, width, height)
    done = [c / s if space is None else F.when(space == "normalized", c).otherwise(c / s) for c, s in zip(b, size, strict=True)]
    return tuple(F.coalesce(c, F.lit(0.0)) for c in done)


def denormalised(b: tuple, width: Column, height: Column) -> tuple:
    return tuple(c * s for c, s in zip(b, (width, height, width, height), strict=True))


def intersection(a: tuple, b: tuple) -> Column:
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    return side(0) * side(1)


def area(b: tuple) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union; 0 if both are empty."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def area_ratio(b: tuple, width: Column, height: Column) -> Column:
    """The part of the page that a box covers, clipped to it; no box covers nothing."""
    page = (F.lit(0.0), F.lit(0.0), width, height)
    return F.coalesce(F.when(width * height > 0, intersection(b, page) / (width * height)), F.lit(0.0))


def table_markdown(rows: Column) -> Column:
    """Rows of cells, padded to the widest, as a table whose first row is the head; no rows give an empty text."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    full = F.transform(rows, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0))))))
    rule = F.array(line(F.array_repeat(F.lit("---"), width)))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(full, 1, 1), rule, F.slice(full, 2, F.size(rows))), "\n")).otherwise("")


def clean_rows(rows: Column) -> Column:
    """Cells without nulls, bars (full width instead) and runs of white space."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("｜")), r"(?U)\s+", " "), "^ | $", "")
    return F.transform(rows, lambda r: F.transform(r, clean))


def _cell(x: Column) -> Column:
    return F.floor(x / CELL).cast("int")


def centre_in_box(elements: DataFrame, tables: DataFrame, page: list[str], element: str, table: str) -> DataFrame:
    """Pairs (page keys, table, element and the rest of the elements' columns) with the element's centre in the table's
    box, edges included. Tables are repeated for the cells they cover, an element stands in one."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inner = elements.withColumns({"cx": cx, "cy": cy}).withColumns({"gx": _cell(F.col("cx")), "gy": _cell(F.col("cy"))})
    outer = tables.select(*page, F.col(table).alias("table_"), *(F.col(c).alias(f"t{c}") for c in BOX)).filter("tx0 <= tx1 and ty0 <= ty1")
    outer = outer.withColumn("gx", F.explode(F.sequence(_cell(F.col("tx0")), _cell(F.col("tx1"))))).withColumn("gy", F.explode(F.sequence(_cell(F.col("ty0")), _cell(F.col("ty1")))))
    found = inner.join(outer, [*page, "gx", "gy"]).filter("cx between tx0 and tx1 and cy between ty0 and ty1")
    return found.withColumnRenamed("table_", f"in_{table}").drop("gx", "gy", "cx", "cy")


def contained_tables(tables: DataFrame, page: list[str], table: str, least: float = 0.95) -> DataFrame:
    """(page keys, table, inner, inner_y0): tables of which another one covers at least `least` and which start lower.
    The centre of such a table lies in the other, so pairs come from the centre join."""
    pairs = centre_in_box(tables, tables, page, table, table).filter(F.col(table) != F.col(f"in_{table}"))
    outer, inner = box("t"), box()
    near = pairs.filter((area(inner) > 0) & (intersection(outer, inner) >= least * area(inner)) & (F.col("y0") > F.col("ty0")))
    return near.select(*page, F.col(f"in_{table}").alias(table), F.col(table).alias("inner"), F.col("y0").alias("inner_y0"))


def captions(elements: DataFrame, tables: DataFrame, page: list[str], element: str, table: str, gap: float = 48.0) -> DataFrame:
    """(page keys, table, seed, caption): the nearest caption-like element above a table, and the text of its line.

    Caption-like: of that type, or starting with 表, or short and centred over the table. Elements and tables meet in
    bands of the page's height; of equal gaps the smaller element is the seed."""
    band = lambda y: F.floor(y / CELL).cast("int")
    els = elements.filter(F.col("x0").isNotNull() & (F.trim("text") != "")).select(*page, F.col(element).alias("e"), F.col("text").alias("e_text"), F.col("type").alias("e_type"), *box())
    t = tables.select(*page, F.col(table).alias("t"), *(F.col(c).alias(f"t{c}") for c in BOX))
    above = t.withColumn("band", F.explode(F.sequence(band(F.col("ty0") - gap), band(F.col("ty0") + 5))))
    pairs = els.withColumn("band", band(F.col("y1"))).join(above, [*page, "band"])
    centred = (F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("tx0") + F.col("tx1")) / 2) <= 0.25 * (F.col("tx1") - F.col("tx0"))) & (F.length("e_text") <= 100)
    like = (F.col("e_type") == "caption") | F.col("e_text").startswith("表") | centred
    over = F.least("x1", "tx1") - F.greatest("x0", "tx0") > 0
    distance = F.col("ty0") - F.col("y1")
    seeds = pairs.filter(like & over & distance.between(-5, gap)).groupBy(*page, "t").agg(F.min_by(F.struct("e", ((F.col("y0") + F.col("y1")) / 2).alias("cy")), F.struct(distance.alias("d"), F.col("e"))).alias("s"), F.first("tx0").alias("tx0"), F.first("tx1").alias("tx1"))
    line = seeds.select(*page, "t", F.col("s.e").alias("seed"), F.col("s.cy").alias("cy"), "tx0", "tx1").withColumn("row", F.explode(F.sequence(band(F.col("cy") - 8), band(F.col("cy") + 8))))
    own = els.filter(F.length("e_text") <= 140).withColumn("ey", (F.col("y0") + F.col("y1")) / 2).withColumn("row", band(F.col("ey")))
    same = own.join(line, [*page, "row"]).filter((F.abs(F.col("ey") - F.col("cy")) <= 8) & (F.least("x1", "tx1") >= F.greatest("x0", "tx0")))
    texts = same.groupBy(*page, "t", "seed").agg(F.array_sort(F.collect_list(F.struct("x0", "e", "e_text"))).alias("l"))
    return texts.select(*page, F.col("t").alias(table), "seed", F.array_join(F.transform("l", lambda x: x["e_text"]), " ").alias("caption"))


def trimmed_rows(rows: Column, counts: Column, child_y0: Column) -> Column:
    """How many rows a table keeps: those before the first row (not of the first two) that holds the start of a table
    inside, is at least three times the usual height, and has at most one filled cell; else all. rows: (y0, y1)."""
    heights = F.filter(F.transform(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: r["y1"] - r["y0"]), lambda h: h > 0)
    order = F.array_sort(heights)
    n = F.size(order)
    usual = F.when(n == 0, 0.0).otherwise((F.get(order, F.floor((n - 1) / 2).cast("int")) + F.get(order, F.floor(n / 2).cast("int"))) / 2)
    giant = F.filter(F.transform(rows, lambda r, i: F.when((i >= 2) & child_y0.between(r["y0"], r["y1"]) & (usual > 0) & (r["y1"] - r["y0"] >= 3 * usual) & (F.get(counts, i) <= 1), i)), lambda i: i.isNotNull())
    cut = F.get(giant, F.lit(0))
    return F.when(child_y0.isNull() | (F.size(rows) < 3) | (F.size(rows) != F.size(counts)) | cut.isNull(), F.size(rows)).otherwise(cut)


def continued_tables(tables: DataFrame, doc: str, page: str, table: str) -> DataFrame:
    """(doc, page, table, continuity): tables that run on from page to page. The lowest table of a page and the highest
    of the next link if edges, margins and column counts agree and the next has no caption; a chain has one id, that of
    its first page. Pages of a document are few, so a window over them is small."""
    rows = tables.select(doc, page, table, *BOX, "columns", F.coalesce(F.col("caption"), F.lit("")).alias("caption"))
    own = F.struct(table, *BOX, "columns", "caption")
    ends = rows.groupBy(doc, page).agg(F.max_by(own, F.struct("y1", -F.col(table))).alias("low"), F.min_by(own, F.struct("y0", table)).alias("high"))
    w = Window.partitionBy(doc).orderBy(page)
    pairs = ends.withColumn("next", F.lead("high").over(w)).withColumn("next_page", F.lead(page).over(w))
    a, b = F.col("low"), F.col("next")
    aligned = (F.abs(a["x0"] - b["x0"]) <= 0.08) & (F.abs(a["x1"] - b["x1"]) <= 0.08) & (a["y1"] >= 0.75) & (b["y0"] <= 0.20)
    alike = F.abs(a["columns"] - b["columns"]) / F.greatest(a["columns"], b["columns"], F.lit(1)) <= 0.3
    links = pairs.filter((F.col("next_page") == F.col(page) + 1) & aligned & alike & (b["caption"] == "")).select(doc, F.col(page).alias("p"), a[table].alias("from"), b[table].alias("to"))
    # a link goes on with the chain of the link before it if that ends at the table where this one starts
    v = Window.partitionBy(doc).orderBy("p")
    goes_on = F.coalesce((F.lag("p").over(v) == F.col("p") - 1) & (F.lag("to").over(v) == F.col("from")), F.lit(False))
    chained = links.withColumn("start", F.when(~goes_on, F.col("p")))
    named = chained.withColumn("continuity", F.max("start").over(v.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # the table where a link starts is there already if the link goes on, so no row is made twice
    end = lambda p, t: F.struct(p.alias("page"), F.col(t).alias("table"))
    start, stop = end(F.col("p"), "from"), end(F.col("p") + 1, "to")
    both = named.select(doc, F.explode(F.when(F.col("start").isNull(), F.array(stop)).otherwise(F.array(start, stop))).alias("e"), "continuity")
    return both.select(doc, F.col("e.page").alias(page), F.col("e.table").alias(table), "continuity")


def table_confidence(rows: Column, columns: Column, populated: Column, filled: Column, width: Column, height: Column, captioned: Column) -> Column:
    """How surely a candidate is a table: its size, its filled rows and cells, its extent on the page, its caption.
    populated: rows with two filled cells or more; filled: filled cells."""
    cap = lambda x: F.least(x, F.lit(1.0))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    full_rows, full_cells = populated / F.greatest(rows, F.lit(1)), filled / F.greatest(rows * columns, F.lit(1))
    return F.round(0.25 * cap(rows / 6) + 0.15 * cap(columns / 4) + 0.25 * cap(full_rows) + 0.15 * cap(full_cells / 0.5) + 0.10 * flag((width >= 0.25) & (height >= 0.025)) + 0.10 * flag(captioned), 6)


def cell_counts(text: Column) -> tuple[Column, Column]:
    """(rows with two filled cells or more, filled cells) of a text of lines and tabs."""
    rows = F.transform(F.split(text, r"\r?\n"), lambda l: F.size(F.filter(F.split(l, "\t"), lambda c: F.trim(c) != "")))
    return F.size(F.filter(rows, lambda n: n >= 2)), F.aggregate(rows, F.lit(0), lambda a, n: a + n)


def route_pages(candidates: DataFrame, page: list[str], least: float = TABLE_CONFIDENCE) -> DataFrame:
    """(page keys, confidence, routed): pages with a table candidate (two rows and columns at least) of enough
    confidence; a page without any has 0."""
    fit = (F.col("rows") >= 2) & (F.col("columns") >= 2)
    out = candidates.groupBy(*page).agg(F.coalesce(F.max(F.when(fit, F.col("confidence"))), F.lit(0.0)).alias("confidence"))
    return out.withColumn("routed", F.col("confidence") >= least)


def visual_mode(chars: Column, raster: Column, tables: Column) -> Column:
    """replace: a scan; enrich: a visual page with little text and no table; else none."""
    return F.when((chars < SCAN_CHARS) & (raster >= SCAN_AREA), "replace").when((chars <= NATIVE_CHARS) & (raster >= VISUAL_AREA) & (tables == 0), "enrich").otherwise("none")


def renumbered(elements: DataFrame, page: list[str], first: Column, tie: str) -> DataFrame:
    """Elements with `reading_order` anew: by y0, then those for which `first` holds, then x0; no box comes last."""
    w = Window.partitionBy(*page).orderBy(F.asc_nulls_last("y0"), F.when(first, 0).otherwise(1), F.asc_nulls_last("x0"), tie)
    return elements.withColumn("reading_order", F.row_number().over(w) - 1)


def merged_tables(baseline: DataFrame, rebuilt: DataFrame, routed: DataFrame, page: list[str], element: str) -> DataFrame:
    """Baseline elements, and on routed pages the rebuilt tables: those shadow the baseline's tables there and the
    elements whose centre they hold. Columns: page, element, type, text, box, shadowed, reading_order."""
    names = [*page, element, "type", "text", *BOX]
    chosen = routed.filter("routed").select(*page)
    tables = rebuilt.join(chosen, page, "left_semi").select(*names, F.lit(True).alias("rebuilt"))
    held = centre_in_box(baseline.select(*names), tables, page, element, element).select(*page, element).distinct().withColumn("held", F.lit(True))
    base = baseline.select(*names).join(chosen.withColumn("on", F.lit(True)), page, "left").join(held, [*page, element], "left")
    dark = F.coalesce(F.col("held"), F.lit(False)) | (F.coalesce(F.col("on"), F.lit(False)) & (F.col("type") == "table"))
    both = base.select(*names, F.lit(False).alias("rebuilt"), dark.alias("shadowed")).unionByName(tables.withColumn("shadowed", F.lit(False)))
    return renumbered(both, page, F.col("rebuilt"), element)
