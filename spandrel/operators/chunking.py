"""Chunkers: folds over a document's elements, inside the row that holds them.

A document's elements come as one array in canonical order (page, then reading order), so no chunker shuffles: state
runs along the array within one row, and rows stay where they were read. A null or empty array has no chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.text import bound, sentences

SIZE, OVERLAP, SECTION = 800, 120, 1800
SPANS = "array<struct<first:int,last:int>>"
PLACED = "array<struct<chunk:int,kind:string>>"


def fixed_chunks(texts: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Spans (first, last) of elements, each with its line end within `size` characters together; a chunk repeats whole
    elements of at least `overlap` characters from the end of the one before it. Elements are never cut: a larger one
    makes a larger chunk, and the first element after a repeat is taken whatever its length."""
    if not 0 <= overlap < size:
        raise ValueError("size > overlap >= 0")
    costs = F.transform(texts, lambda t: F.length(F.coalesce(t, F.lit(""))).cast("long") + 1)
    # ends[i]: characters before element i
    ends = F.aggregate(costs, F.array(F.lit(0).cast("long")), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + c)))

    def fold(e: Column) -> Column:
        span = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))

        def retained(first: Column, i: Column) -> Column:
            if not overlap:
                return i
            return F.greatest(first, F.size(F.filter(e, lambda p: p <= F.get(e, i) - overlap)) - 1)

        def step(acc: Column, i: Column) -> Column:
            full = (acc.first < i) & (F.get(e, i + 1) - F.get(e, acc.first) > size)
            after = F.struct(retained(acc.first, i).cast("int").alias("first"), F.concat(acc.out, F.array(span(acc.first, i - 1))).alias("out"))
            return F.when(full, after).otherwise(acc)

        zero = F.struct(F.lit(0).alias("first"), F.array().cast(SPANS).alias("out"))
        last = F.size(e) - 2
        done = F.aggregate(F.sequence(F.lit(0), last), zero, step, lambda acc: F.concat(acc.out, F.array(span(acc.first, last))))
        return F.when(F.size(e) > 1, done).otherwise(F.array().cast(SPANS))

    return bound(ends, fold)


def span_text(texts: Column, span: Column) -> Column:
    """The text of a chunk: its elements, a line each."""
    return F.array_join(F.slice(texts, span["first"] + 1, span["last"] - span["first"] + 1), "\n", "")


def structure_chunks(elements: Column, most: int = SECTION) -> Column:
    """(chunk, kind) of each element of (type, text, page, continuity, shadowed).

    Tables stand alone, with all tables of their continuity id; a figure takes the caption that follows on its page;
    a footnote joins the chunk being filled or else the one before it; a heading, or more than `most` characters, starts
    a chunk. Shadowed elements have no chunk (-1).
    """
    keyed = F.transform(elements, lambda x: F.when((x["type"] == "table") & ~x["shadowed"], x["continuity"]))

    def fold(x: Column, keys: Column) -> Column:
        state = lambda out, used, pending, length, last: F.struct(out.alias("out"), used.cast("int").alias("used"), pending.cast("int").alias("pending"), length.cast("long").alias("length"), last.cast("int").alias("last"))
        none, nothing = F.lit(-1), F.lit(0)

        def step(a: Column, i: Column) -> Column:
            e, before = F.get(x, i), F.get(x, i - 1)
            put = lambda chunk, kind: F.concat(a.out, F.array(F.struct(chunk.cast("int").alias("chunk"), F.lit(kind).cast("string").alias("kind"))))
            size = F.length(F.coalesce(e["text"], F.lit("")))
            open_ = a.pending >= 0
            # the last chunk in the order of their making: a filled one counts once something follows it
            emitted = F.when(open_, a.pending).otherwise(a["last"])
            whose = F.array_position(keys, e["continuity"]) - 1
            linked = (e["type"] == "table") & e["continuity"].isNotNull() & (whose < i)
            captioned = (i > 0) & (e["type"] == "caption") & (before["type"] == "figure") & ~before["shadowed"] & (before["page"] == e["page"])
            heads = (e["type"] == "heading") | (a.length + size > most)
            return (
                F.when(e["shadowed"], state(put(none, None), a.used, a.pending, a.length, a["last"]))
                .when(linked, state(put(F.get(a.out, whose.cast("int"))["chunk"], "cross-page-table"), a.used, none, nothing, emitted))
                .when(captioned, state(put(a["last"], "figure-caption"), a.used, a.pending, a.length, a["last"]))
                .when(e["type"] == "table", state(put(a.used, "table"), a.used + 1, none, nothing, a.used))
                .when(e["type"] == "figure", state(put(a.used, "figure-caption"), a.used + 1, none, nothing, a.used))
                .when((e["type"] == "footnote") & open_, state(put(a.pending, "text"), a.used, a.pending, a.length + size, a["last"]))
                .when((e["type"] == "footnote") & (a["last"] >= 0), state(put(a["last"], "text"), a.used, a.pending, a.length, a["last"]))
                .when(open_ & ~(heads & (e["type"] != "footnote")), state(put(a.pending, "text"), a.used, a.pending, a.length + size + 1, a["last"]))
                .otherwise(state(put(a.used, "text"), a.used + 1, a.used, size + F.when(e["type"] == "footnote", 0).otherwise(1), emitted))
            )

        zero = state(F.array().cast(PLACED), nothing, none, nothing, none)
        return F.when(F.size(x) > 0, F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), zero, step, lambda a: a.out)).otherwise(F.array().cast(PLACED))

    return bound(F.struct(elements.alias("x"), keyed.alias("k")), lambda s: fold(s["x"], s["k"]))


def section_paths(types: Column, texts: Column, pages: Column) -> Column:
    """For each element the text of the last heading at or before it on its page, else null."""
    at = F.arrays_zip(types.alias("type"), texts.alias("text"), pages.alias("page"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("now"), F.lit(None).cast("long").alias("page"))

    def step(a: Column, e: Column) -> Column:
        now = F.when(e["type"] == "heading", e["text"]).when(a["page"].eqNullSafe(e["page"].cast("long")), a["now"])
        return F.struct(F.concat(a["out"], F.array(now)).alias("out"), now.cast("string").alias("now"), e["page"].cast("long").alias("page"))

    return F.aggregate(at, start, step, lambda a: a["out"])


def level_sections(elements: Column) -> Column:
    """For each element of (level, text, page), level null for other text, its path of headings: a heading closes those
    of its level and deeper ones, and its own path is without it; pages start anew."""
    start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast("array<struct<level:int,text:string>>").alias("open"), F.lit(None).cast("long").alias("page"))

    def step(a: Column, e: Column) -> Column:
        stays = F.when(a["page"].eqNullSafe(e["page"].cast("long")), a["open"]).otherwise(F.array().cast("array<struct<level:int,text:string>>"))
        above = F.when(e["level"].isNotNull(), F.filter(stays, lambda h: h["level"] < e["level"])).otherwise(stays)
        own = F.when(e["level"].isNotNull(), F.array(F.struct(e["level"].cast("int").alias("level"), e["text"].alias("text")))).otherwise(F.array().cast("array<struct<level:int,text:string>>"))
        return F.struct(F.concat(a["out"], F.array(F.transform(above, lambda h: h["text"]))).alias("out"), F.concat(above, own).alias("open"), e["page"].cast("long").alias("page"))

    return F.aggregate(elements, start, step, lambda a: a["out"])


#: Fixed value: what stands for a page that no chunk represents.
PLACEHOLDER = "[page without text]"


def chunk_rows(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chunk_idx, kind, text, pages, section, first_ord, last_ord) from elements (key, ord, page, type, text, section,
    chunk): a chunk's texts a line each, its kind by its tables and figures, and as section the last of its elements' that
    is not null. Elements of one chunk meet; a document's chunks need not."""
    own = placed.filter("chunk >= 0").groupBy(key, F.col("chunk").alias("chunk_idx"))
    tables, figures = F.count_if(F.col("type") == "table"), F.count_if(F.col("type") == "figure")
    texts = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text"))))
    rows = own.agg(
        F.when(tables > 1, "cross-page-table").when(tables == 1, "table").when(figures > 0, "figure-caption").otherwise("text").alias("kind"), F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("text"),
        F.array_sort(F.collect_set("page")).alias("pages"), F.max_by("section", F.when(F.col("section").isNotNull(), F.col("ord"))).alias("section"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"),
    )
    return rows


def page_fallbacks(placed: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, chunk_idx, page, text): a placeholder for each of `pages` (key, page) without a chunk, be it that its elements
    have none or that it has no element at all; numbered on after the document's chunks."""
    every = placed.select(key, "page", "chunk").unionByName(pages.select(key, "page", F.lit(-1).alias("chunk")))
    pages = every.groupBy(key, "page").agg(F.max("chunk").alias("most"))
    used = pages.groupBy(key).agg(F.max("most").alias("used"))
    lost = pages.filter("most < 0").select(key, "page", F.row_number().over(Window.partitionBy(key).orderBy("page")).alias("n"))
    return lost.join(used, key).select(key, (F.col("used") + F.col("n")).cast("int").alias("chunk_idx"), "page", F.lit(PLACEHOLDER).alias("text"))


def sentence_nodes(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sent_idx, chunk_idx, text): the sentences of chunks (key, chunk_idx, text), numbered through the document. Only
    the chunks' counts of sentences meet by document and are summed; the texts meet their sums by chunk."""
    counts = chunks.select(key, "chunk_idx", F.size(sentences(F.col("text"))).alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1))
    placed = chunks.join(counts.select(key, "chunk_idx", F.coalesce(before, F.lit(0)).alias("before")), [key, "chunk_idx"])
    return placed.withColumn("parts", sentences(F.col("text"))).select(key, "chunk_idx", "before", F.posexplode("parts").alias("n", "text")).select(key, (F.col("before") + F.col("n")).cast("int").alias("sent_idx"), "chunk_idx", "text")
