"""Parser cases, routing quality, audits, gates and validators: scores per row, then one grouped pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.functions import text as TX
from spandrel.operators.geometry import BOX, box, iou

PASS = 0.999
#: Thresholds of the sensitivity sweep, and the least precision, recall and accuracy of a validated router.
THRESHOLDS = (0.50, 0.56, 0.62, 0.68, 0.74)
LEAST = 0.90


# --- parser cases: scores over the text of the selected pages or its elements (arrays within the row) ----------------


def contains(text: Column, term: Column, ready: bool = False) -> Column:
    """Whether a text holds a term, both without white space and case. ready: the text is without them already, as where
    several scores look at the same texts."""
    return F.contains(text if ready else TX.compact(text), TX.compact(term))


def _share(hits: Column) -> Column:
    """Share of true values of an array; none at all is 1."""
    n = F.size(hits)
    return F.when(n > 0, F.size(F.filter(hits, lambda x: x)) / n).otherwise(1.0)


def completeness(text: Column, terms: Column, ready: bool = False) -> Column:
    """Share of the expected terms (or chart values) that are found."""
    return TX.bound(text if ready else TX.compact(text), lambda whole: _share(F.transform(terms, lambda t: F.contains(whole, TX.compact(t)))))


def reading_order(text: Column, terms: Column) -> Column:
    """Share of the pairs of terms that are both found, the earlier one first."""
    later = lambda at, i: F.slice(at, i + 2, F.greatest(F.size(at) - i - 1, F.lit(0)))
    pairs = lambda at: F.flatten(F.transform(at, lambda a, i: F.transform(later(at, i), lambda b: (a > 0) & (b > 0) & (a < b))))
    found = TX.bound(TX.compact(text), lambda whole: F.transform(terms, lambda t: F.call_function("instr", whole, TX.compact(t))))
    return TX.bound(TX.bound(found, pairs), _share)


def typed_elements(elements: Column, expected: Column, ready: bool = False) -> Column:
    """Share of the expected (type, text) that some element has."""
    return _share(F.transform(expected, lambda e: F.exists(elements, lambda x: (x["type"] == e["type"]) & contains(x["text"], e["text"], ready))))


def footnote_anchor(text: Column, elements: Column, anchor: Column, footnote: Column, ready: bool = False) -> Column:
    """Four checks: the anchor and the footnote are found, in this order, and the footnote has its type."""
    whole = text if ready else TX.compact(text)
    a, f = F.call_function("instr", whole, TX.compact(anchor)), F.call_function("instr", whole, TX.compact(footnote))
    typed = F.exists(elements, lambda x: (x["type"] == "footnote") & contains(x["text"], footnote, ready))
    return _share(F.array(a > 0, f > 0, (a > 0) & (f > 0) & (a < f), typed))


def table_structure(elements: Column, anchor: Column, rows: Column, columns: Column, cells: Column, ready: bool = False) -> Column:
    """Checks on the first table (type, text, markdown, row_count, column_count) that holds the anchor: enough rows,
    enough columns, each cell; without such a table 0."""
    either = lambda x, t: contains(x["text"], t, ready) | contains(x["markdown"], t, ready)
    table = F.get(F.filter(elements, lambda x: (x["type"] == "table") & either(x, anchor)), F.lit(0))
    checks = F.concat(F.array(F.coalesce(table["row_count"], F.lit(0)) >= F.coalesce(rows, F.lit(1)), F.coalesce(table["column_count"], F.lit(0)) >= F.coalesce(columns, F.lit(1))), F.transform(cells, lambda c: either(table, c)))
    return F.when(table.isNull(), 0.0).otherwise(_share(checks))


def contamination(text: Column, term: Column, allowed: Column) -> Column:
    """1 while a repeated text occurs no more often than allowed, else allowed / occurrences."""
    t = TX.compact(term)
    whole = TX.compact(text)
    n = F.when(t == "", 0).otherwise((F.length(whole) - F.length(F.replace(whole, t, F.lit("")))) / F.length(t)).cast("long")
    return F.when(n <= allowed, 1.0).otherwise(F.greatest(F.lit(0.0), allowed / n))


def continuity(elements: Column, left: Column, right: Column, linked: Column | None = None, ready: bool = False) -> Column:
    """Three checks on (text, page): both terms are found, on consecutive pages; with `linked`, a fourth."""
    pages = lambda t: F.transform(F.filter(elements, lambda x: contains(x["text"], t, ready)), lambda x: x["page"])
    l, r = pages(left), pages(right)
    checks = [F.size(l) > 0, F.size(r) > 0, F.arrays_overlap(F.transform(l, lambda p: p + 1), r)]
    return _share(F.array(*checks, *([] if linked is None else [linked])))


def visual(elements: Column, kind: Column, least: Column, need_box: Column) -> Column:
    """Two checks: enough elements of a type, and (if needed) one of them has a box (`x0` not null)."""
    own = F.filter(elements, lambda x: x["type"] == kind)
    return _share(F.array(F.size(own) >= F.coalesce(least, F.lit(1)), ~need_box | F.exists(own, lambda x: x["x0"].isNotNull())))


def grounding(elements: Column, target: Column, expected: tuple, ready: bool = False) -> Column:
    """The best overlap of a box (normalized: x0..y1) of an element that holds the target with the expected box; 0 without."""
    over = lambda x: iou(tuple(x[c] for c in BOX), expected)
    hits = F.filter(elements, lambda x: x["x0"].isNotNull() & contains(x["text"], target, ready))
    return F.coalesce(F.array_max(F.transform(hits, over)), F.lit(0.0))


def scored(dimension: Column, scores: dict[str, Column]) -> Column:
    """The score of a case by its dimension; an unknown one is an error."""
    out = F.raise_error(F.concat(F.lit("no such dimension: "), dimension)).cast("double")
    for name, score in scores.items():
        out = F.when(dimension == name, score).otherwise(out)
    return out


def gold_decisions(gold: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Gold rows with their decisions; a gold row without one is an error when it is read."""
    both = gold.join(decisions.withColumn("decided_", F.lit(True)), keys, "left")
    say = F.raise_error(F.concat(F.lit("no decision for "), F.concat_ws("/", *keys))).cast("boolean")
    return both.filter(F.coalesce("decided_", say)).drop("decided_")


def audit_rollup(audits: DataFrame) -> DataFrame:
    """(documents, mean recall, mean precision, elements, shadowed) of audits (recall, precision, elements, shadowed); without
    audits 0 and nulls."""
    return audits.agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg("precision"), 6).alias("mean_precision"), F.sum("elements").alias("elements"), F.sum("shadowed").alias("shadowed"))


def dimension_rollup(cases: DataFrame) -> DataFrame:
    """(dimension, n, mean, pass_rate) of (dimension, score), and a total whose dimension is null: one pass with grouping
    sets. Without rows there is the total alone, with nulls."""
    sets = cases.groupingSets([[F.col("dimension")], []], F.col("dimension"))
    return sets.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.avg(F.when(F.col("score") >= PASS, 1.0).otherwise(0.0)), 6).alias("pass_rate"))


# --- routing ---------------------------------------------------------------------------------------------------------


def confusion(expected: Column, predicted: Column) -> list[Column]:
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return [count(expected & predicted).alias("tp"), count(~expected & predicted).alias("fp"), count(expected & ~predicted).alias("fn"), count(~expected & ~predicted).alias("tn")]


def quality(counts: DataFrame) -> DataFrame:
    """`counts` (tp, fp, fn, tn) with precision, recall, f1 (empty denominators give 0) and accuracy (null if empty)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    rows = counts.withColumn("p_", p).withColumn("r_", r)
    p, r = F.col("p_"), F.col("r_")
    out = {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), "accuracy": F.when(tp + fp + fn + tn > 0, (tp + tn) / (tp + fp + fn + tn))}
    return rows.select("*", *(F.round(c, 6).alias(n) for n, c in out.items())).drop("p_", "r_")


def sensitivity(scores: DataFrame, expected: str, confidence: str, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, counts, quality): every threshold in one pass; rows are repeated inside the task and summed there."""
    rows = scores.select(expected, confidence, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return quality(rows.groupBy("threshold").agg(*confusion(F.col(expected), F.col(confidence) >= F.col("threshold"))))


# --- audits ----------------------------------------------------------------------------------------------------------


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("shared", "a", "b")]))
def multiset_overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """(characters that two texts share, each as often as in the text that has fewer; characters of a; of b). Spark has no
    such function, and exploding characters would shuffle every one of them. One pair of texts at a time is taken out of the
    batch."""
    rows = [shared_characters(x.as_py() or "", y.as_py() or "") for x, y in zip(a, b, strict=True)]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["shared", "a", "b"])


def shared_characters(a: str, b: str) -> tuple[int, int, int]:
    (x, n), (y, m) = (np.unique(np.frombuffer(t.encode("utf-32-le"), "<u4"), return_counts=True) for t in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum()), len(a), len(b)


def overlap_rates(a: Column, b: Column) -> tuple[Column, Column]:
    """(recall, precision) of text b against a, without white space; an empty text gives 1."""
    n = multiset_overlap(TX.compact(a, lower=False), TX.compact(b, lower=False))
    rate = lambda t: F.round(F.when(n[t] > 0, n["shared"] / n[t]).otherwise(1.0), 6)
    return rate("a"), rate("b")


# --- gates -----------------------------------------------------------------------------------------------------------


def threshold_gates(metrics: DataFrame, names: tuple[str, ...] = ("precision", "recall", "accuracy"), least: float = LEAST) -> DataFrame:
    """(gate, value, passed) a metric, and (all, null, passed): PASS only if every metric reaches its least value."""
    ok = {n: F.coalesce(F.col(n) >= least, F.lit(False)) for n in names}
    every = F.lit(True)
    for c in ok.values():
        every = every & c
    gate = lambda n, v, c: F.struct(F.lit(n).alias("gate"), v.cast("double").alias("value"), c.alias("passed"))
    return metrics.select(F.explode(F.array(*(gate(n, F.col(n), c) for n, c in ok.items()), gate("all", F.lit(None), every))).alias("g")).select("g.*")


def promotion(pair: DataFrame, metrics: tuple[str, ...], least_questions: int, eligible: bool = True) -> DataFrame:
    """One row (delta_<metric>, no_regression, improves, enough, recommendation) from a row (base_<metric>, cand_<metric>,
    base_questions, cand_questions); a missing side (null count) is PENDING."""
    delta = {m: F.round(F.col(f"cand_{m}") - F.col(f"base_{m}"), 6) for m in metrics}
    rows = pair.select("*", *(c.alias(f"delta_{m}") for m, c in delta.items()))
    no_regression, improves = F.lit(True), F.lit(False)
    for m in metrics:
        no_regression, improves = no_regression & (F.col(f"delta_{m}") >= 0), improves | (F.col(f"delta_{m}") > 0)
    n, k = F.col("base_questions"), F.col("cand_questions")
    enough = (n >= least_questions) & (k >= least_questions) & (n == k)
    rows = rows.select(*(f"delta_{m}" for m in metrics), no_regression.alias("no_regression"), improves.alias("improves"), enough.alias("enough"), (n.isNull() | k.isNull()).alias("missing"))
    go = F.col("no_regression") & F.col("improves") & F.col("enough")
    word = F.when(F.col("missing"), "PENDING").when(F.lit(not eligible), "NOT-PROMOTION-EVIDENCE").when(go, "GO").otherwise("NO-GO")
    return rows.select(*(f"delta_{m}" for m in metrics), "no_regression", "improves", "enough", word.alias("recommendation"))


def best_variant(variants: DataFrame, current: DataFrame, name: str = "retriever") -> DataFrame:
    """The variant of the highest (mrr, recall, name) among those that do not fall behind the one row of `current` in
    answer and citation rate. Both are summaries of a few rows, so the one row is broadcast."""
    least = current.agg(F.max("answer").alias("least_answer"), F.max("citation").alias("least_citation"))
    fit = variants.join(F.broadcast(least), (F.col("answer") >= F.col("least_answer")) & (F.col("citation") >= F.col("least_citation")))
    return fit.orderBy(F.desc("mrr"), F.desc("recall"), F.desc(name)).limit(1).select(variants.columns)


# --- validators ------------------------------------------------------------------------------------------------------


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(violation, n): for every rule how many rows break it (a null condition breaks none); one pass over the rows."""
    counts = rows.agg(*(F.sum(F.when(c, 1).otherwise(0)).alias(f"n{i}") for i, c in enumerate(rules.values())))
    pairs = F.array(*(F.struct(F.lit(n).alias("violation"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("n")) for i, n in enumerate(rules)))
    return counts.select(F.explode(pairs).alias("v")).select("v.*")


def duplicates(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(violation, n): how many keys occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.when(F.col("c") > 1, 1).otherwise(0)), F.lit(0)).alias("n")).select(F.lit(name).alias("violation"), "n")


def set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(violation, n): keys only in a, only in b, and repeated in a; equal sets without repeats have zeros. One grouped
    pass over both."""
    both = a.select(*keys, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(*keys, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    each = both.groupBy(*keys).agg(F.sum("in_a").alias("na"), F.sum("in_b").alias("nb"))
    return violations(each, {"only_left": (F.col("na") > 0) & (F.col("nb") == 0), "only_right": (F.col("nb") > 0) & (F.col("na") == 0), "repeated": F.col("na") > 1})


def same_rows(published: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(side, n): rows of either table that the other does not have as often; a verified artefact has none."""
    lost = published.exceptAll(recomputed).select(F.lit("published only").alias("side"))
    new = recomputed.exceptAll(published).select(F.lit("recomputed only").alias("side"))
    return lost.unionByName(new).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def table_cases(cases: DataFrame, tables: DataFrame, documents: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """(case_id, doc, score, candidates): how well a case's box is met by the tables of its document that match the case.

    cases: (case_id, doc, pages: array, anchor, cells: array, bx0..by1); tables: (doc, page, text, markdown, caption,
    shadowed, x0..y1), boxes over the page's size; documents: (doc). A table matches if the anchor is in its text, its
    markdown or its caption, or if it holds two of the cells (the only one, if there is one); all without white space and
    case. No pages mean any page. Shadowed tables and tables without a box do not count; without a match the score is 0.
    Cases of unknown documents are left out; a null anchor or cell matches nothing.

    Cases meet tables by document and page, and what makes them match is a condition of the join: pairs that fail it are
    never rows. A case that names no page meets the pages that its document has tables on.
    """
    known = cases.join(documents.select(doc).distinct(), doc, "left_semi")
    named = known.filter(F.size(F.coalesce("pages", F.array().cast("array<int>"))) > 0).withColumn("on", F.explode(F.array_distinct("pages")))
    pages = tables.select(doc, F.col(page).alias("on")).distinct()
    anywhere = known.filter(F.size(F.coalesce("pages", F.array().cast("array<int>"))) == 0).join(pages, doc)
    asked = named.select("case_id", doc, "on", "anchor", "cells", "bx0", "by0", "bx1", "by1").unionByName(anywhere.select("case_id", doc, "on", "anchor", "cells", "bx0", "by0", "bx1", "by1"))
    asked = asked.withColumns({"anchor": F.when(F.col("anchor").isNotNull(), TX.compact(F.col("anchor"))), "cells": F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: F.when(c.isNotNull(), TX.compact(c)))})
    own = tables.filter(~F.coalesce("shadowed", F.lit(False)) & F.col("x0").isNotNull()).select(F.col(doc).alias("of"), F.col(page).alias("at"), TX.compact(F.concat_ws("\n", F.coalesce("text", F.lit("")), F.coalesce("markdown", F.lit("")))).alias("body"), TX.compact(F.col("caption")).alias("above"), *BOX)
    held = F.size(F.filter("cells", lambda c: F.contains(F.col("body"), c)))
    match = F.coalesce(F.contains("body", F.col("anchor")) | F.contains("above", F.col("anchor")), F.lit(False)) | ((F.size("cells") > 0) & (held >= F.least(F.lit(2), F.size("cells"))))
    met = asked.join(own, (F.col(doc) == F.col("of")) & (F.col("on") == F.col("at")) & match)
    best = met.groupBy("case_id", doc).agg(F.max(iou(box(), box("b"))).alias("best"), F.count(F.lit(1)).alias("n"))
    rows = known.select("case_id", doc).join(best, ["case_id", doc], "left")
    return rows.select("case_id", doc, F.round(F.coalesce("best", F.lit(0.0)), 6).alias("score"), F.coalesce("n", F.lit(0)).alias("candidates"))


def case_summary(scores: DataFrame) -> DataFrame:
    """(case_count, mean_iou): of `table_cases`; the mean is null without cases."""
    return scores.agg(F.count(F.lit(1)).alias("case_count"), F.round(F.avg("score"), 6).alias("mean_iou"))
