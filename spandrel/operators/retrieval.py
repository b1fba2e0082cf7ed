"""Retrieval and its evaluation: top chunks for questions, evidence among chunks, answers, and what went wrong.

Evidence of a question is a set of conditions on one chunk: its document, a page, pages that it must cover, and terms
that its text must hold. Whether a chunk fulfils them is division: all its conditions must be met by the same chunk. As a
chunk's text and an evidence's terms meet whole in one place, one count of the terms found decides, without a shuffle.
Chunks and evidence meet in blocks in a grid, as in `gram_index`; nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions import text as TX
from spandrel.operators import gram_index
from spandrel.operators.gram_index import TOP, Windows

__all__ = ["TOP", "Windows", "answers", "evidence_in", "extractive_answer", "question_results", "top_chunks"]

#: Chunks, and pieces of evidence, that meet in one row.
CHUNKS, EVIDENCE = 64, 1024


def top_chunks(chunks: DataFrame, questions: DataFrame, k: int = TOP, score: str = "cosine", windows: Windows | None = None, key: str = "doc_id", index: str = "chunk_idx", text: str = "text", q_id: str = "item_id", q_text: str = "text", section: str | None = None) -> DataFrame:
    """(q_id, key, index, score, rank): the k best chunks of every question, ties to smaller key and index; chunks that
    share nothing fill up to k. score: "cosine" or "coverage"; with windows, the windowed score, whose windows start with the
    path of the column `section`, if one is named."""
    indexed = gram_index.index(chunks, windows, key, index, text, section)
    found = gram_index.search(indexed, questions, k, score, windows, q_id, q_text)
    return found.select(q_id, F.col("key").alias(key), F.col("idx").alias(index), "score", "rank")


def evidence_in(chunks: DataFrame, evidence: DataFrame, key: str = "doc_id", index: str = "chunk_idx", text: str = "text", pages: str = "pages", q_id: str = "item_id") -> DataFrame:
    """(q_id, evidence, key, index): the chunks (key, index, text, pages) that fulfil a piece of evidence.

    evidence: (q_id, evidence: its number in the question, document, page, pages, terms). A null document, page or pages
    and a page of 0 ask for nothing; all of `pages` must be among the chunk's; every term must be in its text, both
    without white space, separators and case, so a term without anything else is in every text. Null chunk pages are none.
    """
    own = chunks.select(F.col(key).cast("long").alias("key"), F.col(index).cast("int").alias("idx"), F.coalesce(F.col(pages).cast("array<int>"), F.array().cast("array<int>")).alias("pages"), TX.answer_form(F.col(text)).alias("text"))
    terms = F.array_distinct(F.filter(F.transform(F.coalesce("terms", F.array().cast("array<string>")), TX.answer_form), lambda t: t != ""))
    asked = evidence.select(F.col(q_id).cast("long").alias("item"), F.col("evidence").cast("int").alias("evidence"), F.col("document").cast("long").alias("document"), F.nullif(F.col("page").cast("int"), F.lit(0)).alias("page"), F.col("pages").cast("array<int>").alias("pages"), terms.alias("terms"))
    met = gram_index.dealt(gram_index.rows_in_blocks(own, "block", CHUNKS), gram_index.rows_in_blocks(asked, "asked", EVIDENCE).withColumnRenamed("rows", "conditions"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for i in range(batch.num_rows):
                if (of := batch.column(1)[i].as_py()) not in known:
                    known[of] = _automaton(batch.column(2)[i].as_py())
                rows, needed, automaton = known[of]
                for chunk in batch.column(0)[i].as_py():
                    hits: dict[int, set[int]] = {}
                    if automaton is not None:
                        for _, owners in automaton.iter(chunk["text"]):
                            for e, term in owners:
                                hits.setdefault(e, set()).add(term)
                    full = [e for e, terms in hits.items() if len(terms) == needed[e]] + [e for e, n in enumerate(needed) if not n]
                    out += [(rows[e]["item"], rows[e]["evidence"], chunk["key"], chunk["idx"]) for e in full if _fits(rows[e], chunk)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["item", "evidence", "key", "idx"])

    found = met.select("rows", "asked", "conditions").mapInArrow(run, "item long, evidence int, key long, idx int")
    return found.toDF(q_id, "evidence", key, index)


def _automaton(rows: list[dict]) -> tuple[list[dict], list[int], ahocorasick.Automaton | None]:
    """(evidence, terms that each needs, an automaton whose words know their owners)."""
    where: dict[str, list[tuple[int, int]]] = {}
    for e, row in enumerate(rows):
        for n, term in enumerate(row["terms"]):
            where.setdefault(term, []).append((e, n))
    if not where:
        return rows, [len(r["terms"]) for r in rows], None
    a = ahocorasick.Automaton()
    for term, owners in where.items():
        a.add_word(term, owners)
    a.make_automaton()
    return rows, [len(r["terms"]) for r in rows], a


def _fits(evidence: dict, chunk: dict) -> bool:
    pages = chunk["pages"]
    return (evidence["document"] is None or evidence["document"] == chunk["key"]) and (evidence["page"] is None or evidence["page"] in pages) and all(p in pages for p in evidence["pages"] or ())


def answers(top: DataFrame, chunks: DataFrame, questions: DataFrame, key: str = "doc_id", index: str = "chunk_idx", text: str = "text", q_id: str = "item_id") -> DataFrame:
    """(q_id, answer): what each question's `pattern` finds, by its `operation` (null: the first match), in the texts of its
    ranked chunks, one below the other; null for questions that are `unanswerable`."""
    texts = top.select(q_id, key, index, "rank").join(chunks.select(F.col(key), F.col(index), F.coalesce(text, F.lit("")).alias("of")), [key, index])
    joined = texts.groupBy(q_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "of"))), lambda x: x["of"]), "\n").alias("retrieved"))  # k texts a question
    rows = questions.select(q_id, "pattern", "operation", "unanswerable").join(joined, q_id, "left")
    answer = extractive_answer(F.coalesce("retrieved", F.lit("")), F.col("pattern"), F.coalesce("operation", F.lit("first")))
    return rows.select(q_id, F.when(~F.coalesce("unanswerable", F.lit(False)), answer).alias("answer"))


def question_results(top: DataFrame, found: DataFrame, chunks: DataFrame, questions: DataFrame, answered: DataFrame, key: str = "doc_id", index: str = "chunk_idx", text: str = "text", q_id: str = "item_id") -> DataFrame:
    """(q_id, answer, recall, rr, correct, citation_valid, error_source) of every question.

    top: ranked chunks; found: `evidence_in`; answered: (q_id, answer); questions: (q_id, n_evidence, mode, unanswerable,
    accepted: array, operation). Evidence mode "any" (or null) needs one piece of evidence among the ranked, "all" each of
    them: the reciprocal rank is that of the first, or of the last first one. An answer is right if it is accepted, found
    by evidence or not; an unanswerable question is right without one. A right answer is cited if its evidence was
    retrieved and, but for sums, some retrieved chunk with evidence holds the answer's text.
    """
    ranked = top.join(found, [q_id, key, index])
    first = ranked.groupBy(q_id, "evidence").agg(F.min("rank").alias("first"))
    ranks = first.groupBy(q_id).agg(F.min("first").alias("any_rank"), F.max("first").alias("all_rank"), F.count(F.lit(1)).alias("n_ranked"))
    corpus = found.groupBy(q_id, "evidence").agg(F.count(F.lit(1)).alias("n")).groupBy(q_id).agg(F.count(F.lit(1)).alias("n_found"))
    texts = ranked.select(q_id, key, index).distinct().join(chunks.select(key, index, F.col(text).alias("of")), [key, index])
    literal = texts.join(answered, q_id).groupBy(q_id).agg(F.bool_or(F.contains(TX.answer_form(F.col("of")), TX.answer_form(F.col("answer")))).alias("literal"))
    rows = questions.join(answered, q_id, "left").join(ranks, q_id, "left").join(corpus, q_id, "left").join(literal, q_id, "left")
    mode = F.coalesce("mode", F.lit("any"))
    every = F.when(mode.isin("any", "all"), mode == "all").otherwise(F.raise_error(F.concat(F.lit("no such evidence mode: "), mode)).cast("boolean"))
    enough = lambda n: F.coalesce((F.col("n_evidence") > 0) & F.when(every, F.col(n) >= F.col("n_evidence")).otherwise(F.col(n) > 0), F.lit(False))
    none = F.coalesce("unanswerable", F.lit(False))
    rows = rows.withColumns({"in_corpus": enough("n_found"), "got": enough("n_ranked"), "none": none, "every": every})
    accepted = F.transform(F.coalesce("accepted", F.array().cast("array<string>")), TX.answer_form)
    rows = rows.withColumn("correct", F.when(F.col("none"), F.col("answer").isNull()).otherwise(F.array_contains(accepted, TX.answer_form(F.col("answer")))))
    rr = F.when(F.col("none"), 1.0).when(~F.col("got"), 0.0).otherwise(1 / F.when(F.col("every"), F.col("all_rank")).otherwise(F.col("any_rank")))
    cited = F.col("correct") & F.col("got") & (F.coalesce(F.col("operation") == "sum", F.lit(False)) | F.coalesce("literal", F.lit(False)))
    source = F.when(F.col("correct"), F.lit(None).cast("string")).when(~F.col("in_corpus"), "parsing").when(~F.col("got"), "retrieval").otherwise("generation")
    return rows.select(q_id, "answer", F.when(F.col("none") | F.col("got"), 1.0).otherwise(0.0).alias("recall"), F.round(rr, 6).alias("rr"), "correct", F.when(F.col("none"), F.col("answer").isNull()).otherwise(cited).alias("citation_valid"), source.alias("error_source"))


def answer_group(pattern: Column) -> Column:
    """The number of the pattern's group `answer`, 0 (the whole match) if it has none: one more than the groups that begin
    before it."""
    named = F.locate("(?P<answer>", pattern)
    before = F.left(pattern, named - 1)
    return F.when(named > 0, F.regexp_count(before, F.lit(r"(?<!\\)\((?!\?)|\(\?P<")) + 1).otherwise(0)


def extractive_answer(text: Column, pattern: Column, operation: Column, group: Column | int | None = None) -> Column:
    """What a pattern finds in the retrieved text: its first match, all distinct ones joined by 、, or the sum of
    distinct ones as decimals; null for none, for a number that cannot be read, and for a null or empty pattern. group: what
    of a match counts, if not the pattern's group `answer`."""
    flags = F.concat(F.lit("(?iumd)"), F.replace(pattern, F.lit("(?P<"), F.lit("(?<")))
    at = answer_group(pattern) if group is None else group if isinstance(group, Column) else F.lit(group)
    found = F.regexp_extract_all(text, flags, at)
    bare = F.array_distinct(F.transform(found, TX.strip))
    numbers = F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"(?U)[,，%\s]", "")))
    total = F.aggregate(F.transform(numbers, lambda x: x.try_cast("decimal(38,10)")), F.lit(0).cast("decimal(38,10)"), lambda a, x: (a + x).cast("decimal(38,10)"))
    whole = F.regexp_replace(F.regexp_replace(total.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    some = F.size(found) > 0
    asked = F.coalesce(pattern, F.lit("")) != ""
    return F.when(~asked | ~some, F.lit(None).cast("string")).when(operation == "first", F.get(bare, F.lit(0))).when(operation == "unique_join", F.array_join(bare, "、")).when(operation == "sum", whole).otherwise(F.raise_error(F.concat(F.lit("no such operation: "), operation)).cast("string"))
