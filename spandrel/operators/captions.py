"""Captions of charts in the index: which chunk they hang on, what is indexed under each mode, and answers from crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions import text as TX
from spandrel.operators import gram_index

MODES = ("no_image_indexing", "generic_caption", "structured_caption", "structured_caption_original_crop")


def known_mode(mode: Column) -> Column:
    """The mode, or an error if it is none."""
    return F.when(mode.isin(*MODES), mode).otherwise(F.raise_error(F.concat(F.lit("no such mode of caption indexing: "), mode)).cast("string"))


def caption_chunks(base: DataFrame, captions: DataFrame, modes: DataFrame) -> DataFrame:
    """(doc_id, chunk_idx, figure_id, mode, text, crop_ref): what each mode of `modes` (mode) indexes for `captions` (doc_id,
    page, figure_id, generic, structured, crop_ref), on the first chunk of `base` (doc_id, chunk_idx, pages) that covers the
    page. Captions of pages without a chunk are passed over; the first mode indexes nothing. Modes are few."""
    covering = base.select("doc_id", F.explode("pages").alias("page"), "chunk_idx").groupBy("doc_id", "page").agg(F.min("chunk_idx").alias("chunk_idx"))
    on = captions.join(covering, ["doc_id", "page"])
    each = on.join(F.broadcast(modes.select(known_mode(F.col("mode")).alias("mode"))), F.lit(True)).filter(F.col("mode") != MODES[0])
    return each.select("doc_id", "chunk_idx", "figure_id", "mode", F.when(F.col("mode") == MODES[1], F.col("generic")).otherwise(F.col("structured")).alias("text"), "crop_ref")


def with_crop(hits: DataFrame) -> DataFrame:
    """Retrieved captions may be answered from their original crop only: a hit without one is an error."""
    return hits.withColumn("crop_ref", F.coalesce("crop_ref", F.raise_error(F.lit("a retrieved caption has no original crop")).cast("string")))


def rescored(results: DataFrame) -> DataFrame:
    """Results (item_id, expected, retrieved: arrays of chunk ids; answer: recorded from the crop; answers: accepted) anew:
    an answer counts only if an expected chunk was retrieved, and is right if it contains an accepted one."""
    hit = F.arrays_overlap("expected", "retrieved")
    said = TX.answer_form(F.when(F.col("hit"), F.col("answer")))
    right = F.col("hit") & TX.bound(said, lambda s: F.exists("answers", lambda a: F.contains(s, TX.answer_form(a))))
    rows = results.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("correct", F.coalesce(right, F.lit(False)))
    return rows.select("item_id", "hit", "correct", F.when(~F.col("correct"), F.when(F.col("hit"), "generation").otherwise("retrieval")).alias("error_source"))


def rescored_rates(rows: DataFrame) -> DataFrame:
    """(n, crop_recall, answer, citation, retrieval_errors, generation_errors); rates are null without rows."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return rows.agg(F.count(F.lit(1)).alias("n"), rate("hit").alias("crop_recall"), rate("correct").alias("answer"), rate("correct").alias("citation"), F.count_if(F.col("error_source") == "retrieval").alias("retrieval_errors"), F.count_if(F.col("error_source") == "generation").alias("generation_errors"))


#: Added to the document's number in the keys of caption rows: captions come after all chunks, as if appended to the index.
APPENDED = 1 << 48
#: Bits of the modes, in their order: which of them index a chunk, a generic and a structured caption.
OF_CHUNK, OF_GENERIC, OF_STRUCTURED = 0b1111, 0b0010, 0b1100


def ablation(chunks: DataFrame, captions: DataFrame, questions: DataFrame, k: int = gram_index.TOP) -> DataFrame:
    """(mode, item_id, rank, doc_id, chunk_idx, is_caption, score): the k best of each mode's index for every question that a
    caption aims at, by one pass over one index of `chunks` (doc_id, chunk_idx, text, pages) and `captions` (as
    `caption_chunks` takes them, numbered by `chunk` within their document, with question_ids).

    A caption hangs on the first chunk of its document that covers its page, and is left out if there is none. Captions come
    after all chunks among equal scores."""
    covered = chunks.select("doc_id", F.explode("pages").alias("page")).distinct()
    on = captions.join(covered, ["doc_id", "page"], "left_semi")
    key = (F.col("doc_id").cast("long") + APPENDED).alias("doc_id")
    row = lambda text, bits: on.select(key, (F.col("chunk") * 2 + bits // OF_STRUCTURED).cast("int").alias("chunk_idx"), F.col(text).alias("text"), F.lit(bits).alias("bits"))
    rows = chunks.select(F.col("doc_id").cast("long"), F.col("chunk_idx").cast("int"), "text", F.lit(OF_CHUNK).alias("bits")).unionByName(row("generic", OF_GENERIC)).unionByName(row("structured", OF_STRUCTURED))
    aimed = questions.join(captions.select(F.explode("question_ids").alias("item_id")).distinct(), "item_id", "left_semi")
    top = gram_index.search(gram_index.index(rows, variants="bits"), aimed, k, variants=len(MODES))
    mode = F.get(F.array(*map(F.lit, MODES)), F.col("variant"))
    return top.select(mode.alias("mode"), "item_id", "rank", (F.col("key") % APPENDED).alias("doc_id"), F.when(F.col("key") >= APPENDED, F.floor(F.col("idx") / 2)).otherwise(F.col("idx")).cast("int").alias("chunk_idx"), (F.col("key") >= APPENDED).alias("is_caption"), "score")
