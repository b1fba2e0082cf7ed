"""Promotion gates over metric rows, choice of a variant, and validators of frozen definitions.

Metrics of two sides come as one row with base_ and cand_ columns; a gate is a row (gate, passed), and a decision follows
from all of them. Validators give (violation, n); a valid definition has zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.operators import evaluation as E

#: Least gains of a global promotion, and the question types that must gain.
PARSER_GAIN, TABLE_GAIN, TYPES_GAINED = 0.05, 0.20, 2
EXTERNAL_QUESTIONS = 15
QUESTION_TYPES = ("text", "table_cell", "table_aggregation", "chart", "cross_page", "unanswerable")
ALLOWED_HOSTS = ("commons.wikimedia.org", "upload.wikimedia.org")


def delta(metric: str) -> Column:
    return F.round(F.col(f"cand_{metric}") - F.col(f"base_{metric}"), 6)


def decided(row: DataFrame, gates: dict[str, Column], more: dict[str, Column] | None = None) -> DataFrame:
    """One row (recommendation, the gates, `more`): GO if every gate holds; a gate over a missing metric does not."""
    ok = {n: F.coalesce(c, F.lit(False)) for n, c in gates.items()}
    every = F.lit(True)
    for c in ok.values():
        every = every & c
    return row.select(F.when(every, "GO").otherwise("NO-GO").alias("recommendation"), *(c.alias(n) for n, c in ok.items()), *(c.alias(n) for n, c in (more or {}).items()))


def types_gained(base: DataFrame, cand: DataFrame, kind: str = "type", rate: str = "answer") -> DataFrame:
    """(gained): question types whose rate rose; a type that the baseline lacks counts as zero there."""
    both = cand.select(kind, F.col(rate).alias("c")).join(base.select(kind, F.col(rate).alias("b")), kind, "left")
    return both.agg(F.count_if(F.col("c") > F.coalesce("b", F.lit(0.0))).alias("gained"))


def global_promotion(row: DataFrame) -> DataFrame:
    """From a row (base_, cand_: parser, table, answer, citation, mrr; gained): the five gates, and the narrower pilot of
    routed tables alone."""
    gates = {
        "parser_gain": delta("parser") >= PARSER_GAIN, "table_gain": delta("table") >= TABLE_GAIN, "answer_kept": delta("answer") >= 0, "citation_kept": delta("citation") >= 0, "types_gained": F.col("gained") >= TYPES_GAINED,
    }
    pilot = (delta("table") >= TABLE_GAIN) & (delta("answer") > 0) & (delta("citation") > 0) & (F.col("gained") >= TYPES_GAINED)
    return decided(row, gates, {"pilot": F.when(pilot, "GO").otherwise("NO-GO"), "mrr_delta": delta("mrr")})


def external(row: DataFrame, metrics: tuple[str, ...], questions: int = EXTERNAL_QUESTIONS) -> DataFrame:
    """No metric below the baseline's, and all questions of the set evaluated."""
    return decided(row, {f"{m}_kept": delta(m) >= 0 for m in metrics} | {"all_questions": F.col("cand_questions") == questions}, {f"{m}_delta": delta(m) for m in metrics})


def caption_promotion(row: DataFrame, least: dict[str, float], eligible: bool = True) -> DataFrame:
    """The caption decision from a row (base_recall; cand_: recall, crop_recall, answer, citation, questions, executed):
    retrieval does not fall, pixels were read, and each rate of `least` is reached. Not eligible: a finding, no GO."""
    gates = {"retrieval_kept": delta("recall") >= 0, "executed": F.col("cand_executed")} | {m: F.coalesce(F.col(f"cand_{m}"), F.lit(0)) >= v for m, v in least.items()}
    done = decided(row, gates, {"recall_delta": delta("recall")})
    finding = F.when(F.col("recommendation") == "GO", "SUPPORTS").otherwise("DOES-NOT-SUPPORT")
    return done if eligible else done.withColumn("finding", finding).withColumn("recommendation", F.lit("NOT-PROMOTION-EVIDENCE"))


def comparator(row: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """A comparison that never promotes: (recommendation, finding, deltas); PENDING while a side is missing."""
    missing, regress = F.lit(False), F.lit(False)
    for m in metrics:
        missing, regress = missing | delta(m).isNull(), regress | (delta(m) < 0)
    finding = F.when(~missing, F.when(regress, "REGRESSES").otherwise("MATCHES-OR-IMPROVES"))
    return row.select(F.when(missing, "PENDING").otherwise("DESCRIPTIVE-ONLY").alias("recommendation"), finding.alias("finding"), *(delta(m).alias(f"{m}_delta") for m in metrics))


def factors(parsers: DataFrame, chunkings: DataFrame) -> DataFrame:
    """(factor, parser, chunking, status, reason): one factor changed at a time, every parser under the first chunking and
    the first parser under every chunking; a parser that is unavailable (a reason) makes its factors skipped. Both tables
    (name, place; parsers also reason) are short lists, so the product is small."""
    p, c = parsers.select(F.col("name").alias("parser"), F.col("place").alias("p"), "reason"), chunkings.select(F.col("name").alias("chunking"), F.col("place").alias("c"))
    both = p.join(F.broadcast(c), (F.col("p") == 0) | (F.col("c") == 0))
    return both.select(F.concat_ws("_", "parser", "chunking").alias("factor"), "parser", "chunking", F.when(F.col("reason").isNull(), "completed").otherwise("skipped").alias("status"), "reason")


def missing_types(questions: DataFrame, kind: str = "type", required: tuple[str, ...] = QUESTION_TYPES) -> DataFrame:
    """(missing): required types that no question has."""
    present = questions.agg(F.collect_set(F.when(F.col(kind).isin(*required), F.col(kind))).alias("present"))
    return present.select(F.explode(F.array_except(F.array(*map(F.lit, required)), "present")).alias("missing"))


def question_violations(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """Violations of a frozen question set (question_id, type, mode, unanswerable, answers, pattern, evidence: array of
    (document_id, pages, terms)) whose evidence must lie on the selected `pages` (document_id, page)."""
    none = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    asked = ~F.coalesce(F.col("unanswerable"), F.lit(False))
    own = E.violations(questions, {
        "mode": ~F.coalesce(F.col("mode"), F.lit("any")).isin("any", "all"), "gold_of_unanswerable": ~asked & ~(none("answers") & none("evidence")), "no_answer": asked & none("answers"), "no_pattern": asked & (F.coalesce(F.col("pattern"), F.lit("")) == ""), "no_evidence": asked & none("evidence"),
        "no_terms": asked & F.exists("evidence", lambda e: none(e["terms"])), "no_pages": asked & F.exists("evidence", lambda e: none(e["pages"])),
    })
    cited = questions.filter(asked).select(F.explode("evidence").alias("e")).select(F.col("e.document_id").alias("document_id"), F.explode("e.pages").alias("page"))
    loose = cited.join(pages.select("document_id", "page").distinct(), ["document_id", "page"], "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("page_not_selected").alias("violation"), "n")
    gaps = missing_types(questions).agg(F.count(F.lit(1)).alias("n")).select(F.lit("types_missing").alias("violation"), "n")
    return own.unionByName(E.duplicates(questions, ["question_id"], "repeated_id")).unionByName(loose).unionByName(gaps)


def router_violations(pages: DataFrame, gold: DataFrame, router: Column) -> DataFrame:
    """Violations of a frozen routing set: gold (document_id, page, should_route, version, threshold) covers the selected
    `pages` once each, has both kinds, and is frozen to the `router`, a struct (version, threshold)."""
    sets = E.set_difference(gold, pages, ["document_id", "page"])
    frozen = E.violations(gold, {"other_router": (F.col("version") != router["version"]) | (F.col("threshold") != router["threshold"])})
    kinds = gold.agg(F.count_if("should_route").alias("yes"), F.count_if(~F.col("should_route")).alias("no"))
    both = E.violations(kinds, {"no_positive": F.col("yes") == 0, "no_negative": F.col("no") == 0})
    return sets.unionByName(frozen).unionByName(both)


def protocol_violations(protocol: DataFrame) -> DataFrame:
    """Violations of promotion protocols (role, freeze_status, disclosure, version, manifest_version, overlap)."""
    known = F.col("role").isin("promotion", "scale-validation")
    frozen = F.when(F.col("role") == "promotion", "frozen-before-predictions").otherwise("frozen-before-scoring")
    return E.violations(protocol, {
        "role": ~F.coalesce(known, F.lit(False)), "freeze_status": ~F.col("freeze_status").eqNullSafe(frozen), "undisclosed": (F.col("role") == "scale-validation") & (F.coalesce(F.col("disclosure"), F.lit("")) == ""),
        "version": ~F.col("version").eqNullSafe(F.col("manifest_version")), "overlap": ~F.col("overlap").eqNullSafe(F.lit(0)),
    })


def manifest_violations(items: DataFrame, hosts: tuple[str, ...] = ALLOWED_HOSTS) -> DataFrame:
    """Violations of a public manifest (filename, label_file, url, sha256, author, license, personal, review)."""
    part = lambda p: F.try_parse_url("url", F.lit(p))
    plain = part("USERINFO").isNull() & part("QUERY").isNull() & part("REF").isNull()
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    own = E.violations(items, {
        "host": ~F.coalesce((part("PROTOCOL") == "https") & part("HOST").isin(*hosts), F.lit(False)), "url_parts": ~F.coalesce(plain, F.lit(False)), "sha256": ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "source": empty("author") | empty("license"),
        "personal": ~F.col("personal").eqNullSafe(F.lit(False)), "review": ~F.col("review").eqNullSafe(F.lit("human-reviewed")),
    })
    return own.unionByName(E.duplicates(items, ["filename"], "repeated_filename")).unionByName(E.duplicates(items, ["label_file"], "repeated_label_file"))


def artifact_violations(rows: DataFrame, rates: list[str], nullable: list[str], n: str, expected: int, columns: set[str]) -> DataFrame:
    """Violations of a published summary: rates out of 0..1 or missing, other counts than expected, unknown or missing
    columns."""
    bad = lambda c: F.isnan(c) | ~F.col(c).between(0, 1)
    rules = {f"rate_{c}": F.coalesce(bad(c), F.lit(True)) for c in rates} | {f"rate_{c}": bad(c) for c in nullable} | {"count": ~F.col(n).eqNullSafe(F.lit(expected))}
    shape = rows.sparkSession.createDataFrame([("unknown_columns", len(set(rows.columns) - columns)), ("missing_columns", len(columns - set(rows.columns)))], "violation string, n long")
    return E.violations(rows, rules).unionByName(shape)


def checksum_violations(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """Violations of stored bytes (path, content) against a manifest (path, bytes, sha256); both sides are met in full."""
    told = sources.select("path", F.octet_length("content").alias("own_bytes"), F.sha2("content", 256).alias("own_sha"))
    both = manifest.join(told, "path", "left")
    return E.violations(both, {"absent": F.col("own_sha").isNull(), "bytes": F.col("bytes") != F.col("own_bytes"), "sha256": F.col("sha256") != F.col("own_sha")})
