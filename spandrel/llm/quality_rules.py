"""Quality rules as a bitmask ledger, on DataFrame functions only.

Every rule is evaluated once a document; the ledger keeps its measurements and one failure bit a rule. Policies are
versioned masks over those bits, so a new policy, a replay of an old one and an ablation ("which documents does this
rule alone reject?") never read a text again: ablations count bit patterns, of which there are few.

Defined results: a null text has no words; empty and blank texts fail `few_words`; repeated rows are judged each
alone; a text of any length is one row's work, in memory in proportion to it; an empty table has an empty ledger;
columns of the caller's are packed away, so that no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.llm.common import WS, packed, words_of

WINDOW = 8
#: The characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: name -> (bit, condition under which a document fails), all in integers so that every engine agrees.
RULES = {
    "few_words": (0, "n_words < 20"),
    "repeated_words": (1, "100 * n_repeat_words > 30 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "word_length": (3, "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    "duplicate_lines": (4, "100 * n_dup_lines > 30 * n_lines"),
    "shouting": (5, "2 * n_upper > word_chars"),
}
BASE_RULES = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails one of `reject`, or at least `most` of `doubt` together."""

    version: str
    reject: tuple[str, ...]
    doubt: tuple[str, ...] = ()
    most: int = 2


POLICIES = {
    p.version: p
    for p in (
        Policy("base-1", BASE_RULES),
        Policy("corpus-1", (*BASE_RULES, "symbols", "word_length", "duplicate_lines", "shouting")),
        Policy("corpus-2", (*BASE_RULES, "symbols", "duplicate_lines"), ("word_length", "shouting")),
    )
}
DEFAULT = "corpus-1"


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << RULES[n][0] for n in names)


def measured(texts: DataFrame) -> DataFrame:
    """`texts` (with a column `text`) and its measurements, without the text.

    Windows of eight words are compared by a hash of their words; windows of equal hash count as equal only if their
    words are. Only texts with an equal pair pay for the search of the places.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    word_chars = F.length(F.regexp_replace(text, f"[{WS}]+", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    one = texts.select(
        *[c for c in texts.columns if c != "text"],
        words_of(F.col("text")).alias("words"),
        lines.alias("lines"),
        word_chars.cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long").alias("n_upper"),
    )
    two = one.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    ).drop("lines")
    starts = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    # arrays of one bind a value once; a column named inside the inner function would be made anew for each window
    hashed = F.array(F.transform("words", lambda w: F.xxhash64(w)))
    windows = F.get(F.transform(hashed, lambda h: F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, WINDOW)))), F.lit(0))
    three = two.select("*", windows.alias("windows"))
    repeats = F.when(F.size("windows") > F.size(F.array_distinct("windows")), repeat_words()).otherwise(F.lit(0))
    return three.select(*[c for c in three.columns if c not in ("words", "windows")], repeats.cast("long").alias("n_repeat_words"))


def repeat_words() -> Column:
    """Words that windows found twice or more cover, from the columns `words` and `windows`."""
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, b: (a.h == b.h) & (F.slice("words", a.i + 1, WINDOW) == F.slice("words", b.i + 1, WINDOW))

    def places(s: Column) -> Column:
        def place(x: Column, k: Column) -> Column:
            return F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x.i)

        return F.array_sort(F.filter(F.transform(s, place), lambda i: i.isNotNull()))

    found = F.flatten(F.transform(F.array(ordered), places))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    add = lambda a, i: F.struct((a.n + i + WINDOW - F.greatest(i, a.end)).alias("n"), (i + WINDOW).alias("end"))
    return F.aggregate(found, start, add, lambda a: a.n)


def failure_bits() -> Column:
    """All rules' bits, from the measurements."""
    bits = [F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, condition in RULES.values()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("long")


def rejected(policy: Policy, bits: Column) -> Column:
    out = bits.bitwiseAND(F.lit(mask(policy.reject))) != 0
    if policy.doubt:
        out = out | (F.bit_count(bits.bitwiseAND(F.lit(mask(policy.doubt)))) >= policy.most)
    return out


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failure_bits): one row a document, no shuffle."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return measured(texts).withColumn("failure_bits", failure_bits()).withColumnRenamed("id", id_col)


def verdicts(book: DataFrame, version: str = DEFAULT) -> DataFrame:
    """The ledger with `base_failed` and, under the policy, `kept`."""
    bits = F.col("failure_bits")
    base = bits.bitwiseAND(F.lit(mask(BASE_RULES))) != 0
    return book.withColumn("base_failed", base).withColumn("kept", ~base & ~rejected(POLICIES[version], bits))


def ablation(book: DataFrame, version: str = DEFAULT) -> DataFrame:
    """A row for each rule of the policy: documents that fail it, documents that the policy rejects, and documents
    that it would keep without the rule. One grouped count of bit patterns, then bit arithmetic on those."""
    policy = POLICIES[version]
    patterns = book.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    bits = F.col("failure_bits")
    rows = []
    for name in (*policy.reject, *policy.doubt):
        left = Policy("", tuple(x for x in policy.reject if x != name), tuple(x for x in policy.doubt if x != name), policy.most)
        rows.append(F.struct(F.lit(name).alias("rule"), (bits.bitwiseAND(F.lit(mask((name,)))) != 0).alias("fails"), rejected(policy, bits).alias("out"), (rejected(policy, bits) & ~rejected(left, bits)).alias("alone")))
    each = patterns.select("n", F.explode(F.array(*rows)).alias("r"))
    total = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0)))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(total("r.fails").alias("n_failed"), total("r.out").alias("n_rejected"), total("r.alone").alias("n_rejected_alone"))


def keep_documents(docs: DataFrame, version: str = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns; nulls count as empty texts and go. The bits come out
    of a generator of one row: a filter on a plain column would be moved below the projections and measure each text
    again for every rule, and for every word."""
    book = measured(packed(docs, id_col, text_col)).select("row", F.explode(F.array(failure_bits())).alias("failure_bits"))
    return verdicts(book, version).filter("kept").select("row.*")


#: The same in DuckDB: (id, measurements, base_failed, kept, failure_bits) of `documents`.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM t),
p AS (SELECT r, len(words) AS n, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8),
g AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS gram FROM p),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
k AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM d, (SELECT unnest(range(0, 8)) AS o) GROUP BY r),
m AS (SELECT w.r, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN k USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 8 ELSE 0 END
             + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END)::BIGINT AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, failure_bits,
       failure_bits & 3 <> 0 AS base_failed, failure_bits = 0 AS kept FROM b
"""


#: The ablation of the default policy in DuckDB: a rule rejects alone where its bit is the only one.
ABLATION_ORACLE = f"WITH a AS ({ORACLE}) " + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (failure_bits & {1 << bit} <> 0) AS n_failed, count(*) FILTER (failure_bits <> 0) AS n_rejected, count(*) FILTER (failure_bits = {1 << bit}) AS n_rejected_alone FROM a"
    for n, (bit, _) in RULES.items()
)


def report(docs: DataFrame) -> DataFrame:
    """What the query returns: the ledger with the default policy's verdicts."""
    return verdicts(ledger(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "failure_bits", "base_failed", "kept")
