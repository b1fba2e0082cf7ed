"""Spelling variants of words, grouped by letter-parity bitmask bands.

A word's mask has a bit for the parity of each letter's count. One inserted or deleted letter flips one bit, one replaced
letter at most two, so of three bands of the mask at least one is equal in two words that are one edit apart. Words of
equal or neighbouring length that share a band are compared by the masks' distance, then letter by letter.

A band holds few bits, so a band of common letters gathers a share of all words. One edit also leaves either the first
or the second half of a word as it is: words meet on a band together with an equal half, under the length of the shorter
word. A pair that shares several of these is compared under the first of them only. Comparison is a part of the join, so
that pairs which fail it are never rows. Where more than FRAME words still share a band and a half, they meet on what
is left of the other half after one deletion, which only words one edit apart have in common.

Words are counted before anything is shuffled by word. A word's form has at least RATIO times its count, so chains of
forms have at most log(count) links, and doubling finds their ends in a few joins.

Defined results: null, empty and blank texts have no words; rows without an id count, their words whole; repeated rows
count again; ties of forms go to the smallest word in code-point order; a text of any length is one row's work; an
empty table has no words. Further columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.llm.common import staged

#: What a run of letters is, and the least size and count of a word.
LETTERS, LEAST_CHARS, LEAST_N = r"[A-Za-zÀ-ÿ]", 6, 5
#: One run in so many loses a letter.
EVERY = 199
#: How many times more often a form occurs than its variant.
RATIO = 5
BANDS, BAND = 3, 21
#: Words of one band and half that are compared with each other; more of them are split further.
FRAME = 1024
KEY = ["shorter", "way", "value", "part"]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, every: int = EVERY) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough. One run in `every`, chosen by the checksum of
    `<id>:<run>`, loses the letter that the checksum points at."""
    # a shorter run cannot become a word, so it is not read at all
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def parity_mask(word: Column) -> Column:
    """BANDS * BAND bits: bit b is the parity of the letters that belong to it; neighbouring letters go to other bands."""
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % BANDS * BAND + F.floor(F.ascii(c) / BANDS) % BAND).cast("int"))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda mask, c: F.when(c == "", mask).otherwise(mask.bitwiseXOR(one(c))))


def _band(mask: Column, band: Column) -> Column:
    return F.call_function("shiftrightunsigned", mask, (band * BAND).cast("int")).bitwiseAND(F.lit((1 << BAND) - 1))


def signatures(words: DataFrame) -> DataFrame:
    """`words` with where each is filed: `shorter`, the length of the shorter of two words that meet there; `way`, which
    band (way % BANDS) and which half (way >= BANDS: the second); the band's value, and the half (part) itself."""
    masked = words.withColumn("long", F.length("word")).withColumn("mask", parity_mask(F.col("word")))
    filed = masked.withColumn("shorter", F.explode(F.array(F.col("long"), F.col("long") - 1))).filter("shorter > 0")
    filed = filed.withColumn("way", F.explode(F.array(*map(F.lit, range(2 * BANDS)))))
    part = F.when(F.col("way") < BANDS, F.left("word", _first("shorter"))).otherwise(F.right("word", F.col("shorter") - _first("shorter")))
    return filed.select("word", "n", "long", "mask", "shorter", "way", _band(F.col("mask"), F.col("way") % BANDS).alias("value"), part.alias("part"))


def _first(length: str) -> Column:
    """Letters of the first half."""
    return F.floor(F.col(length) / 2).cast("int")


def _met(filed: DataFrame, keys: list[str]) -> DataFrame:
    """(word, n, other, other_n) with word < other: words that meet on `keys` and are one edit apart."""
    a, b = filed.alias("a"), filed.alias("b")
    both = lambda c: (F.col(f"a.{c}"), F.col(f"b.{c}"))
    (word, other), (mask, mask2), (long, long2) = both("word"), both("mask"), both("long")
    flips = mask.bitwiseXOR(mask2)
    half = (F.col("a.shorter") / 2).cast("int")
    # the first way on which the two meet: no earlier band is equal, and for a second half the first ones differ
    first = (F.col("a.way") < BANDS) | (F.left(word, half) != F.left(other, half))
    for band in range(BANDS - 1):
        first &= (F.col("a.way") % BANDS <= band) | (_band(flips, F.lit(band)) != 0)
    near = (F.bit_count(flips) <= 2) & (F.least(long, long2) == F.col("a.shorter")) & (word < other) & first & (F.levenshtein(word, other, 1) == 1)
    on = near
    for key in keys:
        on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & on
    return a.join(b, on).select(word.alias("word"), F.col("a.n").alias("n"), other.alias("other"), F.col("b.n").alias("other_n"))


def near_words(words: DataFrame, frame: int = FRAME) -> DataFrame:
    """(word, n, other, other_n) with word < other: all pairs of `words` (word, n; each word once) that differ by
    exactly one inserted, deleted or replaced letter, once each."""
    filed = signatures(words)
    crowded = staged(filed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > frame), "crowded")
    if crowded.isEmpty():
        return _met(filed, KEY)
    keys = crowded.select(*KEY)
    rest = F.when(F.col("way") < BANDS, F.substring("word", F.length("part") + 1, F.col("long"))).otherwise(F.left("word", F.col("long") - F.length("part")))
    dense = filed.join(keys, KEY, "left_semi").withColumn("rest", rest)
    without = F.transform(F.sequence(F.lit(0), F.length("rest") - 1), lambda i: F.concat(F.left("rest", i), F.substring("rest", i + 2, F.length("rest"))))
    dense = dense.withColumn("left", F.explode(F.array_distinct(F.array_append(F.when(F.length("rest") > 0, without).otherwise(F.array().cast("array<string>")), F.col("rest")))))
    return _met(filed.join(keys, KEY, "left_anti"), KEY).unionByName(_met(dense, [*KEY, "left"]).distinct())


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of `forms` (word, form), each once: where its chain of forms ends. Chains have no
    loops, as counts grow along them."""
    ends = forms.select("word", F.col("form").alias("root"))
    while True:
        ends = staged(ends, "roots")
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = ends.join(further, "root").select("word", "next")
        if moved.isEmpty():
            return ends
        ends = ends.join(moved, "word", "left").select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME, **limits: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary. form: the near word that occurs most often,
    if that is at least RATIO times as often; root: the end of the chain of forms, or the word itself."""
    words = staged(vocabulary(docs, id_col, text_col, **limits), "vocabulary")
    pairs = near_words(words, frame)
    sides = F.array(F.struct("word", "n", F.col("other").alias("form"), F.col("other_n").alias("form_n")), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("form"), F.col("n").alias("form_n")))
    linked = pairs.select(F.explode(sides).alias("x")).select("x.*")
    best = linked.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("rank"), "form")).alias("best"))
    best = staged(best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.rank")).alias("form_n")), "near-words")
    enough = F.col("form_n") >= RATIO * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    rows = staged(rows, "forms")
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The checksum in SQL: the table of 256 entries by its rule, then byte by byte; letters here have one or two bytes.
ORACLE = """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS MATERIALIZED (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, times, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [195::UBIGINT, (unicode(c) - 64)::UBIGINT] END
    FOR c IN string_split(doc_id::VARCHAR || ':' || run, '')]) AS b FROM runs),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x: xor(c // 256, t[(xor(c, x) % 256 + 1)::BIGINT])), 4294967295::UBIGINT) AS h FROM bytes, crc),
cut AS (
  SELECT times, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
deleted AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM deleted a JOIN deleted b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT d.word, w.word FROM deleted d JOIN words w ON d.rest = w.word
  UNION SELECT w.word, d.word FROM deleted d JOIN words w ON d.rest = w.word),
best AS (
  SELECT near.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS form, first(o.n ORDER BY o.n DESC, o.word) AS form_n
  FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain(word, tip, form) AS (
  SELECT word, word, form FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.form)
SELECT f.word, f.form, c.tip AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
