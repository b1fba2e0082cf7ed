"""Text functions on columns: canonical forms, character n-grams, sentences, element types."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def to_halfwidth(x: Column | str) -> Column:
    """Unicode NFKC; Spark has no function for it. ASCII is its own form, so such texts stay in the JVM (a worker sees a null
    in their place)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(_nfkc(F.when(x.rlike(r"[^\x00-\x7F]"), x)), x)


def halves(texts: pa.Array) -> pa.Array:
    """to_halfwidth of an Arrow array, for functions over batches: each different text once, ASCII as it is."""
    wide = pc.invert(pc.string_is_ascii(texts)).fill_null(False)
    own = texts.filter(wide).dictionary_encode()
    told = pa.array([unicodedata.normalize("NFKC", x) for x in own.dictionary.to_pylist()], texts.type).take(own.indices)
    return pc.replace_with_mask(texts, wide, told)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _nfkc_each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for values in batches:  # of an iterator, as Spark leaves a call unmade whose input hangs on another call of its own kind
        lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
        yield pa.ListArray.from_arrays(ends, halves(values.flatten()), mask=values.is_null())


def to_halfwidth_each(xs: Column) -> Column:
    """to_halfwidth of every text of an array: one row passes a worker instead of one a text."""
    return _nfkc_each(xs)


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once: a column named inside an inner function would be made anew there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_text(x: Column, ascii_only: bool = False) -> Column:
    """Canonical form, white space collapsed, upper case; an empty text is null."""
    x = x if ascii_only else to_halfwidth(x)
    # a single blank stays as it is
    form = F.upper(F.trim(F.regexp_replace(x, r"(?U)\s{2,}|[\s&&[^ ]]", " ")))
    # inside an array's function nullif would make its text twice
    return bound(form, lambda t: F.when(t != "", t)) if ascii_only else F.nullif(form, F.lit(""))


def compact(x: Column, lower: bool = True) -> Column:
    """All white space dropped."""
    out = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", "")
    return F.lower(out) if lower else out


def answer_form(x: Column) -> Column:
    """Answers compare without white space, separators, percent and currency signs; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)[\s,，。．%％元]", ""))


def ngrams(x: Column, n: int = 2) -> Column:
    """Character n-grams of the compacted text; a shorter text is its own only one, an empty one has none."""
    c = compact(x)
    many = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.length(c) < n, F.array(c)).otherwise(many)


def sentences(x: Column) -> Column:
    """Sentences end after 。！？!?； ; (white space after them goes) or at line ends; blank ones go."""
    parts = F.transform(F.split(x, r"(?U)(?<=[。！？!?；;])\s*|\n+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


#: How captions, footnotes, list items and headings start.
CAPTION = r"^\s*(?:圖|表)\s*[0-9一二三四五六七八九十IVXivx\-–—.]+"
FOOTNOTE = r"^\s*(?:註|注|備註|資料來源|來源)[:：\s]|\(\s*註\s*\d+\s*\)"
LIST = r"^\s*(?:[\-•●▪]|[0-9一二三四五六七八九十]+[.)、．]|[（(][0-9一二三四五六七八九十]+[）)])"
HEADING = r"^\s*(?:第[一二三四五六七八九十百0-9]+[章節篇]|[0-9]+(?:\.[0-9]+)*\s+\S+)"


def classify(x: Column, font_size: Column | None = None, median_size: Column | None = None) -> Column:
    """Element type of a text, first rule wins: caption, footnote, list, heading, large type, paragraph."""
    s = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    n = F.length(s)
    rule = F.when(n == 0, "paragraph").when(s.rlike(f"(?U){CAPTION}") & (n <= 120), "caption").when(s.rlike(f"(?U){FOOTNOTE}") & (n <= 240), "footnote")
    rule = rule.when(s.rlike(f"(?U){LIST}"), "list").when(s.rlike(f"(?U){HEADING}") & (n <= 100), "heading")
    if font_size is not None and median_size is not None:
        rule = rule.when((font_size >= 1.28 * median_size) & (n <= 100), "heading")
    return rule.otherwise("paragraph")
