"""Canonical forms of receipt fields and their comparison, on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spandrel.functions.text import bound, normalize_text, strip, to_halfwidth

#: Joins texts that travel as one; a control character, so that texts do not hold it.
SEPARATOR = "\x1f"
#: Patterns and weights of the formats.
DMY = r"(\d{1,2})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{4})"
YMD = r"(\d{2,4})\s*[年/\-.]\s*(\d{1,2})\s*[月/\-.]\s*(\d{1,2})\s*日?"
CURRENCY = r"(?i)NT\$|NTD|TWD|RM|MYR|新台幣|新臺幣|\$|元|圓"
BOX_CURRENCY = r"(?i)^(NT\$|NTD|TWD|RM|MYR|\$)\s*"
BOX_AMOUNT = r"(?U)^-?\d{1,3}(,\d{3})*(\.\d+)?$|^-?\d+(\.\d+)?$"
PLAIN_AMOUNT = r"^-?(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)(?:\.[0-9]+)?\z"
DOC_TYPES = ("e_invoice", "receipt")
TAX_WEIGHTS = (1, 2, 1, 2, 1, 2, 4, 1)
CORPUS_DATES = ("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yy", "dd MMM yyyy", "yyyyMMdd")


def date(x: Column, ascii_only: bool = False) -> Column:
    """yyyy-MM-dd of a date in western or republican years, separated or run together, full width or not; null if it is
    no date of 1990 to 2100. A four-digit year at the end beats one at the start. `ascii_only` is for texts that have
    been brought to half width already, as inside arrays."""

    def written(s: Column) -> Column:
        """The date's parts as year-month-day."""
        digits = F.regexp_replace(s, r"\D", "")
        pick = lambda p, order: F.regexp_replace(F.regexp_extract(s, p, 0), p, order)
        part = lambda *cuts: F.concat_ws("-", *(F.substring(digits, a, n) for a, n in cuts))
        return (
            F.when(s.rlike(DMY), pick(DMY, "$3-$2-$1")).when(s.rlike(YMD), pick(YMD, "$1-$2-$3"))
            .when(F.length(digits) == 8, part((1, 4), (5, 2), (7, 2))).when(F.length(digits) == 7, part((1, 3), (4, 2), (6, 2)))
        )

    def real(parts: Column) -> Column:
        y, m, d = (F.get(parts, F.lit(i)).cast("int") for i in range(3))
        year = F.when(y < 1000, y + 1911).otherwise(y)
        text = F.concat_ws("-", *(F.lpad(c.cast("string"), n, "0") for c, n in ((year, 4), (m, 2), (d, 2))))
        return F.when(year.between(1990, 2100), bound(text, lambda t: F.when(t.try_cast("date").isNotNull(), t)))

    def without_era(s: Column) -> Column:
        return F.when(F.contains(s, F.lit("民國")), F.regexp_replace(s, "中華民國|民國", "")).otherwise(s)

    s = bound(F.trim(x if ascii_only else to_halfwidth(x)), without_era)
    return bound(F.split(bound(s, written), "-"), real)


def corpus_date(x: Column) -> Column:
    """yyyy-MM-dd by the first of six formats that reads the text; years of two digits from 69 on are of the last
    century."""

    def read(f: str) -> Column:
        d = F.try_to_date(x, f)
        return d if "yyyy" in f else F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d)

    return F.date_format(F.coalesce(*map(read, CORPUS_DATES)), "yyyy-MM-dd")


def amount(x: Column, ascii_only: bool = False) -> Column:
    """The number of an amount without currency signs, commas and blanks; null if anything else is left."""
    s = strip(F.regexp_replace(F.regexp_replace(x if ascii_only else to_halfwidth(x), CURRENCY, ""), "[, ]", ""))
    return F.when(s.rlike(r"^-?\d+(\.\d+)?$"), s.cast("double"))


def box_amount(text: Column, half: Column) -> Column:
    """The number of a box that holds an amount alone, with a sign of currency before or after it; else null. text: the
    box as read, half: the same in half width. A box without any digit and one that is a bare ASCII number need no more
    than a look."""
    bare = lambda t: F.regexp_replace(F.regexp_replace(strip(t), BOX_CURRENCY, ""), "[元圓]+$", "")
    signed = F.when(bare(text).rlike(BOX_AMOUNT), amount(bare(half), ascii_only=True))
    plain = F.replace(half, F.lit(","), F.lit("")).cast("double")
    return F.when(~text.rlike(r"(?U)\d"), F.lit(None).cast("double")).when((text == half) & text.rlike(PLAIN_AMOUNT), plain).otherwise(signed)


def amount_text(x: Column) -> Column:
    """An amount as its comparison sees it: whole numbers without decimals."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def tax_id(x: Column, ascii_only: bool = False) -> Column:
    """The eight digits of an id, whatever stands between them; null if there are more or fewer."""
    s = F.regexp_replace(x if ascii_only else to_halfwidth(x), r"\D", "")
    return F.when(F.length(s) == 8, s)


def tax_id_valid(x: Column) -> Column:
    """Weighted digits, their products' digits summed, divisible by five; with a seventh digit of 7 also one less."""
    total = F.lit(0)
    for i, w in enumerate(TAX_WEIGHTS, 1):
        p = F.substring(x, i, 1).cast("int") * w
        total = total + F.floor(p / 10) + p % 10
    good = (total % 5 == 0) | ((F.substring(x, 7, 1) == "7") & ((total + 1) % 5 == 0))
    return F.coalesce(x.rlike(r"^\d{8}$") & good, F.lit(False))


def invoice_number(x: Column, ascii_only: bool = False) -> Column:
    s = F.regexp_replace(F.upper(x if ascii_only else to_halfwidth(x)), r"(?U)[\s\-–—]", "")
    return F.when(s.rlike(r"^[A-Z]{2}\d{8}$"), s)


def item_names(names: Column) -> Column:
    """Canonical names of an array; texts without signs are null. The array travels to Python as one text."""
    joined = to_halfwidth(F.array_join(F.transform(names, lambda n: F.coalesce(n, F.lit(""))), SEPARATOR))
    return F.when(F.size(names) > 0, F.transform(F.split(joined, SEPARATOR), lambda n: normalize_text(n, ascii_only=True))).otherwise(F.array().cast("array<string>"))


def exact(a: Column, b: Column) -> Column:
    """Equal, two nulls included."""
    return a.eqNullSafe(b)


def fuzzy(a: Column, b: Column) -> Column:
    """1 - edits / longer length; two nulls 1, one null 0, two empty texts 1."""
    near = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return F.when(exact(a, b), F.lit(1.0)).otherwise(F.coalesce(near, F.lit(0.0)))
