"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Words of templates and texts are lower-cased runs of letters and digits (a "." between digits stays). Every K words of
a template are hashed, and of each WINDOW neighbouring hashes the smallest is its fingerprint; the inverted index maps
fingerprints to (template, place). A text's windows are winnowed alike, so a shared run of K + WINDOW - 1 words always
shares a fingerprint. A candidate is a hit whose run of equal words has LEAST words, or HITS hits of a template on
neighbouring diagonals, as scattered changes leave them. A banded local alignment of the words around it finds the best
segment, and then those on both sides of it, until none is left. Segments of a template that follow each other are
chained into a finding: matched words, coverage of the template, the span of characters, and whether it is whole or
partial. Templates of fewer than LEAST words are found word for word, whole only.

The index holds the templates only; it does not grow with the data and travels with the task. Texts are read in one
narrow pass. Defined results: null and empty texts have no findings; repeated rows are scanned each; a template that
occurs several times is reported each time; of matches that overlap the longer wins, of equal ones the first; an empty
table has no findings; texts of any length are read whole; other columns are not read; a short notice inside a longer
one is reported beside it; a template without words is an error.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.license_templates import TEMPLATES

K, WINDOW = 2, 2
#: Hits on neighbouring diagonals that make a candidate, be their runs as short as they may.
HITS = 3
#: Diagonals left and right of a candidate's that the alignment may use, at most.
BAND = 12


def band_of(words: int) -> int:
    """The band for a template of so many words: a sixth of them, so that short notices close together stay apart."""
    return min(BAND, max(2, words // 6))


#: A finding that covers so much of its template is whole, else partial.
COVERAGE = 0.75
#: Matched words of a segment at least; as many equal words in a row always share a fingerprint.
LEAST = 4
#: Templates of a folder at most: they travel with the tasks.
MOST_TEMPLATES = 1000
#: Template words that two segments of a chain may share; they count once.
OVERLAP = 3
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words and their spans; lower-casing here keeps every character's place."""
    low = text.translate(LOWER)
    found = list(WORD.finditer(low))
    return [m[0] for m in found], [m.span() for m in found]


LOWER = {c: c + 32 for c in range(65, 91)}


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter((word_hash(w) for w in words), np.uint64, len(words))


def grams(words: list[str] | np.ndarray) -> np.ndarray:
    """A hash of every K words, from hashes of the words."""
    one = words if isinstance(words, np.ndarray) else hashed(words)
    if len(one) < K:
        return np.zeros(0, np.uint64)
    n = len(one) - K + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(K):
            out = out * np.uint64(0x9E3779B97F4A7C15) + one[j : j + n]
        return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(1 << 17)
def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: in every WINDOW neighbours the last smallest hash."""
    n = len(hashes)
    if n <= WINDOW:
        return np.array([n - 1 - int(hashes[::-1].argmin())]) if n else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    return np.unique(np.arange(len(views)) + WINDOW - 1 - views[:, ::-1].argmin(axis=1))


class Index:
    """The inverted index of templates."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [words_of(t)[0] for t in templates.values()]
        if not all(self.words):
            raise ValueError(f"templates without words: {[n for n, w in zip(self.names, self.words, strict=True) if not w]}")
        self.hashes = [hashed(w) for w in self.words]
        self.short: dict[int, dict[tuple[str, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            if len(words) < LEAST:
                self.short[len(words)][tuple(words)].append(t)
                continue
            own = grams(self.hashes[t])
            for i in winnowed(own).tolist():
                self.places[int(own[i])].append((t, i))
        self.prints = np.array(sorted(self.places), np.uint64)

    def candidates(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(template, diagonal) of the candidates: a diagonal stands for its neighbours within the band."""
        hashes = grams(words)
        at = winnowed(hashes)
        hits = at[np.isin(hashes[at], self.prints)]
        diagonals = defaultdict(list)
        for i in hits.tolist():
            for t, j in self.places[int(hashes[i])]:
                diagonals[t].append((i - j, j))
        out = set()
        for t, found in diagonals.items():
            found.sort()
            near, last = band_of(len(self.words[t])) // 2, None
            for n, (d, j) in enumerate(found):
                if last is not None and d - last <= near:
                    continue
                crowd = n + HITS <= len(found) and found[n + HITS - 1][0] - d <= near
                if crowd or self.run(t, words, d, j) >= LEAST:
                    out.add((t, d))
                    last = d
        return out

    def run(self, t: int, words: np.ndarray, diagonal: int, j: int) -> int:
        """Equal words in a row around template word j on a diagonal, as far as they matter."""
        own, a, b = self.hashes[t], j, j
        while a > 0 and j - a < LEAST and a - 1 + diagonal >= 0 and own[a - 1] == words[a - 1 + diagonal]:
            a -= 1
        while b < len(own) and b - j < LEAST and b + diagonal < len(words) and own[b] == words[b + diagonal]:
            b += 1
        return b - a

    def segments(self, t: int, words: np.ndarray, diagonal: int) -> Iterator[Segment]:
        """All disjoint local alignments of a template along a diagonal, the best first."""
        size = len(self.words[t])
        open_ = [(0, size, 0, len(words))]
        while open_:
            low, high, left, right = open_.pop()
            got = aligned(self.hashes[t], words, diagonal, low, high, left, right)
            if got and got[2] >= LEAST:
                yield got
                open_ += [part for part in ((low, got[3], left, got[0]), (got[4], high, got[1], right)) if part[1] - part[0] >= LEAST]

    def scan(self, text: str) -> list[tuple[str, int, int, int, float, str]]:
        """(template, start, end, matched words, coverage, verdict) of the findings, best of overlapping ones of a
        template; its segments that follow each other in template and text are one finding."""
        words, spans = words_of(text)
        own = hashed(words)
        found: dict[int, list[Segment]] = defaultdict(list)
        for t, d in sorted(self.candidates(own)):
            found[t] += self.segments(t, own, d)
        out = []
        for t, all_ in found.items():
            size = len(self.words[t])
            taken: list[Segment] = []
            for x in sorted(set(all_), key=lambda x: (-x[2], x[0])):
                if all(x[1] <= y[0] or x[0] >= y[1] for y in taken):
                    taken.append(x)
            for a, b, n in chained(taken, size):
                verdict = "whole" if n >= COVERAGE * size else "partial"
                out.append((self.names[t], spans[a][0], spans[b - 1][1], n, n / size, verdict))
        for size, known in self.short.items():
            for a in range(len(words) - size + 1):
                for t in known.get(tuple(words[a : a + size]), ()):
                    out.append((self.names[t], spans[a][0], spans[a + size - 1][1], size, 1.0, "whole"))
        return sorted(out, key=lambda x: (x[1], x[0]))


#: First word and end in the text, matched words, first word and end in the template.
Segment = tuple[int, int, int, int, int]


def chained(segments: list[Segment], size: int) -> list[tuple[int, int, int]]:
    """(first word, end, matched words) of chains of segments that do not overlap in the text: in the order of the text,
    each joins the open chain whose template part ends last before its own, if no more than `size` words lie between."""
    chains: list[list[int]] = []  # first word, end, matched words, end in the template
    for a, b, n, i, j in sorted(segments):
        open_ = [c for c in chains if c[3] <= i + OVERLAP and a - c[1] <= size]
        if open_:
            c = max(open_, key=lambda c: c[3])
            c[1], c[2], c[3] = b, min(size, c[2] + n - max(0, c[3] - i)), j
        else:
            chains.append([a, b, n, j])
    return [(a, b, n) for a, b, n, _ in chains]


def aligned(template: np.ndarray, words: np.ndarray, diagonal: int, low: int, high: int, left: int, right: int) -> Segment | None:
    """The best local alignment of template words low..high with the text's words left..right within the band of a
    diagonal; both as hashes of words. A row of cells at a time: a gap in the text costs one a word, so the best way along
    a row is a running maximum."""
    band = band_of(len(template))
    width = 2 * band + 1
    first = low + diagonal - band  # the text's word beside the first cell of the first row
    here = np.arange(first, first + high - low + width - 1)
    inside = (here >= left) & (here < right)
    beside = words[np.clip(here, 0, max(0, len(words) - 1))] if len(words) else np.zeros(len(here), np.uint64)
    steps = np.arange(width)
    score, back = np.zeros(width, np.int64), np.zeros((high - low, width), np.int8)  # 0 start, 1 both, 2 template only, 3 text only
    best, cell = 0, None
    for i in range(high - low):
        both = score + np.where(beside[i : i + width] == template[low + i], MATCH, MISMATCH)
        down = np.append(score[1:] + GAP, -9)
        base = np.maximum(np.maximum(both, down), 0)
        base[~inside[i : i + width]] = 0
        score = np.maximum.accumulate(base - GAP * steps) + GAP * steps
        score[~inside[i : i + width]] = 0
        back[i] = np.where(score > base, 3, np.where(base == 0, 0, np.where(base == both, 1, 2)))
        if (top := int(score.max())) > best:
            best, cell = top, (i, int(score.argmax()))
    if cell is None:
        return None
    i, k = cell
    end, matched, start, until = first + i + k + 1, 0, 0, low + i + 1
    while i >= 0 and back[i, k]:
        step, j = back[i, k], first + i + k
        if step == 1:
            matched += int(words[j] == template[low + i])
            start = j
            i -= 1
        elif step == 2:
            i, k = i - 1, k + 1
        else:
            start, k = j, k - 1
    return start, end, matched, low + i + 1, until


@lru_cache(4)
def _index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates from license files (name -> text), for a library of whole licenses: MOST_TEMPLATES at most, as the index
    travels with the tasks; more are an error."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("name"), "value")
    found = {r["name"]: r["value"] for r in rows.orderBy("name").limit(MOST_TEMPLATES + 1).toLocalIterator()}
    if len(found) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return found


SCHEMA = [("license", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("matched_words", T.LongType()), ("coverage", T.DoubleType()), ("verdict", T.StringType())]


def license_findings(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", partial: bool = False) -> DataFrame:
    """(id, license, start, end, matched_words, coverage, verdict): places in code points. Partial findings come only
    with `partial`, as in the registered query."""
    chosen = tuple((templates or TEMPLATES).items())
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in SCHEMA)])
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(chosen)
        for batch in batches:
            rows = [(i, *x) for i, t in enumerate(batch.column(1)) for x in index.scan(t.as_py() or "") if partial or x[-1] == "whole"]
            if rows:
                at, *columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
