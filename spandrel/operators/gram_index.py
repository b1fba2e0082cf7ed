"""An inverted index of character bigrams over blocks of texts, and exact top-k search by block-max pruning.

Chunks are packed into blocks. A block holds, for each gram in ascending order, its postings (text, count) and the
gram's largest impact: the largest count, and the largest count over a text's norm. Questions come as a table; they are
packed into blocks of the same form. Index blocks are dealt over the columns of a grid and question blocks go to every
column, so each pair of blocks meets once, in a join, and nothing passes through the driver.

Where two blocks meet, the largest impacts bound what each question can score in the block; only questions whose bound
reaches the k-th best score found so far are multiplied out, over the grams that both blocks have. A task keeps k chunks
for each question, which are all that is shuffled after that. Scores do not hang on blocks, tasks or order: counts and
norms are whole numbers until the last division.

The index is a table: write it once and search it as often as needed. One index can hold several variants of a corpus: a
chunk's bits tell which of them hold it, and one pass keeps the k best of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions import text as TX
from spandrel.sources.tables import importable

#: Chunks of an index block at most, and characters of its texts after which it is full.
CHUNKS, CHARACTERS = 128, 1 << 18
#: Questions of a block.
QUESTIONS = 256
#: Grams that are multiplied at a time.
SLICE = 4096
TOP = 5
#: Columns of the grid for each core of the cluster.
COLUMNS = 4
#: Bounds are sums of rounded numbers: a question is left out only if its bound is lower by more than this.
SLACK = 1e-9
#: Numbers below this are whole in single precision, so that sums of counts up to it may be made in it.
WHOLE = 1 << 24
#: Arrays of postings travel packed: see `packed`.
POSTINGS = "grams binary, ends binary, rows binary, counts binary, norms binary, sizes binary, impacts binary, most binary"
INDEX = f"block long, keys array<long>, idx array<int>, first array<int>, variants array<int>, {POSTINGS}"
ASKED = f"asked long, items array<long>, {', '.join('q_' + x.strip() for x in POSTINGS.split(','))}"


@dataclass(frozen=True)
class Windows:
    """Parameters of the windowed score: best window and whole chunk, cosine and coverage, weighed."""

    size: int = 320
    overlap: int = 80
    whole: float = 0.25
    coverage: float = 0.5

    def __post_init__(self) -> None:
        if self.size <= 0 or not 0 <= self.overlap < self.size or not 0 <= self.whole <= 1 or not 0 <= self.coverage <= 1:
            raise ValueError("size > overlap >= 0; whole and coverage in 0..1")

    def texts(self, x: Column, section: Column | None = None) -> Column:
        """Windows of a text, with its section path on a line before it: the whole if it is short enough, else one at every
        step before its end."""
        if section is not None:
            x = F.concat_ws("\n", F.nullif(section, F.lit("")), F.coalesce(x, F.lit("")))

        def cut(whole: Column) -> Column:
            many = F.transform(F.sequence(F.lit(0), F.length(whole) - 1, F.lit(self.size - self.overlap)), lambda i: F.substring(whole, i + 1, F.lit(self.size)))
            return F.when(F.length(whole) <= self.size, F.array(whole)).otherwise(many)

        return TX.bound(TX.strip(F.coalesce(x, F.lit(""))), cut)


def gram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, a number for the gram) of each character bigram of compacted texts; one character is its own only gram."""
    lengths = np.array([len(t) for t in texts], np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    at, last = np.repeat(np.arange(len(texts)), lengths), (np.cumsum(lengths) - 1)[lengths > 0]
    keys = c << 21
    keys[:-1] |= c[1:] + 1
    keys[last] = c[last] << 21
    kept = np.ones(len(c), bool)
    kept[last[lengths[lengths > 0] > 1]] = False
    return at[kept], keys[kept]


def packed(x: np.ndarray) -> bytes:
    """An array as bytes behind its type; whole numbers (none is negative) in the narrowest type that holds them."""
    if x.dtype.kind != "f":
        x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return x.dtype.str.encode().ljust(8) + x.tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.dtype(x[:8].decode().strip()), offset=8)


@dataclass
class Postings:
    """Gram by gram, which texts hold it and how often; a text's norm and size are over all its grams."""

    grams: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    counts: np.ndarray
    norms: np.ndarray
    sizes: np.ndarray
    impacts: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Postings:
        at, flat = gram_keys(texts)
        if len(texts) <= 1 << 21:  # a gram has 42 bits, so both fit in one number
            both = np.sort((flat << 21) | at)
            at, flat = both & ((1 << 21) - 1), both >> 21
        else:
            order = np.lexsort((at, flat))
            at, flat = at[order], flat[order]
        new = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (at[1:] != at[:-1])])) if len(flat) else np.zeros(0, np.int64)
        rows, keyed, counts = at[new], flat[new], np.diff(np.append(new, len(flat)))
        norms = np.sqrt(np.bincount(rows, counts.astype(float) ** 2, len(texts)))
        starts = np.flatnonzero(np.concatenate([[True], keyed[1:] != keyed[:-1]])) if len(keyed) else np.zeros(0, np.int64)
        top = lambda x: np.maximum.reduceat(x, starts) if len(starts) else np.zeros(0, x.dtype)
        return cls(keyed[starts], np.append(starts[1:], len(keyed)).astype(np.int32) if len(starts) else np.zeros(0, np.int32), rows.astype(np.int32), counts.astype(np.int32), norms, np.bincount(rows, counts, len(texts)).astype(np.int64), top(counts / norms[rows]), top(counts.astype(np.int32)))

    def fields(self) -> list[bytes]:
        return [packed(x) for x in (self.grams, self.ends, self.rows, self.counts, self.norms, self.sizes, self.impacts, self.most)]

    @classmethod
    def read(cls, fields: list[bytes]) -> Postings:
        """Counts and places as long numbers, so that sums of them cannot overflow."""
        return cls(*(x if x.dtype.kind == "f" else x.astype(np.int64) for x in map(unpacked, fields)))

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of `at`, posting) of all postings of the grams at the places `at`."""
        starts = np.append(0, self.ends[:-1])[at] if len(at) else np.zeros(0, np.int64)
        n = self.ends[at] - starts
        which = np.repeat(np.arange(len(at)), n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


def shared_grams(a: Postings, b: Postings) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the grams that both have."""
    at = np.searchsorted(b.grams, a.grams)
    known = np.flatnonzero(at < len(b.grams))
    known = known[b.grams[at[known]] == a.grams[known]]
    return known, at[known]


def bounds(questions: Postings, block: Postings, shared: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What the cosine and the coverage of each question can be at most with any text of the block."""
    mine, theirs = shared
    which, at = questions.entries(mine)
    rows, n = questions.rows[at], questions.counts[at]
    cosine = np.bincount(rows, n * block.impacts[theirs][which], len(questions.norms)).astype(float)
    coverage = np.bincount(rows, np.minimum(n, block.most[theirs][which]), len(questions.norms)).astype(float)
    return np.divide(cosine, questions.norms, out=np.zeros_like(cosine), where=questions.norms > 0), np.divide(coverage, questions.sizes, out=np.zeros(len(coverage)), where=questions.sizes > 0)


def similarities(questions: Postings, active: np.ndarray, block: Postings, shared: tuple[np.ndarray, np.ndarray], cosine: bool = True, coverage: bool = True) -> tuple[np.ndarray | None, np.ndarray | None]:
    """(cosine, coverage), active questions x texts, each if it is wanted; nothing in common, or no grams, gives zero.

    All sums are of whole numbers, in single precision where none can pass its exact range. The least of two counts is a
    sum over the question's levels (its distinct counts): a level's step, if the question reaches it, or what the text has of
    that step. Few grams reach the higher levels, and only those are multiplied there."""
    place = np.full(len(questions.norms), -1)
    place[active] = np.arange(len(active))
    mine, theirs = shared
    dot, common = (np.zeros((len(active), len(block.norms))) for _ in range(2))
    kind = np.float32 if int(questions.sizes.max(initial=0)) * int(block.most.max(initial=0)) < WHOLE else np.float64
    for a in range(0, len(mine), SLICE):
        left, right = (np.zeros((min(SLICE, len(mine) - a), n), kind) for n in (len(active), len(block.norms)))
        which, at = questions.entries(mine[a : a + SLICE])
        own = place[questions.rows[at]] >= 0
        left[which[own], place[questions.rows[at[own]]]] = questions.counts[at[own]]
        which, at = block.entries(theirs[a : a + SLICE])
        right[which, block.rows[at]] = block.counts[at]
        if cosine:
            dot += left.T @ right
        below = 0
        for level in np.unique(left[left > 0]).astype(int) if coverage else ():
            reach = np.flatnonzero((left.max(axis=1) >= level) & (right.max(axis=1) > below))
            left, right = left[reach], right[reach]
            common += (left >= level).astype(kind).T @ np.clip(right - below, 0, level - below)
            below = level
    scale, sizes = block.norms[None, :] * questions.norms[active][:, None], questions.sizes[active][:, None]
    return np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0) if cosine else None, np.divide(common, sizes, out=np.zeros_like(dot), where=sizes > 0) if coverage else None


def _scores(cosine: np.ndarray | None, coverage: np.ndarray | None, first: np.ndarray, score: str, w: Windows | None) -> np.ndarray:
    """Questions x chunks. With windows, a chunk's first text is the whole, the others are its windows."""
    if w is None:
        return cosine if score == "cosine" else coverage
    local = (1 - w.coverage) * cosine + w.coverage * coverage
    local[:, first] = -np.inf
    return w.whole * cosine[:, first] + (1 - w.whole) * np.maximum.reduceat(local, first, axis=1)


def index(chunks: DataFrame, windows: Windows | None = None, key: str = "doc_id", idx: str = "chunk_idx", text: str = "text", section: str | None = None, variants: str | None = None) -> DataFrame:
    """The blocks of `chunks` (key, idx, text), a table of INDEX. With windows, their texts are indexed too, with the path of
    the column `section` before them if one is named. variants: a column of bits, bit v if variant v holds the chunk; without
    it there is one variant. One narrow pass."""
    importable(chunks.sparkSession)
    texts = F.array(TX.compact(F.col(text)))
    if windows is not None:
        texts = F.concat(texts, F.transform(windows.texts(F.col(text), F.col(section) if section else None), lambda w: TX.compact(w)))
    rows = chunks.select(F.col(key).cast("long").alias("key"), F.col(idx).cast("int").alias("idx"), texts.alias("texts"), (F.col(variants) if variants else F.lit(1)).cast("int").alias("variants"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int, int, list[str], int]] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            number += 1
            held.sort(key=lambda r: (r[0], r[1]))  # so that of equal scores the first place wins
            first = np.cumsum([0, *(len(r[2]) for r in held[:-1])]).astype(np.int32)
            of_texts = Postings.of([t for r in held for t in r[2]])
            columns = [np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int32), first, np.array([r[3] for r in held], np.int32), *of_texts.fields()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([c]) for c in columns)], NAMES)

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(row)
                size += sum(map(len, row[2]))
                if len(held) == CHUNKS or size >= CHARACTERS:
                    size = 0
                    yield block()
        if held:
            yield block()

    return rows.mapInArrow(run, INDEX)


NAMES = [x.strip().split(" ")[0] for x in INDEX.split(",")]


def asked(questions: DataFrame, item: str = "item_id", text: str = "text", size: int = QUESTIONS) -> DataFrame:
    """The blocks of `questions`, a table of ASKED; questions are dealt evenly first, so that there are few blocks."""
    importable(questions.sparkSession)
    names = [x.strip().split(" ")[0] for x in ASKED.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), *(pa.array([c]) for c in Postings.of(part.column(1).to_pylist()).fields())], names)

    return questions.select(F.col(item).cast("long"), TX.compact(F.col(text))).mapInArrow(run, ASKED)


def dealt(rows: DataFrame, blocks: DataFrame, block: str) -> DataFrame:
    """Each of `rows` (with the column `block`) with each of `blocks`: rows are dealt over the columns of a grid, `blocks`
    go to every column."""
    columns = COLUMNS * rows.sparkSession.sparkContext.defaultParallelism
    left = rows.withColumn("column", F.pmod(F.hash(block), F.lit(columns)))
    return left.join(blocks.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))), "column").drop("column")


class Best:
    """The k best chunks of each question of a block so far."""

    def __init__(self, items: np.ndarray, k: int):
        self.items, self.k = items, k
        self.score = np.full((len(items), k), -np.inf)
        self.key, self.idx = np.full((len(items), k), np.iinfo(np.int64).max), np.full((len(items), k), np.iinfo(np.int32).max)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, active: np.ndarray, score: np.ndarray, key: np.ndarray, idx: np.ndarray) -> None:
        at = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        s = np.concatenate([self.score[active], np.take_along_axis(score, at, 1)], axis=1)
        k, i = np.concatenate([self.key[active], key[at]], axis=1), np.concatenate([self.idx[active], idx[at]], axis=1)
        order = np.lexsort((i, k, -s), axis=1)[:, : self.k]
        self.score[active], self.key[active], self.idx[active] = (np.take_along_axis(x, order, 1) for x in (s, k, i))


def search(indexed: DataFrame, questions: DataFrame, k: int = TOP, score: str = "cosine", windows: Windows | None = None, item: str = "item_id", text: str = "text", variants: int = 1) -> DataFrame:
    """(item, key, idx, score, rank): the k best chunks of every question, ties to smaller key and idx; chunks that share
    nothing fill up to k. score: "cosine" or "coverage"; with `windows`, those that the index was made with, the windowed score. With several
    variants (variant, item, ...): the k best of each, as if each had been searched on its own."""
    stated = asked(questions, item, text)
    met = dealt(indexed, stated, "block")
    order = [*NAMES, *stated.columns]
    schema = "variant int, item long, key long, idx int, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[Postings, list[Best]]] = {}
        now, block, keys, idx, first, of_variant = None, *[None] * 5
        for batch in batches:
            array = lambda c, i, batch=batch: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
            for i, (number, of) in enumerate(zip(batch.column(0).to_pylist(), batch.column(len(NAMES)).to_pylist(), strict=True)):
                if number != now:
                    now, keys, idx, first = number, array(1, i), array(2, i), array(3, i)
                    of_variant = [np.flatnonzero(array(4, i) >> v & 1) for v in range(variants)]
                    block = Postings.read([batch.column(c)[i].as_py() for c in range(5, len(NAMES))])
                if of not in best:
                    at = len(NAMES)
                    best[of] = Postings.read([batch.column(c)[i].as_py() for c in range(at + 2, len(order))]), [Best(array(at + 1, i), k) for _ in range(variants)]
                own, held = best[of]
                shared = shared_grams(own, block)
                cosine, coverage = bounds(own, block, shared)
                if windows is not None:
                    most = windows.whole * cosine + (1 - windows.whole) * ((1 - windows.coverage) * cosine + windows.coverage * coverage)
                else:
                    most = cosine if score == "cosine" else coverage
                reaches = [(most + SLACK >= x.least()) & bool(len(c)) for x, c in zip(held, of_variant, strict=True)]
                active = np.flatnonzero(np.any(reaches, axis=0))
                if not len(active):
                    continue
                got = _scores(*similarities(own, active, block, shared, windows is not None or score == "cosine", windows is not None or score != "cosine"), first, score, windows)
                for x, reach, chunks in zip(held, reaches, of_variant, strict=True):
                    if len(chunks) and (mine := reach[active] & (got[:, chunks].max(axis=1) >= x.least()[active])).any():
                        x.add(active[mine], got[mine][:, chunks], keys[chunks], idx[chunks])
        for variant, held in ((v, x) for _, all_ in best.values() for v, x in enumerate(all_)):
            found = np.isfinite(held.score)
            items = np.broadcast_to(held.items[:, None], held.score.shape)
            if found.any():
                columns = [np.full(found.sum(), variant, np.int32), items[found], held.key[found], held.idx[found].astype(np.int32), held.score[found]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["variant", "item", "key", "idx", "score"])

    found = met.select(*order).mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("variant", "item").orderBy(F.desc("score"), "key", "idx"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("item", item)
    return found if variants > 1 else found.drop("variant")


def rows_in_blocks(rows: DataFrame, name: str, size: int) -> DataFrame:
    """(name, rows): the rows of a frame as arrays of at most `size` rows, each with a number in the column `name`."""
    schema: Any = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                number += 1
                inner = pa.StructArray.from_arrays([part.column(i) for i in range(part.num_columns)], part.schema.names)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)], [name, "rows"])

    from pyspark.sql import types as T

    importable(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([T.StructField(name, T.LongType()), T.StructField("rows", T.ArrayType(schema))]))
