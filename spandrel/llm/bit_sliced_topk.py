"""Exact top-k search by inner product over a bit-sliced index.

Vectors are quantised to integers. The index keeps, for blocks of rows, one bitmap for each attribute and binary digit
(over the attribute's smallest value in the block). A query's score is a sum of attribute slices weighted by the
query's digits: bitmaps are added by carry-save adders, for many queries at a time, with an attribute's complement for
a negative weight. Only each attribute's leading slices are added; what the others could add is bounded. The k-th
largest sum is found from the most significant slice of the result downward, rows whose bound reaches it are read off
by a bitwise comparison, and these boundary rows are resolved exactly from all slices.

Queries meet the index in blocks: query blocks and index blocks are dealt over a grid, so work and memory of a task are
bounded however many rows or queries there are, and each block returns at most k rows a query.

Numbers of any size are exact: where a block's sums could leave 64 bits, its few sums and boundary rows are Python's
integers. Rows with a component beyond WIDE have blocks and query parts of their own, so that they slow nobody else.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id, take no part;
vectors are scored against those of their own length (empty vectors score 0); each repeated candidate row counts, a
repeated query row is one query; a query's own row is every row of its id; an empty table has no results. A score
among the k best that 64 bits cannot hold is an error, as the result's type has no place for it; other rows' scores
may leave 64 bits without harm. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.llm.common import staged

SCALE = 1024
#: Rows with a component beyond this in absolute value are kept as doubles, in blocks of their own.
WIDE = float(1 << 20)
#: Sums below this stay within 64 bits, with the bits that slices are padded by.
SAFE = 1 << 59
BLOCK_ROWS = 8192
QUERY_ROWS = 4096
#: Leading slices of an attribute that are added before the boundary is resolved.
SLICES = 6
#: Queries whose bitmaps are added together.
STRIDE = 32
INDEX = "block long, dim int, keys array<long>, base array<string>, bits array<int>, slices binary"
#: side: 1 or -1 where the score is above or below 64 bits, which is then 0.
FOUND = "query_id long, uid long, vec_id long, side int, score long"
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, wide, v array<long>, x array<double>) of the vectors that take part: v = floor(SCALE * x), or for wide rows
    the doubles themselves."""
    x = F.col("x")
    bad = lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).filter(F.col("id").isNotNull() & x.isNotNull() & ~F.exists(x, bad))
    rows = clean.withColumn("wide", F.exists(x, lambda y: F.abs(y) > WIDE))
    return rows.select("id", "wide", F.when(~F.col("wide"), F.transform("x", lambda y: F.floor(y * F.lit(float(SCALE))))).alias("v"), F.when(F.col("wide"), x).alias("x"))


def whole(x: float) -> int:
    """floor(SCALE * x) of any finite double."""
    return math.floor(x * SCALE) if abs(x) < 1 << 53 else int(x) * SCALE


def matrix(lists: pa.Array, dim: int, wide: bool) -> np.ndarray:
    """rows x attributes of an Arrow list array: 64-bit integers, or Python's for wide rows."""
    flat = lists.flatten()
    if wide:
        return np.array([whole(y) for y in flat.to_pylist()], object).reshape(len(lists), dim)
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), dim)


def sliced(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, bits, slices) of a rows x attributes matrix; slices: bytes of one bitmap for each attribute's digits."""
    base = values.min(axis=0) if values.size else np.zeros(values.shape[1], values.dtype)
    over = values - base
    bits = np.array([int(m).bit_length() for m in over.max(axis=0)] if values.size else [0] * values.shape[1], np.int32)
    words = -(-len(values) // 64)
    rows = []
    for d, n in enumerate(bits):
        for b in range(n):
            one = np.zeros(words * 64, np.uint8)
            one[: len(values)] = (over[:, d] >> b & 1).astype(np.uint8)
            rows.append(np.packbits(one, bitorder="little"))
    return base, bits, np.concatenate(rows) if rows else np.zeros(0, np.uint8)


def index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The bit-sliced index of `quantised` rows: one row a block of rows alike in length and width, no more than
    block_rows rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[tuple[int, bool], tuple[list[int], list[np.ndarray]]] = {}
        number = TaskContext.get().partitionId() << 32

        def block(kind: tuple[int, bool]) -> pa.RecordBatch:
            nonlocal number
            keys, rows = held.pop(kind)
            base, bits, slices = sliced(np.array(rows, object if kind[1] else np.int64).reshape(len(keys), kind[0]))
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([kind[0]], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([[str(x) for x in base.tolist()]], pa.list_(pa.string())), pa.array([bits.tolist()], pa.list_(pa.int32())), pa.array([slices.tobytes()], pa.binary())],
                ["block", "dim", "keys", "base", "bits", "slices"],
            )

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3)]
            for key, wide, v, x in zip(*columns, strict=True):
                row = [whole(y) for y in x] if wide else v
                keys, rows = held.setdefault((len(row), wide), ([], []))
                keys.append(key)
                rows.append(row)
                if len(keys) == block_rows:
                    yield block((len(row), wide))
        for kind in list(held):
            yield block(kind)

    n = max(1, -(-vectors.count() // block_rows))
    return vectors.repartition(n).mapInArrow(run, INDEX)


def added(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The binary digits, lowest first, of the sum of bitmaps; columns[w] holds those of weight 2**w."""
    out: list[np.ndarray] = []
    w = 0
    while w < len(columns):
        left = columns[w]
        if w + 1 == len(columns) and len(left) > 1:
            columns.append([])
        while len(left) > 1:
            a, b = left.pop(), left.pop()
            if left:
                c = left.pop()
                x = a ^ b
                left.insert(0, x ^ c)
                columns[w + 1].append((a & b) | (x & c))
            else:
                left.append(a ^ b)
                columns[w + 1].append(a & b)
        out.append(left[0] if left else None)
        columns[w] = []
        w += 1
    return out


class Block:
    """One index block, ready for queries."""

    def __init__(self, dim: int, keys: list[int], base: list[str], bits: list[int], slices: bytes):
        self.keys = np.array(keys, np.int64)
        low = [int(x) for x in base]
        self.bits = np.array(bits, np.int64)
        #: The largest absolute value of each attribute, or a little more.
        self.most = [max(abs(x), abs(x + (1 << b))) for x, b in zip(low, bits, strict=True)]
        n = len(keys)
        self.words = -(-n // 64)
        maps = np.frombuffer(slices, "<u8").reshape(-1, self.words)
        first = np.concatenate([[0], np.cumsum(self.bits)])
        self.maps = [maps[first[d] : first[d + 1]] for d in range(dim)]
        kind = np.int64 if max(self.most, default=0) < SAFE else object
        self.rows = np.zeros((n, dim), kind)  # exact values, from all slices
        for d in range(dim):
            for b, one in enumerate(self.maps[d]):
                self.rows[:, d] += np.unpackbits(one.view(np.uint8), bitorder="little")[:n].astype(kind) * (1 << b)
        if dim:
            self.rows += np.array(low, kind)
        self.exist = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view("<u8")

    def fits(self, q: np.ndarray) -> bool:
        """Whether all sums of these queries and rows stay within 64 bits."""
        return sum(m * int(w) for m, w in zip(self.most, np.abs(q).max(axis=0, initial=0), strict=True)) < SAFE

    def candidates(self, q: np.ndarray, own: np.ndarray, k: int, slices: int = SLICES) -> np.ndarray:
        """queries x words bitmap of the rows that may be among the k best; q: queries x attributes, own: the query ids."""
        weight, minus = np.abs(q), np.where((q < 0).astype(bool), ONES, np.uint64(0))
        slack = np.zeros(len(q), q.dtype)
        columns: list[list[np.ndarray]] = []
        for d, maps in enumerate(self.maps):
            skipped = max(0, len(maps) - slices)
            slack += weight[:, d] * ((1 << skipped) - 1)
            digits = int(weight[:, d].max()).bit_length() if len(q) else 0
            for b in range(skipped, len(maps)):
                one = maps[b][None, :] ^ minus[:, d, None]
                for g in range(digits):
                    chosen = (weight[:, d] >> g & 1).astype(bool)
                    if chosen.any():
                        while len(columns) <= b + g:
                            columns.append([])
                        columns[b + g].append(one & np.where(chosen, ONES, np.uint64(0))[:, None])
        sums = [x for x in added(columns)]
        live = np.repeat(self.exist[None, :], len(q), axis=0)
        for i, key in enumerate(own):
            for r in np.flatnonzero(self.keys == key):
                live[i, r >> 6] &= ~np.uint64(1 << (int(r) & 63))
        # the k-th largest sum, from the most significant slice downward
        tied, need, value = live.copy(), np.full(len(q), k, np.int64), np.zeros(len(q), q.dtype)
        for w in range(len(sums) - 1, -1, -1):
            if sums[w] is None:
                continue
            ones = tied & sums[w]
            count = np.bitwise_count(ones).sum(axis=1).astype(np.int64)
            enough = count >= need
            if enough.any():
                value += enough.astype(q.dtype) * (1 << w)
            need -= np.where(enough, 0, count)
            tied = np.where(enough[:, None], ones, tied & ~sums[w])
        few = np.bitwise_count(live).sum(axis=1) <= k
        least = np.where(few, 0, np.maximum(0, value - slack))
        # sum >= least, digit by digit
        over, same = np.zeros_like(live), live.copy()
        for w in range(len(sums) - 1, -1, -1):
            bit = np.where((least >> w & 1).astype(bool), ONES, np.uint64(0))[:, None]
            s = sums[w] if sums[w] is not None else np.zeros_like(live)
            over |= same & s & ~bit
            same &= ~(s ^ bit)
        return over | same

    def best(self, q: np.ndarray, own: np.ndarray, k: int, slices: int = SLICES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, keys, exact scores) of each query's k best rows."""
        n = len(self.keys)
        if q.dtype == object or self.rows.dtype == object or not self.fits(q):
            q, rows = q.astype(object), self.rows.astype(object)
        else:
            rows = self.rows
        for a in range(0, len(q), STRIDE):
            for i, one in enumerate(self.candidates(q[a : a + STRIDE], own[a : a + STRIDE], k, slices), a):
                at = np.flatnonzero(np.unpackbits(one.view(np.uint8), bitorder="little")[:n])
                yield i, *first(self.keys[at], (rows[at] * q[i]).sum(axis=1) if rows.dtype == object and len(q[i]) else rows[at] @ q[i], k)


def first(keys: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, ties to smaller keys."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(keys)), key=lambda i: (-scores[i], keys[i]))[:k], np.int64)
    else:
        order = np.lexsort((keys, -scores))[:k]
    return keys[order], scores[order]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, slices: int = SLICES, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which `is_query` (over the column `id`) holds, its k best
    other rows. A task meets the index blocks of one grid column with one part of the queries and returns k rows a query."""
    spark = vectors.sparkSession
    rows = staged(quantised(vectors, id_col, vector_col), "quantised")
    blocks = staged(index(rows, block_rows), "bit-slices")
    queries = rows.filter(is_query).distinct()
    n_queries, n_blocks = queries.count(), blocks.count()
    query_parts, grid = max(1, -(-n_queries // query_rows)), max(1, min(n_blocks, 4 * spark.sparkContext.defaultParallelism))
    # queries of a part are one row a vector length and width, repeated for each column of the grid
    asked = queries.select("id", "wide", "v", "x", F.xxhash64("id", "v", "x").alias("uid"), F.size(F.coalesce("v", F.transform("x", lambda _: F.lit(0).cast("long")))).alias("dim"))
    asked = asked.withColumn("part", F.pmod(F.col("uid"), F.lit(query_parts)))
    asked = asked.groupBy("dim", "wide", "part").agg(F.array_sort(F.collect_list(F.struct("uid", "id", "v", "x"))).alias("all")).select("dim", "wide", "part", "all.uid", "all.id", "all.v", "all.x")
    asked = asked.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    placed = blocks.withColumn("column", F.pmod(F.hash("block"), F.lit(grid))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_parts - 1).cast("long"))))
    met = placed.join(asked, ["dim", "part", "column"]).select("dim", "keys", "base", "bits", "slices", "part", "column", "wide", "uid", "id", "v", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, {}

        def cut() -> pa.RecordBatch:
            at = np.repeat(np.array(list(held), np.int64), [len(ks) for ks, _ in held.values()])
            scores = [int(s) for _, ss in held.values() for s in ss.tolist()]
            side = [1 if s > MOST else -1 if s < -MOST - 1 else 0 for s in scores]
            keys = np.concatenate([ks for ks, _ in held.values()])
            return pa.RecordBatch.from_arrays(
                [pa.array(own[at]), pa.array(uid[at]), pa.array(keys), pa.array(side, pa.int32()), pa.array([0 if over else s for s, over in zip(scores, side, strict=True)], pa.int64())],
                ["query_id", "uid", "vec_id", "side", "score"],
            )

        for batch in batches:
            for i in range(batch.num_rows):
                dim, keys, base, bits, packed, *here = (batch.column(c)[i].as_py() for c in range(8))
                if (now := (dim, *here)) != place:
                    if held:
                        yield cut()
                    place, held = now, {}
                    uid, own = (batch.column(c)[i].values.to_numpy() for c in (8, 9))
                    q = matrix(batch.column(11 if here[2] else 10)[i].values, dim, here[2])
                for at, ks, ss in Block(dim, keys, base, bits, packed).best(q, own, k, slices):
                    if at in held:
                        ks, ss = first(np.append(held[at][0], ks), np.append(held[at][1], ss), k)
                    held[at] = ks, ss
        if held:
            yield cut()

    found = met.mapInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "uid").orderBy(F.desc("side"), F.desc("score"), "vec_id"))
    score = F.when(F.col("side") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score among the best leaves 64 bits")).cast("long"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


#: The largest score of 64 bits.
MOST = (1 << 63) - 1

ORACLE = """
WITH p AS (SELECT vec_id::BIGINT AS vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL
           AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
e AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest([floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding]) AS v FROM p),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.v * c.v)::BIGINT AS score FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id
      WHERE q.vec_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
