"""Product codes of vectors: a codebook for each part of a vector, learnt by exact integer k-means.

Components become integers, floor(SCALE * x), and vectors are cut into equal consecutive parts. In each round the
codebooks are built into kd-trees on the driver and broadcast; tasks find every part's nearest entry and return the sums
and counts of their parts by entry, which Spark adds up; only these sums come back. So the driver holds codebooks, never
vectors, and the result does not hang on how rows are dealt.

The search visits a node whenever its box is no farther than the best entry so far, equal bounds included, so that of
entries alike in distance that of the lowest index is found. It walks the tree with all parts of a batch at a time.

Numbers are exact: parts whose squared distances could leave 64 bits are searched with Python's integers.

Defined results: vectors that are null or hold a null or non-finite component are left out; a row without an id is
coded like any other and is the last to start a codebook; repeated rows count and are coded each; fewer vectors than
entries make a codebook of as many entries; null labels are one label; an empty table has no codes. Vectors of several
lengths, a length that cannot be cut into the parts, and an error beyond 64 bits raise an error. Further columns are
not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.llm.common import staged
from spandrel.sources.tables import importable

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries of a leaf of the tree.
LEAF = 8
#: Vectors that are searched together.
BLOCK = 4096


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles, as 64-bit integers if all fit, else as Python's."""
    scaled = np.floor(values * SCALE) if values.size and np.abs(values).max() < 2.0**52 else None
    if scaled is not None and np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    whole = [math.floor(x * SCALE) if abs(x) < 2.0**52 else int(x) * SCALE for x in values.ravel().tolist()]
    return np.array(whole, object).reshape(values.shape) if whole else np.zeros(values.shape, np.int64)


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays, as Python's integers where squared distances between them could leave 64 bits."""
    width = max(1, arrays[0].shape[-1])
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return [a.astype(object) for a in arrays] if 4 * most * most * width >= 1 << 62 else [a.astype(np.int64) for a in arrays]


@dataclass
class Node:
    """A node of the tree: the box of its entries; a leaf's entries in ascending index, or two children."""

    low: np.ndarray
    high: np.ndarray
    index: np.ndarray | None = None
    points: np.ndarray | None = None
    children: tuple[Node, Node] | None = None

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """Squared distances of the parts from the box: no entry in it is nearer."""
        off = np.maximum(np.maximum(self.low - asked, asked - self.high), 0)
        return (off * off).sum(axis=1)


def tree(entries: np.ndarray, index: np.ndarray | None = None) -> Node:
    """The kd-tree of a codebook, cut at the median of its widest component."""
    index = np.arange(len(entries)) if index is None else index
    own = entries[index]
    low, high = own.min(axis=0), own.max(axis=0)
    if len(index) <= LEAF or (low == high).all():
        index = np.sort(index)
        return Node(low, high, index, entries[index])
    order = index[np.argsort(own[:, int(np.argmax(high - low))], kind="stable")]
    half = len(order) // 2
    return Node(low, high, children=(tree(entries, order[:half]), tree(entries, order[half:])))


def nearest(root: Node, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry, ties to the lowest index."""
    best, found = np.zeros(len(asked), asked.dtype), np.full(len(asked), -1)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.children is None:
            off = asked[rows, None, :] - node.points[None]
            far = (off * off).sum(axis=2)
            at = far.argmin(axis=1)  # the first of equals, so the lowest index of the leaf
            least, index = far[np.arange(len(rows)), at], node.index[at]
            better = (found[rows] < 0) | (least < best[rows]) | ((least == best[rows]) & (index < found[rows]))
            best[rows[better]], found[rows[better]] = least[better], index[better]
            return
        left, right = node.children
        to_left, to_right = left.bounds(asked[rows]), right.bounds(asked[rows])
        near = to_left <= to_right
        for child, other, own, bound in ((left, right, near, to_right), (right, left, ~near, to_left)):
            visit(child, rows[own])
            later, bound = rows[own], bound[own]
            visit(other, later[bound <= best[later]])  # equal bounds too: a lower index may lie there

    visit(root, np.arange(len(asked)))
    return found, best


def kept_matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors as doubles); all vectors that take part must have one length."""
    lists = lists.cast(pa.list_(pa.float64()))
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    kept = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - size]))
    if len({*size[kept].tolist()}) > 1:
        raise ValueError("vectors of several lengths cannot be coded by one set of codebooks")
    dim = int(size[kept[0]]) if len(kept) else 0
    return kept, flat[(ends - size)[kept, None] + np.arange(dim)] if dim else np.zeros((len(kept), 0))


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """parts x entries x width: the parts of the `entries` vectors of smallest ids (of equal ids, the smaller vectors)."""
    x = F.col("x")
    bad = lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).filter(x.isNotNull() & ~F.exists(x, bad))
    first = [r["x"] for r in rows.orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()]
    if len({len(v) for v in first}) > 1 or (first and len(first[0]) % parts):
        raise ValueError(f"vectors must have one length that {parts} divides")
    width = len(first[0]) // parts if first else 0
    return np.stack(np.split(integers(np.array(first, float).reshape(len(first), parts * width)), parts, axis=1))


def searched(vectors: pa.Array, trees: list[Node], books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (rows, parts x rows x width integers, entry of each part, squared distance of each part)."""
    kept, doubles = kept_matrix(vectors)
    if len(kept) and doubles.shape[1] != len(books) * books.shape[2]:
        raise ValueError("vectors of several lengths cannot be coded by one set of codebooks")
    for a in range(0, len(kept), BLOCK):
        cut = np.stack(np.split(integers(doubles[a : a + BLOCK]), len(books), axis=1))
        found = [nearest(t, exact(own, book)[0]) for t, own, book in zip(trees, cut, books, strict=True)]
        yield kept[a : a + BLOCK], cut, np.stack([x for x, _ in found]), np.stack([x for _, x in found])


def improved(spark: SparkSession, vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part goes to its nearest entry, every entry to the floor of its parts' mean; unused ones stay."""
    shared = spark.sparkContext.broadcast((books, [tree(b) for b in books]))
    parts, entries, width = books.shape
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("part", "entry", "n")] + [T.StructField("sums", T.ArrayType(T.DecimalType(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, trees = shared.value
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), object)
        for batch in batches:
            for _, cut, found, _ in searched(batch.column(0), trees, own):
                for p in range(parts):
                    order = np.argsort(found[p], kind="stable")
                    used, at = np.unique(found[p][order], return_index=True)
                    sums[p, used] += np.add.reduceat(cut[p][order], at, axis=0).astype(object)
                    counts[p] += np.bincount(found[p], minlength=entries)
        p, e = np.nonzero(counts)
        if len(p):
            rows = pa.array([[str(x) for x in row] for row in sums[p, e].tolist()], pa.list_(pa.string())).cast(pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), rows], ["part", "entry", "n", "sums"])

    partial = vectors.mapInArrow(run, schema).groupBy("part", "entry")
    total = partial.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width))).alias("sums")).collect()
    shared.destroy()
    out = books.astype(object)
    for r in total:
        out[r["part"], r["entry"]] = [int(x) // r["n"] for x in r["sums"]]
    return narrowed(out)


def narrowed(books: np.ndarray) -> np.ndarray:
    """64-bit integers if all fit."""
    return books.astype(np.int64) if not books.size or int(np.abs(books).max()) < 1 << 62 else books


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """The codebooks after `rounds` rounds over all vectors: parts x entries x width integers."""
    importable(vectors.sparkSession)
    books = first_codebooks(vectors, parts, entries, id_col, vector_col)
    for _ in range(rounds if books.size else 0):
        books = improved(vectors.sparkSession, vectors.select(vector_col), books)
    return books


def encode(vectors: DataFrame, books: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error) of every vector that takes part: the entries' indexes in part order, two hex digits or
    more each, and the squared distance from them."""
    spark = vectors.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast((books, [tree(b) for b in books] if books.shape[1] else []))
    kind = {f.name: f.dataType for f in vectors.schema.fields}
    schema = T.StructType([T.StructField("id", kind[id_col]), T.StructField("label", kind[label_col]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    digits = max(2, -(-max(0, books.shape[1] - 1).bit_length() // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, trees = shared.value
        names = np.array([f"{e:0{digits}x}" for e in range(own.shape[1])], object)
        for batch in batches:
            for rows, _, found, far in searched(batch.column(0), trees, own):
                at = pa.array(rows)
                errors = pa.array([sum(x) for x in zip(*far.tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array(names[found].sum(axis=0), pa.string()), errors], ["id", "label", "code", "error"])

    return vectors.select(vector_col, id_col, label_col).mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that takes part, by codebooks learnt from all.
    Labels' sums are written first, so that they are joined as their size allows."""
    books = learn(vectors, parts, entries, rounds, id_col, vector_col)
    rows = staged(encode(vectors, books, id_col, vector_col, label_col), "codes")
    sums = staged(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL: distances to all entries, for each round anew."""
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
cells AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(v) // {parts}) AS part, (i - 1) % (len(v) // {parts}) AS pos, v[i] AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT part, entry, pos, x FROM cells JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept) USING (vec_id) WHERE entry < {entries})"""
    for r in range(rounds + 1):
        sql += f""",
far{r} AS (SELECT vec_id, part, entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM cells c JOIN book{r} b USING (part, pos) GROUP BY ALL),
own{r} AS MATERIALIZED (SELECT vec_id, part, min(d * {entries} + entry) % {entries} AS entry, min(d * {entries} + entry) // {entries} AS d FROM far{r} GROUP BY ALL)"""
        if r < rounds:
            sql += f""",
sum{r} AS (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM cells JOIN own{r} USING (vec_id, part) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM book{r} LEFT JOIN sum{r} USING (part, entry, pos))"""
    return f"""{sql},
rows AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM own{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM rows JOIN kept USING (vec_id)
"""
