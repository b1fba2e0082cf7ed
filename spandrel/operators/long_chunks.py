"""Fixed chunks of documents of any length: the fold of `chunking.fixed_chunks` as a scan over segments.

A document's elements come as rows. Only their costs (characters and a line end) travel: they are gathered in segments of
SEGMENT elements. A chunk that is open where a segment begins reaches back over `size` elements at most, as each costs one
or more, so a segment needs no more than that many costs of the one before it, and can be entered in no more than that
many states. For each state it is worked out how a segment is left and how many chunks it closes. These maps are small;
in the order of a document's segments they are applied one after the other, as a stream, which gives each segment its true
entry state and the number of its first chunk. Then every segment is replayed on its own.

So no task holds a document, and what one task reads of a document is `size` numbers for each SEGMENT elements.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.operators.chunking import OVERLAP, SIZE
from spandrel.sources.tables import importable, written_once

SEGMENT = 8192


@dataclass(frozen=True)
class Walk:
    """A segment's elements behind `back` elements of the segment before; ends[i]: costs before element i."""

    ends: np.ndarray
    back: int
    size: int
    overlap: int

    @classmethod
    def over(cls, tail: list[int], costs: list[int], size: int, overlap: int) -> Walk:
        return cls(np.concatenate([[0], np.cumsum(np.array([*tail, *costs], np.int64))]), len(tail), size, overlap)

    @property
    def last(self) -> int:
        return len(self.ends) - 1

    def close(self, first: int, taken: int) -> int:
        """The first element after `taken` that the chunk from `first` has no room for; `last` if it is not in here."""
        over = int(np.searchsorted(self.ends, self.ends[first] + self.size, "right")) - 1
        return min(self.last, max(over, taken + 1, first + 1))

    def after(self, first: int, at: int) -> int:
        """Where the chunk begins that element `at` goes to, once the one from `first` is closed before it."""
        return max(first, int(np.searchsorted(self.ends, self.ends[at] - self.overlap, "right")) - 1) if self.overlap else at

    def chunks(self, open_: int) -> Iterator[tuple[int, int]]:
        """(first, last) of the chunks that end in here, if `open_` elements before the segment are in the open one; then
        that of the chunk that stays open."""
        first, taken = self.back - open_, self.back - 1
        while (at := self.close(first, taken)) < self.last:
            yield first, at - 1
            first, taken = self.after(first, at), at
        yield first, self.last - 1

    def map(self, states: int) -> tuple[list[int], list[int]]:
        """(elements of the chunk that is open at the end, chunks closed) for 0 to `states` open elements. Walks meet soon:
        what follows a closed chunk is worked out once."""
        known: dict[tuple[int, int], tuple[int, int]] = {}
        left, closed = [], []
        for open_ in range(states + 1):
            first, taken, path = self.back - open_, self.back - 1, []
            while (first, taken) not in known:
                path.append((first, taken))
                at = self.close(first, taken)
                if at == self.last:
                    known[first, taken] = self.last - first, 0
                    break
                first, taken = self.after(first, at), at
            end, n = known[first, taken]
            for k, state in enumerate(reversed(path if path and path[-1] != (first, taken) else path[:-1]), 1):
                known[state] = end, n + k
            end, n = known[self.back - open_, self.back - 1]
            left.append(end)
            closed.append(n)
        return left, closed


def fixed_chunks(elements: DataFrame, key: str = "doc_id", ord_: str = "ord", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, segment: int = SEGMENT) -> DataFrame:
    """(key, chunk_idx, first, last): the chunks of `elements` (key, ord, text), with ord from 0 without gaps in a document.

    A null text is empty; elements are never cut; documents without elements have no chunks."""
    if not 0 <= overlap < size <= segment:
        raise ValueError("segment >= size > overlap >= 0")
    importable(elements.sparkSession)
    costs = elements.select(F.col(key).alias("key"), F.col(ord_).cast("long").alias("ord"), (F.length(F.coalesce(text, F.lit(""))) + 1).cast("long").alias("cost"))
    gathered = costs.groupBy("key", F.floor(F.col("ord") / segment).alias("segment")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "cost"))), lambda x: x["cost"]).alias("costs"))
    along = Window.partitionBy("key").orderBy("segment")
    tail = F.lag(F.slice("costs", F.greatest(F.lit(1), F.size("costs") - size + 1), F.lit(size))).over(along)
    ended = F.lead("segment").over(along).isNull()
    rows = written_once(gathered.select("key", "segment", "costs", F.coalesce(tail, F.array().cast("array<long>")).alias("tail"), ended.alias("ended")))
    kind = rows.schema["key"].dataType
    first_fields = [T.StructField("key", kind), T.StructField("segment", T.LongType())]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Walk.over(t, c, size, overlap).map(len(t)) for c, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in (0, 1))], ["key", "segment", "left", "closed"])

    small = rows.mapInArrow(maps, T.StructType([*first_fields, *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("left", "closed"))]))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, number = object(), 0, 0
        for batch in batches:
            out = []
            for key, left, closed in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if key != now:
                    now, open_, number = key, 0, 0
                out.append((open_, number))
                open_, number = left[open_], number + closed[open_]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[i] for x in out], pa.int64()) for i in (0, 1))], ["key", "segment", "open", "number"])

    entered = small.repartition("key").sortWithinPartitions("key", "segment").mapInArrow(entries, T.StructType([*first_fields, T.StructField("open", T.LongType()), T.StructField("number", T.LongType())]))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, at, c, t, ended, open_, number in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                walk = Walk.over(t, c, size, overlap)
                spans = list(walk.chunks(open_))
                out += [(key, number + k, at * segment - len(t) + a, at * segment - len(t) + b) for k, (a, b) in enumerate(spans if ended else spans[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.column(0).type), *(pa.array([x[i] for x in out], pa.int64()) for i in (1, 2, 3))], ["key", "chunk_idx", "first", "last"])

    joined = rows.join(entered, (rows["key"].eqNullSafe(entered["key"])) & (rows["segment"] == entered["segment"])).select(rows["key"], rows["segment"], "costs", "tail", "ended", "open", "number")
    found = joined.mapInArrow(replay, T.StructType([T.StructField("key", kind), *(T.StructField(n, T.LongType()) for n in ("chunk_idx", "first", "last"))]))
    return found.withColumnRenamed("key", key)
