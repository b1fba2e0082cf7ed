"""Lines of text boxes: a fold along the boxes of one image, inside the row that holds them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO, LEAST = 0.6, 5.0


def _keys(values: pa.Array) -> list[np.ndarray]:
    """Sort keys of a column, the weaker first: its values, then whether there is one (nulls come first)."""
    return [values.fill_null(0).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False)]


def _order(*columns: pa.Array | np.ndarray) -> np.ndarray:
    """The places of the rows in the order of the columns, the weakest first; whether there is a value tells rows apart only where
    some are null."""
    keys = [k for c in columns for k in ([c] if isinstance(c, np.ndarray) else _keys(c)[: 2 if c.null_count else 1])]
    return np.lexsort(keys)


def _lines(row: np.ndarray, yc: pa.Array, h: pa.Array, ratio: float) -> np.ndarray:
    """The line of each box; boxes come row by row, in order. All rows take a step together: the k-th box of each."""
    count = np.bincount(row) if len(row) else np.zeros(0, np.int64)
    start = np.cumsum(count) - count
    rows = np.argsort(-count, kind="stable")
    (y, has_y), (high, has_h) = _keys(yc), _keys(h)
    y, high = np.where(has_y, y, np.nan), np.where(has_h, high, np.nan)
    sum_y, sum_h, n, line = np.zeros(len(count)), np.zeros(len(count)), np.zeros(len(count), np.int64), np.full(len(count), -1, np.int64)
    all_y, all_h = np.ones(len(count), bool), np.ones(len(count), bool)
    out = np.zeros(len(row), np.int32)
    for k in range(int(count.max(initial=0))):
        r = rows[: np.searchsorted(-count[rows], -k)]  # those with more than k boxes
        at = start[r] + k
        with np.errstate(all="ignore"):
            reach = np.where(all_h[r], np.maximum(sum_h[r] / n[r] * ratio, LEAST), LEAST)
            # as in Spark, a NaN is larger than any number
            near = (np.abs(y[at] - sum_y[r] / n[r]) <= reach) | np.isnan(reach)
        joins = (n[r] > 0) & all_y[r] & has_y[at] & near
        sum_y[r], sum_h[r], n[r] = (np.where(joins, old + new, new) for old, new in ((sum_y[r], y[at]), (sum_h[r], high[at]), (n[r], 1)))
        all_y[r], all_h[r] = (np.where(joins, old & new, new) for old, new in ((all_y[r], has_y[at]), (all_h[r], has_h[at])))
        line[r] += ~joins
        out[at] = line[r]
    return out


def placed(boxes: pa.ListArray, flat: pa.StructArray, ratio: float = RATIO) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StructArray]:
    """(row, line, place in the row's array) of all boxes, by row, line, x and id; and the boxes in that order. flat: the
    boxes of all rows as (yc, h, x, id) and whatever else they have."""
    lengths = boxes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(boxes)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    yc, h, x, id_ = (flat.field(c) for c in ("yc", "h", "x", "id"))
    order = _order(x, h, id_, yc, row)
    line = _lines(row[order], yc.take(pa.array(order)), h.take(pa.array(order)), ratio)
    again = _order(id_.take(pa.array(order)), x.take(pa.array(order)), line, row[order])
    order = order[again]
    return row[order], line[again], place[order], flat.take(pa.array(order))


def line_starts(row: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Where each line starts among boxes in the order of `placed`."""
    return np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])])) if len(row) else np.zeros(0, np.int64)


def ends(row: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(n + 1)).astype(np.int32)


def _boxes(boxes: Column) -> Column:
    return F.transform(boxes, lambda b: F.struct(b["yc"].cast("double").alias("yc"), b["h"].cast("double").alias("h"), b["x"].cast("double").alias("x"), b["id"].cast("long").alias("id")))


def line_numbers(boxes: Column, ratio: float = RATIO) -> Column:
    """(line, x, id) of boxes (yc, h, x, id): sorted by centre, a box joins the line while it is no further from the
    line's mean centre than a share of its mean height, and never less than LEAST; else it starts the next line. Equal
    centres keep the order of their ids."""

    @F.arrow_udf("array<struct<line:int,x:double,id:bigint>>")
    def numbers(values: pa.Array) -> pa.Array:
        row, line, _, flat = placed(values, values.flatten(), ratio)
        told = pa.StructArray.from_arrays([pa.array(line, pa.int32()), flat.field("x"), flat.field("id")], ["line", "x", "id"])
        return pa.ListArray.from_arrays(pa.array(ends(row, len(values))), told, mask=values.is_null())

    return numbers(_boxes(boxes))


def lines_of(boxes: Column, ratio: float = RATIO) -> Column:
    """The lines of `line_numbers` as arrays of places in the array `boxes`, from left to right."""

    @F.arrow_udf("array<array<int>>")
    def places(values: pa.Array) -> pa.Array:
        row, line, place, _ = placed(values, values.flatten(), ratio)
        new = line_starts(row, line)
        inner = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(place, pa.int32()))
        return pa.ListArray.from_arrays(pa.array(ends(row[new], len(values))), inner, mask=values.is_null())

    return places(_boxes(boxes))
