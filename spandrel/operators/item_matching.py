"""Greedy matching of the items of many records at once, for the rows of an Arrow batch. The tasks of `receipts.record_scores`
call it; `receipts.matched_items` is the same rule as an expression of one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of items that are compared at once, cells of the tables of edits that are held at once, and the pairs
#: under which numpy's own running minimum is faster than one call a place.
PAIRS_AT_ONCE = 500_000
CELLS_AT_ONCE = 100_000
FEW = 256


def edits(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of texts: a and b have a row a text, code points padded, and n_a and n_b their lengths. Places
    beyond a text's end are never read. A row of the table is held less its places, so that insertions are a running minimum."""
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    row, found = np.zeros((len(b) + 1, len(n_a)), dtype=np.int32), n_b.astype(np.int32)
    for i in range(len(a)):
        new = np.empty_like(row)
        new[0] = i + 1
        np.minimum(row[1:] + 1, row[:-1] - (b == a[i]), out=new[1:])
        if len(n_a) < FEW:
            np.minimum.accumulate(new, axis=0, out=new)
        else:
            for j in range(1, len(new)):
                np.minimum(new[j], new[j - 1], out=new[j])
        row, ends = new, np.flatnonzero(n_a == i + 1)
        found[ends] = row[n_b[ends], ends] + n_b[ends]
    return found


def similarities(texts: list[str | None], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """functions.receipts.fuzzy of the texts (all different) numbered a and b, pair by pair; -1 for pairs whose lengths alone
    put them under the threshold."""
    size = np.array([len(t or "") for t in texts], dtype=np.int64)
    null = np.array([t is None for t in texts])
    longer = np.maximum(size[a], size[b])
    most = 1 - np.abs(size[a] - size[b]) / np.maximum(longer, 1)
    out = np.where(null[a] | null[b], 0.0, np.where(most >= threshold, most, -1.0))
    out[a == b] = 1.0
    open_ = np.flatnonzero((a != b) & ~null[a] & ~null[b] & (most >= threshold))
    open_ = open_[np.argsort(longer[open_], kind="stable")]  # texts of like length share a table
    points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype=np.int32) for t in texts]
    start = 0
    while start < len(open_):
        count = max(1, CELLS_AT_ONCE // int(longer[open_[start]] + 1))
        part = open_[start : start + count]
        while len(part) > 1 and len(part) * int(longer[part[-1]] + 1) > 2 * CELLS_AT_ONCE:
            part = part[: len(part) // 2]
        names, at = np.unique(np.concatenate([a[part], b[part]]), return_inverse=True)
        codes = np.zeros((len(names), int(longer[part[-1]])), dtype=np.int32)
        for k, n in enumerate(names):
            codes[k, : size[n]] = points[n]
        x, y = at[: len(part)], at[len(part) :]
        out[part] = 1 - edits(codes[x], size[a[part]], codes[y], size[b[part]]) / longer[part]
        start += len(part)
    return out


def _near(n_gt: np.ndarray, n_pred: np.ndarray, gt: np.ndarray, pred: np.ndarray, texts: list[str | None], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(gt item, predicted item, similarity) of the pairs of a record's items at or over the threshold, by rising places; items
    are numbered over all records. Some PAIRS_AT_ONCE pairs at a time, whatever a record's size."""
    mates, first = np.repeat(n_pred, n_gt), np.repeat(np.cumsum(n_pred) - n_pred, n_gt)
    ends = np.cumsum(mates)
    at = 0
    while at < len(mates):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        n = mates[at:to]
        g = np.repeat(np.arange(at, to), n)
        p = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
        which, kinds = pd.factorize(gt[g].astype(np.int64) * len(texts) + pred[p])
        s = similarities(texts, kinds // len(texts), kinds % len(texts), threshold)[which] if len(g) else np.zeros(0)
        keep = s >= threshold
        yield g[keep], p[keep], s[keep]
        at = to


def matches(n_gt: np.ndarray, n_pred: np.ndarray, gt: pa.Array, pred: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gt item, predicted item, similarity) of the greedy one-to-one matches within each record, by falling similarity, then
    places. gt and pred are names of the records' items one after the other, n_gt and n_pred the items of each record. A pair
    that comes before all others of both its items is a match; what is left of other items is looked at again."""
    names = pa.concat_arrays([gt, pred]).dictionary_encode()
    texts = [t.decode("utf-8", "surrogateescape") for t in names.dictionary.cast(pa.binary()).to_pylist()] + [None]
    code = names.indices.fill_null(len(texts) - 1).to_numpy(zero_copy_only=False)
    parts = [*_near(n_gt, n_pred, code[: len(gt)], code[len(gt) :], texts, threshold)] or [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)]
    g, p, s = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(-s, kind="stable")
    g, p, s = g[order], p[order], s[order]
    left, taken = np.arange(len(g)), []
    best_g, best_p = np.empty(len(gt), dtype=np.int64), np.empty(len(pred), dtype=np.int64)
    used_g, used_p = np.zeros(len(gt), dtype=bool), np.zeros(len(pred), dtype=bool)
    while len(left):
        gs, ps = g[left], p[left]
        best_g[gs[::-1]], best_p[ps[::-1]] = left[::-1], left[::-1]  # the last write is the first pair's
        won = (best_g[gs] == left) & (best_p[ps] == left)
        taken.append(left[won])
        used_g[gs[won]], used_p[ps[won]] = True, True
        left = left[~(used_g[gs] | used_p[ps])]
    at = np.sort(np.concatenate(taken)) if taken else left
    return g[at], p[at], s[at]


def _equal(a: pa.Array, b: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a[i] and b[j] are equal as Spark sees it: nulls equal each other, as do NaNs, and -0.0 is 0.0."""
    values = pa.concat_arrays([a, b])
    if pa.types.is_floating(values.type):
        values = pc.add(values, pa.scalar(0.0, values.type))
    code = values.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return code[: len(a)][i] == code[len(a) :][j]


def sums(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For rows (key, gt names, gt amounts, predicted names, predicted amounts): key, the numbers of matches, of unmatched
    predicted and of unmatched gt items, of matches with equal amounts and with equal names, and the sum of similarities."""
    for batch in batches:
        key, gt, gt_amount, pred, pred_amount = batch.columns
        n_gt, n_pred = (pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (gt, pred))
        g, p, s = matches(n_gt, n_pred, gt.flatten(), pred.flatten(), threshold)
        record = np.repeat(np.arange(len(key)), n_gt)[g]
        count = lambda x: np.bincount(record[x], minlength=len(key))  # noqa: E731, B023
        tp = count(slice(None))
        same = count(_equal(gt_amount.flatten(), pred_amount.flatten(), g, p))
        numbers = [tp, n_pred - tp, n_gt - tp, same, count(s == 1.0)]
        alike = np.bincount(record, weights=s, minlength=len(key)).astype(np.float64)
        yield pa.RecordBatch.from_arrays([key, *(pa.array(x, pa.int64()) for x in numbers), pa.array(alike)], names=[batch.schema.names[0], "tp", "fp", "fn", "same", "names", "alike"])
