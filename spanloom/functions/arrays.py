"""Folds over the arrays of a row, linear in their length, on whole Arrow batches.

Spark's ``aggregate`` copies an array whenever it appends to it, and finding the
nearest of many values compares all of them, so both are quadratic in the text.
Here the arrays of a batch lie one behind the other in one buffer, and every
fold is a few numpy operations on it.  Rows aren't shuffled, and only the arrays
themselves go to Python.

Null arrays have null results; null entries of number arrays don't occur.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

SPANS = ArrayType(StructType().add("s", IntegerType()).add("e", IntegerType()))
LABELLED = ArrayType(StructType().add("s", IntegerType()).add("e", IntegerType()).add("label", StringType()))
NUMBERS = ArrayType(IntegerType())
_SHIFT = np.int64(1) << 33  # keeps the values of one row apart from those of the next


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Sizes of the lists (0 for nulls) and their entries one behind the other."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _first(sizes: np.ndarray) -> np.ndarray:
    """Which entries are the first of their list."""
    first = np.zeros(int(sizes.sum()), dtype=bool)
    first[_starts(sizes)[sizes > 0]] = True
    return first


def _rows(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)


def _lists(sizes: np.ndarray, values: pa.Array, like: pa.Array) -> pa.Array:
    """Lists of the given sizes, null where ``like`` is."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=like.is_null() if like.null_count else None)


def _spans(s: np.ndarray, e: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["s", "e"])


def _count(flags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many entries of each list are flagged."""
    return np.bincount(_rows(sizes)[flags], minlength=len(sizes)).astype(np.int64)


def _groups(opens: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of the entry that opens each group and end of the last entry in it."""
    at = np.flatnonzero(opens)
    return s[at], e[np.append(at[1:], len(opens)) - 1] if len(at) else e[:0]


@arrow_udf(SPANS)
def tiled_spans(lengths: pa.Array) -> pa.Array:
    """Spans of consecutive pieces from the array of their lengths."""
    sizes, flat = _flat(lengths)
    n = _numbers(flat)
    end = np.cumsum(n)
    end -= np.repeat(np.concatenate([[0], end])[_starts(sizes)], sizes)
    return _lists(sizes, _spans(end - n, end), lengths)


@arrow_udf(SPANS)
def grouped_spans(lengths: pa.Array, opens: pa.Array) -> pa.Array:
    """Spans of runs of consecutive pieces; a piece that opens one, or is the first, starts a new span."""
    sizes, flat = _flat(lengths)
    n = _numbers(flat)
    end = np.cumsum(n)
    end -= np.repeat(np.concatenate([[0], end])[_starts(sizes)], sizes)
    flags = _first(sizes) | pc.fill_null(opens.flatten(), False).to_numpy(zero_copy_only=False)
    return _lists(_count(flags, sizes), _spans(*_groups(flags, end - n, end)), lengths)


def _merge(spans: pa.Array, touching: bool) -> pa.Array:
    sizes, flat = _flat(spans)
    s, e = _numbers(flat.field(0)), _numbers(flat.field(1))
    apart = _rows(sizes) * _SHIFT
    reach = np.maximum.accumulate(e + apart) - apart if len(e) else e
    before = np.concatenate([[0], reach[:-1]]) if len(e) else e
    opens = _first(sizes) | (s > before if touching else s >= before)
    return _lists(_count(opens, sizes), _spans(*_groups(opens, s, reach)), spans)


@arrow_udf(SPANS)
def merged_spans(spans: pa.Array) -> pa.Array:
    """Spans, sorted by start, of which those that overlap or touch are merged."""
    return _merge(spans, True)


@arrow_udf(SPANS)
def overlap_merged_spans(spans: pa.Array) -> pa.Array:
    """Spans, sorted by start, of which those that overlap are merged; those that only touch stay apart."""
    return _merge(spans, False)


@arrow_udf(SPANS)
def retiled_spans(spans: pa.Array, n: pa.Array) -> pa.Array:
    """Spans of which each ends where the next starts and the last at the end of the text; a lone one is the whole text."""
    sizes, flat = _flat(spans)
    row, start = _rows(sizes), flat.field(0)
    at = np.arange(len(row))
    last = np.append(row[1:] != row[:-1], True) if len(row) else row.astype(bool)
    end = n.cast(pa.int32()).take(pa.array(row))
    following = pc.if_else(pa.array(last), end, pc.coalesce(start.take(pa.array(np.minimum(at + 1, max(len(row) - 1, 0)))), end))
    start = pc.if_else(pa.array(sizes[row] == 1), pa.scalar(0, pa.int32()), start.cast(pa.int32()))
    return _lists(sizes, pa.StructArray.from_arrays([start, following.cast(pa.int32())], ["s", "e"]), spans)


@arrow_udf(LABELLED)
def label_runs(units: pa.Array) -> pa.Array:
    """Runs of equal labels (null equals null) of (s, e, label) units: the first unit's start to the last unit's end."""
    sizes, flat = _flat(units)
    labels = flat.field(2)
    code = pc.fill_null(labels.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    opens = _first(sizes)
    opens[1:] |= code[1:] != code[:-1]
    s, e = _groups(opens, _numbers(flat.field(0)), _numbers(flat.field(1)))
    runs = pa.StructArray.from_arrays([pa.array(s, pa.int32()), pa.array(e, pa.int32()), labels.take(pa.array(np.flatnonzero(opens)))], ["s", "e", "label"])
    return _lists(_count(opens, sizes), runs, units)


@arrow_udf(NUMBERS)
def frequent(values: pa.Array, least: pa.Array) -> pa.Array:
    """Distinct values of a sorted array that occur at least so often."""
    sizes, flat = _flat(values)
    v, row = _numbers(flat), _rows(sizes)
    opens = _first(sizes)
    opens[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(opens)
    at = at[np.diff(np.append(at, len(v))) >= _numbers(least)[row[at]]]
    return _lists(np.bincount(row[at], minlength=len(sizes)).astype(np.int64), pa.array(v[at], pa.int32()), values)


@arrow_udf(NUMBERS)
def cluster_heads(values: pa.Array, distance: pa.Array) -> pa.Array:
    """Values of a sorted array that lie more than a distance behind the last one that was kept."""
    out = []
    for row, d in zip(values.to_pylist(), distance.to_pylist()):
        if row is None:
            out.append(None)
            continue
        kept, i = [], 0
        while i < len(row):
            kept.append(row[i])
            i = bisect_right(row, row[i] + d, i)
        out.append(kept)
    return pa.array(out, pa.list_(pa.int32()))


@arrow_udf(NUMBERS)
def nearest(values: pa.Array, others: pa.Array) -> pa.Array:
    """Distance of each value to the nearest of the others of its row; null entries where there are none."""
    sizes, flat = _flat(values)
    other_sizes, other_flat = _flat(others)
    v = _numbers(flat) + _rows(sizes) * _SHIFT
    o = np.sort(_numbers(other_flat) + _rows(other_sizes) * _SHIFT)
    if not len(o):
        return _lists(sizes, pa.nulls(len(v), pa.int32()), values)
    at = np.searchsorted(o, v)
    best = np.minimum(np.abs(o[np.minimum(at, len(o) - 1)] - v), np.abs(o[np.maximum(at - 1, 0)] - v))
    # the values of other rows are far away
    return _lists(sizes, pa.array(np.where(best < _SHIFT // 2, best, 0), pa.int32(), mask=best >= _SHIFT // 2), values)


@arrow_udf(StructType().add("iou", DoubleType()).add("dice", DoubleType()))
def mean_overlaps(gold: pa.Array, pred: pa.Array) -> pa.Array:
    """Means over gold spans of the best intersection over union, and of the best Dice score, with a predicted span.

    Spans of no length don't count; null without gold spans.  Each gold span
    meets the predicted ones between the first that ends behind its start and
    the last that starts before its end.
    """

    def sides(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes, flat = _flat(spans)
        row, s, e = _rows(sizes), _numbers(flat.field(0)), _numbers(flat.field(1))
        kept = e > s
        row, s, e = row[kept], s[kept], e[kept]
        order = np.lexsort((e, s, row))
        return row[order], s[order], e[order]

    row, gs, ge = sides(gold)
    prow, ps, pe = sides(pred)
    apart, papart = row * _SHIFT, prow * _SHIFT
    reach = np.maximum.accumulate(pe + papart) if len(pe) else pe
    low, high = np.searchsorted(reach, gs + apart, side="right"), np.searchsorted(ps + papart, ge + apart, side="left")
    n = np.maximum(high - low, 0)
    own = np.repeat(np.arange(len(row)), n)
    other = np.arange(int(n.sum())) - np.repeat(_starts(n), n) + np.repeat(low, n)
    inter = np.maximum(np.minimum(ge[own], pe[other]) - np.maximum(gs[own], ps[other]), 0).astype(float)
    both = (ge - gs)[own] + (pe - ps)[other]
    out = []
    rows = len(gold)
    spans = np.bincount(row, minlength=rows)
    for value in (inter / (both - inter), 2 * inter / both):
        best = np.zeros(len(row))
        np.maximum.at(best, own, value)
        total = np.bincount(row, weights=best, minlength=rows)
        out.append(pa.array(total / np.maximum(spans, 1), mask=spans == 0))
    return pa.StructArray.from_arrays(out, ["iou", "dice"])


@arrow_udf(StructType().add("p_k", DoubleType()).add("window_diff", DoubleType()))
def window_rates(gold: pa.Array, pred: pa.Array, n: pa.Array, k: pa.Array) -> pa.Array:
    """Shares of positions 0 <= i < n - k whose windows (i, i + k] hold a boundary on one side only, and unlike numbers of boundaries.

    The numbers change only where i passes a boundary b or b - k, so each stretch
    between such points is judged once and weighed by its length.  Null where the
    text isn't longer than the window.
    """
    rates: tuple[list, list] = ([], [])
    for g, p, size, w in zip(gold.to_pylist(), pred.to_pylist(), n.to_pylist(), k.to_pylist()):
        if g is None or p is None or size is None or w is None or size <= w:
            rates[0].append(None)
            rates[1].append(None)
            continue
        ga, pa_ = np.sort(np.array(g, dtype=np.int64)), np.sort(np.array(p, dtype=np.int64))
        points = np.unique(np.concatenate([[0, size - w], ga, pa_, ga - w, pa_ - w]))
        points = points[(points >= 0) & (points <= size - w)]
        i, width = points[:-1], np.diff(points)
        inside = [np.searchsorted(b, i + w, side="right") - np.searchsorted(b, i, side="right") for b in (ga, pa_)]
        rates[0].append(float(width[(inside[0] == 0) != (inside[1] == 0)].sum() / (size - w)))
        rates[1].append(float(width[inside[0] != inside[1]].sum() / (size - w)))
    return pa.StructArray.from_arrays([pa.array(r, pa.float64()) for r in rates], ["p_k", "window_diff"])
