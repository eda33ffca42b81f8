"""Late fusion of several segmentations of one text.

``all_spans`` is an array with the spans of each engine.  Flatten, union,
intersect, voting and fuzzy sort the boundaries of a row and count them; the best
path and label fusion walk the spans once.  All are linear in the spans but for
sorting, and nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import arrays, pair_up, starts_and_ends

SPANS = "array<struct<s:int,e:int>>"
_ARROW_SPAN = pa.struct([("s", pa.int32()), ("e", pa.int32())])
_EMPTY = f"CAST(array() AS {SPANS})"


def flattened(all_spans: str = "all_spans") -> str:
    """Sorted distinct starts and ends of all engines."""
    return starts_and_ends(f"flatten({all_spans})")


def union(df: DataFrame, all_spans: str = "all_spans") -> DataFrame:
    """Adds ``fused``: spans between all consecutive boundaries."""
    return df.withColumn("_b", F.expr(flattened(all_spans))).withColumn("fused", F.expr(pair_up("_b"))).drop("_b")


def intersect(df: DataFrame, all_spans: str = "all_spans") -> DataFrame:
    """Adds ``fused``: spans between the boundaries that every engine has, 0 and the greatest boundary."""
    per_engine = f"array_sort(flatten(transform({all_spans}, x -> array_distinct(concat(transform(x, y -> y.s), transform(x, y -> y.e))))))"
    out = df.withColumn("_all", F.expr(per_engine)).withColumn("_n", arrays.frequent("_all", F.size(all_spans)))
    out = out.withColumn("_b", F.expr("CASE WHEN size(_all) = 0 THEN CAST(array() AS array<int>) ELSE array_sort(array_distinct(concat(_n, array(0, element_at(_all, -1))))) END"))
    return out.withColumn("fused", F.expr(pair_up("_b"))).drop("_all", "_n", "_b")


def voting(df: DataFrame, threshold: int | None = None, all_spans: str = "all_spans") -> DataFrame:
    """Adds ``fused``: spans between boundaries with enough votes.  Starts and an engine's last end are votes; the threshold is by default more than half of the engines."""
    votes = f"array_sort(flatten(transform({all_spans}, x -> concat(transform(x, y -> y.s), IF(size(x) > 0, array(element_at(x, -1).e), CAST(array() AS array<int>))))))"
    enough = F.lit(threshold) if threshold is not None else F.expr(f"CAST(size({all_spans}) div 2 + 1 AS int)")
    return df.withColumn("_b", arrays.frequent(F.expr(votes), enough)).withColumn("fused", F.expr(pair_up("_b"))).drop("_b")


def fuzzy(df: DataFrame, distance: int = 1, all_spans: str = "all_spans") -> DataFrame:
    """Adds ``fused``: spans between cluster heads; a boundary within ``distance`` of its cluster's first is dropped, so the last one may vanish."""
    return df.withColumn("_b", arrays.cluster_heads(F.expr(flattened(all_spans)), F.lit(distance))).withColumn("fused", F.expr(pair_up("_b"))).drop("_b")


def best_path(segmentations: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Spans of the path over all boundaries that collects the most votes; a vote is a span of an engine.

    A path may start anywhere; of equal paths into a boundary the one from the
    smallest boundary counts.  What lies before the first and behind the last
    boundary is added.
    """
    weight = Counter((s, e) for spans in segmentations for s, e in spans)
    nodes = sorted({b for edge in weight for b in edge})
    if not nodes:
        return []
    into: dict[int, list[int]] = {}
    for s, e in sorted(weight):
        into.setdefault(e, []).append(s)
    total: dict[int, int] = {}
    source: dict[int, int | None] = {}
    for b in nodes:
        total[b], source[b] = 0, None
        for s in into.get(b, ()):
            if s < b and total[s] + weight[s, b] > total[b]:
                total[b], source[b] = total[s] + weight[s, b], s
    path = [nodes[-1]]
    while (s := source[path[-1]]) is not None:
        path.append(s)
    path.reverse()
    if path[0] > nodes[0]:
        path.insert(0, nodes[0])
    if path[0] != 0:
        path.insert(0, 0)
    return list(zip(path, path[1:]))


def graph(df: DataFrame, keys: list[str], all_spans: str = "all_spans") -> DataFrame:
    """(keys, fused) by best_path."""
    narrow = df.select(*keys, all_spans)
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fused = [[dict(zip("se", span)) for span in best_path([[(x["s"], x["e"]) for x in engine] for engine in row or []])] for row in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(fused, pa.list_(_ARROW_SPAN))], names=[*keys, "fused"])

    types = dict(narrow.dtypes)
    return narrow.mapInArrow(walk, ", ".join(f"`{k}` {types[k]}" for k in keys) + f", fused {SPANS}")


def fused_labels(fused: list[tuple[int, int]], engines: list[list[tuple[int, int, str]]], mode: str = "majority") -> list[str]:
    """A label for each fused span from the labels of the engines' spans that overlap it.

    Labels that hold "unk" don't count.  majority: the most frequent, of equal
    ones the first in order of engines and spans; concat: all distinct ones,
    sorted, joined by +; UNK if there is none.
    """
    if mode not in ("majority", "concat"):
        raise ValueError(f"unknown label mode {mode!r}")
    gathered: list[list[str]] = [[] for _ in fused]
    starts = [s for s, _ in fused]
    for spans in engines:
        for s, e, label in spans:
            if label is None or "unk" in label.lower() or e <= s:
                continue
            k = max(bisect_right(starts, s) - 1, 0)
            while k < len(fused) and fused[k][0] < e:
                if min(e, fused[k][1]) > max(s, fused[k][0]):
                    gathered[k].append(label)
                k += 1
    if mode == "concat":
        return ["+".join(sorted(set(g))) or "UNK" for g in gathered]
    return [Counter(g).most_common(1)[0][0] if g else "UNK" for g in gathered]


def label_fusion(df: DataFrame, keys: list[str], mode: str = "majority") -> DataFrame:
    """(keys, labelled) from ``fused`` and ``all_labelled``, the engines' arrays of (s, e, label)."""
    if mode not in ("majority", "concat"):
        raise ValueError(f"unknown label mode {mode!r}")
    narrow = df.select(*keys, "fused", "all_labelled")
    k = len(keys)
    out_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("label", pa.string())]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for fused, engines in zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist()):
                spans = [(x["s"], x["e"]) for x in fused or []]
                labels = fused_labels(spans, [[(x["s"], x["e"], x["label"]) for x in engine or []] for engine in engines or []], mode)
                rows.append([{"s": s, "e": e, "label": label} for (s, e), label in zip(spans, labels)])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k)), pa.array(rows, out_type)], names=[*keys, "labelled"])

    types = dict(narrow.dtypes)
    return narrow.mapInArrow(walk, ", ".join(f"`{c}` {types[c]}" for c in keys) + ", labelled array<struct<s:int,e:int,label:string>>")


ALIGNERS = {"union": union, "intersect": intersect, "voting": voting, "fuzzy": fuzzy}
