"""Evolutionary search over combinations of engines and aligners.

A configuration is a 64-bit mask of engines and an aligner's number.  Random
draws are hashes of a seed, the generation and the draw's place, so a generation
is a plan of expressions without state and comes out alike on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.fusion import best_path
from spanloom.partitions import shared_dir, spread

#: Aligners by number.
ALIGNERS = ["union", "intersect", "voting", "fuzzy", "graph"]
#: Share of engines in a random mask, chance of a new aligner, draws of a tournament, share of elites, score of a configuration without one.
DENSITY, REDRAW, DRAWS, ELITE, MISSING = 0.25, 0.05, 7, 16, -1e30
#: Most configurations of a generation, and how many are scored at a time.
POPULATION, BLOCK = 100_000, 4_096


def draw(*parts: str) -> str:
    """A number in [0, 1) from the hash of its parts (SQL texts)."""
    return f"CAST(conv(substring(md5(concat_ws(':', {', '.join(parts)})), 1, 8), 16, 10) AS bigint) / 4294967296D"


def drawn_mask(bits: int, chance: float, *parts: str) -> str:
    """A mask whose bits are set with this chance each, by a fold over the bits."""
    return f"aggregate(sequence(0, {bits - 1}), 0L, (m, i) -> m + IF({draw(*parts, 'i')} < {chance!r}D, shiftleft(1L, i), 0L))"


def one_bit(bits: int, *parts: str) -> str:
    """A mask with a single drawn bit."""
    return f"shiftleft(1L, CAST(floor({draw(*parts)} * {bits}) AS int))"


def drawn_aligner(*parts: str) -> str:
    return f"CAST(floor({draw(*parts)} * {len(ALIGNERS)}) AS int)"


def population(spark: SparkSession, size: int, bits: int, seed: int = 1337) -> DataFrame:
    """(slot, mask, aligner_idx) of a first generation; no mask is 0: if no bit was drawn, one is."""
    slots = spark.range(size).select(F.col("id").cast("int").alias("slot"))
    masks = slots.selectExpr("slot", f"{drawn_mask(bits, DENSITY, f"'{seed}'", "'init'", 'slot')} AS m")
    return masks.selectExpr("slot", f"IF(m = 0, {one_bit(bits, f"'{seed}'", "'init'", 'slot', "'one'")}, m) AS mask", f"{drawn_aligner(f"'{seed}'", "'al'", 'slot')} AS aligner_idx")


def mutated(df: DataFrame, bits: int, generation: int, seed: int = 1337, redraw: float = REDRAW) -> DataFrame:
    """Each bit flipped with chance 1/bits and the aligner drawn anew with chance ``redraw``."""
    s, g = f"'{seed}'", f"'{generation}'"
    flipped = df.selectExpr("slot", "aligner_idx", f"mask ^ {drawn_mask(bits, 1.0 / bits, s, "'flip'", g, 'slot')} AS m")
    return flipped.selectExpr(
        "slot",
        f"IF(m = 0, {one_bit(bits, s, "'bit'", g, 'slot')}, m) AS mask",
        f"IF({draw(s, "'re'", g, 'slot')} < {redraw!r}D, {drawn_aligner(s, "'which'", g, 'slot')}, aligner_idx) AS aligner_idx",
    )


def crossed(pairs: DataFrame, bits: int, generation: int, seed: int = 1337) -> DataFrame:
    """(slot, mask, aligner_idx) from (slot, mask_a, mask_b, aligner_a, aligner_b): each bit from either parent; a child without engines is the first parent."""
    s, g = f"'{seed}'", f"'{generation}'"
    mixed = pairs.selectExpr("*", f"{drawn_mask(bits, 0.5, s, "'mix'", g, 'slot')} AS mix").selectExpr("*", "(mask_a & mix) | (mask_b & ~mix) AS child")
    return mixed.selectExpr("slot", "IF(child = 0, mask_a, child) AS mask", f"IF({draw(s, "'par'", g, 'slot')} < 0.5D, aligner_a, aligner_b) AS aligner_idx")


def tournament(scored: DataFrame, slots: int, generation: int, salt: str, seed: int = 1337, draws: int = DRAWS) -> DataFrame:
    """(slot, mask, aligner_idx, score): for each slot the best of ``draws`` configurations drawn with replacement; of equal ones the first drawn.

    ``scored`` is (slot, mask, aligner_idx, score), slots numbered from 0.
    """
    n = scored.count()
    spark = scored.sparkSession
    picks = spark.range(slots).select(F.col("id").cast("int").alias("out"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("k"))
    picks = picks.select("out", "k", F.expr(f"CAST(floor({draw(f"'{seed}'", f"'{salt}'", f"'{generation}'", 'out', 'k')} * {n}) AS int) AS slot"))
    best = picks.join(scored, "slot").groupBy("out").agg(F.max(F.struct("score", (-F.col("k")).alias("nk"), "mask", "aligner_idx")).alias("w"))
    return best.select(F.col("out").alias("slot"), F.col("w.mask").alias("mask"), F.col("w.aligner_idx").alias("aligner_idx"), F.col("w.score").alias("score"))


def decoded(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``engines``, the names of the mask's bits in order, and ``approach``, their names and the aligner's joined by _."""
    listed = F.array(*map(F.lit, names))
    bits = f"filter(sequence(0, {len(names) - 1}), i -> (shiftright(mask, i) & 1) = 1)"
    out = df.withColumn("_n", listed).withColumn("engines", F.expr(f"transform({bits}, i -> get(_n, i))")).drop("_n")
    aligner = F.element_at(F.array(*map(F.lit, ALIGNERS)), F.col("aligner_idx") + 1)
    return out.withColumn("approach", F.when(F.size("engines") > 1, F.concat_ws("_", F.concat_ws("_", "engines"), aligner)).otherwise(F.concat_ws("_", "engines")))


def insert_ignore(results: DataFrame, fresh: DataFrame) -> DataFrame:
    """results and the rows of fresh whose (mask, aligner_idx) they don't hold."""
    keys = ["mask", "aligner_idx"]
    new = fresh.groupBy(*keys).agg(F.max("score").alias("score")).join(results, keys, "left_anti")
    return results.select(*keys, "score").unionByName(new)


def lookup(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Scores of the wanted keys that are known."""
    return wanted.select("mask", "aligner_idx").distinct().join(results, ["mask", "aligner_idx"])


def elites(scored: DataFrame, n: int) -> DataFrame:
    """The n best configurations; ties by mask and aligner."""
    return scored.orderBy(F.desc("score"), "mask", "aligner_idx").limit(n)


def numbered(df: DataFrame) -> DataFrame:
    """slot anew, from 0 by falling score, of a generation, which holds at most ``POPULATION`` rows."""
    return df.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("score"), "mask", "aligner_idx")) - 1)


# -- scores of configurations ---------------------------------------------------
def fused_boundaries(engines: list[list[tuple[int, int]]], aligner: str, distance: int = 1) -> np.ndarray:
    """Boundaries, first and last included, of the fusion of several engines' spans; of a single engine its own."""
    sides = [np.unique(np.array(x, dtype=np.int64)) for x in engines]
    if len(sides) == 1:
        return sides[0]
    if aligner == "graph":
        return np.unique(np.array(best_path(engines), dtype=np.int64))
    if aligner == "voting":
        votes = np.array([b for x in engines if x for b in [*(s for s, _ in x), x[-1][1]]], dtype=np.int64)
        values, counts = np.unique(votes, return_counts=True)
        return values[counts >= len(engines) // 2 + 1]
    values, counts = np.unique(np.concatenate(sides), return_counts=True)
    if aligner == "intersect":
        return np.unique(np.concatenate([values[counts == len(sides)], [0], values[-1:]])) if len(values) else values
    if aligner == "fuzzy":
        kept, at = [], 0
        while at < len(values):
            kept.append(values[at])
            at = int(np.searchsorted(values, values[at] + distance, side="right"))
        return np.array(kept, dtype=np.int64)
    return values


def boundary_similarity(a: np.ndarray, b: np.ndarray, window: float) -> float:
    """The B-score of two sorted arrays of inner boundaries."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))

    def near(x: np.ndarray, y: np.ndarray) -> float:
        at = np.searchsorted(y, x)
        gap = np.minimum(np.abs(y[np.minimum(at, len(y) - 1)] - x), np.abs(y[np.maximum(at - 1, 0)] - x))
        return float((gap <= window).mean())

    p, r = near(a, b), near(b, a)
    return 2 * p * r / (p + r) if p + r else 0.0


def scorer(texts: DataFrame, bits: int, window: float = 3.0) -> Callable[[DataFrame], DataFrame]:
    """Scores configurations by their fused spans' mean agreement with gold boundaries.

    ``texts`` is (gb, pool): a text's gold boundaries and the spans of every
    engine.  Configurations are a stated set of at most ``POPULATION``, sent along
    in blocks of ``BLOCK``; each task returns a sum for each of them, so no text
    is joined with anything.
    """
    packed = spread(texts.select("gb", "pool")).persist()
    schema = "mask bigint, aligner_idx int, total double, n bigint"

    def block(wanted: list[tuple[int, int]]) -> DataFrame:
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals, n = np.zeros(len(wanted)), 0
            for b in batches:
                for gold, pool in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    spans = [[(x["s"], x["e"]) for x in engine or []] for engine in pool]
                    inner = np.unique(np.array(gold, dtype=np.int64))
                    n += 1
                    for i, (mask, aligner) in enumerate(wanted):
                        found = fused_boundaries([spans[k] for k in range(bits) if mask >> k & 1], ALIGNERS[aligner])
                        totals[i] += boundary_similarity(inner, found[1:-1], window)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in wanted], pa.int64()), pa.array([a for _, a in wanted], pa.int32()), pa.array(totals), pa.array([n] * len(wanted), pa.int64())], names=["mask", "aligner_idx", "total", "n"])

        return packed.mapInArrow(walk, schema)

    def score(configs: DataFrame) -> DataFrame:
        rows = sorted((r["mask"], r["aligner_idx"]) for r in configs.distinct().limit(POPULATION + 1).collect())
        if len(rows) > POPULATION:
            raise ValueError(f"a generation may hold {POPULATION} configurations")
        parts = configs.sparkSession.createDataFrame([], schema)
        for k in range(0, len(rows), BLOCK):
            parts = parts.unionByName(block(rows[k : k + BLOCK]))
        return parts.groupBy("mask", "aligner_idx").agg(F.round(F.sum("total") / F.sum("n"), 9).alias("score"))

    return score


def search(spark: SparkSession, score: Callable[[DataFrame], DataFrame], bits: int, size: int, generations: int, seed: int = 1337, offspring: int | None = None, target: int | None = None) -> DataFrame:
    """(mask, aligner_idx, score) of all configurations tried.

    ``score`` takes (mask, aligner_idx) rows and returns them with a score; only
    configurations that have none are given to it.  Of each generation's
    ``offspring`` (as many as its members by default) those that were tried
    before are replaced by newly drawn ones; with the elites, the ``size`` best
    make the next generation.  The search ends after so many generations, or
    when ``target`` configurations were tried.  Lineage is cut after every
    generation by a checkpoint in the shared folder.
    """
    if max(size, offspring or 0) > POPULATION:
        raise ValueError(f"a generation may hold {POPULATION} configurations")
    shared_dir(spark)
    keys = ["mask", "aligner_idx"]
    pool = population(spark, size, bits, seed).select(*keys).distinct()
    results = insert_ignore(spark.createDataFrame([], "mask bigint, aligner_idx int, score double"), score(pool)).checkpoint()
    for g in range(1, generations):
        if target is not None and results.count() >= target:
            break
        scored = numbered(pool.join(results, keys, "left").na.fill({"score": MISSING})).checkpoint()
        n = offspring or size
        a, b = tournament(scored, n, g, "a", seed), tournament(scored, n, g, "b", seed)
        pairs = a.select("slot", F.col("mask").alias("mask_a"), F.col("aligner_idx").alias("aligner_a")).join(b.select("slot", F.col("mask").alias("mask_b"), F.col("aligner_idx").alias("aligner_b")), "slot")
        children = mutated(crossed(pairs, bits, g, seed), bits, g, seed).select(*keys).distinct().join(results, keys, "left_anti")
        drawn = population(spark, n, bits, seed + g).select(*keys).distinct().join(results, keys, "left_anti")
        fresh = children.withColumn("_o", F.lit(0)).unionByName(drawn.join(children, keys, "left_anti").withColumn("_o", F.lit(1))).orderBy("_o", *keys).limit(n).select(*keys).checkpoint()
        results = insert_ignore(results, score(fresh)).checkpoint()
        kept = elites(scored, max(1, size // ELITE)).select(*keys)
        best = elites(fresh.join(results, keys), size - max(1, size // ELITE)).select(*keys)
        pool = kept.unionByName(best).distinct()
    return results


def report(results: DataFrame) -> DataFrame:
    """(aligner, n, best, mean): how the configurations of each aligner did."""
    name = F.element_at(F.array(*map(F.lit, ALIGNERS)), F.col("aligner_idx") + 1)
    return results.groupBy(name.alias("aligner")).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.avg("score").alias("mean"))


def extracted(results: DataFrame, names: list[str]) -> DataFrame:
    """(approach, engines, score) of all results."""
    return decoded(results, names).select("approach", F.array_join("engines", "+").alias("engines"), "score")
