"""Scores of segmentations against others.

Every metric is a column of two span arrays of one row (``gold`` and ``pred``,
lengths in ``n``), so a table of all metrics is one projection behind one join on
the text's key.  Evaluation boundaries are the ends of all spans but the last.
What holds boundaries or spans of both sides against each other is linear in
their number but for sorting.

Defined results for degenerate inputs: P_k and WindowDiff are null where the
text is not longer than their window; displacement is infinite if either side
has no boundary; a gold without boundaries has recall 1; shares of nothing are
as the metric's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import ends
from spanloom.functions.arrays import mean_overlaps, nearest, window_rates

#: Presets: decay of soft boundary scores, window of the B-score, slack of the cover, bins of the density.
SIGMA, WINDOW, SLACK, BINS = 5.0, 3, 10, 20


def with_boundaries(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Adds ``gb`` and ``pb``, the evaluation boundaries of both sides."""
    return df.withColumns({"gb": F.expr(ends(gold)), "pb": F.expr(ends(pred))})


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def near_share(a: str, b: str, window: float) -> Column:
    """Share of the boundaries a that have one of b within the window."""
    distance = nearest(F.col(a), F.col(b))
    return _ratio(F.size(F.filter(distance, lambda x: x <= window)), F.size(a))


def precision() -> Column:
    return F.when(F.size("pb") == 0, 0.0).otherwise(_ratio(F.size(F.array_intersect("gb", "pb")), F.size(F.array_distinct("pb"))))


def recall() -> Column:
    return F.when(F.size("gb") == 0, 1.0).otherwise(_ratio(F.size(F.array_intersect("gb", "pb")), F.size(F.array_distinct("gb"))))


def f_score(p: Column, r: Column) -> Column:
    """Harmonic mean; both sides are bound to a name, so each is computed once."""
    both = F.array(F.struct(p.cast("double").alias("p"), r.cast("double").alias("r")))
    return F.get(F.transform(both, lambda x: F.when(x["p"] + x["r"] > 0, 2 * x["p"] * x["r"] / (x["p"] + x["r"])).otherwise(0.0)), F.lit(0))


def _unless_empty(a: str, b: str, value: Column) -> Column:
    """1 if neither side has boundaries, 0 if one has none."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(value)


def b_score(a: str = "gb", b: str = "pb", window: float = WINDOW) -> Column:
    """Boundary similarity: harmonic mean of both directions' near shares; 1 if neither has boundaries, 0 if one has none."""
    return _unless_empty(a, b, f_score(near_share(a, b, window), near_share(b, a, window)))


def cover(a: str = "pb", b: str = "gb", slack: float = SLACK) -> Column:
    """Share of the boundaries a within the slack of any of b; 1 if a has none."""
    return F.when(F.size(a) == 0, 1.0).otherwise(near_share(a, b, slack))


def jitter_similarity(a: str = "gb", b: str = "pb", jitter: int = 3) -> Column:
    """One-sided similarity: boundaries of a near one of b, over the number of b (may exceed 1) and of a, in harmonic mean; if one has none, 1 if the other has none too, else 0."""
    near = F.size(F.filter(nearest(F.col(a), F.col(b)), lambda x: x <= jitter))
    return _unless_empty(a, b, f_score(_ratio(near, F.size(b)), _ratio(near, F.size(a))))


def soft(a: str, b: str, sigma: float = SIGMA) -> Column:
    """Mean decay of the distance from each boundary of a to the nearest of b."""
    return _ratio(F.aggregate(nearest(F.col(a), F.col(b)), F.lit(0.0), lambda t, x: t + F.exp(-x / sigma)), F.size(a))


def soft_precision() -> Column:
    return F.when(F.size("pb") == 0, F.when(F.size("gb") == 0, 1.0).otherwise(0.0)).when(F.size("gb") == 0, 0.0).otherwise(soft("pb", "gb"))


def soft_recall() -> Column:
    return F.when(F.size("gb") == 0, 1.0).when(F.size("pb") == 0, 0.0).otherwise(soft("gb", "pb"))


def soft_f() -> Column:
    return _unless_empty("gb", "pb", f_score(soft("pb", "gb"), soft("gb", "pb")))


def displacement() -> Column:
    """Mean distance from a gold boundary to the nearest predicted one."""
    total = F.aggregate(nearest(F.col("gb"), F.col("pb")), F.lit(0.0), lambda t, x: t + x)
    return F.when((F.size("gb") == 0) | (F.size("pb") == 0), float("inf")).otherwise(_ratio(total, F.size("gb")))


def bias() -> Column:
    """Surplus of predicted boundaries over gold ones, relative to the gold's number."""
    return F.expr("(size(pb) - size(gb)) / greatest(1, size(gb))")


def mean_iou() -> Column:
    """Mean over gold spans of the best intersection over union with a predicted span."""
    return mean_overlaps(F.col("gold"), F.col("pred"))["iou"]


def mean_dice() -> Column:
    """Mean over gold spans of the best Dice score with a predicted span."""
    return mean_overlaps(F.col("gold"), F.col("pred"))["dice"]


def density(b: str, bins: int = BINS) -> str:
    """Histogram of boundaries over the text as a density plus 1e-9; a boundary at the text's end lies in the last bin."""
    count = f"size(filter({b}, x -> least(CAST(floor(x * {bins} / n) AS int), {bins - 1}) = i))"
    return f"transform(sequence(0, {bins - 1}), i -> CASE WHEN size({b}) = 0 OR n = 0 THEN 1e-9D ELSE {count} / (size({b}) * (n / {bins}D)) + 1e-9D END)"


def density_jsd(a: str = "gb", b: str = "pb", bins: int = BINS) -> Column:
    """Half the sums of P ln(P/M) and Q ln(Q/M) of both densities, which are not normalised."""
    part = "zip_with({x}, {y}, (p, q) -> p * ln(p / ((p + q) / 2)))"
    p, q = density(a, bins), density(b, bins)
    total = "aggregate({v}, 0D, (t, v) -> t + v)"
    return F.expr(f"0.5D * {total.format(v=part.format(x=p, y=q))} + 0.5D * {total.format(v=part.format(x=q, y=p))}")


#: The window of P_k and WindowDiff: half the mean gold span, ties to even.
K = "greatest(1, CAST(bround(n / nullif(CAST(size(gold) AS double), 0) / 2, 0) AS int))"


def p_k() -> Column:
    """Share of windows that hold a boundary on one side only; for contiguous spans."""
    return window_rates(F.col("gb"), F.col("pb"), F.col("n"), F.expr(K))["p_k"]


def window_diff() -> Column:
    """Share of windows whose boundary counts differ; for contiguous spans."""
    return window_rates(F.col("gb"), F.col("pb"), F.col("n"), F.expr(K))["window_diff"]


def intrinsic(spans: str = "pred") -> dict[str, str]:
    """Number, mean, population deviation and minimum of the spans' lengths, as a struct's fields of ``moments``."""
    return {
        "seg_count": f"size({spans})",
        "avg_len": "moments.total / moments.n",
        "len_std": "sqrt(greatest(0D, moments.squares / moments.n - power(moments.total / moments.n, 2)))",
        "min_len": f"array_min(transform({spans}, x -> x.e - x.s))",
    }


def with_moments(df: DataFrame, spans: str = "pred") -> DataFrame:
    """Adds ``moments`` (n, total, squares) of the spans' lengths, in one fold."""
    fold = f"aggregate({spans}, named_struct('n', 0D, 'total', 0D, 'squares', 0D), (a, x) -> named_struct('n', a.n + 1, 'total', a.total + (x.e - x.s), 'squares', a.squares + power(x.e - x.s, 2)))"
    return df.withColumn("moments", F.expr(fold))


#: Metrics of a gold and a predicted segmentation, by group; each makes its column.
REGISTRY: dict[str, dict[str, Callable[[], Column]]] = {
    "classical": {"p_k": p_k, "window_diff": window_diff},
    "boundary_accuracy": {
        "precision": precision, "recall": recall, "boundary_f1": lambda: f_score(precision(), recall()),
        "soft_precision": soft_precision, "soft_recall": soft_recall, "soft_f1": soft_f, "displacement": displacement,
    },
    "segment_structure": {"mean_iou": mean_iou, "mean_dice": mean_dice, "bias": bias},
    "agreement": {"b_score": b_score, "density_jsd": density_jsd},
    "optimistic": {"boundary_cover": cover},
}
METRICS = {name: make for group in REGISTRY.values() for name, make in group.items()}


def evaluate(df: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """keys and the named metrics (all by default) of rows with gold, pred and n."""
    out = with_boundaries(df)
    return out.select(*keys, *(METRICS[m]().alias(m) for m in names or METRICS))


def table(df: DataFrame, approach: str, names: list[str] | None = None) -> DataFrame:
    """(approach, means of the named metrics, n): one row for each approach, by falling boundary F1, ties by name."""
    wanted = names or list(METRICS)
    scores = evaluate(df, [approach], wanted)
    finite = {m: F.when(F.abs(m) < float("inf"), F.col(m)) for m in wanted}
    means = scores.groupBy(approach).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(m) for m, c in finite.items()))
    return means.orderBy(F.desc("boundary_f1" if "boundary_f1" in wanted else wanted[0]), approach)


def melted(scores: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, metric, value) in long form."""
    pairs = ", ".join(f"'{m}', CAST({m} AS double)" for m in names)
    return scores.select(*keys, F.expr(f"stack({len(names)}, {pairs}) AS (metric, value)"))


def aggregate_scores(long: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric over texts; infinite values and nulls don't count."""
    finite = long.where("value IS NOT NULL AND abs(value) < double('Infinity')")
    return finite.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def scores_as_json(aggregated: DataFrame, by: str, scale: int | None = None) -> DataFrame:
    """One JSON object {metric: {mean, std}} for each value of ``by``; with a scale, in whole parts of it."""

    def number(c: str) -> Column:
        return F.round(c, 6) if scale is None else F.round(F.round(c, 9) * scale).cast("bigint")

    entry = F.struct(F.col("metric"), F.struct(number("mean").alias("mean"), number("std").alias("std")).alias("v"))
    return aggregated.groupBy(by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("scores"))


def pairwise(df: DataFrame, key: str, name: str, boundaries: str, score: Column, alias: str) -> DataFrame:
    """(key, a, b, alias) for each unordered pair of the named segmentations of a text.

    The segmentations of one text are packed into one row (there are as many as
    engines), pairs are made within it.
    """
    packed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.col(boundaries).alias("b")))).alias("_s"))
    pairs = packed.select(key, F.explode(F.expr("flatten(transform(_s, (x, i) -> transform(slice(_s, i + 2, size(_s)), y -> named_struct('a', x.name, 'b', y.name, 'ab', x.b, 'bb', y.b))))")).alias("_p"))
    return pairs.select(key, F.col("_p.a").alias("a"), F.col("_p.b").alias("b"), F.col("_p.ab").alias("ab"), F.col("_p.bb").alias("bb")).select(key, "a", "b", score.alias(alias))


def agreement_matrix(pairs: DataFrame, value: str) -> DataFrame:
    """(a, b, value) means over texts, both ways round, with ones on the diagonal."""
    mean = pairs.groupBy("a", "b").agg(F.avg(value).alias(value))
    names = mean.select(F.col("a").alias("x")).union(mean.select("b")).distinct()
    return mean.union(mean.select(F.col("b").alias("a"), F.col("a").alias("b"), value)).union(names.select(F.col("x").alias("a"), F.col("x").alias("b"), F.lit(1.0)))


def binary_alpha(items: DataFrame, ones: str = "n1", coders: str = "m") -> DataFrame:
    """Krippendorff's alpha of binary values from the number of ones and of coders of each item; 1 if no disagreement is expected, null without items of two coders."""
    two = items.where(F.col(coders) >= 2)
    parts = two.agg(
        F.sum(2 * F.col(ones) * (F.col(coders) - F.col(ones)) / (F.col(coders) - 1)).alias("dis"),
        F.sum(F.col(ones)).cast("double").alias("t1"),
        F.sum(F.col(coders) - F.col(ones)).cast("double").alias("t0"),
    )
    n = F.col("t1") + F.col("t0")
    return parts.select(F.when(F.col("t1") * F.col("t0") == 0, F.lit(1.0)).otherwise(1 - (F.col("dis") / n) / (2 * F.col("t1") * F.col("t0") / (n * (n - 1)))).alias("alpha"))


#: What engines' names hold, by the letter of their family: rules, probabilities, meaning, language models.
FAMILIES = {
    "H": ["newline", "paragraph", "marker", "every", "sentence", "clause"],
    "L": ["prompted", "reward", "groups", "anchors", "flow", "argument"],
    "P": ["surprisal", "entropy", "flatness", "topk", "forced"],
    "S": ["shift", "entailment", "topic", "zeroshot"],
}


def families(name: str) -> str:
    """Letters of the engine families in an experiment's name: H rules, P probabilities, S meaning, L language models."""
    low = f"lower({name})"
    return "concat(" + ", ".join(f"IF({' OR '.join(f'instr({low}, {w!r}) > 0' for w in words)}, '{letter}', '')" for letter, words in sorted(FAMILIES.items())) + ")"


def aligner(name: str) -> str:
    return "CASE " + " ".join(f"WHEN instr(lower({name}), '{a}') > 0 THEN '{a}'" for a in ("fuzzy", "graph", "union", "intersect", "voting", "flatten")) + " ELSE 'none' END"


def score_time(df: DataFrame, name: str = "exp_id", score: str = "score", seconds: str = "ptime") -> DataFrame:
    """Family, aligner, score and the fourth root of the time of each experiment, as plotted against each other."""
    return df.select(name, F.expr(families(name)).alias("family"), F.expr(aligner(name)).alias("aligner"), score, F.pow(F.col(seconds), F.lit(0.25)).alias("x"))


def by_unit(df: DataFrame, name: str = "exp_id", score: str = "score") -> DataFrame:
    """(engine, sent, clause): scores of each engine on either unit side by side."""
    parts = df.select(F.regexp_extract(name, "^(.*)_(sent|clause)$", 1).alias("engine"), F.regexp_extract(name, "^(.*)_(sent|clause)$", 2).alias("unit"), score)
    return parts.where("engine <> ''").groupBy("engine").pivot("unit", ["sent", "clause"]).agg(F.avg(score))


#: Most experiments of a leaderboard.
EXPERIMENTS = 100_000


def board(scores: DataFrame, texts: int | None = None) -> DataFrame:
    """(exp_id, n, score, ptime) from (exp_id, score, ptime) of every text; with ``texts`` only of experiments that cover so many."""
    means = scores.groupBy("exp_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"), F.avg("ptime").alias("ptime"))
    return means if texts is None else means.where(F.col("n") == texts)


def subset_board(scores: DataFrame, subset: str) -> DataFrame:
    """(exp_id, subset, n, score): the same for each subset of the texts, such as their domain or their one model."""
    return scores.groupBy("exp_id", subset).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"))


def single_engines(*boards: DataFrame) -> DataFrame:
    """(exp_id, score_0, score_1 ...): experiments of one engine, which no aligner names, that all boards hold."""
    out = None
    for i, b in enumerate(boards):
        one = b.where(F.expr(aligner("exp_id")) == "none").select("exp_id", F.col("score").alias(f"score_{i}"))
        out = one if out is None else out.join(one, "exp_id")
    return out


def ranked(df: DataFrame, score: str, tie: str) -> DataFrame:
    """Adds a dense order by falling score, ties by name, to a table of at most ``EXPERIMENTS`` rows, which one task orders."""
    rank = F.row_number().over(Window.orderBy(F.desc(score), tie))
    return df.withColumn("rank", F.when(rank <= EXPERIMENTS, rank).otherwise(F.raise_error(F.lit(f"a leaderboard may hold {EXPERIMENTS} experiments")).cast("int")))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, extremes and size of each group."""
    q = F.percentile(F.col(value), F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    return df.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("low"), q.alias("_q"), F.max(value).alias("high")).select(group, "n", "low", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "high")


def kernel_density(df: DataFrame, group: str, value: str, bandwidth: float = 0.01, points: int = 400, digits: int = 4, least: int = 10) -> DataFrame:
    """(group, x, density): Gaussian kernel density of values in [0, 1] on a grid, its peak 1; groups of fewer than ``least`` values are left out.

    Values are first counted at ``digits`` decimals, so a group is at most that
    many distinct values and the grid multiplies a table of fixed size.
    """
    inside = F.when(F.col(value).between(0, 1), 1).otherwise(0)
    # the condition is on an aggregate, which isn't pushed into the expressions that the value is made of
    counted = df.groupBy(group, F.round(F.col(value), digits).alias("v")).agg(F.sum(inside).alias("c")).where("c > 0")
    enough = counted.groupBy(group).agg(F.sum("c").alias("n")).where(F.col("n") >= least)
    grid = counted.join(enough, group, "left_semi").select(group, "v", "c", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: i / F.lit(float(points)))).alias("x"))
    curve = grid.groupBy(group, "x").agg(F.sum(F.col("c") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / bandwidth, F.lit(2.0)))).alias("d"))
    return curve.select(group, "x", (F.col("d") / F.max("d").over(Window.partitionBy(group))).alias("density"))
