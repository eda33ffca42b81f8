"""Consensus from several annotators' labels (problem 6).

Spectral reliability: two annotators agree beyond chance in proportion to the
product of their reliabilities, so the reliabilities are the leading eigenvector
of the chance-centred agreement matrix.  The chance of a pair is taken from both
annotators' own label shares, which leaves nothing to those who always give the
same label.  The matrix is corrected for overlap counts: its entries are divided
by the roots of both annotators' numbers of co-labelled units.  It is never
built: its product with a vector is a join of the votes with the annotators, an
aggregation by unit, a join back with the votes and an aggregation by annotator,
all linear in the votes.  Power iteration repeats it until the vector changes by
less than ``TOLERANCE``.  The reliabilities weigh the votes, and the label of
most weight is the unit's.  Optionally (``settle="confusions"``) one pass over
each annotator's confusions, counted against the weighted votes, settles labels.

Defined results for odd inputs: null labels, units and annotators don't count;
unknown labels count as null; of several labels by one annotator for a unit the
one saved last counts (ties: the one made last, then the smaller label); repeated
rows count once; a unit without any label has no row; with a single annotator
per unit all reliabilities are 0 and the vote decides alone; of labels of equal
weight the first in order of ``LABELS`` counts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.partitions import shared_dir

#: The labels in their spelling.
LABELS = [
    "Problem Setup",
    "Plan Generation",
    "Fact Retrieval",
    "Active Computation",
    "Uncertainty Management",
    "Result Consolidation",
    "Self Checking",
    "Final Answer Emission",
]
K = len(LABELS)
#: Most power iterations, and the change of the vector (whose greatest entry is 1) at which they stop.
ITERATIONS, TOLERANCE = 60, 1e-6
#: Most and least reliability that a vote is weighed with.
MOST, LEAST = 0.97, 0.01
#: Annotators up to which their table (a few numbers for each) is sent to all workers.
BROADCAST_ANNOTATORS = 20_000
#: Votes in one partition of the table that the iterations read.
PARTITION_VOTES = 500_000
#: Characters of a bucket in the join of spans and units.
BUCKET = 512
#: Count that every cell of a confusion table starts with.
SMOOTH = 0.2


def label_number(label: Column) -> Column:
    """Number of a label in any spelling, null if it is none of LABELS."""
    key = F.regexp_replace(F.lower(label), "[^a-z]", "")
    return reduce(lambda c, i: c.when(key == "".join(x for x in LABELS[i].lower() if x.isalpha()), i), range(K), F.when(F.lit(False), F.lit(0))).cast("int")


def span_votes(units: DataFrame, spans: DataFrame, annotator: int) -> DataFrame:
    """(unit_id, annotator, label) of a table of labelled spans (id, split, labels).

    A unit gets the label of the span that covers most of it, if that is more
    than half.  Units and spans meet in buckets of text positions, so a trace
    of many units and spans makes no quadratic join.
    """
    flat = (
        spans.where("id IS NOT NULL AND split IS NOT NULL AND labels IS NOT NULL")
        .select(F.col("id").alias("rtrace_id"), F.explode(F.arrays_zip("split", "labels")).alias("z"))
        .select("rtrace_id", F.col("z.split")[0].alias("s"), F.col("z.split")[1].alias("e"), F.explode("z.labels").alias("label"))
        .select("rtrace_id", F.least("s", "e").alias("s"), F.greatest("s", "e").alias("e"), label_number(F.col("label")).alias("label"))
        .where("s IS NOT NULL AND e IS NOT NULL AND label IS NOT NULL")
        .distinct()
    )

    def bucketed(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(s) / BUCKET), F.floor(F.greatest(F.col(e) - 1, F.col(s)) / BUCKET))))

    both = bucketed(units.where("unit_end > unit_start"), "unit_start", "unit_end").join(bucketed(flat, "s", "e"), ["rtrace_id", "bucket"])
    overlap = F.least("unit_end", "e") - F.greatest("unit_start", "s")
    return (
        both.where((overlap * 2) > (F.col("unit_end") - F.col("unit_start")))
        .groupBy("unit_id")
        .agg(F.max(F.struct(overlap.alias("o"), (-F.col("label")).alias("l"))).alias("best"))
        .select("unit_id", F.lit(annotator).cast("int").alias("annotator"), (-F.col("best.l")).alias("label"))
    )


def all_votes(votes: DataFrame, galleries: dict[int, DataFrame]) -> DataFrame:
    """(unit_id, annotator, label): the counting label of every annotator for every unit."""
    rows = votes.where("unit_id IS NOT NULL").select("unit_id", "rtrace_id", "unit_start", "unit_end", F.col("completed_by").alias("annotator"), label_number(F.col("label")).alias("label"), "labelled_at", "saved_at")
    units = rows.groupBy("unit_id").agg(F.max(F.struct("rtrace_id", "unit_start", "unit_end")).alias("u")).select("unit_id", "u.*").where("rtrace_id IS NOT NULL AND unit_start IS NOT NULL AND unit_end IS NOT NULL")
    stamped = rows.where("annotator IS NOT NULL AND label IS NOT NULL").select("unit_id", "annotator", "label", "saved_at", "labelled_at")
    for annotator, spans in galleries.items():
        # spans carry no time: a label that was saved comes before them
        stamped = stamped.unionByName(span_votes(units, spans, annotator).withColumns({"saved_at": F.lit(None).cast("timestamp"), "labelled_at": F.lit(None).cast("timestamp")}))
    last = stamped.groupBy("unit_id", "annotator").agg(F.max(F.struct("saved_at", "labelled_at", (-F.col("label")).alias("l"))).alias("v"))
    return last.select("unit_id", "annotator", (-F.col("v.l")).cast("int").alias("label"))


def _with_annotators(votes: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """votes with the columns of a table of annotators; beyond BROADCAST_ANNOTATORS by a salted join, since one annotator may hold much of the votes."""
    if small:
        return votes.join(F.broadcast(table), "annotator")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return votes.withColumn("_salt", F.pmod(F.hash("unit_id"), F.lit(16))).join(salted, ["annotator", "_salt"]).drop("_salt")


def _settled(table: DataFrame, small: bool) -> DataFrame:
    """A table of annotators, computed: kept by the driver if it is small, else checkpointed."""
    if small:
        return table.sparkSession.createDataFrame(table.toArrow())
    shared_dir(table.sparkSession)
    return table.checkpoint()


def _own(prefix: str) -> str:
    """The value of a row's own label."""
    return "CASE label " + " ".join(f"WHEN {k} THEN {prefix}{k}" for k in range(K)) + " END"


def _plus(parts: list[str]) -> str:
    return " + ".join(parts)


def _layout(base: DataFrame, n: int) -> DataFrame:
    """Votes laid out by unit once for all iterations, so that sums over a unit need no shuffle."""
    parts = max(base.sparkSession.sparkContext.defaultParallelism, -(-n // PARTITION_VOTES))
    return base.repartition(parts, "unit_id").sortWithinPartitions("unit_id").persist()


def _product(laid: DataFrame, x: DataFrame, small: bool) -> DataFrame:
    """What the chance-centred agreement times x needs of the votes: for each annotator

    ``hits`` (sum of x over equal labels of others and the own one), ``r0``.. (sums of all annotators' x times
    label share over the annotator's units), ``d`` (votes of others in these units) and ``q`` (sums of squares of x).
    """
    rows = _with_annotators(laid, x, small)
    units = rows.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("m"), F.expr("sum(x * x) AS q"), *(F.expr(f"sum(CASE WHEN label = {k} THEN x ELSE 0D END) AS s{k}") for k in range(K)), *(F.expr(f"sum(x * p{k}) AS t{k}") for k in range(K))
    )
    return laid.join(units, "unit_id").groupBy("annotator").agg(F.expr(f"sum({_own('s')}) AS hits"), F.expr("CAST(sum(m - 1) AS DOUBLE) AS d"), F.sum("q").alias("q"), *(F.sum(f"t{k}").alias(f"r{k}") for k in range(K)))


def _change(both: DataFrame, small: bool) -> tuple[float, float]:
    """Greatest entry of z, and the most that any entry of z, scaled to it, differs from x."""
    if small:
        pairs = both.select("x", "z").collect()  # at most BROADCAST_ANNOTATORS rows, which the driver holds already
        top = max((abs(r["z"]) for r in pairs), default=0.0)
        return top, max((abs(r["z"] / top - r["x"]) for r in pairs), default=0.0) if top else 0.0
    top = both.selectExpr("max(abs(z)) AS top").first()["top"] or 0.0
    return top, both.selectExpr(f"max(abs(z / {top!r}D - x)) AS change").first()["change"] if top else 0.0


def _reliabilities(laid: DataFrame, profile: DataFrame, small: bool, iterations: int) -> DataFrame:
    """(annotator, reliability, n_votes) from power iteration."""
    shares = [f"p{k}" for k in range(K)]
    x = profile.selectExpr("annotator", "n", *shares, "1D AS x")
    squares = _plus([f"p{k} * p{k}" for k in range(K)])
    for _ in range(max(1, iterations)):
        sums = _product(laid, x, small).join(x, "annotator")
        # less the annotator's own share of every sum; then x is y / d, since v = root(d) x and the next v is y / root(d)
        y = f"hits - n * x - ({_plus([f'p{k} * r{k}' for k in range(K)])}) + n * x * ({squares})"
        both = _settled(sums.selectExpr("annotator", "n", *shares, "x", "d", "q", f"{y} AS y").selectExpr("*", "CASE WHEN d > 0 THEN y / d ELSE 0D END AS z"), small)
        top, change = _change(both, small)
        if not top:
            x = both.withColumn("x", F.lit(0.0))
            break
        done, x = both, both.selectExpr("annotator", "n", *shares, f"z / {top!r}D AS x")
        if change < TOLERANCE:
            break
    if not top:
        return x.selectExpr("annotator", "0D AS reliability", "n AS n_votes")
    # scale: the least-squares fit of the products of reliabilities to the centred agreements, of what is left of agreement beyond chance
    fit = done.agg(F.expr("sum(x * y) AS top"), F.expr("sum(x * x * (q - n * x * x)) AS bottom"), F.expr("sum(x * n) AS sign"), *(F.expr(f"sum(n * p{k}) / sum(n) AS p{k}") for k in range(K))).first()
    beyond = 1 - sum((fit[f"p{k}"] or 0.0) ** 2 for k in range(K))
    usable = fit["top"] > 0 and fit["bottom"] > 0 and beyond > 0
    factor = math.copysign(math.sqrt(fit["top"] / fit["bottom"] / beyond), fit["sign"]) if usable else 0.0
    return _settled(done.selectExpr("annotator", f"x * {factor!r}D AS reliability", "n AS n_votes"), small)


def _best(prefix: str, rows: DataFrame) -> DataFrame:
    """(unit_id, label, agreement, n_votes) of rows with a score of each label (prefix), its weight (w) and all weight."""
    best = "greatest(" + ", ".join(f"struct({prefix}{k} AS score, {-k} AS l, w{k} AS w)" for k in range(K)) + ")"
    names = "array(" + ", ".join(f"'{x}'" for x in LABELS) + ")"
    return rows.selectExpr("unit_id", f"{best} AS best", "all_w", "n_votes").selectExpr("unit_id", f"element_at({names}, 1 - best.l) AS label", "CASE WHEN all_w > 0 THEN best.w / all_w ELSE 0D END AS agreement", "n_votes")


def consensus(votes: DataFrame, galleries: dict[int, DataFrame], iterations: int = ITERATIONS, settle: str = "votes") -> tuple[DataFrame, DataFrame]:
    """Units (unit_id, label, agreement, n_votes) and annotators (annotator, reliability, n_votes).

    ``agreement`` is the winning label's share of the unit's vote weight.  The
    label is the one of most weight, or with ``settle="confusions"`` the one that
    is likeliest by the annotators' confusion tables.
    """
    if settle not in ("votes", "confusions"):
        raise ValueError(f"unknown way to settle labels {settle!r}")
    base = all_votes(votes, galleries).persist()
    profile = base.groupBy("annotator").agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"count_if(label = {k}) AS n{k}") for k in range(K))).persist()
    size = profile.agg(F.count(F.lit(1)).alias("annotators"), F.sum("n").alias("votes")).first()
    small = size["annotators"] <= BROADCAST_ANNOTATORS
    profile = _settled(profile.selectExpr("annotator", "n", *(f"n{k} / n AS p{k}" for k in range(K))), small)
    laid = _layout(base, size["votes"] or 0)
    reliability = _reliabilities(laid, profile, small, iterations)
    base.unpersist()

    # weights: log odds of the chance that the vote is right
    weighed = reliability.selectExpr("annotator", f"least(greatest(reliability, {LEAST}D), {MOST}D) AS r").selectExpr("annotator", f"r + (1 - r) / {K} AS right").selectExpr("annotator", f"ln(right * {K - 1} / (1 - right)) AS w")
    narrow = _with_annotators(laid, weighed, small)
    sums = narrow.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_votes"), F.sum("w").alias("all_w"), *(F.expr(f"sum(CASE WHEN label = {k} THEN w ELSE 0D END) AS w{k}") for k in range(K)))
    if settle == "votes":
        return _best("w", sums), reliability
    return _best("l", _likely(laid, sums, small)), reliability


def _likely(laid: DataFrame, sums: DataFrame, small: bool) -> DataFrame:
    """sums with l0.., the log likelihood of each label by the annotators' confusions against the weighted votes."""
    peak = "greatest(" + ", ".join(f"w{k}" for k in range(K)) + ")"
    soft = sums.selectExpr("unit_id", *(f"exp(w{k} - {peak}) AS e{k}" for k in range(K)))
    soft = soft.selectExpr("unit_id", *(f"e{k} / ({_plus([f'e{j}' for j in range(K)])}) AS q{k}" for k in range(K)))
    prior = soft.agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"q{k}").alias(f"q{k}") for k in range(K))).first()
    before = [math.log(((prior[f"q{k}"] or 0.0) + SMOOTH) / (prior["n"] + SMOOTH * K)) for k in range(K)]
    cells = laid.join(soft, "unit_id").groupBy("annotator", "label").agg(*(F.sum(f"q{k}").alias(f"c{k}") for k in range(K)))
    of_all = Window.partitionBy("annotator")  # K rows each
    likely = cells.select("annotator", "label", *(F.log((F.col(f"c{k}") + SMOOTH) / (F.sum(f"c{k}").over(of_all) + SMOOTH * K)).alias(f"l{k}") for k in range(K)))
    if small:
        scored = laid.join(F.broadcast(likely), ["annotator", "label"])  # K rows for each annotator
    else:
        salted = likely.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        scored = laid.withColumn("_salt", F.pmod(F.hash("unit_id"), F.lit(16))).join(salted, ["annotator", "label", "_salt"])
    chances = scored.groupBy("unit_id").agg(*(F.expr(f"sum(l{k}) + ({before[k]!r}D) AS l{k}") for k in range(K)))
    return sums.join(chances, "unit_id")
