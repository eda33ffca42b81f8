"""Score-series engines: token scores of a bigram model and decisions on them.

The token scores of a language model come from a provider, a function of (texts,
key) that gives (key, tokens, surprisal, entropy, gap) with one array entry for
each token.  The built-in one is an add-one smoothed bigram model counted on the
corpus itself (it stands in for a neural model and does not reproduce one's
scores).  Counting is its only shuffle, with partial counts first; the model is
then looked up where the texts lie, if it is measured to be small, else joined.
The decision operators work on such arrays or on any token table (key, tok_idx,
token, char_s, score): window means before and after each hard end mark, z-scored
per text, with a percentile as threshold.

Windows run over the tokens of one text, whose number is bounded by its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.arrays import tiled_spans
from spanloom.partitions import joined, spread

#: Tokens that tile a text: a word with the space before it, or a single other character.
TOKEN_PATTERN = r" ?[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"
HARD_MARKS = [".", "!", "?", "\n"]
SOFT_MARKS = [",", "\t"]
_HARD, _SOFT = frozenset(HARD_MARKS), frozenset(SOFT_MARKS)
EPSILON = 1e-6
#: Scores of a token.
SCORES = ["surprisal", "entropy", "gap"]
#: Pairs of tokens up to which the model is sent to all workers (32 bytes each).
MODEL_ROWS = 1_000_000


def tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, tok_idx, token): tokens that tile the text."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))).alias("tok_idx", "token"))


def bigrams(tokens_: DataFrame, key: str) -> DataFrame:
    """Tokens with ``prev``, the token before ('' for the first), and the character they start at."""
    w = Window.partitionBy(key).orderBy("tok_idx")
    return tokens_.select(key, "tok_idx", "token", F.lag("token", 1, "").over(w).alias("prev"), (F.sum(F.length("token")).over(w) - F.length("token")).cast("int").alias("char_s"))


def bigram_counts(pairs: DataFrame) -> DataFrame:
    """(prev, token, n) over all texts."""
    return pairs.groupBy("prev", "token").agg(F.count(F.lit(1)).alias("n"))


def context_table(counts: DataFrame) -> DataFrame:
    """(prev, total, kinds, entropy, sep_n) of each context: how often it occurs, with how many tokens, the entropy of the smoothed next token, and the most frequent hard mark behind it; ``v`` is the vocabulary's size."""
    v = counts.agg(F.count_distinct("token").alias("v"))
    per = counts.groupBy("prev").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.max(F.when(F.col("token").isin(HARD_MARKS), F.col("n")).otherwise(0)).alias("sep_n"))
    size = F.lit(int(v.first()["v"] or 0))  # one number
    seen = joined(counts, per, ["prev"], F.col("token")).select("prev", "total", "kinds", "sep_n", ((F.col("n") + 1) / (F.col("total") + size)).alias("p"))
    # -sum p ln p over seen tokens, and the same for all unseen ones, which are equal
    ent = seen.groupBy("prev", "total", "kinds", "sep_n").agg((-F.sum(F.col("p") * F.log("p"))).alias("h"))
    p0 = 1.0 / (F.col("total") + size)
    return ent.select("prev", "total", "kinds", "sep_n", size.alias("v"), (F.col("h") - (size - F.col("kinds")) * p0 * F.log(p0)).alias("entropy"))


def bigram_model(counts: DataFrame) -> DataFrame:
    """(prev, token, surprisal, entropy, gap); gap is how much likelier the likeliest hard mark is than the token."""
    both = joined(counts, context_table(counts), ["prev"], F.col("token"))
    return both.select("prev", "token", F.log((F.col("total") + F.col("v")) / (F.col("n") + 1)).alias("surprisal"), "entropy", F.log((F.col("sep_n") + 1) / (F.col("n") + 1)).alias("gap"))


_PAIRS = "transform(tokens, (x, i) -> named_struct('prev', IF(i = 0, '', get(tokens, i - 1)), 'token', x))"


def bigram_scores(df: DataFrame, key: str, text: str = "text", wanted: list[str] | None = None, rows: int = MODEL_ROWS) -> DataFrame:
    """(key, tokens, the wanted SCORES): arrays of the tokens of each text and their scores by the bigram model of all texts."""
    wanted = wanted or SCORES
    own = df.where(F.col(text).isNotNull()).select(key, F.regexp_extract_all(F.col(text), F.lit(f"({TOKEN_PATTERN})"), F.lit(1)).alias("tokens"))
    counts = bigram_counts(own.select(F.inline(F.expr(_PAIRS)))).persist()
    model = bigram_model(counts).select("prev", "token", *wanted)
    if counts.count() <= rows:
        table = model.select(F.xxhash64("prev", "token").alias("h"), *wanted).toArrow()
        h = table["h"].to_numpy()
        order = np.argsort(h)
        if not len(h) or (np.diff(h[order]) > 0).all():  # else two pairs have one hash
            counts.unpersist()
            return _looked_up(own, key, wanted, h[order], [table[c].to_numpy()[order] for c in wanted])
    flat = own.select(key, F.posexplode(F.expr(_PAIRS)).alias("tok_idx", "p")).select(key, "tok_idx", "p.prev", "p.token")
    scored = joined(flat, model, ["prev", "token"], F.xxhash64(key, "tok_idx"), F.lit(96))
    return scored.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tok_idx", "token", *wanted))).alias("t")).select(key, F.col("t.token").alias("tokens"), *(F.col(f"t.{c}").alias(c) for c in wanted))


def _looked_up(own: DataFrame, key: str, wanted: list[str], h: np.ndarray, scores: list[np.ndarray]) -> DataFrame:
    hashed = spread(own.withColumn("_h", F.expr("transform(tokens, (x, i) -> xxhash64(IF(i = 0, '', get(tokens, i - 1)), x))")))
    kind = dict(own.dtypes)[key]
    model = own.sparkSession.sparkContext.broadcast((h, scores))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = model.value
        for b in batches:
            lists = b.column(2)
            at = np.searchsorted(known, lists.flatten().to_numpy())
            offsets = pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.ListArray.from_arrays(offsets, pa.array(v[at])) for v in values)], names=[key, "tokens", *wanted])

    return hashed.mapInArrow(look_up, f"`{key}` {kind}, tokens array<string>, " + ", ".join(f"{c} array<double>" for c in wanted))


Decide = Callable[[list[str], np.ndarray], np.ndarray]


def _z(values: np.ndarray) -> np.ndarray:
    return (values - values.mean()) / (values.std() + EPSILON)


def at_turns(window: int, quantile: float, flat: bool = False) -> Decide:
    """Decision on a text: tokens behind hard marks, with full windows on both sides, whose turn of the mean score has a z-score below the quantile."""

    def decide(tokens_: list[str], scores: np.ndarray) -> np.ndarray:
        n = len(tokens_)
        at = np.array([i for i in range(window, n - window) if tokens_[i - 1] in _HARD], dtype=np.int64)
        if not len(at):
            return at
        views = np.lib.stride_tricks.sliding_window_view(scores, window)
        before = views[at - window]
        delta = views[at].mean(axis=1) - before.mean(axis=1)
        if flat:
            delta = delta / np.sqrt(before.var(axis=1) + EPSILON)
        z = np.round(_z(delta), 9)
        return at[z < np.round(np.quantile(z, quantile), 9)]

    return decide


def at_forced(alpha: float = 1.0, beta: float = 2.0, quantile: float = 0.9, soft_bias: float = 0.5) -> Decide:
    """Decision on a text as of forced_boundaries."""

    def decide(tokens_: list[str], scores: np.ndarray) -> np.ndarray:
        if not len(tokens_):
            return np.zeros(0, dtype=np.int64)
        bias = np.array([0.0, *(1.0 if t in _HARD else soft_bias if t in _SOFT else 0.0 for t in tokens_[:-1])])
        z = np.round(alpha * _z(scores) + beta * bias, 9)
        over = (z > np.round(np.quantile(z, quantile), 9)) & np.array([t not in _HARD for t in tokens_])
        over[0] = False
        return np.flatnonzero(over & ~np.concatenate([[False], over[:-1]]))

    return decide


def decided(scored: DataFrame, key: str, score: str, decide: Decide) -> DataFrame:
    """(key, bs): characters at which the tokens start that a decision picks, for each text of a provider."""
    narrow = scored.select(key, "tokens", score)
    kind = dict(narrow.dtypes)[key]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, v in zip(b.column(1).to_pylist(), b.column(2)):
                t = t or []
                picked = decide(t, v.values.to_numpy() if v.is_valid else np.zeros(0))
                out.append(np.concatenate([[0], np.cumsum([len(x) for x in t])])[picked].astype(np.int32) if len(picked) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=[key, "bs"])

    return narrow.mapInArrow(walk, f"`{key}` {kind}, bs array<int>")


def spans_at(decided_: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """(key, spans): contiguous spans cut at the boundaries ``bs``, empty ones dropped, of every text of ``lengths`` (key, n)."""
    points = "array_distinct(concat(array(0), filter(array_sort(coalesce(bs, CAST(array() AS array<int>))), b -> b > 0 AND b < n), array(n)))"
    cut = lengths.where("n > 0").join(decided_, key, "left").withColumn("_b", F.expr(points))
    return cut.select(key, F.expr("transform(slice(_b, 1, size(_b) - 1), (b, i) -> named_struct('s', b, 'e', get(_b, i + 1)))").alias("spans"))


def candidates(scored: DataFrame, key: str, score: str, window: int, flat: bool = False) -> DataFrame:
    """(key, tok_idx, char_s, delta) behind hard marks with full windows on both sides.

    delta is the mean of the next ``window`` scores, the token's own included,
    less the mean of those before, divided by their deviation if ``flat``.
    """
    w = Window.partitionBy(key).orderBy("tok_idx")
    rows = scored.select(
        key, "tok_idx", "char_s", F.lag("token").over(w).alias("before"),
        F.avg(score).over(w.rowsBetween(-window, -1)).alias("m0"), F.avg(score).over(w.rowsBetween(0, window - 1)).alias("m1"), F.var_pop(score).over(w.rowsBetween(-window, -1)).alias("v0"),
        F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"),
    )
    kept = rows.where((F.col("tok_idx") >= window) & (F.col("tok_idx") < F.col("n") - window) & F.col("before").isin(HARD_MARKS))
    delta = F.col("m1") - F.col("m0")
    return kept.select(key, "tok_idx", "char_s", (delta / F.sqrt(F.col("v0") + EPSILON) if flat else delta).alias("delta"))


def threshold_boundaries(found: DataFrame, key: str, quantile: float, high: bool = False) -> DataFrame:
    """(key, b, z): candidates whose z-score lies below the quantile of their text's (above it if ``high``)."""
    per = found.groupBy(key).agg(F.avg("delta").alias("m"), F.stddev_pop("delta").alias("s"))
    z = found.join(per, key).select(key, F.col("char_s").alias("b"), F.round((F.col("delta") - F.col("m")) / (F.col("s") + EPSILON), 9).alias("z"))
    cut = z.groupBy(key).agg(F.round(F.percentile("z", F.lit(quantile)), 9).alias("cut"))
    beyond = F.col("z") > F.col("cut") if high else F.col("z") < F.col("cut")
    return z.join(cut, key).where(beyond).select(key, "b", "z")


def forced_boundaries(scored: DataFrame, key: str, alpha: float = 1.0, beta: float = 2.0, quantile: float = 0.9, soft_bias: float = 0.5) -> DataFrame:
    """(key, b, z): tokens whose weighed gap and bias lie above the quantile of their text, are no hard mark and don't follow one that was put in just before.

    The batch form of decoding with forced separators: the separator is put
    before such a token unless the token before it is one too.
    """
    w = Window.partitionBy(key).orderBy("tok_idx")
    per = scored.groupBy(key).agg(F.avg("gap").alias("m"), F.stddev_pop("gap").alias("s"))
    biased = F.when(F.col("before").isin(HARD_MARKS), 1.0).when(F.col("before").isin(SOFT_MARKS), soft_bias).otherwise(0.0)
    rows = scored.withColumn("before", F.lag("token").over(w)).join(per, key)
    rows = rows.select(key, "tok_idx", "token", "char_s", F.round(alpha * (F.col("gap") - F.col("m")) / (F.col("s") + EPSILON) + beta * biased, 9).alias("z"))
    cut = rows.groupBy(key).agg(F.round(F.percentile("z", F.lit(quantile)), 9).alias("cut"))
    flagged = rows.join(cut, key).withColumn("over", (F.col("z") > F.col("cut")) & ~F.col("token").isin(HARD_MARKS) & (F.col("tok_idx") > 0))
    return flagged.withColumn("again", F.coalesce(F.lag("over").over(w), F.lit(False))).where("over AND NOT again").select(key, F.col("char_s").alias("b"), "z")


def top_tokens(counts: DataFrame, k: int = 20) -> DataFrame:
    """(prev, top): the k likeliest next tokens of each context with their share among them, as a map; ties by token.

    Contexts hold at most the vocabulary; the k best are kept in a bounded heap
    per task by ranking within (prev, part of the tokens) first, so that a
    frequent context is never ranked in one place.
    """
    part = F.pmod(F.hash("token"), F.lit(16))
    first = Window.partitionBy("prev", part).orderBy(F.desc("n"), "token")
    small = counts.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r")
    best = small.withColumn("r", F.row_number().over(Window.partitionBy("prev").orderBy(F.desc("n"), "token"))).where(F.col("r") <= k)
    return best.groupBy("prev").agg(F.collect_list(F.struct("token", F.col("n").cast("double").alias("n"))).alias("t"), F.sum("n").alias("s")).select("prev", F.map_from_entries(F.expr("transform(t, x -> struct(x.token, x.n / s))")).alias("top"))


def js_distance(a: str, b: str) -> str:
    """Jensen-Shannon distance of two maps of shares (natural logarithm)."""
    zipped = f"map_values(map_zip_with({a}, {b}, (k, p, q) -> named_struct('p', coalesce(p, 0D), 'q', coalesce(q, 0D))))"
    kl = "IF(x.p > 0, x.p * ln(x.p / ((x.p + x.q) / 2)), 0D) + IF(x.q > 0, x.q * ln(x.q / ((x.p + x.q) / 2)), 0D)"
    return f"sqrt(greatest(0D, 0.5D * aggregate(transform({zipped}, x -> {kl}), 0D, (t, v) -> t + v)))"


def topk_shift(df: DataFrame, key: str, text: str = "text", k: int = 20) -> DataFrame:
    """(key, tok_idx, char_s, delta): distance between the next-token shares before and behind each hard mark.

    Only the tokens behind hard marks become rows; they meet the distances of the
    distinct pairs of contexts, of which there are few.
    """
    own = df.where(F.col(text).isNotNull()).select(key, F.regexp_extract_all(F.col(text), F.lit(f"({TOKEN_PATTERN})"), F.lit(1)).alias("tokens"))
    top = top_tokens(bigram_counts(own.select(F.inline(F.expr(_PAIRS)))), k)
    marks = ", ".join("'" + m.replace("\n", "\\n") + "'" for m in HARD_MARKS)
    at = f"filter(transform(tokens, (x, i) -> named_struct('tok_idx', i, 'char_s', get(_t, i).s, 'prev', get(tokens, i - 1), 'prev2', IF(i = 1, '', get(tokens, i - 2)))), y -> y.prev IN ({marks}))"
    tiled = own.withColumn("_t", tiled_spans(F.transform("tokens", F.length)))
    spots = tiled.select(key, F.explode_outer(F.expr(at)).alias("y")).where("y IS NOT NULL").select(key, "y.*")
    contexts = spots.select("prev", "prev2").distinct().join(top, "prev").join(top.select(F.col("prev").alias("prev2"), F.col("top").alias("top2")), "prev2")
    deltas = contexts.select("prev", "prev2", F.expr(js_distance("top2", "top")).alias("delta"))
    return joined(spots, deltas, ["prev", "prev2"], F.xxhash64(key, "tok_idx")).select(key, "tok_idx", "char_s", "delta")


def spans_from(boundaries: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """spans_at for boundaries in rows of (key, b)."""
    return spans_at(boundaries.groupBy(key).agg(F.array_sort(F.collect_set("b")).alias("bs")), lengths, key)


def step_turns(scores: np.ndarray, ends: np.ndarray, span: int = 4, quantile: float = 0.6, least: int = 4) -> list[int]:
    """Ends of the units behind which step scores turn.

    Each unit's delta is the mean of its and the next scores less the mean of
    those before (its own if there are none); a unit is a cut if the z-score of
    the size of its delta exceeds the text's quantile, which is halved at the
    start and full from the fifth unit on, and more than ``least`` characters
    lie behind the end of the unit that follows the cut before.
    """
    n = len(scores)
    if n < 2:
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    i = np.arange(n)
    ahead, back = np.minimum(i + span, n), np.maximum(i - span, 0)
    after = (total[ahead] - total[i]) / (ahead - i)
    before = np.where(i > 0, (total[i] - total[back]) / np.maximum(i - back, 1), scores)
    size = np.abs(after - before)
    z = np.round(_z(size), 9)
    bar = np.round(np.quantile(z, quantile), 9)
    out, current = [], 0
    for k in np.flatnonzero(z[:-1] > bar * (0.5 + 0.5 * np.minimum(i[:-1] / 5, 1))).tolist():
        if ends[k] - current > least:
            out.append(int(ends[k]))
            current = int(ends[k + 1])
    return out


def step_cuts(df: DataFrame, key: str, units: str = "units", scores: str = "scores") -> DataFrame:
    """(key, cuts) by step_turns, in Arrow batches: a cut depends on the one before."""
    narrow = df.select(key, F.transform(units, lambda u: u["e"]).alias("ends"), F.col(scores).cast("array<double>").alias("scores"))
    kind = dict(narrow.dtypes)[key]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = [step_turns(np.array(s or [], dtype=float), np.array(e or [], dtype=int)) for e, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cuts, pa.list_(pa.int32()))], names=[key, "cuts"])

    return spread(narrow).mapInArrow(walk, f"`{key}` {kind}, cuts array<int>")
