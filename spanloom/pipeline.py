"""Segmentation by named engines and an aligner, with registries for one's own.

An engine is a function of (texts, key), where texts has the key, ``text`` and
its length ``n``, and returns (key, spans).  An aligner adds ``fused`` to rows
with ``all_spans``.  Options belong to one Segmenter and never leak into others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import coherence, engines, fusion, series, units
from spanloom.sources.store import experiment_name

Engine = Callable[..., DataFrame]
#: A provider of token scores: (texts, key) to (key, tokens, surprisal, entropy, gap).
Scores = Callable[[DataFrame, str], DataFrame]
ENGINES: dict[str, Engine] = {}
ALIGNERS: dict[str, Callable[[DataFrame], DataFrame]] = dict(fusion.ALIGNERS)
UNITS = {"sent": units.sentence_units, "clause": units.clause_units}


def register_engine(name: str, engine: Engine) -> None:
    ENGINES[name] = engine


def register_aligner(name: str, align: Callable[[DataFrame], DataFrame]) -> None:
    ALIGNERS[name] = align


def _direct(cut: Callable[..., DataFrame]) -> Engine:
    return lambda texts, key, **options: cut(texts, **options).select(key, "spans")


def _scored(score: str, window: int, quantile: float, flat: bool = False) -> Engine:
    def engine(texts: DataFrame, key: str, window: int = window, quantile: float = quantile, scores: Scores = series.bigram_scores) -> DataFrame:
        return series.spans_at(series.decided(scores(texts, key), key, score, series.at_turns(window, quantile, flat)), texts.select(key, "n"), key)

    return engine


def _topk(texts: DataFrame, key: str, k: int = 20, quantile: float = 0.9) -> DataFrame:
    found = series.threshold_boundaries(series.topk_shift(texts, key, k=k), key, quantile, True)
    return series.spans_from(found, texts.select(key, "n"), key)


def _forced(texts: DataFrame, key: str, scores: Scores = series.bigram_scores, **options: float) -> DataFrame:
    return series.spans_at(series.decided(scores(texts, key), key, "gap", series.at_forced(**options)), texts.select(key, "n"), key)


def _on_units(fold: Callable[..., DataFrame]) -> Engine:
    """An engine on base units; it takes the Segmenter's unit."""

    def engine(texts: DataFrame, key: str, unit: str = "sent", **options: object) -> DataFrame:
        return fold(UNITS[unit](texts), key, **options)

    engine.on_units = True
    return engine


def _labelled(scheme: str) -> Engine:
    return _on_units(lambda df, key, **options: coherence.by_prompted_labels(df, key, scheme, **options))


def _zero_shot(scheme: str) -> Engine:
    def fold(df: DataFrame, key: str, score: Callable = coherence.label_scores) -> DataFrame:
        return coherence.by_labels(df, key, lambda us: coherence.zero_shot_labels(us, coherence.LABEL_SETS[scheme], score))

    return _on_units(fold)


def digit_shares(df: DataFrame) -> DataFrame:
    """Adds ``scores``, the share of digits in each unit; stands in for a reward model."""
    return df.withColumn("scores", F.expr(r"transform(units, x -> CAST(size(regexp_extract_all(substring(text, x.s + 1, x.e - x.s), '[0-9]', 0)) AS double) / (x.e - x.s))"))


def _step_reward(df: DataFrame, key: str, reward: Callable[[DataFrame], DataFrame] = digit_shares) -> DataFrame:
    cuts = series.step_cuts(reward(df), key).withColumnRenamed("cuts", "bs")
    return series.spans_at(cuts, df.select(key, "n"), key)


for _name, _engine in {
    "newline": _direct(lambda t: engines.at_delimiter(t, "\n")),
    "paragraph": _direct(lambda t: engines.at_delimiter(t, "\n\n")),
    "marker": _direct(engines.at_markers),
    "every": _direct(lambda t, size=400: engines.every(t, size)),
    "surprisal": _scored("surprisal", 15, 0.1),
    "entropy": _scored("entropy", 30, 0.1),
    "flatness": _scored("surprisal", 15, 0.1, True),
    "topk": _topk,
    "forced": _forced,
    "shift": _on_units(coherence.by_semantic_shift),
    "entailment": _on_units(coherence.by_entailment),
    "topics": _on_units(lambda df, key, label=coherence.topic_labels: coherence.by_labels(df, key, label)),
    "zeroshot_rf": _zero_shot("reasoning_flow"),
    "zeroshot_ta": _zero_shot("thought_anchor"),
    "reward": _on_units(_step_reward),
    "groups": _on_units(coherence.by_unit_groups),
    "anchors": _labelled("thought_anchor"),
    "flow": _labelled("reasoning_flow"),
    "argument": _labelled("argument"),
    "prompted": lambda texts, key, **options: coherence.by_offset_chunks(texts, key, **options),
}.items():
    register_engine(_name, _engine)


class Segmenter:
    """Runs one or several engines and fuses their spans."""

    def __init__(self, names: list[str], aligner: str | None = None, unit: str = "sent", options: dict[str, dict] | None = None):
        unknown = [n for n in names if n not in ENGINES] + ([aligner] if aligner and aligner not in ALIGNERS and aligner != "graph" else [])
        if unknown:
            raise ValueError(f"unknown: {', '.join(unknown)}")
        if unit not in UNITS:
            raise ValueError(f"unknown unit {unit!r}")
        self.exp_id = experiment_name(names, aligner, unit)
        self.names, self.aligner, self.unit, self.options = list(names), aligner, unit, dict(options or {})

    def _run(self, name: str, texts: DataFrame, key: str) -> DataFrame:
        """(key, spans) of one engine; those on units get the Segmenter's."""
        engine, options = ENGINES[name], self.options.get(name, {})
        if getattr(engine, "on_units", False):
            options = {"unit": self.unit} | options
        return engine(texts, key, **options)

    def segment(self, df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
        """(key, spans) of every row; null texts have null or no spans."""
        texts = df.select(key, F.col(text).alias("text"), F.length(text).alias("n"))
        if len(self.names) == 1:
            return self._run(self.names[0], texts, key).select(key, "spans")
        bare = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        parts = [self._run(n, texts, key).select(key, bare("spans").alias(f"x{i}")) for i, n in enumerate(self.names)]
        none = f"CAST(array() AS {fusion.SPANS})"
        joined = reduce(lambda a, b: a.join(b, key, "full"), parts)
        packed = joined.select(key, F.expr("array(" + ", ".join(f"coalesce(x{i}, {none})" for i in range(len(parts))) + ")").alias("all_spans"))
        fused = fusion.graph(packed, [key]) if self.aligner == "graph" else ALIGNERS[self.aligner](packed)
        return fused.select(key, F.col("fused").alias("spans"))
