"""Segmentation engines on rules: delimiters, markers, lengths; and runs of labels.

An engine takes texts and adds ``spans``; rule engines label every span UNK.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import arrays
from spanloom.operators.units import SENTENCE_PATTERN

# --------------------------------------------------------------------------
# The stock markers of each family.
# --------------------------------------------------------------------------
MARKERS = {
    "inference": ["therefore", "thus", "hence", "so", "follows that", "implies", "we conclude"],
    "contrast": ["but", "however", "though", "instead", "actually", "nevertheless", "on the other hand"],
    "revision": ["this is wrong", "that was wrong", "i was mistaken", "let me reconsider", "wait"],
    "goal": ["now we", "let us", "next", "consider", "we need to", "the goal"],
    "final": ["the answer is", "therefore the answer", "in conclusion", "final answer"],
}
UNLABELLED = "UNK"

Engine = Callable[[DataFrame], DataFrame]


def at_delimiter(df: DataFrame, delimiter: str, text: str = "text") -> DataFrame:
    """Adds ``spans`` cut behind each delimiter.

    A delimiter at the very start opens no span of its own, one at the end
    leaves an empty span behind it; an empty text is one empty span.
    """
    pieces = F.split(F.col(text), delimiter, -1)
    tiles = arrays.tiled_spans(F.transform("_p", lambda x: F.length(x) + len(delimiter)))
    kept = "CASE WHEN size(_t) > 1 AND _p[0] = '' THEN slice(_t, 2, size(_t) - 1) ELSE _t END"
    spans = f"transform(_k, (x, i) -> named_struct('s', x.s, 'e', CAST(coalesce(get(_k, i + 1).s, length({text})) AS int)))"
    return df.withColumn("_p", pieces).withColumn("_t", tiles).withColumn("_k", F.expr(kept)).select(*df.columns, F.expr(spans).alias("spans"))


def marker_pattern(markers: list[str]) -> str:
    """A pattern for any of the markers as whole words, alike for Java's and RE2's expressions."""
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(markers) + r")($|[^\p{L}\p{N}_])"


def all_markers() -> list[str]:
    return [m for family in MARKERS.values() for m in family]


def at_markers(df: DataFrame, markers: list[str] | None = None, text: str = "text", pattern: str = SENTENCE_PATTERN) -> DataFrame:
    """Adds ``spans``: base units in which a marker stands open a new span; the last ends with the text.  A text without units has none."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1))
    rule = F.lit(marker_pattern(markers or all_markers()))
    facts = F.transform(found, lambda x: F.struct(F.length(x).alias("n"), F.rlike(F.lower(x), rule).alias("opens")))
    spans = arrays.grouped_spans(F.transform("_f", lambda x: x["n"]), F.transform("_f", lambda x: x["opens"]))
    return df.withColumn("_f", facts).select(*df.columns, spans.alias("spans"))


def family_flags(unit: str = "unit") -> list:
    """A boolean column for each marker family."""
    return [F.rlike(F.lower(F.col(unit)), F.lit(marker_pattern(m))).alias(family) for family, m in MARKERS.items()]


def every(df: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Adds ``spans`` of ``size`` characters, the last one shorter."""
    spans = f"CASE WHEN length({text}) = 0 THEN CAST(array() AS array<struct<s:int,e:int>>) ELSE transform(sequence(0, length({text}) - 1, {size}), s -> named_struct('s', s, 'e', least(s + {size}, length({text})))) END"
    return df.withColumn("spans", F.expr(spans))


def clean(df: DataFrame, spans: str = "spans", length: str = "n") -> DataFrame:
    """Replaces spans by their repaired form: contiguous to the end of the text."""
    return df.withColumn(spans, arrays.retiled_spans(F.col(spans), F.col(length)))


# -- runs of equal labels -----------------------------------------------------
def label_runs(df: DataFrame, units: str = "units") -> DataFrame:
    """Adds ``spans`` (s, e, label): from the first unit's start to the last unit's end of each run of equal labels."""
    return df.withColumn("spans", arrays.label_runs(F.col(units)))


def absorbed_runs(df: DataFrame, units: str = "units", length: str = "n") -> DataFrame:
    """Adds ``spans`` (s, e, label): runs as of label_runs, but the last one is absorbed by the one before, the first starts at 0 and each ends where the next starts; a single run is the whole text."""
    runs = label_runs(df, units).withColumn("_r", F.expr("CASE WHEN size(spans) > 1 THEN slice(spans, 1, size(spans) - 1) ELSE spans END"))
    tiled = f"transform(_r, (x, i) -> named_struct('s', IF(i = 0, 0, x.s), 'e', CAST(coalesce(get(_r, i + 1).s, {length}) AS int), 'label', x.label))"
    return runs.select(*df.columns, F.expr(tiled).alias("spans"))


# -- prompts ------------------------------------------------------------------
def with_context(df: DataFrame, units: str = "units", window: int = 2) -> DataFrame:
    """Adds ``contexts`` (previous, target, next) of each unit text: the first and the last unit of its window, or a sentinel where the target's text equals them."""
    first, last = f"get({units}, greatest(i - {window}, 0))", f"get({units}, least(i + {window}, size({units}) - 1))"
    body = (
        f"transform({units}, (x, i) -> named_struct('previous', IF(x = {first}, '[START OF TRACE]', {first}), 'target', x, "
        f"'next', IF(x <> {first} AND x = {last}, '[END OF TRACE]', {last})))"
    )
    return df.withColumn("contexts", F.expr(body))


def fill_template(df: DataFrame, template: str, slots: dict[str, str], out: str = "prompt") -> DataFrame:
    """Adds a prompt: the template with each {SLOT} replaced by a column."""
    c = F.lit(template)
    for slot, column in slots.items():
        c = F.replace(c, F.lit("{" + slot + "}"), F.col(column))
    return df.withColumn(out, c)


def reply_label(reply: str = "reply"):  # noqa: ANN201
    """Label of a JSON reply, null if it has none."""
    return F.get_json_object(F.col(reply), "$.label")


def reply_pairs(reply: str = "reply"):  # noqa: ANN201
    """Pairs of offsets in a reply, from its first [ to its last ]; a lone pair counts as a list of one."""
    body = F.regexp_extract(F.col(reply), r"(?s)\[.*\]", 0)
    lone = F.from_json(body, "array<int>")
    pairs = F.from_json(body, "array<array<int>>")
    return F.coalesce(F.when(F.exists(pairs, lambda p: F.size(p) == 2), pairs), F.when(F.size(lone) == 2, F.array(lone)))
