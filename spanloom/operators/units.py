"""Base units of texts: masking, sentence and clause tilers and their post-passes.

All functions take a DataFrame with one row per text and add columns; no rows
are shuffled.  Null texts have null units, empty texts none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import arrays

#: What is masked, in this order: display formula, formula, fenced code, inline code.
MASK_PATTERN = r"(?s)\$\$.*?\$\$|\$.*?\$|```.*?```|`.*?`"
#: Pieces of a text that join up to it again: up to end marks and the space behind, or what is left.
SENTENCE_PATTERN = r"[^.!?\n]*[.!?\n]+[ \t\n\r\f]*|[^.!?\n]+"
#: The same with commas, colons and semicolons; which of them end a clause is decided afterwards.
CLAUSE_PATTERN = r"[^.!?\n,;:]*(?:[.!?\n]+|[,;:])[ \t\n\r\f]*|[^.!?\n,;:]+"
CONNECTIVES = "and but because which that so while whereas if when since although although though where who or as"
WORD = r"[^ \t\n\r\f]+"
#: Words before a clause mark from which it may end a clause; words and characters below which a unit is a micro-unit.
MIN_WORDS, MICRO_WORDS, MICRO_CHARS = 4, 3, 10


def mask(df: DataFrame, text: str = "text", filler: str = "x") -> DataFrame:
    """Adds ``masked``, the text with each formula and code block filled at its length, and ``n_blocks``, their number.

    Since lengths are kept, offsets in the masked text are offsets in the text.
    """
    pattern = F.lit(MASK_PATTERN)
    return df.withColumn("_b", F.regexp_extract_all(F.col(text), pattern, F.lit(0))).select(
        *df.columns,
        F.size("_b").alias("n_blocks"),
        F.array_join(F.zip_with(F.split(F.col(text), MASK_PATTERN, -1), F.col("_b"), lambda gap, b: F.concat(gap, F.when(b.isNull(), F.lit("")).otherwise(F.repeat(F.lit(filler), F.length(b))))), "").alias("masked"),
    )


def _pieces(df: DataFrame, text: str, pattern: str) -> DataFrame:
    return df.withColumn("_p", F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), F.lit(1)))


def sentence_units(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``units``, sentence spans that tile the text."""
    return _pieces(df, text, SENTENCE_PATTERN).select(*df.columns, arrays.tiled_spans(F.transform("_p", F.length)).alias("units"))


def _words(x: str) -> str:
    return rf"size(regexp_extract_all({x}, '[^ \\t\\n\\r\\f]+', 0))"


def _stripped(x: str) -> str:
    return rf"length(regexp_replace({x}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', ''))"


def clause_units(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Adds ``units``, clause spans that tile the text.

    A sentence's pieces at commas, colons and semicolons are cut apart where at
    least ``min_words`` words stand between the marks, at commas only if a
    connective follows.
    """
    words = CONNECTIVES.split()
    begins = "(" + "|".join(sorted(set(words))) + ")"
    facts = (
        "transform(_p, (x, i) -> named_struct('n', length(x), 'cut', i = 0 "
        rf"OR get(_p, i - 1) RLIKE '[.!?\\n][ \\t\\n\\r\\f]*$' "
        rf"OR (get(_p, i - 1) RLIKE '[;:][ \\t\\n\\r\\f]*$' AND {_words('get(_p, i - 1)')} >= {min_words}) "
        rf"OR (get(_p, i - 1) RLIKE ',[ \\t\\n\\r\\f]*$' AND {_words('get(_p, i - 1)')} >= {min_words} AND lower(x) RLIKE '^{begins}[ \\t\\n\\r\\f]')))"
    )
    return _pieces(df, text, CLAUSE_PATTERN).withColumn("_f", F.expr(facts)).select(*df.columns, _grouped("cut"))


def _grouped(opens: str) -> Column:
    """Spans of runs of the pieces in _f (structs with their length n); a piece with the flag ``opens`` opens a span."""
    return arrays.grouped_spans(F.transform("_f", lambda x: x["n"]), F.transform("_f", lambda x: x[opens])).alias("units")


def micro_merged(df: DataFrame, text: str = "text", pattern: str = SENTENCE_PATTERN, words: int = MICRO_WORDS, chars: int = MICRO_CHARS) -> DataFrame:
    """Adds ``units``: tiled units of which each with fewer words or stripped characters is merged into the one before; the first never is."""
    facts = f"transform(_p, x -> named_struct('n', length(x), 'big', {_words('x')} >= {words} AND {_stripped('x')} >= {chars}))"
    return _pieces(df, text, pattern).withColumn("_f", F.expr(facts)).select(*df.columns, _grouped("big"))


def overlap_merged(df: DataFrame, spans: str = "spans") -> DataFrame:
    """Adds ``merged``: spans in order of their start, each that starts before the running end merged into it.

    Unlike the periods of ``intervals``, spans that only touch stay apart.
    """
    return df.withColumn("merged", arrays.overlap_merged_spans(F.array_sort(spans)))


def exploded(df: DataFrame, keys: list[str], array: str | Column, index: str, value: str) -> DataFrame:
    """(keys, index, value): one row per entry of an array.

    The outer form is used since for the inner one Spark infers a filter on the
    array's size and pushes it down, which computes the array a second time
    with all that it is made of written out.
    """
    both = df.select(*keys, F.posexplode_outer(array).alias(index, value))
    return both.where(F.col(index).isNotNull())


def long(df: DataFrame, keys: list[str], spans: str = "units", index: str = "unit_idx") -> DataFrame:
    """One row per span: keys, index, s, e."""
    return exploded(df, keys, spans, index, "_u").select(*keys, index, F.col("_u.s").alias("s"), F.col("_u.e").alias("e"))
