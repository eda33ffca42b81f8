"""Queries of the operators on training texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import consensus, leaks, packing, pairs, quality, repetition, sentences_spark, splitting
from spanloom.tables import read

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Traces with a defect, and which."""
    return pairs.broken_pairs(read(spark, d, "samples"), read(spark, d, "rtrace"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Traces that must be split, and whether a cut inside a stretch is forced."""
    return splitting.split_traces(read(spark, d, "rtrace"), read(spark, d, "size_limits")).select("rtrace_id", "forced")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of the traces that must be split."""
    out = splitting.split_traces(read(spark, d, "rtrace"), read(spark, d, "size_limits"))
    return out.select("rtrace_id", F.posexplode("pieces").alias("piece", "p")).select("rtrace_id", "piece", "p.piece_start", "p.piece_end", "p.cut")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Traces of which two fifths or more are repetition."""
    return repetition.repetitive(read(spark, d, "rtrace"))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of repeated content of every trace."""
    out = repetition.repetition(read(spark, d, "rtrace"))
    return out.select("rtrace_id", F.round("share", 6).alias("repeated_share"), F.round("score", 6).alias("score"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of every trace."""
    return sentences_spark.sentence_units(read(spark, d, "rtrace"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The right label of every unit."""
    units, _ = _consensus(spark, d)
    return units.select("unit_id", "label")


def p6_units(spark: SparkSession, d: str) -> DataFrame:
    """Label, agreement and votes of every unit."""
    units, _ = _consensus(spark, d)
    return units.select("unit_id", "label", F.round("agreement", 6).alias("agreement"), "n_votes")


def p6_confusions(spark: SparkSession, d: str) -> DataFrame:
    """Label of every unit if the annotators' confusion tables settle it."""
    units, _ = _consensus(spark, d, "confusions")
    return units.select("unit_id", "label")


def p6_annotators(spark: SparkSession, d: str) -> DataFrame:
    """Reliability of every annotator."""
    _, annotators = _consensus(spark, d)
    return annotators.select("annotator", F.round("reliability", 6).alias("reliability"), "n_votes")


def _consensus(spark: SparkSession, d: str, settle: str = "votes") -> tuple[DataFrame, DataFrame]:
    return consensus.consensus(read(spark, d, "ta_votes"), {1: read(spark, d, "thought_anchor_gold_ha"), 8: read(spark, d, "thought_anchor_gold_ve")}, settle=settle)


def p8_filling(spark: SparkSession, d: str) -> DataFrame:
    """The filling of containers with all documents."""
    return packing.fill_containers(read(spark, d, "documents"), read(spark, d, "size_limits"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items they leak."""
    return leaks.leaks(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Leaks with the length of their longest passage and the words replaced in it."""
    return leaks.leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    return quality.no_prose(read(spark, d, "documents"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics, robust z-scores, percentile bands and tails of every document."""
    return quality.scored_statistics(read(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_shares": p4_shares,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_units": p6_units,
    "p6_confusions": p6_confusions,
    "p6_annotators": p6_annotators,
    "p8_filling": p8_filling,
    "p9_found": p9_found,
    "p9_passages": p9_passages,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}

#: SQL where it can express the operator; the rest is tested against brute force, round trips and labelled rows.
ORACLE_SQL: dict[str, str] = {
    "p3_found": r"""
        WITH lim AS (SELECT min(capacity) AS capacity FROM size_limits WHERE purpose = 'rt_pieces'),
        t AS (SELECT id, max(rt) AS rt FROM rtrace, lim WHERE id IS NOT NULL AND length(rt) > lim.capacity GROUP BY id)
        SELECT id AS rtrace_id,
               CAST(list_max(list_transform(regexp_split_to_array(rt, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?。！？।؟]'), lambda x: length(x))) > (SELECT capacity FROM lim) AS INTEGER) AS forced
        FROM t
    """,
}
