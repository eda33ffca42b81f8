"""Overlapping and gapped intervals: continuous periods and gaps (problem 2).

Sort by start per entity, compare each start with the running maximum of the
ends before it, label islands by a running count, aggregate the islands to
periods and derive the gaps between them.

An entity may hold a large part of all spans, so none is ever sorted as a whole.
Spans of one start are first reduced to the longest, which leaves at most one row
per text position.  Each block of positions is then swept on its own, and one row
per block, with the islands found in it, carries the running maximum on to the
entity's later blocks.  Gaps come first: one lies before every island that starts
beyond all ends before it, and periods are what lies between gaps.

Defined results for odd inputs: a span with a null or missing end, or of no
length, covers nothing; ends in reverse cover the same text; parts outside
[0, length) are ignored; touching spans form one period; an entity without any
covering span is one gap; an entity whose length is null or 0 has no rows;
repeated rows count once; spans of entities without a length are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.arrays import merged_spans

#: Positions per block.
BLOCK = 1 << 14


def periods_and_gaps(spans: DataFrame, lengths: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, kind, from_pos, to_pos) of the periods covered by ``spans`` (keys, s, e) and the gaps left in [0, n) of ``lengths`` (keys, n)."""
    sizes = lengths.groupBy(*keys).agg(F.max("n").alias("n")).where("n > 0")
    inside = spans.where("s IS NOT NULL AND e IS NOT NULL").select(*keys, F.greatest(F.least("s", "e"), F.lit(0)).alias("s"), F.greatest("s", "e").alias("e")).where("s < e")
    longest = inside.groupBy(*keys, "s").agg(F.max("e").alias("e")).withColumn("block", F.floor(F.col("s") / block).cast("int"))
    # at most one entry for each position of a block
    blocks = longest.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")))).alias("spans"))
    islands = blocks.select(*keys, "block", merged_spans("spans").alias("islands"))

    # one row for each block of an entity, at most length / block of them; a row of its own for an entity without spans
    in_order = Window.partitionBy(*keys).orderBy("block")
    rows = sizes.join(islands, keys, "left").withColumn("top", F.element_at("islands", -1)["e"])
    rows = rows.withColumn("carry", F.coalesce(F.max("top").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # islands ascend in start and end, so the end before one is the greater of the carried one and that of the island before it
    ends = "transform(coalesce(islands, array()), (x, i) -> named_struct('g', greatest(carry, coalesce(get(islands, i - 1).e, 0)), 's', x.s))"
    rows = rows.withColumn("gaps", F.expr(f"transform(filter({ends}, y -> y.s > y.g AND y.g < n), y -> named_struct('g', y.g, 's', least(y.s, n)))"))
    rows = rows.withColumn("reach", F.least("n", F.coalesce(F.max("top").over(Window.partitionBy(*keys)), F.lit(0))))
    later = F.first(F.when(F.size("gaps") > 0, F.col("gaps")[0]["g"]), ignorenulls=True).over(in_order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("next", F.coalesce(later, F.col("reach"))).withColumn("first", F.row_number().over(in_order) == 1)
    # a period starts behind each gap, and at 0 where no gap does, and ends at the next gap
    rows = rows.withColumn("whole", F.expr("first AND reach > 0 AND coalesce(get(gaps, 0).g, 1) > 0"))
    rows = rows.withColumn("starts", F.expr("concat(IF(whole, array(0), CAST(array() AS array<int>)), transform(gaps, y -> y.s))"))
    rows = rows.withColumn("stops", F.expr("concat(IF(whole, transform(gaps, y -> y.g), slice(transform(gaps, y -> y.g), 2, size(gaps))), array(next))"))
    piece = "named_struct('kind', '{}', 'from_pos', {}, 'to_pos', {})"
    both = f"""concat(transform(gaps, y -> {piece.format('gap', 'y.g', 'y.s')}), transform(starts, (x, i) -> {piece.format('period', 'x', 'get(stops, i)')}),
        IF(first AND reach < n, array({piece.format('gap', 'reach', 'n')}), CAST(array() AS array<struct<kind:string,from_pos:int,to_pos:int>>)))"""
    flat = rows.select(*keys, F.explode_outer(F.expr(both)).alias("x")).select(*keys, "x.kind", F.col("x.from_pos").cast("int").alias("from_pos"), F.col("x.to_pos").cast("int").alias("to_pos"))
    return flat.where("from_pos < to_pos")


def gold_spans(gold_documents: DataFrame, gold_splits: DataFrame, traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (origin, doc_id, s, e) and lengths (origin, doc_id, n) of both gold tables.

    Of gold documents the response nodes count, within the response; of gold
    splits the pairs, within the trace's text.
    """
    keep = gold_documents.where("doc_id IS NOT NULL")
    nodes = keep.select(F.lit("rf_doc").alias("origin"), "doc_id", F.explode("nodes").alias("node")).where("node.source = 'response'").select("origin", "doc_id", F.col("node.start").alias("s"), F.col("node.end").alias("e"))
    pairs = gold_splits.where("id IS NOT NULL").select(F.lit("reasoning_flow_gold").alias("origin"), F.col("id").alias("doc_id"), F.explode("split").alias("p")).select("origin", "doc_id", F.get("p", F.lit(0)).alias("s"), F.get("p", F.lit(1)).alias("e"))
    texts = traces.where("id IS NOT NULL").select(F.col("id").alias("doc_id"), F.length("rt").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    wanted = gold_splits.where("id IS NOT NULL").select(F.col("id").alias("doc_id")).distinct()
    lengths = keep.select(F.lit("rf_doc").alias("origin"), "doc_id", F.length("raw_text.response").alias("n")).unionByName(texts.join(wanted, "doc_id", "left_semi").select(F.lit("reasoning_flow_gold").alias("origin"), "doc_id", "n"))
    return nodes.unionByName(pairs), lengths


def coverage(gold_documents: DataFrame, gold_splits: DataFrame, traces: DataFrame) -> DataFrame:
    """(origin, doc_id, kind, from_pos, to_pos): periods and gaps of every gold text."""
    spans, lengths = gold_spans(gold_documents, gold_splits, traces)
    return periods_and_gaps(spans, lengths, ["origin", "doc_id"])
