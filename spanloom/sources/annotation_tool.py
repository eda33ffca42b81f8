"""Tasks for a span annotation tool, and the annotations that come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANNOTATIONS = "struct<annotations:array<struct<completed_by:int,result:array<struct<value:struct<start:string,end:string,startOffset:int,endOffset:int,hypertextlabels:array<string>>>>>>"


def boxes(df: DataFrame, text: str, spans: str, out: str = "html") -> DataFrame:
    """Adds the text as HTML, one box for each span, quotes escaped."""
    box = f"concat('<p>', replace(replace(replace(substring({text}, x.s + 1, x.e - x.s), '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '</p>')"
    return df.withColumn(out, F.expr(f"concat('<div>', array_join(transform({spans}, x -> {box}), ''), '</div>')"))


def sample_per_group(df: DataFrame, groups: list[str], key: str, n: int = 1, seed: str = "0", first: list[str] | None = None) -> DataFrame:
    """n rows of each group, those smallest in the columns ``first`` and of these the ones whose keys have the smallest hashes.

    A group may hold a large part of all rows: the best of each of 32 parts of a
    group come first, then the best of those.
    """
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    order_by = [*(first or []), "_h", key]
    part = Window.partitionBy(*groups, F.pmod(F.hash(key), F.lit(32))).orderBy(*order_by)
    few = df.withColumn("_h", order).withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n)
    return few.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order_by))).where(F.col("_r") <= n).drop("_h", "_r")


def imported(tasks: DataFrame, units: DataFrame) -> DataFrame:
    """(id, completed_by, s, e, label) from tasks (id, annotations) and the texts' units (id, units).

    An annotation points to the 1-based box of its start and end by a path
    ending in [n]; a path without one is the first box.  Annotations of boxes
    that don't exist are left out.
    """
    flat = tasks.select("id", F.explode("annotations").alias("a")).select("id", F.col("a.completed_by").alias("completed_by"), F.explode("a.result").alias("r")).select("id", "completed_by", F.col("r.value").alias("v"))

    def box(path: str) -> F.Column:  # type: ignore[name-defined]
        n = F.regexp_extract(F.col(path), r"p\[(\d+)\]", 1)
        return F.when(n == "", 1).otherwise(n.cast("int"))

    joined = flat.join(units, "id").select("id", "completed_by", "v", F.get("units", box("v.start") - 1).alias("first"), F.get("units", box("v.end") - 1).alias("last"))
    return joined.where("first IS NOT NULL AND last IS NOT NULL").select("id", "completed_by", (F.col("first.s") + F.col("v.startOffset")).alias("s"), (F.col("last.s") + F.col("v.endOffset")).alias("e"), F.col("v.hypertextlabels").alias("label"))


def exported_annotations(df: DataFrame, key: str, units: str, labels: str, annotator: int) -> DataFrame:
    """(id, annotations) as the tool would send them, for units with labels; the inverse of ``imported``."""
    path = "concat('/div[1]/p[', i + 1, ']/text()[1]')"
    value = f"named_struct('start', {path}, 'end', {path}, 'startOffset', 0, 'endOffset', x.e - x.s, 'hypertextlabels', array(get({labels}, i)))"
    return df.select(F.col(key).alias("id"), F.expr(f"array(named_struct('completed_by', {annotator}, 'result', transform({units}, (x, i) -> named_struct('value', {value}))))").alias("annotations"))
