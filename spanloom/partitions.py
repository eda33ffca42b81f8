"""Partitioning helpers, joins that stand hot keys, and the shared folder."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a measured table is sent to all workers.
BROADCAST_BYTES = 64 << 20
#: A key is hot if it holds more than one in so many rows; there can be no more hot keys than that.
HOT_KEYS = 4_000


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """df in at least as many partitions as there are cores.

    Inputs of many files or row groups come in enough partitions already and are
    left as they are; only a small table of a single file is dealt out, so that
    Python work on it isn't done by one task.  What comes out of a shuffle is left
    as it is too; asking for its partitions would run it.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.nodeName() or any("Exchange" in line.split("[", 1)[0].split("(", 1)[0] for line in plan.toString().splitlines()):
        return df
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if df._jdf.queryExecution().toRdd().getNumPartitions() < least else df


def joined(left: DataFrame, right: DataFrame, keys: list[str], row: Column, size: Column | None = None, how: str = "inner") -> DataFrame:
    """left joined with right, a table with one row for each key.

    right is measured first (``size`` is the bytes of one row).  A small one is
    sent to all workers and left isn't shuffled.  Otherwise the rows of each hot
    key of left, of which there are at most ``HOT_KEYS``, are dealt over parts by
    the hash of ``row``, and right's rows of these keys are repeated for each
    part.  ``how`` is inner or left.
    """
    total = right.agg(F.sum(size if size is not None else F.lit(64)).alias("bytes")).first()["bytes"] or 0
    if total <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), keys, how)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.agg(F.sum("_n").alias("n")).first()["n"] or 1
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = counts.where(F.col("_n") * HOT_KEYS > rows).select(*keys, F.ceil(F.col("_n") * parts / F.lit(rows)).cast("int").alias("_parts")).where("_parts > 1")
    # rows with a null key match nothing; they are dealt out as well
    part = F.when(reduce(or_, (F.col(k).isNull() for k in keys)), F.pmod(F.hash(row), F.lit(parts))).when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.hash(row), F.col("_parts")))
    salted = left.join(F.broadcast(hot), keys, "left").withColumn("_part", part).drop("_parts")
    copies = right.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return salted.join(copies, [*keys, "_part"], how).drop("_part")


def once(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key, of several the greatest in the given order; null keys are left out.

    Keys are counted first.  If the repeated ones are few enough to be sent to
    all workers, only their rows are shuffled and all others stay where they lie.
    """
    rows = df.where(F.col(key).isNotNull())
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, F.lit(True).alias("_again"))
    n = again.count()
    if not n:
        return rows
    rest = [c for c in df.columns if c != key]

    def last(of: DataFrame) -> DataFrame:
        return of.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*").select(*df.columns)

    if n * 32 > BROADCAST_BYTES:
        return last(rows)
    marked = rows.join(F.broadcast(again), key, "left")
    return marked.where("_again IS NULL").select(*df.columns).unionByName(last(marked.where("_again").select(*df.columns)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all workers share for checkpoints and written tables: the one the cluster names.

    A folder of one machine would be lost with it, so without a setting
    (``spark.checkpoint.dir``, or a checkpoint folder set on the context) this is
    an error; tests and local runs set one of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        named = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"  # a single process: its own working folder
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all workers share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named
