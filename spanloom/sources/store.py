"""The experiment store: one table of segmentations, partitioned by experiment."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, spans array<struct<s:int,e:int>>, labels array<string>, ptime double, error string, exp_id string"


def experiment_name(engines: list[str], aligner: str | None, unit: str) -> str:
    if len(engines) > 1 and not aligner:
        raise ValueError("several engines need an aligner")
    return "_".join([*engines, *([aligner] if len(engines) > 1 else []), unit])


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read(spark: SparkSession, path: str, exp_id: str | None = None) -> DataFrame:
    """Stored segmentations; a filter on the experiment reads its partition only."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    stored = spark.read.schema(SCHEMA).parquet(path)
    return stored.where(F.col("exp_id") == exp_id) if exp_id else stored


def missing(traces: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Traces without a result."""
    return traces.join(done.select(key).distinct(), key, "left_anti")


def segment(spark: SparkSession, path: str, traces: DataFrame, exp_id: str, engine: Callable[[DataFrame], DataFrame]) -> int:
    """Runs an engine on the traces an experiment lacks and appends the results; returns how many there were.

    ``ptime`` is the job's time per trace, since expressions on columns have none of their own.
    """
    todo = missing(traces, read(spark, path, exp_id)).dropDuplicates(["id"]).persist()
    n = todo.count()
    if n:
        began = time.time()
        out = engine(todo).select("id", "spans").persist()
        out.count()
        per = (time.time() - began) / n
        out.select("id", "spans", F.expr("transform(spans, x -> 'UNK')").alias("labels"), F.lit(per).alias("ptime"), F.lit(None).cast("string").alias("error"), F.lit(exp_id).alias("exp_id")).write.mode("append").partitionBy("exp_id").parquet(path)
        out.unpersist()
    todo.unpersist()
    return n


def replace(df: DataFrame, path: str) -> None:
    """Overwrites the experiments that df holds, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("exp_id").parquet(path)


def rename(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Stores an experiment under another name as well; the old one is then dropped by its folder."""
    rows = read(spark, path, old).withColumn("exp_id", F.lit(new)).dropDuplicates(["id"])
    rows.write.mode("append").partitionBy("exp_id").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/exp_id={old}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def counts(stored: DataFrame) -> DataFrame:
    return stored.groupBy("exp_id").agg(F.count(F.lit(1)).alias("n"))


def times(stored: DataFrame) -> DataFrame:
    """Mean, median and 95th percentile of the times of each experiment."""
    q = F.percentile("ptime", F.array(F.lit(0.5), F.lit(0.95)))
    return stored.groupBy("exp_id").agg(F.avg("ptime").alias("mean"), q[0].alias("p50"), q[1].alias("p95"))
