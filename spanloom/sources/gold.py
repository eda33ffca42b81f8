"""Gold annotation documents: one pretty-printed JSON file per text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id string, raw_text struct<question:string,response:string>, metadata struct<batch:int,domain:string,generator:string,source:string>, "
    "nodes array<struct<id:string,annotation:boolean,start:int,end:int,label:string,text:string,source:string>>, "
    "edges array<struct<id:string,from_node_id:string,to_node_id:string,label:string>>"
)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder, with an explicit schema; unreadable files have null columns."""
    return spark.read.option("multiLine", True).schema(SCHEMA).json(path)


def samples(gold: DataFrame) -> DataFrame:
    return gold.select(F.col("doc_id").alias("id"), F.col("raw_text.question").alias("question"), F.col("metadata").alias("meta"))


def traces(gold: DataFrame) -> DataFrame:
    return gold.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("sample_id"), F.col("raw_text.response").alias("rt"), F.col("metadata.generator").alias("model"), F.col("metadata.source").alias("source"), F.col("metadata.domain").alias("domain"), F.col("metadata.batch").alias("batch"))


def spans(gold: DataFrame) -> DataFrame:
    """(id, split, labels) of the response nodes, in their order."""
    nodes = F.filter("nodes", lambda n: n["source"] == "response")
    return gold.select(F.col("doc_id").alias("id"), F.transform(nodes, lambda n: F.array(n["start"], n["end"])).alias("split"), F.transform(nodes, lambda n: n["label"]).alias("labels"))


def edges(gold: DataFrame) -> DataFrame:
    return gold.select("doc_id", F.explode("edges").alias("e")).select("doc_id", "e.*")


def upload(gold: DataFrame, path: str) -> None:
    """Writes the three projections of gold documents as tables samples, rtrace and reasoning_flow_gold under a path."""
    for name, rows in {"samples": samples(gold), "rtrace": traces(gold), "reasoning_flow_gold": spans(gold)}.items():
        rows.where("id IS NOT NULL").dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
