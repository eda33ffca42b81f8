"""Named engines and aligners."""

import pytest
from pyspark.sql import functions as F

from spanloom import pipeline
from tests.conftest import DATA, rows


def test_every_engine_covers_text(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("id"), "text").limit(20)
    for name in pipeline.ENGINES:
        out = pipeline.Segmenter([name]).segment(docs).collect()
        assert len(out) == 20, name
        assert all(s["s"] <= s["e"] for r in out for s in r["spans"]), name


def test_fused_and_own(spark):
    df = spark.createDataFrame([(1, "One. Therefore two.\nThree."), (2, None), (3, "")], "id int, text string")
    s = pipeline.Segmenter(["newline", "marker", "every"], "voting", options={"every": {"size": 8}})
    assert s.exp_id == "newline_marker_every_voting_sent"
    got = {r["id"]: r["spans"] for r in s.segment(df).collect()}
    assert [tuple(x) for x in got[1]] == [(0, 26)] and not got[2]
    pipeline.register_engine("whole", lambda t, key: t.select(key, F.expr("array(named_struct('s', 0, 'e', n))").alias("spans")))
    assert [tuple(x) for x in rows(pipeline.Segmenter(["whole", "newline"], "graph").segment(df.where("id = 1")))[0][1]] != []
    for bad in ({"names": ["nope"]}, {"names": ["newline", "marker"]}, {"names": ["newline"], "unit": "page"}, {"names": ["newline", "marker"], "aligner": "nope"}):
        with pytest.raises(ValueError):
            pipeline.Segmenter(**bad)


def test_unit_reaches_the_engines(spark):
    text = "We need to add the two parts, because the rest of it is known; the answer is 4 so far. Wait, the first one is wrong here. " * 3
    df = spark.createDataFrame([(1, text)], "id int, text string")
    for name in ("shift", "entailment", "groups", "anchors"):
        by_unit = {u: [(x["s"], x["e"]) for x in pipeline.Segmenter([name], unit=u).segment(df).first()["spans"]] for u in ("sent", "clause")}
        assert by_unit["sent"] != by_unit["clause"], name


def test_own_providers(spark):
    df = spark.createDataFrame([(1, "One two. Three four. Five six. Seven.")], "id int, text string")
    always = lambda prompt: '{"label": "Fact"}'
    assert [(x["s"], x["e"], x["label"]) for x in pipeline.Segmenter(["flow"], options={"flow": {"reply": always}}).segment(df).first()["spans"]] == [(0, 37, "Fact")]
    never = lambda prompt: "no json"
    assert {x["label"] for x in pipeline.Segmenter(["flow"], options={"flow": {"reply": never}}).segment(df).first()["spans"]} == {"UNK"}

    def flat_scores(texts, key):
        return texts.select(key, F.split("text", "(?<=[ .])").alias("tokens")).withColumn("surprisal", F.transform("tokens", lambda t: F.length(t).cast("double")))

    assert pipeline.Segmenter(["surprisal"], options={"surprisal": {"scores": flat_scores, "window": 2}}).segment(df).count() == 1
