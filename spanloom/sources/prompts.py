"""Prompt templates by name, and example texts.

Templates have slots in braces, which ``engines.fill_template`` fills from
columns; labels stand in the slot ``{LABELS}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONTEXT = "Before: {PREVIOUS}\nUnit: {TARGET}\nAfter: {NEXT}\n"
_ANSWER = 'Answer with JSON alone, like {"label": "..."}.\n'

PROMPTS = {
    "thought_anchor": "Say what this unit of a solution does. Labels: {LABELS}.\n" + _ANSWER + _CONTEXT,
    "reasoning_flow": "Name the step that this unit of a line of reasoning takes. Labels: {LABELS}.\n" + _ANSWER + _CONTEXT,
    "argument": "Name the part that this unit plays in the argument. Labels: {LABELS}.\n" + _ANSWER + _CONTEXT,
    "offsets": "Cut the text where a new thought starts. Answer with pairs of offsets, like [[0, 12], [12, 40]].\n{TARGET}",
    "groups": "Put the numbered units that belong together into groups of numbers in order, like [[0, 1], [2]].\n{TARGET}",
    "topic": "Give a short name to what these words are about.\n{TARGET}",
}

#: Short made-up lines of reasoning to try engines on.
EXAMPLES = {
    "pump": "Let me see what is asked. A pump fills a tank in 6 hours and a leak empties it in 9. In one hour 1/6 comes in and 1/9 goes out.\n\nSo the tank gains 1/18 each hour. Wait, is the leak open from the start? Yes, it is.\n\nTherefore the tank is full after 18 hours. The answer is 18.",
    "rod": "We need to find the mass of the rod. I recall that mass is density times volume. The volume is 4 cubic centimetres.\n\nBut the density is given per litre, so I convert it first: 2,700 g per litre are 2.7 g per cubic centimetre.\n\nHence the mass is 10.8 g. Let me check the unit: g. Final answer: 10.8 g.",
}


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(name, template) from JSON files that map names to templates."""
    rows = spark.read.option("multiLine", True).text(path, wholetext=True)
    return rows.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "template"))


def examples(spark: SparkSession) -> DataFrame:
    """(id, text) of the example texts."""
    return spark.createDataFrame(sorted(EXAMPLES.items()), "id string, text string")
