"""Coherence folds over units, topics, and engines that ask a model.

Each engine is a provider of scores or replies and a decision on them.  The
built-in providers are deterministic and need no model (hashed word vectors,
word overlap, keyword labels); others are any function with the same signature.
The folds depend on what was accepted before, so they run per text in Arrow
batches; a text is one row, nothing is shuffled.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.engines import absorbed_runs
from spanloom.partitions import spread
from spanloom.sources.prompts import PROMPTS

Embed = Callable[[list[str]], np.ndarray]
Entail = Callable[[list[tuple[str, str]]], list[tuple[float, float]]]
Reply = Callable[[str], str]

_WORD = re.compile(r"[^\W_]+")


# -- providers ------------------------------------------------------------------
def hashed_vectors(texts: list[str], size: int = 64) -> np.ndarray:
    """Unit vectors of hashed word counts."""
    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in _WORD.findall(t.lower()):
            h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            out[i, h % size] += 1 if h & 0x10000 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def word_overlap(pairs: list[tuple[str, str]]) -> list[tuple[float, float]]:
    """(entailed, neutral) shares of premise and hypothesis from their common words."""
    out = []
    for premise, hypothesis in pairs:
        a, b = set(_WORD.findall(premise.lower())), set(_WORD.findall(hypothesis.lower()))
        e = len(a & b) / len(b) if b else 0.0
        out.append((e, (1 - e) / 2))
    return out


# -- folds ----------------------------------------------------------------------
def semantic_shift(vectors: np.ndarray, tolerance: float = 0.15, least: float = 0.4) -> list[tuple[int, int]]:
    """(first, last) units of each segment.

    A unit joins the segment if its similarity to the segment's mean, or the next
    unit's, reaches the running average less the tolerance, but at least ``least``.
    """
    n = len(vectors)
    if not n:
        return []

    def similar(a: np.ndarray, b: np.ndarray) -> float:
        d = float(np.linalg.norm(a) * np.linalg.norm(b))
        return float(a @ b) / d if d else 0.0

    out, first, total, average = [], 0, vectors[0].astype(float).copy(), 1.0
    for i in range(1, n):
        centre = total / (i - first)
        sim = similar(centre, vectors[i])
        bar = max(average - tolerance, least)
        if sim >= bar or (i + 1 < n and similar(centre, vectors[i + 1]) >= bar):
            total += vectors[i]
            average = (average + sim) / 2
        else:
            out.append((first, i - 1))
            first, total, average = i, vectors[i].astype(float).copy(), 1.0
    return [*out, (first, n - 1)]


def entailment_fold(units: list[str], entail: Entail = word_overlap, neutral: float = 0.4, tolerance: float = 0.15, least: float = 0.25) -> list[tuple[int, int]]:
    """(first, last) units of each segment: a unit joins if the last two units of the segment, or with them the next unit, entail it well enough.

    The contexts a unit can meet are the two units before it or the one before
    it, so all their scores are asked for at once.
    """
    n = len(units)
    if not n:
        return []
    asked: dict[tuple[int, int, int], int] = {}
    pairs: list[tuple[str, str]] = []
    for i in range(1, n):
        for width in (1, 2):
            for target in (i, i + 1):
                if i - width >= 0 and target < n:
                    asked[i, width, target] = len(pairs)
                    pairs.append((" ".join(units[i - width : i]), units[target]))
    scores = [min(max(e + neutral * u, 0.0), 1.0) for e, u in entail(pairs)]
    out, first, average = [], 0, 0.85
    for i in range(1, n):
        width = min(2, i - first)
        score = scores[asked[i, width, i]]
        bar = max(average - tolerance, least)
        ahead = scores[asked[i, width, i + 1]] if i + 1 < n else 0.0
        if score >= bar or ahead >= bar:
            average = 0.7 * average + 0.3 * score
        else:
            out.append((first, i - 1))
            first, average = i, 0.85
    return [*out, (first, n - 1)]


def _per_text(df: DataFrame, key: str, fold: Callable[[list[str]], list[tuple[int, int]]], text: str, units: str) -> DataFrame:
    narrow = df.select(key, text, units)
    kind = dict(narrow.dtypes)[key]
    out_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, us in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                us = us or []
                rows.append([{"s": us[i]["s"], "e": us[j]["e"]} for i, j in fold([t[u["s"] : u["e"]] for u in us])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, out_type)], names=[key, "spans"])

    return spread(narrow).mapInArrow(walk, f"`{key}` {kind}, spans array<struct<s:int,e:int>>")


def by_semantic_shift(df: DataFrame, key: str, text: str = "text", units: str = "units", embed: Embed = hashed_vectors, tolerance: float = 0.15, least: float = 0.4) -> DataFrame:
    """(key, spans) from the first unit's start to the last unit's end of each segment."""
    return _per_text(df, key, lambda us: semantic_shift(embed(us), tolerance, least) if us else [], text, units)


def by_entailment(df: DataFrame, key: str, text: str = "text", units: str = "units", entail: Entail = word_overlap) -> DataFrame:
    """(key, spans) of entailment_fold."""
    return _per_text(df, key, lambda us: entailment_fold(us, entail), text, units)


# -- topics ---------------------------------------------------------------------
def cluster_units(vectors: np.ndarray, k: int = 8, rounds: int = 25, seed: int = 42) -> np.ndarray:
    """Cluster of each vector by k-means with farthest starts; deterministic for a seed."""
    n = len(vectors)
    k = min(k, n)
    if k < 1:
        return np.zeros(0, dtype=int)
    rng = np.random.default_rng(seed)
    centres = [vectors[rng.integers(n)]]
    for _ in range(1, k):
        d = np.min([((vectors - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(vectors[int(np.argmax(d))])
    c = np.array(centres)
    own = np.zeros(n, dtype=int)
    for _ in range(rounds):
        own = np.argmin(((vectors[:, None, :] - c[None]) ** 2).sum(axis=2), axis=1)
        fresh = np.array([vectors[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(k)])
        if np.allclose(fresh, c):
            break
        c = fresh
    return own


def topic_labels(units: list[str], least_units: int = 100, k: int = 8, embed: Embed = hashed_vectors) -> list[str]:
    """A topic label for each unit: its cluster's most telling words; texts of few units get a keyword label instead."""
    if len(units) < least_units:
        return [keyword_label(u) for u in units]
    own = cluster_units(embed(units), k)
    words = [Counter(_WORD.findall(u.lower())) for u in units]
    per: dict[int, Counter] = {}
    for c, w in zip(own, words):
        per.setdefault(int(c), Counter()).update(w)
    everywhere: Counter = sum(per.values(), Counter())
    mean = sum(everywhere.values()) / max(1, len(per))
    names = {}
    for c, w in per.items():
        size = sum(w.values()) or 1
        names[c] = "_".join(sorted(w, key=lambda x, w=w, size=size: (-(w[x] / size) * math.log1p(mean / everywhere[x]), x))[:3])
    return [names[int(c)] for c in own]


# --------------------------------------------------------------------------
# Label sets of the reasoning-flow and thought-anchor schemes, of
# the general scheme, and of argument mining.
# --------------------------------------------------------------------------
LABEL_SETS = {
    "reasoning_flow": ["Context", "Planning", "Fact", "Reasoning", "Restatement", "Assumption", "Example", "Reflection", "Conclusion"],
    "thought_anchor": ["Problem Setup", "Plan Generation", "Fact Retrieval", "Active Computation", "Uncertainty Management", "Result Consolidation", "Self Checking", "Final Answer Emission"],
    "general": ["Context", "Planning", "Fact", "Restatement", "Example", "Reflection", "Conclusion"],
    "argument": ["PREMISE", "INTERMEDIATE CLAIM", "REBUTTAL-CORRECTION", "FINAL CLAIM", "META"],
}


def label_scores(unit: str, labels: list[str]) -> list[float]:
    """Scores of labels by words and word beginnings that they share with a unit."""
    words = _WORD.findall(unit.lower())
    return [sum(w[:5] == part[:5] for w in words for part in _WORD.findall(label.lower())) / (len(words) or 1) for label in labels]


def zero_shot_labels(units: list[str], labels: list[str], score: Callable[[str, list[str]], list[float]] = label_scores) -> list[str]:
    """The best label of each unit, the first of equal ones."""
    return [max(zip(score(u, labels), range(len(labels), 0, -1), labels))[2] for u in units]


def labelled_runs(labels: list[str], spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Runs of equal labels with their spans."""
    out: list[tuple[int, int, str]] = []
    for label, (s, e) in zip(labels, spans):
        if out and out[-1][2] == label:
            out[-1] = (out[-1][0], e, label)
        else:
            out.append((s, e, label))
    return out


def by_labels(df: DataFrame, key: str, label: Callable[[list[str]], list[str]], text: str = "text", units: str = "units") -> DataFrame:
    """(key, spans of (s, e, label)): runs of the labels that a function gives the units of a text, such as topic_labels."""
    narrow = df.select(key, text, units)
    kind = dict(narrow.dtypes)[key]
    out_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("label", pa.string())]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, us in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                spans = [(u["s"], u["e"]) for u in us or []]
                rows.append([dict(zip(("s", "e", "label"), r)) for r in labelled_runs(label([t[s:e] for s, e in spans]), spans)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, out_type)], names=[key, "spans"])

    return spread(narrow).mapInArrow(walk, f"`{key}` {kind}, spans array<struct<s:int,e:int,label:string>>")


#: Keyword labels, tried in this order; the default is the last.
KEYWORDS = [("conclusion", ("answer", "therefore", "conclusion", "final")), ("reflection", ("wait", "hmm", "check", "wrong")), ("planning", ("let", "need", "next", "first")), ("fact", ("know", "recall", "table")), ("reasoning", ())]


def keyword_label(unit: str) -> str:
    words = set(_WORD.findall(unit.lower()))
    return next(label for label, keys in KEYWORDS if not keys or words & set(keys))


def keyword_label_sql(unit: str) -> str:
    """keyword_label as an SQL expression."""
    tests = " ".join(f"WHEN lower({unit}) RLIKE '(^|[^\\\\p{{L}}\\\\p{{N}}])({'|'.join(keys)})($|[^\\\\p{{L}}\\\\p{{N}}])' THEN '{label}'" for label, keys in KEYWORDS if keys)
    return f"CASE {tests} ELSE '{KEYWORDS[-1][0]}' END"


def topic_terms(terms: DataFrame, cluster: str, term: str, top: int = 10) -> DataFrame:
    """(cluster, term, n, weight, rank): class TF-IDF of terms, ln(1 + mean words per cluster / words of the term) times the term's share of its cluster."""
    counts = terms.groupBy(cluster, term).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(cluster).agg(F.sum("n").alias("size"))
    mean = sizes.agg(F.avg("size").alias("m")).first()["m"] or 0.0  # one number
    everywhere = counts.groupBy(term).agg(F.sum("n").alias("all_n"))
    weighed = counts.join(everywhere, term).join(sizes, cluster).select(cluster, term, "n", F.round(F.col("n") / F.col("size") * F.log1p(F.lit(mean) / F.col("all_n")), 9).alias("weight"))
    # the best of each part of a cluster first, so that a large cluster isn't ranked in one place
    part = Window.partitionBy(cluster, F.pmod(F.hash(term), F.lit(16))).orderBy(F.desc("weight"), term)
    few = weighed.withColumn("r", F.row_number().over(part)).where(F.col("r") <= top).drop("r")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("weight"), term))).where(F.col("rank") <= top)


# -- engines that ask a model ---------------------------------------------------
def parse_pairs(reply: str) -> list[tuple[int, int]] | None:
    """Pairs of offsets in a reply, from its first [ to its last ]; None if malformed."""
    a, b = reply.find("["), reply.rfind("]")
    try:
        data = json.loads(reply[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        return None
    if not isinstance(data, list) or not data:
        return None
    if len(data) == 2 and all(isinstance(x, int) for x in data):
        data = [data]
    if not all(isinstance(p, list) and len(p) == 2 and all(isinstance(x, int) for x in p) for p in data):
        return None
    return [(p[0], p[1]) for p in data]


def offset_chunks(text: str, reply: Reply, chunk: int = 300, tail: int = 20, retries: int = 5) -> list[tuple[int, int]]:
    """Spans from a model that is given the text in chunks and returns offsets in each; malformed or stalling replies are asked again a bounded number of times, then the chunk is one span."""
    out, i = [], 0
    while i < len(text) - tail:
        piece = text[i : i + chunk]
        pairs = None
        for _ in range(retries):
            pairs = parse_pairs(reply(piece))
            if pairs and 0 < pairs[-1][1] <= len(piece):
                break
            pairs = None
        pairs = pairs or [(0, len(piece))]
        out += [(i + s, i + e) for s, e in pairs]
        i = out[-1][1]
    if i < len(text):
        out.append((i, len(text)))
    return out


def unit_groups(n: int, group: Callable[[int, int], list[list[int]]], chunk: int = 100, grow: int = 5, retries: int = 30) -> list[list[int]]:
    """Groups of unit numbers from a model that is shown windows of units.

    The last group of a window is dropped and starts the next one; the window
    grows if one group fills it.
    """
    out: list[list[int]] = []
    at, size, tries = 0, chunk, 0
    while at < n:
        stop = min(at + size, n)
        groups = [sorted(g) for g in group(at, stop) if g]
        valid = bool(groups) and [x for g in groups for x in g] == list(range(at, stop))
        if not valid:
            tries += 1
            if tries > retries:
                return [*out, list(range(at, n))]
            continue
        if stop == n:
            return out + groups
        if len(groups) == 1:
            size += grow
            continue
        out += groups[:-1]
        at, size = groups[-1][0], chunk
    return out


def sentence_reply(piece: str) -> str:
    """A provider for offset_chunks: cuts behind end marks."""
    cuts = [m.end() for m in re.finditer(r"[.!?\n]+[ \t\n\r\f]*", piece)] or [len(piece)]
    return json.dumps([list(p) for p in zip([0, *cuts[:-1]], cuts)])


def by_offset_chunks(df: DataFrame, key: str, text: str = "text", reply: Reply = sentence_reply, chunk: int = 300) -> DataFrame:
    """(key, spans) of offset_chunks."""
    narrow = df.select(key, text)
    kind = dict(narrow.dtypes)[key]
    out_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[{"s": s, "e": e} for s, e in offset_chunks(t, reply, chunk)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, out_type)], names=[key, "spans"])

    return spread(narrow).mapInArrow(walk, f"`{key}` {kind}, spans array<struct<s:int,e:int>>")


# -- engines that show a model units --------------------------------------------
Group = Callable[[list[str], int, int], list[list[int]]]


def groups_of_three(units: list[str], start: int, stop: int) -> list[list[int]]:
    """A provider for by_unit_groups: units 0 to 2, 3 to 5, and so on."""
    return [[i for i in range(max(start, k), min(k + 3, stop))] for k in range(start - start % 3, stop, 3)]


def by_unit_groups(df: DataFrame, key: str, text: str = "text", units: str = "units", group: Group = groups_of_three, chunk: int = 100) -> DataFrame:
    """(key, spans) from the first unit's start to the last unit's end of each of unit_groups."""
    return _per_text(df, key, lambda us: [(g[0], g[-1]) for g in unit_groups(len(us), lambda a, b: group(us, a, b), chunk)], text, units)


# --------------------------------------------------------------------------
# What the keyword labels are called in each scheme.
# --------------------------------------------------------------------------
SCHEMES = {
    "thought_anchor": {"conclusion": "Final Answer Emission", "reflection": "Self Checking", "planning": "Plan Generation", "fact": "Fact Retrieval", "reasoning": "Active Computation"},
    "reasoning_flow": {"conclusion": "Conclusion", "reflection": "Reflection", "planning": "Planning", "fact": "Fact", "reasoning": "Reasoning"},
    "argument": {"conclusion": "FINAL CLAIM", "reflection": "REBUTTAL-CORRECTION", "planning": "META", "fact": "PREMISE", "reasoning": "INTERMEDIATE CLAIM"},
}


def keyword_reply(scheme: str) -> Reply:
    """A provider for by_prompted_labels: replies with the scheme's name of the unit's keyword label."""

    def reply(prompt: str) -> str:
        unit = prompt.partition("\nUnit: ")[2].rpartition("\nAfter: ")[0]
        return json.dumps({"label": SCHEMES[scheme][keyword_label(unit)]})

    return reply


def prompted_labels(units: list[str], template: str, labels: list[str], reply: Reply, window: int = 2, retries: int = 5) -> list[str]:
    """A label for each unit from a model that is shown it in its context.

    Replies that aren't JSON with one of the labels are asked for again a bounded
    number of times, then the unit is UNK.
    """
    out = []
    for i, unit in enumerate(units):
        first, last = units[max(i - window, 0)], units[min(i + window, len(units) - 1)]
        slots = {"LABELS": ", ".join(labels), "PREVIOUS": "[START OF TRACE]" if unit == first else first, "NEXT": "[END OF TRACE]" if unit != first and unit == last else last, "TARGET": unit}
        prompt = template
        for slot, value in slots.items():
            prompt = prompt.replace("{" + slot + "}", value)
        label = None
        for _ in range(retries):
            try:
                label = json.loads(reply(prompt)).get("label")
            except (ValueError, AttributeError):
                continue
            if label in labels:
                break
            label = None
        out.append(label or "UNK")
    return out


def by_prompted_labels(df: DataFrame, key: str, scheme: str, text: str = "text", units: str = "units", reply: Reply | None = None, template: str | None = None) -> DataFrame:
    """(key, spans of (s, e, label)): runs of the labels of a scheme that a model gives the units; in the argument scheme the last run is absorbed and spans are tiled."""
    labels, ask, prompt = LABEL_SETS[scheme], reply or keyword_reply(scheme), template or PROMPTS[scheme]
    if scheme != "argument":
        return by_labels(df, key, lambda us: prompted_labels(us, prompt, labels, ask), text, units)
    each = by_labels(df.select(key, text, units), key, lambda us: prompted_labels(us, prompt, labels, ask), text, units)
    return absorbed_runs(each.withColumnRenamed("spans", "_runs").join(df.select(key, F.length(text).alias("_n")), key), "_runs", "_n").select(key, "spans")
