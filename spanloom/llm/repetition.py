"""Repetition inside a single document (problem 4).

Statistics of each text (shares of its letters in passages that repeat earlier
passages, measured with windows of 4, 8 and 14 tokens, in sentences, lines and
paragraphs, how well it compresses, how many tokens are distinct) are scored by
gradient-boosted trees.  The trees are trained here, on a bounded sample of the
corpus: passages of sampled texts are repeated, with other letter case, spacing
and numbers, until a known share of the text is repetition, and the trees learn
whether that share is at least ``SHARE``.  Scores never fall as a share of
repetition grows, nor as the share of distinct tokens falls (monotonic
constraints).  The fitted trees are flattened into numpy node arrays and score
whole batches at once; a text is repetitive if its score says that this is more
likely than not.

Letter case, spacing and numbers never matter: tokens are case-folded words,
single letters of scripts without spaces, punctuation, and one token for every
number.

Defined results for odd inputs: null and empty texts have share 0; texts of
fewer tokens than a window have share 0 for it; an empty corpus trains on
made-up texts; repeated rows of one id count once.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.partitions import spread

FEATURES = ["gram4", "gram8", "gram14", "sentences", "lines", "paragraphs", "compressed", "distinct", "tokens"]
#: Direction in which each feature may move the score: 1 up, -1 down, 0 free.
MONOTONE = [1, 1, 1, 1, 1, 1, -1, -1, 0]
#: Share of a text's letters from which it counts as repetitive.
SHARE = 0.4
#: Score from which a text counts as repetitive.
DECISION = 0.5
#: Most texts that the trees are trained on, and most characters of such a text.
SAMPLE_TEXTS, SAMPLE_CHARS = 200, 20_000

_DENSE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}"
_TOKEN = regex.compile(rf"[{_DENSE}]|\d+(?:[.,/:]\d+)*|[^\W\d_{_DENSE}]+|[^\w\s]", regex.V0)
_ASCII_TOKEN = re.compile(r"\d+(?:[.,/:]\d+)*|[^\W\d_]+|[^\w\s]", re.ASCII)  # the same for texts of these letters alone
_SENTENCE = re.compile(r"(?<=[.!?。！？।؟])\s+|(?<=[。！？])|\n+")
_NUMBER = re.compile(r"[-−]?\d+(?:[.,/:]\d+)*")
_P = np.uint64(0x9E3779B97F4A7C15)
_POWER = {b: np.uint64(pow(int(_P), b, 1 << 64)) for b in (1, 2, 4, 6)}
#: An array of no windows, for texts of fewer tokens.
_NONE = np.zeros(0, dtype=np.uint64)


def _window_hashes(ids: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all windows of 4, 8 and 14 tokens, each put together from two shorter ones."""
    known = {1: ids}
    for k, a in ((2, 1), (4, 2), (6, 4), (8, 4), (14, 8)):
        b = k - a
        n = len(ids) - k + 1
        if n < 2:
            break
        known[k] = known[a][:n] * _POWER[b] + known[b][a : a + n]
    return known


def _hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k tokens."""
    n = max(0, len(ids) - k + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * _P + ids[j : j + n]
    return h


def _repeat_mask(h: np.ndarray, k: int) -> np.ndarray | None:
    """Tokens that lie in a window of k tokens that stood earlier in the text, from the windows' hashes."""
    n = len(h)
    if n < 2:
        return None
    order = np.argsort(h, kind="stable")
    s = h[order]
    again = np.zeros(n, dtype=bool)
    again[order[1:]] = s[1:] == s[:-1]
    edge = np.zeros(n + k, dtype=np.int32)
    edge[:n] += again
    edge[k : k + n] -= again
    return np.cumsum(edge[:-1]) > 0


def _shares(low: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a text without letter case, one for all numbers, and the letters of each token."""
    tokens = (_ASCII_TOKEN if low.isascii() else _TOKEN).findall(low)
    ids = {t: 0 if t[0].isdigit() else n for n, t in enumerate(dict.fromkeys(tokens), 1)}
    size = len(tokens)
    return np.fromiter(map(ids.__getitem__, tokens), dtype=np.uint64, count=size), np.fromiter(map(len, tokens), dtype=np.int64, count=size)


def _window_share(h: np.ndarray, weight: np.ndarray, k: int) -> float:
    mask = _repeat_mask(h, k)
    return float(weight[mask].sum() / weight.sum()) if mask is not None else 0.0


def repeated_share(text: str | None, k: int = 8) -> float:
    """Share of the letters in passages of k tokens or more that repeat earlier ones."""
    if not text:
        return 0.0
    ids, weight = _shares(text.casefold())
    return _window_share(_hashes(ids, k), weight, k)


def _part_share(parts: list[str]) -> float:
    """Share of the letters of parts that stood earlier, up to spacing."""
    seen: set[str] = set()
    total = repeated = 0
    for p in parts:
        p = " ".join(p.split())
        total += len(p)
        if p in seen:
            repeated += len(p)
        elif p:
            seen.add(p)
    return repeated / total if total else 0.0


def features(text: str | None) -> list[float]:
    """The values of FEATURES for one text."""
    if not text or not text.strip():
        return [0.0] * 6 + [1.0, 1.0, 0.0]
    low = text.casefold()
    ids, weight = _shares(low)
    h = _window_hashes(ids)
    flat = _NUMBER.sub("0", low)
    raw = flat.encode("utf-8", "surrogatepass")
    return [
        *(_window_share(h.get(k, _NONE), weight, k) for k in (4, 8, 14)),
        *(_part_share(parts) for parts in (_SENTENCE.split(flat), flat.split("\n"), flat.split("\n\n"))),
        min(1.5, len(zlib.compress(raw, 1)) / len(raw)),
        len(np.unique(ids)) / len(ids) if len(ids) else 1.0,
        math.log1p(len(ids)),
    ]


# -- trees ------------------------------------------------------------------
@dataclass
class Trees:
    """Boosted trees as node arrays; a leaf has feature -1 and its value."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of x, all rows and trees at once."""
        if not len(x):
            return np.zeros(0)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            inner = f >= 0
            right = x[rows, np.where(inner, f, 0)] > self.threshold[at]
            at = np.where(inner, np.where(right, self.right[at], self.left[at]), at)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0, least: float = 4.0) -> Trees:
    """Newton boosting of the logistic loss over quantile bins.

    A split on a constrained feature is taken only if its two values run in the
    allowed direction, and the subtrees stay on their sides of the middle, so
    the sum of trees is monotone in every constrained feature.
    """
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
    p0 = min(max(float(y.mean()), 0.01), 0.99)
    base = math.log(p0 / (1 - p0))
    margin = np.full(n, base)
    nodes: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "value": []}
    roots = []

    def add() -> int:
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", 0), ("right", 0), ("value", 0.0)):
            nodes[k].append(v)
        return len(nodes["feature"]) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left_depth: int, low: float, high: float) -> int:
        at = add()
        gs, hs = g[rows].sum(), h[rows].sum()
        own = min(max(-gs / (hs + l2), low), high)
        best = None
        if left_depth and len(rows) >= 2 * least:
            for j in range(m):
                if not len(cuts[j]):
                    continue
                b = binned[rows, j]
                gb = np.cumsum(np.bincount(b, weights=g[rows], minlength=len(cuts[j]) + 1))[:-1]
                hb = np.cumsum(np.bincount(b, weights=h[rows], minlength=len(cuts[j]) + 1))[:-1]
                nb = np.cumsum(np.bincount(b, minlength=len(cuts[j]) + 1))[:-1]
                vl, vr = np.clip(-gb / (hb + l2), low, high), np.clip(-(gs - gb) / (hs - hb + l2), low, high)
                gain = gb**2 / (hb + l2) + (gs - gb) ** 2 / (hs - hb + l2) - gs**2 / (hs + l2)
                ok = (nb >= least) & (len(rows) - nb >= least)
                if monotone[j]:
                    ok &= (vr - vl) * monotone[j] >= 0
                gain = np.where(ok, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], j, k, vl[k], vr[k])
        if best is None:
            nodes["value"][at] = rate * own
            return at
        _, j, k, vl, vr = best
        side = binned[rows, j] > k
        middle = (vl + vr) / 2
        bounds = ((low, high), (low, high))
        if monotone[j] > 0:
            bounds = ((low, middle), (middle, high))
        elif monotone[j] < 0:
            bounds = ((middle, high), (low, middle))
        nodes["feature"][at], nodes["threshold"][at] = j, float(cuts[j][k])
        nodes["left"][at] = grow(rows[~side], g, h, left_depth - 1, *bounds[0])
        nodes["right"][at] = grow(rows[side], g, h, left_depth - 1, *bounds[1])
        return at

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), depth, -np.inf, np.inf))
        one = Trees(np.array(roots[-1:]), *(np.array(nodes[k]) for k in ("feature", "threshold", "left", "right", "value")), 0.0, depth)
        at = np.full(n, roots[-1])
        for _ in range(depth):
            f = one.feature[at]
            right = x[np.arange(n), np.where(f >= 0, f, 0)] > one.threshold[at]
            at = np.where(f >= 0, np.where(right, one.right[at], one.left[at]), at)
        margin = margin + one.value[at]
    return Trees(np.array(roots), *(np.array(nodes[k]) for k in ("feature", "threshold", "left", "right", "value")), base, depth)


# -- training texts -----------------------------------------------------------
def _made_up(rng: random.Random) -> str:
    words = ["".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(5, 18))).capitalize() + "." for _ in range(rng.randint(5, 30)))


def _repeat(base: list[str], share: float, rng: random.Random) -> tuple[str, float]:
    """A text in which about this share of letters repeats earlier passages, and the share."""
    size = rng.choice([1, 1, 2, 3, 5])
    start = rng.randrange(len(base))
    passage = base[start : start + size]
    rest = sum(map(len, base))
    length = max(1, sum(map(len, passage)))
    times = round(share * rest / ((1 - share) * length)) if share else 0
    joint = rng.choice([" ", "\n\n", "\n", "  "])
    copies = []
    for _ in range(times):
        units = [_NUMBER.sub(lambda _: str(rng.randint(1, 9999)), u) if rng.random() < 0.3 else u for u in passage]
        copies.append(joint.join(u.upper() if rng.random() < 0.1 else u for u in units))
    if times and rng.random() < 0.5:  # scattered through the text, else in one run
        spots = sorted(rng.randrange(start + len(passage), len(base) + 1) if start + len(passage) <= len(base) else len(base) for _ in copies)
        out: list[str] = []
        k = 0
        for i, u in enumerate([*base, None]):
            while k < len(spots) and spots[k] == i:
                out.append(copies[k])
                k += 1
            if u is not None:
                out.append(u)
    else:
        at = start + len(passage)
        out = [*base[:at], *copies, *base[at:]]
    added = sum(map(len, copies))
    return joint.join(out), added / (added + rest) if added + rest else 0.0


def train(texts: list[str], seed: int = 7) -> Trees:
    """Trees from texts with repetition put in."""
    rng = random.Random(seed)
    bases = [t for t in texts if t and len(t) > 120 and repeated_share(t) < 0.15]
    bases += [_made_up(rng) for _ in range(max(20, 60 - len(bases)))]
    x, y = [], []
    for t in bases:
        units = [u for u in _SENTENCE.split(t) if u.strip()]
        if len(units) < 3:
            continue
        for share in (0.0, rng.uniform(0.05, 0.3), rng.uniform(0.3, 0.5), rng.uniform(0.5, 0.9)):
            text, got = _repeat(units, share, rng)
            x.append(features(text))
            y.append(float(got >= SHARE))
    return fit_trees(np.array(x), np.array(y), MONOTONE)


# -- operator -----------------------------------------------------------------
_OUT = pa.schema([("rtrace_id", pa.string()), ("score", pa.float64()), ("share", pa.float64()), ("stored_at", pa.timestamp("us", tz="UTC"))])


def repetition(traces: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(rtrace_id, score, share) of every trace.

    ``score`` is the trees' probability that at least ``SHARE`` of the text is
    repetition; ``share`` is what windows of 8 tokens measure.  The trees are
    trained on at most ``sample_texts`` texts of at most ``sample_chars``
    characters, those whose ids have the smallest hashes, so any run over the
    same rows trains the same trees.  Both bounds limit the training alone: every
    text of any length is scored whole.
    """
    rows = traces.where("id IS NOT NULL").select("id", "rt", "stored_at")
    sample = rows.where(F.length("rt") <= sample_chars).select("rt", F.xxhash64("id").alias("h")).orderBy("h", "rt").limit(sample_texts)
    trees = train(list(dict.fromkeys(r["rt"] for r in sample.collect())))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(trees.score(x)), pa.array(x[:, 1]), b.column(2).cast(_OUT.field(3).type)], schema=_OUT)

    out = spread(rows).mapInArrow(scored, "rtrace_id string, score double, share double, stored_at timestamp")
    last = out.groupBy("rtrace_id").agg(F.max(F.struct("stored_at", "share", "score")).alias("r"))
    return last.select("rtrace_id", "r.score", "r.share")


def repetitive(traces: DataFrame, decision: float = DECISION) -> DataFrame:
    """(rtrace_id) of traces of which at least ``SHARE`` is repetition, as the trees decide."""
    return repetition(traces).where(F.col("score") >= decision).select("rtrace_id")
