"""Splitting oversized texts at natural boundaries (problem 3).

Lexical cohesion decides where a text is cut: at every sentence boundary the
words of the units before it are compared with those of the units after it
(cosine of the counts), the depth of a valley is how far the similarity lies
below the peaks on either side, and of the boundaries a piece may end at the
deepest valley is taken.  Where a text has no sentence boundary the cut goes to
white space, and into a stretch only if it has neither.  Every piece but the
first begins ``overlap`` characters before the end of the one before it.

Defined results for odd inputs: a null or empty text has no pieces; a text
within the limit is one piece; pieces never exceed the limit and together cover
the whole text; an overlap of half the limit or more is refused; without a limit
for the purpose nothing is split.  Repeated rows of one id count once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.sentences import sentence_spans
from spanloom.partitions import spread

#: Units on each side of a boundary whose words are compared.
BLOCK = 6
END_MARKS = ".!?。！？।؟"

_DENSE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}"
_WORD = regex.compile(rf"[{_DENSE}]|[^\W\d_{_DENSE}]+", regex.V0)
_SPACE = regex.compile(r"\s+")


_ENDS = regex.compile(rf"[\s{END_MARKS}]")
_ENDS_BEFORE = regex.compile(rf"(?r)[\s{END_MARKS}]")


def is_forced(text: str, cuts: list[tuple[int, int, str]], capacity: int) -> bool:
    """Whether a cut fell into a stretch beyond the limit without white space and end marks.

    A text that holds such a stretch always has one: no piece can hold the whole
    stretch, so some piece ends inside of it, where there is neither a sentence
    boundary nor white space to cut at.  A cut may also be forced on a shorter
    stretch, by the overlap before it; that doesn't count.
    """
    for _, cut, kind in cuts:
        if kind == "hard":
            before = _ENDS_BEFORE.search(text, 0, cut)
            behind = _ENDS.search(text, cut)
            if (behind.start() if behind else len(text)) - (before.end() if before else 0) > capacity:
                return True
    return False


def valley_depths(units: list[list[str]], block: int = BLOCK) -> list[float]:
    """Depth of the valley at each boundary between units; item i is the boundary before unit i + 1."""
    n = len(units)
    if n < 2:
        return []
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    dot = l2 = r2 = 0

    def put(side: dict[str, int], other: dict[str, int], words: list[str], by: int) -> tuple[int, int]:
        d = sq = 0
        for w in words:
            c = side.get(w, 0)
            sq += 2 * by * c + 1
            d += by * other.get(w, 0)
            side[w] = c + by
        return d, sq

    def change(which: str, words: list[str], by: int) -> None:
        nonlocal dot, l2, r2
        if which == "l":
            d, s = put(left, right, words, by)
            l2 += s
        else:
            d, s = put(right, left, words, by)
            r2 += s
        dot += d

    for u in units[1 : 1 + block]:
        change("r", u, 1)
    change("l", units[0], 1)
    similar = []
    for b in range(1, n):
        similar.append(dot / (l2 * r2) ** 0.5 if l2 and r2 else 0.0)
        if b == n - 1:
            break
        change("r", units[b], -1)
        change("l", units[b], 1)
        if b - block >= 0:
            change("l", units[b - block], -1)
        if b + block < n:
            change("r", units[b + block], 1)
    m = len(similar)
    peak_left, peak_right = similar[:], similar[:]
    for i in range(1, m):  # the nearest peak on the way up
        if similar[i - 1] >= similar[i]:
            peak_left[i] = peak_left[i - 1]
    for i in range(m - 2, -1, -1):
        if similar[i + 1] >= similar[i]:
            peak_right[i] = peak_right[i + 1]
    return [peak_left[i] + peak_right[i] - 2 * similar[i] for i in range(m)]


def pieces(text: str | None, capacity: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, cut) of each piece; cut says what the piece ends at: valley, space, hard or end."""
    if not 0 <= overlap * 2 < capacity:
        raise ValueError("the overlap must be less than half the limit")
    if not text:
        return []
    n = len(text)
    if n <= capacity:
        return [(0, n, "end")]
    spans = sentence_spans(text)
    starts = [s for s, _ in spans][1:]
    depths = valley_depths([_WORD.findall(text[s:e].casefold()) for s, e in spans])
    out = []
    start = 0
    while n - start > capacity:
        cut, kind = 0, ""
        for low in (start + capacity // 2, start + overlap + 1):
            i, j = bisect_left(starts, low), bisect_right(starts, start + capacity)
            if i < j:
                best = max(range(i, j), key=lambda k: (round(depths[k], 9), starts[k]))
                cut, kind = starts[best], "valley"
                break
        if not cut:
            spaces = [m.end() for m in _SPACE.finditer(text, start + overlap + 1, start + capacity) if m.end() > start + overlap]
            if spaces:
                cut, kind = spaces[-1], "space"
            else:
                cut, kind = start + capacity, "hard"
        out.append((start, cut, kind))
        start = cut - overlap
    out.append((start, n, "end"))
    return out


_OUT = pa.schema([("rtrace_id", pa.string()), ("pieces", pa.list_(pa.struct([("piece_start", pa.int32()), ("piece_end", pa.int32()), ("cut", pa.string())]))), ("n_chars", pa.int32()), ("forced", pa.int32()), ("stored_at", pa.timestamp("us", tz="UTC"))])


def split_traces(traces: DataFrame, limits: DataFrame, purpose: str = "rt_pieces") -> DataFrame:
    """(rtrace_id, n_chars, forced, pieces) of every trace with a text beyond the limit.

    The limit and overlap come from ``limits`` (purpose, capacity, overlap).
    ``pieces`` is an array of (piece_start, piece_end, cut); ``forced`` is 1 if
    a cut fell into a stretch beyond the limit without white space and end marks.
    """
    limit = limits.where(F.col("purpose") == purpose).select("capacity", "overlap").orderBy("capacity").first()
    schema = "rtrace_id string, n_chars int, forced int, pieces array<struct<piece_start:int,piece_end:int,cut:string>>"
    if limit is None or limit["capacity"] is None:
        return traces.sparkSession.createDataFrame([], schema)
    capacity, overlap = int(limit["capacity"]), int(limit["overlap"] or 0)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            made = [pieces(t, capacity, overlap) for t in texts]
            cut = [[dict(zip(("piece_start", "piece_end", "cut"), p)) for p in ps] for ps in made]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.string()), pa.array(cut, _OUT.field(1).type), pa.array([len(t) for t in texts], pa.int32()), pa.array([int(is_forced(t, ps, capacity)) for t, ps in zip(texts, made)], pa.int32()), b.column(2).cast(_OUT.field(4).type)],
                schema=_OUT,
            )

    long = traces.where(F.col("id").isNotNull() & (F.length("rt") > capacity)).select("id", "rt", "stored_at")
    out = spread(long).mapInArrow(split, "rtrace_id string, pieces array<struct<piece_start:int,piece_end:int,cut:string>>, n_chars int, forced int, stored_at timestamp")
    last = out.groupBy("rtrace_id").agg(F.max_by(F.struct("n_chars", "forced", "pieces"), F.struct(F.col("stored_at"), F.col("n_chars"))).alias("r"))
    return last.select("rtrace_id", "r.n_chars", "r.forced", "r.pieces")
