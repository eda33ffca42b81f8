"""Per-document text statistics and the texts that are no prose (problem 10).

Each document gets its statistics in one pass over its whole text (word count,
mean word length, symbol, digit and common-word shares, share of lines ending
in punctuation, and the shares of its letters that stand in lines of prose, of
lists, of tables and of junk).  Quantile sketches of every statistic, one per
language and one of all documents, merge partition by partition; from them each
value becomes a percentile band and a robust z-score, and come the limits of the
tails of every statistic.  The shares of prose, lists, tables and junk heap up at
both ends, so their tails begin in the valley between the heaps, the widest gap
between neighbouring quantiles, wherever it lies and however large the heaps are;
without a valley, as those of the other statistics, at a robust z-score.  A
document with its prose share in the low tail and a share of lists, tables or
junk in its high tail is named after the one that is furthest out.

Defined results for odd inputs: a null text counts as empty; an empty text has
zero counts and shares and is no kind; documents of a language with fewer than
``least`` documents, or of no known language, are held against the sketch of
all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.languages import STOPWORDS
from spanloom.partitions import spread

# --------------------------------------------------------------------------
# Words of menus; common words that also join terms of a list.
# --------------------------------------------------------------------------
MENU_WORDS = "home login logout register help menu search tags comments share print next previous contact sitemap privacy cookie cookies subscribe about sign forum archive top back download upload faq terms imprint profile settings follow"
JOINING_WORDS = "of and or de du des la le et y e und von der die das den del d l a in no"

COMMON = frozenset(w for words in STOPWORDS.values() for w in words.split())
#: Common words that terms of a list or table don't hold.
SENTENCE_WORDS = COMMON - frozenset(JOINING_WORDS.split()) | {"the", "it", "is", "that", "they", "he", "she", "his", "her", "than", "after", "before", "while", "und", "der", "die", "das"}
_MENU = frozenset(MENU_WORDS.split())

KINDS = ["prose", "list", "table", "junk"]
STATISTICS = ["words", "mean_word", "symbol_share", "digit_share", "common_share", "end_share", "repeat_share", "prose_share", "list_share", "table_share", "junk_share"]
#: Statistics that are shares of a text's parts.
PARTS = [f"{k}_share" for k in KINDS]
#: Robust z-score beyond which a value lies in a tail.
TAIL_Z = 3.5
#: Least spread of a statistic that a z-score divides by.
LEAST_SPREAD = 0.05
#: Least gap between neighbouring quantiles of a part's share that is a valley.
VALLEY = 0.2
#: A text of which more than this is prose isn't anything else in its main part, and a part beyond it is the main one.
MAIN_PART = 0.5
#: Size of the sketches, ranks at which they are read, and those of the percentile bands.
SKETCH_K = 400
RANKS = [i / 200 for i in range(201)]
LEVELS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]

_OWN = {lang: sorted(set(words.split()) - {w for other, ws in STOPWORDS.items() if other != lang for w in ws.split()}) for lang, words in STOPWORDS.items()}
_SCRIPT = re.compile(r"(?P<kana>[぀-ヿ]+)|(?P<han>[㐀-鿿]+)|(?P<cyr>[Ѐ-ӿ]+)|(?P<arab>[؀-ۿ]+)|(?P<deva>[ऀ-ॿ]+)|(?P<thai>[฀-๿]+)|(?P<hang>[가-힯]+)")
_SCRIPT_LANGUAGE = {"kana": "ja", "han": "zh", "cyr": "ru", "arab": "ar", "deva": "hi", "thai": "th", "hang": "ko"}
_WORD = re.compile(r"[^\W\d_]+")
_END_LINE = re.compile(r"[.!?。！？।؟۔…:;][\"'”’»)\]」』*]*\s*$", re.M)
_DAMAGED = re.compile(r"[�\x00-\x08\x0e-\x1f\x7f]")
_MISREAD = re.compile(r"[\x80-\xa6\xa8-\xaa\xac-\xaf\xb1\xb3-\xb6\xb8-\xba\xbc-\xbe]")
_NON_LATIN = re.compile(r"[Ͱ-ϿЀ-ӿ֐-ۿऀ-෿฀-๿぀-ヿ㐀-鿿가-힯]")
_BULLET = re.compile(r"\s*(?:\\?[-*+•–—‣◦·▪●]|\[[ xX✓]?\]|[\[(]?\d{1,4}[\]).]|[\[(]?[a-zA-Z][\])]|[a-zA-Z]\.)\s+\S")
_BULLET_STARTS = frozenset("\\-*+•–—‣◦·▪●[(0123456789") | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LEADER = re.compile(r"(?:\.\s?){4,}\s*\d+\s*$|…+\s*\d+\s*$")
_GLOSS = re.compile(r"\S\s+[–—-]\s+\S|\S:\s+\S")
_TABLE_TAG = re.compile(r"</?(?:table|tr|td|th|tbody|thead)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|&[a-z]+;|<!--.*?-->")
_LATEX = re.compile(r"\\\\\s*(?:\\hline)?\s*$|^\s*\\(?:begin|end|hline|toprule|midrule|bottomrule)\b")
_GAP = re.compile(r"(?<=\S)(?: {3,}|\t+)(?=\S)")
_WIDE = re.compile(r"(?<=\S)(?:  +|\t+)(?=\S)")
_KEY_VALUE = re.compile(r"(?:^|[\s,;{])\"?[\w.-]+\"?\s?(?:=|:)\s?\"?[^\s=:,;]+")
_TIGHT = re.compile(r"(?<=[\w.)%/-])[,;|](?=[\w.(\"'+%-])")
_HEX = re.compile(r"\s*(?:[0-9a-fA-F]{6,}:?\s+)?(?:[0-9a-fA-F]{2}\s+){6,}|\s*(?:\\x[0-9a-fA-F]{2}|%[0-9a-fA-F]{2}){4,}|\s*(?:[01]{8}\s*){3,}")
_THOUSANDS = re.compile(r"[-+]?\d{1,3},\d{3}\W*\Z")
_HEX_STARTS = frozenset("0123456789abcdefABCDEF\\%")
_BASE64 = re.compile(r"[A-Za-z0-9+/=_-]{32,}")
_FORMULA = re.compile(r"\$|\\[(\[a-zA-Z]|[\w)]\s*[=^]\s*[-\w(\\]|\d! / \d!")
_RULE = re.compile(r"(?:[-=_*~#+|:.\s$]|\\[\[\]()])+\Z|[-*•]\Z|`{3}\w*\Z")
_CAPTION = re.compile(r"\s*(?:table|tabelle|tableau|tabla|tab\.|figure)\s*\d+", re.I)


def _line_kind(line: str, flat: str, words: list[str], letters: int, sentence: int) -> str | None:
    """prose, list, table or junk; None for lines that tell nothing.

    flat is the line without outer space, words are its words in lower case,
    letters is their length in all and sentence is how many are SENTENCE_WORDS.
    """
    n = len(flat)
    w = len(words)
    if not flat.isascii():
        if ("�" in flat or _DAMAGED.search(flat)) and len(_DAMAGED.findall(flat)) * 5 > n:
            return "junk"
        if len(_MISREAD.findall(flat)) * 10 > n:
            return "junk"  # UTF-8 that was read as Latin-1
        if len(_NON_LATIN.findall(flat)) * 4 > n:
            if n < 80 and _BULLET.match(line) and not _END_LINE.search(flat):
                return "list"
            if flat.count("|") > 1 or "\t" in flat:
                return "table"
            return "prose"
    if "<" in flat:
        if _TABLE_TAG.search(flat):
            return "table"
        bare = _TAG.sub("", flat).strip()
        if len(bare) * 4 < n:
            return "junk"
    if flat[0] in _HEX_STARTS and _HEX.match(flat):
        return "junk"
    if w >= 8 and letters * 2 < w * 3 and flat.count(" ") * 9 >= n * 4:
        return "junk"  # single letters with spaces between them
    bullet = flat[0] in _BULLET_STARTS and bool(_BULLET.match(line))
    if w >= 4 and sentence and sentence * 12 >= w and not bullet and "&" not in flat:
        return "prose"
    if ("&" in flat or flat[0] == "\\") and _LATEX.search(line):
        return "table"
    tokens = flat.split()
    if not w and not any(map(str.isdigit, flat)) or sum(map(str.isalnum, flat)) * 8 < sum(map(len, tokens)):
        return None if _RULE.match(flat) else "junk"
    gaps = len(_GAP.findall(flat))
    leader = n < 400 and bool(_LEADER.search(flat))
    if len(tokens) >= 8 and not gaps and "|" not in flat and sum(len(t) == 1 for t in tokens) * 10 >= len(tokens) * 7 and letters * 3 > len(tokens):
        return "junk"
    menu = sum(x in _MENU for x in words)
    if w and menu * 2 >= w and menu >= 2:
        return "junk"
    if _CAPTION.match(flat):
        return None
    if bullet and w < 8 and _FORMULA.search(flat):
        return "list"
    if w >= 4 and sentence and sentence * 12 >= w and not bullet:
        return "prose"
    bars = flat.count("|")
    if bars >= 2 or bars and "---" in flat:
        return "table"
    if "\t" in flat:
        return "table"
    if gaps and not leader and len(tokens) <= 4 * (gaps + 1):
        return "table"
    if len(_KEY_VALUE.findall(flat)) >= 2 and not _FORMULA.search(flat[:12] if "= " in flat else ""):
        return "table"
    tight = len(_TIGHT.findall(flat))
    if tight >= 2 and len(tokens) <= 3 * (tight + 1) or tight == 1 and len(tokens) == 1 and not _THOUSANDS.match(flat):
        return "table"
    wide = len(_WIDE.findall(flat))
    if wide and not leader and w <= 3 * (wide + 1) and not bullet and sentence == 0 and wide >= 2:
        return "table"
    if letters * 3 < n and not bullet and n > 12 and not _FORMULA.search(flat):
        digits = sum(c.isdigit() for c in flat)
        if digits * 2 < n - letters:
            return None if leader else "junk"
    if letters + 2 * len(tokens) < n * 0.35 and n > 6 and not any(c.isdigit() for c in flat) and not _FORMULA.search(flat):
        return "junk"
    if bullet or leader:
        return "list"
    if _BASE64.search(flat) and not _FORMULA.search(flat) and max(map(len, tokens)) * 2 > n:
        return "junk"
    if w >= 10 and sentence * 25 < w:
        marks = flat.count(",") + flat.count(";") + flat.count("•") + flat.count("/")
        return "list" if marks * 5 >= w or _GLOSS.search(flat) else "junk"
    if _FORMULA.search(flat):
        return None
    if w >= 4 and flat[0].isupper() and flat[-1] in ".!?" and sum(map(COMMON.__contains__, words)) * 3 >= w and not bullet:
        return "prose"
    if w <= 9 and (sentence == 0 or sentence * 12 < w):
        return "list" if w else None
    return "prose" if sentence and w >= 3 else None


def language_of(text: str, counts: Counter[str]) -> str:
    """Language of a text by script and stopwords; und if nothing tells."""
    if not text.isascii():
        n = {m: 0 for m in _SCRIPT_LANGUAGE}
        for m in _SCRIPT.finditer(text):
            n[m.lastgroup] += len(m.group())
        total = sum(n.values())
        if total * 4 > len(text):
            if n["kana"]:
                return "ja"
            return _SCRIPT_LANGUAGE[max(n, key=lambda k: (n[k], k))]
    votes = {lang: sum(map(counts.get, own, repeat(0))) for lang, own in _OWN.items()}
    best = max(votes, key=lambda k: (votes[k], k))
    return best if votes[best] else "und"


def statistics(text: str | None) -> tuple:
    """Language and values of STATISTICS for one text."""
    if not text:
        return ("und", 0) + (0.0,) * (len(STATISTICS) - 1)
    n = len(text)
    digits = sum(map(text.count, "0123456789"))
    spaces = n - sum(map(len, text.split()))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    ends = len(_END_LINE.findall(text))
    weights = dict.fromkeys(KINDS, 0)
    seen: set[str] = set()
    repeated = w = letters = 0
    counts: Counter[str] = Counter()
    for line in lines:
        flat = line.strip()
        words = _WORD.findall(flat.lower())
        w += len(words)
        here = sum(map(len, words))
        letters += here
        counts.update(words)
        if flat in seen:
            repeated += len(flat)
        seen.add(flat)
        kind = _line_kind(line, flat, words, here, sum(map(SENTENCE_WORDS.__contains__, words)))
        if kind:
            weights[kind] += len(flat)
    if repeated * 2 > n - spaces and len(lines) > 3 and weights["prose"] * 2 < sum(weights.values()):
        weights = dict.fromkeys(KINDS, 0) | {"junk": 1}  # the same few lines over and over
    total = sum(weights.values())
    return (
        language_of(text, counts),
        w,
        letters / w if w else 0.0,
        max(0, n - letters - digits - spaces) / n,
        digits / n,
        sum(map(counts.get, COMMON, repeat(0))) / w if w else 0.0,
        min(1.0, ends / len(lines)) if lines else 0.0,
        min(1.0, repeated / n),
        *(weights[k] / total if total else 0.0 for k in KINDS),
    )


# -- operator -----------------------------------------------------------------
_OUT = pa.schema([("doc_id", pa.int64()), ("language", pa.string()), ("words", pa.int32()), *((s, pa.float64()) for s in STATISTICS[1:])])


def document_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, language, the STATISTICS) of every document with an id."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t) for t in b.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(_OUT.names[1:])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(_OUT)[1:]))], schema=_OUT)

    schema = "doc_id bigint, language string, words int, " + ", ".join(f"{s} double" for s in STATISTICS[1:])
    return spread(documents.where("doc_id IS NOT NULL").select("doc_id", "text")).mapInArrow(measure, schema)


def sketches(stats: DataFrame) -> DataFrame:
    """One row per language with its number of documents and a quantile sketch (KLL) of each statistic."""
    return stats.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(F.col(s).cast("double"), F.lit(SKETCH_K)).alias(s) for s in STATISTICS))


def quantile_table(stats: DataFrame, least: int = 200) -> DataFrame:
    """(language, n, few, q_<statistic>) for every language, quantiles at RANKS, and a row of all documents with language null.

    The sketches of all languages merge into the one of the whole corpus.
    ``few`` marks languages of fewer than ``least`` documents, and documents
    without a known language, which are held against the whole corpus.
    """
    own = stats.sparkSession.createDataFrame(sketches(stats).toArrow())  # a row of sketches of fixed size for each of the known languages
    whole = own.agg(F.lit(None).cast("string").alias("language"), F.sum("n").alias("n"), *(F.kll_merge_agg_double(s).alias(s) for s in STATISTICS)).where("n > 0")
    ranks = F.array(*map(F.lit, RANKS))
    few = F.coalesce((F.col("n") < least) | (F.col("language") == "und"), F.lit(False))
    return own.unionByName(whole).select("language", "n", few.alias("few"), *(F.kll_sketch_get_quantile_double(s, ranks).alias(f"q_{s}") for s in STATISTICS))


def valley(q: list[float]) -> float | None:
    """The middle of the widest gap between neighbouring quantiles, None if no gap is wide."""
    gaps = [b - a for a, b in zip(q, q[1:])]
    widest = max(gaps)
    at = gaps.index(widest)
    return (q[at] + q[at + 1]) / 2 if widest >= VALLEY else None


def centre_and_spread(s: str, q: list[float]) -> tuple[float, float]:
    """Median of a statistic and its interquartile range as a deviation, from its quantiles."""
    middle, low, high = (q[RANKS.index(r)] for r in (0.5, 0.25, 0.75))
    floor = LEAST_SPREAD if s.endswith("share") else max(LEAST_SPREAD, abs(middle) * LEAST_SPREAD)
    return middle, max((high - low) * 0.7413, floor)


def tail_limits(s: str, own: list[float], whole: list[float]) -> tuple[float, float]:
    """Values of a statistic at which its low and its high tail begin, from the quantiles of a language and of the corpus."""
    centre, spread_ = centre_and_spread(s, own)
    low, high = centre - TAIL_Z * spread_, centre + TAIL_Z * spread_
    if s not in PARTS:
        return low, high
    gap = valley(own)
    gap = valley(whole) if gap is None else gap
    if s == "prose_share":
        # where hardly any text is prose, no text is out of the ordinary, but none is prose either
        return min(MAIN_PART, gap if gap is not None else low if centre > MAIN_PART else MAIN_PART), high
    return low, min(MAIN_PART, gap if gap is not None else high)


def _limits(stats: DataFrame, least: int) -> DataFrame:
    """(language, l_<statistic> of centre, spread, low, high and the quantiles at LEVELS): one row for each known language."""
    table = quantile_table(stats, least).collect()  # a row for each of the known languages and one of all
    whole = next((r for r in table if r["language"] is None), None)
    rows = []
    for r in table:
        if r["language"] is not None:
            used = whole if r["few"] else r
            parts = []
            for s in STATISTICS:
                q = list(used[f"q_{s}"])
                low, high = tail_limits(s, q, list(whole[f"q_{s}"]))
                parts.append((*centre_and_spread(s, q), low, high, [q[RANKS.index(x)] for x in LEVELS]))
            rows.append((r["language"], *parts))
    kind = "struct<centre:double,spread:double,low:double,high:double,levels:array<double>>"
    return stats.sparkSession.createDataFrame(rows, "language string, " + ", ".join(f"l_{s} {kind}" for s in STATISTICS))


def scored_statistics(documents: DataFrame, least: int = 200) -> DataFrame:
    """document_statistics with z_<statistic>, a robust z-score, and band_<statistic>, how many of LEVELS lie at or below the value, and ``tails``, the statistics whose value lies in a tail."""
    stats = document_statistics(documents).persist()
    scored = stats.join(F.broadcast(_limits(stats, least)), "language")  # a row for each of the known languages
    out = [F.when((F.col(s) < F.col(f"l_{s}.low")) | (F.col(s) > F.col(f"l_{s}.high")), F.lit(s)) for s in STATISTICS]
    beyond = [F.struct(((F.col(f"{k}_share") - F.col(f"l_{k}_share.high")) / (1 - F.col(f"l_{k}_share.high"))).alias("by"), F.lit(k).alias("kind")) for k in KINDS if k != "prose"]
    return scored.select(
        *stats.columns,
        *(((F.col(s) - F.col(f"l_{s}.centre")) / F.col(f"l_{s}.spread")).alias(f"z_{s}") for s in STATISTICS),
        *(F.expr(f"size(filter(l_{s}.levels, q -> q <= {s})) AS band_{s}") for s in STATISTICS),
        F.array_compact(F.array(*out)).alias("tails"),
        F.when((F.col("prose_share") < F.col("l_prose_share.low")) & (F.greatest(*beyond)["by"] > 0), F.greatest(*beyond)["kind"]).alias("kind"),
    )


def no_prose(documents: DataFrame, least: int = 200) -> DataFrame:
    """(doc_id, kind) of documents that are a list, a table or junk in their main part.

    Those are the ones with the prose share in its low tail and a share of lists,
    tables or junk in its high tail, named after the one furthest out.
    """
    return scored_statistics(documents, least).where("kind IS NOT NULL").select("doc_id", "kind").distinct()
