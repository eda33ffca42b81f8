"""Evaluation texts leaking into training texts (problem 9).

A distributed positional inverted index answers which documents hold a passage
of a test item.  The first pass over the corpus counts in how many documents
each term of the items stands.  With these counts every stretch of ``BLOCK``
tokens of an item names its rarest terms as anchors.  The second pass stores the
postings (term, document, position) of the anchors, each together with the word
before or behind it (a next-word index), since a word of a passage that wasn't
replaced has at least one neighbour that wasn't either.  Joining the postings
with the items' anchors and adjusting by the offset intersects the posting lists
from the rarest terms on: a passage makes several hits of one document, one item
and one offset.  Offsets with at least two hits are then followed token by
token, with single replaced words allowed, and a passage that is long enough is
a leak (an exact phrase if nothing in it was replaced, else a proximity match).

No passage is missed for its anchors: a passage of 20 words holds a whole block
of 10 tokens, at most one word in ``MISMATCH`` of it is replaced and replaced
words stand apart, so of the block's four anchors and those beside it at least
two are found at the same offset, each in a pair of its own.

Only the items are ever sent to all workers.  They are measured first: more than
``ITEMS`` of them, or than ``ITEM_BYTES`` of text, are searched in blocks.  Stock
sentences are counted over all items, whatever block they fall into.  Tokens are compared
without letter case, spacing, line marks and punctuation.

Defined results for odd inputs: null and empty items and documents match
nothing; items of fewer words than a passage cannot leak; repeated items and
documents of one id count once; stock sentences (shared by ``STOCK`` items or
more) don't make a passage by themselves.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.sentences import sentence_spans
from spanloom.partitions import joined, shared_dir, spread

#: Least length of a passage: words, or characters in scripts without spaces.
WORDS, CHARACTERS = 20, 30
#: Tokens of an item that choose anchors together, and how many; for scripts without spaces, whose passages hold fewer tokens.
BLOCK, ANCHORS = 10, 4
DENSE_BLOCK, DENSE_ANCHORS = 5, 3
#: At most one token in so many of a passage is replaced, with at least APART matches between two replaced ones.
MISMATCH, APART = 7, 3
#: Tokens in a row that match somewhere in every passage: its replaced words and one line mark leave at least one such run.
RUN, DENSE_RUN = 5, 3
#: Tokens that are compared at a time.
CHUNK = 1 << 20
#: Tokens that line marks may put between two runs of a passage.
DRIFT = 2
#: Tokens of the item that a replaced word may have been, by how much the offset changes behind it; 0 is a line mark put in.
_GAPS = {-2: (3,), -1: (0, 1, 2, 3), 0: (1, 2, 3), 1: (0, 1, 2), 2: (0, 1)}
#: Items in which a sentence stands from which it is a stock sentence, and least words of a passage outside of them.
STOCK, OWN_WORDS = 3, 5
#: Items, and bytes of their texts, that are searched for at a time.
ITEMS, ITEM_BYTES = 5_000, 16 << 20
#: Tokens within which a document must hold two anchors to be kept in the index.
NEAR = 60

_DENSE = "぀-ヿ㐀-鿿฀-๿"
_TOKEN = re.compile(rf"[{_DENSE}]|[^\W_{_DENSE}]+")
_DENSE_CHAR = re.compile(rf"[{_DENSE}]")
_HIDDEN = re.compile("[­​-‏⁠﻿]")


def tokens(text: str) -> list[str]:
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    return _TOKEN.findall(text.lower())


class Item:
    """One test item: its token ids, the word each token belongs to, and which tokens stand in stock sentences."""

    __slots__ = ("characters", "dense", "ids", "item_id", "stock", "words")

    def __init__(self, item_id: int, text: str, terms: dict[str, int], stock: set[str]):
        text = _HIDDEN.sub("", text)
        self.item_id = item_id
        spans = [m.span() for m in _TOKEN.finditer(text.lower())] if len(text.lower()) == len(text) else []
        if not spans:
            spans = [m.span() for m in _TOKEN.finditer(text)]
        self.ids = np.array([terms.setdefault(text[s:e].lower(), len(terms)) for s, e in spans], dtype=np.int32)
        n_dense = len(_DENSE_CHAR.findall(text))
        self.dense = n_dense * 4 > len(text)
        word_of: list[int] = []
        word, last = -1, -1
        for s, _ in spans:
            if last < 0 or any(c.isspace() for c in text[last:s]):
                word += 1
            word_of.append(word)
            last = s
        self.words = np.array(word_of, dtype=np.int32)
        self.characters = [(len("".join(text[:s].split())), len("".join(text[:e].split()))) for s, e in spans]
        marked = np.zeros(len(spans), dtype=bool)
        for s, e in sentence_spans(text):
            if _plain(text[s:e]) in stock:
                marked |= np.array([s <= a < e for a, _ in spans], dtype=bool)
        self.stock = marked

    def long_enough(self, start: int, end: int) -> bool:
        """Whether tokens start..end - 1 make a passage."""
        own = len(set(self.words[start:end][~self.stock[start:end]].tolist()))
        if self.dense:
            return self.characters[end - 1][1] - self.characters[start][0] >= CHARACTERS and not self.stock[start:end].all()
        return int(self.words[end - 1] - self.words[start]) + 1 >= WORDS and own >= OWN_WORDS


def _plain(sentence: str) -> str:
    return " ".join(tokens(sentence))


def _sentences(text: str) -> set[str]:
    return {_plain(text[s:e]) for s, e in sentence_spans(text)} - {""}


def read_items(rows: list[tuple[int, str]], stock: dict[int, set[str]] | None = None) -> tuple[list[Item], dict[str, int]]:
    """The items and their terms; each item's stock sentences are counted over the rows if they aren't given."""
    if stock is None:
        shared: Counter[str] = Counter()
        for _, text in rows:
            shared.update(_sentences(text))
        common = {s for s, n in shared.items() if n >= STOCK}
        stock = {i: common for i, _ in rows}
    terms: dict[str, int] = {}
    return [Item(i, t, terms, stock.get(i, set())) for i, t in rows], terms


def choose_anchors(items: list[Item], df: np.ndarray) -> list[tuple[int, int, int]]:
    """(pair, item, position) of the rarest tokens of every block of every item.

    A pair is first token * number of terms + second token; the position is the first token's.
    """
    out = []
    for n, item in enumerate(items):
        block, anchors = (DENSE_BLOCK, DENSE_ANCHORS) if item.dense else (BLOCK, ANCHORS)
        firsts: set[int] = set()
        for start in range(0, len(item.ids), block):
            part = range(start, min(start + block, len(item.ids)))
            for p in sorted(part, key=lambda p: (df[item.ids[p]], p))[:anchors]:
                firsts |= {p - 1, p}
        out += [(int(item.ids[p]) * len(df) + int(item.ids[p + 1]), n, p) for p in sorted(firsts) if 0 <= p < len(item.ids) - 1]
    return out


def find_pairs(ids: np.ndarray, pairs: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (in the sorted pairs) and positions of the pairs that stand in a document."""
    if len(ids) < 2 or not len(pairs):
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)
    keys = ids[:-1].astype(np.int64) * terms + ids[1:]
    keys[(ids[:-1] < 0) | (ids[1:] < 0)] = -1
    at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
    pos = np.flatnonzero(pairs[at] == keys)
    return at[pos].astype(np.int32), pos.astype(np.int32)


def passages(item: Item, doc: np.ndarray, offsets: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, replaced) of item passages that stand in a document, along the given offsets."""
    runs = []
    m, n = len(item.ids), len(doc)
    offsets = sorted({o + d for o in offsets for d in range(-DRIFT, DRIFT + 1)})  # line marks may have moved a part of the passage
    for off in offsets:
        lo, hi = max(0, -off), min(m, n - off)
        if hi - lo < 2:
            continue
        same = item.ids[lo:hi] == doc[lo + off : hi + off]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        runs += [(lo + int(a), lo + int(b), off) for a, b in zip(edge[::2], edge[1::2]) if b - a >= 2]
    runs.sort()
    best: list[tuple[int, int, int]] = []
    # of every run, by its offset and end: its length, and for each start of a chain that ends with it the fewest replaced words
    chains: dict[tuple[int, int], tuple[int, dict[int, int]]] = {}
    for start, end, off in runs:
        least = {start: 0}
        for shift in range(-DRIFT, DRIFT + 1):
            for gap in _GAPS[shift]:
                before = chains.get((off - shift, start - gap))
                if before is None or gap > 1 and (item.dense or item.words[start - gap] != item.words[start - 1]):
                    continue  # a gap of several tokens must be one word, such as a number with decimals
                length, known = before
                for first, replaced in known.items():
                    if shift or length >= APART or first == start - gap - length:
                        least[first] = min(least.get(first, m), replaced + (gap > 0))
        chains[off, end] = end - start, least
        # a chain may hold a passage though its whole has too many replaced words
        best += [(first, end, replaced) for first, replaced in least.items() if replaced * MISMATCH <= end - first and item.long_enough(first, end)]
    return best


class Runs:
    """Looks for runs of matching tokens at many offsets of a document at once; items lie one behind the other in one array."""

    def __init__(self, items: list[Item]):
        self.size = np.array([len(i.ids) for i in items], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([np.zeros(0, dtype=np.int32), *(i.ids for i in items)])
        self.run = np.array([DENSE_RUN if i.dense else RUN for i in items], dtype=np.int64)

    def keep(self, doc: np.ndarray, item: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which of the (item, offset) candidates have a run."""
        out = np.zeros(len(item), dtype=bool)
        low = np.maximum(0, -off.astype(np.int64))
        shared = np.maximum(0, np.minimum(self.size[item], len(doc) - off) - low)  # tokens that the item and the document have at this offset
        block = (np.cumsum(shared) - shared) // CHUNK
        for k in np.unique(block):
            part = np.flatnonzero((block == k) & (shared > 0))
            if not len(part):
                continue
            n = shared[part]
            own = np.repeat(np.arange(len(part)), n)
            place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            at = place + low[part][own]
            same = doc[at + off[part][own]] == self.flat[at + self.first[item[part]][own]]
            seen = np.concatenate([[0], np.cumsum(same)])
            need = self.run[item[part]][own]
            end = np.arange(1, len(own) + 1)
            long = (place + 1 >= need) & (seen[end] - seen[np.maximum(end - need, 0)] == need)
            out[part] = np.bincount(own[long], minlength=len(part)) > 0
        return out


_COUNTS = pa.schema([("term", pa.int32()), ("n", pa.int64())])
_INDEX = pa.schema([("doc_id", pa.int64()), ("term", pa.list_(pa.int32())), ("pos", pa.list_(pa.int32())), ("tokens", pa.binary())])
_LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("words", pa.int32()), ("replaced", pa.int32())])


def _stock_sentences(items: DataFrame) -> DataFrame:
    """(item_id, stock): the stock sentences of each item that has any, counted over all items."""

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(i, s) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in _sentences(t)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([s for _, s in own], pa.string())], names=["item_id", "sentence"])

    every = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(sentences, "item_id bigint, sentence string")
    common = every.groupBy("sentence").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= STOCK).select("sentence")
    return joined(every, common, ["sentence"], F.col("item_id"), F.octet_length("sentence") + 32).groupBy("item_id").agg(F.collect_list("sentence").alias("stock"))


def _search(documents: DataFrame, rows: list[tuple[int, str]], stock: dict[int, set[str]]) -> DataFrame | None:
    spark = documents.sparkSession
    items, terms = read_items(rows, stock)
    if not terms:
        return None
    vocabulary = frozenset(terms)
    corpus = spread(documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                n.update(vocabulary.intersection(tokens(t)))
        yield pa.RecordBatch.from_arrays([pa.array([terms[w] for w in n], pa.int32()), pa.array(list(n.values()), pa.int64())], schema=_COUNTS)

    df = np.zeros(len(terms), dtype=np.int64)
    for r in corpus.select("text").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]  # one row for each term of the items

    anchors = choose_anchors(items, df)
    pairs = np.unique(np.array([a[0] for a in anchors], dtype=np.int64))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = terms.get
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([get(w, -1) for w in tokens(text)], dtype=np.int32)
                pair, pos = find_pairs(ids, pairs, len(terms))
                if len(pos) < 2 or (pos[1:] - pos[:-1]).min() > NEAR:
                    continue
                out[0].append(doc)
                out[1].append(pair)
                out[2].append(pos)
                out[3].append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _INDEX)], schema=_INDEX)

    postings = corpus.mapInArrow(index, "doc_id bigint, term array<int>, pos array<int>, tokens binary").persist()
    postings.count()  # both sides of the join below read the index; this makes it once
    listed = pd.DataFrame({"term": np.searchsorted(pairs, [a[0] for a in anchors]), "item": [a[1] for a in anchors], "item_pos": [a[2] for a in anchors]}).astype("int32")
    wanted = spark.createDataFrame(pa.Table.from_pandas(listed, preserve_index=False))
    hits = (
        postings.select("doc_id", F.explode(F.arrays_zip("term", "pos")).alias("p"))
        .select("doc_id", F.col("p.term").alias("term"), F.col("p.pos").alias("pos"))
        .join(F.broadcast(wanted), "term")  # at most ITEMS items of bounded length
        .groupBy("doc_id", "item", (F.col("pos") - F.col("item_pos")).alias("off"))
        .agg(F.count(F.lit(1)).alias("hits"))
        .where("hits >= 2")
    )
    # offsets of one document and item: at most as many as the document has tokens
    candidates = hits.groupBy("doc_id").agg(F.collect_list(F.struct("item", "off")).alias("candidates"))

    runs = Runs(items)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            found = b.column(1)
            first = found.offsets.to_numpy()
            item_of = found.values.field(0).to_numpy(zero_copy_only=False)
            offset_of = found.values.field(1).to_numpy(zero_copy_only=False)
            for row, (doc, packed) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                ids = np.frombuffer(packed, dtype=np.int32)
                own, off = item_of[first[row] : first[row + 1]], offset_of[first[row] : first[row + 1]]
                kept = runs.keep(ids, own, off)
                if not kept.any():
                    continue
                offsets: dict[int, list[int]] = defaultdict(list)
                for n, o in zip(own[kept].tolist(), off[kept].tolist()):
                    offsets[n].append(o)
                for n, offs in offsets.items():
                    item = items[n]
                    good = passages(item, ids, offs)
                    if good:
                        start, end, replaced = max(good, key=lambda p: (p[1] - p[0], -p[2]))
                        out[0].append(doc)
                        out[1].append(item.item_id)
                        out[2].append(int(item.words[end - 1] - item.words[start]) + 1)
                        out[3].append(replaced)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _LEAKS)], schema=_LEAKS)

    both = candidates.join(postings.select("doc_id", "tokens"), "doc_id").select("doc_id", "candidates", "tokens")
    found = both.mapInArrow(verify, "doc_id bigint, item_id bigint, words int, replaced int").checkpoint()  # small, and the index can go
    postings.unpersist()
    return found


def leaks(documents: DataFrame, items: DataFrame, block: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, words, replaced): the longest passage of each item in each document.

    ``words`` is its length and ``replaced`` how many of them the document
    replaces; 0 is an exact phrase.
    """
    known = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.max("text").alias("text"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shared_dir(documents.sparkSession)
    found = None
    parts = max(1, -(-size["n"] // block), -(-(size["bytes"] or 0) // ITEM_BYTES))
    marked = known.join(_stock_sentences(known), "item_id", "left").withColumn("_part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    for k in range(parts):
        rows = sorted((r["item_id"], r["text"], r["stock"] or ()) for r in marked.where(F.col("_part") == k).collect())
        one = _search(documents, [(i, t) for i, t, _ in rows], {i: set(s) for i, _, s in rows})
        if one is not None:
            found = one if found is None else found.unionByName(one)
    if found is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, words int, replaced int")
    # rows of repeated documents are settled; words and replaced words are of the same passage
    longest = F.max_by(F.struct("words", "replaced"), F.struct(F.col("words"), -F.col("replaced"))).alias("p")
    return found.groupBy("doc_id", "item_id").agg(longest).select("doc_id", "item_id", "p.words", "p.replaced")
