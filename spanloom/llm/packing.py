"""Filling fixed-capacity containers with texts (problem 8).

Harmonic packing: a text of s tokens belongs to the class k with
capacity/(k+1) < s <= capacity/k, and a container of class k takes k texts of
it, so a container never needs to be looked at again and each worker fills its
own containers alone, from its own texts.  Plain harmonic packing leaves up to
half of a container free, which the problem does not allow, so one step is
added: what room a container keeps after its k texts is filled with the largest
texts of the higher classes that fit.  Texts beyond the capacity are cut into
full containers and one remainder, which is packed like any other text.

Defined results for odd inputs: a null or empty text has no tokens, takes no
room and is placed in no container; repeated rows of one id count once when
``distinct_ids`` says ids may repeat; special tokens in a text are ordinary text;
without a capacity for the purpose nothing is filled.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.partitions import once, spread

#: Classes; the last one holds all smaller texts.
CLASSES = 8
#: Texts that a worker packs together (only their ids and sizes are kept).
WORKER_BLOCK = 200_000


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoder(path: str):  # noqa: ANN202
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters that are encoded at a time; longer texts are cut before a space, which no token crosses.
CHUNK = 200_000


def count_tokens(text: str | None, path: str) -> int:
    if not text:
        return 0
    encode = _encoder(path).encode_ordinary
    if len(text) <= CHUNK:
        return len(encode(text))
    total = at = 0
    while at < len(text):
        to = at + CHUNK
        if to < len(text):
            # before a space that stands between two characters that are none
            while to > at and not (text[to] == " " and not text[to - 1].isspace() and to + 1 < len(text) and not text[to + 1].isspace()):
                to -= 1
            to = to if to > at else at + CHUNK
        total += len(encode(text[at:to]))
        at = to
    return total


def pack(sizes: np.ndarray, capacity: int, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray, int]:
    """Container and position of each item of at most the capacity, and the number of containers."""
    container = np.full(len(sizes), -1, dtype=np.int64)
    position = np.full(len(sizes), -1, dtype=np.int32)
    order = np.argsort(sizes, kind="stable")
    keys: list[list[int]] = [[] for _ in range(classes + 1)]
    items: list[list[int]] = [[] for _ in range(classes + 1)]
    for i in order.tolist():
        s = int(sizes[i])
        if s > 0:
            k = min(classes, capacity // s)
            keys[k].append(s)
            items[k].append(i)
    n = 0
    for k in range(1, classes + 1):
        while items[k]:
            room, p = capacity, 0
            for _ in range(k):  # the class's own share
                if items[k] and keys[k][-1] <= room:
                    room -= keys[k].pop()
                    i = items[k].pop()
                    container[i], position[i], p = n, p, p + 1
            for j in range(min(k + 1, classes), classes + 1):  # the room that is left
                while items[j] and keys[j][0] <= room:
                    at = bisect_right(keys[j], room) - 1
                    room -= keys[j].pop(at)
                    i = items[j].pop(at)
                    container[i], position[i], p = n, p, p + 1
            n += 1
    return container, position, n


_FIELDS = [("container", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("position", pa.int32()), ("n_tokens", pa.int32())]
_OUT = pa.schema(_FIELDS)


def _filled(ids: np.ndarray, sizes: np.ndarray, capacity: int, worker: int, first: int) -> tuple[pa.RecordBatch, int]:
    """Containers of one worker's block; ids of containers are the worker's number and a count."""
    full = sizes // capacity
    rest = sizes - full * capacity
    whole = np.where(sizes > capacity, full, 0)
    rest = np.where(sizes > capacity, rest, sizes)
    container, position, n = pack(rest, capacity)
    kept = rest > 0
    cut_ids = np.repeat(ids, whole)
    cut_part = np.concatenate([np.arange(k) for k in whole]) if whole.any() else np.zeros(0, dtype=np.int64)
    base = (worker << 33) + first
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([base + container[kept], base + n + np.arange(len(cut_ids))]), pa.int64()),
            pa.array(np.concatenate([ids[kept], cut_ids]), pa.int64()),
            pa.array(np.concatenate([whole[kept], cut_part]), pa.int32()),
            pa.array(np.concatenate([position[kept], np.zeros(len(cut_ids), dtype=np.int64)]), pa.int32()),
            pa.array(np.concatenate([rest[kept], np.full(len(cut_ids), capacity)]), pa.int32()),
        ],
        schema=_OUT,
    )
    return batch, first + n + len(cut_ids)


def fill_containers(documents: DataFrame, limits: DataFrame, purpose: str = "doc_containers", tokenizer: str | None = None) -> DataFrame:
    """(container, doc_id, part, position, n_tokens): the filling of containers with all texts.

    ``part`` counts the pieces of a text beyond the capacity (0 for all others).
    Texts stay in the partitions they are read in; only those of ids that are
    counted to stand there several times are shuffled, and the longest one counts.
    """
    limit = limits.where(F.col("purpose") == purpose).select("capacity").orderBy("capacity").first()
    schema = "container bigint, doc_id bigint, part int, position int, n_tokens int"
    if limit is None or not limit["capacity"]:
        return documents.sparkSession.createDataFrame([], schema)
    capacity, path = int(limit["capacity"]), tokenizer or tokenizer_path()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, first = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0
        for b in batches:
            texts = b.column(1).to_pylist()
            ids.append(b.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False))
            sizes.append(np.fromiter((count_tokens(t, path) for t in texts), dtype=np.int64, count=len(texts)))
            held += len(texts)
            if held >= WORKER_BLOCK:
                out, first = _filled(np.concatenate(ids), np.concatenate(sizes), capacity, worker, first)
                yield out
                ids, sizes, held = [], [], 0
        if held:
            yield _filled(np.concatenate(ids), np.concatenate(sizes), capacity, worker, first)[0]

    rows = once(documents.select("doc_id", "text"), "doc_id", [F.length("text"), F.col("text")])
    return spread(rows).mapInArrow(fill, schema)
