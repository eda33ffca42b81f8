"""Sentence units of a table of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.sentences import sentence_spans
from spanloom.partitions import spread

_OUT = pa.schema([("rtrace_id", pa.string()), ("stored_at", pa.timestamp("us", tz="UTC")), ("ends", pa.list_(pa.int32()))])


def sentence_units(traces: DataFrame) -> DataFrame:
    """(rtrace_id, sent_start, sent_end) of every trace with an id.

    Texts are read where they lie; per trace only its packed offsets (start,
    end, start, end ...) are shuffled to settle repeated rows, of which the one
    stored last counts, and they are unpacked behind that.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.array(sentence_spans(t), dtype=np.int32).reshape(-1) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(2).cast(_OUT.field(1).type), pa.array(packed, _OUT.field(2).type)], schema=_OUT)

    rows = spread(traces.where("id IS NOT NULL AND rt IS NOT NULL").select("id", "rt", "stored_at"))
    packed = rows.mapInArrow(cut, "rtrace_id string, stored_at timestamp, ends array<int>")
    last = packed.groupBy("rtrace_id").agg(F.max_by("ends", F.struct("stored_at", "ends")).alias("ends"))
    pairs = F.expr("transform(sequence(0, size(ends) div 2 - 1), i -> struct(ends[2 * i] AS sent_start, ends[2 * i + 1] AS sent_end))")
    return last.where("size(ends) > 0").select("rtrace_id", F.inline(pairs))
