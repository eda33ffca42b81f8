"""Deeply nested records as flat tables with parent-child links (problem 7).

A depth-first visitor walks each payload once and emits tagged rows: the tag of
a table, the row's key, its parent's key and a JSON payload.  All flat tables
come out of this one pass; each is its tag's rows with a schema applied to the
payload, so writing the rows partitioned by tag stores every table without
reading the records again, and reading one table reads its partition only.

Keys are paths of zero-based positions from the outermost node down.

Defined results for odd inputs: null, empty and invalid payloads, and payloads
that are no object, have no rows (NaN and Infinity are no valid JSON); an object
in place of an array counts as position 0; entries that are no object keep their
position but have no row; of a record delivered several times the row received
last counts (ties: the larger payload in text order); absent and null keys are
alike, except that a node's label list without labels gives one label ''.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.partitions import once, shared_dir, spread

#: Tables by tag, with the schema of their payload.
TABLES = {
    "document": "doc_id string, title string, place string, metadata string",
    "node": "node_id string, annotated int, source string, node_start bigint, node_end bigint, text string",
    "label": "label_no int, label string",
    "edge": "edge_id string, from_node_id string, to_node_id string, label string",
}


def _not_json(constant: str) -> None:
    raise ValueError(constant)


_DECODER = json.JSONDecoder(parse_constant=_not_json)


def _array(value: object) -> list:
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _whole(value: object) -> int | None:
    return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) < 2**62 else None


def _annotated(value: object) -> int:
    """1 for true, 0 for false, also as text in any case; -1 for anything else."""
    if isinstance(value, str):
        return {"true": 1, "false": 0}.get(value.strip().lower(), -1)
    return int(value) if isinstance(value, bool) else -1


def _labels(value: object) -> list[str]:
    """Labels as written; [''] if there are none."""
    listed = value if isinstance(value, list) else [value]
    return [_text(x) for x in listed if x is not None] or [""]


def visit(payload: str | None) -> Iterator[tuple[str, str, str, dict]]:
    """(tag, key, parent key, values) of all rows in one payload, parents before children."""
    if not payload:
        return
    try:
        record = _DECODER.decode(payload)
    except (ValueError, RecursionError):
        return
    if not isinstance(record, dict):
        return
    inner = record.get("document")
    inner = inner if isinstance(inner, dict) else {}
    place = "document" if _array(inner.get("nodes")) and not _array(record.get("nodes")) else "top"
    yield "document", "", "", {"doc_id": _text(record.get("doc_id")), "title": _text(inner.get("title")), "place": place, "metadata": _text(record.get("metadata"))}
    # an explicit stack, so that depth is not bounded; children are pushed in reverse to come out in order
    tops = _array(record.get("nodes")) or _array(inner.get("nodes"))
    stack = [(str(i), "", n) for i, n in reversed(list(enumerate(tops)))]
    while stack:
        path, parent, node = stack.pop()
        if not isinstance(node, dict):
            continue
        yield "node", path, parent, {"node_id": _text(node.get("id")) or "", "annotated": _annotated(node.get("annotation")), "source": _text(node.get("source")), "node_start": _whole(node.get("start")), "node_end": _whole(node.get("end")), "text": _text(node.get("text"))}
        for k, label in enumerate(_labels(node.get("label"))):
            yield "label", f"{path}#{k}", path, {"label_no": k, "label": label}
        stack += [(f"{path}/{i}", path, n) for i, n in reversed(list(enumerate(_array(node.get("children")))))]
    for i, edge in enumerate(_array(record.get("edges")) or _array(inner.get("edges"))):
        if isinstance(edge, dict):
            yield "edge", str(i), "", {"edge_id": _text(edge.get("id")), "from_node_id": _text(edge.get("from_node_id")), "to_node_id": _text(edge.get("to_node_id")), "label": _text(edge.get("label"))}


_ROWS = pa.schema([("tag", pa.string()), ("record_id", pa.int64()), ("key", pa.string()), ("parent_key", pa.string()), ("payload", pa.string())])
ROWS = "tag string, record_id bigint, key string, parent_key string, payload string"
#: Rows that the visitor hands on at a time.
_CHUNK = 20_000


def tagged_rows(records: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """(tag, record_id, key, parent_key, payload) of all records (record_id, payload, received_at), or of some tags only."""
    wanted = frozenset(tags or TABLES)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for record, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for tag, key, parent, values in visit(payload):
                    if tag in wanted:
                        out.append((tag, record, key, parent, json.dumps(values, ensure_ascii=False)))
                if len(out) >= _CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS)

    # only payloads of records that came several times are shuffled
    last = once(records.select("record_id", "payload", "received_at"), "record_id", [F.col("received_at"), F.col("payload")])
    return spread(last.select("record_id", "payload")).mapInArrow(emit, ROWS)


def table_of(rows: DataFrame, tag: str) -> DataFrame:
    """The flat table of one tag: record_id, key, parent_key and the columns of its schema."""
    return rows.where(F.col("tag") == tag).select("record_id", "key", "parent_key", F.from_json("payload", TABLES[tag]).alias("v")).select("record_id", "key", "parent_key", "v.*")


def write_tables(rows: DataFrame, path: str) -> None:
    """Stores the rows of all tables, partitioned by tag."""
    rows.write.mode("overwrite").partitionBy("tag").parquet(path)


def stored_tables(records: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """The flat tables by tag, written once and read back.

    Without a path they lie in a folder of their own in the shared folder.
    """
    spark = records.sparkSession
    path = path or f"{shared_dir(spark)}/nested-{uuid.uuid4().hex}"
    write_tables(tagged_rows(records), path)
    rows = spark.read.schema(ROWS).parquet(path)
    return {tag: table_of(rows, tag) for tag in TABLES}


def labelled_nodes(tables: dict[str, DataFrame]) -> DataFrame:
    """(record_id, parent_path, node_path, node_id, annotated, label): a row for each node and each of its labels, by the link from label to node."""
    nodes = tables["node"].select("record_id", F.col("key").alias("node_path"), F.col("parent_key").alias("parent_path"), "node_id", "annotated")
    labels = tables["label"].select("record_id", F.col("parent_key").alias("node_path"), "label")
    return nodes.join(labels, ["record_id", "node_path"]).select("record_id", "parent_path", "node_path", "node_id", "annotated", "label").distinct()
