"""Queries of the general operators: intervals and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import intervals, nested
from spanloom.tables import read


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Covered periods and gaps of every gold text."""
    return intervals.coverage(read(spark, d, "rf_doc"), read(spark, d, "reasoning_flow_gold"), read(spark, d, "rtrace"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes at any depth with each of their labels."""
    return nested.labelled_nodes(nested.stored_tables(read(spark, d, "rf_raw")))


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of records, and where their nodes stood."""
    return nested.stored_tables(read(spark, d, "rf_raw"))["document"].select("record_id", "doc_id", "place")


def p7_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of nodes with the link to their parents."""
    return nested.stored_tables(read(spark, d, "rf_raw"))["node"].select("record_id", F.col("key").alias("node_path"), F.col("parent_key").alias("parent_path"), "node_id", "annotated", "source")


def p7_labels(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of labels with the link to their nodes."""
    return nested.stored_tables(read(spark, d, "rf_raw"))["label"].select("record_id", F.col("parent_key").alias("node_path"), "label_no", "label")


def p7_edges(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of edges."""
    return nested.stored_tables(read(spark, d, "rf_raw"))["edge"].select("record_id", F.col("key").cast("int").alias("edge_no"), "from_node_id", "to_node_id", "label")


QUERIES = {f.__name__: f for f in (p2_found, p7_found, p7_documents, p7_nodes, p7_labels, p7_edges)}

_RECORDS = """r AS (SELECT record_id, max_by(payload, (received_at, payload)) AS p FROM rf_raw WHERE record_id IS NOT NULL GROUP BY record_id),
        v AS (SELECT record_id, CAST(p AS JSON) AS j FROM r WHERE CASE WHEN p IS NULL OR p = '' THEN false ELSE json_valid(p) END),
        w AS (SELECT record_id, j, json_type(j, '$.nodes') = 'OBJECT' OR coalesce(json_array_length(j, '$.nodes'), 0) > 0 AS at_top, json_type(j, '$.document.nodes') = 'OBJECT' OR coalesce(json_array_length(j, '$.document.nodes'), 0) > 0 AS inside FROM v WHERE json_type(j) = 'OBJECT')"""
_NODES = f"""{_RECORDS},
        t AS (SELECT record_id, CASE WHEN at_top THEN json_extract(j, '$.nodes') ELSE json_extract(j, '$.document.nodes') END AS ns FROM w),
        top AS (SELECT record_id, CASE json_type(ns) WHEN 'ARRAY' THEN json_extract(ns, '$[*]') WHEN 'OBJECT' THEN [ns] END AS l FROM t),
        nodes AS (
            SELECT record_id, '' AS parent_path, CAST(i - 1 AS VARCHAR) AS path, e AS n FROM (SELECT record_id, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM top) WHERE json_type(e) = 'OBJECT'
            UNION ALL
            SELECT record_id, path, path || '/' || (i - 1), e FROM (
                SELECT record_id, path, unnest(l) AS e, generate_subscripts(l, 1) AS i FROM (
                    SELECT record_id, path, CASE json_type(n, '$.children') WHEN 'ARRAY' THEN json_extract(n, '$.children[*]') WHEN 'OBJECT' THEN [json_extract(n, '$.children')] END AS l FROM nodes))
            WHERE json_type(e) = 'OBJECT'
        ),
        nd AS (SELECT record_id, parent_path, path AS node_path, coalesce(json_extract_string(n, '$.id'), '') AS node_id, json_extract_string(n, '$.source') AS source,
            CASE lower(trim(json_extract_string(n, '$.annotation'))) WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE -1 END AS annotated,
            CASE json_type(n, '$.label') WHEN 'ARRAY' THEN list_filter(json_extract_string(n, '$.label[*]'), lambda x: x IS NOT NULL) WHEN 'NULL' THEN [] ELSE list_filter([json_extract_string(n, '$.label')], lambda x: x IS NOT NULL) END AS ls FROM nodes),
        lb AS (SELECT *, unnest(l2) AS label, generate_subscripts(l2, 1) - 1 AS label_no FROM (SELECT *, CASE WHEN len(ls) = 0 THEN [''] ELSE ls END AS l2 FROM nd))"""

ORACLE_SQL = {
    "p7_found": f"WITH RECURSIVE {_NODES} SELECT DISTINCT record_id, parent_path, node_path, node_id, annotated, label FROM lb",
    "p7_nodes": f"WITH RECURSIVE {_NODES} SELECT record_id, node_path, parent_path, node_id, annotated, source FROM nd",
    "p7_labels": f"WITH RECURSIVE {_NODES} SELECT record_id, node_path, CAST(label_no AS INTEGER) AS label_no, label FROM lb",
    "p7_documents": f"WITH {_RECORDS} SELECT record_id, json_extract_string(j, '$.doc_id') AS doc_id, CASE WHEN coalesce(inside, false) AND NOT coalesce(at_top, false) THEN 'document' ELSE 'top' END AS place FROM w",
    "p7_edges": f"""WITH {_RECORDS}, x AS (SELECT record_id, CASE WHEN json_type(j, '$.edges') = 'OBJECT' OR coalesce(json_array_length(j, '$.edges'), 0) > 0 THEN json_extract(j, '$.edges') ELSE json_extract(j, '$.document.edges') END AS es FROM w),
        y AS (SELECT record_id, CASE json_type(es) WHEN 'ARRAY' THEN json_extract(es, '$[*]') WHEN 'OBJECT' THEN [es] END AS l FROM x),
        z AS (SELECT record_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS i FROM y)
        SELECT record_id, CAST(i AS INTEGER) AS edge_no, json_extract_string(e, '$.from_node_id') AS from_node_id, json_extract_string(e, '$.to_node_id') AS to_node_id, json_extract_string(e, '$.label') AS label FROM z WHERE json_type(e) = 'OBJECT'""",
    "p2_found": """
        WITH sp AS (
            SELECT 'rf_doc' AS origin, doc_id, n.start AS a, n."end" AS b FROM (SELECT doc_id, unnest(nodes) AS n FROM rf_doc) WHERE n.source = 'response'
            UNION ALL
            SELECT 'reasoning_flow_gold', id, p[1], p[2] FROM (SELECT id, unnest(split) AS p FROM reasoning_flow_gold)
        ),
        len AS (
            SELECT 'rf_doc' AS origin, doc_id, max(length(raw_text.response)) AS n FROM rf_doc WHERE doc_id IS NOT NULL GROUP BY ALL
            UNION ALL
            SELECT 'reasoning_flow_gold', id, max(length(rt)) FROM rtrace WHERE id IN (SELECT id FROM reasoning_flow_gold) GROUP BY ALL
        ),
        cl AS (
            SELECT DISTINCT sp.origin, sp.doc_id, greatest(least(a, b), 0) AS s, least(greatest(a, b), n) AS e
            FROM sp JOIN len ON sp.origin = len.origin AND sp.doc_id = len.doc_id WHERE a IS NOT NULL AND b IS NOT NULL AND n > 0
        ),
        fl AS (
            SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY origin, doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens
            FROM cl WHERE s < e
        ),
        isl AS (SELECT *, sum(opens) OVER (PARTITION BY origin, doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM fl),
        per AS (SELECT origin, doc_id, min(s) AS f, max(e) AS t FROM isl GROUP BY origin, doc_id, island),
        edges AS (
            SELECT origin, doc_id, f, t FROM per
            UNION ALL SELECT origin, doc_id, 0, 0 FROM len WHERE n > 0
            UNION ALL SELECT origin, doc_id, n, n FROM len WHERE n > 0
        ),
        gaps AS (SELECT origin, doc_id, t AS f, lead(f) OVER (PARTITION BY origin, doc_id ORDER BY f, t) AS t FROM edges)
        SELECT origin, doc_id, 'period' AS kind, CAST(f AS INTEGER) AS from_pos, CAST(t AS INTEGER) AS to_pos FROM per
        UNION ALL
        SELECT origin, doc_id, 'gap', CAST(f AS INTEGER), CAST(t AS INTEGER) FROM gaps WHERE t > f
    """,
}
