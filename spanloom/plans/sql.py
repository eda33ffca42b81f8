"""Common table expressions of the queries' SQL."""

from __future__ import annotations

from spanloom.operators.engines import MARKERS, marker_pattern
from spanloom.operators.units import SENTENCE_PATTERN

ALL_MARKERS = marker_pattern([m for family in MARKERS.values() for m in family])
CHUNK = 400

#: texts(id, text, n): what the engines run on.
DOCUMENTS = "texts AS (SELECT doc_id AS id, text, length(text) AS n FROM documents WHERE text IS NOT NULL)"
TRACES = "texts AS (SELECT id, max(rt) AS text, length(max(rt)) AS n FROM rtrace WHERE id IS NOT NULL AND rt IS NOT NULL GROUP BY id)"


def units(pattern: str = SENTENCE_PATTERN, name: str = "u", source: str = "texts") -> str:
    """u(id, n, unit_idx, piece, s, e): pieces of a tiling pattern."""
    return f"""
    {name}_p AS (SELECT id, n, regexp_extract_all(text, '({pattern})', 1) AS ps FROM {source}),
    {name}_x AS (SELECT id, n, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM {name}_p),
    {name} AS (SELECT id, n, CAST(i - 1 AS INTEGER) AS unit_idx, piece,
        CAST(sum(length(piece)) OVER (PARTITION BY id ORDER BY i) - length(piece) AS INTEGER) AS s,
        CAST(sum(length(piece)) OVER (PARTITION BY id ORDER BY i) AS INTEGER) AS e FROM {name}_x)"""


def delimited(delimiter: str, name: str, source: str = "texts") -> str:
    """name(id, s, e): spans cut behind a delimiter (an SQL expression)."""
    return f"""
    {name}_p AS (SELECT id, n, string_split(text, {delimiter}) AS ps, length({delimiter}) AS w FROM {source}),
    {name}_x AS (SELECT id, n, w, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i, ps[1] = '' AND len(ps) > 1 AS skip FROM {name}_p),
    {name}_s AS (SELECT id, n, i, skip, sum(length(piece) + w) OVER (PARTITION BY id ORDER BY i) - length(piece) - w AS s FROM {name}_x),
    {name} AS (SELECT id, CAST(s AS INTEGER) AS s, CAST(coalesce(lead(s) OVER (PARTITION BY id ORDER BY i), n) AS INTEGER) AS e FROM {name}_s WHERE NOT (skip AND i = 1))"""


def marked(name: str, pattern: str = ALL_MARKERS, source: str = "u") -> str:
    """name(id, s, e): units with a marker open spans."""
    return f"""
    {name}_m AS (SELECT id, n, s FROM {source} WHERE unit_idx = 0 OR regexp_matches(lower(piece), '{pattern}')),
    {name} AS (SELECT id, s, CAST(coalesce(lead(s) OVER (PARTITION BY id ORDER BY s), n) AS INTEGER) AS e FROM {name}_m)"""


def chunked(name: str, size: int = CHUNK, source: str = "texts") -> str:
    return f"""{name} AS (SELECT id, CAST(s AS INTEGER) AS s, CAST(least(s + {size}, n) AS INTEGER) AS e FROM (SELECT id, n, unnest(range(0, n, {size})) AS s FROM {source}))"""


def engines(texts: str) -> str:
    """texts, u, nl, mk, ch and seg(id, eng, s, e) of the three engines."""
    return ",".join([texts, units(), delimited("chr(10)", "nl"), marked("mk"), chunked("ch"), "seg AS (SELECT id, 0 AS eng, s, e FROM nl UNION ALL SELECT id, 1, s, e FROM mk UNION ALL SELECT id, 2, s, e FROM ch)"])


def cleaned(name: str, source: str, order: str = "s") -> str:
    """name(id, s, e, n): spans of source(id, n, s, e, order) made contiguous to the end of the text."""
    return f"""{name} AS (SELECT id, n, CASE WHEN count(*) OVER (PARTITION BY id) = 1 THEN 0 ELSE s END AS s, CAST(coalesce(lead(s) OVER (PARTITION BY id ORDER BY {order}), n) AS INTEGER) AS e, {order} AS o FROM {source})"""


def boundaries(name: str, source: str, order: str = "s") -> str:
    """name(id, b): list of the ends of all spans but the last."""
    return f"""{name} AS (SELECT id, coalesce(list(e ORDER BY r) FILTER (WHERE r < m), CAST([] AS INTEGER[])) AS b, list({{'s': s, 'e': e}} ORDER BY r) AS sp FROM
        (SELECT id, s, e, row_number() OVER (PARTITION BY id ORDER BY {order}, e) AS r, count(*) OVER (PARTITION BY id) AS m FROM {source}) GROUP BY id)"""


def near(a: str, b: str, window: float) -> str:
    return f"(len(list_filter({a}, lambda x: len(list_filter({b}, lambda y: abs(x - y) <= {window})) > 0)) / len({a}))"


def b_score(a: str, b: str, window: float = 3) -> str:
    m, k = near(a, b, window), near(b, a, window)
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 WHEN {m} + {k} > 0 THEN 2 * {m} * {k} / ({m} + {k}) ELSE 0.0 END"


def soft(a: str, b: str, sigma: float = 5.0) -> str:
    return f"(list_sum(list_transform({a}, lambda x: exp(-list_min(list_transform({b}, lambda y: abs(x - y))) / {sigma}))) / len({a}))"
