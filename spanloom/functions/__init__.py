"""SQL expressions on texts, spans and boundaries.

Everything here is text of Spark SQL expressions on columns of one row, so a
whole chain of operators on a text stays in one stage without a shuffle.  Spans
are ``array<struct<s:int,e:int>>``, labelled spans have ``label:string`` too,
boundaries are ``array<int>``.  Folds that would be quadratic as expressions are
in ``arrays``.
"""

from __future__ import annotations

def ends(spans: str) -> str:
    """Evaluation boundaries: the ends of all spans but the last."""
    return f"slice(transform({spans}, x -> x.e), 1, greatest(size({spans}) - 1, 0))"


def starts_and_ends(spans: str) -> str:
    """Fusion boundaries: all starts and ends."""
    return f"array_sort(array_distinct(concat(transform({spans}, x -> x.s), transform({spans}, x -> x.e))))"


def pair_up(boundaries: str) -> str:
    """Spans between consecutive boundaries."""
    return f"transform(slice({boundaries}, 1, greatest(size({boundaries}) - 1, 0)), (b, i) -> named_struct('s', b, 'e', get({boundaries}, i + 1)))"
