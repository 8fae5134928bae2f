"""Predicates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_rejected(status: Column | str = "status") -> Column:
    """A link counts unless it was rejected; a link without a status counts."""
    return ~_column(status).eqNullSafe(F.lit("rejected"))


def is_reviewed(status: Column | str = "status") -> Column:
    return F.coalesce(_column(status).isin("approved", "rejected"), F.lit(False))


def is_leaf(parent: Column | str = "parent_stable_id") -> Column:
    return _column(parent).isNotNull()


def has_vector(vector: Column | str = "embedding") -> Column:
    return _column(vector).isNotNull()


def map_visible(confidence: Column | str, framework: Column | str, least: float = 0.5, wanted: str = "all") -> Column:
    """Links that a map shows: confident enough (null is 0), of the wanted framework (all, AAMC: every id that starts so, USMLE)."""
    sure = F.coalesce(_column(confidence), F.lit(0)) >= least
    return sure if wanted == "all" else sure & (_column(framework).startswith("AAMC") if wanted == "AAMC" else _column(framework) == wanted)


def matches_objective(text: Column | str, case: Column | str, method: Column | str, query: str = "", want_case: int | None = None, want_method: str | None = None) -> Column:
    out = F.contains(F.lower(_column(text)), F.lit(query.lower()))
    if want_case is not None:
        out &= _column(case) == want_case
    return out & (_column(method) == want_method) if want_method is not None else out


def parse_number(raw: Column | str, low: float, high: float) -> Column:
    """The leading number of a text, if there is one in [low, high]; else null."""
    x = F.regexp_extract(_column(raw), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    return F.when(x.between(low, high), x)


def within_distance(distance: Column | str, most: float | None) -> Column:
    return F.lit(True) if most is None else _column(distance) <= most


def above_similarity(similarity: Column | str, least: float | None) -> Column:
    return F.lit(True) if least is None else _column(similarity) >= least
