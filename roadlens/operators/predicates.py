"""Optional predicates: what is not asked for leaves no trace in the plan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """Rows that fulfil all predicates that are given; with none of them the table itself."""
    given = [p for p in predicates if p is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def equal(column: str, value: object) -> Column | None:
    """Equality, unless the value is unset, zero or empty."""
    return F.col(column) == F.lit(value) if value else None


def at_least(column: str, value: object) -> Column | None:
    return None if value is None else F.col(column) >= F.lit(value)


def at_most(column: str, value: object) -> Column | None:
    return None if value is None else F.col(column) <= F.lit(value)


def within(column: str, low: object, high: object) -> Column:
    """Both bounds included."""
    return F.col(column).between(F.lit(low), F.lit(high))


def starts_with(column: str, prefixes: Sequence[str]) -> Column:
    """Any of the prefixes; a single one reaches the scan as a pushed filter."""
    return reduce(lambda a, b: a | b, [F.col(column).startswith(p) for p in prefixes])


#: The other comparisons of the query surface, by name.
COMPARISONS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "between": lambda c, v: c.between(*v),
    "not_between": lambda c, v: ~c.between(*v),
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
    "like": lambda c, v: c.like(v),
    "not_like": lambda c, v: ~c.like(v),
    "ilike": lambda c, v: c.ilike(v),
    "not_ilike": lambda c, v: ~c.ilike(v),
    "is_null": lambda c, v: c.isNull(),
    "is_not_null": lambda c, v: c.isNotNull(),
}


def where(df: DataFrame, conditions: Iterable[tuple[str, str, object]]) -> DataFrame:
    """Rows that fulfil (column, comparison, value) conditions, e.g. ``("idade", "between", (0, 150))``."""
    return keep(df, *[COMPARISONS[name](F.col(column), value) for column, name, value in conditions])


def exists(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows of which the other table has a match, each once."""
    return df.join(other, df[key] == other[other_key], "left_semi")


def missing(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows of which the other table has no match."""
    return df.join(other, df[key] == other[other_key], "left_anti")
