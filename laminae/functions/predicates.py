"""Predicates with the semantics of the query surface."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_from(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM."""
    return ~a.eqNullSafe(b)


def excluded(predicate: Column) -> Column:
    """The rows that ``exclude`` keeps: those of which the predicate is false or unknown."""
    return ~F.coalesce(predicate, F.lit(False))


def any_distinct(pairs: Iterable[tuple[Column, Column]]) -> Column:
    """Whether any pair differs; false for none."""
    return reduce(lambda x, y: x | y, (distinct_from(a, b) for a, b in pairs), F.lit(False))


def joined_text(*parts: Column) -> Column:
    """Parts one after the other, as text; a null is an empty one."""
    return F.concat_ws("", *(p.cast("string") for p in parts))


def lookup(column: Column, kind: str, value) -> Column:
    """A predicate by the name of its lookup; ``exact`` with None is a test for null."""
    if kind == "exact":
        return column.isNull() if value is None else column == value
    if kind == "isnull":
        return column.isNull() if value else column.isNotNull()
    simple = {
        "in": lambda: column.isin(list(value)),
        "gt": lambda: column > value,
        "gte": lambda: column >= value,
        "lt": lambda: column < value,
        "lte": lambda: column <= value,
        "startswith": lambda: column.startswith(value),
        "contains": lambda: column.contains(value),
        "icontains": lambda: F.lower(column).contains(str(value).lower()),
        "range": lambda: column.between(*value),
    }
    return simple[kind]()


#: Distinct keys of 8 to 36 bytes that may be broadcast.
BROADCAST_KEYS = 200_000


def in_keys(df: DataFrame, column: str, keys: DataFrame, small: bool = False) -> DataFrame:
    """Rows whose ``column`` is among the first column of ``keys``: a semi-join, so rows never multiply.

    ``small`` says that the keys are likely few: they are counted, up to ``BROADCAST_KEYS``, and broadcast if they are.
    """
    key = keys.columns[0]
    keys = keys.select(F.col(key).alias("__key"))
    if small:
        few = keys.distinct()
        if few.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
            keys = F.broadcast(few)
    return df.join(keys, F.col(column) == F.col("__key"), "left_semi")


def not_in_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``column`` is not among ``keys``; a null column is kept."""
    key = keys.columns[0]
    return df.join(keys.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")


#: Literal keys up to here stay an expression (a hash set in generated code); more become a semi-join.
LITERAL_KEYS = 1000


def in_literals(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose ``column`` is among literal ``values``."""
    values = [v for v in dict.fromkeys(values) if v is not None]
    if len(values) <= LITERAL_KEYS:
        return df.filter(F.col(column).isin(values)) if values else df.filter(F.lit(False))
    kind = df.schema[column].dataType.simpleString()
    return in_keys(df, column, df.sparkSession.createDataFrame([(v,) for v in values], f"k {kind}"))
