"""Relations between tables, with exact row multiplicity.

A forward foreign key never multiplies rows, so filtering through it is a semi-join. Many-to-many
and reverse relations give a row for each matching link: they are inner joins, and only a caller
who wants each row once says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import in_keys, not_in_keys


def filter_forward(df: DataFrame, fk: str, target: DataFrame, pk: str, where: Column | None = None) -> DataFrame:
    """Rows whose ``fk`` names a target row that meets ``where``; a null key never matches."""
    target = target.filter(where) if where is not None else target
    return in_keys(df, fk, target.select(pk))


def filter_m2m(df: DataFrame, pk: str, link: DataFrame, near: str, far: str, target: DataFrame, target_pk: str, where: Column | None = None) -> DataFrame:
    """Rows of ``df``, once for each link to a matching target row."""
    return _linked(df, pk, m2m_keys(link, near, far, target, target_pk, where))


def m2m_keys(link: DataFrame, near: str, far: str, target: DataFrame, target_pk: str, where: Column | None = None) -> DataFrame:
    """Near keys of the links to matching target rows, one for each link."""
    target = target.filter(where) if where is not None else target
    # The far side is unique, so finding its links is a semi-join.
    return in_keys(link, far, target.select(target_pk)).select(near)


def filter_reverse(df: DataFrame, pk: str, child: DataFrame, fk: str, where: Column | None = None, once: bool = False) -> DataFrame:
    """Rows of ``df``, once for each matching child row; with ``once``, once."""
    child = child.filter(where) if where is not None else child
    return in_keys(df, pk, child.select(fk)) if once else _linked(df, pk, child.select(fk))


def _linked(df: DataFrame, pk: str, keys: DataFrame) -> DataFrame:
    return df.join(keys.select(F.col(keys.columns[0]).alias("__near")), F.col(pk) == F.col("__near")).drop("__near")


def exclude_related(df: DataFrame, pk: str, keys: DataFrame) -> DataFrame:
    """Rows without any of ``keys``: exclusion over a relation of many is an anti-join."""
    return not_in_keys(df, pk, keys)


def any_of(df: DataFrame, pk: str, *keys: DataFrame) -> DataFrame:
    """Rows whose key is in any of the key sets: an OR across relations, each row once."""
    named = [k.select(F.col(k.columns[0]).alias("k")) for k in keys]
    return in_keys(df, pk, reduce(lambda a, b: a.unionByName(b), named))


def all_of(df: DataFrame, pk: str, *keys: DataFrame) -> DataFrame:
    """Rows whose key is in every key set: a chain of semi-joins, the narrowest first."""
    return reduce(lambda d, k: in_keys(d, pk, k), keys, df)


def with_related(df: DataFrame, fk: str, target: DataFrame, pk: str, name: str) -> DataFrame:
    """Add the row that ``fk`` names as a struct, null without one."""
    packed = target.select(F.col(pk).alias("__pk"), F.struct(*(F.col(f"`{c}`") for c in target.columns)).alias(name))
    return df.join(packed, F.col(fk) == F.col("__pk"), "left").drop("__pk")


def with_children(df: DataFrame, pk: str, child: DataFrame, fk: str, name: str, columns: list[str]) -> DataFrame:
    """Add the child rows as an array of structs, ordered by their columns, empty without any.

    The array holds one row's children: a parent with unboundedly many is better joined.
    """
    packed = child.groupBy(F.col(fk).alias("__fk")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    joined = df.join(packed, F.col(pk) == F.col("__fk"), "left").drop("__fk")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def with_count(df: DataFrame, pk: str, child: DataFrame, fk: str, name: str) -> DataFrame:
    """Add how many child rows name each row, counted before the join."""
    counts = child.groupBy(F.col(fk).alias("__fk")).agg(F.count("*").alias(name))
    return df.join(counts, F.col(pk) == F.col("__fk"), "left").drop("__fk").withColumn(name, F.coalesce(name, F.lit(0)))


def latest_related(df: DataFrame, pk: str, child: DataFrame, fk: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``value`` of each row's last child in ``order``: an aggregate instead of a correlated subquery."""
    last = child.groupBy(F.col(fk).alias("__fk")).agg(F.max_by(value, F.struct(*order)).alias(name))
    return df.join(last, F.col(pk) == F.col("__fk"), "left").drop("__fk")
