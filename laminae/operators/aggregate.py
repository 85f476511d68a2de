"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layer import LayeredTable


def count_split(layer: LayeredTable) -> DataFrame:
    """The view's row count as live base rows plus source rows that no base row hides.

    Only keys are read. Counting base rows alone would be wrong: orphan overrides and tombstones of
    rows that the vendor dropped hide nothing.
    """
    base = layer.live_base().agg(F.count("*").alias("n"))
    source = layer.source_only().agg(F.count("*").alias("n"))
    return base.unionByName(source).agg(F.sum("n").alias("n"))


def resolve_count(df: DataFrame, key: str) -> DataFrame:
    """How many different keys: each is shuffled once for each task that holds it."""
    return df.select(key).distinct().agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, columns: list[str], name: str = "n") -> DataFrame:
    """Values that occur more than once; rows with a null among them never collide."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df.groupBy(*columns).agg(F.count("*").alias(name)).filter(F.col(name) > 1)


def bucket_counts(buckets: dict[str, Column], distinct: str | None = None) -> list[Column]:
    """A conditional count for each bucket; of distinct keys where a join has multiplied the rows."""
    if distinct is None:
        return [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in buckets.items()]
    return [F.count_distinct(F.when(c, F.col(distinct))).alias(n) for n, c in buckets.items()]
