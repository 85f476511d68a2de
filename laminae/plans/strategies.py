"""Ways to compute one answer: they must agree, and the caller or a measurement picks one.

``scope`` is a DataFrame of rows, ``leaves`` are key sets (one column each).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import in_keys
from ..operators.aggregate import bucket_counts
from ..operators.relate import all_of


def _keys(leaf: DataFrame) -> DataFrame:
    return leaf.select(F.col(leaf.columns[0]).alias("k")).distinct()


def naive(df: DataFrame, pk: str, leaves: list[DataFrame]) -> DataFrame:
    """Join every leaf and make the keys distinct."""
    for i, leaf in enumerate(leaves):
        df = df.join(leaf.select(F.col(leaf.columns[0]).alias(f"__k{i}")), F.col(pk) == F.col(f"__k{i}"))
    return df.select(pk).distinct()


def narrow_first(df: DataFrame, pk: str, leaves: list[DataFrame]) -> DataFrame:
    """Semi-joins in the order given."""
    return all_of(df, pk, *leaves).select(pk)


def broad_first(df: DataFrame, pk: str, leaves: list[DataFrame]) -> DataFrame:
    return all_of(df, pk, *reversed(leaves)).select(pk)


def subquery_first(df: DataFrame, pk: str, leaves: list[DataFrame]) -> DataFrame:
    """The leaves are joined with each other, and rows are read by the keys that remain."""
    keys = reduce(lambda a, b: in_keys(a, "k", b), [_keys(x) for x in leaves])
    return in_keys(df, pk, keys).select(pk)


def intersected(df: DataFrame, pk: str, leaves: list[DataFrame]) -> DataFrame:
    """INTERSECT of the leaves."""
    keys = reduce(lambda a, b: a.intersect(b), [_keys(x) for x in leaves])
    return in_keys(df, pk, keys).select(pk)


def counted(df: DataFrame, pk: str, leaves: list[DataFrame]) -> DataFrame:
    """Keys that as many leaves hold as there are: one aggregation, whatever their number."""
    tagged = [_keys(x) for x in leaves]
    keys = reduce(lambda a, b: a.unionByName(b), tagged).groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") == len(leaves))
    return in_keys(df, pk, keys.select("k")).select(pk)


STAGED: dict[str, Callable[[DataFrame, str, list[DataFrame]], DataFrame]] = {
    f.__name__: f for f in (naive, narrow_first, broad_first, subquery_first, intersected, counted)
}


def panel_joined(df: DataFrame, pk: str, keys: DataFrame, buckets: dict[str, Column]) -> DataFrame:
    """A: the scope's join multiplies rows, so every bucket counts distinct keys.

    The buckets of a row are the bits of a number, which the join carries in place of their columns;
    the rows of a key are made one by their bits. A distinct count for each bucket would copy every
    joined row as often as there are buckets.
    """
    bits = sum((F.when(c, F.lit(1 << i).cast("bigint")).otherwise(0) for i, c in enumerate(buckets.values())), F.lit(0).cast("bigint"))
    rows = df.select(F.col(pk), bits.alias("__bits"))
    joined = rows.join(keys.select(F.col(keys.columns[0]).alias("__k")), F.col(pk) == F.col("__k"))
    once = joined.groupBy(pk).agg(F.bit_or("__bits").alias("__bits"))
    return once.agg(F.count("*").alias("total"), *(F.count_if(F.getbit("__bits", F.lit(i)) == 1).alias(n) for i, n in enumerate(buckets)))


def panel_semi(df: DataFrame, pk: str, keys: DataFrame, buckets: dict[str, Column]) -> DataFrame:
    """B: the scope is a semi-join, so rows are counted as they are. The plan to prefer."""
    return in_keys(df, pk, keys).agg(F.count("*").alias("total"), *bucket_counts(buckets))


def panel_staged(df: DataFrame, pk: str, keys: DataFrame, buckets: dict[str, Column]) -> DataFrame:
    """C: distinct keys first, then an inner join on them."""
    joined = df.join(_keys(keys), F.col(pk) == F.col("k"))
    return joined.agg(F.count("*").alias("total"), *bucket_counts(buckets))


def panel_grouped(df: DataFrame, pk: str, keys: DataFrame, buckets: dict[str, Column]) -> DataFrame:
    """D: each row once by grouping on the key after the join, then sums of flags."""
    joined = df.join(keys.select(F.col(keys.columns[0]).alias("__k")), F.col(pk) == F.col("__k"))
    flags = [F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in buckets.items()]
    return joined.groupBy(pk).agg(*flags).agg(F.count("*").alias("total"), *(F.sum(n).alias(n) for n in buckets))


def panel_split(df: DataFrame, pk: str, keys: DataFrame, buckets: dict[str, Column]) -> DataFrame:
    """E: one row a bucket, then turned: a single pass that grows with the number of buckets."""
    rows = in_keys(df, pk, keys)
    names = F.array(F.lit("total"), *(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in buckets.items()))
    counts = rows.select(F.explode(F.array_compact(names)).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    return counts.agg(*(F.coalesce(F.sum(F.when(F.col("b") == n, F.col("n"))), F.lit(0)).alias(n) for n in ("total", *buckets)))


PANELS = {"a": panel_joined, "b": panel_semi, "c": panel_staged, "d": panel_grouped, "e": panel_split}
