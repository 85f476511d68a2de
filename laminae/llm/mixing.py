"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

Every document has an expected number of copies: its source's target over its source's size. Within
a source these are summed along an order of the documents, one random offset is added, and a
document is emitted once for each integer that its step of the sum crosses. Sums are kept in fixed
point (2**-24), so that they are exact and reruns agree whatever the partitioning.

Null texts have size 0; a null source is a source, the last one. Rows that repeat are documents of
their own. Sources of size 0 have target 0. An empty table gives an empty result. Columns that clash
with the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .durable import durable
from .lookup import lookup

ONE = 1 << 24
WEIGHTS = (3, 1, 2)
SHARE, CEILING = 1.5, 2
#: Rows of one group of equal source and size class that one task orders, on average at most.
GROUP_ROWS = 200_000


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: weighted shares with a ceiling.

    The targets share ``share`` of all sizes by weight; none exceeds ``ceiling`` times its source's
    size, and what that leaves is shared by weight among the others. In the order of size over
    weight the sources at the ceiling come first, so running sums give the level of the others. One
    row a source: the windows over the whole table hold sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("__ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("__ratio")
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    level = sizes.withColumn("__w", pick.cast("long")).withColumn("__cap", F.col("source_size") * ceiling)
    level = level.withColumn("__ratio", F.col("__cap") / F.col("__w"))
    left = F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(by_ratio), F.lit(0))
    weight = F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(by_ratio), F.lit(0))
    level = level.withColumn("__level", left / weight)
    full = F.col("__ratio") <= F.col("__level")
    level = level.withColumn("__free", F.first(F.when(~full, F.col("__level")), ignorenulls=True).over(whole))
    target = F.when(full, F.col("__cap").cast("double")).otherwise(F.col("__w") * F.col("__free"))
    return level.select("source", "source_size", target.alias("target"))


def systematic_copies(df: DataFrame, stratum: str, size: str, expected: Column, tie: list[Column], rows: int, seed: int = 0) -> DataFrame:
    """Add ``copies`` (long): how often each row is emitted, from ``expected`` copies (double).

    Within a stratum rows are ordered by size class, then a salt drawn from ``tie``, then size and
    tie; ordering by size keeps the words taken close to their target. A group of equal stratum,
    class and salt is summed on its own and shifted by the sum of the groups before it: a stratum
    with a third of all rows is thousands of groups.
    """
    salts = max(16, rows // GROUP_ROWS)
    group = [stratum, "__class", "__salt"]
    rows_ = (
        df.withColumn("__fixed", F.round(expected * ONE).cast("long"))
        .withColumn("__class", F.floor(F.log2(F.col(size) + 1.0) * 4).cast("int"))
        .withColumn("__tie", F.xxhash64(*tie, F.lit(seed)))
        .withColumn("__salt", F.pmod("__tie", F.lit(salts)).cast("int"))
    )
    before = Window.partitionBy(stratum).orderBy("__class", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.pmod(F.xxhash64(F.coalesce(F.col(stratum), F.lit("\0null")), F.lit(seed)), F.lit(ONE))
    groups = rows_.groupBy(*group).agg(F.sum("__fixed").alias("__sum"))
    groups = groups.select(*group, (F.coalesce(F.sum("__sum").over(before), F.lit(0)) + offset).alias("__from"))
    inside = Window.partitionBy(*group).orderBy(size, "__tie", *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = lookup(rows_, groups, group, "__tie").withColumn("__upto", F.col("__from") + F.sum("__fixed").over(inside))
    copies = F.expr(f"(__upto div {ONE}) - ((__upto - __fixed) div {ONE})")
    return out.withColumn("copies", copies).drop("__fixed", "__class", "__tie", "__salt", "__from", "__upto")


def with_size(docs: DataFrame) -> DataFrame:
    """Documents with ``size``, their number of words, and ``text_tie``, which orders documents of one doc_id (or none)."""
    return docs.withColumns({"size": word_count(F.col("text")), "text_tie": F.xxhash64("text")})


def mix_plan(sized: DataFrame, seed: int = 0) -> DataFrame:
    """Add ``source_size``, ``target`` (their source's) and ``copies`` to rows with ``doc_id, source, size``.

    A table that has a bounded width is worth writing out first: it is read three times.
    """
    sized = sized.drop("source_size", "target", "copies")
    totals = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    rows = totals.agg(F.sum("n")).first()[0] or 0
    planned = lookup(sized, source_targets(totals.drop("n")), ["source"], "doc_id")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # By the text too, where it is known, so that rows without an id are not one group.
    tie = [F.col(c) for c in ("doc_id", "text_tie") if c in sized.columns]
    return systematic_copies(planned, "source", "size", expected, tie, rows, seed).drop("text_tie")


def emit_copies(planned: DataFrame) -> DataFrame:
    """Each row as often as its ``copies`` say."""
    return planned.filter("copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, copies)"))).drop("__copy")
