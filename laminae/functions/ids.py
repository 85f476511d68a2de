"""Key columns: mapping between the layers and generation."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.settle import settled
from ..spec import LayerSpec


def view_key(spec: LayerSpec, source_id: Column) -> Column:
    """A source id as the view shows it."""
    return -source_id if spec.strategy.negates_source else source_id


source_key = view_key  # the mapping is its own inverse


def uuid7_expression(millis: int | None = None) -> Column:
    """A time-ordered version 7 UUID for each row: one time for all rows, read here, then random bits."""
    millis = time.time_ns() // 1_000_000 if millis is None else millis
    head = f"{millis:012x}"
    rest = F.replace(F.expr("uuid()"), F.lit("-"))
    return F.concat_ws(
        "-", F.lit(head[:8]), F.lit(head[8:]), F.concat(F.lit("7"), F.substring(rest, 14, 3)), F.substring(rest, 17, 4), F.substring(rest, 21, 12)
    )


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add a gapless number from 1 in ``order``, over as many tasks as there are ranges of it.

    Ranges are sorted on their own and written once; their sizes, the only thing the driver sees,
    say where each begins. Rows equal in ``order`` keep the numbers they got.
    """
    placed = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    sizes = dict(placed.groupBy(F.shiftright("__at", 33).cast("int").alias("p")).count().collect())
    before, starts = 0, []
    for p in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(p, 0)
    start = F.get(F.lit(starts or [0]).cast("array<bigint>"), F.shiftright("__at", 33).cast("int"))
    return placed.withColumn(name, start + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at")


def with_new_keys(spec: LayerSpec, rows: DataFrame, base: DataFrame, order_by: list[str]) -> DataFrame:
    """Fill null keys of ``rows``.

    Integer keys continue the base's sequence in the strategy's direction, numbered by ``order_by``.
    Rows with generated keys are written once, so that all who read them see the same keys.
    """
    if spec.pk_is_relation:
        return rows
    kind = base.schema[spec.pk].dataType
    key = F.col(spec.pk)
    if spec.pk_default_sql is not None:
        return settled(rows.withColumn(spec.pk, F.coalesce(key, F.expr(spec.pk_default_sql).cast(kind))))
    if not spec.strategy.integer:
        new = F.expr("uuid()") if spec.strategy.name == "UUID4" else uuid7_expression()
        return settled(rows.withColumn(spec.pk, F.coalesce(key, new)))
    step = spec.strategy.direction
    edge = base.select(key).unionByName(rows.select(key)).agg(F.max(key) if step > 0 else F.min(key)).first()[0] or 0
    edge = max(edge, 0) if step > 0 else min(edge, 0)
    fresh = numbered(rows.filter(key.isNull()), [F.col(c).asc_nulls_last() for c in order_by], "__n")
    fresh = fresh.withColumn(spec.pk, (edge + step * F.col("__n")).cast(kind)).drop("__n")
    return rows.filter(key.isNotNull()).unionByName(fresh.select(*rows.columns))
