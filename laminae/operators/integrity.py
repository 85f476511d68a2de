"""Constraints over both layers, as queries that return the rows that break them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import LayerSpec, Relation, Unique
from .layer import LayeredTable


def dangling(refs: DataFrame, column: str, target: DataFrame, pk: str) -> DataFrame:
    """Rows whose ``column`` is not null and names no row of ``target``; seeing the view's rows is all a key needs."""
    keys = target.select(F.col(pk).alias("__pk"))
    return refs.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__pk"), "left_anti")


def broken_references(refs: DataFrame, column: str, before: DataFrame, after: DataFrame, pk: str) -> DataFrame:
    """Rows that name a key which the target's view had and has no longer."""
    gone = before.select(F.col(pk).alias("__pk")).join(after.select(F.col(pk).alias("__left")), F.col("__pk") == F.col("__left"), "left_anti")
    return refs.join(gone, F.col(column) == F.col("__pk"), "left_semi")


def _constrained(rows: DataFrame, unique: Unique) -> DataFrame:
    for c in unique.columns:
        rows = rows.filter(F.col(c).isNotNull())
    return rows.filter(F.expr(unique.condition)) if unique.condition else rows


def watched_columns(layer: LayeredTable, unique: Unique) -> list[str]:
    """The columns of which a change can make a row collide: the constrained ones and those of the condition."""
    named = set(re.findall(r"\w+", unique.condition or ""))
    return [c for c in layer.spec.columns if c in unique.columns or c in named]


def changed_rows(before: LayeredTable, after: LayeredTable, columns: list[str]) -> DataFrame:
    """Keys of live base rows that the view did not show before, or not with these values."""
    pk = after.spec.pk
    old = before.rows().select(F.col(pk).alias("__old"), *(F.col(c).alias(f"__o_{c}") for c in columns))
    same = [F.col(pk) == F.col("__old"), *(F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in columns)]
    return after.live_base().join(old, same, "left_anti").select(pk)


def _of(rows: DataFrame, pk: str, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select(F.col(keys.columns[0]).alias("__c")), F.col(pk) == F.col("__c"), "left_semi")


def base_duplicates(layer: LayeredTable, unique: Unique, changed: DataFrame | None = None) -> DataFrame:
    """Values that more than one live base row (one of ``changed`` keys among them) holds, with their number ``n``."""
    rows = _constrained(layer.live_base(), unique)
    if changed is not None:
        values = _of(rows, layer.spec.pk, changed).select(*(F.col(c).alias(f"__v_{c}") for c in unique.columns))
        rows = rows.join(values, [F.col(c) == F.col(f"__v_{c}") for c in unique.columns], "left_semi")
    return rows.groupBy(*unique.columns).agg(F.count("*").alias("n")).filter("n > 1")


#: Pairs of rows that a task makes, and those of one value that stay together.
TASK_PAIRS, CELL_PAIRS = 1 << 26, 1 << 20


def _pairs(own: DataFrame, pk: str, theirs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``own`` (``pk`` and ``columns``) with those of ``theirs`` (``source_pk``, ``columns`` under ``__s_``) of the same values.

    Few values with many rows make as many pairs as the product of their rows, from inputs so small
    that one task would take them all. So pairs are counted (one number reaches the driver), and
    dealt to as many tasks as they need. A value with more than ``CELL_PAIRS`` is cut into parts on
    both sides, and a row is copied once for each part of the other side: with the power 1.5 of its
    rows. Such values have 2,048 rows or more, so a 2,048th of the rows at most are broadcast.
    """
    there = [f"__s_{c}" for c in columns]
    same = [F.col(c) == F.col(t) for c, t in zip(columns, there, strict=True)]
    counts = own.groupBy(*columns).agg(F.count("*").alias("__m")).join(theirs.groupBy(*there).agg(F.count("*").alias("__n")), same)
    pairs = F.col("__m").cast("double") * F.col("__n")
    total = counts.agg(F.sum(pairs)).first()[0] or 0
    if total <= TASK_PAIRS:
        return own.join(theirs, same)
    spark = own.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total / TASK_PAIRS) + 1)
    side = int(CELL_PAIRS**0.5)
    parts = [F.ceil(F.col(n) / side).cast("int").alias(name) for n, name in (("__m", "__mine"), ("__n", "__other"))]
    cut = F.broadcast(counts.filter(pairs > CELL_PAIRS).select(*(F.col(c).alias(f"__v_{c}") for c in columns), *parts))

    def dealt(rows: DataFrame, key: str, names: list[str], part: str, copies: str, at: tuple[str, str]) -> DataFrame:
        rows = rows.join(cut, [F.col(n) == F.col(f"__v_{c}") for n, c in zip(names, columns, strict=True)], "left")
        each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(copies), F.lit(1)) - 1))
        rows = rows.select(key, *names, F.pmod(F.xxhash64(key), F.coalesce(F.col(part), F.lit(1))).cast("int").alias(at[0]), each.alias(at[1]))
        return rows.repartition(tasks, *names, *sorted(at))

    mine = dealt(own, pk, columns, "__mine", "__other", ("__i", "__j"))
    others = dealt(theirs, "source_pk", there, "__other", "__mine", ("__l", "__k"))
    return mine.join(others, [*same, F.col("__i") == F.col("__k"), F.col("__j") == F.col("__l")]).select(pk, *columns, "source_pk", *there)


def source_collisions(layer: LayeredTable, unique: Unique, changed: DataFrame | None = None) -> DataFrame:
    """Live base rows (those of ``changed`` keys) whose values a visible source row of another key holds.

    ``pk, columns..., source_pk``, a row for each collision.
    """
    pk = layer.spec.pk
    rows = _constrained(layer.live_base(), unique)
    if changed is not None:
        rows = _of(rows, pk, changed)
    theirs = _constrained(layer.source_only(), unique).select(F.col(pk).alias("source_pk"), *(F.col(c).alias(f"__s_{c}") for c in unique.columns))
    joined = _pairs(rows.select(pk, *unique.columns), pk, theirs, list(unique.columns))
    return joined.filter(F.col(pk) != F.col("source_pk")).select(pk, *unique.columns, "source_pk")


def source_duplicates(rows: DataFrame, unique: Unique) -> DataFrame:
    """Values that several rows of one source hold: reported in a swap, never enforced."""
    return _constrained(rows, unique).groupBy(*unique.columns).agg(F.count("*").alias("n")).filter("n > 1")


def failed_checks(layer: LayeredTable, condition: str, changed: DataFrame | None = None) -> DataFrame:
    """Live base rows (those of ``changed`` keys) of which a check is false; unknown passes."""
    rows = layer.live_base() if changed is None else _of(layer.live_base(), layer.spec.pk, changed)
    return rows.filter(~F.coalesce(F.expr(condition), F.lit(True)))


def validate(layer: LayeredTable, candidates: DataFrame, unique: Unique) -> DataFrame:
    """Candidates whose values a view row of another key holds, tombstones and hidden rows not counted."""
    pk = layer.spec.pk
    held = _constrained(layer.rows(), unique).select(F.col(pk).alias("__pk"), *(F.col(c).alias(f"__v_{c}") for c in unique.columns))
    same = [F.col(c) == F.col(f"__v_{c}") for c in unique.columns]
    mine = _constrained(candidates, unique)
    return mine.join(held, [*same, ~F.col(pk).eqNullSafe(F.col("__pk"))], "left_semi")


def relation_problems(relations: list[Relation], layers: dict[str, LayerSpec], sources: dict[str, list[str]]) -> list[str]:
    """What is wrong with declared relations: unknown tables and columns, and targets partitioned by a column that the referrer lacks."""
    found = []
    for r in relations:
        name = f"{r.from_table}.{r.column}"
        if r.to_table not in layers and r.to_table not in sources:
            found.append(f"{name}: unknown target {r.to_table}")
        columns = layers[r.from_table].columns if r.from_table in layers else sources.get(r.from_table, [])
        if r.column not in columns:
            found.append(f"{name}: no such column")
        target = layers.get(r.to_table)
        if target is not None and target.source.partition_key and r.partition_column is None:
            found.append(f"{name}: {r.to_table} is partitioned by {target.source.partition_key}, and the relation names no column for it")
        if r.partition_column is not None and r.partition_column not in columns:
            found.append(f"{name}: no partition column {r.partition_column}")
    return found
