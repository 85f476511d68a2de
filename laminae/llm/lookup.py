"""Joining many rows to a table of unique keys without gathering a hot key in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import compact

#: Rows of up to about 100 bytes that may be broadcast: some 2 MB.
BROADCAST_ROWS = 20_000
SALTS = 32


def lookup(left: DataFrame, table: DataFrame, on: list[str], spread: str, limit: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Left-join ``table`` (at most one row a key, nulls equal nulls) and drop its keys.

    The table is computed once and counted, unless ``rows`` says how many there are at most: up to ``limit`` rows it is broadcast. Beyond that each
    of its rows is copied to ``SALTS`` salts and ``left`` is dealt by key and ``hash(spread)``, so a
    key with a third of all rows still reaches ``SALTS`` tasks. A limit of 0, for rows of unbounded
    width, goes to the salts without a count.
    """
    if rows is None:
        table, rows = compact(table) if limit else (table, 0)
    names = {c: f"__k{i}" for i, c in enumerate(on)}
    table = table.select(*(F.col(c).alias(n) for c, n in names.items()), *(c for c in table.columns if c not in names))
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    if limit and rows <= limit:
        joined = left.join(F.broadcast(table), reduce(lambda a, b: a & b, same), "left")
    else:
        left = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        table = table.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.join(table, reduce(lambda a, b: a & b, [*same, F.col("__salt") == F.col("__to")]), "left")
        joined = joined.drop("__salt", "__to")
    return joined.drop(*names.values())
