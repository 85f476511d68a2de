"""Ordering, pages and top rows. Nulls sort last ascending and first descending, as in the reference database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import numbered


def terms(*order: str) -> list[Column]:
    """Sort terms from names, ``-`` in front for descending."""
    return [F.col(o[1:]).desc_nulls_first() if o.startswith("-") else F.col(o).asc_nulls_last() for o in order]


def page(df: DataFrame, order: list[str], start: int, stop: int) -> DataFrame:
    """Rows ``start:stop`` of an order: a top-k for each task and one merge, never a full sort."""
    return df.orderBy(*terms(*order)).offset(start).limit(stop - start)


def late_page(df: DataFrame, key: str, order: list[str], start: int, stop: int) -> DataFrame:
    """The same page, its keys first and their rows after: for wide rows, where the key pass reads few columns.

    The keys are ``stop - start`` at most, so they are broadcast.
    """
    columns = list(dict.fromkeys([key, *(o.lstrip("-") for o in order)]))
    keys = page(df.select(*columns), order, start, stop).select(F.col(key).alias("__key"))
    return df.join(F.broadcast(keys), F.col(key) == F.col("__key"), "left_semi").orderBy(*terms(*order))


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The page that follows a cursor."""
    rows = df if after is None else df.filter(F.col(key) > after)
    return rows.orderBy(*terms(key)).limit(size)


def page_number(df: DataFrame, order: list[str], number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """A numbered page from 1, and the count that a pager shows."""
    return page(df, order, (number - 1) * size, number * size), df.agg(F.count("*").alias("n"))


def first(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*terms(*order)).limit(1)


def last(df: DataFrame, *order: str) -> DataFrame:
    return first(df, *(o[1:] if o.startswith("-") else f"-{o}" for o in order))


def exists(df: DataFrame) -> DataFrame:
    """One row: whether there is any."""
    return df.limit(1).agg((F.count("*") > 0).alias("exists"))


def distinct_on(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row in ``order`` for each value of ``by``.

    A minimum (or, of descending orders, a maximum) over (order, row) sums up in each task before
    the shuffle, so a value of ``by`` with a third of all rows is one row a task. Orders of mixed
    direction are turned where the descending ones are integers; otherwise a window is
    left.
    """
    down = [o.startswith("-") for o in order]
    names = [o.lstrip("-") for o in order]
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    groups = df.groupBy(*(F.col(b).alias(f"__{b}") for b in by))
    first = lambda least: groups.agg(least.alias("__row")).select("__row.*")
    if not any(down) or all(down):
        rank = F.struct(*(x for n in names for x in (F.col(n).isNull(), F.col(n))))
        return first(F.max_by(row, rank) if down and down[0] else F.min_by(row, rank))
    kinds = [df.schema[n].dataType for n in names]
    turned = ("int", "bigint", "smallint")
    if all(not d or k.simpleString() in turned for d, k in zip(down, kinds, strict=True)):
        rank = [x for d, n in zip(down, names, strict=True) for x in ((F.col(n).isNotNull(), F.bitwise_not(n)) if d else (F.col(n).isNull(), F.col(n)))]
        return first(F.min_by(row, F.struct(*rank)))
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*terms(*order))))
    return ranked.filter("__rn = 1").drop("__rn")


def iterate(df: DataFrame, chunk_size: int):
    """Rows in lists of ``chunk_size``; one partition at a time is on the driver."""
    chunk = []
    for row in df.toLocalIterator():
        chunk.append(row)
        if len(chunk) == chunk_size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """A global row number, counted in ranges of the order."""
    return numbered(df, terms(*order), name)
