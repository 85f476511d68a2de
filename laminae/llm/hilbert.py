"""Sharding by a Hilbert curve over quantised metadata.

Rows are ordered by the Hilbert index of several metadata dimensions and the order is cut into runs
of equal row counts, so a shard (and a file in it) covers a small box of every dimension at once and
a filter on any of them skips most files.

A dimension is quantised by cut points taken from all rows: of numbers equal parts by approximate
quantiles, of strings the distinct values themselves, or, where there are more of them than places
on the axis, every so many of them in their order. Whole strings are compared.

Nulls sort before every value of a dimension. Ties on the curve are ordered by a hash of the tie
columns, then of the whole row; rows equal in every column are interchangeable. Rows that repeat
have places of their own. Long texts move once, in the last shuffle, and are never handed to Python.
An empty table gives an empty result. Columns of the table named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .durable import compact, durable

#: Bits of the order given to the curve; the others break ties.
CURVE_BITS = 30


def curve_steps(n: int) -> list[int]:
    """The automaton of the curve in ``n`` dimensions: entry ``state << n | bits`` holds ``next << n | digit``.

    A state is the corner at which a cell is entered and the axis along which it is crossed. The
    cells within a cell follow a Gray code, turned and mirrored by the state.
    """
    mask = (1 << n) - 1
    turn = lambda x, by: ((x << by % n) | (x >> (n - by % n))) & mask
    gray = lambda i: i ^ (i >> 1)
    rank = {gray(i): i for i in range(1 << n)}
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing ones
    corner = lambda i: gray((i - 1) // 2 * 2) if i else 0
    axis = lambda i: 0 if not i else ones(i if i % 2 else i - 1) % n
    out = [0] * (n << (2 * n))
    for entry in range(1 << n):
        for along in range(n):
            for bits in range(1 << n):
                digit = rank[turn(bits ^ entry, n - (along + 1) % n)]
                then = (entry ^ turn(corner(digit), along + 1)) * n + (along + axis(digit) + 1) % n
                out[(entry * n + along) << n | bits] = then << n | digit
    return out


def curve_index(axes: list[Column], bits: int) -> Column:
    """The index along the curve of a point whose axes are longs below ``2**bits``."""
    n = len(axes)
    steps = F.lit(curve_steps(n))

    def step(at: Column, level: Column) -> Column:
        # ``at`` is the index so far, then the state in the lowest byte.
        cell = F.lit(0).cast("long")
        for x in axes:
            cell = F.shiftleft(cell, 1).bitwiseOR(F.call_function("shiftright", x, level).bitwiseAND(F.lit(1)))
        entry = F.element_at(steps, (F.shiftleft(at.bitwiseAND(F.lit(255)), n).bitwiseOR(cell) + 1).cast("int"))
        digit, state = entry.bitwiseAND(F.lit((1 << n) - 1)), F.shiftright(entry, n)
        return F.shiftleft(F.shiftleft(F.shiftright(at, 8), n).bitwiseOR(digit.cast("long")), 8).bitwiseOR(state.cast("long"))

    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.shiftright(F.aggregate(levels, F.lit(0).cast("long"), step), 8)


def reached(value: Column, cuts: list, kind: str) -> Column:
    """How many of the ascending ``cuts`` a value has reached, by halving; 0 for null."""
    if not cuts:
        return F.lit(0)
    table = F.lit(list(cuts)).cast(f"array<{kind}>")
    halves = F.array(*(F.lit(1 << r) for r in range(len(cuts).bit_length() - 1, -1, -1)))
    step = lambda at, half: F.when((at + half <= len(cuts)) & (F.get(table, at + half - 1) <= value), at + half).otherwise(at)
    return F.aggregate(halves, F.lit(0), step)


def number_cuts(rows: DataFrame, columns: list[str], parts: int) -> list[list[int]]:
    """Distinct cut points of each column into about ``parts`` equal parts: one aggregation, ``parts - 1`` numbers a column."""
    if not columns:
        return []
    at = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    row = rows.agg(*(F.percentile_approx(c, at, max(10_000, 8 * parts)).alias(c) for c in columns)).first()
    return [sorted(set(row[c] or [])) for c in columns]


def string_cuts(rows: DataFrame, column: str, parts: int) -> list[str]:
    """All distinct values of a column, or ``parts - 1`` of them at equal distances in their order."""
    values, n = compact(rows.select(F.col(column).alias("v")).filter("v is not null").distinct())
    if n < parts:
        return sorted(r[0] for r in values.collect())
    placed = durable(values.repartitionByRange("v").sortWithinPartitions("v").select("v", F.monotonically_increasing_id().alias("at")))
    before, offsets = 0, []
    for _, first, count in sorted(placed.groupBy(F.shiftright("at", 33).alias("p")).agg(F.min("at"), F.count("*")).collect()):
        offsets.append((first, before))
        before += count
    # An entry for each partition, so a literal: at is a partition's first number and a count within it.
    starts = F.lit([f for f, _ in offsets])
    which = F.size(F.filter(starts, lambda s: s <= F.col("at")))
    rank = F.col("at") - F.get(starts, which - 1) + F.get(F.lit([b for _, b in offsets]), which - 1)
    step = -(-n // (parts - 1))
    return sorted(r[0] for r in placed.filter(rank % step == 0).select("v").collect())


def hilbert_shards(df: DataFrame, dimensions: dict[str, Column], tie: list[Column], n_shards: int, *, parts: int | None = None) -> DataFrame:
    """Add ``hilbert`` (long), ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``dimensions`` are long or string columns. Shards' row counts differ by one at most. What places
    a row is written once, without the row; from it come the cut points of the dimensions, those of
    the order, and a count of each part. Then one shuffle of the rows ranks each part on its own. The
    driver sees cut points and counts alone.
    """
    spark = df.sparkSession
    parts = parts or max(64, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = CURVE_BITS // len(dimensions)
    names = [f"__d{i}" for i in range(len(dimensions))]
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("hilbert", "shard", "slot")]
    places = [c.alias(n) for n, c in zip(names, dimensions.values(), strict=True)]
    places.append(F.shiftrightunsigned(F.xxhash64(*tie), 1 + CURVE_BITS).alias("__tie"))
    narrow = durable(df.select(*places))
    kinds = {n: narrow.schema[n].dataType for n in names}
    strings = [n for n in names if isinstance(kinds[n], T.StringType)]
    numbers = [n for n in names if n not in strings]
    cuts = dict(zip(numbers, number_cuts(narrow, numbers, 1 << bits), strict=True)) | {n: string_cuts(narrow, n, 1 << bits) for n in strings}
    # Fewer values than places are spread over the axis.
    place = lambda n: F.floor(reached(F.col(n), cuts[n], kinds[n].simpleString()) * ((1 << bits) / (len(cuts[n]) + 1))).cast("long")
    index = curve_index([place(n) for n in names], bits)
    key = F.shiftleft(index, 63 - CURVE_BITS).bitwiseOR(F.col("__tie"))
    keys = durable(narrow.select(key.alias("__key")))
    (edges,) = number_cuts(keys, ["__key"], parts)
    part = reached(F.col("__key"), edges, "bigint")
    counts = dict(keys.groupBy(part.alias("__part")).count().collect())
    total, before, starts = sum(counts.values()), 0, []
    for p in range(len(edges) + 1):
        starts.append(before)
        before += counts.get(p, 0)
    rows = df.select(F.struct(*keep).alias("__row"), *places)
    keyed = rows.select("__row", key.alias("__key")).withColumn("__part", part)
    inside = Window.partitionBy("__part").orderBy("__key", F.xxhash64("__row"))
    rank = F.get(F.lit(starts).cast("array<bigint>"), F.col("__part")) + F.row_number().over(inside) - 1
    shard = F.expr(f"int((__rank * {n_shards}) div {max(total, 1)})")
    return (
        keyed.withColumn("__rank", rank)
        .withColumn("__shard", shard)
        .select(
            "__row.*",
            F.shiftright("__key", 63 - CURVE_BITS).alias("hilbert"),
            F.col("__shard").alias("shard"),
            F.expr(f"__rank - (__shard * {total} + {n_shards - 1}) div {n_shards}").alias("slot"),
        )
    )


def document_shards(docs: DataFrame, n_shards: int) -> DataFrame:
    """Documents sharded by language, source and size, the three dimensions that corpus readers filter on.

    A null text has size 0. Rows of one place on the curve are dealt by doc_id and text.
    """
    dimensions = {
        "lang": F.col("lang").cast("string"),
        "source": F.col("source").cast("string"),
        "size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"),
    }
    return hilbert_shards(docs, dimensions, [F.col("doc_id"), F.crc32("text")], n_shards)
