"""A deterministic graph of layered entities and links, generated in the tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layer import LayeredTable
from ..spec import DELETED, LayerSpec, Strategy


@dataclass(frozen=True)
class GraphSizes:
    people: int = 10_000
    addresses: int = 8_000
    phones: int = 7_000
    person_address: int = 15_000
    person_phone: int = 12_000
    base_share: float = 0.4

    def scaled(self, by: float) -> GraphSizes:
        counts = {n: int(getattr(self, n) * by) for n in ("people", "addresses", "phones", "person_address", "person_phone")}
        return GraphSizes(**counts, base_share=self.base_share)


def _pick(i: Column, salt: int, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(values))) + 1).cast("int"))


def _code(i: Column, salt: int, n: int) -> Column:
    return F.lpad(F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(n)).cast("string"), 5, "0")


COLUMNS = {
    "person": lambda i: {
        "first_name": F.concat(F.lit("first"), _code(i, 1, 1000)),
        "city": F.concat(F.lit("city"), _code(i, 2, 200)),
        "status": _pick(i, 3, ["active", "lapsed", "blocked", "new"]),
        "score": F.pmod(F.xxhash64(i, F.lit(4)), F.lit(100)).cast("int"),
        "born_on": F.date_add(F.lit("1940-01-01").cast("date"), F.pmod(F.xxhash64(i, F.lit(5)), F.lit(25_000)).cast("int")),
    },
    "address": lambda i: {"city": F.concat(F.lit("city"), _code(i, 6, 200)), "country": _pick(i, 7, ["NL", "BE", "DE"])},
    "phone": lambda i: {"number": F.concat(F.lit("+"), _code(i, 8, 100_000)), "kind": _pick(i, 9, ["mobile", "home", "work"])},
}


def entity(spark: SparkSession, name: str, rows: int, base_share: float) -> LayeredTable:
    """An entity layer: of the base rows half override a source row and half are organic."""
    overrides = organic = int(rows * base_share / 2)
    i = F.col("id")
    columns = COLUMNS[name](i)
    spec = LayerSpec(name, ("id", *columns), strategy=Strategy.NEGATIVE_BASE_POSITIVE_SOURCE_ID)
    source = spark.range(1, rows - organic + 1).select("id", *(e.alias(c) for c, e in columns.items()))
    edited = spark.range(1, overrides + 1).select("id", *((F.concat(e, F.lit("*")) if c == "city" else e).alias(c) for c, e in columns.items()))
    own = spark.range(1, organic + 1).select((-i).alias("id"), *(e.alias(c) for c, e in columns.items()))
    return LayeredTable(spec, edited.unionByName(own).withColumn(DELETED, F.lit(False)), source)


def link(spark: SparkSession, rows: int, near: tuple[str, int], far: tuple[str, int], organic_share: float) -> DataFrame:
    """Append-only links between view ids, split between source and organic ends."""

    def end(salt: int, n: int) -> Column:
        organic = int(n * organic_share)
        drawn = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
        return F.when(drawn < organic, -(drawn + 1)).otherwise(drawn - organic + 1)

    return spark.range(rows).select("id", end(11, near[1]).alias(near[0]), end(12, far[1]).alias(far[0]))


def mirror(layer: LayeredTable) -> DataFrame:
    """The plain table with the view's rows: what a merged query is compared with."""
    return layer.rows()
