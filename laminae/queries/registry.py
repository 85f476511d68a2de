"""Where queries and their SQL are kept, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import FIXTURES, plain, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Context:
    """The layers and plain tables of one call."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str):
        """A layer by its name."""
        if name.startswith("_") or name not in FIXTURES:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = FIXTURES[name].layer(self.spark, self.sf_dir)
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        return plain(self.spark, self.sf_dir, name)


def query(name: str, sql: str, *layers: str):
    """Register a function of a ``Context`` with SQL over the expressions of ``layers``."""

    def add(build: Callable[[Context], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Context(spark, sf_dir))

        run.__name__ = name
        QUERIES[name], ORACLES[name] = run, with_ctes(layers, sql)
        return build

    return add
