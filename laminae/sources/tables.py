"""Sources and plain tables as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def catalog(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def switchable(resolve: Callable[[], DataFrame]) -> DataFrame:
    """A source that is decided when the layer is built, by tenant or by release."""
    return resolve()


def serialize(df: DataFrame) -> DataFrame:
    """Each row as JSON, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def deserialize(df: DataFrame, schema) -> DataFrame:
    return df.select(F.from_json("json", schema).alias("r")).select("r.*")


def layout(df: DataFrame) -> DataFrame:
    """Files a table is read from, with their rows: where an index report would stand."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))
