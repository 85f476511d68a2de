"""Handing rows of unbounded width to Python in batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What a batch holds, unless the session says otherwise; a single longer row is a batch of its own.
DEFAULT_BYTES = 4 << 20


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` with batches limited by bytes: ten thousand texts or sets would be too many."""
    conf = df.sparkSession.conf
    conf.set(BATCH_BYTES, conf.get(BATCH_BYTES, str(DEFAULT_BYTES)))
    return df.mapInArrow(run, schema)
