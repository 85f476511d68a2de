"""Looking at physical plans: what a query reads, shuffles and joins."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

OPERATORS = re.compile(r"\b(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct|Exchange|Window|Sort|TakeOrderedAndProject|FileScan \w+|Scan \w+)\b")


def text(df: DataFrame) -> str:
    """The executed plan, before adaptive changes."""
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> Counter:
    return Counter(OPERATORS.findall(text(df)))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", text(df))


def read_schemas(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", text(df))
