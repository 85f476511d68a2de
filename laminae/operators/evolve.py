"""Changing the columns of a layer: a new base under a new declaration, the old snapshot untouched."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IntegrityViolation, LayerConfigError
from ..spec import ORIGIN, LayerSpec, Unique
from . import integrity
from .layer import LayeredTable


def columns_in_view_order(existing: list[str], spec: LayerSpec) -> list[str]:
    """Origin first, then the columns a deployed view has, in its order, then new ones as declared."""
    kept = [c for c in existing if c in spec.columns]
    return [ORIGIN, *kept, *(c for c in spec.columns if c not in kept)]


def add_column(layer: LayeredTable, name: str, default: Column, source: DataFrame) -> LayeredTable:
    """Declare a column that the (new) source has; base rows get ``default``."""
    if name in layer.spec.columns:
        raise LayerConfigError(f"{layer.spec.name}.{name} is there already")
    spec = replace(layer.spec, columns=(*layer.spec.columns, name))
    base = layer.base.withColumn(name, default.cast(source.schema[name].dataType))
    return LayeredTable(spec, base, source)


def drop_column(layer: LayeredTable, name: str) -> LayeredTable:
    if name == layer.spec.pk or any(name in u.columns for u in layer.spec.unique):
        raise LayerConfigError(f"{layer.spec.name}.{name} is a key or part of a constraint")
    spec = replace(layer.spec, columns=tuple(c for c in layer.spec.columns if c != name))
    return LayeredTable(spec, layer.base.drop(name), layer.source_table)


def rename_column(layer: LayeredTable, old: str, new: str, source: DataFrame) -> LayeredTable:
    if old == layer.spec.pk:
        raise LayerConfigError(f"{layer.spec.name}: keys are not renamed")
    word = rf"\b{re.escape(old)}\b"
    unique = tuple(
        replace(u, columns=tuple(new if c == old else c for c in u.columns), condition=u.condition and re.sub(word, new, u.condition)) for u in layer.spec.unique
    )
    spec = replace(layer.spec, columns=tuple(new if c == old else c for c in layer.spec.columns), unique=unique)
    return LayeredTable(spec, layer.base.withColumnRenamed(old, new), source)


def alter_type(layer: LayeredTable, name: str, kind: str, source: DataFrame) -> LayeredTable:
    """Change a column's type on both sides at once; a base value that the new type cannot hold is an error when read."""
    return LayeredTable(layer.spec, layer.base.withColumn(name, F.col(name).cast(kind)), source)


def add_unique(layer: LayeredTable, unique: Unique) -> LayeredTable:
    """Declare a constraint on a layer in use. Rows of the base that break it, among themselves or with the source, refuse it."""
    out = LayeredTable(replace(layer.spec, unique=(*layer.spec.unique, unique)), layer.base, layer.source_table)
    for what, rows in (("in the base", integrity.base_duplicates(out, unique)), ("with the source", integrity.source_collisions(out, unique))):
        if found := rows.limit(5).collect():
            raise IntegrityViolation("unique", f"{layer.spec.name} {unique.columns} {what}", found)
    return out


def drop_unique(layer: LayeredTable, columns: tuple[str, ...]) -> LayeredTable:
    left = tuple(u for u in layer.spec.unique if u.columns != tuple(columns))
    if len(left) == len(layer.spec.unique):
        raise LayerConfigError(f"{layer.spec.name}: no constraint on {columns}")
    return LayeredTable(replace(layer.spec, unique=left), layer.base, layer.source_table)


def add_check(layer: LayeredTable, condition: str) -> LayeredTable:
    """Declare a check on a layer in use; live base rows that fail it refuse it."""
    if found := integrity.failed_checks(layer, condition).limit(5).collect():
        raise IntegrityViolation("check", f"{layer.spec.name}: {condition}", found)
    return LayeredTable(replace(layer.spec, checks=(*layer.spec.checks, condition)), layer.base, layer.source_table)


def drop_check(layer: LayeredTable, condition: str) -> LayeredTable:
    if condition not in layer.spec.checks:
        raise LayerConfigError(f"{layer.spec.name}: no check {condition!r}")
    return LayeredTable(replace(layer.spec, checks=tuple(c for c in layer.spec.checks if c != condition)), layer.base, layer.source_table)
