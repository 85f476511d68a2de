"""Deleting through relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IntegrityViolation
from ..sources.settle import settled
from ..spec import Relation
from . import changes
from .layer import LayeredTable


def _naming(child: LayeredTable, column: str, keys: DataFrame) -> DataFrame:
    """Keys of the child rows that name one of ``keys``."""
    return child.rows().join(keys.select(F.col(keys.columns[0]).alias("__k")), F.col(column) == F.col("__k"), "left_semi").select(child.spec.pk)


def _but(keys: DataFrame, known: DataFrame | None) -> DataFrame:
    if known is None:
        return keys
    pk = keys.columns[0]
    return keys.join(known.select(F.col(known.columns[0]).alias("__known")), F.col(pk) == F.col("__known"), "left_anti")


#: Steps whose keys are kept apart before they are written as one.
STEPS = 8


def doomed_keys(layers: dict[str, LayeredTable], relations: list[Relation], table: str, keys: DataFrame) -> dict[str, DataFrame]:
    """The keys, by table, that go when ``keys`` of ``table`` go and ``cascade`` relations are followed to the end.

    A step adds only keys that were not there, so relations may form loops. Its keys are written
    once, so a step costs its own rows and not those before it; steps are as many as the longest
    chain of referring rows. A relation that is followed again has its keys written, narrow, first.
    """
    start = layers[table].rows().join(keys.select(F.col(keys.columns[0]).alias("__k")), F.col(layers[table].spec.pk) == F.col("__k"), "left_semi")
    found = {table: settled(start.select(layers[table].spec.pk))}
    doomed: dict[str, list[DataFrame]] = {name: [k] for name, k in found.items()}
    refs: dict[tuple[str, str], DataFrame] = {}
    written: set[tuple[str, str]] = set()
    together = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    while found:
        fresh, found = found, {}
        for r in relations:
            if r.on_delete != "cascade" or r.to_table not in fresh or r.from_table not in layers:
                continue
            child, at = layers[r.from_table], (r.from_table, r.column)
            if at not in refs:
                refs[at] = child.rows().select(child.spec.pk, r.column)
            elif at not in written:
                refs[at] = settled(refs[at])
                written.add(at)
            named = refs[at].join(fresh[r.to_table].select(F.col(fresh[r.to_table].columns[0]).alias("__k")), F.col(r.column) == F.col("__k"), "left_semi")
            known = [*doomed.get(r.from_table, ()), *([found[r.from_table]] if r.from_table in found else [])]
            named = named.select(child.spec.pk)
            named = settled(_but(named, together(known)) if known else named)
            if not named.isEmpty():
                found[r.from_table] = found[r.from_table].unionByName(named) if r.from_table in found else named
        for name, more in found.items():
            parts = [*doomed.get(name, ()), more]
            doomed[name] = [settled(together(parts).coalesce(8))] if len(parts) > STEPS else parts
    return {name: settled(together(parts).coalesce(8)) if len(parts) > 1 else parts[0] for name, parts in doomed.items()}


def delete_cascade(layers: dict[str, LayeredTable], relations: list[Relation], table: str, keys: DataFrame) -> dict[str, LayeredTable]:
    """Delete view rows of ``table`` and all that goes with them; the layers that follow.

    Rows that stay and name a row that goes are refused under ``protect`` and cleared under
    ``set_null``; ``do_nothing`` leaves them to the checks of a commit.
    """
    out, doomed = dict(layers), doomed_keys(layers, relations, table, keys)
    for r in relations:
        if r.to_table not in doomed or r.from_table not in layers or r.on_delete not in ("protect", "set_null"):
            continue
        named = _but(_naming(layers[r.from_table], r.column, doomed[r.to_table]), doomed.get(r.from_table))
        if r.on_delete == "set_null":
            child = out[r.from_table]
            null = F.lit(None).cast(child.base.schema[r.column].dataType)
            out[r.from_table] = changes.update(child, named, {r.column: null}).layer
        elif found := named.limit(5).collect():
            raise IntegrityViolation("foreign key", f"{r.from_table}.{r.column} protects {r.to_table}", found)
    for name, gone in doomed.items():
        out[name] = changes.delete(out[name], gone).layer
    return out
