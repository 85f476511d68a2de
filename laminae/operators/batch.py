"""Several changes published as one.

Uniqueness and checks hold after each operation, references when the batch commits, so a row may be
inserted and deleted again within one. Only what a batch changes is checked: rows that are new to
the view or have other values in the columns of a constraint, and keys that have left the view.
What was wrong before and is not touched does not stop a change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IntegrityViolation
from ..spec import Relation
from . import integrity
from .changes import Change
from .layer import LayeredTable


class Batch:
    """Changes to some layers. ``plain`` are tables that are not layered but named by relations."""

    def __init__(self, layers: dict[str, LayeredTable], relations: list[Relation] = (), plain: dict[str, DataFrame] | None = None) -> None:
        self.before, self.layers, self.relations, self.plain = dict(layers), dict(layers), list(relations), plain or {}

    def apply(self, table: str, operation: Callable[..., Change], *args, **how) -> Change:
        before = self.layers[table]
        change = operation(before, *args, **how)
        layer = change.layer
        for unique in layer.spec.unique:
            changed = integrity.changed_rows(before, layer, integrity.watched_columns(layer, unique))
            for what, rows in (("in the base", integrity.base_duplicates(layer, unique, changed)), ("with the source", integrity.source_collisions(layer, unique, changed))):
                if found := rows.limit(5).collect():
                    raise IntegrityViolation("unique", f"{table} {unique.columns} {what}", found)
        for condition in layer.spec.checks:
            changed = integrity.changed_rows(before, layer, list(layer.spec.columns))
            if found := integrity.failed_checks(layer, condition, changed).limit(5).collect():
                raise IntegrityViolation("check", f"{table}: {condition}", found)
        self.layers[table] = layer
        return change

    def _changed(self, table: str) -> bool:
        return table in self.layers and self.layers[table] is not self.before[table]

    def violations(self) -> dict[str, DataFrame]:
        """For each enforced relation whose tables changed, the rows that name nothing.

        ``from.column`` has the changed rows of the referring base, ``from.column (deleted)`` all
        rows that name a key which has left the view; a relation of a table to itself has both.
        """
        out = {}
        for r in (r for r in self.relations if r.enforced):
            name = f"{r.from_table}.{r.column}"
            target = self.layers[r.to_table].rows() if r.to_table in self.layers else self.plain[r.to_table]
            pk = self.layers[r.to_table].spec.pk if r.to_table in self.layers else target.columns[0]
            if self._changed(r.from_table):
                # Source rows are the vendor's: only rows of the base are answered for.
                child = self.layers[r.from_table]
                keys = integrity.changed_rows(self.before[r.from_table], child, [r.column])
                refs = child.live_base().join(keys.select(F.col(child.spec.pk).alias("__c")), F.col(child.spec.pk) == F.col("__c"), "left_semi")
                out[name] = integrity.dangling(refs, r.column, target, pk)
            if self._changed(r.to_table):
                refs = self.layers[r.from_table].rows() if r.from_table in self.layers else self.plain[r.from_table]
                out[f"{name} (deleted)"] = integrity.broken_references(refs, r.column, self.before[r.to_table].rows(), target, pk)
        return out

    def commit(self, publish: Callable[[dict[str, LayeredTable]], object] | None = None) -> dict[str, LayeredTable]:
        """Check references on the final state, then hand all changed layers to one call of ``publish``.

        ``SnapshotSet.publish`` makes them visible by one manifest, so that all of a batch is seen or none.
        """
        for name, rows in self.violations().items():
            if found := rows.limit(5).collect():
                raise IntegrityViolation("foreign key", name, found)
        changed = {t: layer for t, layer in self.layers.items() if self._changed(t)}
        if publish is not None and changed:
            publish(changed)
        return self.layers
