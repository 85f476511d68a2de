"""Writes as pure functions from a layer and a change to the layer's next base.

Spark tables of Parquet have no row updates, so every operator returns a ``Change``: the next base,
and the events that an observer of the base would see, in DataFrames that nothing has computed yet.
Publishing is the snapshot store's work.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IntegrityViolation, LayerConfigError, MultipleRows, NotOverridable, RedundantUpdate
from ..functions.ids import with_new_keys
from ..functions.predicates import any_distinct, excluded
from ..spec import DELETED, ORIGIN, RedundantPolicy
from .layer import LayeredTable


@dataclass(frozen=True)
class Change:
    """``layer`` has the next base; ``events`` are rows ``pk, op``; ``matched`` are the keys the change was for."""

    layer: LayeredTable
    events: DataFrame
    matched: DataFrame

    @property
    def base(self) -> DataFrame:
        return self.layer.base

    def count(self) -> int:
        """Rows matched, those that a policy skipped included."""
        return self.matched.count()


def _stored(layer: LayeredTable, rows: DataFrame, deleted: bool = False) -> DataFrame:
    """Rows of declared columns as the base stores them."""
    return (rows.withColumn(DELETED, F.lit(deleted)) if layer.spec.soft_delete else rows).select(*layer.base.columns)


def _keys(df: DataFrame, pk: str) -> DataFrame:
    return df.select(F.col(pk).alias("__changed"))


def _without(base: DataFrame, keys: DataFrame, pk: str) -> DataFrame:
    return base.join(_keys(keys, pk), F.col(pk) == F.col("__changed"), "left_anti")


def _flagged(layer: LayeredTable, where: Column | DataFrame) -> DataFrame:
    """All rows of the view, with ``__hit``: whether ``where`` selects them."""
    if isinstance(where, Column):
        return layer.view.withColumn("__hit", F.coalesce(where, F.lit(False)))
    key = F.col(where.columns[0])
    # Text is compared with numbers as a number, so it is made one before repeats are dropped.
    if layer.spec.strategy.integer and where.dtypes[0][1] == "string":
        key = key.cast("bigint")
    keys = where.select(key.alias("__changed")).distinct().withColumn("__in", F.lit(True))
    return layer.view.join(keys, F.col(layer.spec.pk) == F.col("__changed"), "left").withColumn("__hit", F.col("__in").isNotNull()).drop("__changed", "__in")


def _shown_base(layer: LayeredTable, shown: DataFrame) -> DataFrame:
    """The base of which ``shown`` is the view: its base rows, and all rows of the base that the view never shows."""
    own = _stored(layer, shown.filter(F.col(ORIGIN) == "base"))
    return layer.base.filter(F.coalesce(F.col(DELETED), F.lit(True))).unionByName(own) if layer.spec.soft_delete else own


def _event(df: DataFrame, pk: str, op: str) -> DataFrame:
    return df.select(pk, F.lit(op).alias("op"))


def insert(layer: LayeredTable, rows: DataFrame, order_by: list[str] | None = None, verify: bool = True) -> Change:
    """Add rows; null keys are generated, in ``order_by``'s order where keys are a sequence.

    A key that the base holds, a tombstone's included, is refused. A source row's key makes an
    override, or is refused where source rows cannot be overridden. Generated keys are written once,
    so the keys of ``matched`` are those of the layer that follows.
    """
    keyed = _keyed(layer, rows, order_by, verify)
    return Change(layer.replaced(layer.base.unionByName(_stored(layer, keyed))), _event(keyed, layer.spec.pk, "insert"), keyed.select(layer.spec.pk))


def _keyed(layer: LayeredTable, rows: DataFrame, order_by: list[str] | None = None, verify: bool = True) -> DataFrame:
    """Rows to insert, verified, with all declared columns and their keys."""
    spec = layer.spec
    if spec.pk not in rows.columns:
        rows = rows.withColumn(spec.pk, F.lit(None).cast(layer.base.schema[spec.pk].dataType))
    if missing := set(spec.columns) - set(rows.columns):
        rows = rows.withColumns({c: F.lit(None).cast(layer.base.schema[c].dataType) for c in missing})
    rows = rows.select(*spec.columns)
    given = rows.filter(F.col(spec.pk).isNotNull())
    if verify:
        taken = given.join(_keys(layer.base, spec.pk), F.col(spec.pk) == F.col("__changed"), "left_semi").select(spec.pk)
        twice = given.groupBy(spec.pk).count().filter("count > 1").select(spec.pk)
        if found := taken.unionByName(twice).limit(5).collect():
            raise IntegrityViolation("primary key", spec.name, found)
        if not spec.overridable:
            theirs = given.join(_keys(layer.mapped_source(filtered=False), spec.pk), F.col(spec.pk) == F.col("__changed"), "left_semi")
            if found := theirs.select(spec.pk).limit(5).collect():
                raise NotOverridable(f"{spec.name}: {found} are source rows")
    return with_new_keys(spec, rows, layer.base, order_by or [c for c in spec.columns if c != spec.pk])


def bulk_create(layer: LayeredTable, rows: DataFrame, ignore_conflicts: bool = False, update_conflicts: bool = False, **how) -> Change:
    if ignore_conflicts or update_conflicts:
        raise LayerConfigError("conflicts cannot be ignored or turned into updates on a layered table")
    return insert(layer, rows, **how)


def update(layer: LayeredTable, where: Column | DataFrame, assign: dict[str, Column], policy: RedundantPolicy | None = None) -> Change:
    """Change columns of the view rows that ``where`` selects (a predicate, or a DataFrame of keys).

    Expressions read the row as the view shows it. A source row is first copied into the base as it
    is, then changed, which observers see as two events; a base row takes only the columns that
    differ. The policy says what happens to rows that the update would not change.
    """
    spec, policy = layer.spec, policy or layer.spec.redundant
    if spec.pk in assign:
        raise LayerConfigError(f"{spec.name}: keys are never updated")
    if unknown := set(assign) - set(spec.columns):
        raise LayerConfigError(f"{spec.name}: unknown columns {sorted(unknown)}")
    view = layer.view
    seen = view.filter(where) if isinstance(where, Column) else view.join(_keys(where, where.columns[0]), F.col(spec.pk) == F.col("__changed"), "left_semi")
    new = {f"__n_{c}": e.cast(layer.base.schema[c].dataType) for c, e in assign.items()}
    return _write(layer, seen.withColumns(new), list(assign), policy, _flagged(layer, where).withColumns(new))


def refuse_source_rows(layer: LayeredTable, seen: DataFrame) -> None:
    """Raise where rows of the view that a change would write are source rows that cannot be overridden."""
    if not layer.spec.overridable and (found := seen.filter(F.col(ORIGIN) == "source").select(layer.spec.pk).limit(5).collect()):
        raise NotOverridable(f"{layer.spec.name}: {found} are source rows")


def _write(layer: LayeredTable, seen: DataFrame, assign: list[str], policy: RedundantPolicy, every: DataFrame) -> Change:
    """Write view rows ``seen``, which hold the new value of each column of ``assign`` as ``__n_<column>``.

    ``every`` are all rows of the view, those of ``seen`` under ``__hit`` with their new values. Where
    all base rows hide, the next view is ``every`` with those values, and the next base its base rows
    and the tombstones: one pass, not a join with the keys for each of base, view and what it hides.
    """
    spec = layer.spec
    compared = [c for c in assign if c not in policy.ignore]
    real = any_distinct((F.col(c), F.col(f"__n_{c}")) for c in compared)
    from_source = F.col(ORIGIN) == "source"
    refuse_source_rows(layer, seen)
    governed = ~real & (from_source if policy.scope == "source_only" else F.lit(True))
    matched = seen.select(spec.pk)
    if policy.mode in ("warn", "raise"):
        idle = seen.filter(governed).select(spec.pk).limit(5).collect()
        if idle and policy.mode == "raise":
            raise RedundantUpdate(f"{spec.name}: {idle} would not change")
        if idle:
            warnings.warn(f"{spec.name}: {idle} would not change and are left as they are", RuntimeWarning, stacklevel=3)
    # To warn is to skip, and say so.
    written = F.lit(True) if policy.mode == "materialize" else ~governed
    taken = seen.filter(written)
    changed = any_distinct((F.col(c), F.col(f"__n_{c}")) for c in assign)
    events = _event(taken.filter(from_source), spec.pk, "materialize").unionByName(_event(taken.filter(changed), spec.pk, "update"))
    if spec.anti_join == "full":
        hit = every.withColumn("__hit", F.col("__hit") & written)
        values = (F.when(F.col("__hit"), F.col(f"__n_{c}")).otherwise(F.col(f"`{c}`")).alias(c) if c in assign else F.col(f"`{c}`") for c in spec.columns)
        shown = hit.select(F.when(F.col("__hit"), "base").otherwise(F.col(ORIGIN)).alias(ORIGIN), *values)
        base = _shown_base(layer, shown)
        return Change(layer.replaced(base, shown), events, matched)
    result = taken.select(*(F.col(f"__n_{c}").alias(c) if c in assign else F.col(f"`{c}`") for c in spec.columns))
    base = _without(layer.base, taken.select(spec.pk), spec.pk).unionByName(_stored(layer, result))
    return Change(layer.replaced(base), events, matched)


def materialize(layer: LayeredTable, where: Column | DataFrame) -> Change:
    """Copy the selected source rows into the base; base rows stay as they are."""
    spec = layer.spec
    if not spec.overridable:
        raise NotOverridable(f"{spec.name}: source rows cannot be copied into the base")
    rows = layer.source_only()
    rows = rows.filter(where) if isinstance(where, Column) else rows.join(_keys(where, where.columns[0]), F.col(spec.pk) == F.col("__changed"), "left_semi")
    return Change(layer.replaced(layer.base.unionByName(_stored(layer, rows))), _event(rows, spec.pk, "materialize"), rows.select(spec.pk))


def delete(layer: LayeredTable, where: Column | DataFrame) -> Change:
    """Delete view rows.

    Hard delete drops base rows, and a source row behind one shows again; rows of the source alone
    stay. Soft delete leaves a tombstone with the row's values where a source row of that key exists
    (whether or not ``extra_where`` hides it), and drops the base row outright where none does.
    """
    spec = layer.spec
    view = layer.view
    seen = view.filter(where) if isinstance(where, Column) else view.join(_keys(where, where.columns[0]), F.col(spec.pk) == F.col("__changed"), "left_semi")
    gone = seen.select(*spec.columns)
    # Where all base rows hide, what stays of the view is the view that follows.
    left = None
    if spec.soft_delete and spec.anti_join == "full":
        left = view.filter(excluded(where)) if isinstance(where, Column) else view.join(_keys(where, where.columns[0]), F.col(spec.pk) == F.col("__changed"), "left_anti")
    base = _without(layer.base, gone, spec.pk) if left is None else _shown_base(layer, left)
    if not spec.soft_delete:
        dropped = seen.filter("_overlay_origin = 'base'")
        return Change(layer.replaced(base), _event(dropped, spec.pk, "delete"), seen.select(spec.pk))
    behind = _keys(layer.mapped_source(filtered=False), spec.pk)
    marked = gone.join(behind, F.col(spec.pk) == F.col("__changed"), "left_semi")
    dropped = gone.join(behind, F.col(spec.pk) == F.col("__changed"), "left_anti")
    events = _event(marked, spec.pk, "tombstone").unionByName(_event(dropped, spec.pk, "delete"))
    return Change(layer.replaced(base.unionByName(_stored(layer, marked, True)), left), events, seen.select(spec.pk))


def reset_to_source(layer: LayeredTable, keys: DataFrame) -> Change:
    """Drop the base rows of some keys, tombstones too, so that the source shows through."""
    pk = layer.spec.pk
    gone = layer.base.join(_keys(keys, keys.columns[0]), F.col(pk) == F.col("__changed"), "left_semi")
    return Change(layer.replaced(_without(layer.base, keys, keys.columns[0]) if keys.columns[0] == pk else _without(layer.base, keys.toDF(pk), pk)), _event(gone, pk, "reset"), gone.select(pk))


def _once(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row for each combination of ``by`` values, nulls equal nulls: of rows that repeat them the greatest by the other columns."""
    others = [c for c in rows.columns if c not in by]
    if not others:
        return rows.distinct()
    return rows.groupBy(*by).agg(F.max(F.struct(*others)).alias("__r")).select(*by, "__r.*").select(*rows.columns)


def _named_twice(seen: DataFrame, columns: list[str], name: str) -> None:
    if found := seen.groupBy(*columns).count().filter("count > 1").limit(5).collect():
        raise MultipleRows(f"{name}: {found}")


def get_or_create(layer: LayeredTable, rows: DataFrame, by: list[str], **how) -> Change:
    """Insert the rows whose ``by`` values no view row has, once for each; source rows count as present."""
    return insert(layer, _absent(layer, _once(rows, by), by), **how)


def _absent(layer: LayeredTable, rows: DataFrame, by: list[str]) -> DataFrame:
    present = layer.rows().select(*(F.col(c).alias(f"__b_{c}") for c in by))
    return rows.join(present, [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in by], "left_anti")


def update_or_create(layer: LayeredTable, rows: DataFrame, by: list[str], policy: RedundantPolicy | None = None, **how) -> Change:
    """Set the other columns of ``rows`` on the view rows with their ``by`` values; insert the rest.

    Of rows that repeat their ``by`` values one counts. Several view rows of one combination are
    refused, and so are source rows that cannot be overridden. Rows that would not change follow the
    policy, as in ``update``.
    """
    spec, policy = layer.spec, policy or layer.spec.redundant
    rows = _once(rows, by)
    values = [c for c in rows.columns if c not in by and c != spec.pk]
    wanted = rows.select(*(F.col(c).alias(f"__w_{c}") for c in by), *(F.col(c).cast(layer.base.schema[c].dataType).alias(f"__n_{c}") for c in values))
    same = [F.col(c).eqNullSafe(F.col(f"__w_{c}")) for c in by]
    found = layer.view.join(wanted, same).drop(*(f"__w_{c}" for c in by))
    _named_twice(found, by, spec.name)
    keyed = _keyed(layer, _absent(layer, rows, by), **how)
    every = layer.view.join(wanted.withColumn("__in", F.lit(True)), same, "left").withColumn("__hit", F.col("__in").isNotNull())
    written = _write(layer, found, values, policy, every)
    events = _event(keyed, spec.pk, "insert").unionByName(written.events)
    matched = keyed.select(spec.pk).unionByName(written.matched)
    if written.layer.shown is not None and spec.pk not in rows.columns:
        # New keys are no other row's, so the new rows stand beside those written.
        shown = written.layer.view.unionByName(keyed.withColumn(ORIGIN, F.lit("base")))
        return Change(layer.replaced(written.base.unionByName(_stored(layer, keyed)), shown), events, matched)
    base = layer.base.unionByName(_stored(layer, keyed)).join(_keys(written.matched, spec.pk), F.col(spec.pk) == F.col("__changed"), "left_anti")
    base = base.unionByName(written.base.join(_keys(written.matched, spec.pk), F.col(spec.pk) == F.col("__changed"), "left_semi"))
    return Change(layer.replaced(base), events, matched)


def three_way_merge(layer: LayeredTable, edits: DataFrame) -> Change:
    """Apply rows ``pk, old, new`` (structs of columns as read and as wanted) to the current view.

    Only columns that an editor changed are written, so edits of different columns of one row, made
    from one snapshot, both survive; of edits to one column the last ``seq`` wins.
    """
    spec = layer.spec
    columns = [c for c in edits.schema["new"].dataType.names if c != spec.pk]
    differs = lambda c: any_distinct([(F.col(f"old.{c}"), F.col(f"new.{c}"))])
    last = edits.groupBy(F.col(spec.pk).alias("__pk")).agg(
        *(F.max_by(F.when(differs(c), F.struct(F.col(f"new.{c}").alias("v"))), F.when(differs(c), F.col("seq"))).alias(f"__e_{c}") for c in columns)
    )
    rows = layer.view.join(last, F.col(spec.pk) == F.col("__pk"))
    refuse_source_rows(layer, rows)
    merged = rows.select(
        *(F.when(F.col(f"__e_{c}").isNotNull(), F.col(f"__e_{c}.v")).otherwise(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in spec.columns)
    )
    base = _without(layer.base, merged, spec.pk).unionByName(_stored(layer, merged))
    return Change(layer.replaced(base), _event(merged, spec.pk, "update"), merged.select(spec.pk))


def select_for_update(*_args, **_kwargs):
    raise LayerConfigError("rows are not locked; publishing checks the snapshot that a change was made from")
