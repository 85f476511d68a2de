"""The merged relation and the slices of it by origin."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import LayerConfigError
from ..functions.ids import source_key, view_key
from ..functions.predicates import distinct_from
from ..spec import DELETED, ORIGIN, LayerSpec


@dataclass(frozen=True)
class LayeredTable:
    """``base`` holds the declared columns (and the deletion flag under soft delete), ``source_table`` the vendor's rows."""

    spec: LayerSpec
    base: DataFrame
    source_table: DataFrame
    #: Base rows that hide source rows where ``base`` is only a part of them.
    hiders: DataFrame | None = None
    #: The view, where the change that made ``base`` can say it in fewer joins than ``base`` and source can.
    shown: DataFrame | None = None

    def __post_init__(self) -> None:
        spec = self.spec
        want = set(spec.columns) | ({DELETED} if spec.soft_delete else set())
        if missing := want - set(self.base.columns):
            raise LayerConfigError(f"{spec.name}: the base lacks {sorted(missing)}")
        spec.check_key_type(self.base.schema[spec.pk].dataType)
        for column in spec.columns:
            named = spec.source.id_column if column == spec.pk else column
            if named not in self.source_table.columns:
                raise LayerConfigError(f"{spec.name}: the source lacks {named}")
            mine, theirs = self.base.schema[column].dataType, self.source_table.schema[named].dataType
            # A cast on a key would keep filters out of the scan, and Spark would widen in silence.
            if mine != theirs:
                raise LayerConfigError(f"{spec.name}.{column}: {mine.simpleString()} in the base, {theirs.simpleString()} in the source")

        # Conditions are read against both layers, so they may name the declared columns alone, the key aside.
        named = self.base.select(*(F.col(f"`{c}`") for c in spec.columns if c != spec.pk))
        for condition in (u.condition for u in spec.unique if u.condition):
            try:
                named.filter(F.expr(condition))
            except AnalysisException as e:
                raise LayerConfigError(f"{spec.name}: condition {condition!r}: {str(e).splitlines()[0]}") from e

    # -- the two sides

    def _mapped(self, rows: DataFrame) -> DataFrame:
        spec = self.spec
        key = view_key(spec, F.col(f"`{spec.source.id_column}`")).cast(self.base.schema[spec.pk].dataType)
        return rows.select(*(key.alias(c) if c == spec.pk else F.col(f"`{c}`") for c in spec.columns))

    def source(self, filtered: bool = True) -> DataFrame:
        """Vendor rows under vendor ids; unfiltered, also those that ``extra_where`` hides."""
        where = self.spec.source.extra_where
        return self.source_table.filter(F.expr(where)) if where and filtered else self.source_table

    def mapped_source(self, filtered: bool = True) -> DataFrame:
        """Source rows as the view would show them, hidden or not."""
        return self._mapped(self.source(filtered))

    def live_base(self) -> DataFrame:
        rows = self.base.filter(~F.col(DELETED)) if self.spec.soft_delete else self.base
        return rows.select(*(F.col(f"`{c}`") for c in self.spec.columns))

    def tombstones(self) -> DataFrame:
        return self.base.filter(DELETED) if self.spec.soft_delete else self.base.filter(F.lit(False))

    def _hiding(self) -> DataFrame | None:
        """Keys of the base rows that hide a source row."""
        kind = self.spec.anti_join
        if kind is None:
            return None
        base = self.base if self.hiders is None else self.hiders
        return (base if kind == "full" else base.filter(DELETED)).select(F.col(self.spec.pk).alias("__hidden"))

    def source_only(self) -> DataFrame:
        """Source rows that no base row hides."""
        rows, hiding = self.mapped_source(), self._hiding()
        # An equi anti-join on a key that is never null: hashed, broadcast while the base is small.
        return rows if hiding is None else rows.join(hiding, F.col(self.spec.pk) == F.col("__hidden"), "left_anti")

    def base_only(self) -> DataFrame:
        """Live base rows; the source is not read."""
        return self.live_base()

    # -- the merged view

    @cached_property
    def view(self) -> DataFrame:
        """Origin first, then the declared columns. A filter on the origin prunes a whole branch, but of a change not yet published."""
        if self.shown is not None:
            return self.shown
        base = self.live_base().withColumn(ORIGIN, F.lit("base"))
        source = self.source_only().withColumn(ORIGIN, F.lit("source"))
        return base.unionByName(source).select(ORIGIN, *(F.col(f"`{c}`") for c in self.spec.columns))

    def rows(self) -> DataFrame:
        """The view without its origin."""
        return self.view.drop(ORIGIN)

    def with_origin(self, alias: str = "overlay_origin") -> DataFrame:
        if alias in self.spec.columns:
            raise LayerConfigError(f"{alias} is a column of {self.spec.name}")
        return self.view.withColumnRenamed(ORIGIN, alias)

    def register(self) -> str:
        """Make the view a temporary view for SQL; returns its name."""
        self.view.createOrReplaceTempView(self.spec.view_name)
        return self.spec.view_name

    def overridden(self) -> DataFrame:
        """Live base rows with a source row behind them, one that ``extra_where`` hides included."""
        keys = self.mapped_source(filtered=False).select(F.col(self.spec.pk).alias("__behind"))
        return self.live_base().join(keys, F.col(self.spec.pk) == F.col("__behind"), "left_semi")

    def organic(self) -> DataFrame:
        """Live base rows without a source row behind them."""
        keys = self.mapped_source(filtered=False).select(F.col(self.spec.pk).alias("__behind"))
        return self.live_base().join(keys, F.col(self.spec.pk) == F.col("__behind"), "left_anti")

    # -- by key

    def by_pk(self, values: list, partition_values: list | None = None) -> DataFrame:
        """Rows of the view with these keys. The predicate is mapped to vendor ids, so it reaches both scans.

        ``partition_values`` say in which partitions of the source rows of these keys are, so that no other is read.
        """
        spec = self.spec
        ids = [-v if spec.strategy.negates_source else v for v in values]
        theirs = self.source_table.filter(F.col(f"`{spec.source.id_column}`").isin(ids))
        theirs = theirs if partition_values is None else theirs.filter(self._inside(partition_values))
        return LayeredTable(spec, self.base.filter(F.col(spec.pk).isin(values)), theirs).view

    def _inside(self, partition_values: list) -> Column:
        key = self.spec.source.partition_key
        if key is None:
            raise LayerConfigError(f"{self.spec.name} declares no partition key")
        return F.col(f"`{key}`").isin(partition_values)

    def narrowed(self, partition_values: list) -> LayeredTable:
        """The layer within some partitions of its source.

        Live base rows and source rows are filtered on the declared key. What hides a source row is
        the whole base: an override that has moved to another partition hides its source row still.
        """
        inside = self._inside(partition_values)
        return LayeredTable(self.spec, self.base.filter(inside), self.source_table.filter(inside), self.base if self.hiders is None else self.hiders)

    def view_pk_for(self, source_id: Column) -> Column:
        return view_key(self.spec, source_id)

    def source_pk_for(self, view_id: Column) -> Column:
        return source_key(self.spec, view_id)

    def source_rows_behind(self, keys: DataFrame | None = None) -> DataFrame:
        """``pk, source_row``: the vendor row behind each base key (or given key), null without one; masked rows have theirs too."""
        pk = self.spec.pk
        keys = (self.base if keys is None else keys).select(F.col(pk).alias("__pk"))
        behind = self.source().withColumn("__view_id", view_key(self.spec, F.col(f"`{self.spec.source.id_column}`")))
        packed = behind.select("__view_id", F.struct(*(F.col(f"`{c}`") for c in self.source_table.columns)).alias("source_row"))
        return keys.join(packed, F.col("__pk") == F.col("__view_id"), "left").select(F.col("__pk").alias(pk), "source_row")

    def edit_diff(self) -> DataFrame:
        """``pk, changed``: for each overridden row the columns in which it differs from its source row."""
        spec = self.spec
        theirs = self.mapped_source()
        theirs = theirs.select(*(F.col(f"`{c}`").alias(f"__s_{c}") for c in spec.columns))
        both = self.live_base().join(theirs, F.col(spec.pk) == F.col(f"__s_{spec.pk}"))
        changed = [F.when(distinct_from(F.col(f"`{c}`"), F.col(f"`__s_{c}`")), F.lit(c)) for c in spec.columns if c != spec.pk]
        return both.select(spec.pk, F.array_compact(F.array(*changed)).alias("changed"))

    def replaced(self, base: DataFrame, shown: DataFrame | None = None) -> LayeredTable:
        """The layer with another base, and the view that it makes where that is known."""
        if self.hiders is not None:
            raise LayerConfigError(f"{self.spec.name}: a narrowed layer is read, not written")
        return LayeredTable(self.spec, base, self.source_table, shown=shown)
