"""Applying a stream of changes to a layered table, one snapshot for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes
from ..operators.layer import LayeredTable
from ..sources.snapshots import SnapshotStore
from ..spec import DELETED, ORIGIN, LayerSpec


def latest(batch: DataFrame, pk: str, seq: str) -> DataFrame:
    """The last change of each key: a maximum, summed in each task first, so a hot key is no group."""
    row = F.struct(*(F.col(f"`{c}`") for c in batch.columns))
    return batch.groupBy(F.col(pk).alias("__pk")).agg(F.max_by(row, seq).alias("r")).select("r.*")


def apply_changes(layer: LayeredTable, batch: DataFrame, op: str = "op", seq: str = "seq") -> LayeredTable:
    """Apply rows of declared columns with ``op`` (upsert, delete, reset) and ``seq``; the last of a key counts."""
    spec = layer.spec
    last = latest(batch, spec.pk, seq)
    keys = last.select(F.col(spec.pk).alias("__changed"))
    kept = layer.base.join(keys, F.col(spec.pk) == F.col("__changed"), "left_anti")
    upserts = last.filter(F.col(op) == "upsert").select(*spec.columns)
    if not spec.overridable:
        theirs = layer.source_only().withColumn(ORIGIN, F.lit("source"))
        changes.refuse_source_rows(layer, theirs.join(upserts.select(F.col(spec.pk).alias("__u")), F.col(spec.pk) == F.col("__u"), "left_semi"))
    stored = upserts.withColumn(DELETED, F.lit(False)) if spec.soft_delete else upserts
    deletes = layer.replaced(kept if spec.soft_delete else layer.base)
    gone = last.filter(F.col(op) == "delete").select(spec.pk)
    if spec.soft_delete:
        # The row as it was seen goes into the tombstone, so the deletion reads the base before the change.
        tombs = changes.delete(layer, gone).base.filter(DELETED).join(gone.select(F.col(spec.pk).alias("__g")), F.col(spec.pk) == F.col("__g"), "left_semi")
        kept = deletes.base.unionByName(tombs.select(*layer.base.columns))
    return layer.replaced(kept.unionByName(stored.select(*layer.base.columns)))


def stream_into(changes_stream: DataFrame, store: SnapshotStore, spec: LayerSpec, source: DataFrame, checkpoint: str, **trigger):
    """Start a query that publishes a version for each micro-batch; a batch that is replayed is published once."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        version = store.version()
        if store.manifest(version).get("batch", -1) >= batch_id:
            return
        layer = apply_changes(store.layer(spec, source, version), batch)
        store.publish(layer.base, version, batch=batch_id)

    return changes_stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
