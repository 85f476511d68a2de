"""Stores, tenants, scans in chunks, changes of declarations, refusals and the report of a swap that cannot be."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..errors import IntegrityViolation, LayerConfigError, NotOverridable, RedundantUpdate
from ..functions import predicates as P
from ..operators import changes as W
from ..operators import evolve as E
from ..operators import page as G
from ..operators import swap as S
from ..operators.batch import Batch
from ..operators.layer import LayeredTable
from ..sources.settle import shared_folder
from ..sources.snapshots import SnapshotSet, SnapshotStore
from ..spec import LayerSpec, RedundantPolicy, Relation, SourceSpec, Strategy, Unique
from .reads import C, n_
from .registry import query

col, lit = F.col, F.lit


def _folder(c, name: str) -> str:
    return f"{shared_folder(c.spark)}/{name}-{uuid.uuid4().hex}"


# -- stores


@query("store_reads_what_was_published", f"SELECT _overlay_origin, {C} FROM people", "people")
def _(c):
    store = SnapshotStore(c.spark, _folder(c, "people"))
    store.publish(c.people.base, 0)
    return store.layer(c.people.spec, c.people.source_table).view


@query("store_truncated_shows_the_source", f"SELECT {C} FROM people_src", "people")
def _(c):
    store = SnapshotStore(c.spark, _folder(c, "people"))
    store.publish(c.people.base, 0)
    store.truncate(c.people.base.schema)
    return store.layer(c.people.spec, c.people.source_table).rows()


@query(
    "tenants_share_a_source",
    "SELECT 'north' AS tenant, count(*) FILTER (WHERE c_nationkey = 4) AS n FROM people UNION ALL SELECT 'south', 0",
    "people",
)
def _(c):
    out = None
    for tenant, base in (("north", c.people.base), ("south", W.delete(c.people, col("c_nationkey") == 4).base)):
        store = SnapshotStore(c.spark, _folder(c, tenant))
        store.publish(base, 0)
        rows = store.layer(c.people.spec, c.people.source_table).rows()
        one = rows.agg(F.count_if(col("c_nationkey") == 4).alias("n")).select(lit(tenant).alias("tenant"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("batch_is_published_whole", "SELECT (SELECT count(*) FROM people WHERE c_nationkey <> 4) AS people, (SELECT count(*) FROM ord WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT id FROM people WHERE c_nationkey = 4)) AS orders", "people", "ord")
def _(c):
    store = SnapshotSet(c.spark, _folder(c, "set"))
    store.publish({"people": c.people, "ord": c.ord}, 0)
    layers = {n: store.layer(x.spec, x.source_table, n) for n, x in (("people", c.people), ("ord", c.ord))}
    work = Batch(layers, [Relation("ord", "o_custkey", "people")])
    gone = layers["people"].rows().filter("c_nationkey = 4").select("id")
    work.apply("ord", W.delete, P.in_keys(layers["ord"].rows(), "o_custkey", gone).select("id"))
    work.apply("people", W.delete, col("c_nationkey") == 4)
    work.relations = [replace(r, enforced=False) for r in work.relations]  # old danglers aside, both sides go together
    work.commit(lambda changed: store.publish(changed, 1))
    people, orders = (store.layer(x.spec, x.source_table).rows().agg(n_()) for x in (c.people, c.ord))
    return people.select(col("n").alias("people")).unionByName(orders.select(col("n").alias("orders")), allowMissingColumns=True).agg(F.max("people").alias("people"), F.max("orders").alias("orders"))


@query("scan_in_chunks", "SELECT CAST(floor((row_number() OVER (ORDER BY id) - 1) / 64) AS INTEGER) AS chunk, id FROM people", "people")
def _(c):
    rows = c.people.rows().select("id").orderBy("id")
    chunks = [(i, r["id"]) for i, chunk in enumerate(G.iterate(rows, 64)) for r in chunk]
    return c.spark.createDataFrame(chunks, f"chunk int, id {rows.schema['id'].dataType.simpleString()}")


# -- declarations of a layer in use


@query("column_added", f"SELECT _overlay_origin, id, CASE WHEN _overlay_origin = 'base' THEN '?' ELSE c_mktsegment END AS city FROM people", "people")
def _(c):
    wider = c.people.source_table.withColumn("city", col("c_mktsegment"))
    return E.add_column(c.people, "city", lit("?"), wider).view.select("_overlay_origin", "id", "city")


@query("column_dropped_renamed_and_widened", "SELECT id, c_name AS title, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM people", "people")
def _(c):
    layer = E.drop_column(c.people, "c_mktsegment")
    layer = E.rename_column(layer, "c_name", "title", layer.source_table.withColumnRenamed("c_name", "title"))
    layer = E.alter_type(layer, "c_nationkey", "bigint", layer.source_table.withColumn("c_nationkey", col("c_nationkey").cast("bigint")))
    return layer.rows().select("id", "title", "c_nationkey")


@query("columns_in_view_order", "SELECT * FROM (VALUES (0, '_overlay_origin'), (1, 'c_acctbal'), (2, 'id'), (3, 'c_name'), (4, 'c_nationkey'), (5, 'c_mktsegment')) t(pos, name)")
def _(c):
    names = E.columns_in_view_order(["_overlay_origin", "c_acctbal", "gone", "id"], c.people.spec)
    return c.spark.createDataFrame(list(enumerate(names)), "pos int, name string")


@query("constraint_added_where_it_holds", "SELECT count(*) > 0 AS refused FROM (SELECT c_name FROM people_base WHERE NOT _overlay_deleted GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT b.c_name FROM people_base b JOIN people s ON s._overlay_origin = 'source' AND s.c_name = b.c_name AND s.id <> b.id WHERE NOT b._overlay_deleted)", "people")
def _(c):
    return _outcome(c, IntegrityViolation, lambda: E.add_unique(c.people, Unique(("c_name",))))


# -- what is refused


def _outcome(c, error: type, change):
    """One row: whether ``change`` raises ``error``."""
    try:
        change()
        refused = False
    except error:
        refused = True
    return c.spark.createDataFrame([(refused,)], "refused boolean")


@query("update_of_fixed_source_rows", "SELECT count(*) > 0 AS refused FROM cust_fixed WHERE _overlay_origin = 'source' AND c_nationkey = 4", "cust_fixed")
def _(c):
    return _outcome(c, NotOverridable, lambda: W.update(c.cust_fixed, col("c_nationkey") == 4, {"c_name": lit("x")}))


@query("redundant_raise", "SELECT count(*) > 0 AS refused FROM people WHERE _overlay_origin = 'source' AND c_nationkey = 3", "people")
def _(c):
    return _outcome(c, RedundantUpdate, lambda: W.update(c.people, col("c_nationkey") == 3, {"c_nationkey": lit(3)}, RedundantPolicy("raise")))


@query("row_locks", "SELECT true AS refused")
def _(c):
    return _outcome(c, LayerConfigError, lambda: W.select_for_update(c.people))


@query("insert_of_taken_keys", "SELECT count(*) > 0 AS refused FROM people_base WHERE c_nationkey = 4", "people")
def _(c):
    rows = c.people.base.filter("c_nationkey = 4").select(*c.people.spec.columns)
    return _outcome(c, IntegrityViolation, lambda: W.insert(c.people, rows))


@query("declarations", "SELECT * FROM (VALUES ('column twice'), ('key unknown'), ('flag not a bool'), ('source missing'), ('condition names the key'), ('condition names a stranger'), ('set null on a required column')) t(refused)")
def _(c):
    cases = {
        "column twice": lambda: LayerSpec("t", ("id", "id")),
        "key unknown": lambda: LayerSpec("t", ("id",), pk="nope"),
        "flag not a bool": lambda: LayerSpec("t", ("id",), soft_delete=1),
        "source missing": lambda: LayerSpec("t", ("id",), source=None),
        "condition names the key": lambda: LayerSpec("t", ("id", "a"), unique=(Unique(("a",), "id > 1"),)),
        "condition names a stranger": lambda: LayeredTable(replace(c.people.spec, unique=(Unique(("c_name",), "stranger > 1"),)), c.people.base, c.people.source_table),
        "set null on a required column": lambda: Relation("a", "b", "c", nullable=False, on_delete="set_null"),
        "fine": lambda: LayerSpec("t", ("id", "a"), unique=(Unique(("a",), "a > 1"),)),
    }
    found = []
    for name, make in cases.items():
        try:
            make()
        except LayerConfigError:
            found.append((name,))
    return c.spark.createDataFrame(found, "refused string")


@query("unenforced_relations_are_not_checked", "SELECT 0 AS checks, count(*) AS dangling FROM ord WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT id FROM people WHERE c_nationkey <> 4)", "ord", "people")
def _(c):
    from ..operators import integrity as I

    work = Batch({"ord": c.ord, "people": c.people}, [Relation("ord", "o_custkey", "people", enforced=False)])
    work.apply("people", W.delete, col("c_nationkey") == 4)
    return I.dangling(c.ord.rows(), "o_custkey", work.layers["people"].rows(), "id").agg(lit(len(work.violations())).alias("checks"), F.count("*").alias("dangling"))


# -- keys and text


@query("generated_uuid7_keys", "SELECT count(*) AS n FROM nation")
def _(c):
    layer = LayeredTable(replace(c.docs.spec, strategy=Strategy.UUID7), c.docs.base, c.docs.source_table)
    rows = c.table("nation").select(col("n_name").alias("source"))
    shape = "^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return W.insert(layer, rows).matched.filter(col("id").rlike(shape)).distinct().agg(n_())


@query("text_joined_with_nulls_as_empty", "SELECT id, concat('order ', id, ' of ', o_custkey) AS t FROM ord", "ord")
def _(c):
    return c.ord.rows().select("id", P.joined_text(lit("order "), col("id"), lit(" of "), col("o_custkey")).alias("t"))


# -- swaps that fail by their shape


@query("swap_shape_findings", "SELECT * FROM (VALUES ('empty', 'S013'), ('missing', 'S001'), ('no identity', 'S005'), ('other partitions', 'S012'), ('other types', 'S000'), ('other types', 'S002'), ('unknown identity', 'S000'), ('unknown identity', 'S016')) t(candidate, code)")
def _(c):
    people, table = c.people, c.people.source_table
    parted = LayeredTable(replace(people.spec, source=SourceSpec("c_custkey", partition_key="c_nationkey")), people.base, table)
    bare = people.replaced(people.base.filter("id < 0"))
    reports = {
        "missing": S.verify(people, None),
        "no identity": S.verify(people, table),
        "unknown identity": S.verify(people, table, identity=["nope"]),
        "other types": S.verify(people, table.drop("c_name").withColumn("c_nationkey", lit("x")), identity=["c_name"]),
        "other partitions": S.verify(parted, table, identity=["c_name"], partition_columns=["c_mktsegment"]),
        "empty": S.verify(bare, table.limit(0), identity=["c_name"]),
    }
    found = sorted({(name, f.code) for name, report in reports.items() for f in report.findings})
    return c.spark.createDataFrame(found, "candidate string, code string")


@query("swap_cutover", "SELECT * FROM (VALUES ('first', 'S017'), ('same', 'S018'), ('moved', 'none')) t(step, code)")
def _(c):
    store = SnapshotStore(c.spark, _folder(c, "cutover"))
    store.publish(c.people.base, 0)
    read = {"v1": c.people.source_table, "v2": c.people.source_table}.get
    try:
        first = S.cutover(store, c.people.spec, "v2", read, identity=["c_name"])
    except S.SwapRefused as e:
        first = e.report
    store.swap(1, source="v1")
    same = S.cutover(store, c.people.spec, "v1", read, identity=["c_name"])
    moved = S.cutover(store, c.people.spec, "v2", read, identity=["c_name"])
    assert store.manifest()["source"] == "v2"
    steps = (("first", first), ("same", same), ("moved", moved))
    return c.spark.createDataFrame([(n, next((f.code for f in r.findings), "none")) for n, r in steps], "step string, code string")
