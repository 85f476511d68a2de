"""Changes, integrity and swaps: each query returns the state, events or offending rows that follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..errors import NotOverridable
from ..operators import cascade as K
from ..operators import changes as W
from ..operators import integrity as I
from ..operators import swap as S
from ..operators.batch import Batch
from ..operators.layer import LayeredTable
from ..spec import RedundantPolicy, Relation, Unique
from ..streaming.apply import apply_changes
from .reads import C, n_
from .registry import query

col, lit = F.col, F.lit


def _new(c, n: int):
    """Rows to insert: made from nations, keys not given."""
    return c.table("nation").filter(f"n_nationkey < {n}").select(
        F.concat(lit("New "), "n_name").alias("c_name"), col("n_nationkey").alias("c_nationkey"), lit(1.5).alias("c_acctbal"), lit("NEW").alias("c_mktsegment")
    )


# -- inserts


@query(
    "insert_generates_ascending_keys",
    f"""SELECT _overlay_origin, {C} FROM cust UNION ALL SELECT 'base', (SELECT max(id) FROM cust_base) + row_number() OVER (ORDER BY n_name), concat('New ', n_name), n_nationkey, 1.5, 'NEW'
    FROM nation WHERE n_nationkey < 6""",
    "cust",
)
def _(c):
    return W.insert(c.cust, _new(c, 6), order_by=["c_name"]).layer.view


@query(
    "insert_generates_descending_keys",
    "SELECT (SELECT min(id) FROM people_base) - row_number() OVER (ORDER BY n_name) AS id, concat('New ', n_name) AS c_name FROM nation WHERE n_nationkey < 6",
    "people",
)
def _(c):
    return W.insert(c.people, _new(c, 6), order_by=["c_name"]).layer.base_only().filter("c_mktsegment = 'NEW'").select("id", "c_name")


@query(
    "insert_with_source_key_overrides",
    f"""SELECT CASE WHEN id BETWEEN 5 AND 9 THEN 'base' ELSE _overlay_origin END AS _overlay_origin, id, CASE WHEN id BETWEEN 5 AND 9 THEN 'over' ELSE c_name END AS c_name FROM people""",
    "people",
)
def _(c):
    rows = c.people.source_only().filter("id BETWEEN 5 AND 9").withColumn("c_name", lit("over"))
    return W.insert(c.people, rows).layer.view.select("_overlay_origin", "id", "c_name")


@query("insert_partial_row", "SELECT 'only a name' AS c_name, CAST(NULL AS INTEGER) AS c_nationkey, (SELECT max(id) FROM cust_base) + 1 AS id", "cust")
def _(c):
    one = c.spark.range(1).select(lit("only a name").alias("c_name"))
    return W.insert(c.cust, one, order_by=["c_name"]).layer.rows().filter("c_name = 'only a name'").select("c_name", "c_nationkey", "id")


@query("bulk_create_keys", "SELECT (SELECT max(id) FROM cust_base) + row_number() OVER (ORDER BY n_name) AS id FROM nation", "cust")
def _(c):
    return W.bulk_create(c.cust, _new(c, 25), order_by=["c_name"]).matched


# -- updates

_SET = "c_mktsegment = 'BUILDING'"
_UPDATED = f"""SELECT CASE WHEN {_SET} THEN 'base' ELSE _overlay_origin END AS _overlay_origin, id, c_name, c_nationkey, CASE WHEN {_SET} THEN {{}} ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM people"""


@query("update_literal_copies_up", _UPDATED.format("7.0"), "people")
def _(c):
    return W.update(c.people, col("c_mktsegment") == "BUILDING", {"c_acctbal": lit(7.0)}).layer.view


@query("update_reads_own_columns", _UPDATED.format("c_acctbal * 2 + c_nationkey"), "people")
def _(c):
    return W.update(c.people, col("c_mktsegment") == "BUILDING", {"c_acctbal": col("c_acctbal") * 2 + col("c_nationkey")}).layer.view


@query("update_by_case", _UPDATED.format("CASE WHEN c_nationkey = 1 THEN 0.0 WHEN c_nationkey = 2 THEN c_acctbal + 1 ELSE c_acctbal END"), "people")
def _(c):
    value = F.when(col("c_nationkey") == 1, 0.0).when(col("c_nationkey") == 2, col("c_acctbal") + 1).otherwise(col("c_acctbal"))
    return W.update(c.people, col("c_mktsegment") == "BUILDING", {"c_acctbal": value}).layer.view


@query(
    "update_events",
    f"""SELECT id, 'materialize' AS op FROM people WHERE {_SET} AND _overlay_origin = 'source' UNION ALL SELECT id, 'update' FROM people WHERE {_SET} AND c_nationkey IS DISTINCT FROM 5""",
    "people",
)
def _(c):
    return W.update(c.people, col("c_mktsegment") == "BUILDING", {"c_nationkey": lit(5)}).events


@query("update_matched_count", f"SELECT count(*) AS n FROM people WHERE {_SET}", "people")
def _(c):
    change = W.update(c.people, col("c_mktsegment") == "BUILDING", {"c_nationkey": lit(5)}, RedundantPolicy("skip", "all"))
    return change.matched.agg(n_())


@query(
    "update_by_keys",
    f"SELECT id, CASE WHEN id IN (SELECT o_custkey FROM ord WHERE o_totalprice > 300000) THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM people",
    "people",
    "ord",
)
def _(c):
    keys = c.ord.rows().filter("o_totalprice > 300000").select("o_custkey")
    return W.update(c.people, keys, {"c_mktsegment": lit("VIP")}).layer.rows().select("id", "c_mktsegment")


def _policy(mode: str, scope: str, ignore: tuple[str, ...] = ()):
    # Setting the nation to 3 and the segment to itself changes only rows of other nations.
    real = "c_nationkey IS DISTINCT FROM 3" if "c_nationkey" not in ignore else "false"
    skipped = f"NOT ({real})" + (" AND _overlay_origin = 'source'" if scope == "source_only" else "") if mode != "materialize" else "false"
    sql = f"""SELECT CASE WHEN c_nationkey < 8 AND NOT ({skipped}) THEN 'base' ELSE _overlay_origin END AS _overlay_origin, id,
    CASE WHEN c_nationkey < 8 AND NOT ({skipped}) THEN 3 ELSE c_nationkey END AS c_nationkey FROM people"""
    name = f"redundant_{mode}_{scope}" + ("_ignoring" if ignore else "")

    @query(name, sql, "people")
    def _(c):
        return W.update(c.people, col("c_nationkey") < 8, {"c_nationkey": lit(3)}, RedundantPolicy(mode, scope, ignore)).layer.view.select("_overlay_origin", "id", "c_nationkey")


for _mode in ("materialize", "skip", "warn"):
    for _scope in ("source_only", "all"):
        _policy(_mode, _scope)
        _policy(_mode, _scope, ("c_nationkey",))


@query("materialize_selected", f"SELECT CASE WHEN c_nationkey = 2 THEN 'base' ELSE _overlay_origin END AS _overlay_origin, {C} FROM people", "people")
def _(c):
    return W.materialize(c.people, col("c_nationkey") == 2).layer.view


@query("materialize_is_idempotent", "SELECT count(*) AS n FROM people_base", "people")
def _(c):
    once = W.materialize(c.people, col("c_nationkey") == 2)
    twice = W.materialize(once.layer, col("c_nationkey") == 2)
    return twice.base.join(once.matched.select(col("id").alias("m")), col("id") == col("m"), "left_anti").agg(n_())


# -- deletes


@query("delete_hard_shows_source_again", "SELECT CASE WHEN id < 0 AND id % 5 = 0 THEN 'source' ELSE _overlay_origin END AS _overlay_origin, id, CASE WHEN id < 0 AND id % 5 = 0 THEN s_acctbal / 2 ELSE s_acctbal END AS s_acctbal FROM supp WHERE NOT (id > 0 AND id < 40)", "supp")
def _(c):
    gone = ((col("id") < 0) & (col("_overlay_origin") == "base")) | ((col("id") > 0) & (col("id") < 40))
    return W.delete(c.supp, gone).layer.view.select("_overlay_origin", "id", "s_acctbal")


@query("delete_soft_hides", f"SELECT _overlay_origin, {C} FROM people WHERE c_nationkey <> 4", "people")
def _(c):
    return W.delete(c.people, col("c_nationkey") == 4).layer.view


@query(
    "delete_soft_splits_per_row",
    "SELECT v.id, CASE WHEN s.id IS NULL THEN 'delete' ELSE 'tombstone' END AS op FROM people v LEFT JOIN people_all s ON s.id = v.id WHERE v.c_nationkey = 4",
    "people",
)
def _(c):
    return W.delete(c.people, col("c_nationkey") == 4).events


@query(
    "delete_soft_tombstones_keep_values",
    "SELECT id, c_name, c_acctbal FROM people v WHERE c_nationkey = 4 AND EXISTS (SELECT 1 FROM people_all s WHERE s.id = v.id) UNION ALL SELECT id, c_name, c_acctbal FROM people_base WHERE _overlay_deleted",
    "people",
)
def _(c):
    return W.delete(c.people, col("c_nationkey") == 4).layer.tombstones().select("id", "c_name", "c_acctbal")


@query("delete_soft_looks_past_the_filter", "SELECT v.id FROM docs v WHERE v.n_chars % 10 = 0 AND EXISTS (SELECT 1 FROM docs_all s WHERE s.id = v.id)", "docs")
def _(c):
    return W.delete(c.docs, col("n_chars") % 10 == 0).events.filter("op = 'tombstone'").select("id")


@query(
    "reset_to_source",
    "SELECT 'source' AS _overlay_origin, s.id, s.c_name, s.c_acctbal FROM people_src s WHERE s.id % 10 < 2 UNION ALL SELECT _overlay_origin, id, c_name, c_acctbal FROM people WHERE id NOT IN (SELECT id FROM people_src WHERE id % 10 < 2)",
    "people",
)
def _(c):
    keys = c.people.mapped_source().filter("id % 10 < 2").select("id")
    return W.reset_to_source(c.people, keys).layer.view.select("_overlay_origin", "id", "c_name", "c_acctbal")


@query(
    "get_or_create",
    f"SELECT count(*) AS n FROM (SELECT id FROM people UNION ALL SELECT 0 FROM nation WHERE n_name NOT IN (SELECT c_name FROM people))",
    "people",
)
def _(c):
    present = c.people.rows().filter("id = 7").select("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    rows = _new(c, 25).withColumn("c_name", F.replace("c_name", lit("New "))).unionByName(present)
    return W.get_or_create(c.people, rows, ["c_name"], order_by=["c_name"]).layer.rows().agg(n_())


@query(
    "update_or_create",
    "SELECT id, c_name, CASE WHEN id BETWEEN 5 AND 9 THEN 'MERGED' ELSE c_mktsegment END AS c_mktsegment FROM people UNION ALL SELECT (SELECT min(id) FROM people_base) - 1, 'nobody yet', 'MERGED'",
    "people",
)
def _(c):
    some = c.people.rows().filter("id BETWEEN 5 AND 9").select("c_name", lit("MERGED").alias("c_mktsegment"))
    some = some.unionByName(c.spark.range(1).select(lit("nobody yet").alias("c_name"), lit("MERGED").alias("c_mktsegment")))
    return W.update_or_create(c.people, some, ["c_name"], order_by=["c_name"]).layer.rows().select("id", "c_name", "c_mktsegment")


@query("get_or_create_once_for_each_value", "SELECT 'twin' AS c_name, CAST(max(n_nationkey) AS INTEGER) AS c_nationkey, (SELECT min(id) FROM people_base) - 1 AS id FROM nation", "people")
def _(c):
    rows = _new(c, 25).withColumn("c_name", lit("twin"))
    return W.get_or_create(c.people, rows, ["c_name"], order_by=["c_name"]).layer.rows().filter("c_name = 'twin'").select("c_name", "c_nationkey", "id")


@query(
    "update_or_create_of_repeated_rows",
    "SELECT id, CASE WHEN c_name IN (SELECT c_name FROM people_src WHERE c_nationkey = 3) THEN 24 ELSE c_nationkey END AS c_nationkey FROM people",
    "people",
)
def _(c):
    names = c.people.mapped_source().filter("c_nationkey = 3").join(c.people.rows().select(col("c_name").alias("seen")), col("c_name") == col("seen"), "left_semi").select("c_name")
    rows = names.withColumn("c_nationkey", lit(7)).unionByName(names.withColumn("c_nationkey", lit(24)))
    return W.update_or_create(c.people, rows, ["c_name"]).layer.rows().select("id", "c_nationkey")


@query(
    "update_or_create_follows_the_policy",
    "SELECT _overlay_origin, id FROM people",
    "people",
)
def _(c):
    same = c.people.view.filter("_overlay_origin = 'source'").select("c_name", "c_nationkey")
    return W.update_or_create(c.people, same, ["c_name"], RedundantPolicy("skip")).layer.view.select("_overlay_origin", "id")


def _refused(c, error: type, change) -> object:
    """One row: whether a change raises ``error``."""
    try:
        change()
        outcome = False
    except error:
        outcome = True
    return c.spark.createDataFrame([(outcome,)], "refused boolean")


@query("source_rows_that_cannot_be_overridden_are_refused", "SELECT count(*) > 0 AS refused FROM cust_fixed WHERE _overlay_origin = 'source' AND id % 10 <> -2", "cust_fixed")
def _(c):
    rows = c.cust_fixed.view.filter("_overlay_origin = 'source' AND id % 10 <> -2").select("c_name", lit("X").alias("c_mktsegment"))
    return _refused(c, NotOverridable, lambda: W.update_or_create(c.cust_fixed, rows, ["c_name"]))


@query("generated_uuids_are_stored", "SELECT count(*) AS n FROM nation")
def _(c):
    rows = c.table("nation").select(lit("en").alias("lang"), col("n_name").alias("source"), lit(1).cast(c.docs.base.schema["n_chars"].dataType).alias("n_chars"))
    change = W.insert(c.docs, rows)
    return change.layer.live_base().join(change.matched.select(col("id").alias("k")), col("id") == col("k"), "left_semi").agg(n_())


_RELATIONS = [Relation("ord", "o_custkey", "people"), Relation("links", "l_orderkey", "ord")]


@query("cascade_deletes_referring_rows", "SELECT id FROM ord WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT id FROM people WHERE c_nationkey = 4)", "people", "ord")
def _(c):
    keys = c.people.rows().filter("c_nationkey = 4").select("id")
    return K.delete_cascade({"people": c.people, "ord": c.ord}, _RELATIONS[:1], "people", keys)["ord"].rows().select("id")


@query(
    "cascade_sets_null",
    "SELECT id, CASE WHEN o_custkey IN (SELECT id FROM people WHERE c_nationkey = 4) THEN NULL ELSE o_custkey END AS o_custkey FROM ord",
    "people",
    "ord",
)
def _(c):
    keys = c.people.rows().filter("c_nationkey = 4").select("id")
    relation = Relation("ord", "o_custkey", "people", on_delete="set_null")
    return K.delete_cascade({"people": c.people, "ord": c.ord}, [relation], "people", keys)["ord"].rows().select("id", "o_custkey")


@query(
    "edits_of_different_columns_merge",
    "SELECT id, CASE WHEN c_nationkey = 6 THEN concat(c_name, '!') ELSE c_name END AS c_name, CASE WHEN c_nationkey = 6 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM people",
    "people",
)
def _(c):
    rows = c.people.rows().filter("c_nationkey = 6")
    old = F.struct("c_name", "c_acctbal").alias("old")
    one = rows.select("id", old, F.struct(F.concat("c_name", lit("!")).alias("c_name"), "c_acctbal").alias("new"), lit(1).alias("seq"))
    two = rows.select("id", old, F.struct("c_name", (col("c_acctbal") + 1).alias("c_acctbal")).alias("new"), lit(2).alias("seq"))
    return W.three_way_merge(c.people, one.unionByName(two)).layer.rows().select("id", "c_name", "c_acctbal")


@query(
    "change_batch_last_per_key",
    """SELECT CASE WHEN x.op = 'upsert' THEN 'base' ELSE v._overlay_origin END AS _overlay_origin, v.id, CASE WHEN x.op = 'upsert' THEN 'by stream' ELSE v.c_name END AS c_name
    FROM people v LEFT JOIN (SELECT user_id, arg_max(CASE WHEN event_type = 'click' THEN 'upsert' ELSE 'delete' END, event_id) AS op FROM events GROUP BY 1) x ON x.user_id = v.id
    WHERE x.op IS NULL OR x.op = 'upsert'
    UNION ALL SELECT 'base', s.id, 'by stream' FROM people_src s WHERE s.id NOT IN (SELECT id FROM people)
    AND s.id IN (SELECT user_id FROM (SELECT user_id, arg_max(CASE WHEN event_type = 'click' THEN 'upsert' ELSE 'delete' END, event_id) AS op FROM events GROUP BY 1) WHERE op = 'upsert')""",
    "people",
)
def _(c):
    events = c.table("events").select("user_id", col("event_id").alias("seq"), F.when(col("event_type") == "click", "upsert").otherwise("delete").alias("op"))
    batch = c.people.mapped_source().join(events, col("id") == col("user_id")).withColumn("c_name", lit("by stream"))
    return apply_changes(c.people, batch.select(*c.people.spec.columns, "op", "seq")).view.select("_overlay_origin", "id", "c_name")


# -- integrity


@query("references_dangling", "SELECT o.id, o.o_custkey FROM ord o WHERE o.o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM people p WHERE p.id = o.o_custkey)", "ord", "people")
def _(c):
    return I.dangling(c.ord.rows(), "o_custkey", c.people.rows(), "id").select("id", "o_custkey")


@query("references_broken_by_delete", "SELECT o.id FROM ord o JOIN people p ON p.id = o.o_custkey WHERE p.c_nationkey = 4", "ord", "people")
def _(c):
    after = W.delete(c.people, col("c_nationkey") == 4).layer.rows()
    return I.broken_references(c.ord.rows(), "o_custkey", c.people.rows(), after, "id").select("id")


@query(
    "batch_checks_both_sides_of_a_relation",
    """SELECT 'ord.o_custkey' AS side, id FROM ord WHERE o_orderpriority LIKE '1%'
    UNION ALL SELECT 'ord.o_custkey (deleted)', id FROM ord WHERE o_orderpriority NOT LIKE '1%' AND o_custkey IN (SELECT id FROM people WHERE c_nationkey = 4)""",
    "ord",
    "people",
)
def _(c):
    work = Batch({"ord": c.ord, "people": c.people}, _RELATIONS[:1])
    work.apply("people", W.delete, col("c_nationkey") == 4)
    work.apply("ord", W.update, col("o_orderpriority").startswith("1"), {"o_custkey": lit(40_000_000)})
    sides = [rows.select(lit(side).alias("side"), "id") for side, rows in work.violations().items()]
    return sides[0].unionByName(sides[1])


@query("batch_leaves_old_danglers_alone", "SELECT id FROM ord WHERE false", "ord")
def _(c):
    work = Batch({"ord": c.ord, "people": c.people}, _RELATIONS[:1])
    work.apply("ord", W.update, col("o_orderstatus") == "F", {"o_totalprice": lit(1.0)})
    return work.violations()["ord.o_custkey"].select("id")


@query("batch_checks_a_relation_to_itself", "SELECT id FROM people WHERE c_nationkey <> 7 AND c_nationkey IN (SELECT id FROM people WHERE c_nationkey = 7 OR c_mktsegment = 'EDITED') AND c_mktsegment <> 'EDITED'", "people")
def _(c):
    work = Batch({"people": c.people}, [Relation("people", "c_nationkey", "people")])
    work.apply("people", W.delete, (col("c_nationkey") == 7) | (col("c_mktsegment") == "EDITED"))
    return work.violations()["people.c_nationkey (deleted)"].select("id")


@query("batch_ignores_old_collisions", "SELECT _overlay_origin, id FROM parts", "parts")
def _(c):
    from dataclasses import replace

    spec = replace(c.parts.spec, unique=(Unique(("p_size", "p_brand")),))
    work = Batch({"parts": LayeredTable(spec, c.parts.base, c.parts.source_table)})
    work.apply("parts", W.update, col("_overlay_origin") == "base", {"p_retailprice": lit(5.0)})
    return work.commit()["parts"].view.select("_overlay_origin", "id")


@query(
    "cascade_follows_chains",
    """SELECT id FROM staff WHERE id NOT IN (SELECT id FROM (WITH RECURSIVE gone(id) AS (SELECT id FROM staff WHERE id = 3 UNION SELECT s.id FROM staff s JOIN gone g ON s.boss = g.id) SELECT id FROM gone))""",
    "staff",
)
def _(c):
    keys = c.staff.rows().filter("id = 3").select("id")
    return K.delete_cascade({"staff": c.staff}, [Relation("staff", "boss", "staff")], "staff", keys)["staff"].rows().select("id")


@query("unique_within_base", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM people_base WHERE NOT _overlay_deleted GROUP BY 1, 2 HAVING count(*) > 1", "people")
def _(c):
    return I.base_duplicates(c.people, Unique(("c_nationkey", "c_mktsegment")))


@query(
    "unique_against_source",
    "SELECT b.id, b.p_size, b.p_brand, s.id AS source_pk FROM parts_base b JOIN parts s ON s._overlay_origin = 'source' AND s.p_size = b.p_size AND s.p_brand = b.p_brand AND s.id <> b.id WHERE NOT b._overlay_deleted",
    "parts",
)
def _(c):
    return I.source_collisions(c.parts, Unique(("p_size", "p_brand")))


@query(
    "unique_conditional",
    "SELECT b.id, b.p_name, s.id AS source_pk FROM parts_base b JOIN parts s ON s._overlay_origin = 'source' AND s.p_name = b.p_name AND s.id <> b.id AND s.p_size > 25 WHERE NOT b._overlay_deleted AND b.p_size > 25",
    "parts",
)
def _(c):
    return I.source_collisions(c.parts, Unique(("p_name",), "p_size > 25"))


@query("unique_frees_deleted_values", "SELECT s_name, count(*) AS n FROM (SELECT s_name FROM supp_base UNION ALL SELECT s_name FROM supp_base WHERE id > 0) GROUP BY 1 HAVING count(*) > 1", "supp")
def _(c):
    own = c.supp.base.filter("id > 0")
    return I.base_duplicates(c.supp.replaced(c.supp.base.unionByName(own.withColumn("id", col("id") + 10_000_000))), Unique(("s_name",)))


@query("source_duplicates", "SELECT p_size, p_brand, count(*) AS n FROM parts_src GROUP BY 1, 2 HAVING count(*) > 1", "parts")
def _(c):
    return I.source_duplicates(c.parts.mapped_source(), Unique(("p_size", "p_brand")))


@query("validate_candidates", "SELECT c_custkey AS id FROM customer c WHERE EXISTS (SELECT 1 FROM people v WHERE v.c_name = c.c_name AND v.id <> c.c_custkey - 1)", "people")
def _(c):
    candidates = c.people.mapped_source().withColumn("id", col("id") - 1)
    return I.validate(c.people, candidates, Unique(("c_name",))).select((col("id") + 1).alias("id"))


@query("check_failures", "SELECT id FROM people_base WHERE NOT _overlay_deleted AND NOT (c_acctbal < 9000)", "people")
def _(c):
    return I.failed_checks(c.people, "c_acctbal < 9000").select("id")


# -- swaps: the candidate drops, renumbers and renames some vendor rows

_CANDIDATE = "SELECT CASE WHEN c_custkey % 30 = 20 THEN c_custkey + 500000 ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 30 = 8 THEN 'renamed' ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 20 <> 10"


def _candidate(c) -> LayeredTable:
    return LayeredTable(c.people.spec, c.people.base, c.spark.sql(_CANDIDATE.replace("customer", "{customer}"), customer=c.table("customer")))


@query("swap_reassigned_ids", f"SELECT a.c_custkey FROM customer a JOIN ({_CANDIDATE}) b USING (c_custkey) WHERE a.c_name IS DISTINCT FROM b.c_name")
def _(c):
    return S.reassigned(c.people.source(), _candidate(c).source(), "c_custkey", ["c_name"])


@query("swap_renumbered_ids", f"SELECT a.c_custkey, b.c_custkey AS new_id FROM customer a JOIN ({_CANDIDATE}) b USING (c_name) WHERE a.c_custkey <> b.c_custkey")
def _(c):
    return S.renumbered(c.people.source(), _candidate(c).source(), "c_custkey", ["c_name"])


@query("swap_orphaned_base_rows", f"SELECT id FROM people_base WHERE id IN (SELECT id FROM people_src) AND id NOT IN (SELECT c_custkey FROM ({_CANDIDATE}))", "people")
def _(c):
    return S.orphaned(c.people, _candidate(c))


@query(
    "swap_new_dangling_references",
    f"SELECT o.id FROM ord o WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT id FROM people_base WHERE NOT _overlay_deleted) AND o_custkey NOT IN (SELECT c_custkey FROM ({_CANDIDATE}) WHERE c_custkey NOT IN (SELECT id FROM people_base))",
    "ord",
    "people",
)
def _(c):
    return I.dangling(c.ord.rows(), "o_custkey", _candidate(c).rows(), "id").select("id")


@query("swap_duplicates_in_candidate", f"SELECT c_name, count(*) AS n FROM ({_CANDIDATE}) GROUP BY 1 HAVING count(*) > 1")
def _(c):
    return I.source_duplicates(_candidate(c).mapped_source(), Unique(("c_name",)))


@query(
    "swap_collisions_with_base",
    f"SELECT b.id, b.c_name, s.c_custkey AS source_pk FROM people_base b JOIN ({_CANDIDATE}) s ON s.c_name = b.c_name AND s.c_custkey <> b.id WHERE NOT _overlay_deleted AND s.c_custkey NOT IN (SELECT id FROM people_base)",
    "people",
)
def _(c):
    return I.source_collisions(_candidate(c), Unique(("c_name",)))


@query(
    "swap_report",
    f"""SELECT * FROM (
    SELECT 'S003' AS code, 'error' AS level, count(*) AS n FROM customer a JOIN ({_CANDIDATE}) b USING (c_custkey) WHERE a.c_name IS DISTINCT FROM b.c_name
    UNION ALL SELECT 'S004', 'error', count(*) FROM customer a JOIN ({_CANDIDATE}) b USING (c_name) WHERE a.c_custkey <> b.c_custkey
    UNION ALL SELECT 'S006', 'warning', count(*) FROM people_base WHERE id IN (SELECT id FROM people_src) AND id NOT IN (SELECT c_custkey FROM ({_CANDIDATE}))
    UNION ALL SELECT 'S008', 'error', count(*) FROM (SELECT c_name FROM ({_CANDIDATE}) GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'S009', 'error', count(*) FROM people_base b JOIN ({_CANDIDATE}) s ON s.c_name = b.c_name AND s.c_custkey <> b.id WHERE NOT _overlay_deleted AND s.c_custkey NOT IN (SELECT id FROM people_base)
    ) WHERE n > 0""",
    "people",
)
def _(c):
    from dataclasses import replace

    layer = LayeredTable(replace(c.people.spec, unique=(Unique(("c_name",)),)), c.people.base, c.people.source_table)
    report = S.verify(layer, _candidate(c).source_table, identity=["c_name"])
    return c.spark.createDataFrame([(f.code, f.level, f.count) for f in report.findings], "code string, level string, n long")


@query("partial_condition_on_both_layers", "SELECT _overlay_origin, id FROM parts WHERE p_size > 25 AND NOT coalesce(p_retailprice < 920, false)", "parts")
def _(c):
    return c.parts.view.filter(F.expr("p_size > 25") & P.excluded(col("p_retailprice") < 920)).select("_overlay_origin", "id")


