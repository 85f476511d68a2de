"""Scans, provenance, filters, relations, aggregation, windows, pages and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import predicates as P
from ..operators import aggregate as A
from ..operators import changes as W
from ..operators import page as G
from ..operators import relate as R
from ..sources import tables
from .registry import query

C, O, PT = "id, c_name, c_nationkey, c_acctbal, c_mktsegment", "id, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority", "id, p_name, p_brand, p_type, p_size, p_retailprice"
col, lit = F.col, F.lit


def money(column: str):
    """An exact sum of amounts."""
    return F.sum(col(column).cast("decimal(18,2)")).cast("double")


MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)".format


def n_():
    """The number of rows, as ``n``."""
    return F.count("*").alias("n")


# -- scans and sources


@query("view_by_origin", f"SELECT _overlay_origin AS origin, count(*) AS n, {MONEY('c_acctbal')} AS balance FROM cust GROUP BY 1", "cust")
def _(c):
    return c.cust.view.groupBy(col("_overlay_origin").alias("origin")).agg(n_(), money("c_acctbal").alias("balance"))


@query("view_full", f"SELECT _overlay_origin, {C} FROM cust", "cust")
def _(c):
    return c.cust.view


@query("view_tombstones_only", f"SELECT _overlay_origin, {C} FROM cust_fixed", "cust_fixed")
def _(c):
    return c.cust_fixed.view


@query("view_bare_union", f"SELECT _overlay_origin AS origin, l_returnflag, count(*) AS n, {MONEY('l_quantity')} AS quantity FROM links GROUP BY 1, 2", "links")
def _(c):
    return c.links.view.groupBy(col("_overlay_origin").alias("origin"), "l_returnflag").agg(n_(), money("l_quantity").alias("quantity"))


@query("view_hard_delete", "SELECT _overlay_origin, id, s_name, s_nationkey, s_acctbal FROM supp", "supp")
def _(c):
    return c.supp.view


@query("view_stored_negative_source", f"SELECT _overlay_origin, {C} FROM cust_neg", "cust_neg")
def _(c):
    return c.cust_neg.view


@query("view_negative_base", f"SELECT _overlay_origin, {C} FROM people", "people")
def _(c):
    return c.people.view


@query("view_string_keys_filtered_source", "SELECT _overlay_origin, id, lang, source, n_chars FROM docs", "docs")
def _(c):
    return c.docs.view


@query("view_key_is_relation", "SELECT _overlay_origin, person_id, bio FROM prof", "prof")
def _(c):
    return c.prof.view


@query("view_layered_links", "SELECT _overlay_origin, count(*) AS n, min(id) AS lo, max(id) AS hi FROM roster GROUP BY 1", "roster")
def _(c):
    return c.roster.view.groupBy("_overlay_origin").agg(n_(), F.min("id").alias("lo"), F.max("id").alias("hi"))


@query("source_filtered_and_not", "SELECT 'filtered' AS kind, count(*) AS n FROM docs_src UNION ALL SELECT 'unfiltered', count(*) FROM docs_all", "docs")
def _(c):
    kind = lambda df, k: df.agg(n_()).select(lit(k).alias("kind"), "n")
    return kind(c.docs.source(), "filtered").unionByName(kind(c.docs.source(filtered=False), "unfiltered"))


@query("source_row_behind_base", "SELECT b.id, s.c_name AS vendor_name, s.c_acctbal AS vendor_balance FROM cust_base b LEFT JOIN cust_src s ON s.id = b.id", "cust")
def _(c):
    return c.cust.source_rows_behind().select("id", col("source_row.c_name").alias("vendor_name"), col("source_row.c_acctbal").alias("vendor_balance"))


@query("key_mapping_round_trip", "SELECT c_custkey AS source_id, -c_custkey AS view_id, c_custkey AS back FROM customer")
def _(c):
    seen = c.cust.view_pk_for(col("c_custkey"))
    return c.cust.source().select(col("c_custkey").alias("source_id"), seen.alias("view_id"), c.cust.source_pk_for(seen).alias("back"))


@query("base_access", f"SELECT {C}, _overlay_deleted FROM cust_base", "cust")
def _(c):
    return c.cust.base


@query("lookup_by_keys", f"SELECT _overlay_origin, {C} FROM cust WHERE id IN (-7, -10, -11, 2, 12, -2000004, 999999999)", "cust")
def _(c):
    return c.cust.by_pk([-7, -10, -11, 2, 12, -2000004, 999999999])


@query("partition_narrowed_view", f"SELECT event_type, count(*) AS n, {MONEY('value')} AS total FROM evt WHERE event_type IN ('click', 'purchase') GROUP BY 1", "evt")
def _(c):
    return c.evt.narrowed(["click", "purchase"]).view.groupBy("event_type").agg(n_(), money("value").alias("total"))


@query("partition_moved_overrides_hide", "SELECT _overlay_origin, id FROM evt WHERE event_type = 'click' AND user_id % 7 <> 0", "evt")
def _(c):
    moved = W.update(c.evt, (col("event_type") == "click") & (col("user_id") % 7 == 0), {"event_type": lit("moved")}).layer
    return moved.narrowed(["click"]).view.select("_overlay_origin", "id")


@query("partition_point_by_key", "SELECT id, user_id, event_type FROM evt WHERE event_type = 'click' AND id BETWEEN 20 AND 60", "evt")
def _(c):
    return c.evt.narrowed(["click"]).view.filter(col("id").between(20, 60)).select("id", "user_id", "event_type")


@query("sql_over_view", "SELECT c_mktsegment, count(*) AS n FROM cust WHERE c_acctbal > 0 GROUP BY 1", "cust")
def _(c):
    return c.spark.sql("SELECT c_mktsegment, count(*) AS n FROM {v} WHERE c_acctbal > 0 GROUP BY 1", v=c.cust.view)


@query("json_round_trip", f"SELECT {C} FROM cust", "cust")
def _(c):
    rows = c.cust.rows()
    return tables.deserialize(tables.serialize(rows), rows.schema)


# -- provenance


@query("origin_annotated", "SELECT id, _overlay_origin AS overlay_origin FROM cust WHERE c_nationkey < 5", "cust")
def _(c):
    return c.cust.with_origin().filter("c_nationkey < 5").select("id", "overlay_origin")


@query("origin_base_only", f"SELECT {C} FROM cust WHERE _overlay_origin = 'base'", "cust")
def _(c):
    return c.cust.base_only()


@query("origin_source_only", f"SELECT {C} FROM cust WHERE _overlay_origin = 'source'", "cust")
def _(c):
    return c.cust.source_only()


@query("origin_overridden", f"SELECT {C} FROM cust_base b WHERE NOT _overlay_deleted AND EXISTS (SELECT 1 FROM cust_all s WHERE s.id = b.id)", "cust")
def _(c):
    return c.cust.overridden()


@query("origin_organic", f"SELECT {C} FROM cust_base b WHERE NOT _overlay_deleted AND NOT EXISTS (SELECT 1 FROM cust_all s WHERE s.id = b.id)", "cust")
def _(c):
    return c.cust.organic()


@query("overridden_ignores_the_source_filter", "SELECT id, lang FROM docs_base b WHERE NOT _overlay_deleted AND EXISTS (SELECT 1 FROM docs_all s WHERE s.id = b.id)", "docs")
def _(c):
    return c.docs.overridden().select("id", "lang")


@query(
    "origin_slices_add_up",
    """SELECT k, n FROM (SELECT 'view' AS k, count(*) AS n FROM people UNION ALL SELECT 'base', count(*) FROM people WHERE _overlay_origin = 'base'
    UNION ALL SELECT 'source', count(*) FROM people WHERE _overlay_origin = 'source'
    UNION ALL SELECT 'overridden', count(*) FROM people_base b WHERE NOT _overlay_deleted AND EXISTS (SELECT 1 FROM people_all s WHERE s.id = b.id)
    UNION ALL SELECT 'organic', count(*) FROM people_base b WHERE NOT _overlay_deleted AND NOT EXISTS (SELECT 1 FROM people_all s WHERE s.id = b.id))""",
    "people",
)
def _(c):
    p, out = c.people, None
    for k, rows in (("view", p.view), ("base", p.base_only()), ("source", p.source_only()), ("overridden", p.overridden()), ("organic", p.organic())):
        one = rows.agg(n_()).select(lit(k).alias("k"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "edit_diff",
    """SELECT b.id, concat_ws(',', CASE WHEN b.c_name IS DISTINCT FROM s.c_name THEN 'c_name' END, CASE WHEN b.c_acctbal IS DISTINCT FROM s.c_acctbal THEN 'c_acctbal' END,
    CASE WHEN b.c_mktsegment IS DISTINCT FROM s.c_mktsegment THEN 'c_mktsegment' END) AS changed FROM people_base b JOIN people_src s ON s.id = b.id WHERE NOT _overlay_deleted""",
    "people",
)
def _(c):
    return c.people.edit_diff().select("id", F.array_join("changed", ",").alias("changed"))


# -- projections, filters, predicates


@query("filter_combined", f"SELECT {C} FROM people WHERE (c_acctbal >= 5000 OR c_mktsegment = 'BUILDING') AND NOT (c_nationkey = 3)", "people")
def _(c):
    return c.people.rows().filter(((col("c_acctbal") >= 5000) | (col("c_mktsegment") == "BUILDING")) & P.excluded(col("c_nationkey") == 3))


@query("exclude_keeps_unknown", "SELECT id, o_custkey FROM ord WHERE NOT coalesce(o_custkey < 500, false)", "ord")
def _(c):
    return c.ord.rows().filter(P.excluded(col("o_custkey") < 500)).select("id", "o_custkey")


@query("lookup_startswith", "SELECT id, c_name FROM people WHERE starts_with(c_name, 'Organic#1')", "people")
def _(c):
    return c.people.rows().filter(P.lookup(col("c_name"), "startswith", "Organic#1")).select("id", "c_name")


@query("lookup_icontains", "SELECT id, c_name FROM people WHERE contains(lower(c_name), 'phan#')", "people")
def _(c):
    return c.people.rows().filter(P.lookup(col("c_name"), "icontains", "PHAN#")).select("id", "c_name")


@query("lookup_isnull", "SELECT id FROM ord WHERE o_custkey IS NULL", "ord")
def _(c):
    return c.ord.rows().filter(P.lookup(col("o_custkey"), "isnull", True)).select("id")


@query("lookup_exact_none", "SELECT id FROM ord WHERE o_custkey IS NULL AND o_orderstatus IN ('F', 'O')", "ord")
def _(c):
    return c.ord.rows().filter(P.lookup(col("o_custkey"), "exact", None) & P.lookup(col("o_orderstatus"), "in", ["F", "O"])).select("id")


@query("lookup_range", "SELECT id, p_size FROM parts WHERE p_size BETWEEN 10 AND 12", "parts")
def _(c):
    return c.parts.rows().filter(P.lookup(col("p_size"), "range", (10, 12))).select("id", "p_size")


@query("distinct_from", "SELECT id FROM ord WHERE o_custkey IS DISTINCT FROM 7", "ord")
def _(c):
    return c.ord.rows().filter(P.distinct_from(col("o_custkey"), lit(7))).select("id")


@query("key_in_subquery", "SELECT id, o_custkey FROM ord WHERE o_custkey IN (SELECT id FROM people WHERE c_mktsegment = 'BUILDING')", "ord", "people")
def _(c):
    return P.in_keys(c.ord.rows(), "o_custkey", c.people.rows().filter("c_mktsegment = 'BUILDING'").select("id")).select("id", "o_custkey")


@query("selective_in", "SELECT id, o_totalprice FROM ord WHERE o_custkey IN (SELECT id FROM people WHERE c_name = 'Customer#3' OR id BETWEEN -40 AND 20)", "ord", "people")
def _(c):
    few = c.people.rows().filter("c_name = 'Customer#3' OR id BETWEEN -40 AND 20").select("id")
    return P.in_keys(c.ord.rows(), "o_custkey", few, small=True).select("id", "o_totalprice")


@query("literal_keys", "SELECT id, c_name FROM people WHERE id IN (SELECT unnest(range(-100, 101)))", "people")
def _(c):
    return P.in_literals(c.people.rows(), "id", list(range(-100, 101))).select("id", "c_name")


@query("literal_keys_many", "SELECT id, o_orderstatus FROM ord WHERE id IN (SELECT unnest(range(0, 6000, 3)))", "ord")
def _(c):
    return P.in_literals(c.ord.rows(), "id", list(range(0, 6000, 3))).select("id", "o_orderstatus")


@query("exists_flag", "SELECT p.id, EXISTS (SELECT 1 FROM ord o WHERE o.o_custkey = p.id) AS has_orders FROM people p", "people", "ord")
def _(c):
    return R.with_count(c.people.rows(), "id", c.ord.rows(), "o_custkey", "n").select("id", (col("n") > 0).alias("has_orders"))


@query(
    "latest_order_per_customer",
    "SELECT p.id, max_by(o.o_totalprice, struct_pack(d := o.o_orderdate, i := o.id)) AS last_total FROM people p LEFT JOIN ord o ON o.o_custkey = p.id GROUP BY 1",
    "people",
    "ord",
)
def _(c):
    return R.latest_related(c.people.rows(), "id", c.ord.rows(), "o_custkey", ["o_orderdate", "id"], "o_totalprice", "last_total").select("id", "last_total")


@query("annotate_case", "SELECT id, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS band, c_acctbal * 2 AS twice FROM people", "people")
def _(c):
    band = F.when(col("c_acctbal") < 0, "debt").when(col("c_acctbal") < 5000, "some").otherwise("rich")
    return c.people.rows().select("id", band.alias("band"), (col("c_acctbal") * 2).alias("twice"))


@query("raw_predicate", "SELECT id FROM people WHERE length(c_name) % 2 = 0 AND c_acctbal BETWEEN 0 AND 1000", "people")
def _(c):
    return c.people.rows().filter(F.expr("length(c_name) % 2 = 0 AND c_acctbal BETWEEN 0 AND 1000")).select("id")


@query(
    "scalar_functions",
    "SELECT id, abs(c_acctbal) AS a, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS s, concat(c_name, '/', c_mktsegment) AS t, lower(c_mktsegment) AS l, greatest(c_nationkey, 7) AS g, least(c_nationkey, 7) AS e, md5(c_name) AS h, lpad(CAST(c_nationkey AS STRING), 4, '0') AS p FROM people",
    "people",
)
def _(c):
    return c.people.rows().select(
        "id",
        F.abs("c_acctbal").alias("a"),
        F.coalesce(F.nullif(col("c_mktsegment"), lit("BUILDING")), lit("-")).alias("s"),
        F.concat("c_name", lit("/"), "c_mktsegment").alias("t"),
        F.lower("c_mktsegment").alias("l"),
        F.greatest("c_nationkey", lit(7)).alias("g"),
        F.least("c_nationkey", lit(7)).alias("e"),
        F.md5("c_name").alias("h"),
        F.lpad(col("c_nationkey").cast("string"), 4, "0").alias("p"),
    )


# -- relations


@query("forward_one_hop", "SELECT o.id FROM ord o JOIN people p ON p.id = o.o_custkey WHERE p.c_mktsegment = 'MACHINERY'", "ord", "people")
def _(c):
    return R.filter_forward(c.ord.rows(), "o_custkey", c.people.rows(), "id", col("c_mktsegment") == "MACHINERY").select("id")


@query("forward_two_hops", "SELECT o.id FROM ord o JOIN people p ON p.id = o.o_custkey JOIN nation n ON n.n_nationkey = p.c_nationkey WHERE n.n_name LIKE '%1%'", "ord", "people")
def _(c):
    people = R.filter_forward(c.people.rows(), "c_nationkey", c.table("nation"), "n_nationkey", col("n_name").contains("1"))
    return R.filter_forward(c.ord.rows(), "o_custkey", people, "id").select("id")


@query(
    "forward_three_hops",
    "SELECT l_returnflag, count(*) AS n FROM links l JOIN ord o ON o.id = l.l_orderkey JOIN people p ON p.id = o.o_custkey JOIN nation n ON n.n_nationkey = p.c_nationkey WHERE n.n_regionkey = 2 GROUP BY 1",
    "links",
    "ord",
    "people",
)
def _(c):
    people = R.filter_forward(c.people.rows(), "c_nationkey", c.table("nation"), "n_nationkey", col("n_regionkey") == 2)
    orders = R.filter_forward(c.ord.rows(), "o_custkey", people, "id")
    return R.filter_forward(c.links.rows(), "l_orderkey", orders, "id").groupBy("l_returnflag").agg(n_())


@query("m2m_multiplies", "SELECT o.id, count(*) AS copies FROM ord o JOIN links l ON l.l_orderkey = o.id JOIN parts p ON p.id = l.l_partkey WHERE p.p_size < 20 GROUP BY 1", "ord", "links", "parts")
def _(c):
    rows = R.filter_m2m(c.ord.rows(), "id", c.links.rows(), "l_orderkey", "l_partkey", c.parts.rows(), "id", col("p_size") < 20)
    return rows.groupBy("id").agg(F.count("*").alias("copies"))


@query("m2m_reverse", "SELECT p.id, count(*) AS copies FROM parts p JOIN links l ON l.l_partkey = p.id JOIN ord o ON o.id = l.l_orderkey WHERE o.o_orderstatus = 'F' GROUP BY 1", "parts", "links", "ord")
def _(c):
    rows = R.filter_m2m(c.parts.rows(), "id", c.links.rows(), "l_partkey", "l_orderkey", c.ord.rows(), "id", col("o_orderstatus") == "F")
    return rows.groupBy("id").agg(F.count("*").alias("copies"))


@query("reverse_multiplies", "SELECT p.id, count(*) AS copies FROM people p JOIN ord o ON o.o_custkey = p.id WHERE o.o_totalprice > 100000 GROUP BY 1", "people", "ord")
def _(c):
    return R.filter_reverse(c.people.rows(), "id", c.ord.rows(), "o_custkey", col("o_totalprice") > 100000).groupBy("id").agg(F.count("*").alias("copies"))


@query("reverse_once", "SELECT id, c_name FROM people p WHERE EXISTS (SELECT 1 FROM ord o WHERE o.o_custkey = p.id AND o.o_totalprice > 100000)", "people", "ord")
def _(c):
    return R.filter_reverse(c.people.rows(), "id", c.ord.rows(), "o_custkey", col("o_totalprice") > 100000, once=True).select("id", "c_name")


@query("layered_to_plain", "SELECT p.id, n.n_name FROM people p JOIN nation n ON n.n_nationkey = p.c_nationkey WHERE n.n_regionkey = 1", "people")
def _(c):
    nations = c.table("nation").filter("n_regionkey = 1")
    return c.people.rows().join(nations, col("c_nationkey") == col("n_nationkey")).select("id", "n_name")


@query("plain_to_layered", "SELECT n.n_name, count(*) AS n FROM nation n JOIN people p ON p.c_nationkey = n.n_nationkey GROUP BY 1", "people")
def _(c):
    return c.table("nation").join(c.people.rows(), col("c_nationkey") == col("n_nationkey")).groupBy("n_name").agg(n_())


@query(
    "detail_with_all_relations",
    "SELECT p.id, n.n_name, r.r_name, o.id AS order_id, f.bio FROM people p LEFT JOIN nation n ON n.n_nationkey = p.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN ord o ON o.o_custkey = p.id LEFT JOIN prof f ON f.person_id = p.id",
    "people",
    "ord",
    "prof",
)
def _(c):
    rows = c.people.rows()
    orders = c.ord.rows().select(col("id").alias("order_id"), "o_custkey")
    rows = rows.join(c.table("nation"), col("c_nationkey") == col("n_nationkey"), "left").join(c.table("region"), col("n_regionkey") == col("r_regionkey"), "left")
    rows = rows.join(orders, col("id") == col("o_custkey"), "left").join(c.prof.rows(), col("id") == col("person_id"), "left")
    return rows.select("id", "n_name", "r_name", "order_id", "bio")


@query("list_with_counts", "SELECT p.id, p.c_name, count(o.id) AS orders FROM people p LEFT JOIN ord o ON o.o_custkey = p.id GROUP BY 1, 2", "people", "ord")
def _(c):
    return R.with_count(c.people.rows(), "id", c.ord.rows(), "o_custkey", "orders").select("id", "c_name", "orders")


@query(
    "chained_filters_are_independent_joins",
    "SELECT p.id, count(*) AS copies FROM people p JOIN ord a ON a.o_custkey = p.id AND a.o_orderstatus = 'F' JOIN ord b ON b.o_custkey = p.id AND b.o_orderpriority = '1-URGENT' GROUP BY 1",
    "people",
    "ord",
)
def _(c):
    rows = R.filter_reverse(c.people.rows(), "id", c.ord.rows(), "o_custkey", col("o_orderstatus") == "F")
    return R.filter_reverse(rows, "id", c.ord.rows(), "o_custkey", col("o_orderpriority") == "1-URGENT").groupBy("id").agg(F.count("*").alias("copies"))


@query("exclude_over_many", "SELECT id FROM people p WHERE NOT EXISTS (SELECT 1 FROM ord o WHERE o.o_custkey = p.id AND o.o_orderstatus = 'F')", "people", "ord")
def _(c):
    return R.exclude_related(c.people.rows(), "id", c.ord.rows().filter("o_orderstatus = 'F'").select("o_custkey")).select("id")


@query(
    "or_across_relations",
    "SELECT id FROM people p WHERE EXISTS (SELECT 1 FROM ord o WHERE o.o_custkey = p.id AND o.o_totalprice > 400000) OR EXISTS (SELECT 1 FROM prof f WHERE f.person_id = p.id AND f.bio LIKE 'edited%')",
    "people",
    "ord",
    "prof",
)
def _(c):
    rich = c.ord.rows().filter("o_totalprice > 400000").select("o_custkey")
    return R.any_of(c.people.rows(), "id", rich, c.prof.rows().filter("bio LIKE 'edited%'").select("person_id")).select("id")


@query("related_row_as_struct", "SELECT o.id, p.c_name AS customer FROM ord o LEFT JOIN people p ON p.id = o.o_custkey", "ord", "people")
def _(c):
    return R.with_related(c.ord.rows(), "o_custkey", c.people.rows(), "id", "customer").select("id", col("customer.c_name").alias("customer"))


@query(
    "prefetched_children",
    "SELECT p.id, coalesce(string_agg(CAST(o.id AS STRING), ',' ORDER BY o.id), '') AS orders FROM people p LEFT JOIN ord o ON o.o_custkey = p.id GROUP BY 1",
    "people",
    "ord",
)
def _(c):
    rows = R.with_children(c.people.rows(), "id", c.ord.rows(), "o_custkey", "orders", ["id"])
    return rows.select("id", F.array_join(F.transform("orders", lambda o: o["id"].cast("string")), ",").alias("orders"))


@query(
    "self_many_to_many",
    "SELECT a.id, count(*) AS friends FROM people a JOIN ord l ON l.o_custkey = a.id JOIN people b ON b.id = l.id % 1000 WHERE b.c_mktsegment <> a.c_mktsegment GROUP BY 1",
    "people",
    "ord",
)
def _(c):
    link = c.ord.rows().select(col("o_custkey").alias("from_id"), (col("id") % 1000).alias("to_id"))
    a = c.people.rows().select("id", "c_mktsegment").join(link, col("id") == col("from_id"))
    b = c.people.rows().select(col("id").alias("friend"), col("c_mktsegment").alias("segment"))
    return a.join(b, col("to_id") == col("friend")).filter("segment <> c_mktsegment").groupBy("id").agg(F.count("*").alias("friends"))


@query("one_to_one_does_not_multiply", "SELECT p.id, f.bio FROM people p JOIN prof f ON f.person_id = p.id", "people", "prof")
def _(c):
    return c.people.rows().join(c.prof.rows(), col("id") == col("person_id")).select("id", "bio")


@query("through_layered_links", "SELECT o.id, count(*) AS members FROM ord o JOIN roster r ON r.order_id = o.id JOIN supp s ON s.id = -r.member_id GROUP BY 1", "ord", "roster", "supp")
def _(c):
    link = c.roster.rows().select("order_id", (-col("member_id")).alias("supplier"))
    rows = R.filter_m2m(c.ord.rows(), "id", link, "order_id", "supplier", c.supp.rows(), "id")
    return rows.groupBy("id").agg(F.count("*").alias("members"))


# -- aggregation


@query("count_split", "SELECT count(*) AS n FROM cust", "cust")
def _(c):
    return A.count_split(c.cust)


@query("count_split_no_base_hides", "SELECT count(*) AS n FROM links", "links")
def _(c):
    return A.count_split(c.links)


@query(
    "aggregate_many",
    f"SELECT count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, {MONEY('c_acctbal')} AS total, count(DISTINCT c_nationkey) AS nations, count(DISTINCT c_mktsegment) AS segments FROM people",
    "people",
)
def _(c):
    return c.people.rows().agg(
        n_(),
        F.min("c_acctbal").alias("lo"),
        F.max("c_acctbal").alias("hi"),
        money("c_acctbal").alias("total"),
        F.count_distinct("c_nationkey").alias("nations"),
        F.count_distinct("c_mktsegment").alias("segments"),
    )


@query("group_by_two", f"SELECT c_nationkey, c_mktsegment, count(*) AS n, {MONEY('c_acctbal')} AS total FROM people GROUP BY 1, 2", "people")
def _(c):
    return c.people.rows().groupBy("c_nationkey", "c_mktsegment").agg(n_(), money("c_acctbal").alias("total"))


@query("group_average", "SELECT c_mktsegment, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS average FROM people GROUP BY 1", "people")
def _(c):
    return c.people.rows().groupBy("c_mktsegment").agg(F.round(money("c_acctbal") / F.count("*"), 4).alias("average"))


@query("rollup_and_cube", f"SELECT c_mktsegment, c_nationkey % 3 AS third, count(*) AS n FROM people GROUP BY CUBE (c_mktsegment, c_nationkey % 3)", "people")
def _(c):
    return c.people.rows().withColumn("third", col("c_nationkey") % 3).cube("c_mktsegment", "third").agg(n_())


@query("duplicates_having", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM people GROUP BY 1, 2 HAVING count(*) > 1", "people")
def _(c):
    return A.duplicates(c.people.rows(), ["c_nationkey", "c_mktsegment"])


@query("resolve_distinct", "SELECT count(DISTINCT o.id) AS n FROM ord o JOIN links l ON l.l_orderkey = o.id JOIN parts p ON p.id = l.l_partkey WHERE p.p_brand = 'Brand#12'", "ord", "links", "parts")
def _(c):
    rows = R.filter_m2m(c.ord.rows(), "id", c.links.rows(), "l_orderkey", "l_partkey", c.parts.rows(), "id", col("p_brand") == "Brand#12")
    return A.resolve_count(rows, "id")


@query("distinct_on", f"SELECT DISTINCT ON (c_nationkey) {C} FROM people ORDER BY c_nationkey, c_acctbal NULLS LAST, id", "people")
def _(c):
    return G.distinct_on(c.people.rows(), ["c_nationkey"], ["c_acctbal", "id"])


@query("distinct_on_descending", f"SELECT DISTINCT ON (o_custkey) {O} FROM ord ORDER BY o_custkey, o_totalprice DESC NULLS FIRST, id", "ord")
def _(c):
    return G.distinct_on(c.ord.rows(), ["o_custkey"], ["-o_totalprice", "id"])


# -- windows


@query("window_row_number_slice", "SELECT id, row_number FROM (SELECT id, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS row_number FROM people) WHERE row_number BETWEEN 11 AND 30", "people")
def _(c):
    return G.number_rows(c.people.rows().select("id").orderBy("id").limit(30), ["id"]).filter("row_number > 10")


@query(
    "window_ranks",
    "SELECT id, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, id) AS INTEGER) AS q FROM people WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)",
    "people",
)
def _(c):
    w = Window.partitionBy("c_nationkey")
    by = w.orderBy("c_mktsegment")
    return c.people.rows().select("id", F.rank().over(by).alias("r"), F.dense_rank().over(by).alias("d"), F.ntile(4).over(w.orderBy("c_acctbal", "id")).alias("q"))


@query(
    "window_neighbours_and_running_sum",
    f"SELECT id, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM ord WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, id)",
    "ord",
)
def _(c):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "id")
    amount = F.sum(col("o_totalprice").cast("decimal(18,2)")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("double")
    return c.ord.rows().select("id", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice").over(w).alias("after"), amount.alias("running"))


# -- pages


@query("page_ordered", f"SELECT {C} FROM people ORDER BY c_acctbal NULLS LAST, id LIMIT 20", "people")
def _(c):
    return G.page(c.people.rows(), ["c_acctbal", "id"], 0, 20)


@query("page_deep_offset", f"SELECT {C} FROM people ORDER BY c_mktsegment NULLS LAST, c_acctbal DESC NULLS FIRST, id LIMIT 20 OFFSET 100", "people")
def _(c):
    return G.page(c.people.rows(), ["c_mktsegment", "-c_acctbal", "id"], 100, 120)


@query("page_nulls_last", "SELECT id, o_custkey FROM ord ORDER BY o_custkey DESC NULLS FIRST, id LIMIT 50", "ord")
def _(c):
    return G.page(c.ord.rows(), ["-o_custkey", "id"], 0, 50).select("id", "o_custkey")


@query("page_keys_first", f"SELECT {O} FROM ord ORDER BY o_totalprice NULLS LAST, id LIMIT 40 OFFSET 10", "ord")
def _(c):
    return G.late_page(c.ord.rows(), "id", ["o_totalprice", "id"], 10, 50)


@query("page_keyset", "SELECT id, c_name FROM people WHERE id > 25 ORDER BY id LIMIT 15", "people")
def _(c):
    return G.keyset_page(c.people.rows().select("id", "c_name"), "id", 25, 15)


@query("page_number_and_count", "SELECT id, c_name, (SELECT count(*) FROM cust WHERE c_nationkey = 4) AS n FROM cust WHERE c_nationkey = 4 ORDER BY id LIMIT 2 OFFSET 2", "cust")
def _(c):
    rows, count = G.page_number(c.cust.rows().filter("c_nationkey = 4").select("id", "c_name"), ["id"], 2, 2)
    return rows.withColumn("n", F.lit(count.first()["n"]))  # a pager asks twice


@query("page_across_relation", "SELECT o.id, p.c_name FROM ord o LEFT JOIN people p ON p.id = o.o_custkey ORDER BY p.c_name NULLS LAST, o.id LIMIT 30", "ord", "people")
def _(c):
    rows = R.with_related(c.ord.rows(), "o_custkey", c.people.rows(), "id", "p").select("id", col("p.c_name").alias("c_name"))
    return G.page(rows, ["c_name", "id"], 0, 30)


@query("negated_ids_order_source_first", "SELECT id FROM cust ORDER BY id LIMIT 10", "cust")
def _(c):
    return G.page(c.cust.rows().select("id"), ["id"], 0, 10)


@query("first_and_last", "SELECT * FROM (SELECT id, 'first' AS k FROM people ORDER BY id LIMIT 1) UNION ALL SELECT * FROM (SELECT id, 'last' AS k FROM people ORDER BY id DESC LIMIT 1)", "people")
def _(c):
    rows = c.people.rows().select("id")
    return G.first(rows, "id").withColumn("k", lit("first")).unionByName(G.last(rows, "id").withColumn("k", lit("last")))


@query("exists_any", "SELECT count(*) > 0 AS exists FROM people WHERE c_acctbal > 9000", "people")
def _(c):
    return G.exists(c.people.rows().filter("c_acctbal > 9000"))


# -- set operations

_A, _B = "c_acctbal > 3000", "c_mktsegment = 'BUILDING'"


@query("union_all", f"SELECT id FROM people WHERE {_A} UNION ALL SELECT id FROM people WHERE {_B}", "people")
def _(c):
    rows = c.people.rows()
    return rows.filter(_A).select("id").union(rows.filter(_B).select("id"))


@query("union_distinct", f"SELECT id FROM people WHERE {_A} UNION SELECT id FROM people WHERE {_B}", "people")
def _(c):
    rows = c.people.rows()
    return rows.filter(_A).select("id").union(rows.filter(_B).select("id")).distinct()


@query("intersection", f"SELECT id FROM people WHERE {_A} INTERSECT SELECT id FROM people WHERE {_B}", "people")
def _(c):
    rows = c.people.rows()
    return rows.filter(_A).select("id").intersect(rows.filter(_B).select("id"))


@query("difference", f"SELECT c_nationkey FROM people WHERE {_A} EXCEPT SELECT c_nationkey FROM people WHERE c_acctbal > 9950", "people")
def _(c):
    rows = c.people.rows()
    return rows.filter(_A).select("c_nationkey").subtract(rows.filter("c_acctbal > 9950").select("c_nationkey"))
