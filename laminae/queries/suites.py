"""The analytic workloads: conjunctions of relations, scopes of growing breadth, summary panels, and the strategies for each."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import page as G
from ..operators import relate as R
from ..operators.aggregate import bucket_counts
from ..operators.layer import LayeredTable
from ..plans import strategies as ST
from ..sources import graph
from ..sources.settle import shared_folder
from .reads import O, n_
from .registry import query

col, lit = F.col, F.lit

#: Conditions on orders through their relations: (name, SQL join and predicate, keys of the matching links).
HOPS = (
    ("brand", "JOIN links l{i} ON l{i}.l_orderkey = o.id JOIN parts t{i} ON t{i}.id = l{i}.l_partkey AND t{i}.p_brand = 'Brand#12'"),
    ("vendor", "JOIN links l{i} ON l{i}.l_orderkey = o.id JOIN supplier t{i} ON t{i}.s_suppkey = l{i}.l_suppkey AND t{i}.s_nationkey < 8"),
    ("size", "JOIN links l{i} ON l{i}.l_orderkey = o.id JOIN parts t{i} ON t{i}.id = l{i}.l_partkey AND t{i}.p_size < 25"),
    ("returned", "JOIN links l{i} ON l{i}.l_orderkey = o.id AND l{i}.l_returnflag = 'R' JOIN parts t{i} ON t{i}.id = l{i}.l_partkey"),
)
_LAYERS = ("ord", "links", "parts")


def leaf(c, name: str):
    """Order keys of the links that meet a condition, one for each link."""
    links, parts = c.links.rows(), c.parts.rows()
    if name == "vendor":
        return R.m2m_keys(links, "l_orderkey", "l_suppkey", c.table("supplier"), "s_suppkey", col("s_nationkey") < 8)
    if name == "returned":
        return R.m2m_keys(links.filter("l_returnflag = 'R'"), "l_orderkey", "l_partkey", parts, "id")
    where = {"brand": col("p_brand") == "Brand#12", "size": col("p_size") < 25}[name]
    return R.m2m_keys(links, "l_orderkey", "l_partkey", parts, "id", where)


def _joins(k: int) -> str:
    return " ".join(text.format(i=i) for i, (_, text) in enumerate(HOPS[:k]))


def _hops(k: int) -> None:
    names = [name for name, _ in HOPS[:k]]

    @query(f"hops_{k}_resolve", f"SELECT count(DISTINCT o.id) AS n FROM ord o {_joins(k)}", *_LAYERS)
    def _(c):
        # Only the number of different orders is asked for, so each condition is a semi-join.
        return R.all_of(c.ord.rows(), "id", *(leaf(c, n) for n in names)).agg(n_())

    @query(f"hops_{k}_page", f"SELECT DISTINCT o.{O.replace(', ', ', o.')} FROM ord o {_joins(k)} ORDER BY o.o_totalprice DESC NULLS FIRST, o.id LIMIT 200", *_LAYERS)
    def _(c):
        return G.page(R.all_of(c.ord.rows(), "id", *(leaf(c, n) for n in names)), ["-o_totalprice", "id"], 0, 200)


for _k in range(1, 5):
    _hops(_k)


@query("hops_2_multiplicity", f"SELECT count(*) AS n FROM ord o {_joins(2)}", *_LAYERS)
def _(c):
    rows = c.ord.rows().select("id")
    for name in ("brand", "vendor"):
        # A count of copies for each key, so that no copy is made before it is counted.
        copies = leaf(c, name).groupBy(col("l_orderkey").alias("k")).agg(F.count("*").alias(f"n_{name}"))
        rows = rows.join(copies, col("id") == col("k")).drop("k")
    return rows.agg(F.coalesce(F.sum(col("n_brand") * col("n_vendor")), lit(0)).alias("n"))


# -- scopes of growing breadth over one relation, resolved and paged

for _name, _where in {"narrow": "p_size = 1", "tenth": "p_size <= 5", "half": "p_size <= 25", "all": "p_size > 0"}.items():

    @query(f"scope_{_name}_resolve", f"SELECT count(DISTINCT o.id) AS n FROM ord o JOIN links l ON l.l_orderkey = o.id JOIN parts p ON p.id = l.l_partkey WHERE p.{_where}", *_LAYERS)
    def _(c, where=_where):
        keys = R.m2m_keys(c.links.rows(), "l_orderkey", "l_partkey", c.parts.rows(), "id", F.expr(where))
        return P.in_keys(c.ord.rows(), "id", keys).agg(n_())

    @query(
        f"scope_{_name}_page",
        f"SELECT {O} FROM ord o WHERE EXISTS (SELECT 1 FROM links l JOIN parts p ON p.id = l.l_partkey WHERE l.l_orderkey = o.id AND p.{_where}) ORDER BY o_orderdate NULLS LAST, id LIMIT 20",
        *_LAYERS,
    )
    def _(c, where=_where):
        keys = R.m2m_keys(c.links.rows(), "l_orderkey", "l_partkey", c.parts.rows(), "id", F.expr(where))
        return G.page(P.in_keys(c.ord.rows(), "id", keys), ["o_orderdate", "id"], 0, 20)


# -- one scope with conditions on layered and plain relations


#: Conditions on orders, through the layered parts of their lines or the plain suppliers: SQL, keys of the matching links.
_VIEW = {"narrow": "p_size = 1", "mid": "p_size <= 5", "broad": "p_size <= 25"}
_PLAIN = {"narrow": "s_nationkey = 7", "broad": "s_nationkey < 12"}
_CASES = {
    "plain_narrow": ("plain narrow",),
    "plain_broad": ("plain broad",),
    "view_narrow": ("view narrow",),
    "view_mid": ("view mid",),
    "plain_and_plain": ("plain narrow", "plain broad"),
    "view_and_narrow_plain": ("view mid", "plain narrow"),
    "view_and_broad_plain": ("view mid", "plain broad"),
    "view_and_view": ("view mid", "view broad"),
    "view_view_and_plain": ("view mid", "view broad", "plain narrow"),
}


def _condition_sql(case: str) -> str:
    kind, breadth = case.split()
    far = "parts t ON t.id = l.l_partkey" if kind == "view" else "supplier t ON t.s_suppkey = l.l_suppkey"
    where = (_VIEW if kind == "view" else _PLAIN)[breadth]
    return f"EXISTS (SELECT 1 FROM links l JOIN {far} WHERE l.l_orderkey = o.id AND t.{where})"


def _condition(c, case: str):
    kind, breadth = case.split()
    if kind == "view":
        return R.m2m_keys(c.links.rows(), "l_orderkey", "l_partkey", c.parts.rows(), "id", F.expr(_VIEW[breadth]))
    return R.m2m_keys(c.links.rows(), "l_orderkey", "l_suppkey", c.table("supplier"), "s_suppkey", F.expr(_PLAIN[breadth]))


for _name, _conditions in _CASES.items():

    @query(f"hybrid_{_name}", f"SELECT count(*) AS n FROM ord o WHERE {' AND '.join(map(_condition_sql, _conditions))}", *_LAYERS)
    def _(c, conditions=_conditions):
        return R.all_of(c.ord.rows().select("id"), "id", *(_condition(c, x) for x in conditions)).agg(n_())


# -- a summary of 17 numbers over four scopes, in five formulations

BUCKETS = {
    **{f"price_{i}": f"o_totalprice >= {i * 100_000} AND o_totalprice < {(i + 1) * 100_000}" for i in range(5)},
    **{f"status_{s.lower()}": f"o_orderstatus = '{s}'" for s in ("F", "O", "P")},
    **{f"priority_{i}": f"starts_with(o_orderpriority, '{i}')" for i in range(1, 6)},
    **{f"year_{y}": f"year(o_orderdate) = {y}" for y in (1992, 1993, 1994)},
}
_PANEL = ", ".join(["count(*) AS total", *(f"count(*) FILTER (WHERE {w}) AS {b}" for b, w in BUCKETS.items())])


def _buckets() -> dict:
    return {b: F.expr(w.replace("starts_with", "startswith")) for b, w in BUCKETS.items()}


SCOPES = {
    "brand": ("p_brand = 'Brand#12'", lambda: col("p_brand") == "Brand#12"),
    "wide": ("p_size > 5", lambda: col("p_size") > 5),
}
for _scope, (_sql, _where) in SCOPES.items():
    for _panel in ST.PANELS:

        @query(
            f"panel_{_panel}_{_scope}",
            f"SELECT {_PANEL} FROM ord o WHERE EXISTS (SELECT 1 FROM links l JOIN parts p ON p.id = l.l_partkey WHERE l.l_orderkey = o.id AND {_sql})",
            *_LAYERS,
        )
        def _(c, panel=_panel, where=_where):
            keys = R.m2m_keys(c.links.rows(), "l_orderkey", "l_partkey", c.parts.rows(), "id", where())
            return ST.PANELS[panel](c.ord.rows(), "id", keys, _buckets())


@query("panel_without_scope", f"SELECT {_PANEL} FROM ord", "ord")
def _(c):
    return c.ord.rows().agg(F.count("*").alias("total"), *bucket_counts(_buckets()))


@query(
    "panel_with_reach",
    f"SELECT {_PANEL}, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM links l WHERE l.l_orderkey = o.id)) AS with_lines, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM people p WHERE p.id = o.o_custkey)) AS with_customer FROM ord o",
    "ord",
    "links",
    "people",
)
def _(c):
    rows = R.with_count(c.ord.rows(), "id", c.links.rows(), "l_orderkey", "lines")
    rows = R.with_related(rows, "o_custkey", c.people.rows().select("id"), "id", "customer")
    buckets = _buckets() | {"with_lines": col("lines") > 0, "with_customer": col("customer").isNotNull()}
    return rows.agg(F.count("*").alias("total"), *bucket_counts(buckets))


# -- strategies over two and three leaves

for _leaves in (2, 3):
    for _name, _strategy in ST.STAGED.items():

        @query(f"staged_{_name}_{_leaves}", f"SELECT DISTINCT o.id FROM ord o {_joins(_leaves)}", *_LAYERS)
        def _(c, strategy=_strategy, leaves=_leaves):
            return strategy(c.ord.rows(), "id", [leaf(c, n) for n, _ in HOPS[:leaves]])


# -- a reverse key as a join, a join after a semi-join, and a semi-join

_REVERSE = "SELECT count(DISTINCT p.id) AS n FROM people p JOIN ord o ON o.o_custkey = p.id WHERE o.o_totalprice > 250000"


@query("reverse_arm_join", _REVERSE, "people", "ord")
def _(c):
    return R.filter_reverse(c.people.rows(), "id", c.ord.rows(), "o_custkey", col("o_totalprice") > 250000).select("id").distinct().agg(n_())


@query("reverse_arm_fenced", _REVERSE, "people", "ord")
def _(c):
    rich = c.ord.rows().filter("o_totalprice > 250000")
    return R.filter_reverse(P.in_keys(c.people.rows(), "id", rich.select("o_custkey")), "id", rich, "o_custkey").select("id").distinct().agg(n_())


@query("reverse_arm_semi", _REVERSE, "people", "ord")
def _(c):
    return R.filter_reverse(c.people.rows(), "id", c.ord.rows(), "o_custkey", col("o_totalprice") > 250000, once=True).agg(n_())


@query(
    "reverse_beside_or_of_key_sets",
    "SELECT count(*) AS n FROM people p WHERE EXISTS (SELECT 1 FROM ord o WHERE o.o_custkey = p.id AND o.o_totalprice > 250000) AND (p.id IN (SELECT o_custkey FROM ord WHERE o_orderstatus = 'F') OR p.id IN (SELECT person_id FROM prof))",
    "people",
    "ord",
    "prof",
)
def _(c):
    rows = R.filter_reverse(c.people.rows(), "id", c.ord.rows(), "o_custkey", col("o_totalprice") > 250000, once=True)
    return R.any_of(rows, "id", c.ord.rows().filter("o_orderstatus = 'F'").select("o_custkey"), c.prof.rows().select("person_id")).agg(n_())


# -- keys kept in the engine, from the link side, and a page by keyset through all rows


@query("from_the_links_outwards", "SELECT p.c_mktsegment, count(*) AS n FROM links l JOIN ord o ON o.id = l.l_orderkey JOIN people p ON p.id = o.o_custkey JOIN parts t ON t.id = l.l_partkey WHERE t.p_size < 10 GROUP BY 1", "links", "ord", "people", "parts")
def _(c):
    lines = R.filter_forward(c.links.rows(), "l_partkey", c.parts.rows(), "id", col("p_size") < 10).select("l_orderkey")
    # Lines are counted by order before they meet orders and people.
    lines = lines.groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    rows = lines.join(c.ord.rows().select("id", "o_custkey"), col("l_orderkey") == col("id")).drop("id")
    people = c.people.rows().select(col("id").alias("pid"), "c_mktsegment")
    return rows.join(people, col("o_custkey") == col("pid")).groupBy("c_mktsegment").agg(F.sum("lines").alias("n"))


# -- a detail page in three ways, for the dearest order

_ONE = "(SELECT id FROM ord ORDER BY o_totalprice DESC NULLS FIRST, id LIMIT 1)"


def _one(c):
    return G.first(c.ord.rows().select("id", "o_totalprice"), "-o_totalprice", "id").select("id")


@query("detail_by_join", f"SELECT t.id, t.p_name FROM links l JOIN parts t ON t.id = l.l_partkey WHERE l.l_orderkey = {_ONE}", *_LAYERS)
def _(c):
    lines = P.in_keys(c.links.rows(), "l_orderkey", _one(c)).select("l_partkey")
    return lines.join(c.parts.rows(), col("l_partkey") == col("id")).select("id", "p_name")


_DETAIL = f"SELECT t.id, t.p_name FROM parts t WHERE t.id IN (SELECT l_partkey FROM links WHERE l_orderkey = {_ONE})"


@query("detail_by_keys_in_the_engine", _DETAIL, *_LAYERS)
def _(c):
    return P.in_keys(c.parts.rows(), "id", P.in_keys(c.links.rows(), "l_orderkey", _one(c)).select("l_partkey"), small=True).select("id", "p_name")


@query("detail_by_two_queries", _DETAIL, *_LAYERS)
def _(c):
    # The keys of one order are read and sent back, as a prefetch does: a handful.
    key = _one(c).first()["id"]
    parts = [r[0] for r in c.links.rows().filter(col("l_orderkey") == key).select("l_partkey").collect()]
    return P.in_literals(c.parts.rows(), "id", parts).select("id", "p_name")


# -- key lists: read and sent back, or kept in the engine

for _label, _count in (("1", 1), ("5", 5), ("25", 25)):
    _sql = f"SELECT id, c_acctbal FROM people WHERE id IN (SELECT id FROM people WHERE c_nationkey < {_count})"

    @query(f"lists_{_label}_kept_in_the_engine", _sql, "people")
    def _(c, count=_count):
        return P.in_keys(c.people.rows(), "id", c.people.rows().filter(col("c_nationkey") < count).select("id")).select("id", "c_acctbal")

    @query(f"lists_{_label}_round_trip", _sql, "people")
    def _(c, count=_count):
        # What a caller with a list in hand does; the list is as large as their memory allows, so keep keys in the engine.
        keys = [r[0] for r in c.people.rows().filter(col("c_nationkey") < count).select("id").collect()]
        return P.in_literals(c.people.rows(), "id", keys).select("id", "c_acctbal")


# -- two conditions, one of them from narrow to broad

_SWEEP = {"1_size": "p_size = 1", "3_sizes": "p_size <= 3", "10_sizes": "p_size <= 10", "25_sizes": "p_size <= 25", "all_sizes": "p_size > 0"}
for _name, _where in _SWEEP.items():
    _sql = f"FROM ord o WHERE EXISTS (SELECT 1 FROM links l JOIN parts t ON t.id = l.l_partkey WHERE l.l_orderkey = o.id AND t.{_where}) AND EXISTS (SELECT 1 FROM links l JOIN supplier t ON t.s_suppkey = l.l_suppkey WHERE l.l_orderkey = o.id AND t.s_nationkey < 8)"

    def _scope(c, where):
        return R.m2m_keys(c.links.rows(), "l_orderkey", "l_partkey", c.parts.rows(), "id", F.expr(where)), leaf(c, "vendor")

    @query(f"selectivity_{_name}_resolve", f"SELECT o.id {_sql}", *_LAYERS)
    def _(c, where=_where):
        return R.all_of(c.ord.rows().select("id"), "id", *_scope(c, where))

    @query(f"selectivity_{_name}_summarise", f"SELECT {_PANEL} {_sql}", *_LAYERS)
    def _(c, where=_where):
        one, two = _scope(c, where)
        return ST.panel_semi(P.in_keys(c.ord.rows(), "id", one), "id", two, _buckets())


# -- twenty aggregates over four scopes: seventeen of the rows, three of what they reach


def _reach_sql(where: str) -> str:
    scope = f"FROM ord o WHERE {where}"
    lines = f"FROM links l WHERE l.l_orderkey IN (SELECT o.id {scope})"
    return f"(SELECT count(DISTINCT l.l_partkey) {lines}) AS part_count, (SELECT count(DISTINCT l.l_suppkey) {lines}) AS supplier_count, (SELECT count(*) FROM people p WHERE p.id IN (SELECT o.o_custkey {scope})) AS customer_count"


_AREAS = {
    "few": ("o_orderdate < DATE '1992-03-01'", lambda c, rows: rows.filter("o_orderdate < DATE '1992-03-01'")),
    "half": ("o_totalprice < 200000", lambda c, rows: rows.filter("o_totalprice < 200000")),
    "everyone": ("true", lambda c, rows: rows),
    "join_heavy": (f"{_condition_sql('view mid')} AND {_condition_sql('plain broad')}", lambda c, rows: R.all_of(rows, "id", _condition(c, "view mid"), _condition(c, "plain broad"))),
}
for _name, (_sql, _rows) in _AREAS.items():

    @query(f"aggregates_20_{_name}", f"SELECT {_PANEL}, {_reach_sql(_sql)} FROM ord o WHERE {_sql}", "people", *_LAYERS)
    def _(c, rows=_rows):
        scope = rows(c, c.ord.rows())
        own = scope.agg(F.count("*").alias("total"), *bucket_counts(_buckets()))
        lines = P.in_keys(c.links.rows(), "l_orderkey", scope.select("id"))
        # A distinct count is two aggregations; one over both columns would copy every line.
        reach = [lines.select(k).distinct().agg(F.count(k).alias(n)) for k, n in (("l_partkey", "part_count"), ("l_suppkey", "supplier_count"))]
        reach.append(P.in_keys(c.people.rows(), "id", scope.select("o_custkey")).agg(F.count("*").alias("customer_count")))
        out = own
        for one in reach:
            out = out.unionByName(one, allowMissingColumns=True)
        return out.agg(*(F.max(n).alias(n) for n in out.columns))


# -- the link layer: lookup, page, deep offset, count

_L = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


@query("links_lookup", f"SELECT {_L} FROM links WHERE l_orderkey = {_ONE}", *_LAYERS)
def _(c):
    return P.in_keys(c.links.rows(), "l_orderkey", _one(c), small=True).select(*_L.split(", "))


for _name, _start in (("page", 0), ("deep_offset", 1000)):

    @query(f"links_{_name}", f"SELECT {_L}, l_quantity FROM links ORDER BY l_partkey, l_orderkey, l_linenumber, l_quantity LIMIT 20 OFFSET {_start}", "links")
    def _(c, start=_start):
        return G.page(c.links.rows().select(*_L.split(", "), "l_quantity"), ["l_partkey", "l_orderkey", "l_linenumber", "l_quantity"], start, start + 20)


@query("links_count", "SELECT count(*) AS n FROM links", "links")
def _(c):
    return c.links.rows().agg(n_())


# -- pages under narrower scopes and of larger sizes, from a cursor, and without an order

for _name, _where in {"all": "true", "tenth": "o_totalprice < 40000", "few": "o_totalprice < 5000"}.items():

    @query(f"page_scope_{_name}", f"SELECT {O} FROM ord WHERE {_where} ORDER BY id LIMIT 50", "ord")
    def _(c, where=_where):
        return G.page(c.ord.rows().filter(where), ["id"], 0, 50)


for _size in (20, 200, 2000):

    @query(f"page_of_{_size}", f"SELECT {O} FROM ord ORDER BY id LIMIT {_size}", "ord")
    def _(c, size=_size):
        return G.page(c.ord.rows(), ["id"], 0, size)


@query("page_cursor_in_scope", f"SELECT {O} FROM ord WHERE id > 500 AND o_totalprice < 40000 ORDER BY id LIMIT 50", "ord")
def _(c):
    return G.keyset_page(c.ord.rows().filter("o_totalprice < 40000"), "id", 500, 50)


@query("page_without_order", "SELECT count(*) AS n FROM (SELECT id FROM people LIMIT 50)", "people")
def _(c):
    return c.people.rows().limit(50).agg(n_())


# -- a source that is partitioned on disk

for _parts in (4, 16, 64):
    _evt = f"FROM evt WHERE user_id % {_parts} = 3"

    @query(f"partitions_{_parts}_one", f"SELECT _overlay_origin, id, user_id, value {_evt}", "evt")
    def _(c, parts=_parts):
        return _partitioned(c, parts).narrowed([3]).view.select("_overlay_origin", "id", "user_id", "value")

    @query(f"partitions_{_parts}_all", f"SELECT CAST(user_id % {_parts} AS INTEGER) AS part, count(*) AS n FROM evt GROUP BY 1", "evt")
    def _(c, parts=_parts):
        return _partitioned(c, parts).rows().groupBy("part").agg(n_())


def _partitioned(c, parts: int) -> LayeredTable:
    """The events' layer over a source written by ``user_id`` modulo ``parts``; its base knows each row's partition."""
    part = F.pmod("user_id", lit(parts)).cast("int")
    path = f"{shared_folder(c.spark)}/partitioned-{parts}-{uuid.uuid4().hex}"
    c.evt.source_table.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(path)
    spec = replace(c.evt.spec, columns=(*c.evt.spec.columns, "part"), source=replace(c.evt.spec.source, partition_key="part"))
    return LayeredTable(spec, c.evt.base.withColumn("part", part), c.spark.read.parquet(path))


@query(
    "generated_graph_adds_up",
    """SELECT k, CAST(n AS INTEGER) AS n FROM (
    WITH src AS (SELECT range AS id FROM range(1, 801)), base AS (SELECT range AS id FROM range(1, 201) UNION ALL SELECT -range FROM range(1, 201)),
    view AS (SELECT id FROM base UNION ALL SELECT id FROM src WHERE id NOT IN (SELECT id FROM base))
    SELECT 'base' AS k, count(*) AS n FROM base UNION ALL SELECT 'source', count(*) FROM src WHERE id NOT IN (SELECT id FROM base)
    UNION ALL SELECT 'overridden', count(*) FROM base WHERE id IN (SELECT id FROM src) UNION ALL SELECT 'organic', count(*) FROM base WHERE id NOT IN (SELECT id FROM src)
    UNION ALL SELECT 'mirror', count(*) FROM view UNION ALL SELECT 'dangling', 0)""",
)
def _(c):
    sizes = graph.GraphSizes().scaled(0.1)
    person = graph.entity(c.spark, "person", sizes.people, sizes.base_share)
    links = graph.link(c.spark, sizes.person_phone, ("person_id", sizes.people), ("phone_id", sizes.phones), sizes.base_share / 2)
    lost = links.join(person.rows().select(col("id").alias("p")), col("person_id") == col("p"), "left_anti")
    parts = (("base", person.base_only()), ("source", person.source_only()), ("overridden", person.overridden()), ("organic", person.organic()), ("mirror", graph.mirror(person)), ("dangling", lost))
    out = None
    for k, rows in parts:
        one = rows.agg(n_()).select(lit(k).alias("k"), col("n").cast("int").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
