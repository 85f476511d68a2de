"""Layers derived from plain tables by rules that Spark and DuckDB read alike.

A layer is declared once: its source is a plain table (or a projection of one), its base is a list
of populations, each a key expression, a condition, column expressions and the deletion flag. From
that come both the DataFrames and the common table expressions of the SQL: ``<name>_base``,
``<name>_src`` (source rows under view ids, after the filter) and ``<name>`` (the merged view).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.layer import LayeredTable
from ..sources.snapshots import SnapshotStore
from ..spec import DELETED, LayerSpec, SourceSpec, Strategy


@dataclass(frozen=True)
class Population:
    key: str
    where: str
    change: dict[str, str] = field(default_factory=dict)
    deleted: bool = False


@dataclass(frozen=True)
class Fixture:
    spec: LayerSpec
    source: str
    populations: tuple[Population, ...]

    def layer(self, spark: SparkSession, sf_dir: str) -> LayeredTable:
        rows = plain(spark, sf_dir, self.source)
        if (sf_dir, self.spec.name) in _PUBLISHED:
            return LayeredTable(self.spec, _read(spark, _PUBLISHED[sf_dir, self.spec.name]), rows)
        parts = [rows.where(p.where).select(*map(F.expr, self._select(p))) for p in self.populations]
        base = parts[0]
        for part in parts[1:]:
            base = base.unionByName(part)
        return LayeredTable(self.spec, base, rows)

    def _select(self, p: Population) -> list[str]:
        spec = self.spec
        columns = [f"{p.key if c == spec.pk else p.change.get(c, c)} AS {c}" for c in spec.columns]
        return [*columns, *([f"{str(p.deleted).lower()} AS {DELETED}"] if spec.soft_delete else [])]

    def ctes(self) -> dict[str, str]:
        spec, n = self.spec, self.spec.name
        out = {}
        if self.source in PROJECTIONS:
            out[self.source] = PROJECTIONS[self.source]
        out[f"{n}_base"] = " UNION ALL ".join(f"SELECT {", ".join(self._select(p))} FROM {self.source} WHERE {p.where}" for p in self.populations)
        key = f"-{spec.source.id_column}" if spec.strategy.negates_source else spec.source.id_column
        mapped = ", ".join(f"{key} AS {c}" if c == spec.pk else c for c in spec.columns)
        out[f"{n}_all"] = f"SELECT {mapped} FROM {self.source}"
        where = f" WHERE {spec.source.extra_where}" if spec.source.extra_where else ""
        out[f"{n}_src"] = out[f"{n}_all"] + where
        columns = ", ".join(spec.columns)
        live = f" WHERE NOT {DELETED}" if spec.soft_delete else ""
        hidden = {"full": "", "tombstones": f" AND b.{DELETED}", None: None}[spec.anti_join]
        anti = "" if hidden is None else f" WHERE NOT EXISTS (SELECT 1 FROM {n}_base b WHERE b.{spec.pk} = s.{spec.pk}{hidden})"
        out[n] = f"SELECT 'base' AS _overlay_origin, {columns} FROM {n}_base{live} UNION ALL SELECT 'source', {columns} FROM {n}_src s{anti}"
        return out


#: Sources that are projections of a table; read the same way by both engines.
PROJECTIONS = {
    "customer_stored": "SELECT -(c_custkey + 1) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "documents_keyed": "SELECT concat('doc-', CAST(doc_id AS STRING)) AS doc_key, lang, source, n_chars FROM documents",
    "event_rows": "SELECT event_id, user_id, event_type, value FROM events",
    "orders_dated": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders",
    "lines": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem",
    "profiles": "SELECT c_custkey AS person_id, concat('bio of ', c_name) AS bio FROM customer WHERE c_custkey % 4 = 0",
    "staff_rows": "SELECT c_custkey AS staff_id, CAST(floor(c_custkey / 2) AS INTEGER) AS boss, c_name FROM customer",
    "rosters": "SELECT l_orderkey * 10 + l_linenumber AS roster_id, min(l_orderkey) AS order_id, min(l_suppkey) AS member_id FROM lineitem GROUP BY l_orderkey * 10 + l_linenumber",
}


#: What a file's columns are, by session and path: read once, as each look at a footer is a job of its own.
_SCHEMAS: dict[tuple[str, str], StructType] = {}
#: Where ``publish`` has put the bases of a folder's layers.
_PUBLISHED: dict[tuple[str, str], str] = {}


def _read(spark: SparkSession, path: str) -> DataFrame:
    at = (spark.sparkContext.applicationId, path)
    if at not in _SCHEMAS:
        _SCHEMAS[at] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[at]).parquet(path)


def plain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in PROJECTIONS:
        return _read(spark, f"{sf_dir}/{name}.parquet")
    text = PROJECTIONS[name]
    table = text.split(" FROM ")[1].split()[0]
    return spark.sql(text.replace(f" FROM {table}", " FROM {table}"), table=_read(spark, f"{sf_dir}/{table}.parquet"))


def publish(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write the base of every layer through a snapshot store under ``path``, and read it from there from now on."""
    for name, fixture in FIXTURES.items():
        store = SnapshotStore(spark, f"{path}/{name}")
        store.publish(fixture.layer(spark, sf_dir).base, store.version())
        _PUBLISHED[sf_dir, name] = store.manifest()["base"]


CUSTOMER = ("id", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
ORDERS = ("id", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
PART = ("id", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")

_FIXTURES = (
    Fixture(
        LayerSpec("cust", CUSTOMER, source=SourceSpec("c_custkey"), strategy=Strategy.NEGATIVE_ID),
        "customer",
        (
            Population("-c_custkey", "c_custkey % 10 = 0", {"c_acctbal": "c_acctbal + 1000"}),
            Population("-c_custkey", "c_custkey % 10 = 1", deleted=True),
            Population("c_custkey", "c_custkey % 10 = 2", {"c_name": "concat('Organic#', CAST(c_custkey AS STRING))"}),
            Population("-(c_custkey + 1000000)", "c_custkey % 50 = 3", deleted=True),
            Population("-(c_custkey + 2000000)", "c_custkey % 50 = 4", {"c_name": "concat('Orphan#', CAST(c_custkey AS STRING))"}),
        ),
    ),
    Fixture(
        LayerSpec("cust_fixed", CUSTOMER, source=SourceSpec("c_custkey"), strategy=Strategy.NEGATIVE_ID, overridable=False),
        "customer",
        (Population("-c_custkey", "c_custkey % 10 = 1", deleted=True), Population("c_custkey", "c_custkey % 10 = 2")),
    ),
    Fixture(
        LayerSpec("cust_neg", CUSTOMER, source=SourceSpec("c_custkey"), strategy=Strategy.NEGATIVE_SOURCE_POSITIVE_BASE_ID),
        "customer_stored",
        (
            Population("c_custkey", "c_custkey % 10 = 0", {"c_mktsegment": "'EDITED'"}),
            Population("c_custkey", "c_custkey % 10 = -1", deleted=True),
            Population("-c_custkey", "c_custkey % 10 = -2"),
        ),
    ),
    Fixture(
        LayerSpec("people", CUSTOMER, source=SourceSpec("c_custkey"), strategy=Strategy.NEGATIVE_BASE_POSITIVE_SOURCE_ID),
        "customer",
        (
            Population("c_custkey", "c_custkey % 10 = 0", {"c_acctbal": "c_acctbal + 1000", "c_mktsegment": "CASE WHEN c_custkey % 20 = 0 THEN 'EDITED' ELSE c_mktsegment END"}),
            Population("c_custkey", "c_custkey % 10 = 1", deleted=True),
            Population("-(c_custkey + 1)", "c_custkey % 10 = 2", {"c_name": "concat('Organic#', CAST(c_custkey AS STRING))"}),
            Population("c_custkey + 1000000", "c_custkey % 50 = 3", deleted=True),
            Population("c_custkey + 2000000", "c_custkey % 50 = 4", {"c_name": "concat('Orphan#', CAST(c_custkey AS STRING))"}),
        ),
    ),
    Fixture(
        LayerSpec("ord", ORDERS, source=SourceSpec("o_orderkey"), strategy=Strategy.NEGATIVE_BASE_POSITIVE_SOURCE_ID),
        "orders_dated",
        (
            Population("o_orderkey", "o_orderkey % 10 = 0", {"o_totalprice": "o_totalprice + 100", "o_custkey": "CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE o_custkey END"}),
            Population("o_orderkey", "o_orderkey % 10 = 1", deleted=True),
            Population("-(o_orderkey + 1)", "o_orderkey % 20 = 2", {"o_orderpriority": "'1-URGENT'"}),
        ),
    ),
    Fixture(
        LayerSpec("parts", PART, source=SourceSpec("p_partkey"), strategy=Strategy.NEGATIVE_BASE_POSITIVE_SOURCE_ID),
        "part",
        (
            Population("p_partkey", "p_partkey % 10 = 0", {"p_retailprice": "p_retailprice + 10"}),
            Population("p_partkey", "p_partkey % 10 = 1", deleted=True),
            Population("-(p_partkey + 1)", "p_partkey % 10 = 2"),
        ),
    ),
    Fixture(
        LayerSpec("supp", ("id", "s_name", "s_nationkey", "s_acctbal"), source=SourceSpec("s_suppkey"), strategy=Strategy.NEGATIVE_ID, soft_delete=False),
        "supplier",
        (
            Population("-s_suppkey", "s_suppkey % 5 = 0", {"s_acctbal": "s_acctbal * 2"}),
            Population("s_suppkey", "s_suppkey % 5 = 1", {"s_name": "concat('Own#', CAST(s_suppkey AS STRING))"}),
        ),
    ),
    Fixture(
        LayerSpec(
            "links",
            ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"),
            pk="l_orderkey",
            source=SourceSpec("l_orderkey"),
            strategy=Strategy.NEGATIVE_BASE_POSITIVE_SOURCE_ID,
            soft_delete=False,
            overridable=False,
        ),
        "lines",
        (Population("l_orderkey", "l_orderkey % 97 = 5", {"l_quantity": "l_quantity + 100"}),),
    ),
    Fixture(
        LayerSpec("docs", ("id", "lang", "source", "n_chars"), source=SourceSpec("doc_key", extra_where="lang = 'en'"), strategy=Strategy.UUID4),
        "documents_keyed",
        (
            Population("doc_key", "n_chars % 10 = 0", {"source": "'edited'"}),
            Population("doc_key", "n_chars % 10 = 1", deleted=True),
            Population("concat('own-', doc_key)", "n_chars % 10 = 2"),
        ),
    ),
    Fixture(
        LayerSpec(
            "evt",
            ("id", "user_id", "event_type", "value"),
            source=SourceSpec("event_id", partition_key="event_type"),
            strategy=Strategy.NEGATIVE_BASE_POSITIVE_SOURCE_ID,
        ),
        "event_rows",
        (
            Population("event_id", "event_id % 10 = 0", {"value": "value + 1"}),
            Population("event_id", "event_id % 10 = 1", deleted=True),
        ),
    ),
    Fixture(
        LayerSpec("prof", ("person_id", "bio"), pk="person_id", source=SourceSpec("person_id"), strategy=Strategy.NEGATIVE_BASE_POSITIVE_SOURCE_ID, pk_is_relation=True),
        "profiles",
        (Population("person_id", "person_id % 8 = 0", {"bio": "concat('edited ', bio)"}),),
    ),
    Fixture(
        LayerSpec("staff", ("id", "boss", "c_name"), source=SourceSpec("staff_id"), strategy=Strategy.NEGATIVE_BASE_POSITIVE_SOURCE_ID),
        "staff_rows",
        (Population("staff_id", "staff_id % 10 = 0", {"c_name": "concat('edited ', c_name)"}), Population("staff_id", "staff_id % 50 = 49", deleted=True)),
    ),
    Fixture(
        LayerSpec("roster", ("id", "order_id", "member_id"), source=SourceSpec("roster_id"), strategy=Strategy.NEGATIVE_BASE_POSITIVE_SOURCE_ID, overridable=False),
        "rosters",
        (Population("roster_id", "roster_id % 7 = 0", deleted=True), Population("-(roster_id + 1)", "roster_id % 11 = 0", {"member_id": "member_id + 1"})),
    ),
)
FIXTURES = {f.spec.name: f for f in _FIXTURES}


def with_ctes(names: tuple[str, ...], body: str) -> str:
    """``body`` with the expressions of these layers before it."""
    ctes: dict[str, str] = {}
    for name in names:
        ctes |= FIXTURES[name].ctes()
    return ("WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + " " if ctes else "") + " ".join(body.split())
