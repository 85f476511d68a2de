"""Plans and work that must stay small as tables grow."""

from collections import Counter

from laminae import LayeredTable, LayerSpec, RedundantPolicy, Relation, SourceSpec, Strategy, Unique
from laminae.operators import cascade, changes, integrity
from laminae.plans import inspect, strategies
from pyspark.sql import functions as F

col, lit = F.col, F.lit


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def joins(df):
    found = inspect.operators(df)
    return sum(n for name, n in found.items() if "Join" in name)


def people(spark, n=40):
    """Untouched rows, overrides, tombstones and rows of the base's own."""
    spec = LayerSpec("person", ("id", "name", "age"), source=SourceSpec("id"), strategy=Strategy.NEGATIVE_BASE_POSITIVE_SOURCE_ID)
    source = spark.createDataFrame([(i, f"n{i}", i % 7) for i in range(n)], "id long, name string, age int")
    base = [(i, f"edited {i}", i % 7, False) for i in range(0, n, 5)] + [(i, f"n{i}", 0, True) for i in range(1, n, 5)] + [(-i, f"own {i}", 3, False) for i in range(1, 5)]
    # A deletion flag that is null makes a row neither live nor a tombstone, and it hides its source row.
    base.append((7, "unsure", 1, None))
    return LayeredTable(spec, spark.createDataFrame(base, "id long, name string, age int, _overlay_deleted boolean"), source)


def defined(layer):
    """The view as base and source make it."""
    return LayeredTable(layer.spec, layer.base, layer.source_table).view


def test_an_update_passes_over_the_view_once(spark):
    layer = people(spark)
    before = rows(layer.base)
    keys = spark.createDataFrame([(i,) for i in (2, 2, 5, 1, -3, None, 99, 7)], "k long")
    text = keys.select(F.when(col("k") == 5, "05").otherwise(col("k").cast("string")).alias("k")).unionByName(keys.select(col("k").cast("string")))
    for where in (keys, text, col("id").isin(2, 5, 1, -3, 99, 7)):
        change = changes.update(layer, where, {"age": lit(99)})
        assert joins(change.layer.view) <= 2 + joins(layer.view) and joins(change.base) <= 2 + joins(layer.view)
        assert rows(change.layer.view) == rows(defined(change.layer))
        assert {r["id"]: r["_overlay_origin"] for r in change.layer.view.filter("age = 99").collect()} == {2: "base", 5: "base", -3: "base"}
        kept = before - rows(change.base)
        assert {r[0] for r in kept} == {5, -3} and (7, "unsure", 1, None) in rows(change.base)


def test_pairs_of_one_value_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(integrity, "TASK_PAIRS", 8, raising=False)
    monkeypatch.setattr(integrity, "CELL_PAIRS", 16, raising=False)
    layer = people(spark, 200)
    found = integrity.source_collisions(layer, Unique(("age",), "name <> 'n8'"))
    own = [r for r in layer.live_base().collect() if r["name"] != "n8"]
    theirs = [r for r in layer.source_only().collect() if r["name"] != "n8"]
    assert rows(found) == Counter((a["id"], a["age"], b["id"]) for a in own for b in theirs if a["age"] == b["age"] and a["id"] != b["id"])
    task = found.groupBy(F.spark_partition_id().alias("task")).count()
    assert task.agg(F.max("count")).first()[0] < found.count() / 8


def test_a_delete_leaves_the_view_but_for_its_rows(spark):
    layer = people(spark)
    keys = spark.createDataFrame([(i,) for i in (2, 2, 5, 1, -3, None, 99, 7)], "k long")
    for where in (keys, col("id").isin(2, 5, 1, -3, 99, 7)):
        after = changes.delete(layer, where).layer
        assert joins(after.view) <= 2 + joins(layer.view)
        assert rows(after.view) == rows(defined(after)) == rows(layer.view.filter("id NOT IN (2, 5, -3)"))
        assert {r["id"] for r in after.tombstones().collect()} == {2, 5, *range(1, 40, 5)}


def test_cleared_references_pass_over_the_child_once(spark):
    layer = people(spark)
    doomed = cascade.delete_cascade({"person": layer}, [Relation("person", "age", "person", on_delete="set_null")], "person", layer.rows().filter("id = 2").select("id"))
    after = doomed["person"]
    assert joins(after.view) <= 8
    assert rows(after.view) == rows(defined(after))
    assert after.view.filter("age IS NULL").count() == layer.view.filter("age = 2 AND id <> 2").count() > 0


def test_rows_set_and_created_pass_over_the_view_once(spark):
    layer = people(spark)
    given = spark.createDataFrame([("n2", 50), ("edited 5", 5), ("own 3", 51), ("n7", 52), ("someone", 53), (None, 54)], "name string, age int")
    for policy in (None, RedundantPolicy("skip"), RedundantPolicy("skip", "all")):
        after = changes.update_or_create(layer, given, ["name"], policy, order_by=["age"]).layer
        assert joins(after.view) <= 2 + joins(layer.view) and joins(after.base) <= 3 + joins(layer.view)
        assert rows(after.view) == rows(defined(after))
        ages = {r["name"]: (r["_overlay_origin"], r["age"]) for r in after.view.filter("age >= 50").collect()}
        assert ages == {"n2": ("base", 50), "own 3": ("base", 51), "n7": ("base", 52), "someone": ("base", 53), None: ("base", 54)}


def test_a_joined_panel_copies_no_row_for_a_bucket(spark):
    df = spark.createDataFrame([(i, i % 5 if i % 7 else None) for i in range(50)], "id long, v int")
    keys = spark.createDataFrame([(i % 30,) for i in range(200)] + [(None,)], "k long")
    buckets = {f"at_{i}": col("v") == i for i in range(5)} | {"low": col("v") < 3, "none": col("v") > 9}
    found = strategies.panel_joined(df, "id", keys, buckets)
    assert "Expand" not in inspect.text(found)
    assert found.first().asDict() == strategies.panel_semi(df, "id", keys, buckets).first().asDict()
