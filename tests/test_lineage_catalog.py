import pytest
from pyspark.sql import functions as F

from vigil.operators import catalog as CA
from vigil.operators import lineage as LI

EDGE = "source_table string, source_column string, target_table string, target_column string, transform string"


def test_upstream_downstream(spark):
    e = spark.createDataFrame([("order_items", "price", "orders", "total", "SUM(price * qty)")], EDGE)
    up = LI.lineage_upstream(e, spark.createDataFrame([("orders", "total"), ("orders", "id")], "table string, column string"))
    got = sorted((r["column"], r["source"]) for r in up.collect())
    assert got == [("id", None), ("total", "order_items.price")]
    down = LI.lineage_downstream(e).collect()
    assert [(r["table"], r["target"]) for r in down] == [("order_items", "orders.total")]


def test_closure_chain_and_diamond(spark):
    e = spark.createDataFrame([("r", "a", "n", "a", None), ("n", "a", "c", "a", "direct"), ("c", "a", "o", "a", "x"),
                               ("r", "a", "c", "a", "shortcut")], EDGE)
    cl = {(r["source_table"], r["target_table"]): r["hops"] for r in LI.lineage_closure(e).collect()}
    assert cl == {("r", "n"): 1, ("n", "c"): 1, ("c", "o"): 1, ("r", "c"): 1, ("n", "o"): 2, ("r", "o"): 2}


@pytest.fixture
def cat(spark):
    tables = spark.createDataFrame([("parcels", "Every parcel that a carrier took over", ["internal", "daily"]),
                                    ("carriers", "Master data of carriers", ["internal"])],
                                   "table_name string, description string, tags array<string>")
    cols = spark.createDataFrame([("parcels", "parcel_no", "INTEGER", False, "Number on the label"),
                                  ("parcels", "carrier_no", "INTEGER", False, "Who moves it"),
                                  ("parcels", "weight", "FLOAT", True, "Kilograms"),
                                  ("parcels", "place", "VARCHAR", True, "")],
                                 "table_name string, name string, type string, nullable boolean, description string")
    usage = spark.createDataFrame([("parcels", "load_plan", "weight"), ("parcels", "load_plan", "place"), ("parcels", "billing", "weight")],
                                  "table_name string, pipeline string, column_name string")
    return tables, cols, usage


def test_search_and_tags(cat):
    tables, cols, _ = cat
    hits = sorted((r["kind"], r["name"]) for r in CA.catalog_search(tables, cols, "carrier").collect())
    assert hits == [("column", "carrier_no"), ("table", "carriers"), ("table", "parcels")]
    assert CA.catalog_search(tables, cols, "internal", scope="tags").collect()[0]["description"] == "2 tables"
    assert {r["tag"]: r["table_count"] for r in CA.tag_counts(tables).collect()} == {"internal": 2, "daily": 1}


def test_describe_and_impact(spark, cat):
    tables, cols, usage = cat
    upstream = spark.createDataFrame([("parcels", "scanner"), ("parcels", "depot"), ("parcels", "scanner")], "table_name string, source string")
    queries = spark.createDataFrame([("parcels",)] * 3, "table_name string")
    d = {r["table_name"]: r for r in CA.catalog_describe(tables, cols, usage, upstream, queries).collect()}
    assert d["parcels"]["column_count"] == 4 and d["parcels"]["downstream_pipelines"] == 2
    assert d["parcels"]["upstream_sources"] == ["depot", "scanner"] and d["parcels"]["query_count"] == 3
    assert (d["carriers"]["column_count"], d["carriers"]["upstream_sources"], d["carriers"]["query_count"]) == (0, [], 0)
    changes = spark.createDataFrame([("parcels", "weight", "drop", None), ("parcels", "place", "rename", "stop"),
                                     ("parcels", "parcel_no", "modify", None), ("parcels", "x", "note", None)],
                                    "table_name string, column string, change_type string, new_name string")
    imp = {r["column"]: r for r in CA.impact_analysis(changes, usage).collect()}
    assert imp["weight"]["severity"] == "high" and imp["weight"]["pipelines"] == ["billing", "load_plan"]
    assert imp["place"]["severity"] == "medium" and "from place to stop" in imp["place"]["recommendation"]
    assert imp["x"]["severity"] == "low" and imp["x"]["pipelines"] == []
    s = CA.impact_summary(CA.impact_analysis(changes, usage)).collect()[0]
    assert (s["high_severity"], s["medium_severity"], s["low_severity"]) == (1, 2, 1)
    assert {r["pipeline"] for r in CA.impact_pipelines(changes, usage).filter("column = 'weight'").collect()} == {"load_plan", "billing"}


def test_tag_apply(spark):
    state = spark.createDataFrame([("table", "orders", ["b", "a"]), ("column", "orders.id", [])],
                                  "entity_type string, entity_name string, tags array<string>")
    ch = spark.createDataFrame([("table", "orders", "add", ["c", "a"]), ("table", "orders", "remove", ["b"]),
                                ("column", "orders.id", "set", ["pii"]), ("table", "new", "add", ["x"])],
                               "entity_type string, entity_name string, action string, tags array<string>")
    out = {r["entity_name"]: r["tags"] for r in CA.tag_apply(state, ch).collect()}
    assert out == {"orders": ["a", "c"], "orders.id": ["pii"], "new": ["x"]}
    bad = spark.createDataFrame([("table", "orders", "wipe", ["a"])], ch.schema)
    with pytest.raises(Exception):
        CA.tag_apply(state, bad).collect()
    badcol = spark.createDataFrame([("column", "orders", "add", ["a"])], ch.schema)
    with pytest.raises(Exception):
        CA.tag_apply(state, badcol).collect()


def test_sync_and_content_search(spark, cat):
    _, cols, _ = cat
    s = CA.catalog_sync(cols).collect()[0]
    assert s["description"] == "Imported from public.parcels" and s["column_count"] == 4 and s["nullable_columns"] == 2
    docs = spark.createDataFrame([(1, "Data data DATA"), (2, "none")], "id long, text string")
    hits = CA.content_search({"docs": (docs, "id", "text")}, "data").collect()
    assert [(r["row_id"], r["occurrences"]) for r in hits] == [(1, 3)]


def test_ancestors_of_requested_columns(spark):
    e = spark.createDataFrame([("r", "a", "n", "a", None), ("n", "a", "c", "a", "direct"), ("c", "a", "o", "a", "x"),
                               ("r", "a", "c", "a", "shortcut"), ("z", "q", "y", "q", None)], EDGE)
    req = spark.createDataFrame([("o", "a"), ("nowhere", "a")], "table string, column string")
    got = {(r["source_table"], r["hops"]) for r in LI.lineage_ancestors(e, req).collect()}
    assert got == {("c", 1), ("r", 2), ("n", 2)}
