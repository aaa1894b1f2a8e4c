"""Plan properties of every registered query."""

from conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


def test_no_cross_joins_or_python_in_any_query(spark):
    from vigil.plans.registry import QUERIES
    bad = {}
    for name, fn in QUERIES.items():
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_filters_reach_the_scan(spark):
    import __spark_entry__ as E
    plan = E.queries()["alert_summary"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln][0]
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,100.0)" in scan or "GreaterThan(value,100.0)" in scan
    assert "ts" in scan.split("PushedFilters")[1]


def test_drift_names_are_case_sensitive(spark):
    from vigil.operators import schema as SC
    meta = "table_name string, name string, type string, nullable boolean, description string"
    src = spark.createDataFrame([("t", "ID", "INT", True, "")], meta)
    tgt = spark.createDataFrame([("t", "id", "INT", True, "")], meta)
    assert sorted(r["change"] for r in SC.detect_drift(src, tgt).collect()) == ["added", "removed"]
