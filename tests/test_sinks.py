import datetime as dt

from pyspark.sql import functions as F

from vigil.operators import cleaning as CL
from vigil.operators import runs as RN
from vigil.sources.logs import record_alerts, record_runs

T0 = dt.datetime(2026, 6, 18, 12, 0, 0)


def test_append_logs_then_health(spark, tmp_path):
    path = str(tmp_path / "runs")
    for batch in range(2):
        rows = [("p", "success" if batch == 0 else "failed", 10.0, T0 + dt.timedelta(hours=batch))]
        record_runs(spark.createDataFrame(rows, "pipeline string, status string, duration_min double, ts timestamp_ntz"), path)
    runs = spark.read.parquet(path)
    assert runs.count() == 2 and runs.select("run_id").distinct().count() == 2
    h = RN.pipeline_health(runs).collect()[0]
    assert h["status"] == "failed" and h["success_rate"] == 0.5
    apath = str(tmp_path / "alerts")
    record_alerts(spark.createDataFrame([("p", "critical", "boom", T0)],
                                        "pipeline string, severity string, message string, ts timestamp_ntz"), apath)
    a = spark.read.parquet(apath).collect()[0]
    assert a["acknowledged"] is False and a["alert_id"]


def test_pipeline_load_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "id int, v string")
    p = CL.Pipeline([("filter_nulls", {"columns": ["v"]}), ("deduplicate", {"keys": ["id"], "order_by": ["v"]})])
    out = str(tmp_path / "clean")
    p.load(df, out)
    p.load(df, out)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, "b"), (1, "b")]
