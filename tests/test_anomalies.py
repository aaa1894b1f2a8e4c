import statistics

import pytest

from vigil.operators import anomalies as A
from conftest import METRIC, plan_text


def test_flags_the_outlier_medium_at_2(metrics):
    rows = A.detect_anomalies(metrics, "dt", "val", threshold=2.0).collect()
    z = round((90.0 - statistics.mean(METRIC)) / statistics.stdev(METRIC), 3)
    assert [(r["value"], r["z_score"], r["severity"], r["total_points"]) for r in rows] == [(90.0, z, "medium", 8)]


def test_none_at_10(metrics):
    assert A.detect_anomalies(metrics, "dt", "val", threshold=10.0).count() == 0


def test_baseline(metrics):
    b = A.metric_baseline(metrics, "val").collect()[0]
    assert b["total_points"] == 8 and b["mean"] == statistics.mean(METRIC)
    assert abs(b["stddev"] - statistics.stdev(METRIC)) < 1e-9


def test_zero_stddev_counts_points(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(4)], "t int, v double")
    assert A.detect_anomalies(df, "t", "v").count() == 0
    s = A.anomaly_summary(df, "t", "v").collect()[0]
    assert s["total_points"] == 4 and s["anomalies"] == 0


def test_method_checked(metrics):
    with pytest.raises(ValueError):
        A.detect_anomalies(metrics, "dt", "val", method="iqr")


def test_by_series(spark):
    rows = [("a", i, 10.0) for i in range(9)] + [("a", 9, 100.0)] + [("b", i, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    out = A.detect_anomalies_by_series(df, "t", "v", ["k"], threshold=2.0).collect()
    assert [(r["k"], r["value"]) for r in out] == [("a", 100.0)]


def test_no_single_partition_exchange(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df = A.detect_anomalies(ev, "ts", "value")
    df.collect()
    lines = plan_text(df).splitlines()
    assert not any("Window" in ln for ln in lines)
    # The only single-partition exchange is the one-row baseline's final aggregation,
    # fed by map-side partial aggregates — the scan itself is never funnelled.
    for i, ln in enumerate(lines):
        if "Exchange SinglePartition" in ln:
            assert "partial_" in lines[i + 1]
