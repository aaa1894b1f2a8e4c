"""Stored profiles: equal to a profile of the whole table, and only changed partitions are read."""

import os
import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import profile_state as PS

SCHEMA = "day string, k long, v double, s string"


def _rows(seed, days, n=300):
    rng = random.Random(seed)
    return [(rng.choice(days), rng.randint(0, 500) if rng.random() < 0.9 else None, rng.gauss(0, 10), rng.choice(["hot"] * 5 + [f"s{k}" for k in range(40)]))
            for _ in range(n * len(days))]


def _check(spark, table, state):
    rows = spark.read.option("basePath", table).parquet(table).drop("day")
    got = {r.column_name: r for r in PS.profile(spark, state).collect()}
    assert set(got) == set(rows.columns)
    for c in rows.columns:
        values = [r[0] for r in rows.select(c).collect()]
        known = [v for v in values if v is not None]
        r = got[c]
        assert (r.row_count, r.null_count) == (len(values), len(values) - len(known))
        assert abs(r.distinct_estimate - len(set(known))) <= PS.DISTINCT_ERROR * len(set(known)) + 1
        if c == "s":
            assert r["min"] is None and r.quantiles is None
            assert r.top_values[0]["item"] == "hot" and abs(r.top_values[0]["count"] - values.count("hot")) <= len(values) / PS.TRACKED + 1
        else:
            assert (r["min"], r["max"]) == (min(known), max(known)) and r["mean"] == pytest.approx(sum(known) / len(known))
            for q, x in zip((0.25, 0.5, 0.75), r.quantiles):
                below, upto = sum(v < x for v in known) / len(known), sum(v <= x for v in known) / len(known)
                assert below <= q + PS.RANK_ERROR and upto >= q - PS.RANK_ERROR


def _garble(table, day):
    """Make a partition unreadable without a change that a listing could show."""
    folder = f"{table}/day={day}"
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        seen = os.stat(path)
        data = open(path, "rb").read()
        with open(path, "wb") as f:
            f.write(b"x" * len(data))
        os.utime(path, ns=(seen.st_atime_ns, seen.st_mtime_ns))
        yield path, data, seen


def test_updates_read_only_what_changed(spark, tmp_path):
    table, state = f"{tmp_path}/t", f"{tmp_path}/state"
    days = ["2024-01-01", "2024-01-02", "a b/c=%é", None]
    df = spark.createDataFrame(_rows(1, days), SCHEMA)
    df.repartition("day").write.partitionBy("day").parquet(table)
    assert PS.update(spark, table, "day", state) == {"read": sorted(days, key=str), "retracted": []}
    _check(spark, table, state)
    assert PS.update(spark, table, "day", state) == {"read": [], "retracted": []}

    # rows are added to one partition, one is dropped, one is new; the untouched one cannot be read at all
    hidden = list(_garble(table, "2024-01-01"))
    spark.createDataFrame(_rows(2, ["2024-01-02", "2024-03-01"], 50), SCHEMA).repartition("day").write.mode("append").partitionBy("day").parquet(table)
    null_day = next(x for x in os.listdir(table) if "HIVE_DEFAULT" in x)
    for name in os.listdir(f"{table}/{null_day}"):
        os.remove(f"{table}/{null_day}/{name}")
    os.rmdir(f"{table}/{null_day}")
    assert PS.update(spark, table, "day", state) == {"read": ["2024-01-02", "2024-03-01"], "retracted": [None]}
    for path, data, seen in hidden:
        with open(path, "wb") as f:
            f.write(data)
        os.utime(path, ns=(seen.st_atime_ns, seen.st_mtime_ns))
    _check(spark, table, state)

    spark.createDataFrame(_rows(3, ["2024-03-01"], 40), SCHEMA).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(table)
    assert PS.update(spark, table, "day", state)["read"] == ["2024-03-01"]  # replaced, not added to
    _check(spark, table, state)
    assert PS.signatures(spark, table, "day").where(F.col("part").isNull()).count() == 0
