import datetime as dt
import os


import pytest
from pyspark.sql import functions as F

from vigil.operators import backfill as BF
from vigil.operators import cleaning as CL
from vigil.operators import graph as GR
from vigil.session import Rounds, ensure_checkpoint_dir


def dag(spark, deps):
    tasks = spark.createDataFrame([("d", t) for t in deps], "dag_id string, task_id string")
    edges = spark.createDataFrame([("d", c, p) for c, ps in deps.items() for p in ps] or [],
                                  "dag_id string, child string, parent string")
    return tasks, edges


def test_levels_chain(spark):
    t, e = dag(spark, {"a": [], "b": ["a"], "c": ["b", "b"]})
    lv = {r["task_id"]: r["level"] for r in GR.dag_levels(t, e).collect()}
    assert lv == {"a": 1, "b": 2, "c": 3}
    r = GR.dag_resolution(GR.dag_levels(t, e)).collect()[0]
    assert (r["depth"], r["can_parallelize"]) == (3, False)


def test_diamond_and_critical_path(spark):
    t, e = dag(spark, {"start": [], "branch_a": ["start"], "branch_b": ["start"], "join": ["branch_a", "branch_b"]})
    lv = GR.dag_levels(t, e)
    assert {r["task_id"]: r["level"] for r in lv.collect()}["join"] == 3
    cp = GR.critical_path(lv, e).collect()[0]
    assert cp["critical_path"] == "start>branch_a>join" and cp["critical_path_length"] == 3
    assert GR.dag_resolution(lv).collect()[0]["can_parallelize"] is True
    adj = {r["task_id"]: (r["n_parents"], r["n_children"]) for r in GR.adjacency(t, e).collect()}
    assert adj["start"] == (0, 2) and adj["join"] == (2, 0)


def test_cycle_and_missing(spark):
    t, e = dag(spark, {"a": ["c"], "b": ["a"], "c": ["b"], "ok": [], "after": ["ok", "c"], "m": ["ghost"]})
    blocked = sorted(r["task_id"] for r in GR.blocked_tasks(t, e).collect())
    assert blocked == ["a", "after", "b", "c", "m"]
    assert [r["parent"] for r in GR.missing_parents(t, e).collect()] == ["ghost"]


def test_cycle_members_are_only_the_tasks_on_cycles(spark):
    t, e = dag(spark, {"a": ["c"], "b": ["a"], "c": ["b"], "after": ["c"], "x": ["after", "y"], "y": ["x"], "own": ["own"],
                       "m": ["ghost"], "below": ["m"], "ok": [], "bridge": ["c", "ok"], "z": ["bridge", "w"], "w": ["z"]})
    got = sorted((r["cycle"], r["task_id"]) for r in GR.cycle_members(t, e).collect())
    assert got == [("a", "a"), ("a", "b"), ("a", "c"), ("own", "own"), ("w", "w"), ("w", "z"), ("x", "x"), ("x", "y")]
    t, e = dag(spark, {"a": ["missing"], "b": ["a"]})
    assert GR.cycle_members(t, e).count() == 0
    assert sorted(r["task_id"] for r in GR.blocked_tasks(t, e).collect()) == ["a", "b"]


def test_long_chain_keeps_no_round_in_memory(spark):
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = held()
    n = 24
    t, e = dag(spark, {f"t{i:02d}": [f"t{i - 1:02d}"] if i else [] for i in range(n)})
    lv = GR.dag_levels(t, e)
    assert held() == before
    assert {r["task_id"]: r["level"] for r in lv.collect()} == {f"t{i:02d}": i + 1 for i in range(n)}
    cp = GR.critical_path(lv, e).collect()[0]
    assert cp["critical_path_length"] == n and cp["critical_path"].startswith("t00>t01>") and held() == before
    tree = GR.dependency_tree(e, spark.createDataFrame([(t.first()["dag_id"], "t20")], "dag_id string, root string"))
    assert sorted((r["task_id"], r["depth"]) for r in tree.collect()) == [("t21", 1), ("t22", 2), ("t23", 3)] and held() == before


def test_monthly_backfill_follows_the_calendar(spark):
    dags = spark.createDataFrame([("d", "@monthly", "2024-01-05", "2024-04-04")], "dag_id string, schedule string, start_date string, end_date string")
    tasks = spark.createDataFrame([("d", "t")], "dag_id string, task_id string")
    days = lambda **k: [str(r["interval"])[:10] for r in BF.backfill_plan(dags, tasks, **k).orderBy("interval").collect()]
    assert days() == ["2024-01-05", "2024-02-05", "2024-03-05"]
    assert days(monthly="30 days") == ["2024-01-05", "2024-02-04", "2024-03-05", "2024-04-04"]


def test_backfill_plan_daily_and_hourly(spark):
    tasks = spark.createDataFrame([("etl", "extract"), ("etl", "load")], "dag_id string, task_id string")
    dags = spark.createDataFrame([("etl", "@daily", "2024-01-01", "2024-01-03")],
                                 "dag_id string, schedule string, start_date string, end_date string")
    c = BF.backfill_counts(dags, tasks).collect()[0]
    assert (c["total_intervals"], c["tasks_per_run"], c["total_task_runs"]) == (3, 2, 6)
    two = dags.withColumn("end_date", F.lit("2024-01-02"))
    assert BF.backfill_plan(two, tasks).count() == 4
    hourly = dags.withColumn("schedule", F.lit("@hourly")).withColumn("end_date", F.lit("2024-01-02"))
    assert BF.backfill_counts(hourly, tasks).collect()[0]["total_intervals"] == 25
    none = dags.withColumn("schedule", F.lit(None).cast("string"))
    assert BF.backfill_counts(none, tasks).collect()[0]["total_intervals"] == 3
    hist = BF.run_history(BF.backfill_plan(two, tasks)).collect()
    assert sorted((r["tasks"], r["queued"]) for r in hist) == [(2, 2), (2, 2)]


def test_gaps_and_recompute(spark, tmp_path):
    days = [dt.date(2024, 1, d) for d in (1, 2, 4, 7)]
    df = spark.createDataFrame([(d, 1) for d in days], "dt date, v int")
    gaps = sorted(r["interval"] for r in BF.missing_intervals(df, "dt").collect())
    assert gaps == [dt.date(2024, 1, 3), dt.date(2024, 1, 5), dt.date(2024, 1, 6)]
    out = str(tmp_path / "t")
    BF.recompute(df, df.select(F.col("dt").alias("interval")), "dt", lambda x: x, out, "dt")
    src2 = spark.createDataFrame([(dt.date(2024, 1, 3), 9), (dt.date(2024, 1, 4), 8)], "dt date, v int")
    BF.recompute(src2, spark.createDataFrame([(dt.date(2024, 1, 3),)], "interval date"), "dt", lambda x: x, out, "dt")
    back = sorted((str(r["dt"]), r["v"]) for r in spark.read.parquet(out).collect())
    assert back == [("2024-01-01", 1), ("2024-01-02", 1), ("2024-01-03", 9), ("2024-01-04", 1), ("2024-01-07", 1)]


def test_cleaning_steps(spark):
    df = spark.createDataFrame([(1, "10", 1), (1, "11", 2), (2, "x", 1), (3, None, 1)], "id int, v string, ver int")
    d = sorted(tuple(r) for r in CL.deduplicate(df, ["id"], ["ver"]).collect())
    assert d == [(1, "11", 2), (2, "x", 1), (3, None, 1)]
    assert CL.cast_rejects(df, {"v": "int"}).count() == 1
    p = CL.Pipeline([("filter_nulls", {"columns": ["v"]}), ("deduplicate", {"keys": ["id"], "order_by": ["ver"]}),
                     ("cast_types", {"mapping": {"v": "int"}}), lambda x: x.filter("id < 5")])
    assert sorted(tuple(r) for r in p.run(df).collect()) == [(1, 11, 2)]
    with pytest.raises(ValueError):
        CL.Pipeline(["bogus"])


def test_rounds_of_deep_chains_and_rings(spark, monkeypatch):
    """A chain, a ladder of diamonds and a ring of 1,000 tasks each take a number of rounds logarithmic in their depth."""
    n = 1000
    chain = [("c", f"{k:04}", f"{k - 1:04}") for k in range(1, n)]
    ladder = [("l", f"{k:04}", f"{p:04}") for k in range(1, n) for p in ([k - 1, k - 2] if k % 3 == 0 else [k - 1])]
    ring = [("r", f"{k:04}", f"{(k - 1) % n:04}") for k in range(n)] + [("r", "tail", "0005")]
    edges = spark.createDataFrame(chain + ladder + ring, "dag_id string, child string, parent string")
    tasks = edges.selectExpr("dag_id", "child AS task_id").union(edges.selectExpr("dag_id", "parent")).distinct()
    written = []
    plain = Rounds.write
    monkeypatch.setattr(Rounds, "write", lambda self, k, df: written.append(k) or plain(self, k, df))
    got = {(r.dag_id, r.task_id): r.level for r in GR.dag_levels(tasks, edges).collect()}
    assert got == {(d, f"{k:04}"): k + 1 for d in "cl" for k in range(n)}
    assert len(written) <= 60
    folder = ensure_checkpoint_dir(spark).replace("file:", "")
    assert not [x for x in os.listdir(folder) if x.startswith(("pointers-", "settled-", "edges-")) and os.path.isdir(f"{folder}/{x}")
                and any(os.scandir(f"{folder}/{x}"))]
