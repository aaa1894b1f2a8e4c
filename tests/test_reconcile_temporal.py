"""Versions compared by content, as-of and interval joins: brute force, hot series, plans."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from vigil.operators import reconcile as RC
from vigil.operators import temporal as TM

SCHEMA = "k long, g string, v double, tags array<string>"


def _versions(seed, n=400):
    rng = random.Random(seed)

    def row(k):
        return (k, rng.choice(["a", "b", None]), rng.choice([1.5, 2.5, None]), rng.choice([("x",), ("x", None), (), None]))
    before = [row(rng.randint(0, n) if rng.random() < 0.9 else None) for _ in range(n)] + [(7, "hot", 1.0, None)] * 60
    after = list(before)
    for _ in range(12):
        after.pop(rng.randrange(len(after)))
        i = rng.randrange(len(after))
        after[i] = (after[i][0], "edited", after[i][2], after[i][3])
        after.append(rng.choice(after))
        after.append(row(n + 1 + rng.randint(0, 50)))
    return before, after


def _expected(before, after):
    a, b = Counter(before), Counter(after)
    plus, minus = b - a, a - b
    won, lost = {r[0] for r in plus}, {r[0] for r in minus}
    out = set()
    for side, rows in (("before", minus), ("after", plus)):
        for r, n in rows.items():
            change = "changed" if r[0] in won and r[0] in lost else "added" if side == "after" else "removed"
            out.add((*r, side, change, n))
    return out


def _found(df):
    return [(r.k, r.g, r.v, None if r.tags is None else tuple(r.tags), r.side, r.change, r.copies) for r in df.collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_with_multiplicity(spark, tmp_path, seed):
    before, after = _versions(seed)
    a, b = (spark.createDataFrame([(k, g, v, None if t is None else list(t)) for k, g, v, t in rows], SCHEMA) for rows in (before, after))
    want = _expected(before, after)
    whole = _found(RC.compare(a, b, ["k"]))
    RC.write_version(a, ["k"], f"{tmp_path}/a", levels=2)
    RC.write_version(b, ["k"], f"{tmp_path}/b", levels=2)
    stored = _found(RC.reconcile(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["k"]))
    assert set(whole) == set(stored) == want and len(whole) == len(stored) == len(want)
    assert RC.differing_nodes(spark, f"{tmp_path}/a", f"{tmp_path}/a") == [[]]
    assert _found(RC.reconcile(spark, f"{tmp_path}/a", f"{tmp_path}/a", ["k"])) == []


def test_empty_versions_and_other_columns(spark, tmp_path):
    rows, none = spark.createDataFrame([(1, "a", None, [])], SCHEMA), spark.createDataFrame([], SCHEMA)
    RC.write_version(rows, ["k"], f"{tmp_path}/a")
    RC.write_version(none, ["k"], f"{tmp_path}/b")
    assert [r[4:] for r in _found(RC.reconcile(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["k"]))] == [("before", "removed", 1)]
    assert [r[4:] for r in _found(RC.reconcile(spark, f"{tmp_path}/b", f"{tmp_path}/a", ["k"]))] == [("after", "added", 1)]
    with pytest.raises(ValueError):
        RC.compare(rows, rows.withColumn("w", F.lit(1)), ["k"])


def test_a_null_is_not_its_neighbour(spark, tmp_path):
    """Row hashes skip nulls; (1, null) and (null, 1) must still differ."""
    for name, row in (("a", (1, None, 2)), ("b", (1, 2, None))):
        RC.write_version(spark.createDataFrame([row], "k int, x int, y int"), ["k"], f"{tmp_path}/{name}")
    assert {r.change for r in RC.reconcile(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["k"]).collect()} == {"changed"}


def _scanned(df):
    """Rows that the scan of a plan without shuffles hands on."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_rows_read_follow_the_change(spark, tmp_path):
    n = 200_000
    a = spark.range(n).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    b = a.withColumn("v", F.when(F.col("k") == 77, "new").otherwise(F.col("v")))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "5000")
    try:
        for df, name in ((a, "a"), (b, "b")):
            RC.write_version(df, ["k"], f"{tmp_path}/{name}")
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    nodes = RC.differing_nodes(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert [len(x) for x in nodes] == [1] * (RC.LEVELS + 1)
    assert _scanned(RC.rows_of_leaves(spark, f"{tmp_path}/a", nodes[-1])) <= 10_000 < n
    assert {(r.k, r.change) for r in RC.reconcile(spark, f"{tmp_path}/a", f"{tmp_path}/b", ["k"]).collect()} == {(77, "changed")}


# ---------------------------------------------------------------- joins in time

START = dt.datetime(2024, 1, 1)


def _series(seed, n, nulls=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None] if nulls else ["a", "b"])
        ts = START + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 9)) if rng.random() < 0.95 or not nulls else None
        rows.append((i, s, ts, rng.randint(0, 5)))
    return rows


@pytest.mark.parametrize("bin_seconds,tolerance", [(86_400, None), (3_600, None), (86_400, 7_200)])
def test_asof_join(spark, bin_seconds, tolerance):
    left, right = _series(1, 300), _series(2, 120)
    left += [left[0], left[0]]  # repeated rows stay
    a = spark.createDataFrame(left, "id long, s string, ts timestamp, x int")
    b = spark.createDataFrame(right, "rid long, s string, rts timestamp, y int")
    out = TM.asof_join(a, b, ["s"], "ts", "rts", ["rid", "rts"], ["y", "rid"], bin_seconds, tolerance)
    got = Counter((r.id, r.s, r.ts, r.x, r.rid, r.rts) for r in out.collect())
    want = Counter()
    for i, s, ts, x in left:
        before = [(rts, y, rid) for rid, rs, rts, y in right if s is not None and rs == s and ts is not None and rts is not None and rts <= ts]
        best = max(before, default=None)
        if best and tolerance and (ts - best[0]).total_seconds() > tolerance:
            best = None
        want[(i, s, ts, x, best[2] if best else None, best[0] if best else None)] += 1
    assert got == want
    assert "NestedLoop" not in plan_text(out) and "CartesianProduct" not in plan_text(out)
    with pytest.raises(ValueError):
        TM.asof_join(a, b, ["s"], "ts", "rts", ["s"], ["rid"])


@pytest.mark.parametrize("bin_seconds", [86_400, 1_800])
def test_interval_join(spark, bin_seconds):
    rng = random.Random(5)

    def spans(seed, n):
        return [(i, s, ts, ts + dt.timedelta(minutes=rng.choice([0, 1, 30, 30, 600, 2880, -5])) if ts else None) for i, s, ts, _ in _series(seed, n)]
    left, right = spans(3, 90), spans(4, 70)
    left.append((900, "hot", START, START + dt.timedelta(days=8)))  # touches many bins
    a = spark.createDataFrame(left, "id long, s string, f timestamp, t timestamp")
    b = spark.createDataFrame(right, "rid long, s string, f timestamp, t timestamp")
    out = TM.interval_join(a, b, ["s"], ("f", "t"), ("f", "t"), bin_seconds)
    got = Counter((r.l.id, r.r.rid, r.overlap_start, r.overlap_end) for r in out.collect())
    want = Counter((i, j, max(f, g), min(t, u)) for i, s, f, t in left for j, z, g, u in right
                   if s is not None and s == z and f and t and g and u and f < t and g < u and max(f, g) < min(t, u))
    assert got == want and len(want) > 50
    assert "NestedLoop" not in plan_text(out) and "CartesianProduct" not in plan_text(out)


def test_a_hot_series_is_spread_over_its_bins(spark):
    """No window or join of the as-of join is dealt by the series alone, but for the bin summaries."""
    a = spark.createDataFrame(_series(1, 10), "id long, s string, ts timestamp, x int")
    b = spark.createDataFrame(_series(2, 10), "rid long, s string, rts timestamp, y int")
    plan = plan_text(TM.asof_join(a, b, ["s"], "ts", "rts", ["rid"], ["rid"]))
    dealt = [line for line in plan.split("\n") if "hashpartitioning(" in line]
    assert dealt and sum("__bin" not in line for line in dealt) <= 1
