"""Interval backfill planning and gap-aware recompute.

Intervals are generated per task row with ``explode(sequence(start, end, step))`` after
joining tasks to their DAG's schedule — an equi-join on dag_id, then a narrow explode, so
a DAG with very many tasks is spread over the tasks' partitions instead of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigil.sources.tables import write_partitions

# Schedule presets.  Months are calendar months; "30 days" is the other choice.
SCHEDULE_STEPS = {"@hourly": "1 hour", "@daily": "1 day", "@weekly": "7 days", "@monthly": "1 month"}
DEFAULT_STEP = "1 day"


def schedule_step(schedule: Column, monthly: str = "calendar") -> Column:
    """Interval step of a schedule preset (unknown / NULL schedule → one day)."""
    expr = F.when(schedule == "@hourly", F.expr("INTERVAL 1 HOUR"))
    expr = expr.when(schedule == "@weekly", F.expr("INTERVAL 7 DAYS"))
    if monthly == "calendar":
        expr = expr.when(schedule == "@monthly", F.expr("INTERVAL 1 MONTH"))
    else:
        expr = expr.when(schedule == "@monthly", F.expr(f"INTERVAL {monthly}"))
    return expr.otherwise(F.expr("INTERVAL 1 DAY"))


def _sequence(monthly: str) -> Column:
    """All intervals of a (schedule, start_date, end_date) row."""
    start, end = F.col("start_date").cast("timestamp_ntz"), F.col("end_date").cast("timestamp_ntz")
    if monthly != "calendar":
        return F.sequence(start, end, schedule_step(F.col("schedule"), monthly))
    return F.when(F.col("schedule") == "@monthly", F.sequence(start, end, F.expr("INTERVAL 1 MONTH"))) \
            .otherwise(F.sequence(start, end, schedule_step(F.col("schedule"), "30 days")))


def _scheduled(dags: DataFrame) -> DataFrame:
    return dags.where(F.col("end_date").cast("timestamp_ntz") >= F.col("start_date").cast("timestamp_ntz")) \
               .select("dag_id", "schedule", "start_date", "end_date")


def backfill_plan(dags: DataFrame, tasks: DataFrame, monthly: str = "calendar") -> DataFrame:
    """One 'queued' run per (interval, task): dag_id, task_id, interval, status.

    ``dags``: dag_id, schedule, start_date, end_date (inclusive at both ends).
    """
    t = tasks.select("dag_id", "task_id").distinct()
    return (t.join(_scheduled(dags), "dag_id")
             .select("dag_id", "task_id", F.explode(_sequence(monthly)).alias("interval"), F.lit("queued").alias("status")))


def backfill_counts(dags: DataFrame, tasks: DataFrame, monthly: str = "calendar") -> DataFrame:
    """G8 dry-run counts per DAG: total_intervals, tasks_per_run, total_task_runs."""
    iv = _scheduled(dags).select("dag_id", F.size(_sequence(monthly)).cast("bigint").alias("total_intervals"))
    nt = tasks.groupBy("dag_id").agg(F.count_distinct("task_id").alias("tasks_per_run"))
    j = iv.join(nt, "dag_id", "left")
    return j.select("dag_id", "total_intervals", F.coalesce("tasks_per_run", F.lit(0)).alias("tasks_per_run"),
                    (F.col("total_intervals") * F.coalesce("tasks_per_run", F.lit(0))).alias("total_task_runs"))


def run_history(runs: DataFrame) -> DataFrame:
    """Per (dag_id, interval): tasks (runs recorded) and queued."""
    return runs.groupBy("dag_id", "interval").agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "queued").alias("queued"))


def recent_task_runs(runs: DataFrame, k: int = 5) -> DataFrame:
    """The last ``k`` recorded runs per DAG (ts, then run_id), ``pos`` 1 = oldest of them."""
    w = Window.partitionBy("dag_id").orderBy(F.col("ts").desc(), F.col("run_id").desc())
    last = runs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    n = F.count(F.lit(1)).over(Window.partitionBy("dag_id"))
    return last.select("dag_id", (n - F.col("_r") + 1).cast("int").alias("pos"), "task_id", "interval", "status")


def intervals_covered(runs: DataFrame) -> DataFrame:
    """G11 per DAG: total_runs, intervals_covered."""
    return runs.groupBy("dag_id").agg(F.count(F.lit(1)).alias("total_runs"),
                                      F.count_distinct("interval").alias("intervals_covered"))


def missing_intervals(existing: DataFrame, time_col: str, step: str = "1 day",
                      start=None, end=None, by: list[str] | None = None) -> DataFrame:
    """Expected intervals absent from ``existing`` (optionally per series ``by``).

    The expected range is [start, end] or, when not given, the observed min..max of each
    series; the result is ``sequence`` exploded and anti-joined with the observed keys.
    """
    by = by or []
    obs = existing.select(*by, F.col(time_col).alias("interval")).distinct()
    rng = obs.groupBy(*by).agg(F.min("interval").alias("lo"), F.max("interval").alias("hi"))
    lo = F.lit(start).cast(obs.schema["interval"].dataType) if start is not None else F.col("lo")
    hi = F.lit(end).cast(obs.schema["interval"].dataType) if end is not None else F.col("hi")
    expected = rng.select(*by, F.explode(F.sequence(lo, hi, F.expr(f"INTERVAL {step}"))).alias("interval"))
    return expected.join(obs, [*by, "interval"], "left_anti")


def recompute(source: DataFrame, intervals: DataFrame, time_col: str, transform, path: str,
              partition_col: str) -> None:
    """G10 recompute: rebuild only the missing intervals and replace just those partitions.

    ``source`` rows inside the given intervals are selected with a semi-join, ``transform``
    (DataFrame -> DataFrame, output carrying ``partition_col``) is applied, and the result
    is written with dynamic partition overwrite, so a re-run is idempotent.
    """
    keys = intervals.select(F.col("interval").alias("_iv")).distinct()
    todo = source.join(keys, F.col(time_col) == F.col("_iv"), "left_semi")
    write_partitions(transform(todo), path, [partition_col])
