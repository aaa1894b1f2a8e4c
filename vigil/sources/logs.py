"""Append-only run and alert logs (O1, O2): records are appended as files, never updated.

Identifiers come from the data (a source key) or ``uuid()``, never from a global counter,
so concurrent writers and retried tasks cannot collide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigil.sources.tables import write_append

RUN_COLUMNS = ("run_id", "pipeline", "status", "duration_min", "rows_processed", "ts")
ALERT_COLUMNS = ("alert_id", "pipeline", "severity", "message", "ts", "acknowledged")


def record_runs(runs: DataFrame, path: str) -> None:
    """O1 sink: append run records (run_id from the data or a fresh uuid)."""
    out = runs if "run_id" in runs.columns else runs.withColumn("run_id", F.expr("uuid()"))
    if "rows_processed" not in out.columns:
        out = out.withColumn("rows_processed", F.lit(0).cast("bigint"))
    write_append(out.select(*RUN_COLUMNS), path)


def record_alerts(alerts: DataFrame, path: str) -> None:
    """O2 sink: append alerts, unacknowledged unless stated."""
    out = alerts if "alert_id" in alerts.columns else alerts.withColumn("alert_id", F.expr("uuid()"))
    if "acknowledged" not in out.columns:
        out = out.withColumn("acknowledged", F.lit(False))
    write_append(out.select(*ALERT_COLUMNS), path)
