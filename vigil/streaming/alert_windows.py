"""Windowed alert counts on a stream (O8) with Structured Streaming.

Event time must be a ``timestamp`` for ``withWatermark`` (``timestamp_ntz`` is refused).
The wall-clock ``timestamp_ntz`` values are read explicitly as UTC (whatever the session
time zone), so windows start at UTC midnight and results do not depend on the session.
Append mode emits a window once the watermark passes its end; late rows beyond the
watermark are dropped by Spark.
State is kept in the checkpoint location, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigil.session import ensure_checkpoint_dir

ALERT_SCHEMA = ("alert_id bigint, pipeline string, severity string, message string, "
                "ts timestamp_ntz, acknowledged boolean")


def _utc_instant(ntz_col, session_tz: str):
    # wall clock read as UTC -> instant (cast interprets in the session zone, so shift first)
    return F.convert_timezone(F.lit("UTC"), F.lit(session_tz), ntz_col).cast("timestamp")


def _utc_wall_clock(ts_col, session_tz: str):
    # instant -> wall clock in UTC
    return F.convert_timezone(F.lit(session_tz), F.lit("UTC"), ts_col.cast("timestamp_ntz"))


def alert_window_counts(stream: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Streaming (or batch) counts per (window, severity) with a lateness bound."""
    tz = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    ev = stream.withColumn("event_time", _utc_instant(F.col("ts"), tz))
    return (ev.withWatermark("event_time", watermark)
              .groupBy(F.window("event_time", window).alias("w"), "severity")
              .agg(F.count(F.lit(1)).alias("n"))
              .select(_utc_wall_clock(F.col("w.start"), tz).alias("window_start"),
                      _utc_wall_clock(F.col("w.end"), tz).alias("window_end"), "severity", "n"))


def run_alert_windows(spark: SparkSession, source_dir: str, output_dir: str, checkpoint_dir: str,
                      window: str = "1 day", watermark: str = "1 hour",
                      schema: str = ALERT_SCHEMA, max_files_per_trigger: int | None = None) -> None:
    """Process every file now in ``source_dir`` (trigger availableNow) and append closed
    windows to parquet at ``output_dir``; blocks until done."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    counts = alert_window_counts(reader.parquet(source_dir), window, watermark)
    q = (counts.writeStream.outputMode("append").format("parquet")
              .option("path", output_dir).option("checkpointLocation", checkpoint_dir)
              .trigger(availableNow=True).start())
    q.awaitTermination()


def alert_windows_via_stream(alerts: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Stage ``alerts`` as files in the shared checkpoint folder, stream them through
    ``run_alert_windows`` and read back the emitted (closed) windows."""
    spark = alerts.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/alert-windows-{uuid.uuid4().hex}"
    alerts.select("alert_id", "pipeline", "severity", "message", "ts", "acknowledged") \
          .write.mode("overwrite").parquet(f"{base}/input")
    run_alert_windows(spark, f"{base}/input", f"{base}/output", f"{base}/state", window, watermark)
    return spark.read.schema("window_start timestamp_ntz, window_end timestamp_ntz, severity string, n bigint") \
                .parquet(f"{base}/output")
