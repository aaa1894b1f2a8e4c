"""Sessions of events on a stream (O8): merging state, watermark, late rows in a side table.

A session of a key ends when ``gap_seconds`` pass without an event.  Each micro-batch merges its events with the open
sessions of the batch before, writes the sessions that the watermark has passed, and keeps the others as the next
batch's state.  Events older than the watermark can no longer change a session: they go to a side table, counted,
not lost.  The watermark is the latest event time seen so far less ``delay_seconds``.

Everything a batch writes (closed sessions, late rows, open sessions, watermark) stands under its batch id and is
overwritten when the batch is run again, so a restarted query neither loses nor doubles a session.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigil.session import drop_folder, ensure_checkpoint_dir


def _later(ts: Column, seconds: int) -> Column:
    return ts + F.make_interval(secs=F.lit(seconds))


def merge_sessions(parts: DataFrame, keys: list[str], gap_seconds: int) -> DataFrame:
    """(keys, session_start, last_event, n) of partial sessions: gaps and islands over their starts."""
    order = Window.partitionBy(*keys).orderBy("session_start", "last_event")
    reach = F.max("last_event").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumn("__new", F.when(reach.isNotNull() & (F.col("session_start") < _later(reach, gap_seconds)), 0).otherwise(1))
    numbered = marked.withColumn("__session", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "__session").agg(
        F.min("session_start").alias("session_start"), F.max("last_event").alias("last_event"), F.sum("n").alias("n")).drop("__session")


def sessions(events: DataFrame, keys: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """(keys, session_start, session_end, n) of a batch; rows without a time are in no session.

    Events of one instant are counted before they are dealt by key.
    """
    parts = events.where(F.col(f"`{ts}`").isNotNull()).groupBy(*keys, F.col(f"`{ts}`").alias("session_start")).agg(F.count(F.lit(1)).alias("n"))
    merged = merge_sessions(parts.withColumn("last_event", F.col("session_start")), keys, gap_seconds)
    return merged.select(*keys, "session_start", _later(F.col("last_event"), gap_seconds).alias("session_end"), "n")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def sessions_stream(stream: DataFrame, keys: list[str], ts: str, gap_seconds: int, delay_seconds: int, output_dir: str, state_dir: str,
                    available_now: bool = True, processing_time: str | None = None):
    """Start a query that writes ``sessions`` and ``late`` below ``output_dir`` by batch id; state and progress in ``state_dir``."""
    spark = stream.sparkSession

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        before = f"{state_dir}/open/batch={batch_id - 1}"
        known = _exists(spark, f"{before}/mark/_SUCCESS")
        mark = spark.read.parquet(f"{before}/mark").first()["mark"] if known else None
        time = F.col(f"`{ts}`")
        on_time = F.coalesce(time >= F.lit(mark).cast(batch.schema[ts].dataType), F.lit(False)) if mark is not None else time.isNotNull()
        parts = batch.where(on_time).groupBy(*keys, time.alias("session_start")).agg(F.count(F.lit(1)).alias("n"))
        parts = parts.withColumn("last_event", F.col("session_start"))
        if known:
            parts = parts.unionByName(spark.read.schema(parts.schema).parquet(f"{before}/sessions"))
        merged = merge_sessions(parts, keys, gap_seconds).persist()
        latest = batch.agg(F.max(time).alias("t")).first()["t"]
        if latest is not None:
            passed = latest - dt.timedelta(seconds=delay_seconds)
            mark = passed if mark is None else max(mark, passed)
        end = _later(F.col("last_event"), gap_seconds)
        closed = F.coalesce(end <= F.lit(mark).cast(batch.schema[ts].dataType), F.lit(False)) if mark is not None else F.lit(False)
        here = f"{state_dir}/open/batch={batch_id}"
        (merged.where(closed).select(*keys, "session_start", end.alias("session_end"), "n")
         .write.mode("overwrite").parquet(f"{output_dir}/sessions/batch_id={batch_id}"))
        batch.where(~on_time).write.mode("overwrite").parquet(f"{output_dir}/late/batch_id={batch_id}")
        merged.where(~closed).select(*keys, "session_start", "last_event", "n").write.mode("overwrite").parquet(f"{here}/sessions")
        # the mark is written last: a state without it is never read
        spark.createDataFrame([(mark,)], f"mark {batch.schema[ts].dataType.simpleString()}").coalesce(1).write.mode("overwrite").parquet(f"{here}/mark")
        merged.unpersist()
        batch.unpersist()
        drop_folder(spark, f"{state_dir}/open/batch={batch_id - 2}")

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", f"{state_dir}/progress")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()


def sessions_via_stream(slices: list[DataFrame], keys: list[str], ts: str, gap_seconds: int, delay_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(closed sessions, late rows) of slices that arrive one after another.  Staged in the shared checkpoint folder; runs when called."""
    spark = slices[0].sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/sessions-{uuid.uuid4().hex}"
    for part in slices:
        part.write.mode("append").parquet(f"{base}/input")
        reader = spark.readStream.schema(slices[0].schema).parquet(f"{base}/input")
        sessions_stream(reader, keys, ts, gap_seconds, delay_seconds, f"{base}/output", f"{base}/state").awaitTermination()
    drop_folder(spark, f"{base}/input")
    drop_folder(spark, f"{base}/state")
    return tuple(spark.read.parquet(f"{base}/output/{name}").drop("batch_id") for name in ("sessions", "late"))
