"""Quality rules on a stream (D19 per micro-batch) with ``foreachBatch``.

Every micro-batch is validated with the batch operator (one aggregate for all row rules)
and its results are written under ``batch_id=<id>`` with dynamic partition overwrite, so
a batch that is retried after a failure replaces its own partition instead of appending
twice.  Progress lives in the checkpoint location; a restarted query resumes from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigil.operators import rules as RU
from vigil.sources.tables import write_partitions


def validate_stream(stream: DataFrame, rules: list, output_dir: str, checkpoint_dir: str,
                    available_now: bool = True, processing_time: str | None = None):
    """Start a streaming query that writes per-batch rule results; returns the query."""
    RU._validate(stream, [r for r in rules if r.type != "custom_sql"])

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        res = RU.validate_rules(batch, rules).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        write_partitions(res, output_dir, ["batch_id"])

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()


def stream_scorecard(results: DataFrame) -> DataFrame:
    """Failures per rule summed over all processed batches, with the batch count."""
    return results.groupBy("rule_index", "rule_type", "column").agg(
        F.sum("failures").cast("bigint").alias("failures"), F.count_distinct("batch_id").alias("batches"))


def rules_via_stream(df: DataFrame, rules: list, files_per_batch: int | None = None) -> DataFrame:
    """Stage ``df`` in the shared checkpoint folder with its own partitioning, validate it as a
    stream (all files at once, or ``files_per_batch`` per micro-batch), and return the summed
    per-rule failures.  Runs when called; the staged copy is deleted afterwards."""
    import uuid

    from vigil.session import drop_folder, ensure_checkpoint_dir

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/rule-stream-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/input")
    reader = spark.readStream.schema(df.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    validate_stream(reader.parquet(f"{base}/input"), rules, f"{base}/output", f"{base}/state").awaitTermination()
    drop_folder(spark, f"{base}/input")
    drop_folder(spark, f"{base}/state")
    return stream_scorecard(spark.read.parquet(f"{base}/output")).drop("batches")
