"""Readers for the parquet tables and the two sinks the operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazily read one table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: load(spark, sf_dir, n) for n in names}


def write_append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append-only sink (run / alert logs, loaded pipeline output)."""
    df.write.mode("append").format(fmt).save(path)


def write_partitions(df: DataFrame, path: str, partition_cols: list[str],
                     fmt: str = "parquet") -> None:
    """Replace only the partitions present in ``df`` (dynamic partition overwrite).

    Re-running a recompute for some intervals rewrites exactly those intervals; a lost
    executor mid-write leaves the previous partitions in place because the commit protocol
    only swaps in completed output.
    """
    (df.write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_cols)
       .format(fmt).save(path))
