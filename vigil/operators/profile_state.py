"""Incremental profiles (D0, D5-D8): stored sketches per partition of a table, merged on read.

``update`` keeps one row per (partition, column) of a partitioned Parquet table: exact counts, sums and extremes, and
mergeable sketches of the distinct values (HyperLogLog), of the quantiles (KLL) and of the most frequent values.  A
partition's signature (files, bytes, latest modification) comes from a listing that opens no file; only
partitions whose signature changed are read (with the schema of one of their files) and replaced, and those that are gone are retracted.
``profile`` merges what is stored: the table is not read at all.

Bounds: distinct counts within ``DISTINCT_ERROR``, quantiles within ``RANK_ERROR`` of their rank (several standard errors
each); counts of frequent values are at most n / ``TRACKED`` too high per merged sketch; all else is exact.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType, StructType

from vigil.session import drop_folder

LG_K = 12
DISTINCT_ERROR = 0.05
KLL_K = 400
RANK_ERROR = 0.02
TRACKED = 1000
TOP = 5
PART = "part"  # folders of the state are named by the hash of the partition value
_NULL = "\x00null"


def signatures(spark: SparkSession, table: str, by: str) -> DataFrame:
    """(part, files, bytes, latest, one file) of every partition, from the file listing alone."""
    # partition values stay the text that they are in the folder names
    listing = StructType.fromDDL("path string, modificationTime timestamp, length bigint, content binary").add(by, "string")
    files = spark.read.format("binaryFile").schema(listing).option("basePath", table).load(table)
    return files.groupBy(F.col(f"`{by}`").alias(PART)).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("latest"), F.max("path").alias("one"))


def _sketches(c: Column, numeric: bool) -> list[Column]:
    number = c.cast("double") if numeric else F.lit(None).cast("double")
    text = c.cast("string")
    return [F.count(F.lit(1)).alias("row_count"), F.count_if(c.isNull()).alias("null_count"),
            F.min(number).alias("low"), F.max(number).alias("high"), F.sum(number).alias("total"),
            F.hll_sketch_agg(text, LG_K).alias("hll"), F.kll_sketch_agg_double(number, KLL_K).alias("kll"),
            F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)).alias("top")]


def sketch_partitions(df: DataFrame, by: str) -> DataFrame:
    """One row per (partition, column): all columns of a partition come from one aggregate over one scan."""
    columns = [f for f in df.schema.fields if f.name != by]
    parts = [[x.alias(f"s{i}_{j}") for j, x in enumerate(_sketches(F.col(f"`{f.name}`"), isinstance(f.dataType, NumericType)))]
             for i, f in enumerate(columns)]
    names = ["row_count", "null_count", "low", "high", "total", "hll", "kll", "top"]
    wide = df.groupBy(F.col(f"`{by}`").cast("string").alias(PART)).agg(*[x for p in parts for x in p])
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("position"), F.lit(isinstance(f.dataType, NumericType)).alias("numeric"),
                     *[F.col(f"s{i}_{j}").alias(n) for j, n in enumerate(names)]) for i, f in enumerate(columns)]
    return wide.select(PART, F.explode(F.array(*rows)).alias("x")).select(PART, "x.*")


def _stored(spark: SparkSession, state: str) -> DataFrame | None:
    """The state, or None before the first update."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.option("basePath", state).parquet(state).withColumn(PART, F.col("key"))


def update(spark: SparkSession, table: str, by: str, state: str) -> dict[str, list[str | None]]:
    """Bring the state up to date; the partitions that were read and those that were retracted.

    Lists of partitions are metadata: as long as the table's own directory listing, never its rows.
    """
    now, before = signatures(spark, table, by), _stored(spark, state)
    sign = ["files", "bytes", "latest"]
    if before is None:
        changed, gone = [r[PART] for r in now.select(PART).collect()], []
    else:
        known = before.select(PART, *[F.col(c).alias(f"old_{c}") for c in sign]).distinct()
        both = now.withColumnRenamed(PART, "p").drop("one").join(known.withColumnRenamed(PART, "q"), F.col("p").eqNullSafe(F.col("q")), "full_outer")
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in sign])
        listed = both.where(~same).select("p", "q", F.col("files").isNull().alias("gone")).collect()
        changed, gone = [r["p"] for r in listed if not r["gone"]], [r["q"] for r in listed if r["gone"]]
    if changed:
        of_file = spark.read.parquet(now.where(F.col(PART).eqNullSafe(F.lit(changed[0]).cast("string"))).first()["one"]).schema
        rows = spark.read.schema(StructType(of_file.fields).add(by, "string")).option("basePath", table).parquet(table)
        column = F.col(f"`{by}`")
        wanted = column.isin([p for p in changed if p is not None])
        if None in changed:
            wanted |= column.isNull()
        fresh = sketch_partitions(rows.where(wanted), by)
        fresh = (fresh.withColumnRenamed(PART, "key").join(now.withColumnRenamed(PART, "p").drop("one"), F.col("key").eqNullSafe(F.col("p"))).drop("p")
                 .withColumn(PART, F.sha2(F.coalesce("key", F.lit(_NULL)), 256)))
        (fresh.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(state))
    for p in gone:
        drop_folder(spark, f"{state}/{PART}={hashlib.sha256((_NULL if p is None else p).encode()).hexdigest()}")
    return {"read": sorted(changed, key=str), "retracted": sorted(gone, key=str)}


def profile(spark: SparkSession, state: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), top: int = TOP) -> DataFrame:
    """One row per column: exact counts, extremes and mean, estimated distinct count, quantiles and top values."""
    merged = _stored(spark, state).groupBy("column_name", "position", "numeric").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"), F.min("low").alias("min"), F.max("high").alias("max"),
        F.sum("total").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct_estimate"),
        F.kll_merge_agg_double("kll").alias("kll"), F.call_function("approx_top_k_combine", F.col("top"), F.lit(TRACKED)).alias("top"))
    known = F.col("row_count") - F.col("null_count")
    return merged.select(
        "column_name", "position", "row_count", "null_count", "min", "max",
        F.when(F.col("numeric") & (known > 0), F.col("total") / known).alias("mean"), "distinct_estimate",
        F.when(F.col("numeric") & (known > 0), F.array(*[F.kll_sketch_get_quantile_double("kll", F.lit(q)) for q in quantiles])).alias("quantiles"),
        F.call_function("approx_top_k_estimate", F.col("top"), F.lit(top)).alias("top_values"))
