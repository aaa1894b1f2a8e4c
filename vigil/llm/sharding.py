"""Sharding by extendible hashing: only buckets above the byte limit split on another hash bit.

A row's key is hashed to 60 bits.  The directory starts with one bucket; a bucket whose rows exceed the
limit and hold more than one key splits on the next bit, until every shard fits.  Only byte sums per
hash prefix are aggregated, ``STEP`` bits a round, and a further round looks only at the prefixes
that are still too large, so the directory is an ordinary table of one row per shard and each
row finds its shard by an equi-join on its prefix.

A bucket that holds one key cannot split: one row above the limit is a shard of its own; rows repeated
under one key are cut into parts by running byte sums (per task, then over tasks), each part
within the limit unless a single row is larger.

Defined results: null ids hash as empty text; null payloads have 0 bytes; an empty table gives no rows.
DataFrame functions only, no Python code on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm import common as C

BITS = 60
STEP = 12
LIMIT = 1 << 20


def key_hash(key: Column) -> Column:
    """First 60 bits of the MD5 of the key as text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits) -> Column:
    return F.expr(f"shiftright(__hash, {BITS} - ({bits}))")


def directory(sized: DataFrame, limit: int) -> list[DataFrame]:
    """Per round: (__fine, __depth, __shard_bytes, __single) of the prefixes that found their bucket."""
    spark = sized.sparkSession
    rounds, open_ = [], None
    for top in range(STEP, BITS + 1, STEP):
        rows = sized.withColumn("__fine", _prefix(top))
        if open_ is not None:
            rows = rows.withColumn("__above", _prefix(top - STEP)).join(open_, "__above", "left_semi")
        fine = C.materialise(rows.groupBy("__fine").agg(
            F.sum("__bytes").alias("b"), F.min("__hash").alias("lo"), F.max("__hash").alias("hi")), "prefixes")
        first = 0 if open_ is None else top - STEP + 1
        level = fine.withColumn("__depth", F.explode(F.sequence(F.lit(first), F.lit(top))))
        level = level.withColumn("__bucket", F.expr(f"shiftright(__fine, {top} - __depth)"))
        sums = (level.groupBy("__depth", "__bucket")
                .agg(F.sum("b").alias("__shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                .withColumn("__single", F.col("lo") == F.col("hi"))
                .where((F.col("__shard_bytes") <= limit) | F.col("__single")))
        # the shallowest bucket that fits: its parents were all too large
        fits = level.select("__fine", "__depth", "__bucket").join(sums, ["__depth", "__bucket"])
        leaf = fits.groupBy("__fine").agg(F.min(F.struct("__depth", "__shard_bytes", "__single")).alias("x"))
        found = C.materialise(leaf.select("__fine", "x.*"), "directory")
        rounds.append(found)
        rest = fine.join(found, "__fine", "left_anti").select(F.col("__fine").alias("__above"))
        open_ = C.materialise(rest, "open")
        if open_.isEmpty():
            break
    return rounds


def shard(df: DataFrame, key: str, payload: str, keep: list[str], limit: int = LIMIT) -> DataFrame:
    """``keep`` columns of every row with ``n_bytes``, ``depth``, ``shard`` (its hash bits), ``part``
    (within a bucket of one key) and ``shard_bytes`` (of the whole bucket)."""
    keep = C.apart(keep, ("n_bytes", "depth", "shard", "part", "shard_bytes"))
    size = F.coalesce(F.octet_length(F.col(payload)), F.lit(0)).cast("long")
    base = df.select(*[F.col(c) for c in keep], size.alias("__bytes"), key_hash(F.col(key)).alias("__hash"))
    base = C.materialise(base.withColumn("__row", F.monotonically_increasing_id())
                         .withColumn("__task", F.spark_partition_id()), "sized")
    rounds = directory(base.select("__hash", "__bytes"), limit)
    out = base
    for k, found in enumerate(rounds):
        named = found.select(F.col("__fine").alias(f"__fine{k}"), F.struct("__depth", "__shard_bytes", "__single").alias(f"__leaf{k}"))
        out = out.withColumn(f"__fine{k}", _prefix((k + 1) * STEP)).join(named, f"__fine{k}", "left")
    leaf = F.coalesce(*[F.col(f"__leaf{k}") for k in range(len(rounds))])
    out = out.select(*keep, "__bytes", "__hash", "__row", "__task", leaf.alias("__leaf")).select(
        *keep, "__bytes", "__hash", "__row", "__task", "__leaf.*")

    repeated = F.col("__single") & (F.col("__shard_bytes") > limit)
    whole = out.where(~repeated).withColumn("part", F.lit(0).cast("long"))
    stuck = out.where(repeated)
    within = Window.partitionBy("__hash", "__task").orderBy("__row")
    before = Window.partitionBy("__hash").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = stuck.groupBy("__hash", "__task").agg(F.sum("__bytes").alias("b"), F.count("*").alias("n"), F.max("__bytes").alias("m"))
    tasks = tasks.select("__hash", "__task", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("__b0"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n0"),
                         F.max("m").over(Window.partitionBy("__hash")).alias("__m"))
    placed = (stuck.withColumn("__b1", F.sum("__bytes").over(within) - F.col("__bytes"))
              .withColumn("__n1", F.row_number().over(within) - 1).join(tasks, ["__hash", "__task"]))
    # a part takes the rows that start within limit - m bytes; rows above half the limit stay alone
    part = F.when(2 * F.col("__m") > limit, F.col("__n0") + F.col("__n1")).otherwise(
        F.floor((F.col("__b0") + F.col("__b1")) / (limit - F.col("__m"))))
    cut = placed.withColumn("part", part.cast("long"))

    def final(x: DataFrame) -> DataFrame:
        bits = F.substring(F.lpad(F.bin("__hash"), BITS, "0"), F.lit(1), F.col("__depth"))
        return x.select(*keep, F.col("__bytes").alias("n_bytes"), F.col("__depth").cast("int").alias("depth"),
                        bits.alias("shard"), "part", F.col("__shard_bytes").alias("shard_bytes"))

    return reduce(DataFrame.unionByName, [final(whole), final(cut)])


def write_shards(df: DataFrame, key: str, payload: str, path: str, limit: int = LIMIT) -> None:
    """Write the rows of ``df`` as one Parquet folder per shard and part."""
    out = shard(df, key, payload, df.columns, limit)
    out.repartition("shard", "part").write.partitionBy("shard", "part").parquet(path)
