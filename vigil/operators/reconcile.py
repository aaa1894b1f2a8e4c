"""Table reconciliation: two versions of a table compared by content.

``compare`` answers for any two DataFrames: every row that one version has more often than the other, with its
multiplicity, as ``EXCEPT ALL`` in both directions would, told apart by key into added, removed and changed.  One
``groupBy`` over whole rows with map-side partial counts does it; no version is joined to the other.

For versions that are kept, ``write_version`` sorts a table by hash ranges of its key (the leaves of a tree of
fan-out ``FANOUT``) and stores a digest per tree node.  A digest is a row count and two sums of 64-bit row hashes:
sums merge in any order, count duplicates, and a parent's digest is the sum of its children's.  ``differing_leaves``
descends from the root and looks at the children of differing nodes only; ``reconcile`` then reads just the
differing leaves of both versions (files and row groups are skipped by their statistics), so the bytes read follow the
change, not the table.

Equal rows are found equal by digest up to a collision of two 64-bit sums and a count; what differs is compared by value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
LEVELS = 3
_SECOND = 0x51ED270B  # makes the second row hash another one


def _hashable(df: DataFrame) -> list[Column]:
    """Columns as hash arguments.  Hashes skip nulls, so null flags go along; nested values hash as JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))
        out += [F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) if nested else c, c.isNull()]
    return out


def _leaf(df: DataFrame, keys: list[str], levels: int) -> Column:
    key = F.xxhash64(*_hashable(df.select(*[F.col(f"`{k}`") for k in keys])))
    return F.shiftrightunsigned(key, 64 - FANOUT_BITS * levels).cast("int")


def _digest(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))


def write_version(df: DataFrame, keys: list[str], path: str, levels: int = LEVELS) -> None:
    """Write ``df`` under ``path``: ``rows`` in the order of their leaves, ``digests`` partitioned by tree level (0 is the root).

    Rows are dealt by ranges of (leaf, row hash), so the copies of a hot key are spread over files too.
    """
    spark = df.sparkSession
    if any(c.lower() == "leaf" for c in df.columns):
        raise ValueError("a column is called leaf")
    leafed = df.withColumn("leaf", _leaf(df, keys, levels))
    leafed.repartitionByRange("leaf", F.xxhash64(*_hashable(df))).sortWithinPartitions("leaf").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    values = _hashable(rows.drop("leaf"))
    hashed = rows.select(F.col("leaf").alias("node"), F.lit(1).cast("bigint").alias("n"),
                         F.xxhash64(*values).cast("decimal(38,0)").alias("h1"),
                         F.xxhash64(F.lit(_SECOND), *values).cast("decimal(38,0)").alias("h2"))
    digest = _digest(hashed, ["node"]).withColumn("level", F.lit(levels))
    all_levels = [digest]
    for level in range(levels - 1, -1, -1):
        up = digest.withColumn("node", F.shiftright("node", FANOUT_BITS * (levels - level)))
        all_levels.append(_digest(up, ["node"]).withColumn("level", F.lit(level)))
    reduce(DataFrame.unionByName, all_levels).write.partitionBy("level").parquet(f"{path}/digests")


def _nodes(spark: SparkSession, path: str) -> DataFrame:
    """Digests of all levels; the schema is stated so that an empty version reads as no nodes."""
    return spark.read.schema("node int, n bigint, h1 decimal(38,0), h2 decimal(38,0), level int").parquet(f"{path}/digests")


def differing_nodes(spark: SparkSession, before: str, after: str) -> list[list[int]]:
    """Per level, the nodes whose digests differ.  Only children of differing nodes are compared.

    The lists are bounded by the tree, never by the tables.
    """
    a, b = _nodes(spark, before), _nodes(spark, after)
    levels = max((r["m"] or 0) for r in (x.agg(F.max("level").alias("m")).first() for x in (a, b)))
    found, parents = [], None
    for level in range(levels + 1):
        sides = []
        for x in (a, b):
            own = x.where(F.col("level") == level).drop("level")
            if parents is not None:
                own = own.where(F.shiftright("node", FANOUT_BITS).isin(parents))
            sides.append(own)
        same = F.col("x.n").eqNullSafe(F.col("y.n")) & F.col("x.h1").eqNullSafe(F.col("y.h1")) & F.col("x.h2").eqNullSafe(F.col("y.h2"))
        joined = sides[0].alias("x").join(sides[1].alias("y"), "node", "full_outer").where(~same)
        parents = sorted(r["node"] for r in joined.select("node").collect())
        found.append(parents)
        if not parents:
            break
    return found


def differing_leaves(spark: SparkSession, before: str, after: str) -> list[int]:
    return differing_nodes(spark, before, after)[-1]


def compare(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of the tables, ``side`` (before / after), ``change`` (added / removed / changed) and ``copies``.

    A row stands on the side that has it ``copies`` times more often.  A key with such rows on both sides is changed,
    otherwise added or removed.  Nulls are equal to nulls, in keys too.
    """
    if sorted(before.columns) != sorted(after.columns):
        raise ValueError("the versions have different columns: compare their schemas first")
    columns = [F.col(f"`{c}`") for c in before.columns]
    both = before.select(*columns, F.lit(-1).cast("bigint").alias("__way")).union(
        after.select(*columns, F.lit(1).cast("bigint").alias("__way")))
    surplus = both.groupBy(*columns).agg(F.sum("__way").alias("__more")).where("__more <> 0")
    of_key = (surplus.groupBy(*[F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)])
              .agg(F.bool_or(F.col("__more") < 0).alias("__lost"), F.bool_or(F.col("__more") > 0).alias("__won")))
    same_key = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)])
    change = F.when(F.col("__lost") & F.col("__won"), "changed").when(F.col("__won"), "added").otherwise("removed")
    return surplus.join(of_key, same_key).select(
        *columns, F.when(F.col("__more") > 0, "after").otherwise("before").alias("side"), change.alias("change"),
        F.abs("__more").alias("copies"))


def rows_of_leaves(spark: SparkSession, path: str, leaves: list[int]) -> DataFrame:
    """Rows of some leaves: runs of neighbouring leaves become range predicates, which the scan pushes down."""
    rows = spark.read.parquet(f"{path}/rows")
    runs: list[list[int]] = []
    for x in sorted(leaves):
        if runs and runs[-1][1] == x - 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    wanted = [F.col("leaf") == lo if lo == hi else (F.col("leaf") >= lo) & (F.col("leaf") <= hi) for lo, hi in runs]
    while len(wanted) > 1:  # a balanced disjunction
        wanted = [reduce(lambda x, y: x | y, wanted[i: i + 2]) for i in range(0, len(wanted), 2)]
    return rows.where(wanted[0] if wanted else F.lit(False))


def reconcile(spark: SparkSession, before: str, after: str, keys: list[str]) -> DataFrame:
    """``compare`` of two written versions that reads their differing leaves only."""
    leaves = differing_leaves(spark, before, after)
    return compare(*[rows_of_leaves(spark, path, leaves).drop("leaf") for path in (before, after)], keys)


def change_summary(changes: DataFrame) -> DataFrame:
    """(change, side, distinct_rows, copies) of a comparison."""
    return changes.groupBy("change", "side").agg(F.count(F.lit(1)).alias("distinct_rows"), F.sum("copies").alias("copies"))
