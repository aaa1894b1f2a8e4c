"""Column lineage (S17-S19) over an edge DataFrame
(source_table, source_column, target_table, target_column, transform).

One hop is a join; transitive lineage is semi-naive iteration: each round joins only the
pairs found in the previous round with the edges, keeps the new ones and writes them to the
shared checkpoint folder (``session.Rounds``).  Rounds end when no new pair is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigil.session import Rounds


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("source_table", "source_column", "target_table", "target_column",
                        F.coalesce(F.col("transform"), F.lit("direct")).alias("transform")).distinct()


def lineage_upstream(edges: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """For each requested (table, column) its direct sources: table, column, source,
    transform.  A requested column without sources keeps one row with NULL source."""
    e = _edges(edges).select(
        F.col("target_table").alias("table"), F.col("target_column").alias("column"),
        F.concat_ws(".", "source_table", "source_column").alias("source"), "transform")
    if columns is None:
        return e
    return columns.select("table", "column").distinct().join(e, ["table", "column"], "left")


def lineage_downstream(edges: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """For each requested (table, column) its direct targets."""
    e = _edges(edges).select(
        F.col("source_table").alias("table"), F.col("source_column").alias("column"),
        F.concat_ws(".", "target_table", "target_column").alias("target"), "transform")
    if columns is None:
        return e
    return columns.select("table", "column").distinct().join(e, ["table", "column"], "left")


def lineage_ancestors(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """S19 for requested columns: every upstream column of each requested (table, column)
    with its minimum hop count.  Output: table, column, source_table, source_column, hops.
    Runs its rounds when called; the edges are the only thing cached meanwhile."""
    key = ["table", "column", "source_table", "source_column"]
    e = _edges(edges).select("source_table", "source_column", "target_table", "target_column").distinct().persist()
    seeds = columns.select("table", "column").distinct()
    state, k = Rounds(edges.sparkSession, "lineage"), 1
    now = state.write(1, seeds.join(e, (F.col("table") == F.col("target_table")) & (F.col("column") == F.col("target_column")))
                      .select(*key).distinct())
    while not now.isEmpty():
        k += 1
        step = (now.alias("f")
                .join(e.alias("e"), (F.col("f.source_table") == F.col("e.target_table"))
                      & (F.col("f.source_column") == F.col("e.target_column")))
                .select(F.col("f.table"), F.col("f.column"), F.col("e.source_table"), F.col("e.source_column"))
                .distinct())
        now = state.write(k, step.join(state.all().drop("round"), key, "left_anti"))
    e.unpersist()
    return state.all().withColumnRenamed("round", "hops")


def lineage_closure(edges: DataFrame) -> DataFrame:
    """S19 over the whole graph: every (ancestor, descendant) pair with the minimum hop
    count — the upstream search seeded with every column that has a source.  The result is
    quadratic in the depth of the graph by definition; ask ``lineage_ancestors`` for the columns
    of interest instead where that is possible.
    Output: source_table, source_column, target_table, target_column, hops."""
    targets = edges.select(F.col("target_table").alias("table"), F.col("target_column").alias("column"))
    anc = lineage_ancestors(edges, targets)
    return anc.select("source_table", "source_column", F.col("table").alias("target_table"),
                      F.col("column").alias("target_column"), "hops")
