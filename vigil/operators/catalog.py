"""Metadata catalog operators (C1-C7) over catalog DataFrames.

tables  (table_name, description, tags array<string>)
columns (table_name, name, type, nullable, description)
usage   (table_name, pipeline, column_name)  — one row per downstream read of a column
All results are DataFrames; nothing mutates shared state, and unknown tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

ACTIONS = ("add", "remove", "set")
ENTITY_TYPES = ("table", "column")


def catalog_sync(columns: DataFrame, schema: str = "public") -> DataFrame:
    """Table entries built from column metadata: table_name, description
    ('Imported from <schema>.<table>'), column_count, nullable_columns."""
    return (columns.groupBy("table_name")
                   .agg(F.count(F.lit(1)).alias("column_count"),
                        F.count_if(F.coalesce("nullable", F.lit(True))).alias("nullable_columns"))
                   .select("table_name",
                           F.concat(F.lit(f"Imported from {schema}."), F.col("table_name")).alias("description"),
                           "column_count", "nullable_columns"))


def sync_totals(synced: DataFrame) -> DataFrame:
    """C1 counts: tables_added, columns_added."""
    return synced.agg(F.count(F.lit(1)).alias("tables_added"),
                      F.sum("column_count").cast("bigint").alias("columns_added"))


def columns_from_catalog(spark: SparkSession, database: str | None = None) -> DataFrame:
    """C1 source: column metadata of the tables registered in the Spark catalog.

    Catalog listings are metadata (one entry per table / column), read through the
    catalog API and returned as a DataFrame.
    """
    rows = []
    for t in spark.catalog.listTables(database):
        for i, c in enumerate(spark.catalog.listColumns(t.name, database)):
            rows.append((t.name, c.name, c.dataType, bool(c.nullable), c.description or "", i))
    return spark.createDataFrame(rows, "table_name string, name string, type string, nullable boolean, "
                                       "description string, position int")


def catalog_search(tables: DataFrame, columns: DataFrame, query: str, scope: str = "all") -> DataFrame:
    """Case-insensitive substring search; rows: kind, table_name, column_name, name,
    description.  Tables match on name or description, columns on name or description,
    tags on the tag text (one row per matching tag)."""
    q = query.lower()
    hit = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(q)
    parts = []
    if scope in ("all", "tables"):
        parts.append(tables.filter(hit(F.col("table_name")) | hit(F.col("description"))).select(
            F.lit("table").alias("kind"), "table_name", F.lit(None).cast("string").alias("column_name"),
            F.col("table_name").alias("name"), "description"))
    if scope in ("all", "columns"):
        parts.append(columns.filter(hit(F.col("name")) | hit(F.col("description"))).select(
            F.lit("column").alias("kind"), "table_name", F.col("name").alias("column_name"), "name",
            "description"))
    if scope in ("all", "tags"):
        parts.append(tag_counts(tables).filter(hit(F.col("tag"))).select(
            F.lit("tag").alias("kind"), F.lit(None).cast("string").alias("table_name"),
            F.lit(None).cast("string").alias("column_name"), F.col("tag").alias("name"),
            F.format_string("%d tables", F.col("table_count")).alias("description")))
    if not parts:
        raise ValueError(f"unknown scope {scope!r}")
    return reduce(DataFrame.unionByName, parts)


def tag_counts(tables: DataFrame) -> DataFrame:
    """Tables carrying each tag."""
    return (tables.select("table_name", F.explode("tags").alias("tag"))
                  .groupBy("tag").agg(F.count_distinct("table_name").alias("table_count")))


def content_search(sources: dict[str, tuple[DataFrame, str, str]], query: str) -> DataFrame:
    """C4: search whole texts of several tables: source, row_id, occurrences.

    ``sources`` maps a source name to (DataFrame, id column, text column).  Matching is a
    case-insensitive substring test over the complete text; ``occurrences`` counts the
    non-overlapping hits.
    """
    q = query.lower()
    parts = []
    for name, (df, id_col, text_col) in sources.items():
        low = F.lower(F.col(text_col))
        parts.append(df.filter(low.contains(q)).select(
            F.lit(name).alias("source"), F.col(id_col).cast("bigint").alias("row_id"),
            ((F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / F.lit(len(q)))
            .cast("bigint").alias("occurrences")))
    return reduce(DataFrame.unionByName, parts)


def content_hits(hits: DataFrame) -> DataFrame:
    """C4 summary: per source the matching rows and total occurrences."""
    return hits.groupBy("source").agg(F.count(F.lit(1)).alias("rows"),
                                      F.sum("occurrences").cast("bigint").alias("occurrences"))


def catalog_describe(tables: DataFrame, columns: DataFrame, usage: DataFrame | None = None,
                     upstream: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """One documentation row per table: table_name, description, tags, column_count,
    downstream_pipelines, columns_read (distinct columns read downstream), upstream_sources (sorted
    names; ``upstream``: table_name, source) and query_count (rows of ``queries``: table_name)."""
    ncol = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("column_count"))
    out = tables.join(ncol, "table_name", "left")
    if usage is not None:
        u = usage.groupBy("table_name").agg(F.count_distinct("pipeline").alias("downstream_pipelines"),
                                            F.count_distinct("column_name").alias("columns_read"))
        out = out.join(u, "table_name", "left")
    else:
        out = out.withColumn("downstream_pipelines", F.lit(0)).withColumn("columns_read", F.lit(0))
    none = F.array().cast("array<string>")
    if upstream is not None:
        out = out.join(upstream.groupBy("table_name").agg(F.sort_array(F.collect_set("source")).alias("upstream_sources")),
                       "table_name", "left")
    else:
        out = out.withColumn("upstream_sources", none)
    if queries is not None:
        out = out.join(queries.groupBy("table_name").agg(F.count(F.lit(1)).alias("query_count")), "table_name", "left")
    else:
        out = out.withColumn("query_count", F.lit(0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("table_name", "description", "tags", z("column_count"), z("downstream_pipelines"),
                      z("columns_read"), F.coalesce("upstream_sources", none).alias("upstream_sources"), z("query_count"))


def describe_columns(columns: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """C5 column part: the columns of each table, optionally with profile statistics."""
    out = columns.select("table_name", "name", "type", F.coalesce("nullable", F.lit(True)).alias("nullable"),
                         F.coalesce("description", F.lit("")).alias("description"))
    if profile is not None:
        p = profile.select(F.col("table").alias("table_name"), F.col("column_name").alias("name"),
                           "null_count", "distinct_count", "min", "max", "mean")
        out = out.join(p, ["table_name", "name"], "left")
    return out


def _severity(change_type):
    return (F.when(change_type == "drop", "high").when(change_type.isin("rename", "modify"), "medium")
             .otherwise("low"))


def impact_analysis(changes: DataFrame, usage: DataFrame) -> DataFrame:
    """Per change (table_name, column, change_type[, new_name]): severity,
    affected_pipelines (distinct downstream readers of that column), recommendation, and the
    sorted names of those pipelines (readers of one column)."""
    if "new_name" not in changes.columns:
        changes = changes.withColumn("new_name", F.lit(""))
    reads = usage.select("table_name", F.col("column_name").alias("column"), "pipeline").distinct()
    n = (changes.select("table_name", "column").distinct()
                .join(reads, ["table_name", "column"])
                .groupBy("table_name", "column").agg(F.count(F.lit(1)).alias("affected_pipelines"),
                                                     F.sort_array(F.collect_set("pipeline")).alias("pipelines")))
    j = changes.join(n, ["table_name", "column"], "left")
    k = F.coalesce(F.col("affected_pipelines"), F.lit(0)).cast("bigint")
    ct = F.col("change_type")
    rec = (F.when(ct == "drop", F.format_string(
                "Remove all references to %s before dropping. Affects %d pipeline(s).", F.col("column"), k))
            .when(ct == "rename", F.format_string(
                "Update all references from %s to %s. Use ALTER TABLE RENAME to preserve downstream "
                "compatibility during transition.", F.col("column"), F.coalesce("new_name", F.lit(""))))
            .when(ct == "modify", F.format_string(
                "Verify type compatibility for %s across %d downstream pipeline(s).", F.col("column"), k))
            .otherwise(F.lit("")))
    return j.select("table_name", "column", "change_type", _severity(ct).alias("severity"),
                    k.alias("affected_pipelines"), rec.alias("recommendation"),
                    F.coalesce("pipelines", F.array().cast("array<string>")).alias("pipelines"))


def impact_pipelines(changes: DataFrame, usage: DataFrame) -> DataFrame:
    """C6 detail: one row per (change, affected pipeline)."""
    reads = usage.select("table_name", F.col("column_name").alias("column"), "pipeline").distinct()
    return changes.select("table_name", "column", "change_type").join(reads, ["table_name", "column"])


def impact_summary(impacts: DataFrame) -> DataFrame:
    """C6 totals per table: total_impacts, high_severity, medium_severity, low_severity."""
    s = F.col("severity")
    return impacts.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("total_impacts"), F.count_if(s == "high").alias("high_severity"),
        F.count_if(s == "medium").alias("medium_severity"), F.count_if(s == "low").alias("low_severity"))


def tag_apply(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply a batch of tag changes to a tag state.

    state   (entity_type, entity_name, tags array<string>)
    changes (entity_type, entity_name, action 'add'|'remove'|'set', tags array<string>)
    Per entity: a 'set' replaces the state (union of all set tags), then adds are merged,
    then removes subtracted; result sorted and distinct.  Unknown actions / entity types
    and column names not shaped 'table.column' raise at run time.
    """
    et, en, act = F.col("entity_type"), F.col("entity_name"), F.col("action")
    # The checks live in the action column itself, which every later step reads, so the
    # optimizer cannot prune them away.
    action = (F.when(~et.isin(*ENTITY_TYPES), F.raise_error(F.concat(F.lit("unknown entity type: "), et)))
               .when((et == "column") & ~en.rlike(r"^[^.]+\.[^.]+$"),
                     F.raise_error(F.lit("Column must be specified as table.column")))
               .when(act.isin(*ACTIONS), act)
               .otherwise(F.raise_error(F.concat(F.lit("unknown tag action: "), act))))
    exploded = changes.select("entity_type", "entity_name", action.alias("action"),
                              F.explode_outer("tags").alias("tag"))
    per = exploded.groupBy("entity_type", "entity_name").agg(
        F.collect_set(F.when(F.col("action") == "add", F.col("tag"))).alias("adds"),
        F.collect_set(F.when(F.col("action") == "remove", F.col("tag"))).alias("removes"),
        F.collect_set(F.when(F.col("action") == "set", F.col("tag"))).alias("sets"),
        F.max((F.col("action") == "set").cast("int")).alias("has_set"))
    key = ["entity_type", "entity_name"]
    j = state.select(*key, F.col("tags").alias("current")).join(per, key, "full_outer")
    base = F.when(F.col("has_set") == 1, F.col("sets")).otherwise(F.coalesce("current", F.array().cast("array<string>")))
    merged = F.array_except(F.array_union(base, F.coalesce("adds", F.array().cast("array<string>"))),
                            F.coalesce("removes", F.array().cast("array<string>")))
    return j.select(*key, F.array_sort(F.array_distinct(F.filter(merged, lambda x: x.isNotNull()))).alias("tags"),
                    F.col("has_set").isNotNull().alias("changed"))
