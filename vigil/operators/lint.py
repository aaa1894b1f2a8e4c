"""Schema linting over column metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigil.functions.columns import compact
from vigil.operators import profile as P
from vigil.operators.schema import columns_of

# The text types the id rule looks at.
TEXT_TYPES = ("TEXT", "VARCHAR", "STRING")


def _finding(rule: str, severity: str, message):
    return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), message.alias("message"))


def lint_schema(columns: DataFrame, naming_case: str | None = "snake_case",
                require_descriptions: bool = False, require_not_null: bool = False,
                word_match: bool = False) -> DataFrame:
    """One row per issue: table_name, column, severity, rule, message.

    ``naming_case`` 'snake_case' checks upper-case letters (warning) and spaces (error);
    'camelCase' checks underscores; None skips both.  ``word_match`` makes the id rule
    look for a whole word 'id' instead of any substring (the reference's default flags
    'width' and 'paid').
    """
    name = F.col("name")
    q = lambda text: F.concat(F.lit("Column '"), name, F.lit(text))
    items = []
    if naming_case == "snake_case":
        items.append(F.when(name != F.lower(name), _finding("naming_case", "warning", q("' should use snake_case"))))
        items.append(F.when(name.contains(" "), _finding("no_spaces", "error", q("' contains spaces"))))
    elif naming_case == "camelCase":
        items.append(F.when(name.contains("_"), _finding("naming_case", "warning", q("' should use camelCase"))))
    if require_descriptions:
        items.append(F.when(F.coalesce(F.col("description"), F.lit("")) == "",
                            _finding("missing_description", "info", q("' is missing a description"))))
    if require_not_null:
        items.append(F.when(F.coalesce(F.col("nullable"), F.lit(True)),
                            _finding("nullable_column", "warning", q("' is nullable but should be NOT NULL"))))
    typ = F.coalesce(F.col("type"), F.lit(""))
    has_id = (F.lower(name).rlike(r"(^|[^a-z0-9])id([^a-z0-9]|$)") if word_match
              else F.lower(name).contains("id"))
    items.append(F.when(F.upper(typ).isin(*TEXT_TYPES) & has_id,
                        _finding("id_type", "warning",
                                 F.concat(q("' looks like an ID but is "), typ))))
    table = F.col("table_name") if "table_name" in columns.columns else F.lit(None).cast("string")
    return (columns.select(table.alias("table_name"), name.alias("column"),
                           F.explode(compact(*items)).alias("i"))
                   .select("table_name", "column", "i.severity", "i.rule", "i.message"))


def lint_summary(columns: DataFrame, issues: DataFrame) -> DataFrame:
    """Per table: columns_checked, issue_count, has_issues."""
    checked = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("columns_checked"))
    found = issues.groupBy("table_name").agg(F.count(F.lit(1)).alias("issue_count"))
    out = checked.join(found, "table_name", "left")
    return out.select("table_name", "columns_checked",
                      F.coalesce("issue_count", F.lit(0)).cast("bigint").alias("issue_count"),
                      (F.coalesce("issue_count", F.lit(0)) > 0).alias("has_issues"))


def lint_with_data(df: DataFrame, table: str | None = None) -> DataFrame:
    """Findings that need the data, from one scan of it.

    'never_null' (info): a nullable column in which no NULL occurs;
    'numeric_text' (warning): a text column whose non-null values all read as numbers.
    """
    meta = columns_of(df, table).select("name", "type", "nullable")
    stats = P.column_stats(df).select(F.col("column_name").alias("name"), "row_count", "null_count", "castable_count")
    j = meta.join(stats, "name")
    items = F.array(
        F.when(F.col("nullable") & (F.col("null_count") == 0) & (F.col("row_count") > 0),
               _finding("never_null", "info", F.concat(F.lit("Column '"), F.col("name"),
                                                      F.lit("' is nullable but holds no NULL")))),
        F.when((F.col("type") == "string") & (F.col("castable_count") > 0)
               & (F.col("castable_count") == F.col("row_count") - F.col("null_count")),
               _finding("numeric_text", "warning", F.concat(F.lit("Column '"), F.col("name"),
                                                           F.lit("' is text but every value is a number")))),
    )
    return (j.select(F.lit(table).cast("string").alias("table_name"), F.col("name").alias("column"),
                     F.explode(F.filter(items, lambda x: x.isNotNull())).alias("i"))
             .select("table_name", "column", "i.severity", "i.rule", "i.message"))
