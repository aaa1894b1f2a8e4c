"""Quality rules, scorecard and failing rows.

Row-level rules (not_null, min, max, accepted_values) compile to ``count_if`` columns of a
single aggregate — one scan for all of them.  ``unique`` is one ``groupBy`` per key set
(map-side partial counts, so a hot value crosses the shuffle once per partition).
``custom_sql`` runs the user's SQL with ``{{table}}`` bound to the DataFrame.
Rule types and columns are checked against the schema before any job starts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigil.functions.columns import compact

ROW_RULES = ("not_null", "min", "max", "accepted_values")
RULE_TYPES = ROW_RULES + ("unique", "custom_sql")
SAMPLE_ROWS = 5

_RESULT_SCHEMA = ("rule_index int, rule_type string, `column` string, passed boolean, "
                  "failures bigint, error string")


@dataclass(frozen=True)
class Rule:
    type: str
    column: str | tuple[str, ...] | None = None
    value: float | int | None = None
    values: tuple = field(default_factory=tuple)
    sql: str | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        if self.column is None:
            return ()
        return (self.column,) if isinstance(self.column, str) else tuple(self.column)

    @property
    def column_label(self) -> str:
        return ",".join(self.columns)


def rule(type: str, column=None, value=None, values=None, sql=None) -> Rule:  # noqa: A002
    return Rule(type, tuple(column) if isinstance(column, list) else column, value,
                tuple(values or ()), sql)


def _validate(df: DataFrame, rules: list[Rule]) -> None:
    names = set(df.columns)
    for r in rules:
        if r.type not in RULE_TYPES:
            raise ValueError(f"unknown rule type {r.type!r}")
        if r.type != "custom_sql":
            if not r.columns:
                raise ValueError(f"rule {r.type!r} needs a column")
            missing = [c for c in r.columns if c not in names]
            if missing:
                raise ValueError(f"rule {r.type!r}: unknown columns {missing}")
        if r.type in ("min", "max") and r.value is None:
            raise ValueError(f"rule {r.type!r} needs a value")
        if r.type == "custom_sql" and not r.sql:
            raise ValueError("custom_sql rule needs sql")


def failure_condition(df: DataFrame, r: Rule) -> Column:
    """Row-level failure predicate of a row rule (NULL-safe: NULL never fails min/max/values)."""
    c = F.col(r.columns[0])
    if r.type == "not_null":
        return c.isNull()
    if r.type == "min":
        return c.isNotNull() & (c < F.lit(r.value))
    if r.type == "max":
        return c.isNotNull() & (c > F.lit(r.value))
    if r.type == "accepted_values":
        dtype = df.schema[r.columns[0]].dataType
        if not r.values:
            return c.isNotNull()
        # Literals are converted to the column type; ones that do not convert match nothing
        # (a NULL inside NOT IN would otherwise hide every failure).
        accepted = F.filter(F.array(*[F.lit(v).try_cast(dtype) for v in r.values]), lambda x: x.isNotNull())
        return c.isNotNull() & ~F.array_contains(accepted, c)
    raise ValueError(r.type)


def _row_rule_results(df: DataFrame, indexed: list[tuple[int, Rule]]) -> DataFrame | None:
    if not indexed:
        return None
    wide = df.agg(*[F.count_if(failure_condition(df, r)).alias(f"_f{i}") for i, r in indexed])
    entries = [F.struct(F.lit(i).alias("rule_index"), F.lit(r.type).alias("rule_type"),
                        F.lit(r.column_label).alias("column"), F.col(f"_f{i}").alias("failures"))
               for i, r in indexed]
    return (wide.select(F.explode(F.array(*entries)).alias("r")).select("r.*")
                .select("rule_index", "rule_type", "column", (F.col("failures") == 0).alias("passed"),
                        "failures", F.lit(None).cast("string").alias("error")))


def duplicate_groups(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Key values present more than once (nulls ignored), with their counts."""
    keys = [F.col(c) for c in columns]
    not_null = reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])
    return (df.select(*columns).filter(not_null).groupBy(*columns)
              .agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > 1))


def _unique_result(df: DataFrame, i: int, r: Rule) -> DataFrame:
    surplus = duplicate_groups(df, r.columns).agg(
        F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).cast("bigint").alias("failures"))
    return surplus.select(F.lit(i).alias("rule_index"), F.lit(r.type).alias("rule_type"),
                          F.lit(r.column_label).alias("column"), (F.col("failures") == 0).alias("passed"),
                          "failures", F.lit(None).cast("string").alias("error"))


# SQLSTATE classes of errors that lie in a query or in the values it meets: cardinality, data, syntax and names,
# and errors that the query raises itself.  A lost executor or a full disk has none of these.
_RULE_ERRORS = ("21", "22", "42", "P0")


def _custom_result(spark: SparkSession, df: DataFrame, i: int, r: Rule) -> DataFrame:
    """The rule's own query, run on its own: an error in it, found while planning or while reading the data,
    becomes this rule's row and leaves the other rules alone.  Every other error fails the whole validation, so
    that a micro-batch is retried instead of committed."""
    try:
        # Only the {{table}} placeholder is bound; any other brace in the user's SQL is literal.
        parts = [x.replace("{", "{{").replace("}", "}}") for x in r.sql.split("{{table}}")]
        failures = spark.sql("{t}".join(parts), t=df).count()
        row = (i, r.type, r.column_label, failures == 0, failures, None)
    except PySparkException as e:
        if (e.getSqlState() or "")[:2] not in _RULE_ERRORS:
            raise
        row = (i, r.type, r.column_label, False, 0, str(e))
    return spark.createDataFrame([row], _RESULT_SCHEMA)


def validate_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """D19 per-rule results: rule_index, rule_type, column, passed, failures, error.  Custom SQL rules
    run when this is called, all others when the result is read."""
    _validate(df, rules)
    spark = df.sparkSession
    if not rules:
        return spark.createDataFrame([], _RESULT_SCHEMA)
    indexed = list(enumerate(rules))
    parts = []
    rows = _row_rule_results(df, [(i, r) for i, r in indexed if r.type in ROW_RULES])
    if rows is not None:
        parts.append(rows)
    parts += [_unique_result(df, i, r) for i, r in indexed if r.type == "unique"]
    parts += [_custom_result(spark, df, i, r) for i, r in indexed if r.type == "custom_sql"]
    return reduce(DataFrame.unionByName, parts)


def scorecard(results: DataFrame) -> DataFrame:
    """D19 summary: total_rules, passed, failed, pass_rate (round 2; 1.0 with no rules)."""
    return results.agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if("passed").alias("passed"),
        (F.count(F.lit(1)) - F.count_if("passed")).alias("failed"),
    ).select("total_rules", "passed", "failed",
             F.when(F.col("total_rules") > 0, F.round(F.col("passed") / F.col("total_rules"), 2))
              .otherwise(F.lit(1.0)).alias("pass_rate"))


def failed_rows(df: DataFrame, rules: list[Rule], k: int = SAMPLE_ROWS) -> DataFrame:
    """Up to ``k`` failing values per rule as text, smallest first (deterministic).

    Row rules list failing values ('NULL' for nulls), ``unique`` lists duplicated keys.
    The per-rule limit is a window ``row_number() <= k`` that Spark plans as a partial
    group limit before the shuffle.
    """
    _validate(df, rules)
    parts, entries = [], []
    for i, r in enumerate(rules):
        if r.type in ROW_RULES:
            c = F.col(r.columns[0])
            entries.append(F.when(failure_condition(df, r), F.struct(
                F.lit(i).alias("rule_index"), F.lit(r.type).alias("rule_type"),
                F.coalesce(c.cast("string"), F.lit("NULL")).alias("value"))))
        elif r.type == "unique":
            key = F.concat_ws(",", *[F.col(c).cast("string") for c in r.columns])
            parts.append(duplicate_groups(df, r.columns).select(
                F.lit(i).alias("rule_index"), F.lit(r.type).alias("rule_type"), key.alias("value")))
    if entries:  # all row rules in one scan
        parts.insert(0, df.select(F.explode(compact(*entries)).alias("x")).select("x.*"))
    if not parts:
        return df.sparkSession.createDataFrame([], "rule_index int, rule_type string, value string, rank int")
    union = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("rule_index").orderBy("value")
    return union.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def quarantine(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rows with ``failed_rules`` (array of 'index:type') — the general quarantine form.

    Row rules are evaluated per row; ``unique`` marks every row of a duplicated key through
    a join with the (pre-aggregated) duplicate keys.
    """
    _validate(df, rules)
    out = df
    flags = []
    for i, r in enumerate(rules):
        label = F.lit(f"{i}:{r.type}")
        if r.type in ROW_RULES:
            flags.append(F.when(failure_condition(df, r), label))
        elif r.type == "unique":
            marker = f"_dup{i}"
            dups = duplicate_groups(df, r.columns).select(*r.columns, F.lit(True).alias(marker))
            out = out.join(dups, list(r.columns), "left")
            flags.append(F.when(F.col(marker), label))
    cols = [c for c in df.columns]
    return out.select(*cols, compact(*flags).alias("failed_rules")
                      if flags else F.array().cast("array<string>").alias("failed_rules"))
