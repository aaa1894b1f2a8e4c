"""Composite flows (W1-W3): several operators over one source, reported as one tidy
long-form DataFrame (step, subject, metric, value).

Each step is a lazy DataFrame and the report is their union — one Spark job for the whole
flow.  The source is deliberately not cached: every step reads only the columns it needs
(column pruning), while a cache of a 100 TB table would spill it whole to executor disks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from vigil.operators import catalog as CA
from vigil.operators import lint as LT
from vigil.operators import profile as P
from vigil.operators import rules as RU
from vigil.operators import runs as RN
from vigil.operators import schema as SC

# Sensitive-value patterns (e-mail address, phone number).
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9][0-9 ().-]{7,}[0-9]",
}
PII_TAGS = ["pii", "sensitive"]
# A literal every match must contain: tested first so the regex runs only on candidates.
PII_GUARDS = {"email": "@"}

_REPORT = "step string, subject string, metric string, value string"


def _rows(df: DataFrame, step: str, subject: str, metrics: list[str]) -> DataFrame:
    return df.select(F.lit(step).alias("step"), F.col(subject).cast("string").alias("subject"),
                     F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value"))
                                         for m in metrics])).alias("x")).select("step", "subject", "x.*")


def pii_scan(tables: dict[str, DataFrame], patterns: dict[str, str] | None = None) -> DataFrame:
    """Per (table, column, pattern) the rows whose whole text matches — one scan per
    table, all string columns and patterns counted in the same aggregate."""
    patterns = patterns or PII_PATTERNS
    parts = []
    for name, df in tables.items():
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        checks = [(c, p) for c in cols for p in patterns]
        if not checks:
            continue
        def hit(c, p):
            test = F.col(c).rlike(patterns[p])
            guard = PII_GUARDS.get(p) if patterns[p] == PII_PATTERNS.get(p) else None
            return (F.col(c).contains(guard) & test) if guard else test
        wide = df.agg(*[F.count_if(hit(c, p)).alias(f"_m{i}") for i, (c, p) in enumerate(checks)])
        parts.append(wide.select(F.explode(F.array(*[
            F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column"), F.lit(p).alias("pattern"),
                     F.col(f"_m{i}").alias("matches")) for i, (c, p) in enumerate(checks)])).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


def validation_loop(df: DataFrame, table: str, baseline_columns: DataFrame, rules: list) -> DataFrame:
    """Profile -> drift against a baseline schema -> rules -> describe."""
    src = df
    prof = P.profile(src, table=table)
    current = SC.columns_of(src, table)
    drift = SC.detect_drift(baseline_columns.withColumn("table_name", F.lit(table)), current)
    res = RU.validate_rules(src, rules) if rules else None
    parts = [
        _rows(prof, "profile", "column_name", ["null_count", "distinct_count", "type"]),
        drift.select(F.lit("drift").alias("step"), F.col("name").alias("subject"), F.lit("change").alias("metric"),
                     F.concat_ws(": ", "change", F.array_join("changes", "; ")).alias("value")),
        _rows(current.groupBy("table_name").agg(F.count(F.lit(1)).alias("column_count"),
                                                F.sum(F.col("nullable").cast("int")).alias("nullable_columns")),
              "describe", "table_name", ["column_count", "nullable_columns"]),
    ]
    if res is not None:
        parts.append(_rows(res.withColumn("subject", F.concat_ws(":", F.col("rule_index").cast("string"),
                                                                  "rule_type", "column")),
                           "rules", "subject", ["passed", "failures"]))
    return reduce(DataFrame.unionByName, parts)


def compliance_scan(df: DataFrame, table: str, pii_columns: list[str] | None = None,
                    runs: DataFrame | None = None) -> DataFrame:
    """Sensitive columns (given, or found by ``pii_scan``) are profiled for nulls,
    tagged 'pii' / 'sensitive', linted with descriptions required, and the pipeline named
    after the table gets a health row when a run log is given."""
    src = df
    meta = SC.columns_of(src, table)
    if pii_columns is None:
        flagged = (pii_scan({table: src}).filter(F.col("matches") > 0)
                   .select(F.col("column").alias("name")).distinct())
    else:
        flagged = src.sparkSession.createDataFrame([(c,) for c in pii_columns], "name string")
    nulls = P.null_rates(src).withColumnRenamed("column_name", "name").join(flagged, "name", "left_semi")
    state = meta.select(F.lit("column").alias("entity_type"),
                        F.concat_ws(".", F.lit(table), "name").alias("entity_name"),
                        F.array().cast("array<string>").alias("tags"))
    changes = flagged.select(F.lit("column").alias("entity_type"),
                             F.concat_ws(".", F.lit(table), "name").alias("entity_name"),
                             F.lit("add").alias("action"), F.array(*[F.lit(t) for t in PII_TAGS]).alias("tags"))
    tags = CA.tag_apply(state, changes).filter("changed")
    lint = LT.lint_schema(meta.join(flagged, "name", "left_semi"), naming_case="snake_case",
                          require_descriptions=True)
    parts = [
        _rows(nulls, "profile", "name", ["null_count", "null_rate"]),
        tags.select(F.lit("tag").alias("step"), "entity_name", F.lit("tags").alias("metric"),
                    F.array_join("tags", ",").alias("value")).withColumnRenamed("entity_name", "subject"),
        lint.select(F.lit("lint").alias("step"), F.col("column").alias("subject"), F.col("rule").alias("metric"),
                    F.col("severity").alias("value")),
    ]
    if runs is not None:
        health = RN.pipeline_health(runs.filter(F.col("pipeline") == table),
                                    pipelines=src.sparkSession.createDataFrame([(table,)], "pipeline string"))
        parts.append(_rows(health, "health", "pipeline", ["health", "success_rate"]))
    return reduce(DataFrame.unionByName, parts)
