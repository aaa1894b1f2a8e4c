"""Registered queries: one per operator row, each a function (spark, sf_dir) -> DataFrame,
plus the DuckDB SQL that must return the same rows.

Every query reads whole tables (or views derived from them in ``vigil.sources.derived``);
nothing is subset, sampled or capped except where the cap is the feature (top-k).
"""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigil.operators import profile as P
from vigil.plans import oracle_profile as OP
from vigil.sources import derived as D
from vigil.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return wrap


# Column kinds of the tables the profile queries read (numeric / text / other).
N, T_, O = OP.NUMERIC, OP.TEXT, OP.OTHER
LINEITEM_KINDS = [("l_orderkey", N), ("l_partkey", N), ("l_suppkey", N), ("l_linenumber", N),
                  ("l_quantity", N), ("l_extendedprice", N), ("l_discount", N), ("l_tax", N),
                  ("l_returnflag", T_), ("l_linestatus", T_), ("l_shipdate", O)]
ORDERS_KINDS = [("o_orderkey", N), ("o_custkey", N), ("o_orderstatus", T_), ("o_totalprice", N),
                ("o_orderdate", O), ("o_orderpriority", T_)]
DIRTY_KINDS = [("c_custkey", N), ("c_name", T_), ("c_nationkey", N), ("c_acctbal", N),
               ("c_mktsegment", T_), ("c_nation_text", T_), ("c_version", N)]
PART_KINDS = [("p_partkey", N), ("p_name", T_), ("p_brand", T_), ("p_type", T_), ("p_size", N),
              ("p_retailprice", N)]
SUPPLIER_KINDS = [("s_suppkey", N), ("s_name", T_), ("s_nationkey", N), ("s_acctbal", N)]


def _rendered(df: DataFrame) -> DataFrame:
    return df.withColumn("top_values", P.render_top("top_values"))


# ---------------------------------------------------------------- D0-D9 profile
@register("dq_row_count", "SELECT count(*) AS row_count FROM lineitem")
def q_row_count(spark, sf):
    return P.row_count(load(spark, sf, "lineitem"))


@register("dq_profile", OP.profile_sql("lineitem", "lineitem", LINEITEM_KINDS))
def q_profile(spark, sf):
    return _rendered(P.profile(load(spark, sf, "lineitem"), table="lineitem"))


_ORDERS_COLS = ["o_orderpriority", "o_totalprice", "o_orderdate"]


@register("dq_profile_columns", OP.profile_sql(
    "orders", "orders", [k for c in _ORDERS_COLS for k in ORDERS_KINDS if k[0] == c]))
def q_profile_columns(spark, sf):
    return _rendered(P.profile(load(spark, sf, "orders"), columns=_ORDERS_COLS, table="orders"))


@register("dq_sample_profile")
def q_sample_profile(spark, sf):
    # Rows-only: a random sample has no engine-independent oracle.
    return _rendered(P.profile(load(spark, sf, "orders"), sample_size=1000, table="orders"))


@register("dq_null_rates", D.oracle_with("dirty_customer")
          + OP.null_rates_sql("dirty_customer", [c for c, _ in DIRTY_KINDS]))
def q_null_rates(spark, sf):
    return P.null_rates(D.view(spark, sf, "dirty_customer"))


@register("dq_distinct", OP.distinct_sql("lineitem", [c for c, _ in LINEITEM_KINDS]))
def q_distinct(spark, sf):
    return P.distinct_counts(load(spark, sf, "lineitem"))


@register("dq_numeric_stats", D.oracle_with("dirty_customer")
          + OP.numeric_stats_sql("dirty_customer", DIRTY_KINDS))
def q_numeric_stats(spark, sf):
    return P.numeric_stats(D.view(spark, sf, "dirty_customer"))


@register("dq_top_values", OP.top_values_sql("orders", ORDERS_KINDS))
def q_top_values(spark, sf):
    return P.top_values(load(spark, sf, "orders"))


@register("dq_profile_many", "SELECT * FROM (" + OP.profile_sql("part", "part", PART_KINDS)
          + ") UNION ALL SELECT * FROM (" + OP.profile_sql("supplier", "supplier", SUPPLIER_KINDS) + ")")
def q_profile_many(spark, sf):
    return _rendered(P.profile_many({"part": load(spark, sf, "part"),
                                     "supplier": load(spark, sf, "supplier")}))


# ---------------------------------------------------------------- D10-D13 anomalies
from vigil.operators import anomalies as A  # noqa: E402


@register("dq_metric_baseline", """
SELECT count(*) AS total_points, avg(value) AS mean, stddev_samp(value) AS stddev
FROM events WHERE value IS NOT NULL""")
def q_metric_baseline(spark, sf):
    return A.metric_baseline(load(spark, sf, "events"), "value")


@register("dq_anomalies", """
WITH s AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd, count(*) AS n FROM events WHERE value IS NOT NULL),
z AS (SELECT ts, value, (value - mu) / NULLIF(sd, 0) AS z, n FROM events, s WHERE value IS NOT NULL)
SELECT ts AS "timestamp", value, round(z, 3) AS z_score,
       CASE WHEN abs(z) > 4.5 THEN 'high' ELSE 'medium' END AS severity, n AS total_points
FROM z WHERE abs(z) > 3.0""")
def q_anomalies(spark, sf):
    return A.detect_anomalies(load(spark, sf, "events"), "ts", "value", threshold=3.0)


@register("dq_anomaly_summary", """
WITH s AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM events WHERE value IS NOT NULL),
z AS (SELECT abs((value - mu) / NULLIF(sd, 0)) AS z FROM events, s WHERE value IS NOT NULL)
SELECT count(*) AS total_points, count(*) FILTER (WHERE z > 3.0) AS anomalies,
       count(*) FILTER (WHERE z > 4.5) AS high, count(*) FILTER (WHERE z > 3.0 AND z <= 4.5) AS medium,
       'zscore' AS method, 3.0::DOUBLE AS threshold
FROM z""")
def q_anomaly_summary(spark, sf):
    return A.anomaly_summary(load(spark, sf, "events"), "ts", "value", threshold=3.0)


@register("dq_anomalies_by_series", """
WITH s AS (SELECT event_type, avg(value) AS mu, stddev_samp(value) AS sd, count(*) AS n
           FROM events WHERE value IS NOT NULL GROUP BY event_type),
z AS (SELECT e.event_type, e.ts, e.value, (e.value - s.mu) / NULLIF(s.sd, 0) AS z, s.n
      FROM events e JOIN s ON e.event_type = s.event_type WHERE e.value IS NOT NULL)
SELECT event_type, ts AS "timestamp", value, round(z, 3) AS z_score,
       CASE WHEN abs(z) > 4.5 THEN 'high' ELSE 'medium' END AS severity, n AS total_points
FROM z WHERE abs(z) > 3.0""")
def q_anomalies_by_series(spark, sf):
    return A.detect_anomalies_by_series(load(spark, sf, "events"), "ts", "value", ["event_type"],
                                        threshold=3.0)


# ---------------------------------------------------------------- D14-D20 rules
from vigil.operators import rules as RU  # noqa: E402

SEGMENTS_OK = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
CUSTOM_SQL = "SELECT * FROM {{table}} WHERE c_acctbal < 0 AND c_version = 2"
CUSTOMER_RULES = [
    RU.rule("not_null", "c_mktsegment"),
    RU.rule("not_null", "c_name"),
    RU.rule("unique", "c_custkey"),
    RU.rule("min", "c_acctbal", value=0),
    RU.rule("max", "c_acctbal", value=9000),
    RU.rule("accepted_values", "c_mktsegment", values=SEGMENTS_OK),
    RU.rule("custom_sql", sql=CUSTOM_SQL),
]
_SEG_SQL = ", ".join(f"'{s}'" for s in SEGMENTS_OK)


def _row_rule_sql(i, rtype, col, cond, source="dirty_customer"):
    return (f"SELECT {i} AS rule_index, '{rtype}' AS rule_type, '{col}' AS \"column\","
            f" count(*) FILTER (WHERE {cond}) = 0 AS passed, count(*) FILTER (WHERE {cond}) AS failures,"
            f" CAST(NULL AS VARCHAR) AS error FROM {source}")


_RULE_SQL = [
    _row_rule_sql(0, "not_null", "c_mktsegment", "c_mktsegment IS NULL"),
    _row_rule_sql(1, "not_null", "c_name", "c_name IS NULL"),
    ("SELECT 2 AS rule_index, 'unique' AS rule_type, 'c_custkey' AS \"column\","
     " coalesce(sum(cnt - 1), 0) = 0 AS passed, CAST(coalesce(sum(cnt - 1), 0) AS BIGINT) AS failures,"
     " CAST(NULL AS VARCHAR) AS error FROM (SELECT c_custkey, count(*) AS cnt FROM dirty_customer"
     " WHERE c_custkey IS NOT NULL GROUP BY c_custkey HAVING count(*) > 1)"),
    _row_rule_sql(3, "min", "c_acctbal", "c_acctbal IS NOT NULL AND c_acctbal < 0"),
    _row_rule_sql(4, "max", "c_acctbal", "c_acctbal IS NOT NULL AND c_acctbal > 9000"),
    _row_rule_sql(5, "accepted_values", "c_mktsegment",
                  f"c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ({_SEG_SQL})"),
    ("SELECT 6 AS rule_index, 'custom_sql' AS rule_type, '' AS \"column\", count(*) = 0 AS passed,"
     " count(*) AS failures, CAST(NULL AS VARCHAR) AS error FROM dirty_customer"
     " WHERE c_acctbal < 0 AND c_version = 2"),
]
_DIRTY = D.oracle_with("dirty_customer")


def _rules_query(indices):
    def q(spark, sf):
        return RU.validate_rules(D.view(spark, sf, "dirty_customer"), [CUSTOMER_RULES[i] for i in indices])
    return q


def _rules_sql(indices):
    # rule_index is the position inside the validated list
    parts = []
    for pos, i in enumerate(indices):
        parts.append(f"SELECT {pos} AS rule_index, rule_type, \"column\", passed, failures, error FROM ({_RULE_SQL[i]})")
    return _DIRTY + "\nUNION ALL\n".join(parts)


for _key, _idx in [("dq_rule_not_null", [0, 1]), ("dq_rule_range", [3, 4]),
                   ("dq_rule_accepted", [5]), ("dq_rule_custom_sql", [6]), ("dq_rules_all", list(range(7)))]:
    register(_key, _rules_sql(_idx))(_rules_query(_idx))


@register("dq_rule_unique", """
SELECT 0 AS rule_index, 'unique' AS rule_type, 'l_orderkey,l_linenumber' AS "column",
       coalesce(sum(cnt - 1), 0) = 0 AS passed, CAST(coalesce(sum(cnt - 1), 0) AS BIGINT) AS failures,
       CAST(NULL AS VARCHAR) AS error
FROM (SELECT l_orderkey, l_linenumber, count(*) AS cnt FROM lineitem
      WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
      GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def q_rule_unique(spark, sf):
    return RU.validate_rules(load(spark, sf, "lineitem"), [RU.rule("unique", ["l_orderkey", "l_linenumber"])])


BROKEN_RULES = [RU.rule("not_null", "c_name"),
                RU.rule("custom_sql", sql="SELECT * FROM {{table}} WHERE 1 DIV (c_version - 1) > 0"),
                RU.rule("custom_sql", sql="SELECT * FROM {{table}} WHERE no_such_column = 1"),
                RU.rule("custom_sql", sql="SELECT * FROM {{table}} WHERE c_acctbal < 0")]


# A rule whose SQL fails while reading the data (division by zero) and one that fails to plan each
# give an error row; the rules around them go on.
@register("dq_rules_broken", _DIRTY + """
SELECT 0 AS rule_index, 'not_null' AS rule_type, count(*) = 0 AS passed, count(*) AS failures, false AS has_error
FROM dirty_customer WHERE c_name IS NULL
UNION ALL SELECT 1, 'custom_sql', false, 0, true
UNION ALL SELECT 2, 'custom_sql', false, 0, true
UNION ALL SELECT 3, 'custom_sql', count(*) = 0, count(*), false FROM dirty_customer WHERE c_acctbal < 0""")
def q_rules_broken(spark, sf):
    out = RU.validate_rules(D.view(spark, sf, "dirty_customer"), BROKEN_RULES)
    return out.select("rule_index", "rule_type", "passed", "failures", F.col("error").isNotNull().alias("has_error"))


@register("dq_scorecard", _DIRTY + f"""
, r AS ({_rules_sql(list(range(7))).replace(_DIRTY, '')})
SELECT count(*) AS total_rules, count(*) FILTER (WHERE passed) AS passed,
       count(*) - count(*) FILTER (WHERE passed) AS failed,
       CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE passed) / count(*), 2) ELSE 1.0 END AS pass_rate
FROM r""")
def q_scorecard(spark, sf):
    return RU.scorecard(RU.validate_rules(D.view(spark, sf, "dirty_customer"), CUSTOMER_RULES))


@register("dq_failed_rows", _DIRTY + f"""
SELECT rule_index, rule_type, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT rule_index, rule_type, value, row_number() OVER (PARTITION BY rule_index ORDER BY value) AS rank FROM (
    SELECT 0 AS rule_index, 'not_null' AS rule_type, coalesce(CAST(c_mktsegment AS VARCHAR), 'NULL') AS value
      FROM dirty_customer WHERE c_mktsegment IS NULL
    UNION ALL SELECT 1, 'not_null', coalesce(CAST(c_name AS VARCHAR), 'NULL') FROM dirty_customer WHERE c_name IS NULL
    UNION ALL SELECT 2, 'unique', CAST(c_custkey AS VARCHAR) FROM dirty_customer
      WHERE c_custkey IS NOT NULL GROUP BY c_custkey HAVING count(*) > 1
    UNION ALL SELECT 3, 'min', CAST(c_acctbal AS VARCHAR) FROM dirty_customer WHERE c_acctbal < 0
    UNION ALL SELECT 4, 'max', CAST(c_acctbal AS VARCHAR) FROM dirty_customer WHERE c_acctbal > 9000
    UNION ALL SELECT 5, 'accepted_values', CAST(c_mktsegment AS VARCHAR) FROM dirty_customer
      WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ({_SEG_SQL})
  ) u
) x WHERE rank <= 5""")
def q_failed_rows(spark, sf):
    return RU.failed_rows(D.view(spark, sf, "dirty_customer"), CUSTOMER_RULES)


# ---------------------------------------------------------------- O1-O11 runs, alerts, cost
from vigil.operators import cost as CO  # noqa: E402
from vigil.operators import runs as RN  # noqa: E402

AS_OF = "2024-01-31 00:00:00"
HOURS = 168
_RUNS = D.oracle_with("runs")
_ALERTS = D.oracle_with("alerts")
_RUNS_ALERTS = D.oracle_with("runs", "alerts")
_LAST20 = """r AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY ts DESC, run_id DESC) AS recency
           FROM runs)"""
_STATS_SQL = """SELECT pipeline, count(*) AS runs_counted,
       round(count(*) FILTER (WHERE status = 'success') / count(*), 2) AS success_rate,
       round(avg(duration_min), 1) AS avg_duration_min,
       max(CASE WHEN recency = 1 THEN status END) AS last_status, max(ts) AS last_run
FROM r WHERE recency <= 20 GROUP BY pipeline"""


@register("run_stats", _RUNS + ", " + _LAST20 + "\n" + _STATS_SQL)
def q_run_stats(spark, sf):
    return RN.run_stats(D.view(spark, sf, "runs"))


@register("run_health", _RUNS_ALERTS + ", " + _LAST20 + f""",
s AS ({_STATS_SQL}),
r10 AS (SELECT pipeline, count(*) AS recent_runs FROM r WHERE recency <= 10 GROUP BY pipeline),
a AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY ts DESC, alert_id DESC) AS rr FROM alerts),
a10 AS (SELECT pipeline, count(*) FILTER (WHERE NOT acknowledged) AS active_alerts FROM a WHERE rr <= 10 GROUP BY pipeline)
SELECT s.pipeline,
       CASE WHEN s.success_rate >= 0.95 THEN 'healthy' WHEN s.success_rate >= 0.80 THEN 'degraded' ELSE 'unhealthy' END AS health,
       s.last_status AS status, s.success_rate, s.avg_duration_min, s.last_run,
       coalesce(r10.recent_runs, 0) AS recent_runs, coalesce(a10.active_alerts, 0) AS active_alerts
FROM s LEFT JOIN r10 ON s.pipeline = r10.pipeline LEFT JOIN a10 ON s.pipeline = a10.pipeline""")
def q_pipeline_health(spark, sf):
    return RN.pipeline_health(D.view(spark, sf, "runs"), D.view(spark, sf, "alerts"))


@register("recent_runs", _RUNS + ", " + _LAST20 + """
SELECT pipeline, CAST(count(*) OVER (PARTITION BY pipeline) - recency + 1 AS INTEGER) AS pos,
       run_id, status, duration_min, ts
FROM r WHERE recency <= 5""")
def q_recent_runs(spark, sf):
    return RN.recent_runs(D.view(spark, sf, "runs"))


_ALERT_WIN = (f"ts > TIMESTAMP '{AS_OF}' - INTERVAL {HOURS} HOUR AND ts <= TIMESTAMP '{AS_OF}'")


@register("alert_summary", _ALERTS + f"""
SELECT {HOURS} AS time_window_hours, count(*) AS total_alerts,
       count(*) FILTER (WHERE severity = 'critical') AS critical,
       count(*) FILTER (WHERE severity = 'warning') AS warning,
       count(*) FILTER (WHERE severity = 'info') AS info,
       count(DISTINCT pipeline) AS pipelines_affected,
       count(*) FILTER (WHERE NOT acknowledged) AS unacknowledged_count,
       coalesce(string_agg(DISTINCT pipeline, ',' ORDER BY pipeline), '') AS pipelines
FROM alerts WHERE {_ALERT_WIN}""")
def q_alert_summary(spark, sf):
    return RN.alert_summary(D.view(spark, sf, "alerts"), AS_OF, HOURS).withColumn("pipelines", F.array_join("pipelines", ","))


@register("top_alerts", _ALERTS + f"""
SELECT alert_id, pipeline, severity, substring(message, 1, 60) AS message, ts
FROM alerts WHERE {_ALERT_WIN}
ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, ts, alert_id LIMIT 5""")
def q_top_alerts(spark, sf):
    return RN.top_alerts(D.view(spark, sf, "alerts"), AS_OF, HOURS)


@register("alert_windows", _ALERTS + """
SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start,
       time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, severity, count(*) AS n
FROM alerts GROUP BY 1, 2, 3""")
def q_alert_windows(spark, sf):
    return RN.alert_windows(D.view(spark, sf, "alerts"), "1 day")


# condition and finding of each category; the other texts are RN.ADVICE
_SUGGEST = [
    ("performance", "avg_duration > 30", "'Pipeline averages ' || CAST(avg_duration AS VARCHAR) || 'min runtime'"),
    ("reliability", "success_rate < 0.9", "'Success rate is ' || CAST(CAST(round(success_rate * 100) AS BIGINT) AS VARCHAR) || '%'"),
    ("efficiency", "avg_rows > 10000000",
     "'Pipeline processes ' || format('{:,}', CAST(round(avg_rows) AS BIGINT)) || ' rows on average'"),
    ("monitoring", "avg_rows = 0", "'Row count not being tracked'"),
    ("consistency", "n >= 5 AND max_d > min_d * 3",
     "'Runtime varies from ' || CAST(CAST(round(min_d) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(round(max_d) AS BIGINT) AS VARCHAR)"
     " || 'min (' || CASE WHEN min_d = 0 THEN 'inf' ELSE CAST(CAST(round(max_d / min_d) AS BIGINT) AS VARCHAR) END || 'x)'"),
]


def _advice(category):
    severity, suggestion, impact = RN.ADVICE[category]
    return f"'{category}' AS category, '{severity}' AS severity, '{suggestion}' AS suggestion, '{impact}' AS estimated_impact"


@register("suggest_optimizations", _RUNS + ", " + _LAST20 + """,
s AS (SELECT pipeline, count(*) AS n, round(avg(duration_min), 1) AS avg_duration,
             round(count(*) FILTER (WHERE status = 'success') / count(*), 2) AS success_rate,
             avg(coalesce(rows_processed, 0)) AS avg_rows, min(duration_min) AS min_d, max(duration_min) AS max_d
      FROM r WHERE recency <= 20 GROUP BY pipeline),
f AS (""" + "\nUNION ALL\n".join(
    f"SELECT pipeline, {_advice(c)}, {text} AS finding FROM s WHERE {cond}" for c, cond, text in _SUGGEST) + f""")
SELECT * FROM f
UNION ALL
SELECT pipeline, {_advice('info')}, 'No optimizations identified' AS finding FROM s WHERE pipeline NOT IN (SELECT pipeline FROM f)""")
def q_suggest(spark, sf):
    return RN.suggest_optimizations(D.view(spark, sf, "runs"))


_COSTS = D.oracle_with("costs")


@register("cost_by_provider", _COSTS + """
SELECT provider, compute, storage, total, CAST(round(total / (SELECT sum(total) FROM costs), 4) AS DOUBLE) AS share
FROM costs""")
def q_cost_by_provider(spark, sf):
    return CO.cost_by_provider(D.view(spark, sf, "costs"))


@register("cost_summary", _COSTS + """
SELECT sum(total) AS monthly_total,
       (SELECT provider FROM costs ORDER BY total DESC, provider DESC LIMIT 1) AS top_provider,
       count(*) AS providers
FROM costs""")
def q_cost_summary(spark, sf):
    return CO.cost_summary(D.view(spark, sf, "costs"))


@register("cost_recommendations", _COSTS + """,
t AS (SELECT provider, compute, storage FROM costs ORDER BY total DESC, provider DESC LIMIT 1),
a AS (SELECT sum(compute) AS c, sum(storage) AS s FROM costs),
rec AS (
SELECT 'compute_optimization' AS area, CAST(round(t.compute * 0.15, 0) AS BIGINT) AS potential_savings,
       t.provider || ': Consider auto-scaling or spot instances for non-production workloads' AS suggestion
FROM t WHERE t.compute > t.storage * 3
UNION ALL
SELECT 'warehouse_sizing', CAST(round(c * 0.10, 0) AS BIGINT),
       'Review warehouse sizing: consider multi-cluster warehouses for concurrent workloads' FROM a WHERE c > 10000
UNION ALL
SELECT 'storage_optimization', CAST(round(s * 0.20, 0) AS BIGINT),
       'Implement data lifecycle policy: auto-archive data not accessed in 90+ days' FROM a WHERE s > 2000)
SELECT *, CAST((SELECT sum(potential_savings) FROM rec) AS BIGINT) AS total_potential_savings FROM rec""")
def q_cost_recommendations(spark, sf):
    return CO.cost_recommendations(D.view(spark, sf, "costs"))


# ---------------------------------------------------------------- S1-S8 schema drift / migration
from vigil.operators import catalog as CA  # noqa: E402
from vigil.operators import lineage as LI  # noqa: E402
from vigil.operators import lint as LT  # noqa: E402
from vigil.operators import schema as SC  # noqa: E402

_COLS = D.oracle_with("source_columns", "target_columns")
_DRIFT_SQL = """SELECT coalesce(s.table_name, t.table_name) AS table_name, coalesce(s.name, t.name) AS name,
  CASE WHEN s.name IS NULL THEN 'added' WHEN t.name IS NULL THEN 'removed' ELSE 'modified' END AS change,
  CASE WHEN s.name IS NOT NULL AND t.name IS NOT NULL THEN concat_ws('; ',
     CASE WHEN s.type IS DISTINCT FROM t.type
          THEN 'type: ' || coalesce(s.type, 'None') || ' -> ' || coalesce(t.type, 'None') END,
     CASE WHEN coalesce(s.nullable, true) <> coalesce(t.nullable, true)
          THEN 'nullable: ' || CASE WHEN coalesce(s.nullable, true) THEN 'True' ELSE 'False' END || ' -> '
               || CASE WHEN coalesce(t.nullable, true) THEN 'True' ELSE 'False' END END)
  ELSE '' END AS changes
FROM source_columns s FULL OUTER JOIN target_columns t ON s.table_name = t.table_name AND s.name = t.name
WHERE s.name IS NULL OR t.name IS NULL OR s.type IS DISTINCT FROM t.type
   OR coalesce(s.nullable, true) <> coalesce(t.nullable, true)"""


def _drift(spark, sf):
    return SC.detect_drift(D.view(spark, sf, "source_columns"), D.view(spark, sf, "target_columns"))


@register("schema_drift", _COLS + _DRIFT_SQL)
def q_schema_drift(spark, sf):
    return _drift(spark, sf).withColumn("changes", F.array_join("changes", "; "))


@register("schema_drift_modified", _COLS + f"SELECT * FROM ({_DRIFT_SQL}) d WHERE change = 'modified'")
def q_schema_drift_modified(spark, sf):
    return q_schema_drift(spark, sf).filter(F.col("change") == "modified")


@register("drift_summary", _COLS + f""", d AS ({_DRIFT_SQL}),
ns AS (SELECT table_name, count(*) AS total_source FROM source_columns GROUP BY table_name),
nt AS (SELECT table_name, count(*) AS total_target FROM target_columns GROUP BY table_name),
dd AS (SELECT table_name, count(*) FILTER (WHERE change = 'added') AS added,
              count(*) FILTER (WHERE change = 'removed') AS removed,
              count(*) FILTER (WHERE change = 'modified') AS modified FROM d GROUP BY table_name)
SELECT coalesce(ns.table_name, nt.table_name) AS table_name, coalesce(total_source, 0) AS total_source,
       coalesce(total_target, 0) AS total_target, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed,
       coalesce(modified, 0) AS modified,
       coalesce(added, 0) + coalesce(removed, 0) + coalesce(modified, 0) > 0 AS has_drift
FROM ns FULL OUTER JOIN nt ON ns.table_name = nt.table_name
LEFT JOIN dd ON dd.table_name = coalesce(ns.table_name, nt.table_name)""")
def q_drift_summary(spark, sf):
    return SC.drift_summary(D.view(spark, sf, "source_columns"), D.view(spark, sf, "target_columns"))


_SPLIT = D.PERIOD_SPLIT


@register("json_key_drift", D.oracle_with("events_v2") + f""",
kv AS (SELECT CASE WHEN ts < TIMESTAMP '{_SPLIT}' THEN 'before' ELSE 'after' END AS period, k AS key,
              json_type(props, '$.' || k) AS jt
       FROM (SELECT ts, props, unnest(json_keys(props)) AS k FROM events_v2)),
ty AS (SELECT period, key, array_to_string(list_sort(list_distinct(list(
          CASE WHEN jt IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN jt = 'VARCHAR' THEN 'string'
               WHEN jt = 'BOOLEAN' THEN 'boolean' WHEN jt = 'NULL' THEN 'null' WHEN jt = 'OBJECT' THEN 'object'
               WHEN jt = 'ARRAY' THEN 'array' ELSE 'other' END))), '|') AS types
       FROM kv GROUP BY period, key),
j AS (SELECT coalesce(b.key, a.key) AS key, b.types AS types_before, a.types AS types_after
      FROM (SELECT * FROM ty WHERE period = 'before') b FULL OUTER JOIN (SELECT * FROM ty WHERE period = 'after') a
      ON b.key = a.key)
SELECT key, types_before, types_after,
       CASE WHEN types_before IS NULL THEN 'added' WHEN types_after IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM j WHERE types_before IS NULL OR types_after IS NULL OR types_before <> types_after""")
def q_json_key_drift(spark, sf):
    ev = D.view(spark, sf, "events_v2")
    period = F.when(F.col("ts") < F.lit(_SPLIT).cast("timestamp_ntz"), "before").otherwise("after")
    return SC.json_key_drift(ev, "props", period)


def _qid(x):
    return f"'`' || replace({x}, '`', '``') || '`'"


@register("migration_plan", _COLS + f""",
src_t AS (SELECT DISTINCT table_name FROM source_columns),
j AS (SELECT coalesce(s.table_name, t.table_name) AS table_name, coalesce(s.name, t.name) AS name,
             s.name IS NOT NULL AS has_s, t.name IS NOT NULL AS has_t, s.type AS s_type, t.type AS t_type,
             coalesce(s.nullable, true) AS s_null, coalesce(t.nullable, true) AS t_null,
             s.position AS s_pos, t.position AS t_pos
      FROM source_columns s FULL OUTER JOIN target_columns t ON s.table_name = t.table_name AND s.name = t.name),
st AS (
  SELECT table_name, name, 1 AS phase, s_pos AS pos, 0 AS sub, 'drop' AS kind,
         'ALTER TABLE ' || {_qid('table_name')} || ' DROP COLUMN IF EXISTS ' || {_qid('name')} || ';' AS statement
  FROM j WHERE NOT has_t AND table_name IN (SELECT table_name FROM src_t)
  UNION ALL
  SELECT table_name, name, 2, t_pos, 0, 'add', 'ALTER TABLE ' || {_qid('table_name')} || ' ADD COLUMN ' || {_qid('name')}
         || ' ' || t_type || CASE WHEN t_null THEN '' ELSE ' NOT NULL' END || ';'
  FROM j WHERE NOT has_s AND table_name IN (SELECT table_name FROM src_t)
  UNION ALL
  SELECT table_name, name, 3, s_pos, 0, 'alter_type', 'ALTER TABLE ' || {_qid('table_name')} || ' ALTER COLUMN '
         || {_qid('name')} || ' TYPE ' || t_type || ';'
  FROM j WHERE has_s AND has_t AND s_type IS DISTINCT FROM t_type
  UNION ALL
  SELECT table_name, name, 3, s_pos, 1, CASE WHEN t_null THEN 'drop_not_null' ELSE 'set_not_null' END,
         'ALTER TABLE ' || {_qid('table_name')} || ' ALTER COLUMN ' || {_qid('name')}
         || CASE WHEN t_null THEN ' DROP NOT NULL;' ELSE ' SET NOT NULL;' END
  FROM j WHERE has_s AND has_t AND s_null <> t_null
  UNION ALL
  SELECT table_name, '', 0, 0, 0, 'create', 'CREATE TABLE ' || {_qid('table_name')} || ' ('
         || string_agg({_qid('name')} || ' ' || type || CASE WHEN coalesce(nullable, true) THEN '' ELSE ' NOT NULL' END,
                       ', ' ORDER BY position, name) || ');'
  FROM target_columns WHERE table_name NOT IN (SELECT table_name FROM src_t) GROUP BY table_name)
SELECT table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY phase, pos, name, sub) AS INTEGER) AS seq,
       kind, statement FROM st""")
def q_migration_plan(spark, sf):
    return SC.migration_plan(D.view(spark, sf, "source_columns"), D.view(spark, sf, "target_columns"))


CONFORM_TARGET = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nation_text", "int"),
                  ("c_acctbal", "decimal(12,2)"), ("c_mktsegment", "string", False), ("c_comment", "string")]


@register("migration_conform", _DIRTY + """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, TRY_CAST(c_nation_text AS INTEGER) AS c_nation_text,
       TRY_CAST(c_acctbal AS DECIMAL(12,2)) AS c_acctbal, c_mktsegment, CAST(NULL AS VARCHAR) AS c_comment
FROM dirty_customer""")
def q_migration_conform(spark, sf):
    return SC.conform(D.view(spark, sf, "dirty_customer"), CONFORM_TARGET)


@register("migration_safety", _DIRTY + """
SELECT 'c_nation_text' AS "column", 'cast' AS change,
       count(*) FILTER (WHERE c_nation_text IS NOT NULL AND TRY_CAST(c_nation_text AS INTEGER) IS NULL) AS rows_affected
FROM dirty_customer
UNION ALL SELECT 'c_acctbal', 'cast', count(*) FILTER (WHERE c_acctbal IS NOT NULL
       AND TRY_CAST(c_acctbal AS DECIMAL(12,2)) IS NULL) FROM dirty_customer
UNION ALL SELECT 'c_mktsegment', 'set_not_null', count(*) FILTER (WHERE c_mktsegment IS NULL) FROM dirty_customer
UNION ALL SELECT 'c_nationkey', 'drop', count(c_nationkey) FROM dirty_customer
UNION ALL SELECT 'c_version', 'drop', count(c_version) FROM dirty_customer""")
def q_migration_safety(spark, sf):
    return SC.migration_safety(D.view(spark, sf, "dirty_customer"), CONFORM_TARGET)


# ---------------------------------------------------------------- S9-S16 lint
_ALL_COLUMNS = D.oracle_with("all_columns")
_LINT_SQL = """SELECT table_name, name AS "column", 'warning' AS severity, 'naming_case' AS rule,
       'Column ''' || name || ''' should use snake_case' AS message FROM all_columns WHERE name <> lower(name)
UNION ALL SELECT table_name, name, 'error', 'no_spaces', 'Column ''' || name || ''' contains spaces'
  FROM all_columns WHERE contains(name, ' ')
UNION ALL SELECT table_name, name, 'info', 'missing_description', 'Column ''' || name || ''' is missing a description'
  FROM all_columns WHERE coalesce(description, '') = ''
UNION ALL SELECT table_name, name, 'warning', 'nullable_column', 'Column ''' || name || ''' is nullable but should be NOT NULL'
  FROM all_columns WHERE coalesce(nullable, true)
UNION ALL SELECT table_name, name, 'warning', 'id_type', 'Column ''' || name || ''' looks like an ID but is ' || coalesce(type, '')
  FROM all_columns WHERE upper(coalesce(type, '')) IN ('TEXT', 'VARCHAR', 'STRING') AND contains(lower(name), 'id')"""


def _lint(spark, sf):
    return LT.lint_schema(D.view(spark, sf, "all_columns"), naming_case="snake_case",
                          require_descriptions=True, require_not_null=True)


@register("lint_schema", _ALL_COLUMNS + _LINT_SQL)
def q_lint_schema(spark, sf):
    return _lint(spark, sf)


@register("lint_summary", _ALL_COLUMNS + f""", i AS ({_LINT_SQL}),
c AS (SELECT table_name, count(*) AS columns_checked FROM all_columns GROUP BY table_name),
n AS (SELECT table_name, count(*) AS issue_count FROM i GROUP BY table_name)
SELECT c.table_name, c.columns_checked, coalesce(n.issue_count, 0) AS issue_count,
       coalesce(n.issue_count, 0) > 0 AS has_issues
FROM c LEFT JOIN n ON c.table_name = n.table_name""")
def q_lint_summary(spark, sf):
    return LT.lint_summary(D.view(spark, sf, "all_columns"), _lint(spark, sf))


@register("lint_camel_case", _ALL_COLUMNS + """
SELECT table_name, name AS "column", 'warning' AS severity, 'naming_case' AS rule,
       'Column ''' || name || ''' should use camelCase' AS message FROM all_columns WHERE contains(name, '_')
UNION ALL SELECT table_name, name, 'warning', 'id_type', 'Column ''' || name || ''' looks like an ID but is ' || type
  FROM all_columns WHERE upper(type) IN ('TEXT', 'VARCHAR', 'STRING') AND contains(lower(name), 'id')""")
def q_lint_camel_case(spark, sf):
    return LT.lint_schema(D.view(spark, sf, "all_columns"), naming_case="camelCase")


@register("lint_numeric_text", D.oracle_with("event_keys") + """
SELECT CAST(NULL AS VARCHAR) AS table_name, 'key_text' AS "column", 'warning' AS severity, 'numeric_text' AS rule,
       'Column ''key_text'' is text but every value is a number' AS message
FROM event_keys HAVING count(key_text) > 0 AND count(TRY_CAST(key_text AS DOUBLE)) = count(key_text)""")
def q_lint_numeric_text(spark, sf):
    return LT.lint_with_data(D.view(spark, sf, "event_keys"))


# Spark's schema of the view marks c_version (a literal) NOT NULL; every other column is nullable.
_NULLABLE_DIRTY = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "c_nation_text"]


@register("lint_with_data", _DIRTY + "\nUNION ALL\n".join(
    f"SELECT CAST(NULL AS VARCHAR) AS table_name, '{c}' AS \"column\", 'info' AS severity, 'never_null' AS rule,"
    f" 'Column ''{c}'' is nullable but holds no NULL' AS message FROM dirty_customer"
    f" HAVING count(*) > 0 AND count(*) FILTER (WHERE \"{c}\" IS NULL) = 0" for c in _NULLABLE_DIRTY))
def q_lint_with_data(spark, sf):
    return LT.lint_with_data(D.view(spark, sf, "dirty_customer"))


# ---------------------------------------------------------------- S17-S19 lineage
_LIN = D.oracle_with("lineage_edges")


@register("lineage_upstream", _LIN + """
SELECT DISTINCT target_table AS "table", target_column AS "column", source_table || '.' || source_column AS source,
       coalesce(transform, 'direct') AS transform FROM lineage_edges""")
def q_lineage_upstream(spark, sf):
    return LI.lineage_upstream(D.view(spark, sf, "lineage_edges"))


@register("lineage_downstream", _LIN + """
SELECT DISTINCT source_table AS "table", source_column AS "column", target_table || '.' || target_column AS target,
       coalesce(transform, 'direct') AS transform FROM lineage_edges""")
def q_lineage_downstream(spark, sf):
    return LI.lineage_downstream(D.view(spark, sf, "lineage_edges"))


@register("lineage_closure", _LIN.replace("WITH ", "WITH RECURSIVE ", 1) + """,
c(st, sc, tt, tc, hops) AS (
  SELECT DISTINCT source_table, source_column, target_table, target_column, 1 FROM lineage_edges
  UNION
  SELECT c.st, c.sc, e.target_table, e.target_column, c.hops + 1
  FROM c JOIN lineage_edges e ON c.tt = e.source_table AND c.tc = e.source_column)
SELECT st AS source_table, sc AS source_column, tt AS target_table, tc AS target_column, min(hops) AS hops
FROM c GROUP BY st, sc, tt, tc""")
def q_lineage_closure(spark, sf):
    return LI.lineage_closure(D.view(spark, sf, "lineage_edges"))


# ---------------------------------------------------------------- C1-C7 catalog
_CAT = D.oracle_with("catalog_tables", "all_columns", "usage_edges", "upstream_edges", "dataset_queries")


@register("catalog_sync", _ALL_COLUMNS + """
SELECT table_name, 'Imported from public.' || table_name AS description, count(*) AS column_count,
       count(*) FILTER (WHERE coalesce(nullable, true)) AS nullable_columns
FROM all_columns GROUP BY table_name""")
def q_catalog_sync(spark, sf):
    return CA.catalog_sync(D.view(spark, sf, "all_columns"))


@register("catalog_sync_totals", _ALL_COLUMNS + """
SELECT count(*) AS tables_added, CAST(sum(n) AS BIGINT) AS columns_added
FROM (SELECT table_name, count(*) AS n FROM all_columns GROUP BY table_name)""")
def q_catalog_sync_totals(spark, sf):
    return CA.sync_totals(CA.catalog_sync(D.view(spark, sf, "all_columns")))


SEARCH = "purchase"


@register("catalog_search", _CAT + f"""
SELECT 'table' AS kind, table_name, CAST(NULL AS VARCHAR) AS column_name, table_name AS name, description
FROM catalog_tables WHERE contains(lower(table_name), '{SEARCH}') OR contains(lower(coalesce(description, '')), '{SEARCH}')
UNION ALL
SELECT 'column', table_name, name, name, description FROM all_columns
WHERE contains(lower(name), '{SEARCH}') OR contains(lower(coalesce(description, '')), '{SEARCH}')
UNION ALL
SELECT 'tag', NULL, NULL, tag, CAST(count(DISTINCT table_name) AS VARCHAR) || ' tables'
FROM (SELECT table_name, unnest(tags) AS tag FROM catalog_tables) WHERE contains(lower(tag), '{SEARCH}') GROUP BY tag""")
def q_catalog_search(spark, sf):
    return CA.catalog_search(D.view(spark, sf, "catalog_tables"), D.view(spark, sf, "all_columns"), SEARCH)


@register("tag_counts", D.oracle_with("catalog_tables") + """
SELECT tag, count(DISTINCT table_name) AS table_count
FROM (SELECT table_name, unnest(tags) AS tag FROM catalog_tables) GROUP BY tag""")
def q_tag_counts(spark, sf):
    return CA.tag_counts(D.view(spark, sf, "catalog_tables"))


CONTENT_QUERY = "data"
_CONTENT_SOURCES = [("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("benchmark", "item_id", "text"), ("conversations", "conv_id", "text")]


def _content(spark, sf):
    return CA.content_search({n: (load(spark, sf, n), i, t) for n, i, t in _CONTENT_SOURCES}, CONTENT_QUERY)


_CONTENT_SQL = "\nUNION ALL\n".join(
    f"SELECT '{n}' AS source, CAST({i} AS BIGINT) AS row_id,"
    f" CAST((length(lower({t})) - length(replace(lower({t}), '{CONTENT_QUERY}', ''))) / {len(CONTENT_QUERY)} AS BIGINT)"
    f" AS occurrences FROM {n} WHERE contains(lower({t}), '{CONTENT_QUERY}')" for n, i, t in _CONTENT_SOURCES)


@register("content_search", _CONTENT_SQL)
def q_content_search(spark, sf):
    return _content(spark, sf)


@register("content_hits", f"""SELECT source, count(*) AS rows, CAST(sum(occurrences) AS BIGINT) AS occurrences
FROM ({_CONTENT_SQL}) GROUP BY source""")
def q_content_hits(spark, sf):
    return CA.content_hits(_content(spark, sf))


@register("catalog_describe", _CAT + """,
nc AS (SELECT table_name, count(*) AS column_count FROM all_columns GROUP BY table_name),
u AS (SELECT table_name, count(DISTINCT pipeline) AS downstream_pipelines, count(DISTINCT column_name) AS columns_read
      FROM usage_edges GROUP BY table_name),
up AS (SELECT table_name, string_agg(DISTINCT source, ',' ORDER BY source) AS upstream_sources FROM upstream_edges GROUP BY table_name),
q AS (SELECT table_name, count(*) AS query_count FROM dataset_queries GROUP BY table_name)
SELECT t.table_name, t.description, coalesce(array_to_string(t.tags, ','), '') AS tags,
       coalesce(nc.column_count, 0) AS column_count, coalesce(u.downstream_pipelines, 0) AS downstream_pipelines,
       coalesce(u.columns_read, 0) AS columns_read, coalesce(upstream_sources, '') AS upstream_sources,
       coalesce(query_count, 0) AS query_count
FROM catalog_tables t LEFT JOIN nc ON t.table_name = nc.table_name LEFT JOIN u ON t.table_name = u.table_name
LEFT JOIN up ON t.table_name = up.table_name LEFT JOIN q ON t.table_name = q.table_name""")
def q_catalog_describe(spark, sf):
    v = lambda name: D.view(spark, sf, name)
    out = CA.catalog_describe(v("catalog_tables"), v("all_columns"), v("usage_edges"), v("upstream_edges"), v("dataset_queries"))
    return (out.withColumn("tags", F.coalesce(F.array_join("tags", ","), F.lit("")))
               .withColumn("upstream_sources", F.array_join("upstream_sources", ",")))


def _changes(spark, sf):
    d = _drift(spark, sf)
    return d.select("table_name", F.col("name").alias("column"),
                    F.when(F.col("change") == "removed", "drop").when(F.col("change") == "modified", "modify")
                     .otherwise("add").alias("change_type"))


_IMPACT_SQL = f"""d AS ({_DRIFT_SQL}),
ch AS (SELECT table_name, name AS "column",
              CASE change WHEN 'removed' THEN 'drop' WHEN 'modified' THEN 'modify' ELSE 'add' END AS change_type FROM d),
k AS (SELECT u.table_name, u.column_name AS "column", count(DISTINCT u.pipeline) AS n,
             string_agg(DISTINCT u.pipeline, ',' ORDER BY u.pipeline) AS pipelines
      FROM usage_edges u GROUP BY u.table_name, u.column_name),
im AS (SELECT ch.table_name, ch."column", ch.change_type,
       CASE WHEN change_type = 'drop' THEN 'high' WHEN change_type IN ('rename', 'modify') THEN 'medium' ELSE 'low' END AS severity,
       coalesce(k.n, 0) AS affected_pipelines,
       CASE change_type
         WHEN 'drop' THEN 'Remove all references to ' || ch."column" || ' before dropping. Affects '
                          || CAST(coalesce(k.n, 0) AS VARCHAR) || ' pipeline(s).'
         WHEN 'modify' THEN 'Verify type compatibility for ' || ch."column" || ' across '
                          || CAST(coalesce(k.n, 0) AS VARCHAR) || ' downstream pipeline(s).'
         ELSE '' END AS recommendation, coalesce(k.pipelines, '') AS pipelines
FROM ch LEFT JOIN k ON ch.table_name = k.table_name AND ch."column" = k."column")"""
_IMPACT_PREFIX = D.oracle_with("source_columns", "target_columns", "usage_edges")


@register("impact_analysis", _IMPACT_PREFIX + ", " + _IMPACT_SQL + "\nSELECT * FROM im")
def q_impact_analysis(spark, sf):
    return CA.impact_analysis(_changes(spark, sf), D.view(spark, sf, "usage_edges")).withColumn(
        "pipelines", F.array_join("pipelines", ","))


@register("impact_summary", _IMPACT_PREFIX + ", " + _IMPACT_SQL + """
SELECT table_name, count(*) AS total_impacts, count(*) FILTER (WHERE severity = 'high') AS high_severity,
       count(*) FILTER (WHERE severity = 'medium') AS medium_severity,
       count(*) FILTER (WHERE severity = 'low') AS low_severity
FROM im GROUP BY table_name""")
def q_impact_summary(spark, sf):
    return CA.impact_summary(q_impact_analysis(spark, sf))


@register("tag_apply", D.oracle_with("doc_tags", "tag_changes") + """,
ch AS (SELECT entity_type, entity_name, action, unnest(tags) AS tag FROM tag_changes),
per AS (SELECT entity_type, entity_name,
               list(DISTINCT tag) FILTER (WHERE action = 'add') AS adds,
               list(DISTINCT tag) FILTER (WHERE action = 'remove') AS removes,
               list(DISTINCT tag) FILTER (WHERE action = 'set') AS sets,
               max(CASE WHEN action = 'set' THEN 1 ELSE 0 END) AS has_set
        FROM ch GROUP BY entity_type, entity_name),
j AS (SELECT coalesce(s.entity_type, p.entity_type) AS entity_type, coalesce(s.entity_name, p.entity_name) AS entity_name,
             CASE WHEN p.has_set = 1 THEN p.sets ELSE coalesce(s.tags, []) END AS base,
             coalesce(p.adds, []) AS adds, coalesce(p.removes, []) AS removes, p.has_set IS NOT NULL AS changed
      FROM doc_tags s FULL OUTER JOIN per p ON s.entity_type = p.entity_type AND s.entity_name = p.entity_name)
SELECT entity_type, entity_name,
       array_to_string(list_sort(list_distinct(list_filter(list_concat(base, adds),
                                                lambda x: NOT list_contains(removes, x)))), ',') AS tags,
       changed
FROM j""")
def q_tag_apply(spark, sf):
    out = CA.tag_apply(D.view(spark, sf, "doc_tags"), D.view(spark, sf, "tag_changes"))
    return out.withColumn("tags", F.array_join("tags", ","))


# ---------------------------------------------------------------- G1-G7 dependency graph
from vigil.operators import backfill as BF  # noqa: E402
from vigil.operators import cleaning as CL  # noqa: E402
from vigil.operators import graph as GR  # noqa: E402

_GRAPH = D.oracle_with("tasks", "task_edges")
_FAULTY = D.oracle_with("tasks", "task_edges_faulty")


@register("deps_missing", _FAULTY + """
SELECT DISTINCT e.dag_id, e.child, e.parent FROM task_edges_faulty e
WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.dag_id = e.dag_id AND t.task_id = e.parent)""")
def q_deps_missing(spark, sf):
    return GR.missing_parents(D.view(spark, sf, "tasks"), D.view(spark, sf, "task_edges_faulty"))


# every task that reaches itself, with the smallest task it shares a cycle with
_REACH = _FAULTY.replace("WITH ", "WITH RECURSIVE ", 1) + """,
e AS (SELECT DISTINCT dag_id, child, parent FROM task_edges_faulty
      WHERE (dag_id, parent) IN (SELECT dag_id, task_id FROM tasks) AND (dag_id, child) IN (SELECT dag_id, task_id FROM tasks)),
reach(dag_id, a, b) AS (SELECT dag_id, parent, child FROM e
                        UNION SELECT r.dag_id, r.a, e.child FROM reach r JOIN e ON r.dag_id = e.dag_id AND r.b = e.parent)"""


@register("deps_cycles", _REACH + """
SELECT x.dag_id, min(x.b) AS cycle, x.a AS task_id
FROM reach x JOIN reach y ON x.dag_id = y.dag_id AND x.a = y.b AND x.b = y.a GROUP BY x.dag_id, x.a""")
def q_deps_cycles(spark, sf):
    return GR.cycle_members(D.view(spark, sf, "tasks"), D.view(spark, sf, "task_edges_faulty"))


@register("deps_blocked", _FAULTY.replace("WITH ", "WITH RECURSIVE ", 1) + """,
e AS (SELECT DISTINCT dag_id, child, parent FROM task_edges_faulty),
reach(dag_id, a, b) AS (SELECT dag_id, parent, child FROM e
                        UNION SELECT r.dag_id, r.a, e.child FROM reach r JOIN e ON r.dag_id = e.dag_id AND r.b = e.parent),
cyc AS (SELECT dag_id, a AS task_id FROM reach WHERE a = b),
miss AS (SELECT e.dag_id, e.child AS task_id FROM e
         WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.dag_id = e.dag_id AND t.task_id = e.parent)),
bad0 AS (SELECT * FROM cyc UNION SELECT * FROM miss)
SELECT dag_id, task_id FROM bad0
UNION
SELECT r.dag_id, r.b FROM reach r JOIN bad0 ON r.dag_id = bad0.dag_id AND r.a = bad0.task_id""")
def q_deps_blocked(spark, sf):
    return GR.blocked_tasks(D.view(spark, sf, "tasks"), D.view(spark, sf, "task_edges_faulty"))


_PATHS = """e AS (SELECT DISTINCT dag_id, child, parent FROM task_edges),
p(dag_id, task_id, depth, path) AS (
  SELECT t.dag_id, t.task_id, 1, [t.task_id] FROM tasks t
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.dag_id = t.dag_id AND e.child = t.task_id)
  UNION ALL
  SELECT p.dag_id, e.child, p.depth + 1, list_append(p.path, e.child)
  FROM p JOIN e ON p.dag_id = e.dag_id AND e.parent = p.task_id),
lv AS (SELECT dag_id, task_id, max(depth) AS level FROM p GROUP BY dag_id, task_id)"""
_GRAPH_R = _GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _PATHS


def _levels(spark, sf):
    return GR.dag_levels(D.view(spark, sf, "tasks"), D.view(spark, sf, "task_edges"))


@register("deps_levels", _GRAPH_R + "\nSELECT dag_id, task_id, level FROM lv")
def q_deps_levels(spark, sf):
    return _levels(spark, sf).select("dag_id", "task_id", "level")


@register("deps_level_widths", _GRAPH_R + "\nSELECT dag_id, level, count(*) AS width FROM lv GROUP BY dag_id, level")
def q_deps_level_widths(spark, sf):
    return GR.level_widths(_levels(spark, sf))


@register("deps_order", _GRAPH_R + """,
w AS (SELECT dag_id, level, count(*) AS width FROM lv GROUP BY dag_id, level)
SELECT dag_id, CAST(sum(width) AS BIGINT) AS task_count, max(level) AS depth, max(width) AS max_width,
       max(width) > 1 AS can_parallelize FROM w GROUP BY dag_id""")
def q_deps_order(spark, sf):
    return GR.dag_resolution(_levels(spark, sf))


@register("deps_critical_path", _GRAPH_R + """,
best AS (SELECT dag_id, max(depth) AS len FROM p GROUP BY dag_id)
SELECT p.dag_id, array_to_string(min(p.path), '>') AS critical_path, p.depth AS critical_path_length
FROM p JOIN best ON p.dag_id = best.dag_id AND p.depth = best.len GROUP BY p.dag_id, p.depth""")
def q_deps_critical_path(spark, sf):
    return GR.critical_path(_levels(spark, sf), D.view(spark, sf, "task_edges"))


_ADJ = """e AS (SELECT DISTINCT dag_id, child, parent FROM task_edges),
up AS (SELECT dag_id, child AS task_id, count(*) AS n FROM e GROUP BY dag_id, child),
dn AS (SELECT dag_id, parent AS task_id, count(*) AS n FROM e GROUP BY dag_id, parent),
adj AS (SELECT t.dag_id, t.task_id, coalesce(up.n, 0) AS n_parents, coalesce(dn.n, 0) AS n_children
        FROM (SELECT DISTINCT dag_id, task_id FROM tasks) t
        LEFT JOIN up ON t.dag_id = up.dag_id AND t.task_id = up.task_id
        LEFT JOIN dn ON t.dag_id = dn.dag_id AND t.task_id = dn.task_id)"""


@register("deps_children", _GRAPH + ", " + _ADJ + "\nSELECT * FROM adj")
def q_deps_children(spark, sf):
    return GR.adjacency(D.view(spark, sf, "tasks"), D.view(spark, sf, "task_edges"))


@register("deps_tree", _GRAPH.replace("WITH ", "WITH RECURSIVE ", 1) + """,
e AS (SELECT DISTINCT dag_id, child, parent FROM task_edges),
roots AS (SELECT DISTINCT dag_id, task_id AS root FROM tasks
          WHERE (dag_id, task_id) NOT IN (SELECT dag_id, child FROM e)),
walk(dag_id, root, task_id, depth) AS (
  SELECT dag_id, root, root, 0 FROM roots
  UNION SELECT w.dag_id, w.root, e.child, w.depth + 1 FROM walk w JOIN e ON w.dag_id = e.dag_id AND w.task_id = e.parent)
SELECT dag_id, root, task_id, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE depth > 0 GROUP BY dag_id, root, task_id""")
def q_deps_tree(spark, sf):
    tasks, edges = D.view(spark, sf, "tasks"), D.view(spark, sf, "task_edges")
    roots = tasks.select("dag_id", F.col("task_id").alias("root")).distinct().join(
        edges.select("dag_id", F.col("child").alias("root")), ["dag_id", "root"], "left_anti")
    return GR.dependency_tree(edges, roots)


@register("dag_summary", _GRAPH + ", " + _ADJ + """
SELECT dag_id, count(*) AS task_count, CAST(sum(n_parents) AS BIGINT) AS edge_count,
       count(*) FILTER (WHERE n_parents = 0) AS root_count, count(*) FILTER (WHERE n_children = 0) AS leaf_count
FROM adj GROUP BY dag_id""")
def q_dag_summary(spark, sf):
    return GR.dag_summary(D.view(spark, sf, "tasks"), D.view(spark, sf, "task_edges"))


# ---------------------------------------------------------------- G8-G11 backfill
_BF = D.oracle_with("dags", "tasks")
_PLAN_SQL = """SELECT t.dag_id, t.task_id,
       unnest(generate_series(CAST(d.start_date AS TIMESTAMP), CAST(d.end_date AS TIMESTAMP),
              CASE d.schedule WHEN '@hourly' THEN INTERVAL 1 HOUR WHEN '@weekly' THEN INTERVAL 7 DAY
                              WHEN '@monthly' THEN INTERVAL 1 MONTH ELSE INTERVAL 1 DAY END)) AS "interval",
       'queued' AS status
FROM (SELECT DISTINCT dag_id, task_id FROM tasks) t JOIN dags d ON t.dag_id = d.dag_id
WHERE d.end_date >= d.start_date"""


def _plan(spark, sf):
    return BF.backfill_plan(D.view(spark, sf, "dags"), D.view(spark, sf, "tasks"))


@register("backfill_plan", _BF + _PLAN_SQL)
def q_backfill_plan(spark, sf):
    return _plan(spark, sf)


@register("backfill_counts", _BF + """,
iv AS (SELECT dag_id, CAST(len(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP),
              CASE schedule WHEN '@hourly' THEN INTERVAL 1 HOUR WHEN '@weekly' THEN INTERVAL 7 DAY
                            WHEN '@monthly' THEN INTERVAL 1 MONTH ELSE INTERVAL 1 DAY END)) AS BIGINT) AS total_intervals
       FROM dags WHERE end_date >= start_date),
nt AS (SELECT dag_id, count(DISTINCT task_id) AS tasks_per_run FROM tasks GROUP BY dag_id)
SELECT iv.dag_id, total_intervals, coalesce(tasks_per_run, 0) AS tasks_per_run,
       total_intervals * coalesce(tasks_per_run, 0) AS total_task_runs
FROM iv LEFT JOIN nt ON iv.dag_id = nt.dag_id""")
def q_backfill_counts(spark, sf):
    return BF.backfill_counts(D.view(spark, sf, "dags"), D.view(spark, sf, "tasks"))


_TASK_RUNS = D.oracle_with("task_runs")


def _task_runs(spark, sf):
    return D.view(spark, sf, "task_runs").withColumnRenamed("run_interval", "interval")


@register("run_history", _TASK_RUNS + """
SELECT dag_id, run_interval AS "interval", count(*) AS tasks, count(*) FILTER (WHERE status = 'queued') AS queued
FROM task_runs GROUP BY dag_id, run_interval""")
def q_run_history(spark, sf):
    return BF.run_history(_task_runs(spark, sf))


@register("run_history_recent", _TASK_RUNS + """
SELECT dag_id, CAST(count(*) OVER (PARTITION BY dag_id) - r + 1 AS INTEGER) AS pos, task_id, run_interval AS "interval", status
FROM (SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY ts DESC, run_id DESC) AS r FROM task_runs) x WHERE r <= 5""")
def q_run_history_recent(spark, sf):
    return BF.recent_task_runs(_task_runs(spark, sf))


@register("intervals_covered", _TASK_RUNS + """
SELECT dag_id, count(*) AS total_runs, count(DISTINCT run_interval) AS intervals_covered FROM task_runs GROUP BY dag_id""")
def q_intervals_covered(spark, sf):
    return BF.intervals_covered(_task_runs(spark, sf))


@register("backfill_gaps", D.oracle_with("daily_metric") + """,
r AS (SELECT min(dt) AS lo, max(dt) AS hi FROM daily_metric),
ex AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS "interval" FROM r)
SELECT "interval" FROM ex WHERE "interval" NOT IN (SELECT dt FROM daily_metric)""")
def q_backfill_gaps(spark, sf):
    return BF.missing_intervals(D.view(spark, sf, "daily_metric"), "dt", "1 day")


# ---------------------------------------------------------------- P1-P6 cleaning
CAST_MAP = {"c_nation_text": "int"}


@register("step_filter_nulls", _DIRTY + "SELECT * FROM dirty_customer WHERE c_mktsegment IS NOT NULL")
def q_step_filter_nulls(spark, sf):
    return CL.filter_nulls(D.view(spark, sf, "dirty_customer"), ["c_mktsegment"])


_CAST_SELECT = """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
       TRY_CAST(c_nation_text AS INTEGER) AS c_nation_text, c_version FROM dirty_customer"""


@register("step_cast_types", _DIRTY + _CAST_SELECT
          + " WHERE c_nation_text IS NULL OR TRY_CAST(c_nation_text AS INTEGER) IS NOT NULL")
def q_step_cast_types(spark, sf):
    return CL.cast_types(D.view(spark, sf, "dirty_customer"), CAST_MAP)


@register("step_cast_rejects", _DIRTY + """SELECT * FROM dirty_customer
WHERE NOT (c_nation_text IS NULL OR TRY_CAST(c_nation_text AS INTEGER) IS NOT NULL)""")
def q_step_cast_rejects(spark, sf):
    return CL.cast_rejects(D.view(spark, sf, "dirty_customer"), CAST_MAP)


_DEDUP_SQL = """SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, c_nation_text, c_version FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY c_version DESC, c_name DESC, c_nationkey DESC,
         c_acctbal DESC, c_mktsegment DESC, c_nation_text DESC) AS rn FROM {src}) x WHERE rn = 1"""


@register("step_deduplicate", _DIRTY + _DEDUP_SQL.format(src="dirty_customer"))
def q_step_deduplicate(spark, sf):
    return CL.deduplicate(D.view(spark, sf, "dirty_customer"), ["c_custkey"], ["c_version"])


@register("clean_table", _DIRTY + ", nn AS (SELECT * FROM dirty_customer WHERE c_mktsegment IS NOT NULL), dd AS ("
          + _DEDUP_SQL.format(src="nn") + ")\n" + _CAST_SELECT.replace("dirty_customer", "dd")
          + " WHERE c_nation_text IS NULL OR TRY_CAST(c_nation_text AS INTEGER) IS NOT NULL")
def q_clean_pipeline(spark, sf):
    p = CL.Pipeline([("filter_nulls", {"columns": ["c_mktsegment"]}),
                     ("deduplicate", {"keys": ["c_custkey"], "order_by": ["c_version"]}),
                     ("cast_types", {"mapping": CAST_MAP})])
    return p.run(D.view(spark, sf, "dirty_customer"))


# ---------------------------------------------------------------- W1-W3 flows, O8 stream
from vigil.plans import flows as FL  # noqa: E402
from vigil.streaming import alert_windows as AW  # noqa: E402

_PII_TABLES = {"documents": ["text", "lang", "source"], "conversations": ["role", "text"],
               "pages": ["url", "html"], "benchmark": ["text"]}


@register("pii_scan", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS \"column\", '{p}' AS pattern,"
    f" count(*) FILTER (WHERE regexp_matches({c}, '{rx}')) AS matches FROM {t}"
    for t, cols in _PII_TABLES.items() for c in cols for p, rx in FL.PII_PATTERNS.items()))
def q_pii_scan(spark, sf):
    return FL.pii_scan({t: load(spark, sf, t) for t in _PII_TABLES})


_SPARK_TYPE = ("CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' "
               "WHEN 'DOUBLE' THEN 'double' ELSE lower(column_type) END")
_VLOOP_SQL = _DIRTY + f""",
prof AS ({OP.profile_sql("dirty_customer", "dirty_customer", DIRTY_KINDS, with_top=False)}),
cur AS (SELECT column_name AS name, {_SPARK_TYPE} AS type FROM (DESCRIBE SELECT * FROM dirty_customer)),
base AS (SELECT column_name AS name, {_SPARK_TYPE} AS type FROM (DESCRIBE SELECT * FROM customer)),
rules AS ({_rules_sql(list(range(7))).replace(_DIRTY, '')})
SELECT 'profile' AS step, column_name AS subject, 'null_count' AS metric, CAST(null_count AS VARCHAR) AS value FROM prof
UNION ALL SELECT 'profile', column_name, 'distinct_count', CAST(distinct_count AS VARCHAR) FROM prof
UNION ALL SELECT 'profile', column_name, 'type', type FROM prof
UNION ALL SELECT 'drift', coalesce(c.name, b.name), 'change',
       CASE WHEN b.name IS NULL THEN 'added: ' WHEN c.name IS NULL THEN 'removed: '
            ELSE 'modified: type: ' || b.type || ' -> ' || c.type END
  FROM cur c FULL OUTER JOIN base b ON c.name = b.name
  WHERE b.name IS NULL OR c.name IS NULL OR b.type <> c.type
UNION ALL SELECT 'describe', 'dirty_customer', 'column_count', CAST(count(*) AS VARCHAR) FROM cur
UNION ALL SELECT 'describe', 'dirty_customer', 'nullable_columns',
       CAST(count(*) FILTER (WHERE name IN ({", ".join(repr(c) for c in _NULLABLE_DIRTY)})) AS VARCHAR) FROM cur
UNION ALL SELECT 'rules', CAST(rule_index AS VARCHAR) || ':' || rule_type || ':' || "column", 'passed',
       CAST(passed AS VARCHAR) FROM rules
UNION ALL SELECT 'rules', CAST(rule_index AS VARCHAR) || ':' || rule_type || ':' || "column", 'failures',
       CAST(failures AS VARCHAR) FROM rules"""


# The view's Spark nullability (c_version is a literal, hence NOT NULL) is stated in the
# oracle through _NULLABLE_DIRTY, as for lint_with_data; everything else is computed.
@register("validation_loop", _VLOOP_SQL)
def q_validation_loop(spark, sf):
    base = SC.columns_of(load(spark, sf, "customer"), "dirty_customer")
    return FL.validation_loop(D.view(spark, sf, "dirty_customer"), "dirty_customer", base, CUSTOMER_RULES)


_DOC_TEXT_COLS = ["text", "lang", "source"]  # the string columns of documents
_FLAGGED = "\nUNION\n".join(
    f"SELECT '{c}' AS name FROM documents WHERE regexp_matches({c}, '{rx}') HAVING count(*) > 0"
    for c in _DOC_TEXT_COLS for rx in FL.PII_PATTERNS.values())


@register("compliance_scan", _RUNS + ", " + _LAST20 + f""",
s AS ({_STATS_SQL}),
flagged AS ({_FLAGGED}),
nulls AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS name, count(*) FILTER (WHERE {c} IS NULL) AS n,"
    f" CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 4) ELSE 0.0 END AS r"
    f" FROM documents" for c in _DOC_TEXT_COLS) + """)
SELECT 'profile' AS step, name AS subject, 'null_count' AS metric, CAST(n AS VARCHAR) AS value
FROM nulls WHERE name IN (SELECT name FROM flagged)
UNION ALL SELECT 'profile', name, 'null_rate', CAST(r AS VARCHAR) FROM nulls WHERE name IN (SELECT name FROM flagged)
UNION ALL SELECT 'tag', 'documents.' || name, 'tags', 'pii,sensitive' FROM flagged
UNION ALL SELECT 'lint', name, 'missing_description', 'info' FROM flagged
UNION ALL SELECT 'lint', name, 'id_type', 'warning' FROM flagged WHERE contains(lower(name), 'id')
UNION ALL SELECT 'health', 'documents', 'health', CASE WHEN success_rate >= 0.95 THEN 'healthy' WHEN success_rate >= 0.80 THEN 'degraded'
                                                       ELSE 'unhealthy' END FROM s WHERE pipeline = 'p1'
UNION ALL SELECT 'health', 'documents', 'success_rate', CAST(success_rate AS VARCHAR) FROM s WHERE pipeline = 'p1'""")
def q_compliance_scan(spark, sf):
    # the run log of one pipeline stands for the runs that load the table
    runs = D.view(spark, sf, "runs").withColumn("pipeline", F.regexp_replace("pipeline", "^p1$", "documents"))
    return FL.compliance_scan(load(spark, sf, "documents"), "documents", runs=runs)


@register("alert_windows_stream", _ALERTS + """,
c AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start,
             time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, severity, count(*) AS n
      FROM alerts GROUP BY 1, 2, 3)
SELECT * FROM c WHERE window_end <= (SELECT max(ts) FROM alerts) - INTERVAL 1 HOUR""")
def q_alert_windows_stream(spark, sf):
    return AW.alert_windows_via_stream(D.view(spark, sf, "alerts"), "1 day", "1 hour")


# ---------------------------------------------------------------- additional detail views
@register("recent_alerts", _ALERTS + """,
a AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY ts DESC, alert_id DESC) AS rr FROM alerts)
SELECT pipeline, CAST(count(*) OVER (PARTITION BY pipeline) - rr + 1 AS INTEGER) AS pos, alert_id, severity,
       message, acknowledged
FROM a WHERE rr <= 3""")
def q_recent_alerts(spark, sf):
    return RN.recent_alerts(D.view(spark, sf, "alerts"))


@register("deps_children_edges", _GRAPH + "\nSELECT DISTINCT dag_id, parent, child FROM task_edges")
def q_deps_children_edges(spark, sf):
    return GR.children(D.view(spark, sf, "task_edges"))


_PART_META = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
              ("p_size", "int"), ("p_retailprice", "double")]


@register("catalog_describe_columns", "WITH prof AS (" + OP.profile_sql("part", "part", PART_KINDS, with_top=False)
          + ")\nSELECT 'part' AS table_name, column_name AS name, null_count, distinct_count, \"min\", \"max\", mean "
            "FROM prof")
def q_catalog_describe_columns(spark, sf):
    part = load(spark, sf, "part")
    cols = SC.columns_of(part, "part")
    out = CA.describe_columns(cols, P.profile(part, table="part"))
    return out.select("table_name", "name", "null_count", "distinct_count", "min", "max", "mean")


@register("dq_profile_approx")
def q_profile_approx(spark, sf):
    # Rows-only: distinct counts and top-k come from HyperLogLog++ / approx_top_k sketches.
    return _rendered(P.profile(load(spark, sf, "lineitem"), table="lineitem", approx=True))


@register("dq_top_values_approx")
def q_top_values_approx(spark, sf):
    # Rows-only: sketch-estimated counts.
    return P.top_values(load(spark, sf, "orders"), approx=True)


DOCUMENTS_KINDS = [("doc_id", N), ("text", T_), ("lang", T_), ("source", T_), ("n_chars", N)]


@register("dq_profile_documents", OP.profile_sql("documents", "documents", DOCUMENTS_KINDS))
def q_profile_documents(spark, sf):
    # Whole texts are grouped on a 96-bit fingerprint of the complete value.
    return _rendered(P.profile(load(spark, sf, "documents"), table="documents", fingerprint_text=True))


@register("deps_topo_order", _GRAPH_R + "\nSELECT dag_id, level, task_id FROM lv ORDER BY dag_id, level, task_id")
def q_deps_topo_order(spark, sf):
    return GR.topological_order(_levels(spark, sf))


def _final_turns(spark, sf):
    # The requested columns: the last turn of every conversation (its final output).
    conv = load(spark, sf, "conversations")
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return last.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("table"),
                       F.concat(F.lit("t"), F.col("turn").cast("string")).alias("column"))


@register("lineage_ancestors", _LIN.replace("WITH ", "WITH RECURSIVE ", 1) + """,
req AS (SELECT 'c' || CAST(conv_id AS VARCHAR) AS "table", 't' || CAST(max(turn) AS VARCHAR) AS "column"
        FROM conversations GROUP BY conv_id),
a(tb, cl, st, sc, hops) AS (
  SELECT DISTINCT r."table", r."column", e.source_table, e.source_column, 1
  FROM req r JOIN lineage_edges e ON e.target_table = r."table" AND e.target_column = r."column"
  UNION
  SELECT a.tb, a.cl, e.source_table, e.source_column, a.hops + 1
  FROM a JOIN lineage_edges e ON e.target_table = a.st AND e.target_column = a.sc)
SELECT tb AS "table", cl AS "column", st AS source_table, sc AS source_column, min(hops) AS hops
FROM a GROUP BY tb, cl, st, sc""")
def q_lineage_ancestors(spark, sf):
    return LI.lineage_ancestors(D.view(spark, sf, "lineage_edges"), _final_turns(spark, sf))


from vigil.streaming import rule_checks as RC  # noqa: E402

_ROW_RULE_IDX = [0, 1, 3, 4, 5]   # the row-level rules: additive over micro-batches


@register("dq_rules_stream", _DIRTY + "\nUNION ALL\n".join(
    f"SELECT {pos} AS rule_index, rule_type, \"column\", failures FROM ({_RULE_SQL[i]})"
    for pos, i in enumerate(_ROW_RULE_IDX)))
def q_rules_stream(spark, sf):
    return RC.rules_via_stream(D.view(spark, sf, "dirty_customer"), [CUSTOMER_RULES[i] for i in _ROW_RULE_IDX])


# ---------------------------------------------------------------- forms that write, and invariants of estimates
from vigil.session import ensure_checkpoint_dir  # noqa: E402
from vigil.sources import logs as LG  # noqa: E402


def _scratch(spark, name):
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_QUARANTINE = [(0, "not_null", "c_mktsegment IS NULL"), (3, "min", "c_acctbal < 0"), (4, "max", "c_acctbal > 9000"),
               (5, "accepted_values", f"c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ({_SEG_SQL})")]


@register("dq_quarantine", _DIRTY + """
SELECT c_custkey, c_version, concat_ws(',', """ + ", ".join(
    f"CASE WHEN {cond} THEN '{n}:{kind}' END" for n, (_, kind, cond) in enumerate(_QUARANTINE)) + """,
       CASE WHEN count(*) OVER (PARTITION BY c_custkey) > 1 AND c_custkey IS NOT NULL THEN '4:unique' END) AS failed_rules
FROM dirty_customer""")
def q_quarantine(spark, sf):
    out = RU.quarantine(D.view(spark, sf, "dirty_customer"), [CUSTOMER_RULES[i] for i, _, _ in _QUARANTINE] + [CUSTOMER_RULES[2]])
    return out.select("c_custkey", "c_version", F.array_join("failed_rules", ",").alias("failed_rules"))


# Every fourth month is missing from the written totals; only those are computed anew, twice.
@register("backfill_recompute", """
SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS month, count(*) AS n_orders,
       sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue FROM orders GROUP BY 1""")
def q_backfill_recompute(spark, sf):
    path = _scratch(spark, "monthly")
    orders = load(spark, sf, "orders").withColumn("month", F.trunc(F.col("o_orderdate").cast("date"), "month"))

    def totals(df):
        return df.groupBy("month").agg(F.count(F.lit(1)).alias("n_orders"),
                                       F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"))

    missing = orders.where(F.month("month") % 4 == 0).select(F.col("month").alias("interval")).distinct()
    totals(orders.where(F.month("month") % 4 != 0)).repartition("month").write.partitionBy("month").parquet(path)
    for _ in range(2):
        BF.recompute(orders, missing, "month", totals, path, "month")
    return spark.read.parquet(path).select(F.col("month").cast("date").alias("month"), "n_orders", "revenue")


@register("record_runs", _RUNS + "SELECT run_id, pipeline, status, duration_min, rows_processed, ts FROM runs")
def q_record_runs(spark, sf):
    path, runs = _scratch(spark, "runs"), D.view(spark, sf, "runs")
    for kind in ("success", "failed"):
        LG.record_runs(runs.where(F.col("status") == kind), path)
    return spark.read.parquet(path)


@register("record_alerts", _ALERTS + """
SELECT alert_id, pipeline, severity, message, ts, CASE WHEN severity = 'critical' THEN acknowledged ELSE false END AS acknowledged FROM alerts""")
def q_record_alerts(spark, sf):
    path, alerts = _scratch(spark, "alerts"), D.view(spark, sf, "alerts")
    LG.record_alerts(alerts.where("severity = 'critical'"), path)
    LG.record_alerts(alerts.where("severity <> 'critical'").drop("acknowledged"), path)
    return spark.read.parquet(path)


_CATALOGUED = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "orders": [c for c, _ in ORDERS_KINDS],
               "events": ["event_id", "ts", "user_id", "event_type", "value", "props"]}


# Every column that the Spark catalog lists, with the rows and nulls of its table.
@register("catalog_columns", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS name, {i} AS position, count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM {t}"
    for t, columns in _CATALOGUED.items() for i, c in enumerate(columns)))
def q_catalog_columns(spark, sf):
    views = {t: f"vigil_{t}" for t in _CATALOGUED}
    for t, name in views.items():
        load(spark, sf, t).createOrReplaceTempView(name)
    listed = CA.columns_from_catalog(spark).where(F.col("table_name").isin(list(views.values())))
    for name in views.values():
        spark.catalog.dropTempView(name)
    counted = []
    for t in _CATALOGUED:
        table = load(spark, sf, t)
        nulls = [F.struct(F.lit(c).alias("counted"), F.count_if(F.col(c).isNull()).alias("n_nulls")) for c in table.columns]
        counted.append(table.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*nulls).alias("nulls"))
                       .select(F.lit(t).alias("of"), "n_rows", F.explode("nulls").alias("x")).select("of", "n_rows", "x.*"))
    name = F.substring("table_name", 7, 100)
    return (listed.join(reduce(DataFrame.union, counted), (name == F.col("of")) & (F.col("name") == F.col("counted")))
            .select(name.alias("table_name"), "name", "position", "n_rows", "n_nulls"))


# The sample has exactly the asked size, holds no row twice and only rows of the table.
@register("dq_sample_exact", "SELECT 1000 AS n_rows, 1000 AS n_distinct, 1000 AS n_known WHERE (SELECT count(*) FROM orders) >= 1000")
def q_sample_exact(spark, sf):
    orders = load(spark, sf, "orders")
    keys = P.sample_rows(orders, 1000).select("o_orderkey")
    known = keys.join(orders.select("o_orderkey"), "o_orderkey", "left_semi")
    return keys.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderkey").alias("n_distinct")).withColumn(
        "n_known", known.agg(F.count(F.lit(1))).scalar()).select(*[F.col(c).cast("int").alias(c) for c in ("n_rows", "n_distinct", "n_known")])


# HyperLogLog++ distinct counts within twice their standard error (5 %), all else exact.
@register("dq_approx_within_bounds", "SELECT column_name, true AS distinct_ok, true AS rest_equal FROM (DESCRIBE lineitem)")
def q_approx_within_bounds(spark, sf):
    table = load(spark, sf, "lineitem")
    facts = ["row_count", "null_count", "castable_count", "min", "max", "mean"]
    exact = P.profile(table).select("column_name", F.col("distinct_count").alias("d"), F.struct(*facts).alias("f"))
    near = P.profile(table, approx=True).select("column_name", F.col("distinct_count").alias("a"), F.struct(*facts).alias("g"))
    return exact.join(near, "column_name").select(
        "column_name", (F.abs(F.col("a") - F.col("d")) <= 0.1 * F.col("d") + 1).alias("distinct_ok"), F.col("f").eqNullSafe(F.col("g")).alias("rest_equal"))


# approx_top_k overestimates by a bounded error: each value it reports exists, with about the stated count, and no value
# more frequent than the least one reported is missing.  Columns whose values are all rare have nothing to report.
@register("dq_top_approx_within_bounds", "SELECT 'o_orderstatus' AS column_name, true AS counts_ok, true AS none_missing UNION ALL SELECT 'o_orderpriority', true, true")
def q_top_approx_within_bounds(spark, sf):
    orders, columns = load(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]
    top = P.top_values(orders, columns, approx=True).select("column_name", "value", "count")
    counts = reduce(DataFrame.unionByName, [
        orders.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("column_name", F.lit(c))
        for c in columns])
    both = top.join(counts, ["column_name", "value"], "full_outer")
    near = F.col("n").isNotNull() & (F.abs(F.col("count") - F.col("n")) <= 0.05 * F.col("n") + 1)
    missed = F.max(F.when(F.col("count").isNull(), F.col("n")))
    return both.groupBy("column_name").agg(
        (F.count("count") > 0).alias("any"), F.bool_and(F.col("count").isNull() | near).alias("near"),
        F.coalesce(missed <= 1.05 * F.min("count") + 1, F.lit(True)).alias("none_missing")).select(
            "column_name", (F.col("any") & F.col("near")).alias("counts_ok"), (F.col("any") & F.col("none_missing")).alias("none_missing"))


# ---------------------------------------------------------------- versions, and joins in time
from vigil.operators import reconcile as RX  # noqa: E402
from vigil.operators import temporal as TM  # noqa: E402
from vigil.session import drop_folder  # noqa: E402

_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_VERSIONS = D.oracle_with("orders_v2") + f""", minus AS (SELECT {_O} FROM orders EXCEPT ALL SELECT {_O} FROM orders_v2),
plus AS (SELECT {_O} FROM orders_v2 EXCEPT ALL SELECT {_O} FROM orders),
both_ AS (SELECT *, 'before' AS side FROM minus UNION ALL SELECT *, 'after' FROM plus),
changes AS (SELECT {_O}, side, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM minus) AND o_orderkey IN (SELECT o_orderkey FROM plus)
                   THEN 'changed' WHEN side = 'after' THEN 'added' ELSE 'removed' END AS change, count(*) AS copies
            FROM both_ GROUP BY ALL)
"""


def _reconciled(spark, sf):
    """Both versions written with their digests, the differing leaves compared; only the changes are kept."""
    path = _scratch(spark, "versions")
    RX.write_version(load(spark, sf, "orders"), ["o_orderkey"], f"{path}/before")
    RX.write_version(D.view(spark, sf, "orders_v2"), ["o_orderkey"], f"{path}/after")
    kept = _scratch(spark, "changes")
    RX.reconcile(spark, f"{path}/before", f"{path}/after", ["o_orderkey"]).write.parquet(kept)
    drop_folder(spark, path)
    return spark.read.parquet(kept)


@register("reconcile_rows", _VERSIONS + f"SELECT {_O}, side, change, copies FROM changes")
def q_reconcile_rows(spark, sf):
    return _reconciled(spark, sf)


@register("reconcile_summary", _VERSIONS + """
SELECT change, side, count(*) AS distinct_rows, CAST(sum(copies) AS BIGINT) AS copies FROM changes GROUP BY 1, 2""")
def q_reconcile_summary(spark, sf):
    orders = load(spark, sf, "orders")
    return RX.change_summary(RX.compare(orders, D.view(spark, sf, "orders_v2"), ["o_orderkey"]))


_LAST_GOOD = """, good AS (SELECT pipeline, ts AS run_ts, max(run_id) AS last_run_id, arg_max(duration_min, run_id) AS last_duration
  FROM runs WHERE status = 'success' GROUP BY pipeline, ts)
"""


@register("alert_last_run", _RUNS_ALERTS + _LAST_GOOD + """
SELECT alert_id, a.pipeline, a.ts, last_run_id, run_ts AS last_run_ts, last_duration
FROM alerts a ASOF LEFT JOIN good g ON a.pipeline = g.pipeline AND a.ts >= g.run_ts""")
def q_alert_last_run(spark, sf):
    good = D.view(spark, sf, "runs").where("status = 'success'").select(
        "pipeline", F.col("ts").alias("last_run_ts"), F.col("run_id").alias("last_run_id"), F.col("duration_min").alias("last_duration"))
    alerts = D.view(spark, sf, "alerts").select("alert_id", "pipeline", "ts")
    return TM.asof_join(alerts, good, ["pipeline"], "ts", "last_run_ts", ["last_run_id", "last_run_ts", "last_duration"], ["last_run_id"])


_SPANS = "spans AS (SELECT run_id, pipeline, ts AS started, ts + INTERVAL 1 SECOND * CAST(round(duration_min * 60) AS BIGINT) AS ended FROM runs)"


@register("overlapping_runs", _RUNS + ", " + _SPANS + """
SELECT a.pipeline, a.run_id AS run_a, b.run_id AS run_b, greatest(a.started, b.started) AS overlap_start, least(a.ended, b.ended) AS overlap_end
FROM spans a JOIN spans b ON a.pipeline = b.pipeline AND a.run_id < b.run_id AND a.started < b.ended AND b.started < a.ended
WHERE a.started < a.ended AND b.started < b.ended""")
def q_overlapping_runs(spark, sf):
    seconds = F.round(F.col("duration_min") * 60).cast("bigint")
    spans = D.view(spark, sf, "runs").select("run_id", "pipeline", F.col("ts").alias("started"), (F.col("ts") + F.make_interval(secs=seconds)).alias("ended"))
    pairs = TM.interval_join(spans, spans, ["pipeline"], ("started", "ended"), ("started", "ended"))
    return pairs.where("l.run_id < r.run_id").select(
        F.col("l.pipeline").alias("pipeline"), F.col("l.run_id").alias("run_a"), F.col("r.run_id").alias("run_b"), "overlap_start", "overlap_end")


# ---------------------------------------------------------------- nested drift
_SHAPES = D.oracle_with("nested_events") + f""",
parsed AS (SELECT CASE WHEN ts < TIMESTAMP '{_SPLIT}' THEN 'before' ELSE 'after' END AS period, body,
             CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS v FROM nested_events),
walk AS (SELECT period, regexp_replace(j.fullkey, '\\[\\d+\\]', '[]', 'g') AS path, j.type AS jt FROM parsed, json_tree(parsed.v) j WHERE parsed.v IS NOT NULL),
typed AS (SELECT period, path, CASE WHEN jt IN ('BIGINT', 'UBIGINT') THEN 'integer' WHEN jt = 'DOUBLE' THEN 'number'
            WHEN jt = 'VARCHAR' THEN 'string' ELSE lower(jt) END AS t FROM walk),
merged AS (SELECT path, period, count(*) AS n, list_sort(list(DISTINCT t) FILTER (t <> 'null')) AS ts, bool_or(t = 'null') AS nullable FROM typed GROUP BY 1, 2),
lattice AS (SELECT path, period, n, coalesce(CASE WHEN len(ts) = 1 THEN ts[1] WHEN ts = ['integer', 'number'] THEN 'number'
              WHEN len(ts) > 1 THEN 'mixed' END, 'null') AS type, nullable FROM merged),
sides AS (SELECT coalesce(b.path, a.path) AS path, b.type AS type_before, a.type AS type_after, b.nullable AS nullable_before, a.nullable AS nullable_after,
            coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after
          FROM (SELECT * FROM lattice WHERE period = 'before') b FULL JOIN (SELECT * FROM lattice WHERE period = 'after') a ON a.path = b.path)
"""


@register("json_path_drift", _SHAPES + """
SELECT *, CASE WHEN type_before IS NULL THEN 'added' WHEN type_after IS NULL THEN 'removed'
  WHEN type_before = type_after THEN CASE WHEN nullable_before = nullable_after THEN 'same' WHEN nullable_after THEN 'widened' ELSE 'narrowed' END
  WHEN type_before = 'null' OR type_after = 'mixed' OR (type_before = 'integer' AND type_after = 'number') THEN 'widened'
  WHEN type_after = 'null' OR type_before = 'mixed' OR (type_before = 'number' AND type_after = 'integer') THEN 'narrowed'
  ELSE 'changed' END AS change FROM sides""")
def q_json_path_drift(spark, sf):
    events = D.view(spark, sf, "nested_events")
    return SC.json_path_drift(events, "body", F.when(F.col("ts") < F.lit(_SPLIT).cast("timestamp"), "before").otherwise("after"))


@register("json_malformed", _SHAPES + """
SELECT period, count(*) AS n_rows, count(*) FILTER (body IS NULL) AS n_null, count(*) FILTER (body IS NOT NULL AND v IS NULL) AS n_malformed
FROM parsed GROUP BY period""")
def q_json_malformed(spark, sf):
    events = D.view(spark, sf, "nested_events")
    return SC.json_malformed(events, "body", F.when(F.col("ts") < F.lit(_SPLIT).cast("timestamp"), "before").otherwise("after"))


# ---------------------------------------------------------------- incremental profile
from vigil.operators import profile_state as PS  # noqa: E402

_MONTHLY = """WITH t AS (SELECT * FROM orders WHERE strftime(CAST(o_orderdate AS DATE), '%Y-%m') <> '1996-02'
  UNION ALL SELECT * FROM orders WHERE strftime(CAST(o_orderdate AS DATE), '%Y-%m') = '1995-01')
"""
_ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


# One month is delivered again, another is taken away: only the first is read anew, the second is retracted.  Estimates are
# compared with the table itself: distinct counts and ranks within their bounds, every value of a twentieth of all rows found.
@register("profile_incremental", _MONTHLY + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
    + (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max" if k == N else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max")
    + ", true AS distinct_ok, true AS quantiles_ok, true AS top_ok, 1 AS n_read, 1 AS n_retracted FROM t" for c, k in ORDERS_KINDS))
def q_profile_incremental(spark, sf):
    base = _scratch(spark, "monthly-orders")
    table, state, done = f"{base}/orders", f"{base}/state", _scratch(spark, "profile")
    monthly = load(spark, sf, "orders").withColumn("month", F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM"))
    monthly.repartition("month").write.partitionBy("month").parquet(table)
    PS.update(spark, table, "month", state)
    monthly.where("month = '1995-01'").write.mode("append").partitionBy("month").parquet(table)
    drop_folder(spark, f"{table}/month=1996-02")
    touched = PS.update(spark, table, "month", state)
    rows = spark.read.option("basePath", table).parquet(table).drop("month")
    found = PS.profile(spark, state)

    values = reduce(DataFrame.union, [rows.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
                                      .select(F.lit(c).alias("of"), "value", "n", F.lit(c in _ORDER_NUMBERS).alias("number")) for c in rows.columns])
    total, reported = F.col("row_count"), F.map_from_entries(F.transform("top_values", lambda x: F.struct(x["item"], x["count"])))
    heavy = F.col("n") >= total / 20
    number = F.when(F.col("number"), F.col("value").cast("double"))
    ranks = [(F.sum(F.when(number < F.col("quantiles")[i], F.col("n")).otherwise(0)) <= (q + PS.RANK_ERROR) * F.first("row_count"))
             & (F.sum(F.when(number <= F.col("quantiles")[i], F.col("n")).otherwise(0)) >= (q - PS.RANK_ERROR) * F.first("row_count"))
             for i, q in enumerate((0.25, 0.5, 0.75))]
    held = F.abs(F.coalesce(F.element_at("reported", F.col("value")), F.lit(0)) - F.col("n")) <= total / PS.TRACKED * 2
    checks = (found.withColumn("reported", reported).join(values, F.col("column_name") == F.col("of"))
              .groupBy("column_name").agg(
                  F.first("row_count").alias("row_count"), F.first("null_count").alias("null_count"), F.first("min").alias("min"), F.first("max").alias("max"),
                  (F.abs(F.first("distinct_estimate") - F.count("value")) <= PS.DISTINCT_ERROR * F.count("value") + 1).alias("distinct_ok"),
                  (F.first("quantiles").isNull() | (ranks[0] & ranks[1] & ranks[2])).alias("quantiles_ok"),
                  (F.count_if(heavy) == F.count_if(heavy & held)).alias("top_ok")))
    (checks.withColumn("n_read", F.lit(len(touched["read"]))).withColumn("n_retracted", F.lit(len(touched["retracted"]))).write.parquet(done))
    drop_folder(spark, base)
    return spark.read.parquet(done)


# ---------------------------------------------------------------- ranked search
from vigil.operators import search_index as SX  # noqa: E402

_QUERY = "rigths reserved"  # with a typo: the closest term is searched
_RANKED = f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM t),
tf AS (SELECT doc_id, length, term, count(*) AS tf FROM p GROUP BY ALL),
vocabulary AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT unnest(string_split('{_QUERY}', ' ')) AS asked),
chosen AS (SELECT asked, arg_min(term, {{'d': levenshtein(term, asked), 'r': -df, 't': term}}) AS term
           FROM asked, vocabulary WHERE levenshtein(term, asked) <= {SX.MAX_TYPOS} GROUP BY asked),
terms AS (SELECT DISTINCT term, df FROM chosen JOIN vocabulary USING (term)),
n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM t),
scored AS (SELECT doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {SX.K1 + 1} / (tf + {SX.K1} * (1 - {SX.B} + {SX.B} * length / mean))) AS score,
             string_agg(term, ' ' ORDER BY term) AS matched
           FROM tf JOIN terms USING (term), n GROUP BY doc_id)
"""


@register("content_rank", _RANKED + "SELECT id, round(score, 6) AS score, matched FROM scored ORDER BY score DESC, id LIMIT 20")
def q_content_rank(spark, sf):
    path, kept = _scratch(spark, "index"), _scratch(spark, "ranked")
    docs = load(spark, sf, "documents")
    # two batches, as they would arrive
    for part in (F.col("lang") == "en", F.coalesce(F.col("lang") != "en", F.lit(True))):
        SX.add(docs.where(part), "doc_id", "text", path)
    found = SX.search(spark, path, _QUERY, 20)
    found.select("id", F.round("score", 6).alias("score"), F.array_join("matched", " ").alias("matched")).write.parquet(kept)
    drop_folder(spark, path)
    return spark.read.parquet(kept)


# ---------------------------------------------------------------- sessions of alerts
from vigil.streaming import sessions as SS  # noqa: E402

_GAP, _DELAY = 6 * 3600, 3600


def _islands(source):
    return f"""steps AS (SELECT pipeline, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL {_GAP} SECOND THEN 0 ELSE 1 END AS fresh
  FROM {source} WINDOW w AS (PARTITION BY pipeline ORDER BY ts)),
runs_ AS (SELECT pipeline, ts, sum(fresh) OVER (PARTITION BY pipeline ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM steps),
s AS (SELECT pipeline, min(ts) AS session_start, max(ts) + INTERVAL {_GAP} SECOND AS session_end, count(*) AS n FROM runs_ GROUP BY pipeline, nr)"""


@register("alert_sessions", _ALERTS + ", " + _islands("alerts") + "\nSELECT pipeline, session_start, session_end, n FROM s")
def q_alert_sessions(spark, sf):
    return SS.sessions(D.view(spark, sf, "alerts"), ["pipeline"], "ts", _GAP)


# Alerts arrive in two deliveries; every fiftieth of the first half comes with the second one, mostly too late.
_ARRIVED = f"""arrived AS (SELECT *, ts < TIMESTAMP '{_SPLIT}' AND alert_id % 50 <> 0 AS first_half FROM alerts),
taken AS (SELECT * FROM arrived WHERE first_half OR ts >= (SELECT max(ts) FROM arrived WHERE first_half) - INTERVAL {_DELAY} SECOND)"""


@register("alert_sessions_stream", _ALERTS + f", {_ARRIVED}, " + _islands("taken") + f"""
SELECT pipeline, session_start, session_end, n, (SELECT count(*) FROM arrived) - (SELECT count(*) FROM taken) AS late_rows
FROM s WHERE session_end <= (SELECT max(ts) FROM alerts) - INTERVAL {_DELAY} SECOND""")
def q_alert_sessions_stream(spark, sf):
    alerts = D.view(spark, sf, "alerts").select("alert_id", "pipeline", F.col("ts").cast("timestamp_ntz").alias("ts"))
    first = (F.col("ts") < F.lit(_SPLIT).cast("timestamp_ntz")) & (F.col("alert_id") % 50 != 0)
    closed, late = SS.sessions_via_stream([alerts.where(first), alerts.where(~first)], ["pipeline"], "ts", _GAP, _DELAY)
    return closed.withColumn("late_rows", F.lit(late.count()))
