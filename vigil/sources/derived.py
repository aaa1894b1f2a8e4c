"""Input views derived from the driver's parquet tables.

The reference works on run logs, alert logs, cost records, task graphs, column catalogs,
tag states and lineage edges.  These views derive such inputs from the given tables so
that every operator's work grows with the data.  Each view is one SQL text that runs
unchanged on Spark and DuckDB; ``{name}`` marks an input table or another view.

Spark side: ``view(spark, sf_dir, name)`` binds the placeholders to DataFrames through
``spark.sql(text, **frames)`` (no temp views, no global state).
Oracle side: ``oracle_with(names)`` emits the same texts as a ``WITH`` prefix.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vigil.sources.tables import TABLES, load

# Fixed value: the split instant between the "before" and "after" observation periods of
# the events table (its event time spans 2024-01-01 .. 2024-01-30).
PERIOD_SPLIT = "2024-01-16 00:00:00"

VIEWS: dict[str, str] = {}

# Pipeline run log: one run per event.  Pipelines whose number ends in 3 do not record their row
# counts; those ending in 7 are small, steady and never fail.
VIEWS["runs"] = """
SELECT event_id AS run_id, concat('p', CAST(user_id AS STRING)) AS pipeline,
       CASE WHEN event_type = 'error' AND user_id % 10 <> 7 THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN user_id % 10 = 7 THEN 10 + value / 1000 ELSE value / 2 END AS duration_min,
       CASE WHEN user_id % 10 = 3 THEN NULL
            ELSE TRY_CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) * CASE WHEN user_id % 10 = 7 THEN 1000 ELSE 250000 END
            END AS rows_processed, ts
FROM {events}
"""

# Alert log: events above 100 raise an alert; a third are acknowledged.
VIEWS["alerts"] = """
SELECT event_id AS alert_id, concat('p', CAST(user_id AS STRING)) AS pipeline,
       CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning'
                       WHEN 'signup' THEN 'info' ELSE 'other' END AS severity,
       concat(event_type, ' on ', props) AS message, ts, event_id % 3 = 0 AS acknowledged
FROM {events} WHERE value > 100
"""

# Cost records per provider (brand): returned lines after the first of an order are "storage",
# the rest "compute".
VIEWS["costs"] = """
SELECT p.p_brand AS provider,
       CAST(SUM(CASE WHEN l.l_returnflag <> 'R' OR l.l_linenumber = 1 THEN CAST(l.l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(38,2)) AS compute,
       CAST(SUM(CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber <> 1 THEN CAST(l.l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(38,2)) AS storage,
       CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand
"""

# Which turns of a conversation a turn follows: an equi-join on (conversation, turn), so even a
# very long conversation is dealt by turn.
VIEWS["turn_edges"] = """
SELECT w.conv_id, w.turn, w.pturn
FROM (SELECT conv_id, turn, turn - 1 AS pturn FROM {conversations}
      UNION ALL
      SELECT conv_id, turn, turn - 2 AS pturn FROM {conversations} WHERE turn % 3 = 0) w
JOIN {conversations} b ON b.conv_id = w.conv_id AND b.turn = w.pturn
"""

# Task graph: every conversation is a DAG, each turn a task depending on the previous turn
# and, every third turn, also on the turn before that (diamonds).
VIEWS["task_edges"] = """
SELECT conv_id AS dag_id, concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS child,
       concat(CAST(conv_id AS STRING), '-', CAST(pturn AS STRING)) AS parent
FROM {turn_edges}
"""

VIEWS["tasks"] = """
SELECT conv_id AS dag_id, concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS task_id,
       role, turn
FROM {conversations}
"""

# Edges with faults: in conversations whose id ends in 5 the first turn also waits for a task
# that does not exist (G1); those whose id ends in 0 loop back from their first to their
# last turn (G2).  All other DAGs stay valid.
VIEWS["task_edges_faulty"] = """
SELECT dag_id, child, parent FROM {task_edges}
UNION ALL
SELECT conv_id AS dag_id, concat(CAST(conv_id AS STRING), '-0') AS child,
       concat(CAST(conv_id AS STRING), '-pre') AS parent
FROM {conversations} WHERE turn = 0 AND conv_id % 10 = 5
UNION ALL
SELECT conv_id AS dag_id, concat(CAST(conv_id AS STRING), '-0') AS child,
       concat(CAST(conv_id AS STRING), '-', CAST(max(turn) AS STRING)) AS parent
FROM {conversations} WHERE conv_id % 10 = 0 GROUP BY conv_id HAVING max(turn) > 0
"""

VIEWS["daily_metric"] = """
SELECT CAST(o_orderdate AS DATE) AS dt, COUNT(*) AS n_orders,
       SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue
FROM {orders} GROUP BY CAST(o_orderdate AS DATE)
"""

# Customer table with nulls, a mixed text column and re-delivered rows (version 2).
VIEWS["dirty_customer"] = """
SELECT c_custkey, c_name, c_nationkey, c_acctbal,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS STRING) END AS c_nation_text,
       1 AS c_version
FROM {customer}
UNION ALL
SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS STRING) END AS c_nation_text,
       2 AS c_version
FROM {customer} WHERE c_custkey % 10 = 0
"""

# Name of the column that an event feeds: one per event type and quarter of the day.  Signup, click
# and error columns break the naming rules of the linter.
_COLUMN = """concat(CASE event_type WHEN 'signup' THEN 'signupId' WHEN 'click' THEN 'click_id' WHEN 'error' THEN 'error value '
                             ELSE concat(event_type, '_value') END, CAST(CAST(FLOOR(extract(hour FROM ts) / 6) AS INTEGER) AS STRING))"""

# Table that an event feeds: its pipeline's output, or a separate one for the last hour of the day
# (few events, so some of those tables exist in one period only).
_TABLE = "concat('p', CAST(user_id AS STRING), CASE WHEN extract(hour FROM ts) = 23 THEN '_late' ELSE '' END)"

# Observed schema of each output dataset: a column's type is widened by the values seen, it is
# nullable when sentinel values (< 1) appear, described once it has been seen three times, and
# stands where it was first seen.  {where} selects the observation period, if any.
_OBSERVED = f"""
SELECT table_name, name, type, nullable, description,
       CAST(row_number() OVER (PARTITION BY table_name ORDER BY first_seen, name) AS INTEGER) AS position
FROM (SELECT {_TABLE} AS table_name, {_COLUMN} AS name,
             CASE WHEN event_type IN ('signup', 'click')
                  THEN CASE WHEN max(value) >= 100 THEN 'VARCHAR' ELSE 'BIGINT' END
                  WHEN max(value) >= 100 THEN 'DOUBLE' ELSE 'FLOAT' END AS type,
             min(value) < 1 AS nullable, min(ts) AS first_seen,
             CASE WHEN count(*) >= 3 THEN concat(event_type, ' measure') ELSE '' END AS description
      FROM {{{{events}}}} WHERE {{where}}
      GROUP BY {_TABLE}, {_COLUMN}, event_type) o
"""

# Plain range predicates on the event time, so Parquet row-group statistics prune each period.
VIEWS["source_columns"] = _OBSERVED.format(where=f"ts < TIMESTAMP '{PERIOD_SPLIT}'")
VIEWS["target_columns"] = _OBSERVED.format(where=f"ts >= TIMESTAMP '{PERIOD_SPLIT}'")
VIEWS["all_columns"] = _OBSERVED.format(where="true")

# Catalog entries: one table per pipeline; tags are the event types that raised alerts.
VIEWS["catalog_tables"] = """
SELECT concat('p', CAST(user_id AS STRING)) AS table_name,
       concat('Output of pipeline p', CAST(user_id AS STRING), ', last fed by ', max_by(event_type, event_id)) AS description,
       array_sort(array_agg(DISTINCT event_type) FILTER (WHERE value > 100)) AS tags
FROM {events} GROUP BY user_id
"""

# Downstream usage: report_<type> jobs read every <type> column; audit jobs read what errors fed.
VIEWS["usage_edges"] = f"""
SELECT DISTINCT {_TABLE} AS table_name, concat('report_', event_type) AS pipeline, {_COLUMN} AS column_name FROM {{events}}
UNION ALL
SELECT DISTINCT {_TABLE} AS table_name, 'audit' AS pipeline, {_COLUMN} AS column_name FROM {{events}} WHERE event_type = 'error'
"""

# Where a dataset comes from: the first key of every event's properties names a feed.
VIEWS["upstream_edges"] = f"""
SELECT DISTINCT {_TABLE} AS table_name, concat('feed_', CAST(event_id % 4 AS STRING)) AS source FROM {{events}}
"""

# Queries against a dataset: its click and view events.
VIEWS["dataset_queries"] = f"""
SELECT {_TABLE} AS table_name, event_id FROM {{events}} WHERE event_type IN ('click', 'view')
"""

# Recorded task runs of each DAG: one per event of the user whose number is the DAG's, in several states.
VIEWS["task_runs"] = """
SELECT e.event_id AS run_id, e.user_id AS dag_id, concat(CAST(e.user_id AS STRING), '-', CAST(e.event_id % 5 AS STRING)) AS task_id,
       CAST(e.ts AS DATE) AS run_interval, e.ts,
       CASE e.event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' ELSE 'success' END AS status
FROM {events} e
"""

# Column lineage inside each conversation: turn t is computed from the turns it depends on.
VIEWS["lineage_edges"] = """
SELECT concat('c', CAST(conv_id AS STRING)) AS source_table, concat('t', CAST(pturn AS STRING)) AS source_column,
       concat('c', CAST(conv_id AS STRING)) AS target_table, concat('t', CAST(turn AS STRING)) AS target_column,
       CASE WHEN turn - pturn = 2 THEN 'skip' ELSE 'direct' END AS transform
FROM {turn_edges}
"""

# Tag state of documents and a batch of tag changes derived from their content.
VIEWS["doc_tags"] = """
SELECT 'table' AS entity_type, concat('doc', CAST(doc_id AS STRING)) AS entity_name,
       array(lang, source) AS tags
FROM {documents}
"""

VIEWS["tag_changes"] = """
SELECT 'table' AS entity_type, concat('doc', CAST(doc_id AS STRING)) AS entity_name,
       'add' AS action, array('pii') AS tags
FROM {documents} WHERE regexp_like(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+')
UNION ALL
SELECT 'table' AS entity_type, concat('doc', CAST(doc_id AS STRING)) AS entity_name,
       'remove' AS action, array(source) AS tags
FROM {documents} WHERE n_chars < 100
UNION ALL
SELECT 'table' AS entity_type, concat('doc', CAST(doc_id AS STRING)) AS entity_name,
       'set' AS action, array('long', lang) AS tags
FROM {documents} WHERE n_chars > 5000
"""

# Semi-structured drift source: after the split, purchases carry an extra numeric key, errors
# carry their key as a string and views have lost a key that they carried before.
VIEWS["events_v2"] = f"""
SELECT event_id, ts, user_id, event_type, value,
       CASE WHEN ts >= TIMESTAMP '{PERIOD_SPLIT}' AND event_type = 'purchase'
            THEN concat('{{{{"k": ', regexp_extract(props, '[0-9]+', 0), ', "amount": ', CAST(value AS STRING), '}}}}')
            WHEN ts >= TIMESTAMP '{PERIOD_SPLIT}' AND event_type = 'error'
            THEN concat('{{{{"k": "', regexp_extract(props, '[0-9]+', 0), '"}}}}')
            WHEN ts < TIMESTAMP '{PERIOD_SPLIT}' AND event_type = 'view'
            THEN concat('{{{{"k": ', regexp_extract(props, '[0-9]+', 0), ', "referrer": "r"}}}}')
            ELSE props END AS props
FROM {{events}}
"""

# The number in every event's properties, as text and missing for errors.
VIEWS["event_keys"] = """
SELECT CASE WHEN event_type <> 'error' THEN regexp_extract(props, '[0-9]+', 0) END AS key_text FROM {events}
"""

# DAG schedules for backfill: one DAG per conversation, schedule preset by id, a start date
# spread over a week and a range as long as the conversation.
VIEWS["dags"] = """
SELECT conv_id AS dag_id,
       CASE conv_id % 5 WHEN 0 THEN '@daily' WHEN 1 THEN '@hourly' WHEN 2 THEN '@weekly'
                        WHEN 3 THEN '@monthly' END AS schedule,
       DATE '2024-01-01' + CAST(conv_id % 7 AS INTEGER) AS start_date,
       DATE '2024-01-01' + CAST(conv_id % 7 AS INTEGER) + CAST(max(turn) AS INTEGER) AS end_date
FROM {conversations} GROUP BY conv_id
"""

# Events with a nested body.  After the split a number becomes a fraction, a list of objects loses a key and gains
# another, an object turns into text for errors, and some bodies are cut off.
VIEWS["nested_events"] = f"""
SELECT event_id, ts, CASE
  WHEN event_id % 97 = 0 THEN NULL
  WHEN event_id % 89 = 0 THEN substr(props, 1, 5)
  WHEN ts < TIMESTAMP '{PERIOD_SPLIT}' THEN concat('{{{{"user": {{{{"id": ', CAST(user_id AS STRING), ', "plan": null}}}}, "items": [{{{{"sku": "', event_type,
       '", "n": ', CAST(event_id % 7 AS STRING), '}}}}, {{{{"sku": 5}}}}], "marks": [[1, 2], [', CAST(event_id % 3 AS STRING), ']], "ok": true}}}}')
  WHEN event_type = 'error' THEN concat('{{{{"user": "u', CAST(user_id AS STRING), '", "items": [], "ok": "no"}}}}')
  ELSE concat('{{{{"user": {{{{"id": ', CAST(user_id AS STRING), '.5, "plan": "', event_type, '"}}}}, "items": [{{{{"sku": "', event_type,
       '", "price": 2.25}}}}], "marks": [[1], 3], "ok": false}}}}') END AS body
FROM {{events}}
"""

# A later version of the orders: some are gone, repriced, delivered twice or new.
VIEWS["orders_v2"] = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 401 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderkey % 499 <> 7
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 599 = 5
UNION ALL
SELECT -o_orderkey AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 701 = 9
"""

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def _deps(name: str) -> list[str]:
    text = VIEWS[name].replace("{{", "").replace("}}", "")
    return sorted(set(_PLACEHOLDER.findall(text)))


def view(spark: SparkSession, sf_dir: str, name: str, _cache: dict | None = None) -> DataFrame:
    """The derived view ``name`` as a lazy DataFrame over the tables in ``sf_dir``."""
    cache = {} if _cache is None else _cache
    if name in cache:
        return cache[name]
    frames = {}
    for dep in _deps(name):
        if dep in VIEWS:
            frames[dep] = view(spark, sf_dir, dep, cache)
        elif dep in TABLES:
            frames[dep] = load(spark, sf_dir, dep)
        else:
            raise KeyError(dep)
    df = spark.sql(VIEWS[name], **frames)
    cache[name] = df
    return df


def _duckdb_text(name: str) -> str:
    text = _PLACEHOLDER.sub(lambda m: m.group(1), VIEWS[name])
    text = text.replace("{{", "{").replace("}}", "}")
    # The two dialect differences the views touch: regex predicate and array constructor.
    text = text.replace("regexp_like(", "regexp_matches(")
    return re.sub(r"\barray\(", "list_value(", text)


def oracle_with(*names: str) -> str:
    """``WITH`` prefix defining ``names`` (and their dependencies) for DuckDB."""
    order: list[str] = []

    def visit(n):
        for d in _deps(n):
            if d in VIEWS:
                visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    body = ",\n".join(f"{n} AS ({_duckdb_text(n).strip()})" for n in order)
    return f"WITH {body}\n"
