"""DuckDB SQL for the profile family, generated from a column list.

The SQL is written independently of the Spark operators: one value-count CTE per column,
the same numeric gate (plain-decimal pattern for text), ties ordered by value text.
"""

from __future__ import annotations

from vigil.functions.typegate import NUMERIC_STRING_PATTERN

NUMERIC = "numeric"
TEXT = "text"
OTHER = "other"


def _num_expr(col: str, kind: str) -> str:
    if kind == NUMERIC:
        return f'CAST("{col}" AS DOUBLE)'
    if kind == TEXT:
        return (f"CASE WHEN regexp_matches(\"{col}\", '{NUMERIC_STRING_PATTERN}') "
                f'THEN TRY_CAST("{col}" AS DOUBLE) END')
    return "CAST(NULL AS DOUBLE)"


def profile_sql(source: str, table: str | None, columns: list[tuple[str, str]],
                with_top: bool = True) -> str:
    """Profile rows for ``columns`` [(name, kind)] of relation ``source``."""
    ctes = [f"n AS (SELECT count(*) AS row_count FROM {source})"]
    selects = []
    for i, (c, kind) in enumerate(columns):
        ctes.append(
            f"s{i} AS (SELECT count(*) FILTER (WHERE \"{c}\" IS NULL) AS null_count, count(v) AS castable_count,"
            f" min(v) AS mn, max(v) AS mx, avg(v) AS mu FROM (SELECT \"{c}\", {_num_expr(c, kind)} AS v FROM {source}))")
        ctes.append(
            f"vc{i} AS (SELECT CAST(\"{c}\" AS VARCHAR) AS value, count(*) AS cnt FROM {source}"
            f" WHERE \"{c}\" IS NOT NULL GROUP BY \"{c}\")")
        ctes.append(
            f"t{i} AS (SELECT string_agg(value || '=' || CAST(cnt AS VARCHAR), ';' ORDER BY cnt DESC, value ASC) AS top"
            f" FROM (SELECT * FROM vc{i} ORDER BY cnt DESC, value ASC LIMIT 5))")
        tbl = "CAST(NULL AS VARCHAR)" if table is None else f"'{table}'"
        top = (f"CASE WHEN s{i}.castable_count = 0 OR (SELECT count(*) FROM vc{i}) <= 20 THEN t{i}.top END"
               if with_top else "NULL")
        selects.append(
            f"SELECT {tbl} AS \"table\", '{c}' AS column_name, {i} AS position, n.row_count,"
            f" n.row_count AS total_rows, s{i}.null_count,"
            f" CASE WHEN n.row_count > 0 THEN round(s{i}.null_count / n.row_count, 4) ELSE 0.0 END AS null_rate,"
            f" (SELECT count(*) FROM vc{i}) AS distinct_count, s{i}.castable_count,"
            f" CASE WHEN s{i}.castable_count > 0 THEN 'numeric' END AS type,"
            f" s{i}.mn AS \"min\", s{i}.mx AS \"max\", round(s{i}.mu, 2) AS mean,"
            f" {top} AS top_values"
            f" FROM n, s{i}, t{i}")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(selects)


def null_rates_sql(source: str, columns: list[str]) -> str:
    parts = []
    for i, c in enumerate(columns):
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS position, count(*) AS row_count,"
            f" count(*) FILTER (WHERE \"{c}\" IS NULL) AS null_count,"
            f" CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE \"{c}\" IS NULL) / count(*), 4) ELSE 0.0 END AS null_rate"
            f" FROM {source}")
    return "\nUNION ALL\n".join(parts)


def distinct_sql(source: str, columns: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT \"{c}\") AS distinct_count FROM {source}"
        for c in columns)


def numeric_stats_sql(source: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns):
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS position, count(v) AS castable_count,"
            f" CASE WHEN count(v) > 0 THEN 'numeric' END AS type, min(v) AS \"min\", max(v) AS \"max\","
            f" round(avg(v), 2) AS mean FROM (SELECT {_num_expr(c, kind)} AS v FROM {source})")
    return "\nUNION ALL\n".join(parts)


def top_values_sql(source: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for c, kind in columns:
        parts.append(
            f"SELECT column_name, rank, value, count FROM ("
            f"SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY cnt DESC, value ASC) AS INTEGER) AS rank,"
            f" value, cnt AS count,"
            f" (SELECT count(*) FROM (SELECT DISTINCT \"{c}\" FROM {source} WHERE \"{c}\" IS NOT NULL)) AS d,"
            f" (SELECT count({_num_expr(c, kind)}) FROM {source}) AS castable"
            f" FROM (SELECT CAST(\"{c}\" AS VARCHAR) AS value, count(*) AS cnt FROM {source}"
            f" WHERE \"{c}\" IS NOT NULL GROUP BY \"{c}\")) x WHERE rank <= 5 AND (castable = 0 OR d <= 20)")
    return "\nUNION ALL\n".join(parts)
