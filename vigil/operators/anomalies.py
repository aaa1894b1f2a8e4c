"""Z-score anomaly detection.

Global baseline: the mean / sample stddev / count are one aggregate evaluated as a scalar
subquery, so the detection pass is a plain filter over the scan — no join, no window, no
single-partition exchange.  Per-series baseline: ``groupBy(key).agg`` joined back on the
key; the baseline has one row per series, so AQE broadcasts it when small and splits a
skewed series on the probe side when it is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

METHODS = ("zscore",)
# Fixed value: an anomaly is "high" beyond this multiple of the threshold, else "medium".
HIGH_FACTOR = 1.5


def _check(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unsupported method {method!r}; only 'zscore' is implemented")


def metric_baseline(df: DataFrame, metric_column: str, by: list[str] | None = None) -> DataFrame:
    """(by..., total_points, mean, stddev) over non-null metric values."""
    m = F.col(metric_column)
    base = df.filter(m.isNotNull())
    aggs = [F.count(F.lit(1)).alias("total_points"), F.avg(m).alias("mean"),
            F.stddev_samp(m).alias("stddev")]
    return base.groupBy(*(by or [])).agg(*aggs)


def _is_anomaly(z: Column, threshold: float) -> Column:
    return F.abs(z) > F.lit(threshold)


def _severity(z: Column, threshold: float) -> Column:
    return F.when(F.abs(z) > F.lit(threshold * HIGH_FACTOR), "high").otherwise("medium")


def detect_anomalies(df: DataFrame, time_column: str, metric_column: str,
                     method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """Rows with abs(z) > threshold (strict), with severity and total_points.

    Output: timestamp (native type of ``time_column``), value, z_score (round 3),
    severity, total_points.  Zero or undefined stddev flags nothing.
    """
    _check(method)
    m = F.col(metric_column)
    base = df.filter(m.isNotNull())
    stats = base.agg(F.struct(F.avg(m).alias("mean"), F.stddev_samp(m).alias("stddev"),
                              F.count(F.lit(1)).alias("n")).alias("s")).scalar()
    z = (m - stats["mean"]) / F.nullif(stats["stddev"], F.lit(0.0))
    return (base.select(F.col(time_column).alias("timestamp"), m.alias("value"), z.alias("_z"),
                        stats["n"].alias("total_points"))
                .filter(_is_anomaly(F.col("_z"), threshold))
                .select("timestamp", "value", F.round("_z", 3).alias("z_score"),
                        _severity(F.col("_z"), threshold).alias("severity"), "total_points"))


def detect_anomalies_by_series(df: DataFrame, time_column: str, metric_column: str,
                               by: list[str], method: str = "zscore",
                               threshold: float = 3.0) -> DataFrame:
    """The same test with a baseline per series key."""
    _check(method)
    m = F.col(metric_column)
    base = df.filter(m.isNotNull())
    stats = metric_baseline(df, metric_column, by)
    joined = base.select(*by, F.col(time_column).alias("timestamp"), m.alias("value")).join(stats, by)
    z = (F.col("value") - F.col("mean")) / F.nullif(F.col("stddev"), F.lit(0.0))
    return (joined.withColumn("_z", z)
                  .filter(_is_anomaly(F.col("_z"), threshold))
                  .select(*by, "timestamp", "value", F.round("_z", 3).alias("z_score"),
                          _severity(F.col("_z"), threshold).alias("severity"), "total_points"))


def anomaly_summary(df: DataFrame, time_column: str, metric_column: str,
                    method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """One row: total_points (true count, also when stddev is 0), anomalies, high, medium."""
    _check(method)
    m = F.col(metric_column)
    base = df.filter(m.isNotNull())
    stats = base.agg(F.struct(F.avg(m).alias("mean"), F.stddev_samp(m).alias("stddev")).alias("s")).scalar()
    z = F.abs((m - stats["mean"]) / F.nullif(stats["stddev"], F.lit(0.0)))
    return base.agg(
        F.count(F.lit(1)).alias("total_points"),
        F.count_if(z > F.lit(threshold)).alias("anomalies"),
        F.count_if(z > F.lit(threshold * HIGH_FACTOR)).alias("high"),
        F.count_if((z > F.lit(threshold)) & (z <= F.lit(threshold * HIGH_FACTOR))).alias("medium"),
        F.lit(method).alias("method"), F.lit(float(threshold)).alias("threshold"))
