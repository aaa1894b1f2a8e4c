"""As-of and interval joins over time-binned series.

Both deal rows by (series, time bin) instead of by series, so one series that holds a third of all rows is spread
over its bins; both are equi-joins and windows within a bin, never a nested loop.

``asof_join``: the last row of the other side at or before each row.  Within a bin one running window finds it; a
row with nothing before it in its bin takes the last row of the series' earlier bins, which travels as one
summary row per (series, bin) and is carried across bins.

``interval_join``: pairs of overlapping intervals of a series.  An interval is dealt to every bin it touches, and a
pair is kept in the bin where its later start lies, so it is found once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BIN_SECONDS = 86_400


def _bin(ts: Column, seconds: int) -> Column:
    """Number of the bin that a timestamp (of either kind) lies in."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000)).cast("bigint")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, take: list[str],
              tie: list[str], bin_seconds: int = BIN_SECONDS, tolerance_seconds: int | None = None) -> DataFrame:
    """All columns of ``left`` and ``take`` columns of the last ``right`` row of the same series with
    ``right_ts`` <= ``left_ts``; nulls where there is none (or none within the tolerance).

    Of right rows at the same time the greatest by ``tie`` counts.  Rows without a series or time match nothing.
    ``take`` columns must not be named like columns of ``left``.
    """
    clash = set(left.columns) & set(take)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    keys = [f"__k{i}" for i in range(len(on))]
    usable = F.lit(True)
    for k in keys:
        usable &= F.col(k).isNotNull()

    def side(df, ts, flag, own, other):
        # the sides' rows as structs of one union; right rows come first at equal times
        return df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(on, keys)], F.col(f"`{ts}`").alias("__ts"), F.lit(flag).alias("__side"), own, other)

    held = F.struct(F.col(f"`{right_ts}`").alias("__at"), *[F.col(f"`{c}`") for c in take])
    order = F.struct(F.col(f"`{right_ts}`"), *[F.col(f"`{c}`") for c in tie])
    r = side(right, right_ts, 0, held.alias("__r"), order.alias("__order")).where(usable & F.col("__ts").isNotNull()).withColumn("__bin", _bin(F.col("__ts"), bin_seconds))
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    l_all = side(left, left_ts, 1, row.alias("__l"), F.lit(None).alias("__none")).drop("__none").withColumn("__bin", _bin(F.col("__ts"), bin_seconds))
    lefts, alone = l_all.where(usable & F.col("__ts").isNotNull()), l_all.where(~(usable & F.col("__ts").isNotNull()))

    within = Window.partitionBy(*keys, "__bin").orderBy("__ts", "__side", "__order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = r.unionByName(lefts, allowMissingColumns=True)
    here = merged.withColumn("__here", F.last("__r", ignorenulls=True).over(within)).where("__side = 1")

    # one summary row per bin that either side touches; the last one before a bin is carried into it
    summary = (r.groupBy(*keys, "__bin").agg(F.max_by("__r", "__order").alias("__last"))
               .unionByName(lefts.select(*keys, "__bin").distinct(), allowMissingColumns=True)
               .groupBy(*keys, "__bin").agg(F.first("__last", ignorenulls=True).alias("__last")))
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn("__before", F.last("__last", ignorenulls=True).over(earlier)).select(
        *[F.col(k).alias(f"c{k}") for k in keys], F.col("__bin").alias("c__bin"), "__before")
    same = F.col("__bin") == F.col("c__bin")
    for k in keys:
        same &= F.col(k) == F.col(f"c{k}")
    found = here.join(carried, same, "left").withColumn("__m", F.coalesce("__here", "__before"))
    if tolerance_seconds is not None:
        apart = F.unix_micros(F.col("__ts").cast("timestamp")) - F.unix_micros(F.col("__m.__at").cast("timestamp"))
        found = found.withColumn("__m", F.when(apart <= tolerance_seconds * 1_000_000, F.col("__m")))
    out = found.select("__l", "__m").unionByName(alone.select("__l"), allowMissingColumns=True)
    return out.select(*[F.col(f"__l.`{c}`").alias(c) for c in left.columns], *[F.col(f"__m.`{c}`").alias(c) for c in take])


def interval_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str],
                  bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """Pairs (``l`` struct, ``r`` struct, ``overlap_start``, ``overlap_end``) of a series whose half-open intervals overlap.

    Empty or reversed intervals and those without series, start or end overlap nothing.
    """
    def dealt(df, span, name):
        start, end = (F.col(f"`{c}`") for c in span)
        last = _bin(end - F.expr("INTERVAL 0.000001 SECOND"), bin_seconds)
        rows = df.where(start < end).select(
            *[F.col(f"`{c}`").alias(f"__{name}{i}") for i, c in enumerate(on)], start.alias(f"__{name}_start"), end.alias(f"__{name}_end"),
            F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), F.explode(F.sequence(_bin(start, bin_seconds), last)).alias(f"__{name}_bin"))
        return rows

    a, b = dealt(left, left_span, "l"), dealt(right, right_span, "r")
    meet = F.col("__l_bin") == F.col("__r_bin")
    for i in range(len(on)):
        meet &= F.col(f"__l{i}") == F.col(f"__r{i}")
    start, end = F.greatest("__l_start", "__r_start"), F.least("__l_end", "__r_end")
    return (a.join(b, meet).where((start < end) & (_bin(start, bin_seconds) == F.col("__l_bin")))
            .select("l", "r", start.alias("overlap_start"), end.alias("overlap_end")))
