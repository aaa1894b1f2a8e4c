"""Table profiling (D0-D9): row count, nulls, distinct counts, numeric stats, top values.

Plan shape (one job, see README "Profile plan"):

* one global ``agg`` over the source computes the row count, per-column null counts and
  min / max / mean / castable counts of the numeric view of every column — a single scan,
  partial aggregation on the map side, one row out;
* per column a ``groupBy(value).count()`` branch (only that column is read from Parquet)
  feeds both the exact distinct count and the top-k values; both consumers sit in the same
  plan so the branch's shuffle is computed once and reused;
* the branches are unioned and joined to the one-row stats on the column name (tiny).

A hot value holding a third of a column's rows is harmless: the value count is
pre-aggregated per map partition, so it crosses the shuffle once per partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from vigil.functions.columns import fingerprint
from vigil.functions.typegate import numeric_value
from vigil.session import ensure_checkpoint_dir

TOP_K = 5
# Fixed value: top values are reported for numeric columns only up to this many distincts.
TOP_DISTINCT_MAX = 20
# Of the exact-size sample: rows that share a range of draws small enough to rank in one task.
SAMPLE_TIES = 10_000


def _columns(df: DataFrame, columns: list[str] | None) -> list[tuple[int, str, T.DataType]]:
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = columns if columns else [f.name for f in df.schema.fields]
    missing = [c for c in names if c not in fields]
    if missing:
        raise ValueError(f"unknown columns: {missing}")
    return [(i, c, fields[c]) for i, c in enumerate(names)]


def sample_rows(df: DataFrame, n: int, seed: int = 42, total: int | None = None) -> DataFrame:
    """Exactly ``n`` random rows (the exact-size sample), or ``df`` itself when ``n`` is 0 / None / >= rows.

    Every row draws a random number; the rows of the n smallest numbers are the sample.  One scan checkpoints the rows
    below a limit that a little more than n rows fall under (twice the limit if too few did), so about n rows are
    written, whatever the table's size, and Spark deletes them with the DataFrame (``cleanCheckpoints``).  The
    n-th smallest number is found from counts of the numbers' leading bits (at most 2**16 counts), and only the
    rows of the one count that straddles n are ranked among themselves, so no task holds the sample.  The
    count is an action.
    """
    if not n or n <= 0:
        return df
    total = df.count() if total is None else total
    if n >= total:
        return df
    ensure_checkpoint_dir(df.sparkSession)
    share = (n + 6 * n**0.5 + 20) / total
    while True:  # written once: the random numbers must not be drawn again
        drawn = df.withColumn("_draw", F.floor(F.rand(seed) * 2.0**52).cast("bigint"))
        drawn = drawn.where(F.col("_draw") < int(min(share, 1.0) * 2**52)).checkpoint()
        if share >= 1 or drawn.count() >= n:
            break
        share *= 2
    cut, below, shift = 0, 0, 52
    while shift > 0:  # narrow the range that holds the n-th smallest draw, 16 bits at a time
        step = min(16, shift)
        inside = drawn.where((F.col("_draw") >= cut) & (F.col("_draw") < cut + (1 << shift)))
        shift -= step
        counts = inside.groupBy(F.shiftright(F.col("_draw") - cut, shift).alias("b")).count().orderBy("b").collect()
        for r in counts:
            if below + r["count"] >= n:
                cut += r["b"] << shift
                break
            below += r["count"]
        if r["count"] <= SAMPLE_TIES:
            break
    sure = drawn.where(F.col("_draw") < cut).drop("_draw")
    edge = drawn.where((F.col("_draw") >= cut) & (F.col("_draw") < cut + (1 << shift)))
    return sure.union(edge.orderBy("_draw").limit(n - below).drop("_draw"))


def row_count(df: DataFrame) -> DataFrame:
    """``row_count`` as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


_SKETCHABLE = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _stats(df: DataFrame, cols, sketches: int = 0) -> DataFrame:
    """One scan: row count plus, per column, nulls and numeric min / max / mean / castable.

    With ``sketches`` = k > 0 the same aggregate also carries a HyperLogLog++ distinct
    count and an approx_top_k(k) sketch per column (mergeable partial states, so still one
    scan and no shuffle of values).  Returns one row per column (long form).
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    if sketches:
        for i, c, dt in cols:
            # k + 1 items: NULL can take one slot and is dropped below
            aggs += [F.approx_count_distinct(c).alias(f"_d{i}"),
                     F.call_function("approx_top_k", F.col(c), F.lit(sketches + 1)).alias(f"_k{i}")
                     if isinstance(dt, _SKETCHABLE) else F.lit(None).alias(f"_k{i}")]
    for i, c, dt in cols:
        v = numeric_value(F.col(c), dt)
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"_n{i}"),
            F.count(v).alias(f"_c{i}"),
            F.min(v).alias(f"_lo{i}"),
            F.max(v).alias(f"_hi{i}"),
            F.avg(v).alias(f"_mu{i}"),
        ]
    wide = df.agg(*aggs)

    def sketch_fields(i, dt):
        if not sketches:
            return []
        if isinstance(dt, _SKETCHABLE):
            # the sketch counts NULL as an item; top values are non-null values only
            items = F.filter(f"_k{i}", lambda x: x["item"].isNotNull())
            keyed = F.sort_array(F.transform(items, lambda x: F.struct(
                (-x["count"]).alias("n"), x["item"].cast("string").alias("value"))))
            top = F.slice(F.transform(keyed, lambda x: F.struct(x["value"].alias("value"), (-x["n"]).alias("count"))),
                          1, sketches)
        else:
            top = F.lit(None).cast("array<struct<value:string,count:bigint>>")
        return [F.col(f"_d{i}").alias("distinct_approx"), top.alias("top_approx")]

    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                 F.col(f"_n{i}").alias("null_count"), F.col(f"_c{i}").alias("castable_count"),
                 F.col(f"_lo{i}").alias("min"), F.col(f"_hi{i}").alias("max"),
                 F.col(f"_mu{i}").alias("mean_raw"), *sketch_fields(i, dt))
        for i, c, dt in cols
    ]
    return (wide.select(F.col("_rows").alias("row_count"), F.explode(F.array(*entries)).alias("s"))
                .select("row_count", "s.*"))


def _value_counts(df: DataFrame, c: str, dt: T.DataType, fingerprint_text: bool) -> DataFrame:
    """Per-value counts of one column: (_null flag, value as text, cnt)."""
    v = F.col(c)
    if fingerprint_text and isinstance(dt, T.StringType):
        agg = df.groupBy(fingerprint(v).alias("_k")).agg(F.count(F.lit(1)).alias("cnt"), F.any_value(v).alias("_v"))
    else:
        agg = df.groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("cnt"))
    return agg.select(F.col("_v").isNull().alias("_null"), F.col("_v").cast("string").alias("value"), "cnt")


def _branches(df: DataFrame, cols, k: int, with_distinct: bool, with_top: bool,
              fingerprint_text: bool):
    """Per column, one value-count aggregate feeding both the distinct count and the top-k.

    Both consumers read the aggregate exactly as produced (no filter pushed below it, the
    count column used by both), so the plans below the shuffle are identical and Spark
    reuses the exchange: each column is scanned and shuffled once.
    """
    distinct_parts, top_parts = [], []
    for i, c, dt in cols:
        vc = _value_counts(df, c, dt, fingerprint_text)
        if with_distinct:
            # a global aggregate (one row even for an empty table) carrying the column name
            distinct_parts.append(vc.agg(F.lit(c).alias("column_name"),
                                         F.count_if(~F.col("_null") & (F.col("cnt") > 0)).alias("distinct_count")))
        if with_top:
            # NULL group sorts last and is dropped after the limit (filtering first would be
            # pushed below the aggregate and break the exchange reuse).
            top_parts.append(
                vc.orderBy(F.col("_null").asc(), F.col("cnt").desc(), F.col("value").asc()).limit(k)
                  .filter(~F.col("_null"))
                  .select(F.lit(c).alias("column_name"), "value", F.col("cnt").alias("count")))
    union = lambda parts: reduce(DataFrame.unionByName, parts) if parts else None
    return union(distinct_parts), union(top_parts)


def _branches_long(df: DataFrame, cols, k: int, fingerprint_text: bool):
    """All columns stacked as (column_name, value text) and counted in one ``groupBy``.  Distinct
    counts and top-k both read that aggregate unchanged (NULLs ranked last and dropped after the
    group limit) so its shuffle is shared.  Adding 0.0 makes -0.0 the 0.0 that it equals."""
    def entry(c, dt):
        v = F.col(c) + F.lit(0.0).cast(dt) if isinstance(dt, T.FractionalType) and not isinstance(dt, T.DecimalType) else F.col(c)
        fields = [F.lit(c).alias("column_name"), v.cast("string").alias("value")]
        if fingerprint_text:
            key = fingerprint(F.col(c)) if isinstance(dt, T.StringType) else v
            fields.append(key.cast("string").alias("key"))
        return F.struct(*fields)

    stacked = df.select(F.explode(F.array(*[entry(c, dt) for _, c, dt in cols])).alias("x")).select("x.*")
    if fingerprint_text:
        vc = stacked.groupBy("column_name", "key").agg(F.count(F.lit(1)).alias("cnt"), F.max("value").alias("value"))
    else:
        vc = stacked.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    distinct = vc.groupBy("column_name").agg(
        F.count_if(F.col("value").isNotNull() & (F.col("cnt") > 0)).alias("distinct_count"))
    w = Window.partitionBy("column_name").orderBy(F.col("value").isNull().asc(), F.col("cnt").desc(),
                                                  F.col("value").asc())
    top = (vc.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
             .filter(F.col("value").isNotNull())
             .select("column_name", "value", F.col("cnt").alias("count")))
    return distinct, top


def _ranked_top(top: DataFrame) -> DataFrame:
    """Rank the <= k rows per column (bounded: k rows per column)."""
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value").asc())
    return top.withColumn("rank", F.row_number().over(w))


def profile(df: DataFrame, columns: list[str] | None = None, sample_size: int | None = None,
            table: str | None = None, approx: bool = False, top_k: int = TOP_K,
            seed: int = 42, fingerprint_text: bool = False, long_form: bool = False) -> DataFrame:
    """D0 ``profile_data``: one row per profiled column.

    Columns: table, column_name, position, row_count (sample size when sampling),
    total_rows, null_count, null_rate (round 4), distinct_count, castable_count, type
    ('numeric' when at least one value is a number), min, max, mean (round 2),
    top_values array<struct<value string, count bigint>> — present when the column is not
    numeric or has at most 20 distinct values; ordered by count desc, value asc.

    Plans: per-column branches (default), one long-form aggregate with a single value shuffle
    (``long_form``, same answers, for tables of very many columns), or a single scan of
    sketches (``approx``).
    """
    cols = _columns(df, columns)
    data = df.select(*[c for _, c, _ in cols])
    total = None
    if sample_size and sample_size > 0:
        n_rows = data.count()
        sampled = sample_rows(data, sample_size, seed, total=n_rows)
        if sampled is not data:
            # the sample is drawn from a written table, so every statistic sees the same rows
            total = n_rows
            data = sampled
    if approx:
        # Single scan, no value shuffle: every statistic is a mergeable aggregate state.
        out = (_stats(data, cols, sketches=top_k)
               .withColumnRenamed("distinct_approx", "distinct_count").withColumnRenamed("top_approx", "_top"))
    else:
        stats = _stats(data, cols)
        if long_form:
            distinct, top = _branches_long(data, cols, top_k, fingerprint_text)
        else:
            distinct, top = _branches(data, cols, top_k, True, True, fingerprint_text)
        top_lists = (_ranked_top(top).groupBy("column_name")
                     .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("_t"))
                     .select("column_name",
                             F.transform("_t", lambda x: F.struct(x["value"].alias("value"),
                                                                  x["count"].alias("count"))).alias("_top")))
        out = stats.join(distinct, "column_name", "left").join(top_lists, "column_name", "left")
    is_numeric = F.col("castable_count") > 0
    null_rate = F.when(F.col("row_count") > 0,
                       F.round(F.col("null_count") / F.col("row_count"), 4)).otherwise(F.lit(0.0))
    return out.select(
        F.lit(table).cast("string").alias("table"),
        "column_name", "position", "row_count",
        (F.lit(total) if total is not None else F.col("row_count")).cast("bigint").alias("total_rows"),
        # (the long form has no group at all for an empty table: 0 distinct values)
        "null_count", null_rate.alias("null_rate"),
        F.coalesce(F.col("distinct_count"), F.lit(0).cast("bigint")).alias("distinct_count"), "castable_count",
        F.when(is_numeric, F.lit("numeric")).alias("type"),
        F.when(is_numeric, F.col("min")).alias("min"),
        F.when(is_numeric, F.col("max")).alias("max"),
        F.when(is_numeric, F.round("mean_raw", 2)).alias("mean"),
        F.when((~is_numeric | (F.col("distinct_count") <= TOP_DISTINCT_MAX))
               & (F.size(F.coalesce("_top", F.array())) > 0), F.col("_top")).alias("top_values"),
    )


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column, from one scan: row_count, null_count, castable_count, min, max, mean_raw."""
    return _stats(df, _columns(df, columns))


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, position, row_count, null_count, null_rate) from one scan."""
    cols = _columns(df, columns)
    aggs = [F.count(F.lit(1)).alias("_rows")] + [
        F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c, _ in cols]
    wide = df.agg(*aggs)
    long = wide.select(F.col("_rows").alias("row_count"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                 F.col(f"_n{i}").alias("null_count")) for i, c, _ in cols])).alias("s"))
    return long.select(
        "s.column_name", "s.position", "row_count", "s.null_count",
        F.when(F.col("row_count") > 0, F.round(F.col("s.null_count") / F.col("row_count"), 4))
         .otherwise(F.lit(0.0)).alias("null_rate"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approx: bool = False,
                    fingerprint_text: bool = False) -> DataFrame:
    """Exact (per-column branches) or approximate (HyperLogLog++) distinct counts."""
    cols = _columns(df, columns)
    if approx:
        row = df.agg(*[F.approx_count_distinct(c).alias(f"_d{i}") for i, c, _ in cols])
        return row.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"_d{i}").alias("distinct_count"))
            for i, c, _ in cols])).alias("d")).select("d.*")
    distinct, _ = _branches(df.select(*[c for _, c, _ in cols]), cols, TOP_K, True, False,
                            fingerprint_text)
    return distinct


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric view of every column — castable count, min, max, mean (round 2)."""
    cols = _columns(df, columns)
    s = _stats(df.select(*[c for _, c, _ in cols]), cols)
    is_numeric = F.col("castable_count") > 0
    return s.select("column_name", "position", "castable_count",
                    F.when(is_numeric, F.lit("numeric")).alias("type"),
                    "min", "max", F.round("mean_raw", 2).alias("mean"))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = TOP_K,
               only_categorical: bool = True, fingerprint_text: bool = False,
               approx: bool = False) -> DataFrame:
    """Tidy top-k rows (column_name, rank, value, count).

    With ``only_categorical`` the reference's gate applies: a column reports top values
    when it is not numeric or has at most 20 distinct values.  ``approx`` reads the top-k
    and distinct counts from sketches of one aggregate (single scan, estimated counts).
    """
    cols = _columns(df, columns)
    data = df.select(*[c for _, c, _ in cols])
    if approx:
        s = _stats(data, cols, sketches=k)
        if only_categorical:
            s = s.filter((F.col("castable_count") == 0) | (F.col("distinct_approx") <= TOP_DISTINCT_MAX))
        return (s.select("column_name", F.posexplode("top_approx").alias("p", "t"))
                 .select("column_name", (F.col("p") + 1).alias("rank"), "t.value", "t.count"))
    if not only_categorical:
        _, top = _branches(data, cols, k, False, True, fingerprint_text)
        return _ranked_top(top).select("column_name", "rank", "value", "count")
    # The gate needs castable counts (one aggregate row) and each column's distinct count, which comes
    # from the same value counts as its top-k; both enter the branch as scalar subqueries.
    castable = data.agg(F.struct(*[F.count(numeric_value(F.col(c), dt)).alias(f"c{i}") for i, c, dt in cols])).scalar()
    parts = []
    for i, c, dt in cols:
        _, top = _branches(data, [(i, c, dt)], k, False, True, fingerprint_text)
        vc = _value_counts(data, c, dt, fingerprint_text)
        distinct = vc.agg(F.count_if(~F.col("_null") & (F.col("cnt") > 0))).scalar()
        parts.append(top.where((castable.getField(f"c{i}") == 0) | (distinct <= TOP_DISTINCT_MAX)))
    return _ranked_top(reduce(DataFrame.unionByName, parts)).select("column_name", "rank", "value", "count")


def profile_many(tables: dict[str, DataFrame], **kwargs) -> DataFrame:
    """Profiles of several tables as one DataFrame (one Spark job, keyed by table)."""
    parts = [profile(df, table=name, **kwargs) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def render_top(col: str = "top_values") -> Column:
    """Flatten top values to 'value=count;...' (for text reports and engine comparisons)."""
    return F.array_join(F.transform(col, lambda x: F.concat(x["value"], F.lit("="),
                                                             x["count"].cast("string"))), ";")
