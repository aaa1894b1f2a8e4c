from pyspark.sql import functions as F

from vigil.operators import profile as P
from conftest import plan_text


def by_col(df):
    return {r["column_name"]: r for r in df.collect()}


def test_profile_goldens(users):
    p = by_col(P.profile(users, table="people"))
    assert p["email"]["null_count"] == 2 and p["email"]["null_rate"] == 0.25
    assert p["age"]["min"] == -3 and p["age"]["max"] == 140 and p["age"]["null_count"] == 1
    assert p["id"]["distinct_count"] == 8
    assert p["id"]["row_count"] == 8 and p["id"]["table"] == "people"
    # numeric with few distincts still gets top values; text never gets numeric stats
    assert p["status"]["type"] is None and p["status"]["min"] is None
    top = [(t["value"], t["count"]) for t in p["status"]["top_values"]]
    assert top == [("open", 5), ("closed", 2), ("lost", 1)]


def test_profile_columns_in_order(users):
    p = P.profile(users, columns=["email", "age"])
    assert [r["column_name"] for r in p.orderBy("position").collect()] == ["email", "age"]


def test_sample_is_exact_and_consistent(users):
    p = P.profile(users, sample_size=5).collect()
    assert all(r["row_count"] == 5 and r["total_rows"] == 8 for r in p)
    assert P.sample_rows(users, 0) is users and P.sample_rows(users, 100) is users


def test_sample_takes_distinct_rows_and_exactly_n(spark):
    df = spark.range(0, 50_000, 1, 8)
    for n in (1, 777, 49_999):
        rows = [r["id"] for r in P.sample_rows(df, n).collect()]
        assert len(rows) == len(set(rows)) == n
    assert abs(sum(r["id"] for r in P.sample_rows(df, 20_000).collect()) / 20_000 - 25_000) < 500


def test_wide_tables_get_the_same_answers(spark):
    wide = spark.createDataFrame([(0.0, "b"), (-0.0, "b"), (7.5, None), (None, "")], "x double, t string").select(
        *[F.col("x").alias(f"x{i}") for i in range(40)], *[F.col("t").alias(f"t{i}") for i in range(30)])
    plain, long = by_col(P.profile(wide)), by_col(P.profile(wide, long_form=True))
    assert plain == long and plain["x39"]["distinct_count"] == 2
    assert by_col(P.profile(wide, long_form=True, fingerprint_text=True)) == long


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "a int, b string")
    p = by_col(P.profile(empty))
    assert p["a"]["row_count"] == 0 and p["a"]["null_rate"] == 0.0 and p["a"]["distinct_count"] == 0
    nulls = spark.createDataFrame([(None,), (None,)], "c string")
    c = by_col(P.profile(nulls))["c"]
    assert c["distinct_count"] == 0 and c["type"] is None and c["top_values"] is None


def test_mixed_text_numbers(spark):
    df = spark.createDataFrame([("12",), (" 7 ",), ("n/a",), ("1d",), ("0x1p3",), (None,)], "t string")
    s = by_col(P.numeric_stats(df))["t"]
    assert s["castable_count"] == 2 and s["min"] == 7.0 and s["max"] == 12.0 and s["type"] == "numeric"


def test_typegate_dates_are_not_numeric(spark):
    df = spark.createDataFrame([("2024-01-01",)], "d string").select(F.to_date("d").alias("d"))
    s = by_col(P.profile(df))["d"]
    assert s["type"] is None and s["top_values"][0]["value"] == "2024-01-01"


def test_distinct_exact_and_approx(users):
    exact = {r["column_name"]: r["distinct_count"] for r in P.distinct_counts(users).collect()}
    assert exact == {"id": 8, "email": 6, "age": 7, "status": 3}
    approx = {r["column_name"]: r["distinct_count"] for r in P.distinct_counts(users, approx=True).collect()}
    assert approx["id"] == 8


def test_fingerprinted_text_matches_plain(spark):
    df = spark.createDataFrame([("x" * 5000,), ("x" * 5000,), ("y",)], "t string")
    a = by_col(P.profile(df, fingerprint_text=True))["t"]
    b = by_col(P.profile(df))["t"]
    assert a["distinct_count"] == b["distinct_count"] == 2
    assert a["top_values"][0]["count"] == 2


def test_branch_scans_read_one_column(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    d = P.distinct_counts(li, ["l_orderkey", "l_returnflag"])
    d.collect()
    text = d._jdf.queryExecution().executedPlan().toString()
    assert "struct<l_orderkey:bigint>" in text and "struct<l_returnflag:string>" in text


def test_profile_many_keys_by_table(users, metrics):
    out = P.profile_many({"u": users, "m": metrics})
    assert sorted({r["table"] for r in out.collect()}) == ["m", "u"]


def test_approx_profile_single_scan(spark, users):
    p = by_col(P.profile(users, approx=True))
    assert p["id"]["distinct_count"] == 8 and p["email"]["null_count"] == 2
    assert [(t["value"], t["count"]) for t in p["status"]["top_values"]] == [("open", 5), ("closed", 2), ("lost", 1)]
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    df = P.profile(li, approx=True)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Scan parquet") == 1
    tv = P.top_values(users, approx=True)
    assert [(r["column_name"], r["rank"], r["value"]) for r in tv.filter("column_name = 'status'").orderBy("rank").collect()] == \
        [("status", 1, "open"), ("status", 2, "closed"), ("status", 3, "lost")]


def test_long_form_matches_branches(spark, users):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    for df in (users, li):
        a = {r["column_name"]: (r["distinct_count"], r["top_values"]) for r in P.profile(df).collect()}
        b = {r["column_name"]: (r["distinct_count"], r["top_values"]) for r in P.profile(df, long_form=True).collect()}
        assert a == b
    d = P.profile(li, long_form=True)
    d.collect()
    final = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Scan parquet") == 2 and "ReusedExchange" in final


def test_distinct_and_top_share_each_column_shuffle(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    df = P.profile(li)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") == len(li.columns)
