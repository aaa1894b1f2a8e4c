import pytest
from pyspark.errors import PySparkException

from vigil.operators import rules as RU


def result_map(df):
    return {r["rule_index"]: r for r in df.collect()}


def test_not_null_two_failures(users):
    r = result_map(RU.validate_rules(users, [RU.rule("not_null", "email")]))[0]
    assert r["passed"] is False and r["failures"] == 2


def test_unique_passes(users):
    assert result_map(RU.validate_rules(users, [RU.rule("unique", "id")]))[0]["passed"] is True


def test_multiple_and_scorecard(users):
    res = RU.validate_rules(users, [RU.rule("not_null", "email"), RU.rule("min", "age", value=0),
                                    RU.rule("max", "age", value=120)])
    m = result_map(res)
    assert [m[i]["failures"] for i in range(3)] == [2, 1, 1]
    sc = RU.scorecard(res).collect()[0]
    assert (sc["total_rules"], sc["passed"], sc["failed"], sc["pass_rate"]) == (3, 0, 3, 0.0)


def test_accepted_values(users):
    r = result_map(RU.validate_rules(users, [RU.rule("accepted_values", "status", values=["open", "closed"])]))[0]
    assert r["passed"] is False and r["failures"] == 1
    typed = result_map(RU.validate_rules(users, [RU.rule("accepted_values", "id", values=["1", "2", "abc"])]))[0]
    assert typed["failures"] == 6


def test_empty_values_fail_all_non_null(users):
    assert result_map(RU.validate_rules(users, [RU.rule("accepted_values", "email", values=[])]))[0]["failures"] == 6


def test_empty_rules_pass_rate_one(users):
    sc = RU.scorecard(RU.validate_rules(users, [])).collect()[0]
    assert sc["total_rules"] == 0 and sc["pass_rate"] == 1.0


def test_unknown_rule_rejected(users):
    with pytest.raises(ValueError):
        RU.validate_rules(users, [RU.rule("bogus", "id")])
    with pytest.raises(ValueError):
        RU.validate_rules(users, [RU.rule("min", "age")])


def test_custom_sql_and_error(users):
    res = result_map(RU.validate_rules(users, [
        RU.rule("custom_sql", sql="SELECT * FROM {{table}} WHERE age < 0"),
        RU.rule("custom_sql", sql="SELECT nope FROM {{table}}")]))
    assert res[0]["failures"] == 1 and res[1]["error"] and res[1]["passed"] is False


def test_custom_sql_that_fails_on_the_data_leaves_other_rules_alone(users):
    res = result_map(RU.validate_rules(users, [
        RU.rule("not_null", "email"), RU.rule("custom_sql", sql="SELECT * FROM {{table}} WHERE 1 DIV (id - 3) > 5"),
        RU.rule("custom_sql", sql="SELECT * FROM {{table}} WHERE age > 100")]))
    assert res[0]["failures"] == 2 and res[2]["failures"] == 1
    assert "DIVIDE_BY_ZERO" in res[1]["error"] and (res[1]["passed"], res[1]["failures"]) == (False, 0)


def test_failed_rows_read_the_table_once_for_all_row_rules(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    df = RU.failed_rows(li, [RU.rule("max", "l_quantity", value=40), RU.rule("not_null", "l_shipdate"), RU.rule("min", "l_tax", value=0.01)])
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Scan parquet") == 1


def test_unique_counts_surplus_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (2,), (None,), (None,)], "k int")
    assert result_map(RU.validate_rules(df, [RU.rule("unique", "k")]))[0]["failures"] == 3


def test_failed_rows_and_quarantine(users):
    rules = [RU.rule("not_null", "email"), RU.rule("max", "age", value=120)]
    fr = sorted((r["rule_index"], r["value"]) for r in RU.failed_rows(users, rules).collect())
    assert fr == [(0, "NULL"), (0, "NULL"), (1, "140")]
    q = {r["id"]: r["failed_rules"] for r in RU.quarantine(users, rules + [RU.rule("unique", "status")]).collect()}
    assert q[3] == ["0:not_null", "2:unique"] and q[5] == ["1:max"]


def test_custom_sql_keeps_other_braces(spark):
    df = spark.createDataFrame([('{"k": 1}',), ("x",)], "j string")
    r = result_map(RU.validate_rules(df, [RU.rule("custom_sql", sql="SELECT * FROM {{table}} WHERE j = '{\"k\": 1}'")]))[0]
    assert r["error"] is None and r["failures"] == 1


def test_columns_from_spark_catalog(spark, users):
    from vigil.operators import catalog as CA
    users.createOrReplaceTempView("vigil_users_view")
    cols = CA.columns_from_catalog(spark).filter("table_name = 'vigil_users_view'")
    assert [r["name"] for r in cols.orderBy("position").collect()] == ["id", "email", "age", "status"]
    spark.catalog.dropTempView("vigil_users_view")


def test_errors_beside_the_rule_fail_the_validation(spark, users, monkeypatch):
    """Only errors of the query or its values become rows; what the cluster does wrong is not a verdict."""
    def lost(*_, **__):
        raise PySparkException("executor lost")
    with monkeypatch.context() as m:
        m.setattr(type(spark), "sql", lost)
        with pytest.raises(PySparkException, match="executor lost"):
            RU.validate_rules(users, [RU.rule("custom_sql", sql="SELECT * FROM {{table}} WHERE age < 0")])

    def dies(x):
        raise RuntimeError("disk full")
    spark.udf.register("vigil_dies", dies, "int")
    with pytest.raises(PySparkException):
        RU.validate_rules(users, [RU.rule("custom_sql", sql="SELECT * FROM {{table}} WHERE vigil_dies(age) > 1")]).collect()
    failed = result_map(RU.validate_rules(users, [RU.rule("custom_sql", sql="SELECT * FROM {{table}} WHERE raise_error('mine') IS NULL")]))[0]
    assert not failed["passed"] and "mine" in failed["error"]
