import pytest
from pyspark.sql import functions as F

from vigil.operators import lint as LT
from vigil.operators import schema as SC

META = "table_name string, name string, type string, nullable boolean, description string, position int"


def meta(spark, cols, table="t"):
    return spark.createDataFrame([(table, *c, i) for i, c in enumerate(cols)], META)


def test_drift_goldens(spark):
    src = meta(spark, [("id", "INTEGER", True, ""), ("old_col", "VARCHAR", True, ""), ("amount", "INTEGER", True, "")])
    tgt = meta(spark, [("id", "INTEGER", True, ""), ("email", "VARCHAR", True, ""), ("amount", "FLOAT", True, "")])
    d = {r["name"]: (r["change"], r["changes"]) for r in SC.detect_drift(src, tgt).collect()}
    assert d == {"email": ("added", []), "old_col": ("removed", []),
                 "amount": ("modified", ["type: INTEGER -> FLOAT"])}
    s = SC.drift_summary(src, tgt).collect()[0]
    assert (s["total_source"], s["total_target"], s["added"], s["removed"], s["modified"], s["has_drift"]) == \
        (3, 3, 1, 1, 1, True)


def test_description_only_and_nullable_default(spark):
    src = meta(spark, [("a", "INT", None, "x")])
    tgt = meta(spark, [("a", "INT", True, "y")])
    assert SC.detect_drift(src, tgt).count() == 0
    d = SC.detect_drift(src, tgt, compare=("type", "nullable", "description")).collect()[0]
    assert d["changes"] == ["description: x -> y"]
    n = SC.detect_drift(meta(spark, [("a", "INT", True, "")]), meta(spark, [("a", "INT", False, "")])).collect()[0]
    assert n["changes"] == ["nullable: True -> False"]


def test_migration_plan(spark):
    src = meta(spark, [("id", "INTEGER", True, ""), ("old_col", "VARCHAR", True, ""), ("n", "INTEGER", True, "")])
    tgt = meta(spark, [("id", "INTEGER", False, ""), ("email", "VARCHAR", True, ""), ("n", "BIGINT", True, "")])
    plan = [r["statement"] for r in SC.migration_plan(src, tgt).orderBy("seq").collect()]
    assert plan == ["ALTER TABLE `t` DROP COLUMN IF EXISTS `old_col`;",
                    "ALTER TABLE `t` ADD COLUMN `email` VARCHAR;",
                    "ALTER TABLE `t` ALTER COLUMN `id` SET NOT NULL;",
                    "ALTER TABLE `t` ALTER COLUMN `n` TYPE BIGINT;"]
    # source order, not name order
    drops = SC.migration_plan(meta(spark, [("zeta", "INT", True, ""), ("alpha", "INT", True, ""), ("id", "INT", True, "")]),
                              meta(spark, [("id", "INT", True, "")])).orderBy("seq").collect()
    assert [r["statement"].split("`")[3] for r in drops] == ["zeta", "alpha"]
    create = SC.migration_plan(meta(spark, [("a", "INT", True, "")], "other"),
                               meta(spark, [("id", "INTEGER", False, ""), ("name", "VARCHAR", True, "")], "new"))
    stm = {r["table_name"]: r["statement"] for r in create.collect()}
    assert stm["new"] == "CREATE TABLE `new` (`id` INTEGER NOT NULL, `name` VARCHAR);"


def test_conform_and_safety(spark):
    df = spark.createDataFrame([(1, "12", None, "x"), (2, "n/a", "s", "y")], "id int, v string, seg string, gone string")
    target = [("id", "bigint"), ("v", "int"), ("seg", "string", False), ("new", "double")]
    out = SC.conform(df, target)
    assert out.columns == ["id", "v", "seg", "new"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 12, None, None), (2, None, "s", None)]
    safety = {(r["column"], r["change"]): r["rows_affected"] for r in SC.migration_safety(df, target).collect()}
    assert safety == {("id", "cast"): 0, ("v", "cast"): 1, ("seg", "set_not_null"): 1, ("gone", "drop"): 2}


def test_json_key_drift(spark):
    df = spark.createDataFrame([("b", '{"k": 1}'), ("a", '{"k": "1", "amount": 2.5}')], "p string, j string")
    d = {r["key"]: (r["types_before"], r["types_after"], r["change"])
         for r in SC.json_key_drift(df, "j", F.when(F.col("p") == "b", "before").otherwise("after")).collect()}
    assert d == {"k": ("number", "string", "modified"), "amount": (None, "number", "added")}


def test_lint_goldens(spark):
    assert LT.lint_schema(meta(spark, [("user_id", "INTEGER", True, "")])).count() == 0
    issues = [(r["rule"], r["severity"]) for r in LT.lint_schema(meta(spark, [("userId", "INTEGER", True, "")])).collect()]
    assert issues == [("naming_case", "warning")]
    bad = meta(spark, [("Bad Name", "TEXT", True, ""), ("width", "VARCHAR", True, "d")])
    rules = sorted((r["column"], r["rule"]) for r in LT.lint_schema(bad, require_descriptions=True,
                                                                    require_not_null=True).collect())
    assert rules == [("Bad Name", "missing_description"), ("Bad Name", "naming_case"), ("Bad Name", "no_spaces"),
                     ("Bad Name", "nullable_column"), ("width", "id_type"), ("width", "nullable_column")]
    assert LT.lint_schema(bad, word_match=True).filter("rule = 'id_type'").count() == 0
    camel = LT.lint_schema(meta(spark, [("user_id", "INTEGER", True, "")]), naming_case="camelCase").collect()
    assert [r["rule"] for r in camel] == ["naming_case"]
    assert LT.lint_schema(meta(spark, [("User", "INT", True, "")]), naming_case=None).count() == 0


def test_lint_with_data(spark):
    df = spark.createDataFrame([("1", "a"), ("2", None)], "code string, label string")
    f = sorted((r["column"], r["rule"]) for r in LT.lint_with_data(df).collect())
    assert f == [("code", "never_null"), ("code", "numeric_text")]
