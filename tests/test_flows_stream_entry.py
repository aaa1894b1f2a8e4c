import datetime as dt
import os
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from vigil.plans import flows as FL
from vigil.operators import runs as RN
from vigil.operators import rules as RU
from vigil.operators import schema as SC
from vigil.streaming import alert_windows as AW
from vigil.streaming.rule_checks import validate_stream
from conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_pii_scan_and_flows(spark, users):
    m = {(r["column"], r["pattern"]): r["matches"] for r in FL.pii_scan({"u": users}).collect()}
    assert m[("email", "email")] == 6 and m[("status", "email")] == 0
    rep = FL.validation_loop(users, "u", SC.columns_of(users.drop("status"), "u"), [RU.rule("not_null", "email")])
    steps = {(r["step"], r["subject"], r["metric"]): r["value"] for r in rep.collect()}
    assert steps[("drift", "status", "change")] == "added: "
    assert steps[("rules", "0:not_null:email", "failures")] == "2"
    comp = FL.compliance_scan(users, "u").collect()
    assert {(r["step"], r["subject"]) for r in comp} >= {("tag", "u.email"), ("profile", "email")}


def test_stream_matches_batch_on_closed_windows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "p", ["critical", "warning"][i % 2], "m", t0 + dt.timedelta(hours=5 * i), False) for i in range(30)]
    alerts = spark.createDataFrame(rows, AW.ALERT_SCHEMA)
    src = str(tmp_path / "in")
    alerts.orderBy("ts").coalesce(1).write.parquet(src)  # in event-time order: nothing is late
    AW.run_alert_windows(spark, src, str(tmp_path / "out"), str(tmp_path / "ck"), "1 day", "1 hour",
                         max_files_per_trigger=1)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    wm = max(r[4] for r in rows) - dt.timedelta(hours=1)
    want = sorted(tuple(r) for r in RN.alert_windows(alerts).collect() if r["window_end"] <= wm)
    assert got == want and len(got) > 0


def test_entry_and_every_registered_query(spark):
    import __spark_entry__ as E
    assert E.entry(spark).count() == 11
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    for name, fn in qs.items():
        df = fn(spark, SF_SMALL)
        assert df.columns, name
        df.limit(1).collect()


def test_rules_per_micro_batch(spark, tmp_path, users):
    from vigil.operators import rules as RU
    from vigil.streaming import rule_checks as RC
    src = str(tmp_path / "users")
    users.repartition(4).write.parquet(src)
    rules = [RU.rule("not_null", "email"), RU.rule("max", "age", value=120)]
    q = RC.validate_stream(spark.readStream.schema(users.schema).option("maxFilesPerTrigger", 1).parquet(src),
                           rules, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    res = spark.read.parquet(str(tmp_path / "out"))
    sc = {r["rule_type"]: (r["failures"], r["batches"]) for r in RC.stream_scorecard(res).collect()}
    nfiles = len([f for f in __import__("os").listdir(src) if f.endswith(".parquet")])
    assert sc == {"not_null": (2, nfiles), "max": (1, nfiles)}


def test_stream_windows_ignore_session_time_zone(spark):
    import __spark_entry__ as E
    q = E.queries()["alert_windows_stream"]
    utc = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        other = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc == other and utc


@pytest.mark.parametrize("missing", ["zstandard", "xxhash", "tokenizers", "vigil.llm", "corpus_pipeline"])
def test_core_queries_load_without(missing):
    """One missing package or folder of the training-data part leaves every other query in place."""
    from vigil.plans.registry import ORACLE, QUERIES
    code = (f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules[{missing!r}] = None\n"
            "import __spark_entry__ as E\nprint(len([k for k in E.queries() if not k.startswith('op') and k != 'pipeline']), len(E.oracle_sql()))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(QUERIES) and int(out[1]) >= len(ORACLE)


def test_rules_on_a_stream_retry_a_failed_batch(spark, tmp_path):
    """A batch that fails for another reason than a rule is not committed; the restarted query has it again."""
    path = f"{tmp_path}/in"
    spark.range(10).withColumn("v", F.col("id") * 2).write.parquet(path)
    rules = [RU.rule("not_null", "v"), RU.rule("custom_sql", sql="SELECT * FROM {{table}} WHERE vigil_flaky(v) < 0")]
    stream = spark.readStream.schema("id long, v long").parquet(path)

    def dies(x):
        raise RuntimeError("executor lost")
    spark.udf.register("vigil_flaky", dies, "long")
    with pytest.raises(Exception, match="executor lost"):
        validate_stream(stream, rules, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    spark.udf.register("vigil_flaky", lambda x: x, "long")
    validate_stream(stream, rules, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("rule_index", "passed", "batch_id").collect()) == [(0, True, 0), (1, True, 0)]
