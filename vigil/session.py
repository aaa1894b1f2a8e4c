"""Session builder and checkpoint-directory handling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

# Settings every vigil job wants: UTC wall clock (timestamp_ntz fixtures compare with
# DuckDB), adaptive execution for partition coalescing and skew splitting, no UI.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # iterative operators checkpoint every other round; delete files of unreferenced rounds
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "vigil", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with vigil's defaults.

    ``master`` is only applied when given (on a cluster the launcher decides).  Shuffle
    partitions default to 2x the local core count for tests; on a cluster pass a value
    sized so each partition holds ~128-256 MB of shuffle data.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # Local mode: the driver JVM is the only executor, so give it the memory.
            builder = builder.config("spark.driver.memory", "12g")
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring one only when none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS / object store) and is
    used as is.  Only a local master may fall back to a scratch folder of this machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="vigil-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


class Rounds:
    """The state of an iterative operator: one Parquet folder per round in the shared folder.

    A round writes only the rows it made, so nothing stays cached, no plan grows with the number
    of rounds, and a lost executor costs the running round at most.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.schema = None

    def write(self, k: int, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/round={k}")
        self.schema = df.schema
        return self.read(k)

    def read(self, k: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/round={k}")

    def drop(self, *rounds: int) -> None:
        """Delete rounds that nothing reads any more."""
        for k in rounds:
            drop_folder(self.spark, f"{self.path}/round={k}")

    def drop_all(self) -> None:
        drop_folder(self.spark, self.path)

    def all(self) -> DataFrame:
        """Rows of all rounds, with ``round``."""
        full = StructType(self.schema.fields + [StructField("round", IntegerType())])
        return self.spark.read.schema(full).parquet(self.path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
