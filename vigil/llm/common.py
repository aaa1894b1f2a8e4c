"""Shared helpers: shared scratch tables, Arrow text batches, hashing, connected components."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
SEGMENT = 1 << 18  # bytes hashed at once: bounds numpy temporaries, whatever the text's length


# ---------------------------------------------------------------- shared scratch tables

def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="vigil-llm-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, compression: str = "zstd", free: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives executors.

    ``free`` deletes the write's shuffle files as soon as it has ended.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    try:
        if free:
            spark.conf.set(_FREE_SHUFFLES, "true")
        df.write.option("compression", compression).parquet(path)
    finally:
        if free:
            spark.conf.set(_FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(spark: SparkSession, path: str | DataFrame | None) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more."""
    path = getattr(path, "scratch", path)
    if isinstance(path, str):
        target = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application, through the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    z.write(path := os.path.join(folder, name), os.path.relpath(path, os.path.dirname(package)))
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "vigil_package.zip"))
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(target.toString())
    _SHIPPED.add(sc.applicationId)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def apart(keep: list[str], made: tuple[str, ...]) -> list[str]:
    """Columns to carry along: one with the name of a result gives way to the result.

    Names that begin with two underscores are the operators' own.
    """
    names = {m.lower() for m in made}
    return [c for c in keep if c.lower() not in names]


def with_columns(df: DataFrame, keep: list[str], ddl: str) -> StructType:
    """Schema of ``keep`` columns of ``df`` followed by the columns of ``ddl``."""
    return StructType([df.schema[c] for c in keep] + StructType.fromDDL(ddl).fields)


def group_arrow(df: DataFrame, keys: list[str], run, schema) -> DataFrame:
    """``groupBy(keys).applyInArrow`` with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(run, schema)


# ---------------------------------------------------------------- Arrow batches of texts

def text_groups(batch: pa.RecordBatch, column: str, limit: int = SEGMENT):
    """Yield (first row, last row + 1, bytes, row bounds): whole rows of about ``limit`` bytes.

    Null texts count as empty.  A row longer than ``limit`` forms its own group.
    """
    texts = batch.column(column)
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    bounds = bounds[texts.offset: texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, hi, data[bounds[lo]: bounds[hi]], bounds[lo: hi + 1] - bounds[lo]
        lo = hi


# ---------------------------------------------------------------- words and their hashes

def byte_table(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in spans:
        table[lo: hi + 1] = True
    return table


# words of letters, digits and every byte of a non-ASCII character
ALNUM = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
# words of anything but ASCII white space
NON_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_STEP = U64(0x9E3779B97F4A7C15)
_STEP_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SEGMENT + 1)
        for key, step in (("up", _STEP), ("down", _STEP_INVERSE)):
            p = np.full(size, step)
            p[0] = 1
            _POWERS[key] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (in place on a fresh array)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(32)
    return h


def word_spans(buf: np.ndarray, table: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``buf``; a word never crosses a row bound."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[buf]
    begins = inside[1:] & ~inside[:-1]
    finishes = inside[:-1] & ~inside[1:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    touching = cut[inside[cut] & inside[cut + 1]]
    begins[touching] = True
    finishes[touching] = True
    return np.flatnonzero(begins), np.flatnonzero(finishes)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span of ``buf`` (spans in order), by prefix sums over segments."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + SEGMENT, "right")))
        base, top = int(starts[lo]), int(ends[hi - 1])
        up, down = powers(top - base)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum(_BYTE[buf[base:top]] * up[: top - base], out=sums[1:])
        s = starts[lo:hi] - base
        out[lo:hi] = (sums[ends[lo:hi] - base] - sums[s]) * down[s]
        lo = hi
    return mix64(out)


def row_of(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First word of each row, with the number of words at the end."""
    return np.searchsorted(starts, bounds)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (position-dependent, mixed)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total *= _STEP
        total += hashes[k: len(hashes) - n + 1 + k]
    return mix64(total)


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Which leading ``bits`` bits occur among the longs of ``column``: 2**bits flags, packed.

    The result has a fixed size; a full one merely filters less.
    """
    slots = df.select(F.shiftrightunsigned(column, 64 - bits).cast("int").alias("slot")).distinct()
    blocks = slots.groupBy(F.shiftright("slot", 12).alias("block")).agg(F.collect_list("slot").alias("slots"))
    flags = np.zeros(1 << bits, bool)
    for row in blocks.toLocalIterator():
        flags[np.array(row["slots"], np.int64)] = True
    return np.packbits(flags)


class Flags:
    """A broadcast bitmap, unpacked once per task."""

    def __init__(self, spark: SparkSession, packed: np.ndarray):
        self.shared = spark.sparkContext.broadcast(packed)

    @property
    def value(self) -> np.ndarray:
        return np.unpackbits(self.shared.value).astype(bool)


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of the pairs (i, j): afterwards ``label`` gives every node its component's smallest node."""
    while True:
        x, y = label[i], label[j]
        on = x != y
        if not on.any():
            return
        i, j = i[on], j[on]
        np.minimum.at(label, np.maximum(x[on], y[on]), np.minimum(x[on], y[on]))
        while (label[label] != label).any():
            label[:] = label[label]


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the undirected links (a, b); component is the smallest node.

    Alternating large-star / small-star rounds over the edge table.  Every round only takes a
    pre-aggregated minimum per node and an equi-join on the node, so a hub is reduced map-side and
    its join partition can be split; rounds end when the edge set no longer changes.  Each round
    is written to the shared folder.  Nodes without a link are not returned; self-links are ignored.
    """
    spark = edges.sparkSession
    oriented = (F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = materialise(edges.where("a != b").select(*oriented).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(floor, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = floor.select("u", F.col("m").alias("v")).union(pulled).distinct()
        after = materialise(step, "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, now)
        now = after
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    out.scratch = now.scratch
    return out
