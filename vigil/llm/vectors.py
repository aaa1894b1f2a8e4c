"""Embedding near-dedup by lattice hashing.

A vector is scaled to length 1, projected onto 8 random orthonormal directions per table and
decoded to the nearest point of the E8 lattice (scaled by ``CELL`` over the root of the dimension): its cell.  It also probes the
``PROBES`` neighbouring lattice points that are nearest to it.  Vectors of one label that meet in a
cell, as residents or one as a visitor, are compared by cosine in double precision.

Equal vectors are compared once, weighted by their number.  Cells are dealt by hash and sorted within
partitions; a cell with more than ``BLOCK`` rows is cut into row chunks whose pairs of chunks are
separate groups, so no group has more than two chunks and no task gets a whole hot cell.  A pair is
counted at the first table and cell where it meets, found anew from the two vectors; what leaves a group
are counts per vector and a spanning forest of its links, never its pairs.

Defined results: null or empty vectors, vectors of zeros and vectors with null or non-finite
components, and rows with a null label, link with nothing (also not with their copies); vectors of
different lengths never link; rows repeated under one id are separate vectors; null ids never become a
component's id unless the group has no other.  Further columns stay untouched.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from vigil.llm import common as C

TABLES = 3
PROBES = 8
CELL = 1.12  # side of a cell for vectors of length 1, times the square root of their dimension
THRESHOLD = 0.98
BLOCK = 1024
SEED = 8


def _neighbour_offsets() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates +-1, or all +-1/2 with an even number of minus signs."""
    rows = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            rows.append(v)
    rows += [np.array(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(rows)


_OFFSETS = _neighbour_offsets()
_MIX = np.random.default_rng(SEED).integers(1, 2**62, 8, dtype=np.int64) | 1
_DIRECTIONS: dict[tuple[int, int], np.ndarray] = {}


def _directions(dim: int, table: int) -> np.ndarray:
    """(dim, 8) orthonormal columns, the same in every task."""
    if (dim, table) not in _DIRECTIONS:
        wide = max(dim, 8)
        q, _ = np.linalg.qr(np.random.default_rng([SEED, dim, table]).standard_normal((wide, 8)))
        _DIRECTIONS[dim, table] = q[:dim]
    return _DIRECTIONS[dim, table]


def nearest_point(y: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the better of D8 and D8 + 1/2."""
    def d8(y):
        f = np.rint(y)
        gap = y - f
        odd = np.flatnonzero(f.sum(axis=1) % 2)
        k = np.abs(gap[odd]).argmax(axis=1)
        f[odd, k] += np.where(gap[odd, k] >= 0, 1, -1)
        return f
    a, b = d8(y), d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def _names(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    """64-bit name of lattice points (last axis: coordinates) of one table."""
    raw = ((2 * points).astype(np.int64) @ _MIX) + np.int64(table * 1000003 + dim * 7919)
    return C.mix64(raw.astype(np.uint64)).astype(np.int64)


def cells(unit: np.ndarray, table: int, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Own cell (n) and probed cells (n, probes) of unit vectors in one table."""
    y = unit @ _directions(unit.shape[1], table) * (np.sqrt(max(unit.shape[1], 8)) / CELL)
    own = nearest_point(y)
    far = ((y - own)[:, None, :] - _OFFSETS[None]) ** 2
    best = np.argsort(far.sum(axis=2), axis=1, kind="stable")[:, :probes]
    return _names(own, table, unit.shape[1]), _names(own[:, None, :] + _OFFSETS[best], table, unit.shape[1])


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, through the largest component against overflow."""
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# ---------------------------------------------------------------- dealing vectors to cells

def _deal(kind: str):
    """A row per vector and cell, the vector as it came (``kind``: its number type)."""
    def run(batches):
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.array([len(x) for x in lists])
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                for lo in range(0, len(rows), 512):
                    yield _dealt_rows(batch, rows[lo: lo + 512], kind)
    return run


def _dealt_rows(batch: pa.RecordBatch, own_rows: np.ndarray, kind: str) -> pa.RecordBatch:
    lists = batch.column("vector")
    raw = np.array([lists[int(i)].as_py() for i in own_rows], kind)
    unit = unit_rows(raw.astype(np.float64))
    index, cell, table_of, home = [], [], [], []
    for t in range(TABLES):
        own, near = cells(unit, t)
        for names, at_home in ((own[:, None], True), (near, False)):
            index.append(np.repeat(np.arange(len(unit)), names.shape[1]))
            cell.append(names.ravel())
            table_of.append(np.full(names.size, t, np.int32))
            home.append(np.full(names.size, at_home))
    index = np.concatenate(index)
    take = pa.array(own_rows[index])
    blobs = pa.array([r.tobytes() for r in raw], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(cell)), pa.array(np.concatenate(table_of)), pa.array(np.concatenate(home)),
         batch.column("node").take(take), batch.column("label").take(take), batch.column("weight").take(take),
         blobs.take(pa.array(index))],
        names=["cell", "table", "home", "node", "label", "weight", "vector"])


_DEALT = "cell long, table int, home boolean, node long, label string, weight long, vector binary"


def _meetings(codes: list, a: np.ndarray, b: np.ndarray, cell: int) -> np.ndarray:
    """Whether ``cell`` of the last table in ``codes`` is the first place where the pairs (a, b) meet."""
    first = np.ones(len(a), bool)
    for t, (own, near) in enumerate(codes):
        at_b = (own[a] == own[b]) | (near[a] == own[b][:, None]).any(axis=1)   # a comes to b's cell
        at_a = (own[a] == own[b]) | (near[b] == own[a][:, None]).any(axis=1)
        if t < len(codes) - 1:
            first &= ~(at_a | at_b)
        else:
            here = np.where(at_a & at_b, np.minimum(own[a], own[b]), np.where(at_b, own[b], own[a]))
            first &= (at_a | at_b) & (here == cell)
    return first


_SIDE = 1024


def _group(rows: dict, threshold: float, kind: str):
    """Counts and forest of one group: residents against residents and visitors, cross chunks only."""
    node, home, part, weight = rows["node"], rows["home"], rows["part"], rows["weight"]
    raw = [np.frombuffer(v, kind).astype(np.float64) for v in rows["vector"]]
    dims = np.array([len(r) for r in raw])
    counts = np.zeros(len(node), np.int64)
    label = np.arange(len(node))
    whole = rows["i"] == rows["j"]
    for dim in np.unique(dims):
        member = np.flatnonzero(dims == dim)
        unit, codes = unit_rows(np.array([raw[k] for k in member])), None
        for lo in range(0, len(member), _SIDE):
            a = np.arange(lo, min(lo + _SIDE, len(member)))
            for lo2 in range(lo, len(member), _SIDE):
                b = np.arange(lo2, min(lo2 + _SIDE, len(member)))
                near = unit[a] @ unit[b].T >= threshold
                near &= home[member[a]][:, None] | home[member[b]][None, :]
                near &= node[member[a]][:, None] != node[member[b]][None, :]
                if not whole:
                    near &= part[member[a]][:, None] != part[member[b]][None, :]
                if lo == lo2:
                    near = np.triu(near, 1)
                x, y = np.nonzero(near)
                if len(x) and codes is None:  # cells of every vector here, in this and the earlier tables
                    parts = [[cells(unit[k: k + 512], t) for k in range(0, len(unit), 512)] for t in range(int(rows["table"]) + 1)]
                    codes = [tuple(np.concatenate(z) for z in zip(*part)) for part in parts]
                for k in range(0, len(x), 1 << 16):
                    p, q = a[x[k: k + (1 << 16)]], b[y[k: k + (1 << 16)]]
                    same = rows["label"][member[p]] == rows["label"][member[q]]
                    p, q = p[same], q[same]
                    first = _meetings(codes, p, q, int(rows["cell"]))
                    p, q = member[p[first]], member[q[first]]
                    np.add.at(counts, p, weight[q])
                    np.add.at(counts, q, weight[p])
                    C.merge_labels(label, p, q)
    return counts, label


def _compare(threshold: float, kind: str):
    """Rows arrive sorted by (cell, table, i, j); a group may span batches, and is bounded by two chunks."""
    def run(batches):
        held = None

        def solve(table: pa.Table):
            cell, grid = table["cell"].to_numpy(), table["table"].to_numpy()
            i, j = table["i"].to_numpy(), table["j"].to_numpy()
            edge = np.flatnonzero((np.diff(cell) != 0) | (np.diff(grid) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            cut = np.concatenate([[0], edge, [len(cell)]])
            home = table["home"].to_numpy(zero_copy_only=False)
            residents = np.add.reduceat(home.astype(np.int64), cut[:-1])
            a, b, n = [], [], []
            for g in np.flatnonzero((residents > 0) & (np.diff(cut) > 1)):
                lo, hi = int(cut[g]), int(cut[g + 1])
                own = table.slice(lo, hi - lo)
                rows = {"node": own["node"].to_numpy(), "home": home[lo:hi], "part": own["part"].to_numpy(),
                        "weight": own["weight"].to_numpy(), "label": np.array(own["label"].to_pylist(), object),
                        "vector": own["vector"].to_pylist(), "cell": cell[lo], "table": grid[lo], "i": i[lo], "j": j[lo]}
                counts, label = _group(rows, threshold, kind)
                on = np.flatnonzero(counts)
                a += rows["node"][on].tolist()
                b += rows["node"][label[on]].tolist()
                n += counts[on].tolist()
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            here = pa.Table.from_batches([batch])
            held = here if held is None else pa.concat_tables([held, here])
            key = [held[c].to_numpy() for c in ("cell", "table", "i", "j")]
            other = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield solve(held.slice(0, last))
                held = held.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield solve(held)
    return run


def near_duplicates(df: DataFrame, id_col: str, vector_col: str, label_col: str, keep: list[str],
                    threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``keep`` columns of every row with ``n_links`` (other rows linked directly), ``component_id``
    (smallest id reachable) and ``kept`` (the id is the component's)."""
    keep = C.apart(keep, ("n_links", "component_id", "kept"))
    base = C.materialise(df.select(
        *[F.col(c) for c in keep], F.col(id_col).alias("__id"), F.col(vector_col).alias("__vector"),
        F.col(label_col).cast("string").alias("__label")).withColumn("__row", F.monotonically_increasing_id()), "vectors")
    finite = F.forall("__vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (F.col("__label").isNotNull() & F.col("__vector").isNotNull() & finite
              & F.exists("__vector", lambda x: x != 0))
    digest = F.when(usable, F.sha2(F.concat_ws("|", F.to_json("__vector"), F.col("__label")), 256))
    marked = base.withColumn("__digest", F.coalesce(digest, F.concat(F.lit("row "), F.col("__row").cast("string"))))
    # what a class of equal vectors needs: its first row, its size, its smallest id
    classes = C.materialise(marked.groupBy("__digest").agg(
        F.min("__row").alias("node"), F.count("*").alias("weight"), F.min("__id").alias("least"),
        F.first(F.when(usable, F.col("__vector"))).alias("vector"), F.first("__label").alias("label")), "classes")
    kind = "<f4" if isinstance(base.schema["__vector"].dataType.elementType, FloatType) else "<f8"
    vectors = classes.where("vector IS NOT NULL").select(
        "node", "weight", "label", F.col("vector").cast("array<float>" if kind == "<f4" else "array<double>").alias("vector"))
    dealt = C.materialise(C.map_arrow(vectors, _deal(kind), _DEALT), "dealt")
    hot = C.materialise(dealt.groupBy("cell", "table").count().where(F.col("count") > block).select(
        "cell", "table", F.ceil(F.col("count") / block).cast("int").alias("chunks")), "hot")
    # the join moves every row, so it is there only if some cell is cut at all
    cut = dealt.withColumn("chunks", F.lit(1)) if hot.isEmpty() else dealt.join(hot, ["cell", "table"], "left")
    chunked = (cut.withColumn("chunks", F.coalesce("chunks", F.lit(1)))
               .withColumn("part", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
               .withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("chunks", "other"))
    sort = ["cell", "table", "i", "j"]
    met = C.materialise(C.map_arrow(chunked.repartition(*sort).sortWithinPartitions(*sort), _compare(threshold, kind),
                                    "a long, b long, n long"), "links")
    C.discard(df.sparkSession, dealt)
    linked = met.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "linked")
    found = C.components(met.where("a != b").select("a", "b"))
    joined = (classes.join(found.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
              .join(linked, F.col("node") == F.col("linked"), "left")
              .select("__digest", "weight", "least", F.coalesce("component", "node").alias("label_node"), F.coalesce("n", F.lit(0)).alias("n")))
    heads = joined.groupBy("label_node").agg(F.min("least").alias("component_id"))
    facts = joined.join(heads, "label_node").select(
        F.col("__digest").alias("__key"), "component_id", (F.col("weight") - 1 + F.col("n")).alias("n_links"))
    return marked.join(facts, F.col("__digest") == F.col("__key")).select(
        *keep, F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"))
