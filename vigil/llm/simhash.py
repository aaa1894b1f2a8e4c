"""SimHash near-dedup by anchor-point covering.

Fingerprints: XXH64 (seed 42) of every word shingle of the lower-cased text, repeats included; a bit
is 1 if set in over half of the hashes.  Fingerprints that differ in at most ``THRESHOLD`` bits link.

Anchors are the words of a covering code of the 64-bit space: two binary Golay [23,12] codes
(covering radius 3 each), one Hamming [7,4] code (radius 1) and 11 bits that the code leaves free (their
radius is 11), 2**28 anchors in all.  The anchor nearest to a fingerprint is its home.  A fingerprint also
goes to every anchor within covering radius plus threshold that may be the home of a fingerprint
within the threshold, that is where the distances beyond each part's radius sum to the threshold
or less: 92 on average.  Then each anchor's residents meet each other and its visitors; every pair within
the threshold meets at the home of either, which may be the same anchor.  An anchor's links leave it as a forest, never as all pairs.

Only distinct fingerprints are replicated, so copies of one text count once.  Rows are dealt by anchor
and sorted within partitions (Spark spills); one anchor's fingerprints are buffered at 16
bytes each, and large anchors are compared through equal thirds of the bits instead of all pairs.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated
documents are separate rows with equal fingerprints; null ids never become a component's id unless
the group has no other; empty tables give an empty result.  Further columns stay untouched.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common as C

SEED = 42
SHINGLE = 3
THRESHOLD = 2
U = np.uint64

# ---------------------------------------------------------------- XXH64 of many spans

# Fixed values of XXH64: its five primes.
_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_LONG = 256  # longer spans are hashed one by one


def _rotl(x, k):
    return (x << U(k)) | (x >> U(64 - k))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of ``buf[starts:starts + lengths]`` for many spans at once."""
    padded = np.concatenate([buf, np.zeros(40, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    halves = np.ndarray((len(padded) - 3,), "<u4", padded, 0, (1,))
    out = np.empty(len(starts), np.uint64)
    huge = lengths > _LONG
    for i in np.flatnonzero(huge):
        out[i] = xxhash.xxh64_intdigest(buf[starts[i]: starts[i] + lengths[i]].tobytes(), seed)
    rest = np.flatnonzero(~huge)
    s, n = starts[rest], lengths[rest]
    at = s.copy()
    h = np.full(len(s), U((seed + int(_P5)) % 2**64))
    wide = np.flatnonzero(n >= 32)
    if len(wide):
        p1, p2 = int(_P1), int(_P2)
        acc = [np.full(len(wide), U(v % 2**64)) for v in (seed + p1 + p2, seed + p2, seed, seed - p1)]
        stripes, place = n[wide] // 32, at[wide].copy()
        for k in range(int(stripes.max())):
            on = stripes > k
            for lane in range(4):
                acc[lane] = np.where(on, _round(acc[lane], words[np.where(on, place + 8 * lane, 0)]), acc[lane])
            place += 32 * on
        joined = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            joined = (joined ^ _round(np.zeros(1, np.uint64), a)) * _P1 + _P4
        h[wide] = joined
        at[wide] = place
    h += n.astype(np.uint64)
    end = s + n
    order = np.argsort(end - at, kind="stable")  # a prefix drops out at every step
    at, end, h = at[order], end[order], h[order]
    left = end - at
    for k in range(int(left.max()) // 8 if len(left) else 0):
        i = int(np.searchsorted(left, 8 * (k + 1)))
        lane = words[at[i:]]
        h[i:] = _rotl(h[i:] ^ _round(U(0), lane), 27) * _P1 + _P4
        at[i:] += 8
    on = np.flatnonzero(end - at >= 4)
    h[on] = _rotl(h[on] ^ (halves[at[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[on] += 4
    for _ in range(3):
        on = np.flatnonzero(end > at)
        h[on] = _rotl(h[on] ^ (padded[at[on]].astype(np.uint64) * _P5), 11) * _P1
        at[on] += 1
    h ^= h >> U(33)
    h *= _P2
    h ^= h >> U(29)
    h *= _P3
    h ^= h >> U(32)
    out[rest[order]] = h
    return out


# ---------------------------------------------------------------- fingerprints

def _shingle_hashes(buf: np.ndarray, bounds: np.ndarray, size: int):
    """Hashes of all shingles and the first shingle of each row (with the total at the end)."""
    low = C.LOWER[buf]
    starts, ends = C.word_spans(low, C.NON_SPACE, bounds)
    first = C.row_of(starts, bounds)
    words = np.diff(first)
    last = np.zeros(len(starts), bool)
    last[first[1:][words > 0] - 1] = True
    kept = C.NON_SPACE[low]
    gap = ends[~last]
    low[gap] = 0x20
    kept[gap] = True
    text = low[kept]
    lengths = ends - starts
    begin = np.concatenate([[0], np.cumsum(lengths + ~last)])[:-1].astype(np.int64)
    finish = begin + lengths
    count = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    cut = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(count)), count)
    head = np.arange(cut[-1]) - cut[row] + first[row]
    tail = np.minimum(head + size, first[row + 1]) - 1
    return xxh64(text, begin[head], finish[tail] - begin[head]), cut


_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Per row, the bits set in over half of its hashes."""
    out = np.zeros(len(cut) - 1, np.uint64)
    full = np.flatnonzero(np.diff(cut))
    if not len(full):
        return out
    # byte lanes hold up to 255 ones: sum runs of 128 first, then runs per row
    runs = np.concatenate([np.arange(cut[r], cut[r + 1], 128) for r in full])
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], runs, axis=0)
    ones = lanes.view(np.uint8).reshape(-1, 64).astype(np.int64)
    ones = np.add.reduceat(ones, np.searchsorted(runs, cut[full]), axis=0)
    bits = 2 * ones > np.diff(cut)[full][:, None]
    out[full] = (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(batch: pa.RecordBatch, column: str, size: int = SHINGLE) -> np.ndarray:
    out = np.zeros(batch.num_rows, np.uint64)
    for lo, hi, buf, bounds in C.text_groups(batch, column):
        hashes, cut = _shingle_hashes(buf, bounds, size)
        out[lo:hi] = majority(hashes, cut)
    return out


def with_fingerprints(df: DataFrame, text_col: str, keep: list[str], size: int = SHINGLE) -> DataFrame:
    """``keep`` columns of every row and ``fp``, the fingerprint as a signed long."""
    plain = df.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))

    def run(batches):
        for batch in batches:
            fp = fingerprints(batch, "__text", size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(fp)], names=[*keep, "fp"])

    return C.map_arrow(plain, run, C.with_columns(plain, keep, "fp long"))


# ---------------------------------------------------------------- the covering code

class _Part:
    """A perfect cyclic code on some bits: its home word and the words up to ``excess`` beyond its radius."""

    def __init__(self, shift: int, n: int, generator: int, radius: int, excess: int):
        self.shift, self.mask = U(shift), U((1 << n) - 1)
        degree = generator.bit_length() - 1
        power = [1 << i if i < degree else 0 for i in range(n)]
        for i in range(degree, n):
            x = power[i - 1] << 1
            power[i] = x ^ generator if x >> degree else x
        # syndromes by bytes of the word
        self.tables = []
        for byte in range(0, n, 8):
            table = np.zeros(256, np.int64)
            for b in range(256):
                for k in range(8):
                    if b >> k & 1 and byte + k < n:
                        table[b] ^= power[byte + k]
            self.tables.append(table)
        found: list[list[list[int]]] = [[[] for _ in range(1 << degree)] for _ in range(excess + 1)]
        for weight in range(min(n, radius + excess) + 1):
            level = max(0, weight - radius)
            for places in combinations(range(n), weight):
                s = 0
                for i in places:
                    s ^= power[i]
                found[level][s].append(sum(1 << i for i in places))
        self.levels = [(np.concatenate([[0], np.cumsum([len(x) for x in lists])]),
                        np.array([e for x in lists for e in x], np.uint64)) for lists in found]

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        s = np.zeros(len(x), np.int64)
        for k, table in enumerate(self.tables):
            s ^= table[((x >> U(8 * k)) & U(255)).astype(np.int64)]
        return s

    def of(self, fp: np.ndarray) -> np.ndarray:
        return (fp >> self.shift) & self.mask


_CODE: dict[int, list[_Part]] = {}


def _code(excess: int) -> list[_Part]:
    if excess not in _CODE:
        # Generator polynomials of the binary Golay code and of the Hamming [7,4] code.
        golay, hamming = 0b101011100011, 0b1011
        _CODE[excess] = [_Part(0, 23, golay, 3, excess), _Part(23, 23, golay, 3, excess), _Part(46, 7, hamming, 1, excess)]
    return _CODE[excess]


def anchors(fp: np.ndarray, threshold: int = THRESHOLD):
    """(index into fp, anchor, home?) of every anchor that each fingerprint goes to."""
    parts = _code(threshold)
    words = [p.of(fp) for p in parts]
    syndromes = [p.syndrome(w) for p, w in zip(parts, words)]
    rows, out, home = [], [], []
    for levels in product(range(threshold + 1), repeat=len(parts)):
        if sum(levels) > threshold:
            continue
        index = np.arange(len(fp))
        anchor = np.zeros(len(fp), np.uint64)
        for p, w, s, level in zip(parts, words, syndromes, levels):
            cut, errors = p.levels[level]
            count = (cut[s + 1] - cut[s])[index]
            step = np.repeat(np.arange(len(index)), count)
            inner = np.arange(len(step)) - np.repeat(np.cumsum(count) - count, count)
            index = index[step]
            anchor = anchor[step] | ((w[index] ^ errors[cut[s[index]] + inner]) << p.shift)
        rows.append(index)
        out.append(anchor)
        home.append(np.full(len(index), not any(levels)))
    return np.concatenate(rows), np.concatenate(out), np.concatenate(home)


def _replicate(threshold: int):
    def run(batches):
        for batch in batches:
            values = batch.column("fp").to_numpy().astype(np.uint64)
            for lo in range(0, len(values), 2048):
                fp = values[lo: lo + 2048]
                rows, anchor, home = anchors(fp, threshold)
                yield pa.RecordBatch.from_pydict({
                    "anchor": pa.array(anchor.astype(np.int64)), "fp": pa.array(fp[rows].astype(np.int64)),
                    "home": pa.array(home)})
    return run


# ---------------------------------------------------------------- comparing per anchor

_PAIRS = 1 << 21


def _near(a: np.ndarray, b: np.ndarray, threshold: int):
    """Index pairs (i, j) with a[i], b[j] within the threshold, in blocks."""
    step = max(1, _PAIRS // max(1, len(b)))
    for lo in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[lo: lo + step, None] ^ b[None, :]) <= threshold)
        yield i + lo, j


def _near_large(a: np.ndarray, b: np.ndarray, threshold: int):
    """As ``_near``, through ``threshold + 1`` groups of bits, one of which must be equal."""
    edges = np.linspace(0, 64, threshold + 2).astype(int)
    for low, high in zip(edges[:-1], edges[1:]):
        mask = U(((1 << int(high - low)) - 1) << int(low))
        ka, kb = a & mask, b & mask
        ia, ib = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        sa, sb = ka[ia], kb[ib]
        keys = np.intersect1d(sa, sb)
        for x0, x1, y0, y1 in zip(np.searchsorted(sa, keys), np.searchsorted(sa, keys, "right"),
                                  np.searchsorted(sb, keys), np.searchsorted(sb, keys, "right")):
            for i, j in _near(a[ia[x0:x1]], b[ib[y0:y1]], threshold):
                yield ia[x0:x1][i], ib[y0:y1][j]


def _forest(a: np.ndarray, b: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between residents a and all of the anchor's fingerprints b, reduced to (node, smallest node of its component)."""
    nodes = np.union1d(a, b)
    pa_, pb = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    label = np.arange(len(nodes))

    pairs = _near if len(a) * len(b) <= 8 * _PAIRS else _near_large
    for i, j in pairs(a, b, threshold):
        C.merge_labels(label, pa_[i], pb[j])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _compare(threshold: int):
    """Rows arrive sorted by anchor; an anchor may span batches."""
    def links(fp, home):
        fp, home = fp.astype(np.uint64), home.astype(bool)
        return _forest(fp[home], fp, threshold) if home.any() and len(fp) > 1 else (fp[:0], fp[:0])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def groups(anchor, fp, home):
            edge = np.flatnonzero(np.diff(anchor)) + 1
            cut = np.concatenate([[0], edge, [len(anchor)]])
            size = np.diff(cut)
            resident = np.add.reduceat(home.astype(np.int64), cut[:-1])
            a, b = [], []
            for g in np.flatnonzero((resident > 0) & (size > 1)):
                x, y = links(fp[cut[g]: cut[g + 1]], home[cut[g]: cut[g + 1]])
                a.append(x)
                b.append(y)
            a = np.concatenate(a) if a else np.zeros(0, np.uint64)
            b = np.concatenate(b) if b else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_pydict({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64))})

        for batch in batches:
            anchor, fp = batch.column("anchor").to_numpy(), batch.column("fp").to_numpy()
            home = batch.column("home").to_numpy(zero_copy_only=False)
            if not len(anchor):
                continue
            last = int(np.searchsorted(anchor, anchor[-1]))
            if last:
                done = [*held, (anchor[:last], fp[:last], home[:last])]
                yield groups(*(np.concatenate(x) for x in zip(*done)))
                held = []
            held.append((anchor[last:], fp[last:], home[last:]))
        if held:
            yield groups(*(np.concatenate(x) for x in zip(*held)))
    return run


def links(fingerprints_: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) links between distinct fingerprints (column ``fp``), a spanning forest per anchor."""
    dealt = C.map_arrow(fingerprints_, _replicate(threshold), "anchor long, fp long, home boolean")
    return C.map_arrow(dealt.repartition("anchor").sortWithinPartitions("anchor"), _compare(threshold), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, keep: list[str],
                    size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``keep`` columns of every row, ``fp``, ``component_id`` (smallest id reachable) and ``kept``
    (one row of each component: the smallest id, the first row of several with it)."""
    keep = C.apart(keep, ("fp", "component_id", "kept"))
    source = df.select(*[F.col(c) for c in keep], F.col(id_col).alias("__id"), F.col(text_col).alias("__body"))
    marked = with_fingerprints(source, "__body", [*keep, "__id"], size)
    base = C.materialise(marked.withColumn("__row", F.monotonically_increasing_id()), "fingerprints")
    smallest = F.min(F.struct(F.col("__id").isNull().alias("no"), F.col("__id").alias("id"), F.col("__row").alias("row")))
    distinct = C.materialise(base.groupBy("fp").agg(smallest.alias("least")), "distinct")
    found = C.components(links(distinct.select("fp"), threshold))
    labelled = distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("label"))
    heads = labelled.groupBy("label").agg(F.min("least").alias("head"))
    classes = labelled.select("fp", "label").join(heads, "label").select(
        F.col("fp").alias("__fp"), F.col("head.id").alias("component_id"), F.col("head.row").alias("__head"))
    return base.join(classes, F.col("fp") == F.col("__fp")).select(
        *keep, "fp", "component_id", (F.col("__row") == F.col("__head")).alias("kept"))
