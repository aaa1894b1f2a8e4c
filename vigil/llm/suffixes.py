"""Exact substring dedup with a sparse, range-partitioned suffix array.

A byte of a text goes if a ``SPAN``-byte string that covers it also starts in a document with a smaller
id.  All suffixes of a corpus are too many to move, so only sampled ones are: in every
``SPAN``-byte window the leftmost position of smallest 8-byte hash (of those that leave ``GRAM`` bytes in
the window) starts a sampled suffix.  Equal windows sample the same place, so two
equal strings meet at suffixes with equal leading ``GRAM`` bytes.  A sampled suffix is compared
with its surroundings: up to ``SPAN - GRAM`` bytes before and ``SPAN`` bytes from its start.

1. Leading bytes that occur in one document only are dropped: tasks send the sorted hashes of each text
   chunk by hash range, and get a bit back for each.
2. Suffixes with equal surroundings share one result; the smallest id keeps, later ones lose every
   window in them.  Again hashes (2 x 64 bits) travel, once per chunk.
3. What is left are suffixes with equal leading bytes in different surroundings, once per surroundings.
   Spark samples splitters and range-partitions them by their leading bytes; each bucket sorts their
   windows by multikey quicksort (eight bytes a step, only ties go deeper) and compares neighbours.  Leading
   bytes with more than ``BUCKET`` surroundings would overfill a bucket: their windows are compared across
   buckets, by an aggregation on the window's own bytes.

Chunks of about ``CHUNK_BYTES`` are stored once, compressed and bucketed by chunk number, so every return
trip joins a few bytes per suffix to the texts without moving these again.  What depends on a hash
of 128 bits is step 2; steps 1 and 3 are exact.

Defined results: null and empty texts have no bytes; equal ids (repeated rows) never remove from each
other; a null id counts as larger than all others and never removes; texts may be arbitrary UTF-8; an
empty table gives no row.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common as C

SPAN = 50
GRAM = 24
REACH = SPAN - GRAM          # a window starts at most so many bytes before its sampled suffix
CHUNK_BYTES = 1 << 21
RANGE_BYTES = 24 << 20       # of hashes that one range of step 1 holds
BUCKET = 4096                # surroundings of equal leading bytes that one bucket compares
NO_ID = 2**63 - 1
_STEP = C.U64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- sampled suffixes of a chunk

class Suffixes:
    """Sampled suffixes of the documents of a chunk: place, leading hash, surroundings and their hash."""

    def __init__(self, text: np.ndarray, bounds: np.ndarray, ids: np.ndarray):
        parts = [self._of(text, bounds, lo, hi) for lo, hi in self._pieces(bounds)]
        self.at, self.lead, self.around, self.before, self.after, row = (
            np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [()] * 6))
        self.lead, self.around = self.lead.astype(np.uint64), self.around.astype(np.uint64)
        self.id = ids[row] if len(ids) else np.zeros(0, np.int64)
        self.text = text
        self.leads, self.lead_of = np.unique(self.lead, return_inverse=True)

    @staticmethod
    def _pieces(bounds: np.ndarray):
        """Ranges of window starts: whole rows of about a segment, long rows in parts."""
        lo, rows = 0, len(bounds) - 1
        while lo < rows:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + C.SEGMENT, "right")) - 1)
            first, last = int(bounds[lo]), int(bounds[hi])
            for start in range(first, last, C.SEGMENT) if hi == lo + 1 else (first,):
                yield start, min(start + C.SEGMENT, last) if hi == lo + 1 else last
            lo = hi

    @staticmethod
    def _of(text, bounds, lo, hi):
        """Suffixes sampled by the windows that start in [lo, hi)."""
        base, top = max(0, lo - REACH), min(len(text), hi + 2 * SPAN)
        buf = text[base:top]
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        n = len(buf)
        order = np.ndarray((n,), "<u8", padded, 0, (1,)) * _STEP
        order &= C.U64(0xFFFFFFFF00000000)
        order |= np.arange(n, dtype=np.uint64)
        least, size = order, 1
        while size * 2 <= REACH + 1:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        rest = REACH + 1 - size
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        inner = np.clip(bounds, lo, hi)
        row_first = int(np.searchsorted(bounds, lo, "right")) - 1
        row_last = int(np.searchsorted(bounds, hi, "left"))
        ends = np.repeat(bounds[row_first + 1: row_last + 1], np.diff(inner[row_first: row_last + 1]))
        starts = np.flatnonzero(np.arange(lo + SPAN, hi + SPAN) <= ends) + lo
        if not len(starts):
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        at = (least[starts - base] & C.U64(0xFFFFFFFF)).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        row = np.searchsorted(bounds, at + base, "right") - 1
        before = np.minimum(at + base - bounds[row], REACH)
        after = np.minimum(bounds[row + 1] - at - base, SPAN)
        up, down = C.powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(C._BYTE[buf] * up[:n], out=sums[1:])
        lead = C.mix64((sums[at + GRAM] - sums[at]) * down[at])
        left = at - before
        around = (sums[at + after] - sums[left]) * down[left]
        around = C.mix64(around + before.astype(np.uint64) * _STEP + after.astype(np.uint64) * C.U64(0xC2B2AE3D27D4EB4F))
        return at + base, lead, around, before, after, row

    def repeated_here(self) -> np.ndarray:
        """Per distinct leading hash: whether this chunk has it under several ids."""
        low = np.full(len(self.leads), NO_ID, np.int64)
        high = np.full(len(self.leads), -2**63, np.int64)
        np.minimum.at(low, self.lead_of, self.id)
        np.maximum.at(high, self.lead_of, self.id)
        return low != high

    def classes(self, kept: np.ndarray) -> None:
        """Group the suffixes whose leading hash is ``kept`` by surroundings; the smallest id represents."""
        on = np.flatnonzero(kept[self.lead_of]) if len(kept) else np.zeros(0, np.int64)
        on = on[np.lexsort((self.id[on], self.around[on], self.lead[on]))]
        new = np.ones(len(on), bool)
        new[1:] = (self.lead[on[1:]] != self.lead[on[:-1]]) | (self.around[on[1:]] != self.around[on[:-1]])
        self.member, self.head = on, on[new]
        self.class_of = np.cumsum(new) - 1


def _ranges(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the 2**bits ranges of leading bits in sorted hashes."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << C.U64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _six(hashes: np.ndarray, bits: int) -> bytes:
    """The 48 bits behind the range's bits; an accidental equality only keeps a suffix for step 2."""
    short = (hashes << C.U64(bits)) >> C.U64(16)
    return short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


# ---------------------------------------------------------------- chunks

_CHUNK = "chunk long, size long, ids binary, known binary, bounds binary, text binary"


def _chunks(batches):
    task, count = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0

    def flush():
        nonlocal held, size, count
        ids = np.array([NO_ID if i is None else i for i, _ in held], np.int64)
        known = np.array([i is not None for i, _ in held], np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t) for _, t in held])]).astype(np.int64)
        packed = zstandard.ZstdCompressor(level=1).compress(b"".join(t for _, t in held))
        row = [(task << 32) + count, size, ids.tobytes(), known.tobytes(), bounds.tobytes(), packed]
        held, size, count = [], 0, count + 1
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if k < 2 else pa.binary()) for k, x in enumerate(row)],
                                          names=["chunk", "size", "ids", "known", "bounds", "text"])

    for batch in batches:
        ids = batch.column("id").to_pylist()
        for lo, hi, buf, bounds in C.text_groups(batch, "text"):
            for r in range(hi - lo):
                own = buf[bounds[r]: bounds[r + 1]].tobytes()
                held.append((ids[lo + r], own))
                size += len(own)
                if size >= CHUNK_BYTES:
                    yield flush()
    if held:
        yield flush()


def _opened(batch, k: int):
    ids = np.frombuffer(batch.column("ids")[k].as_py(), np.int64)
    bounds = np.frombuffer(batch.column("bounds")[k].as_py(), np.int64)
    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("text")[k].as_py()), np.uint8)
    return text, bounds, ids


def _returned(batch, name: str, k: int, dtype) -> np.ndarray:
    """What came back for a chunk, ranges in order."""
    parts = batch.column(name)[k].as_py() or []
    return np.concatenate([np.frombuffer(p["data"], dtype) for p in sorted(parts, key=lambda p: p["range"])] or [np.zeros(0, dtype)])


def _suffixes(batch, k: int, with_classes: bool) -> Suffixes:
    s = Suffixes(*_opened(batch, k))
    if with_classes:
        s.classes(_returned(batch, "kept", k, np.uint8).astype(bool))
    return s


# ---------------------------------------------------------------- steps 1 and 2

_PACKET = "range int, chunk long, n int, data binary, flags binary"


def _packets(rows):
    names = [x.split()[0] for x in _PACKET.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _send_leads(bits: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                s = _suffixes(batch, k, False)
                cut, many, chunk = _ranges(s.leads, bits), s.repeated_here().astype(np.uint8), batch.column("chunk")[k].as_py()
                yield _packets([(r, chunk, int(cut[r + 1] - cut[r]), _six(s.leads[cut[r]: cut[r + 1]], bits),
                                 many[cut[r]: cut[r + 1]].tobytes()) for r in np.flatnonzero(np.diff(cut)).tolist()])
    return run


def _answer(table, values: np.ndarray):
    """One row per packet with its part of ``values``."""
    cut = np.concatenate([[0], np.cumsum(table["n"].to_numpy())])
    return pa.table({"chunk": table["chunk"], "range": table["range"].cast(pa.int32()),
                     "data": pa.array([values[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())})


def _repeated(key, table):
    raw = np.frombuffer(b"".join(table["data"].to_pylist()), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    values = wide.view("<u8").ravel()
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    kept = np.frombuffer(b"".join(table["flags"].to_pylist()), np.uint8).copy()
    kept[order[1:][same]] = 1
    kept[order[:-1][same]] = 1
    return _answer(table, kept)


def _send_classes(bits: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                s = _suffixes(batch, k, True)
                cut, chunk = _ranges(s.lead[s.head], bits), batch.column("chunk")[k].as_py()
                rows = []
                for r in np.flatnonzero(np.diff(cut)).tolist():
                    own = s.head[cut[r]: cut[r + 1]]
                    data = np.concatenate([s.lead[own], s.around[own], s.id[own].astype(np.uint64)])
                    rows.append((r, chunk, len(own), data.tobytes(), b""))
                yield _packets(rows)
    return run


def _status(bucket: int):
    """Per class: 0 nothing to lose, 1 loses all windows, 2 to be compared, 3 the same among very many."""
    def run(key, table):
        parts = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in table["data"].to_pylist()]
        lead, around, ids = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.uint64)
        ids = ids.astype(np.int64)
        order = np.lexsort((ids, around, lead))
        l, a, i = lead[order], around[order], ids[order]
        new_lead = np.ones(len(order), bool)
        new_lead[1:] = l[1:] != l[:-1]
        new = new_lead.copy()
        new[1:] |= a[1:] != a[:-1]
        least = i[np.flatnonzero(new)][np.cumsum(new) - 1]
        group = np.cumsum(new_lead) - 1
        kinds = np.bincount(group[new], minlength=int(group[-1]) + 1 if len(group) else 0)[group]
        out = np.zeros(len(order), np.uint8)
        out[order] = np.where(i > least, 1, np.where(kinds > bucket, 3, np.where(kinds > 1, 2, 0)))
        return _answer(table, out)
    return run


# ---------------------------------------------------------------- step 3

_AROUND = "lead binary, around binary, before int, id long, chunk long, class int, crowded boolean"


def _send_around(batches):
    """The surroundings of every class that others with equal leading bytes may overlap."""
    for batch in batches:
        for k in range(batch.num_rows):
            s = _suffixes(batch, k, True)
            status = _returned(batch, "status", k, np.uint8)
            pick = np.flatnonzero(status >= 2)
            at, before, after = (x[s.head[pick]] for x in (s.at, s.before, s.after))
            data = s.text.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([data[p: p + GRAM] for p in at.tolist()], pa.binary()),
                 pa.array([data[p - b: p + a] for p, b, a in zip(at.tolist(), before.tolist(), after.tolist())], pa.binary()),
                 pa.array(before, pa.int32()), pa.array(s.id[s.head[pick]], pa.int64()),
                 pa.array([batch.column("chunk")[k].as_py()] * len(pick), pa.int64()), pa.array(pick, pa.int32()),
                 pa.array(status[pick] == 3)], names=[x.split()[0] for x in _AROUND.split(", ")])


def _windows(around: list[bytes], before: np.ndarray):
    """All windows (as rows of 7 big-endian words) with their surroundings and offset."""
    sizes = np.array([len(x) for x in around])
    grid = np.zeros((len(around), REACH + SPAN), np.uint8)
    shift = REACH - before
    flat = np.frombuffer(b"".join(around), np.uint8)
    row = np.repeat(np.arange(len(around)), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + shift[row]
    grid[row, column] = flat
    rows, offsets, words = [], [], []
    for j in range(REACH + 1):
        ok = np.flatnonzero((before >= j) & (sizes - before >= SPAN - j))
        wide = np.zeros((len(ok), 56), np.uint8)
        wide[:, :SPAN] = grid[ok, REACH - j: REACH - j + SPAN]
        rows.append(ok)
        offsets.append(np.full(len(ok), j))
        words.append(wide.view(">u8").astype(np.uint64))
    return np.concatenate(rows), np.concatenate(offsets), np.concatenate(words)


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): rows in lexicographic order, and a number per equal row, in that order.

    Multikey quicksort by columns: a column sorts the ties of the columns before it, and nothing else.
    """
    order = np.arange(len(words))
    group = np.zeros(len(words), np.int64)
    open_ = np.arange(len(words))  # places in ``order`` that are still tied
    for column in range(words.shape[1]):
        if not len(open_):
            break
        key = words[order[open_], column]
        by = np.lexsort((key, group[open_]))
        order[open_] = order[open_][by]
        key, own = key[by], group[open_]
        split = np.zeros(len(words), bool)
        split[open_[1:]] = (own[1:] == own[:-1]) & (key[1:] != key[:-1])
        edge = np.ones(len(words), bool)
        edge[1:] = group[1:] != group[:-1]
        group = np.cumsum(edge | split) - 1
        size = np.bincount(group)
        open_ = open_[size[group[open_]] > 1]
    return order, group


def _masks(around: list[bytes], before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bit j: the window that starts j bytes before the suffix also lies in a document of smaller id."""
    rows, offsets, words = _windows(around, before)
    mask = np.zeros(len(around), np.int64)
    if not len(rows):
        return mask
    order, group = multikey_sort(words)
    least = np.full(int(group[-1]) + 1, NO_ID, np.int64)
    np.minimum.at(least, group, ids[rows[order]])
    lost = order[least[group] < ids[rows[order]]]
    np.bitwise_or.at(mask, rows[lost], np.int64(1) << offsets[lost])
    return mask


def _compare(batches):
    """Rows arrive range-partitioned and sorted by leading bytes, which never cross partitions here."""
    held: list[pa.Table] = []

    def solve(table):
        mask = _masks(table["around"].to_pylist(), table["before"].to_numpy(), table["id"].to_numpy())
        on = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([pa.array(table["chunk"].to_numpy()[on]), pa.array(table["class"].to_numpy()[on]),
                                           pa.array(mask[on])], names=["chunk", "class", "mask"])

    for batch in batches:
        for lo in range(0, batch.num_rows, BUCKET):
            part = pa.Table.from_batches([batch.slice(lo, BUCKET)])
            lead = part["lead"].to_pylist()
            last = len(lead) - 1
            while last > 0 and lead[last - 1] == lead[-1]:
                last -= 1
            if last or (held and held[-1]["lead"][0] != part["lead"][0]):
                yield solve(pa.concat_tables([*held, part.slice(0, last)]))
                held = []
            held.append(part.slice(last))
    if held:
        yield solve(pa.concat_tables(held))


def _crowded(batches):
    """Each window of each row, for the comparison across buckets."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            rows, offsets, words = _windows(part.column("around").to_pylist(), part.column("before").to_numpy())
            raw = words.astype(">u8").view(np.uint8).reshape(-1, 56)[:, :SPAN]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in raw], pa.binary()), part.column("id").take(pa.array(rows)),
                 part.column("chunk").take(pa.array(rows)), part.column("class").take(pa.array(rows)),
                 pa.array(np.int64(1) << offsets)], names=["window", "id", "chunk", "class", "bit"])


# ---------------------------------------------------------------- the result

_RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_SPANS = "spans array<struct<start:long,end:long>>, kept binary"


def _remove(full: bool):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                s = _suffixes(batch, k, True)
                status = _returned(batch, "status", k, np.uint8)
                masks = np.zeros(len(s.head), np.int64)
                for m in batch.column("masks")[k].as_py() or []:
                    masks[m["class"]] |= m["mask"]
                member, own = s.member, s.class_of
                lost = (s.id[member] > s.id[s.head[own]]) | (status[own] == 1)
                fits = s.before[member] + s.after[member] >= SPAN
                whole = member[lost & fits]
                step = np.zeros(len(s.text) + 1, np.int32)
                np.add.at(step, s.at[whole] - s.before[whole], 1)
                np.add.at(step, s.at[whole] + s.after[whole], -1)
                rest = np.flatnonzero(~lost & (masks[own] != 0))
                for j in range(REACH + 1):
                    start = s.at[member[rest[(masks[own[rest]] >> j) & 1 == 1]]] - j
                    np.add.at(step, start, 1)
                    np.add.at(step, start + SPAN, -1)
                gone = np.cumsum(step[:-1]) > 0
                _, bounds, ids = _opened(batch, k)
                known = np.frombuffer(batch.column("known")[k].as_py(), np.uint8)
                rows = []
                for r in range(len(ids)):
                    lo, hi = int(bounds[r]), int(bounds[r + 1])
                    cut = gone[lo:hi]
                    edge = np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8))
                    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    left = s.text[lo:hi][~cut].tobytes()
                    row = {"id": int(ids[r]) if known[r] else None, "n_bytes": hi - lo, "n_removed": int(cut.sum()),
                           "n_spans": len(begin), "kept_sha256": hashlib.sha256(left).hexdigest()}
                    if full:
                        row |= {"spans": [{"start": int(x), "end": int(y)} for x, y in zip(begin, end)], "kept": left}
                    rows.append(row)
                kinds = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                         ("kept_sha256", pa.string())]
                if full:
                    kinds += [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))
    return run


def dedup(df: DataFrame, id_col: str, text_col: str, full: bool = False, bucket: int = BUCKET) -> DataFrame:
    """Per row: ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; with ``full`` also the
    removed ``spans`` (byte ranges) and the remaining bytes (``kept``)."""
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    path, name = C.scratch_path(spark, "chunks"), f"llm_chunks_{uuid.uuid4().hex}"
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (C.map_arrow(source, _chunks, _CHUNK).repartition(width, "chunk").write.bucketBy(width, "chunk").sortBy("chunk")
     .option("compression", "none").option("path", path).saveAsTable(name))
    chunks = spark.table(name)
    bytes_ = chunks.agg(F.sum("size")).first()[0] or 0
    # 6 bytes for about every 14th byte of text
    bits = max(int(np.ceil(np.log2(max(1, width)))), int(np.ceil(np.log2(max(1.0, bytes_ * 6 / 14 / RANGE_BYTES)))))

    def back(answers: DataFrame, column: str) -> DataFrame:
        # as many bytes as the chunk has suffixes, a fixed share of its text
        return answers.groupBy("chunk").agg(F.collect_list(F.struct("range", "data")).alias(column))

    reply = "chunk long, range int, data binary"
    leads = C.map_arrow(chunks, _send_leads(bits), _PACKET)
    kept = C.materialise(back(C.group_arrow(leads, ["range"], _repeated, reply), "kept"), "kept")
    known = chunks.join(kept, "chunk", "left")
    classes = C.map_arrow(known, _send_classes(bits), _PACKET)
    status = C.materialise(back(C.group_arrow(classes, ["range"], _status(bucket), reply), "status"), "status")
    known = known.join(status, "chunk", "left")
    around = C.materialise(C.map_arrow(known, _send_around, _AROUND), "around")
    sorted_ = around.where(~F.col("crowded")).drop("crowded").repartitionByRange(width, "lead").sortWithinPartitions("lead")
    answer = "chunk long, class int, mask long"
    near = C.map_arrow(sorted_, _compare, answer)
    windows = C.materialise(C.map_arrow(around.where("crowded"), _crowded, "window binary, id long, chunk long, class int, bit long"), "windows")
    least = windows.groupBy("window").agg(F.min("id").alias("least")).withColumnRenamed("window", "same")
    far = (windows.join(least, F.col("window") == F.col("same")).where("least < id")
           .groupBy("chunk", "class").agg(F.bit_or("bit").alias("mask")))
    masks = near.unionByName(far).groupBy("chunk").agg(F.collect_list(F.struct("class", "mask")).alias("masks"))
    known = known.join(C.materialise(masks, "masks"), "chunk", "left")
    return C.map_arrow(known, _remove(full), _RESULT + (", " + _SPANS if full else ""))
