"""Best-fit packing: pattern packing by non-negative least squares.

A document is its token ids and one end id; only documents longer than ``LENGTH`` are cut.  The pieces'
lengths form a histogram of ``LENGTH`` counts, the only thing the driver sees, whatever the input:

1. patterns of one to three lengths that fill a sequence exactly are enumerated (of the triples,
   those whose middle length lies on a grid of ``GRID`` tokens, so that the plan stays small);
2. non-negative least squares fits their repeat counts to the histogram (accelerated projected gradient);
3. counts are rounded down to what the histogram still holds;
4. what is left is packed length by length, longest first, each into the fullest open sequences that
   take it, all sequences with equal contents at once.

The plan says, for ranges of ranks within a length, where they go.  Ranks are made without a global
sort: each task numbers its own pieces per length, prefix sums over (length, task) do the rest; one
equi-join adds them and a map with the broadcast plan (bounded by the pattern grid) places every piece.

Defined results: null and empty texts are one end id; repeated documents are packed row by row; an
empty table gives no piece; very long texts are tokenised in segments; any id, null included, is
carried along.  Further columns stay untouched.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm import common as C

LENGTH = 2048
GRID = 16
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
CACHED_WORDS = 300_000  # about 60 MB in a Python worker
_CACHES: dict[str, "_Words"] = {}


# a word and the ASCII punctuation behind it: the tokenizer always separates the two
_TAIL = re.compile(rb"(.*[a-z0-9])([!-/:-@\[-`{-~]+)", re.DOTALL)


def _byte_alphabet() -> dict[int, str]:
    """The tokenizer's character for each byte: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class _Words(dict):
    """Ids (as little-endian 32-bit bytes) of words between ASCII white space, which no token crosses.

    Words of letters alone go straight to the tokenizer's merges, all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model = tokenizer.encode, tokenizer.model
        self.alphabet = _byte_alphabet()
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        steps = [x["type"] for x in layout["normalizer"]["normalizers"]] if layout.get("normalizer") else []
        self.plain = steps == ["NFC", "Replace", "Lowercase"]  # what the short cut relies on

    def ids(self, word: bytes) -> bytes:
        if self.plain and word.isalpha() and word.islower():  # ASCII letters: their own alphabet
            return array("I", [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        text = word.decode("utf-8", "replace")
        if self.plain and text.isalpha() and "\u03a3" not in text and unicodedata.is_normalized("NFC", text):
            low = text.lower()
            if low.isalpha():
                mapped = low.encode().decode("latin-1").translate(self.alphabet)
                return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        return array("I", self.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        # only a word that ends in ASCII punctuation has a tail to cut off
        tail = _TAIL.fullmatch(word) if self.plain and word[-1] < 97 and b"<|" not in word else None
        ids = self[tail[1]] + self[tail[2]] if tail else self.ids(word)
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def of(self, segment: bytes) -> np.ndarray:
        """Ids of a text, or of a part that ends before white space."""
        if not self.plain:
            words = segment.split()
        elif b"<|" in segment:  # a special token may be there, and those are case-sensitive
            words = [w if b"<|" in w else w.lower() for w in segment.split()]
        else:
            words = segment.lower().split()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4")


def _words(path: str | None) -> _Words:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(TOKENIZER)
    if path not in _CACHES:
        _CACHES[path] = _Words(path)
    return _CACHES[path]


def _segments(text: np.ndarray, size: int = 1 << 20):
    """Bytes of a text in segments that end before white space."""
    lo = 0
    while lo < len(text):
        hi = min(lo + size, len(text))
        while hi < len(text):
            space = np.flatnonzero(~C.NON_SPACE[text[hi: hi + size]])
            if len(space):
                hi += int(space[0])
                break
            hi = min(hi + size, len(text))
        yield text[lo:hi].tobytes()
        lo = hi


def pieces_of(text: np.ndarray, words: _Words, length: int = LENGTH):
    """Token ids of the pieces of one text (bytes)."""
    held = np.zeros(0, "<u4")
    for segment in _segments(text):
        ids = words.of(segment)
        held = np.concatenate([held, ids]) if len(held) else ids
        while len(held) > length:
            yield held[:length]
            held = held[length:]
    held = np.append(held, np.uint32(END_ID)).astype("<u4")
    for lo in range(0, len(held), length):
        yield held[lo: lo + length]


MADE = ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")
_PIECE = "__task int, piece int, start long, length long, ids_crc32 long, __rank long"


def pieces(df: DataFrame, text_col: str, keep: list[str], tokenizer: str | None = None,
           with_ids: bool = False) -> DataFrame:
    """One row per piece: ``keep`` columns, place in the document, CRC-32 (and ids if asked for)."""
    keep = C.apart(keep, MADE)
    source = df.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))

    def run(batches):
        words, task = _words(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(LENGTH + 1, np.int64)
        for batch in batches:
            columns = [batch.column(c) for c in keep]
            for lo, hi, buf, bounds in C.text_groups(batch, "__text", 4 * C.SEGMENT):
                rows, out, ids = [], [], []
                for r in range(hi - lo):
                    start = 0
                    for k, own in enumerate(pieces_of(buf[bounds[r]: bounds[r + 1]], words)):
                        rows.append(lo + r)
                        out.append((task, k, start, len(own), zlib.crc32(own.tobytes()), seen[len(own)]))
                        ids.append(own)
                        seen[len(own)] += 1
                        start += len(own)
                task_, piece, start, length, crc, rank = (np.array(x) for x in zip(*out))
                made = [pa.array(task_, pa.int32()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(rank, pa.int64())]
                if with_ids:
                    made.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int64())))
                names = ["__task", "piece", "start", "length", "ids_crc32", "__rank"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([c.take(pa.array(rows)) for c in columns] + made, names=[*keep, *names])

    return C.map_arrow(source, run, C.with_columns(source, keep, _PIECE + ", ids array<long>" * with_ids))


# ---------------------------------------------------------------- the plan, from the histogram alone

def patterns(counts: np.ndarray, length: int = LENGTH, grid: int = GRID) -> np.ndarray:
    """(patterns, 3) lengths, 0 where a pattern has fewer, that fill a sequence and occur."""
    here = np.flatnonzero(counts[: length + 1])
    here = here[here > 0]
    has = np.zeros(length + 1, bool)
    has[here] = True
    found = [np.array([[length, 0, 0]])] if has[length] else []
    big = here[(here >= length - here) & (here < length)]
    big = big[has[length - big]]
    found.append(np.stack([big, length - big, np.zeros_like(big)], axis=1))
    middle = here[here % grid == 0]
    a, b = np.meshgrid(here, middle, indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = length - a - b
    ok = (c > 0) & (a >= b) & (b >= c)
    ok[ok] = has[c[ok]]
    found.append(np.stack([a[ok], b[ok], c[ok]], axis=1))
    return np.concatenate(found).astype(np.int64)


def fit(table: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance of the patterns' lengths to ``counts``."""
    target = counts.astype(np.float64)
    size = len(counts)

    def used(x):
        total = np.zeros(size)
        for k in range(3):
            total += np.bincount(table[:, k], weights=x, minlength=size)
        total[0] = 0.0
        return total

    def back(r):
        r = r.copy()
        r[0] = 0.0
        return r[table[:, 0]] + r[table[:, 1]] + r[table[:, 2]]

    if not len(table):
        return np.zeros(0)
    v = np.ones(len(table))
    for _ in range(20):  # largest eigenvalue, for the step length
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(table))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(used(y) - target) / (1.05 * top))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(counts: np.ndarray, length: int = LENGTH, grid: int = GRID) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): all pieces of the histogram packed into sequences."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    table = patterns(left, length, grid)
    repeats = np.floor(fit(table, left) + 1e-6).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] <= 0:
            break
        row = [int(x) for x in table[k] if x]
        n = min(int(repeats[k]), *(int(left[x]) // row.count(x) for x in row))
        if n > 0:
            for x in row:
                left[x] -= n
            out.append((tuple(row), n))
    # the rest: longest first, into the fullest open sequences that still take it
    open_: list[list[list]] = [[] for _ in range(length + 1)]  # by room: [lengths, sequences]
    for x in range(length, 0, -1):
        todo = int(left[x])
        room = x
        while todo and room <= length:
            if open_[room]:
                own, n = open_[room].pop()
                fit_each = room // x
                take = min(n, todo // fit_each) if todo >= fit_each else 0
                if take:
                    open_[room - fit_each * x].append([own + (x,) * fit_each, take])
                    todo -= take * fit_each
                else:
                    take = 1
                    open_[room - todo * x].append([own + (x,) * todo, 1])
                    todo = 0
                if n > take:
                    open_[room].append([own, n - take])
            else:
                room += 1
        if todo:
            each = length // x
            if todo >= each:
                open_[length - each * x].append([(x,) * each, todo // each])
            if todo % each:
                open_[length - (todo % each) * x].append([(x,) * (todo % each), 1])
    out.extend((own, n) for level in open_ for own, n in level)
    return out


def placements(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted by length and rank."""
    rows, used, sequence = [], {}, 0
    for lengths, n in planned:
        offset = 0
        for x in lengths:
            first = used.get(x, 0)
            rows.append((x, first, sequence, offset))
            used[x] = first + n
            offset += x
        sequence += n
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(df: DataFrame, text_col: str, keep: list[str], tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every row with ``sequence_id`` and ``offset``; sequences are gapless from 0."""
    spark, keep = df.sparkSession, C.apart(keep, MADE)
    base = C.materialise(pieces(df, text_col, keep, tokenizer, with_ids), "pieces")
    per_task = base.groupBy("__task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(LENGTH + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # LENGTH rows at most
        counts[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(placements(plan(counts)))
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select("__task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    ranked = base.join(firsts, ["__task", "length"]).withColumn("__rank", F.col("__rank") + F.col("__first"))
    columns = [*keep, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = ranked.select(*columns, "__rank")

    def run(batches):
        table = shared.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("__rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])],
                names=[*columns, "sequence_id", "offset"])

    return C.map_arrow(ranked, run, C.with_columns(ranked, columns, "sequence_id long, offset long"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of a packing made ``with_ids``: at most ``LENGTH`` ids per row."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
