"""Benchmark decontamination by winnowing.

Both sides are cut into words (letters, digits and non-ASCII characters, A-Z lower-cased) and
hashed ``GRAM``-word grams.  Of every ``SPAN - GRAM + 1`` consecutive grams the smallest hash (the
leftmost on ties) is a fingerprint, so two texts that share ``SPAN`` words share a fingerprint at the
same place of the span.  An item of fewer than ``SPAN`` words is one gram of its whole length; documents
look for such grams at every position.  Document fingerprints that miss a fixed-size bitmap of the
benchmark's are dropped before the join; a full bitmap only lets more through.  The rest are
joined on the fingerprint with their neighbouring words, and each meeting is extended word by
word in both directions: only spans of at least ``SPAN`` equal words (or a whole short item) count.

The per-document pass is written once to the shared folder; meetings are pre-filtered rows, a
frequent passage is a skewed equi-join that adaptive execution splits.  Equal items are joined once.

Defined results: null and empty texts have no words and no hit; null item texts hit nothing; items
with a null id mark words but are not listed; repeated documents are judged row by row, repeated
items count once per id; empty tables give an empty result or no hit.  Further columns stay apart
from the working columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm import common as C

SPAN = 10
GRAM = 5
BITMAP_BITS = 22
_SHIFT = C.U64(64 - BITMAP_BITS)


def _salted(words: np.ndarray, n: int) -> np.ndarray:
    return C.mix64(C.rolling(words, n) + C.U64(n))


def _neighbours(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Word hashes around grams at ``at``: SPAN - GRAM before to SPAN after; 0 outside the row."""
    reach = np.arange(GRAM - SPAN, SPAN)
    where = at[:, None] + reach[None, :]
    ok = (where >= low[:, None]) & (where < high[:, None])
    return np.where(ok, words[np.clip(where, 0, max(len(words) - 1, 0))], C.U64(0))


WIDTH = 2 * SPAN - GRAM  # words carried with a meeting


def _winnowed(h: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which grams at ``at`` are the leftmost minimum of a whole window within their row's grams."""
    window = SPAN - GRAM + 1
    left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    go_left, go_right = np.ones(len(at), bool), np.ones(len(at), bool)
    for k in range(1, window):
        j = at - k
        go_left &= (j >= low) & (h[np.maximum(j, 0)] > h[at])
        left += go_left
        j = at + k
        go_right &= (j < high) & (h[np.minimum(j, len(h) - 1)] >= h[at])
        right += go_right
    return left + right + 1 >= window


def _fingerprints(batch: pa.RecordBatch, column: str, lengths: list[int], bitmap: np.ndarray | None):
    """Yield per row (row, words, [(fingerprint, place, neighbours)]); bitmap None keeps all."""
    for lo, hi, buf, bounds in C.text_groups(batch, column):
        low = C.LOWER[buf]
        starts, ends = C.word_spans(low, C.ALNUM, bounds)
        words = C.span_hashes(low, starts, ends)
        first = C.row_of(starts, bounds)
        found = []  # (fingerprints, places, row lows, row highs)
        rows = np.repeat(np.arange(hi - lo), np.diff(first))
        for n in sorted({GRAM, *lengths} if bitmap is not None else {GRAM}):
            for salted in ((False, True) if n == GRAM and n in lengths else (n != GRAM,)):
                h = _salted(words, n) if salted else C.rolling(words, n)
                if not len(h):
                    continue
                at = np.flatnonzero(bitmap[h >> _SHIFT]) if bitmap is not None else np.arange(len(h))
                row_low, row_high = first[rows[at]], first[rows[at] + 1]
                keep = at + n <= row_high
                at, row_low, row_high = at[keep], row_low[keep], row_high[keep]
                if not salted:
                    keep = _winnowed(h, at, row_low, row_high - n + 1)
                    at, row_low, row_high = at[keep], row_low[keep], row_high[keep]
                found.append((h[at], at, row_low, row_high))
        if found:
            h, at, row_low, row_high = (np.concatenate(x) for x in zip(*found))
            around = _neighbours(words, at, row_low, row_high)
            order = np.argsort(rows[at], kind="stable")
            cut = np.searchsorted(rows[at][order], np.arange(hi - lo + 1))
        for r in range(hi - lo):
            n_words = int(first[r + 1] - first[r])
            pick = order[cut[r]: cut[r + 1]] if found else ()
            yield lo + r, n_words, [(h[i], at[i] - first[r], around[i]) for i in pick], words[first[r]: first[r + 1]]


_HIT = pa.struct([("fp", pa.int64()), ("at", pa.int32()), ("around", pa.binary())])


def _document_pass(keep: list[str], lengths: list[int], shared):
    def run(batches):
        bitmap = shared.value
        for batch in batches:
            n, hits = [0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            for r, n_words, found, _ in _fingerprints(batch, "__text", lengths, bitmap):
                n[r] = n_words
                hits[r] = [{"fp": int(h.astype(np.int64)), "at": int(at), "around": around.tobytes()}
                           for h, at, around in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(hits, pa.list_(_HIT))],
                names=[*keep, "__n_words", "__hits"])
    return run


def _item_pass(batches):
    """One row per fingerprint of each item: winnowed grams, or the whole of a short item."""
    for batch in batches:
        keys = batch.column("item").to_pylist()
        out = {"item": [], "ifp": [], "iaround": [], "n": []}
        for r, n_words, found, words in _fingerprints(batch, "text", [], None):
            if 0 < n_words < SPAN:
                around = np.zeros(WIDTH, np.uint64)
                around[SPAN - GRAM: SPAN - GRAM + n_words] = words
                found = [(_salted(words, n_words)[0], 0, around)]
            for h, _, around in found if n_words else ():
                out["item"].append(keys[r])
                out["ifp"].append(int(h.astype(np.int64)))
                out["iaround"].append(around.tobytes())
                out["n"].append(min(n_words, SPAN))
        yield pa.RecordBatch.from_pydict({"item": pa.array(out["item"], pa.binary()), "ifp": pa.array(out["ifp"], pa.int64()),
                                          "iaround": pa.array(out["iaround"], pa.binary()), "n": pa.array(out["n"], pa.int32())})


def _extend(batches):
    """Extend each meeting word by word; keep the spans that hold a whole window."""
    left = SPAN - GRAM
    for batch in batches:
        def matrix(name):
            return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint64).reshape(-1, WIDTH)
        a, b = matrix("around"), matrix("iaround")
        n = batch.column("n").to_numpy()
        equal = (a == b) & (a != 0)
        before = np.cumprod(equal[:, left - 1:: -1] if left else equal[:, :0], axis=1).sum(axis=1)
        after = np.cumprod(equal[:, left:], axis=1).sum(axis=1)
        short = n < SPAN
        before, after = np.where(short, 0, before), np.where(short, np.minimum(after, n), after)
        good = np.where(short, after == n, (after >= GRAM) & (before + after >= SPAN))
        at = batch.column("at").to_numpy().astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid").filter(pa.array(good)), batch.column("item").filter(pa.array(good)),
             pa.array((at - before)[good]), pa.array((at + after)[good])],
            names=["rid", "item", "begin", "finish"])


def find_hits(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str,
              keep: list[str]) -> DataFrame:
    """``keep`` columns of every document row with ``n_words``, ``n_hit``, ``n_items``, ``item_ids``
    (sorted strings) and ``spans`` (disjoint hit ranges of words, end exclusive)."""
    keep = C.apart(keep, ("n_words", "n_hit", "n_items", "item_ids", "spans"))
    spark = docs.sparkSession
    plain = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    classes = plain.where("text IS NOT NULL").select(
        F.unhex(F.sha2("text", 256)).alias("item"), "item_id", "text")
    texts = classes.groupBy("item").agg(F.first("text").alias("text"))
    prints = C.materialise(C.map_arrow(texts, _item_pass, "item binary, ifp long, iaround binary, n int"), "items")
    # both are of fixed size: at most 2**BITMAP_BITS slots, at most SPAN - 1 lengths
    bitmap = C.Flags(spark, C.bitmap(prints, "ifp", BITMAP_BITS))
    lengths = [r["n"] for r in prints.select("n").distinct().collect() if r["n"] < SPAN]

    source = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    layout = C.with_columns(source, keep, "__n_words long, __hits array<struct<fp:long,at:int,around:binary>>")
    passed = C.map_arrow(source, _document_pass(keep, lengths, bitmap), layout)
    base = C.materialise(passed.withColumn("__rid", F.monotonically_increasing_id()), "documents")
    hits = base.select(F.col("__rid").alias("rid"), F.explode("__hits").alias("h")).select("rid", "h.*")
    met = hits.join(prints, F.col("fp") == F.col("ifp")).select("rid", "at", "around", "item", "iaround", "n")
    spans = C.materialise(C.map_arrow(met, _extend, "rid long, item binary, begin long, finish long").distinct(), "spans")

    order = Window.partitionBy("rid").orderBy("begin")
    merged = (spans.groupBy("rid", "begin").agg(F.max("finish").alias("finish"))
              .withColumn("reached", F.max("finish").over(order.rowsBetween(Window.unboundedPreceding, -1)))
              .withColumn("fresh", F.greatest("begin", F.coalesce("reached", "begin")))
              .where("finish > fresh"))
    ranges = merged.groupBy("rid").agg(F.sum(F.col("finish") - F.col("fresh")).alias("n_hit"),
                                       F.sort_array(F.collect_list(F.struct("fresh", "finish"))).alias("spans"))
    listed = (spans.select("rid", "item").distinct().join(classes.select("item", "item_id").distinct(), "item")
              .groupBy("rid").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")))
    facts = ranges.join(listed, "rid", "left")
    none = F.expr("cast(array() as array<string>)")
    facts = facts.withColumnsRenamed({c: f"__{c}" for c in ("n_hit", "item_ids", "spans")}).withColumnRenamed("rid", "__of")
    out = base.join(facts, F.col("__rid") == F.col("__of"), "left").select(
        *keep, F.col("__n_words").alias("n_words"), F.coalesce("__n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("__item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("__item_ids", none).alias("item_ids"),
        F.coalesce("__spans", F.expr("cast(array() as array<struct<fresh:long,finish:long>>)")).alias("spans"))
    return out

