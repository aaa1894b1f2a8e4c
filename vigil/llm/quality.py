"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL, scored as sparse dots.

Features of a text: its words (anything between ASCII white space, case kept) and word bigrams, a
bigram that repeats its word also as one shared feature, each hashed to one of ``2**BITS`` slots;
a slot's value is ln(1 + count), the vector has length 1.  Training runs follow-the-regularised-
leader (per-coordinate rates, L1 and L2) over a bounded, documented sample of labelled rows, cut into
shards of about ``SHARD_ROWS`` whose weights are averaged, so no task holds more than a shard and
the model has a fixed size.  Scoring is one narrow pass: no shuffle, the weights are broadcast.

Defined results: null and empty texts have no features and score the bias alone; null labels are
ignored, repeated label rows of a document count once (the larger label); repeated documents are
scored row by row; a null id is scored and never trains; without any labelled row all weights are
zero and every score is 0.5.  Very long texts are hashed in segments.  Only the named columns
are read, so further columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common as C

BITS = 18
SHARD_ROWS = 2048
MAX_TRAINING_ROWS = 16_384
EPOCHS = 4
DAMP = 20.0  # added to the squared length: the few words of a short text say less
_SAME = C.U64(0x5BD1E9955BD1E995)


def features(batch: pa.RecordBatch, column: str):
    """Yield (row, slots, values) of each text in the batch."""
    shift = C.U64(64 - BITS)
    for lo, hi, buf, bounds in C.text_groups(batch, column):
        starts, ends = C.word_spans(buf, C.NON_SPACE, bounds)
        words = C.span_hashes(buf, starts, ends)
        first = C.row_of(starts, bounds)
        pairs = C.rolling(words, 2)
        same = words[1:] == words[:-1]
        for r in range(hi - lo):
            a, b = first[r], first[r + 1]
            if a == b:
                yield lo + r, np.zeros(0, np.int32), np.zeros(0, np.float32)
                continue
            twice = int(same[a: b - 1].sum())
            raw = np.concatenate([words[a:b], pairs[a: b - 1], np.full(twice, _SAME)])
            slots, counts = np.unique((raw >> shift).astype(np.int32), return_counts=True)
            values = np.log1p(counts).astype(np.float32)
            yield lo + r, slots, values / np.sqrt(DAMP + (values * values).sum())


def _featurise(label: str, shards: int):
    def run(batches):
        for batch in batches:
            labels = batch.column(label).to_pylist()
            ids = batch.column("id").to_pylist()
            rows = [(r, s, v) for r, s, v in features(batch, "text")]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([hash(ids[r]) % shards for r, _, _ in rows], pa.int32()),
                "id": pa.array([ids[r] for r, _, _ in rows], pa.int64()),
                "y": pa.array([labels[r] for r, _, _ in rows], pa.int32()),
                "slots": pa.array([s.tobytes() for _, s, _ in rows], pa.binary()),
                "values": pa.array([v.tobytes() for _, _, v in rows], pa.binary()),
            })
    return run


def ftrl(rows, alpha=3.0, beta=1.0, l1=1e-4, l2=1e-4, epochs=EPOCHS) -> np.ndarray:
    """FTRL-proximal over (slots, values, y) rows.  The last weight, the bias, is not learned: it is
    the log-odds of the shard's labels, so a text without evidence scores their share."""
    n = 1 << BITS
    ones = sum(y for _, _, y in rows)
    bias = np.log((ones + 1.0) / (len(rows) - ones + 1.0))
    z, sq = np.zeros(n), np.zeros(n)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(sq[i])) / alpha + l2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            i, x, y = rows[k]
            w = weights(i)
            g = (1.0 / (1.0 + np.exp(-bias - float(w @ x))) - y) * x
            grown = sq[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(sq[i])) / alpha * w
            sq[i] = grown
    return np.append(weights(np.arange(n)), bias).astype(np.float32)


def _fit_shard(key, table):
    table = table.sort_by([("id", "ascending")])
    rows = [(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32), y) for s, v, y in
            zip(table["slots"].to_pylist(), table["values"].to_pylist(), table["y"].to_pylist())]
    return pa.table({"n": pa.array([len(rows)], pa.int64()), "w": pa.array([ftrl(rows).tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
          max_rows: int = MAX_TRAINING_ROWS) -> np.ndarray:
    """Weights from at most ``max_rows`` labelled rows (those whose id hashes lowest)."""
    chosen = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the sample is bounded by max_rows, so the broadcast is too
    shards = -(-chosen.count() // SHARD_ROWS) or 1
    picked = C.map_arrow(rows.join(F.broadcast(chosen), "id"), _featurise("y", shards),
                         "shard int, id long, y int, slots binary, values binary")
    fitted = C.group_arrow(picked, ["shard"], _fit_shard, "n long, w binary").collect()
    if not fitted:
        return np.zeros((1 << BITS) + 1, np.float32)
    total = sum(r["n"] for r in fitted)
    return sum(np.frombuffer(r["w"], np.float32) * (r["n"] / total) for r in fitted).astype(np.float32)


def score(df: DataFrame, weights: np.ndarray, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row with ``score`` (probability of label 1)."""
    keep = C.apart(keep, ("score",))
    model = df.sparkSession.sparkContext.broadcast(weights)
    plain = df.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))

    def run(batches):
        w = model.value
        for batch in batches:
            out = np.full(batch.num_rows, float(w[-1]))
            for r, slots, values in features(batch, "__text"):
                out[r] += float(w[slots] @ values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(1.0 / (1.0 + np.exp(-out)), pa.float64())],
                names=[*keep, "score"])

    return C.map_arrow(plain, run, C.with_columns(plain, keep, "score double"))
