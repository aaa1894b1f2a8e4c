"""Toxicity: maximum-scoring segments over token log-odds, calibrated as extreme values.

Tokens are words (letters, digits, non-ASCII bytes; A-Z lower-cased).  Each has a log-odds score
from labelled texts, smoothed by Dirichlet priors in two levels: the word's prior is its leading
``STEM`` bytes, and theirs is the ratio 1.  ``DRIFT`` is subtracted so that ordinary text scores
below zero.  One linear scan per text then finds all maximal scoring segments; a segment of score S in
a text of n tokens has the expected count E = K n exp(-lambda S) in clean text, where lambda solves
sum p exp(lambda s) = 1 over the clean tokens and K is read off the clean texts' largest segments.
The text's evidence is the sum of -ln E over the segments with E below ``SIGNIFICANT``; a logistic
curve, fitted on labelled texts that the log-odds did not see, turns it into a probability.

Learning uses a documented, bounded sample of labelled rows (``MAX_TRAINING_ROWS``); the model is a
table of ``2**BITS`` word slots and ``2**STEM_BITS`` stem slots, whatever the input.  Scoring
is one narrow pass over whole texts: no shuffle, the model is broadcast.

Defined results: null and empty texts have no segment and score the curve's value at zero evidence;
null labels are ignored, repeated label rows of a document count once (the larger label); repeated
documents are scored row by row; a null id is scored and never trains; with only one label
present, every score is that label's smoothed share.  Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import common as C

BITS = 20
STEM_BITS = 16
STEM = 4
DRIFT = 1.0
CEILING = 8.0
PRIOR = 4.0          # pseudo-tokens behind each word, divided as its stem's ratio says
STEM_PRIOR = 8.0     # pseudo-tokens per class behind each stem
SIGNIFICANT = 0.5
MAX_TRAINING_ROWS = 50_000
FOLDS = 4
BLOCKS = 64           # slices of the slot table while counting


@dataclass
class Model:
    counts: np.ndarray        # float32 (2, word slots): clean and toxic counts, the classes brought to one size
    stems: np.ndarray         # float32 per stem slot: smoothed toxic to clean ratio
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = 0.0


def _tokens(batch: pa.RecordBatch, column: str):
    """Yield (first row, last row + 1, word slots, stem slots, repeats its neighbour?, first word of each row)."""
    for lo, hi, buf, bounds in C.text_groups(batch, column):
        low = C.LOWER[buf]
        starts, ends = C.word_spans(low, C.ALNUM, bounds)
        words = C.span_hashes(low, starts, ends) >> C.U64(64 - BITS)
        stems = C.span_hashes(low, starts, np.minimum(ends, starts + STEM)) >> C.U64(64 - STEM_BITS)
        words, first = words.astype(np.int64), C.row_of(starts, bounds)
        again = np.zeros(len(words), bool)  # a word right after itself says nothing new
        again[1:] = words[1:] == words[:-1]
        again[first[:-1][np.diff(first) > 0]] = False
        yield lo, hi, words, stems.astype(np.int64), again, first


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    Only runs of positive scores are visited: a gap enters through the prefix sums.
    """
    up = scores > 0
    if not up.any():
        return []
    edge = np.diff(np.concatenate([[False], up, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    held: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum through
    link: list[int] = []                            # nearest earlier held segment with a smaller sum before
    for s, e, left, right in zip(begin.tolist(), end.tolist(), total[begin].tolist(), total[end].tolist()):
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = link[j]
            if j < 0 or held[j][3] >= right:
                held.append((s, e, left, right))
                link.append(j)
                break
            s, left = held[j][0], held[j][2]
            del held[j:], link[j:]
    return [(s, e, right - left) for s, e, left, right in held]


def _row_scores(model: Model, words: np.ndarray, stems: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Log-odds of each token under its word's counts and its stem's prior, less the drift."""
    odds = (model.counts[1][words] + PRIOR * model.stems[stems]) / (model.counts[0][words] + PRIOR)
    return np.where(again, -DRIFT, np.clip(np.log(odds) - DRIFT, -CEILING, CEILING))


def _log_e(model: Model, n: int, score: float) -> float:
    """ln E: expected number of segments of ``score`` or more in n clean tokens."""
    return model.log_k + np.log(max(n, 1)) - model.lam * score


def _evidence(model: Model, n: int, scores) -> float:
    """Summed -ln E of the significant segments."""
    logs = (_log_e(model, n, v) for v in scores)
    return sum(-x for x in logs if x < np.log(SIGNIFICANT))


def evidence(model: Model, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
    """Summed -ln E of the significant segments, and those segments with their E."""
    found = [(s, e, _log_e(model, len(scores), v)) for s, e, v in segments(scores)]
    found = [(s, e, x) for s, e, x in found if x < np.log(SIGNIFICANT)]
    return sum(-x for _, _, x in found), [(s, e, float(np.exp(x))) for s, e, x in found]


# ---------------------------------------------------------------- learning

def _count(batches):
    """Per task: (fold, block, kind, counts) of labelled tokens; kind 0 clean, 1 toxic."""
    words = np.zeros((FOLDS, 2, 1 << BITS), np.uint32)
    stems = np.zeros((FOLDS, 2, 1 << STEM_BITS), np.uint32)
    seen = set()
    for batch in batches:
        labels, folds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold"))
        for lo, hi, w, s, again, first in _tokens(batch, "text"):
            sizes = np.diff(first)
            y, f = np.repeat(labels[lo:hi], sizes)[~again], np.repeat(folds[lo:hi], sizes)[~again]
            w, s = w[~again], s[~again]
            for k in set(zip(folds[lo:hi].tolist(), labels[lo:hi].tolist())):
                seen.add(k)
                on = (f == k[0]) & (y == k[1])
                np.add.at(words[k], w[on], 1)
                np.add.at(stems[k], s[on], 1)
    width = (1 << BITS) // BLOCKS
    for fold, kind in sorted(seen):
        own = words[fold, kind]
        yield pa.RecordBatch.from_pydict({
            "fold": pa.array([fold] * (BLOCKS + 1), pa.int32()), "block": pa.array([*range(BLOCKS), -1], pa.int32()),
            "kind": pa.array([kind] * (BLOCKS + 1), pa.int32()),
            "counts": pa.array([*(own[b * width: (b + 1) * width].tobytes() for b in range(BLOCKS)),
                                stems[fold, kind].tobytes()], pa.binary())})


def _add(key, table):
    total = None
    for blob in table["counts"].to_pylist():
        part = np.frombuffer(blob, np.uint32).astype(np.float64)
        total = part if total is None else total + part
    fold, block, kind = (pa.array([k.as_py()], pa.int32()) for k in key)
    return pa.table({"fold": fold, "block": block, "kind": kind, "counts": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _model(words: np.ndarray, stems: np.ndarray) -> Model:
    size = np.maximum(stems.sum(axis=1, keepdims=True), 1.0)
    unit = size.sum() / 2.0 / size
    even = stems * unit
    return Model(counts=(words * unit).astype(np.float32),
                 stems=((even[1] + STEM_PRIOR) / (even[0] + STEM_PRIOR)).astype(np.float32))


GRID = np.arange(-CEILING, CEILING + 0.25, 0.25)  # bin centres of the score histogram


def _statistics(models):
    """Per labelled text, under the model that did not see it: tokens, segment scores, score histogram."""
    def run(batches):
        held_out = models.value
        for batch in batches:
            size, folds = batch.num_rows, batch.column("fold").to_pylist()
            n, found, bins = [0] * size, [[] for _ in range(size)], [b""] * size
            for lo, hi, w, s, again, first in _tokens(batch, "text"):
                for r in range(hi - lo):
                    at = slice(first[r], first[r + 1])
                    own = _row_scores(held_out[folds[lo + r]], w[at], s[at], again[at])
                    n[lo + r] = len(own)
                    found[lo + r] = [v for _, _, v in segments(own)]
                    place = np.rint((own + CEILING) / 0.25).astype(np.int64)
                    bins[lo + r] = np.bincount(place, minlength=len(GRID)).astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_pydict({
                "y": batch.column("y"), "n": pa.array(n, pa.int64()), "found": pa.array(found, pa.list_(pa.float64())),
                "bins": pa.array(bins, pa.binary())})
    return run


def _lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """Root of sum p exp(lambda s) = 1 over background tokens (mean score below zero)."""
    p = weights / weights.sum()
    if (p[scores > 0]).sum() <= 0 or (p * scores).sum() >= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    f = lambda x: float((p * np.exp(x * scores)).sum()) - 1.0
    while f(hi) < 0 and hi < 50:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return min(max(lo, 0.05), 10.0)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps; a weak prior holds the slope near 1 while labels are few."""
    a, b = 1.0, float(np.log((y.sum() + 1.0) / ((1 - y).sum() + 1.0)))
    design = np.stack([x, np.ones_like(x)])
    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * x + b, -30, 30)))
        grad = design @ (p - y) + np.array([a - 1.0, 1e-3 * b])
        hess = (design * (p * (1 - p))) @ design.T + np.diag([1.0, 1e-3])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
          max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Model from at most ``max_rows`` labelled rows (those whose id hashes lowest).

    All of the sample gives the token counts; what calibrates them is each text's result under the
    counts of the other folds.
    """
    spark = docs.sparkSession
    chosen = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FOLDS)).cast("int"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the sample is bounded by max_rows, so the broadcast is too
    sample = C.materialise(rows.join(F.broadcast(chosen), "id"), "labelled")
    words, stems = np.zeros((FOLDS, 2, 1 << BITS), np.float32), np.zeros((FOLDS, 2, 1 << STEM_BITS), np.float32)
    width = (1 << BITS) // BLOCKS
    layout = "fold int, block int, kind int, counts binary"
    for r in C.group_arrow(C.map_arrow(sample, _count, layout), ["fold", "block", "kind"], _add, layout).toLocalIterator():
        part = np.frombuffer(r["counts"], np.float32)
        if r["block"] < 0:
            stems[r["fold"], r["kind"]] = part
        else:
            words[r["fold"], r["kind"], r["block"] * width: (r["block"] + 1) * width] = part
    all_words, all_stems = words.sum(axis=0), stems.sum(axis=0)
    model = _model(all_words, all_stems)
    others = spark.sparkContext.broadcast([_model(all_words - words[f], all_stems - stems[f]) for f in range(FOLDS)])
    # one small row for each row of the bounded sample
    seen = C.map_arrow(sample, _statistics(others), "y int, n long, found array<double>, bins binary").toPandas()
    C.discard(spark, sample)
    others.destroy()
    clean = seen[(seen.y == 0) & (seen.n > 0)]
    if len(clean):
        model.lam = _lambda(GRID, sum(np.frombuffer(x, np.uint32).astype(np.float64) for x in clean.bins))
        top = np.array([max(x, default=0.0) for x in clean.found])
        model.log_k = float(np.quantile(model.lam * top - np.log(clean.n.to_numpy()), 0.95) + np.log(-np.log(0.95)))
    x = np.array([_evidence(model, n, found) for n, found in zip(seen.n, seen.found)], float)
    if len(seen):
        model.slope, model.offset = _logistic(np.log1p(x), seen.y.to_numpy(dtype=float))
    return model


# ---------------------------------------------------------------- scoring

def score(df: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row, ``score``, and the toxic spans found: tokens and E-value."""
    keep = C.apart(keep, ("score", "spans"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    plain = df.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    span = pa.struct([("first_token", pa.int32()), ("last_token", pa.int32()), ("e_value", pa.float64())])

    def run(batches):
        m = shared.value
        for batch in batches:
            out, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for lo, hi, w, s, again, first in _tokens(batch, "__text"):
                scores = _row_scores(m, w, s, again)
                busy = np.add.reduceat(np.append(scores > 0, False).astype(np.int32), first[:-1]) if len(scores) else []
                for r in range(hi - lo) if len(scores) else ():
                    if first[r] == first[r + 1] or not busy[r]:
                        continue
                    out[lo + r], found = evidence(m, scores[first[r]: first[r + 1]])
                    spans[lo + r] = [{"first_token": a, "last_token": b - 1, "e_value": e} for a, b, e in found]
            p = 1.0 / (1.0 + np.exp(-np.clip(m.slope * np.log1p(out) + m.offset, -60, 60)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(p, pa.float64()), pa.array(spans, pa.list_(span))],
                names=[*keep, "score", "spans"])

    return C.map_arrow(plain, run, C.with_columns(
        plain, keep, "score double, spans array<struct<first_token:int,last_token:int,e_value:double>>"))
