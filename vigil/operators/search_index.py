"""Ranked search (C2, C4): an inverted index with positions, BM25, phrases and typo-tolerant terms.

``add`` indexes a batch of documents as a segment of its own: postings (term, id, tf, length, positions) ranged and
sorted by term, so a query reads the row groups of its terms only, and the segment's statistics.  Earlier segments
are not touched.  Postings are grouped per (term, document) where the document is read and cross the network once, to be
ranged, so a term that every document holds is spread by ranges of (term, document).

``search`` scores the postings of the query's terms: document frequencies and the mean length are those of the whole
index; the k best come from per-partition top-k.  A query term that no document holds is replaced by the closest
term (edit distance up to ``MAX_TYPOS``, then frequency, then the term) among those that share a character trigram with
it; trigrams are indexed as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

K1, B = 1.2, 0.75
MAX_TYPOS = 2
TERM = r"[\p{L}\p{N}]+"


def terms_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def trigrams(term: Column) -> Column:
    """Distinct trigrams of a term between two blanks, so that its ends count."""
    padded = F.concat(F.lit(" "), term, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


PART = 1 << 20  # terms of documents that are grouped at once


def _grouping():
    """Rows of (id, terms) in, postings out: of each document one row per term, equal terms side by side.

    A closure, so that it travels to the executors by value and they need no copy of this package.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
            total, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PART, "right")) - 1)
                here, length, lo = batch.slice(lo, hi - lo), sizes[lo:hi], hi
                flat = here.column("terms").flatten()
                if not len(flat):
                    continue
                coded = flat.dictionary_encode()
                words, code = coded.dictionary, coded.indices.to_numpy()
                rank = np.empty(len(words), np.int64)
                rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
                order = np.argsort(rank[code], kind="stable")  # equal terms stay by document and position
                document = np.repeat(np.arange(len(length)), length)
                position = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
                code, document, position = code[order], document[order], position[order]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(document) != 0)]))
                bounds = np.append(first, len(flat))
                yield pa.RecordBatch.from_arrays(
                    [words.take(pa.array(code[first])), here.column("id").take(pa.array(document[first])), pa.array(np.diff(bounds).astype(np.int32)),
                     pa.array(length[document[first]].astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(position.astype(np.int32)))],
                    names=["term", "id", "tf", "length", "positions"])

    return run


def postings(base: DataFrame) -> DataFrame:
    """(term, id, tf, length, positions) per term of each (id, terms) row; a document's terms are at one place, so nothing is shuffled."""
    schema = StructType([StructField("term", StringType()), base.schema["id"], StructField("tf", IntegerType()), StructField("length", IntegerType()),
                         StructField("positions", ArrayType(IntegerType()))])
    return base.select("id", "terms").mapInArrow(_grouping(), schema)


def add(docs: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Index ``docs`` as a new segment under ``path``.  Ids are taken as they are: a document is one row."""
    spark, segment = docs.sparkSession, uuid.uuid4().hex
    base = docs.select(F.col(f"`{id_col}`").alias("id"), terms_of(F.col(f"`{text_col}`")).alias("terms"))
    (postings(base).repartitionByRange("term", F.xxhash64("id")).sortWithinPartitions("term")
     .write.parquet(f"{path}/postings/segment={segment}"))
    held = spark.read.parquet(f"{path}/postings/segment={segment}")
    terms = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    (terms.select(F.explode(trigrams(F.col("term"))).alias("gram"), "term", "df")
     .repartitionByRange("gram", "term").sortWithinPartitions("gram").write.parquet(f"{path}/grams/segment={segment}"))
    # empty documents count as documents too
    (base.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("tokens"))
     .write.parquet(f"{path}/stats/segment={segment}"))


def closest_terms(spark: SparkSession, path: str, terms: list[str]) -> dict[str, str]:
    """For each query term itself if the index holds it, else its closest term within ``MAX_TYPOS``, if any."""
    if not terms:
        return {}
    grams = spark.read.parquet(f"{path}/grams")
    asked = spark.createDataFrame([(t,) for t in terms], "asked string")
    wanted = sorted({g for t in terms for g in (f" {t} "[i: i + 3] for i in range(len(t)))})
    near = grams.where(F.col("gram").isin(wanted)).groupBy("term").agg(F.max("df").alias("df"))
    scored = near.join(F.broadcast(asked), F.abs(F.length("term") - F.length("asked")) <= MAX_TYPOS)  # a query's few terms
    scored = scored.withColumn("typos", F.levenshtein("term", "asked")).where(F.col("typos") <= MAX_TYPOS)
    df = grams.where(F.col("gram").isin(wanted)).select("term", "segment", "df").distinct().groupBy("term").agg(F.sum("df").alias("all_df"))
    best = scored.join(df, "term").groupBy("asked").agg(F.min(F.struct("typos", (-F.col("all_df")).alias("rare"), "term")).alias("b"))
    return {r["asked"]: r["b"]["term"] for r in best.collect()}  # one row per query term


def _matches(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    return spark.read.parquet(f"{path}/postings").where(F.col("term").isin(terms) if terms else F.lit(False))


def search(spark: SparkSession, path: str, query: str, k: int = 10, typos: bool = True) -> DataFrame:
    """(id, score, matched) of the k best documents; ties go to the smaller id.  ``matched`` are the terms that scored."""
    asked = list(dict.fromkeys(spark.range(1).select(terms_of(F.lit(query)).alias("t")).first()["t"]))
    terms = sorted(set(closest_terms(spark, path, asked).values())) if typos else asked
    stats = spark.read.parquet(f"{path}/stats").agg(F.sum("docs").alias("n"), (F.sum("tokens") / F.sum("docs")).alias("mean")).first()
    held = _matches(spark, path, terms)
    frequency = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row per query term
    n, mean = float(stats["n"] or 0), stats["mean"] or 1.0
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    scored = held.join(frequency, "term").groupBy("id").agg(F.sum(part).alias("score"), F.array_sort(F.collect_set("term")).alias("matched"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def phrase(spark: SparkSession, path: str, words: str) -> DataFrame:
    """(id, n): documents that hold the words one after another, and how often, by their positions."""
    asked = spark.range(1).select(terms_of(F.lit(words)).alias("t")).first()["t"]
    places = [(t, i) for i, t in enumerate(asked)]
    offsets = spark.createDataFrame(places, "term string, offset int")
    held = _matches(spark, path, sorted(set(asked))).join(F.broadcast(offsets), "term")  # a phrase's few words
    starts = held.select("segment", "id", "length", F.explode(F.transform("positions", lambda p: p - F.col("offset"))).alias("start"), "offset")
    whole = starts.groupBy("segment", "id", "length", "start").agg(F.count_distinct("offset").alias("n")).where(F.col("n") == len(asked))
    return whole.groupBy("id").agg(F.count(F.lit(1)).alias("n")) if asked else whole.select("id", F.lit(0).cast("bigint").alias("n")).limit(0)
