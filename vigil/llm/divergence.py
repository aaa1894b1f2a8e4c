"""Source divergence audit: three-dimensional cube partitioning.

Terms are runs of letters (A-Z lower-cased) and non-ASCII characters.  A language keeps the V terms that at least
``MIN_DOCUMENTS`` of its documents hold.  A (language, source) group, and a language as a whole, gives every kept term
p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N being its count over kept terms; everything is an integer.

1. Counts: each task counts the terms of its documents per group, one shuffle adds them up; a window over (language,
   term) adds the documents of all groups and drops rare terms.
2. Slices: kept terms are hashed into term blocks of about ``TERMS`` and numbered there, groups into group blocks of
   about ``GROUPS``.  A slice is one group's counts in one term block, present for every block, empty or not.
3. Cube: the cell (group block, group block, term block) gets the slices of its two group blocks, so a slice
   is replicated to as many cells as there are group blocks; a cell adds up abs(p - q) for its pairs over its terms as
   dense arrays, which block sizes bound.
4. Partial divergences are summed along the term axis; nothing else is gathered.

A source or a term of a third of all rows only adds rows that were counted before the shuffle.  ``terms`` ranks each
group's terms above its language by a window whose limit Spark applies before the shuffle.

Defined results: null text, language and source read as ''; groups without terms take part; a language without kept
terms has divergence 0 throughout; a lone source has no pair; repeated rows are documents of their own; empty
tables give no row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigil.llm import common as C

MIN_DOCUMENTS = 30
GROUPS = 64
TERMS = 4096
TOP = 50
SCALE, PRIOR = 1_000_000_000, 5
LETTERS = C.byte_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LARGEST = 9 * 10**15  # of N + 5 V: shares are computed in 64 bits


def share(count: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / whole) in 64-bit integers, three decimal digits at a time."""
    if whole > LARGEST:
        raise OverflowError("counts above 9e15")
    rest = count.astype(np.int64) + PRIOR
    out = np.zeros(len(rest), np.int64)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + step
    return out + 1


def _counted(batches):
    """Per batch of texts: (lang, source, term, count, documents); a row without a term names each group."""
    for batch in batches:
        for lo, hi, buf, bounds in C.text_groups(batch, "text", 1 << 22):
            names = []
            for c in ("lang", "source"):
                column = batch.column(c).slice(lo, hi - lo).fill_null("").dictionary_encode()
                names.append((column.indices.to_numpy().astype(np.int64), column.dictionary))
            (lang, langs), (source, sources) = names
            groups, group = np.unique(lang * len(sources) + source, return_inverse=True)
            low = C.LOWER[buf]
            starts, ends = C.word_spans(low, LETTERS, bounds)
            # words hold all letters and nothing else: without the rest they lie end to end
            letters = low[LETTERS[low]]
            cut = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(letters)])
            coded = words.dictionary_encode()
            size = max(len(coded.dictionary), 1)
            row = np.repeat(np.arange(hi - lo), np.diff(C.row_of(starts, bounds)))
            in_document = np.sort(row * size + coded.indices.to_numpy())
            first = np.flatnonzero(np.diff(in_document, prepend=-1))
            times = np.diff(np.append(first, len(in_document)))
            row, term = np.divmod(in_document[first], size)
            key, where = np.unique(group[row] * size + term, return_inverse=True)
            documents = np.bincount(where, minlength=len(key))
            count = np.zeros(len(key), np.int64)
            np.add.at(count, where, times)
            of_group, term = np.divmod(key, size)
            of_group = np.concatenate([of_group, np.arange(len(groups))])
            blank = np.zeros(len(groups), np.int64)
            spelled = coded.dictionary.take(pa.array(term)).cast(pa.large_string()).cast(pa.string())
            lang, source = np.divmod(groups[of_group], len(sources))
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(lang)).cast(pa.string()), sources.take(pa.array(source)).cast(pa.string()),
                 pa.concat_arrays([spelled, pa.nulls(len(groups), pa.string())]), pa.array(np.concatenate([count, blank])),
                 pa.array(np.concatenate([documents, blank]))], names=["lang", "source", "term", "n", "docs"])


class Audit:
    """Counts of a table, written once; ``pairs`` and ``terms`` read them."""

    def __init__(self, df: DataFrame, text_col: str, lang_col: str, source_col: str, min_documents: int = MIN_DOCUMENTS,
                 groups: int = GROUPS, terms: int = TERMS):
        self.block = groups
        # � stands for bytes that are no character; texts are UTF-8 from here on
        source = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
                           F.col(source_col).cast("string").alias("source"))
        counted = C.map_arrow(source, _counted, "lang string, source string, term string, n long, docs long")
        counts = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        whole = Window.partitionBy("lang", "term")
        common = (counts.withColumn("in_lang", F.sum("n").over(whole)).withColumn("all_docs", F.sum("docs").over(whole))
                  .where((F.col("all_docs") >= min_documents) | F.col("term").isNull())
                  .select("lang", "source", "term", "n", "in_lang"))
        self.counts = C.materialise(common, "counts")
        # one row per group and per language: metadata of the corpus, never of its texts
        self.groups = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("of_group"))
        vocabulary = self.counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang"))
        sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("of_lang"))
        many = self.groups.groupBy("lang").agg(F.count("*").alias("members"))
        self.langs = C.materialise(
            many.join(sizes, "lang", "left").select(
                "lang", "members", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("of_lang", F.lit(0)).alias("of_lang"))
            .withColumn("term_blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / terms)).cast("int"))
            .withColumn("group_blocks", F.greatest(F.lit(1), F.ceil(F.col("members") / groups)).cast("int")), "langs")
        block = F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int")
        numbered = Window.partitionBy("lang", "block").orderBy("term")
        self.vocabulary = C.materialise(
            vocabulary.join(self.langs.select("lang", "term_blocks"), "lang").withColumn("block", block)
            .select("lang", "term", "block", (F.row_number().over(numbered) - 1).alias("place")), "vocabulary")

    def slices(self) -> DataFrame:
        """One row per group and term block: the group's places and counts there, its total and the block's size."""
        sizes = self.vocabulary.groupBy("lang", "block").agg(F.count("*").alias("width"))
        grid = (self.groups.join(self.langs, "lang")
                .select("lang", "source", "of_group", "v", "group_blocks", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("block"))
                .join(sizes, ["lang", "block"], "left").withColumn("width", F.coalesce("width", F.lit(0))))
        held = (self.counts.where("n > 0").join(self.vocabulary, ["lang", "term"])
                .groupBy("lang", "source", "block").agg(F.collect_list(F.struct("place", "n")).alias("entries")))
        return grid.join(held, ["lang", "source", "block"], "left")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): each group's divergence from every other source of its language."""
        home = F.pmod(F.xxhash64("source"), F.col("group_blocks")).cast("int")
        dealt = (self.slices().withColumn("home", home)
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
                 .select("lang", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), "block", "home",
                         "source", "of_group", "v", "width", F.col("entries.place").alias("places"), F.col("entries.n").alias("counts")))
        partial = C.group_arrow(dealt, ["lang", "i", "j", "block"], _cell, StructType.fromDDL("lang string, a string, b string, part long"))
        one_way = C.materialise(partial.groupBy("lang", "a", "b").agg(F.sum("part").alias("value")), "pairs")
        return one_way.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(
            one_way.select("lang", F.col("b"), F.col("a"), "value"))

    def terms(self) -> DataFrame:
        """(lang, source, item, value) of every kept term that a group holds and uses above its language."""
        def p(count, whole):
            scaled = F.lit(SCALE).cast("decimal(20,0)") * (F.col(count) + PRIOR).cast("decimal(18,0)")
            return F.call_function("div", scaled, (F.col(whole) + PRIOR * F.col("v")).cast("decimal(18,0)")) + 1

        held = self.counts.where("n > 0").join(self.groups, ["lang", "source"]).join(self.langs.select("lang", "v", "of_lang"), "lang")
        return (held.withColumn("value", p("n", "of_group") - p("in_lang", "of_lang")).where("value > 0")
                .select("lang", "source", F.col("term").alias("item"), "value"))


def _cell(cell: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of two group blocks over one term block."""
    lang = cell.column("lang")[0].as_py()
    cell = cell.sort_by("source")
    names, home = cell.column("source").to_pylist(), cell.column("home").to_numpy()
    width = cell.column("width")[0].as_py()
    i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
    shares = np.empty((len(names), width), np.int64)
    places, counts = cell.column("places"), cell.column("counts")
    for r in range(len(names)):
        dense = np.zeros(width, np.int64)
        if places[r].is_valid:
            dense[places[r].values.to_numpy()] = counts[r].values.to_numpy()
        shares[r] = share(dense, cell.column("of_group")[r].as_py() + PRIOR * cell.column("v")[r].as_py()) if width else 0
    left, right = np.flatnonzero(home == i), np.flatnonzero(home == j)
    a, b, part = [], [], []
    for r in left:
        others = right[right > r] if i == j else right
        a += [names[r]] * len(others)
        b += [names[s] for s in others]
        part.append(np.abs(shares[others] - shares[r]).sum(axis=1))
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()),
                     "part": pa.array(np.concatenate(part) if part else [], pa.int64())})


def ranked(audit: Audit, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs, and the ``top`` terms of each group."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = audit.pairs().withColumn("rank", F.row_number().over(order))
    terms = audit.terms().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).union(terms.withColumn("part", F.lit("term")).select(columns))
