"""Vectors, archives, shards, classifiers and the pipeline."""

import hashlib
import io

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from vigil.llm import common, quality, queries, sharding, toxicity, vectors, warc

SF = "/root/testdata/sf0.1"


# ---------------------------------------------------------------- connected components

def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (20, 3)] + [(100 + k, 101 + k) for k in range(30)] + [(200, 300 + k) for k in range(20)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[20] == got[3] == 1 and got[9] == 7 and got[130] == 100 and got[319] == 200 and 5 not in got


# ---------------------------------------------------------------- vectors

def _vectors():
    rng = np.random.default_rng(5)
    rows, centre = [], rng.standard_normal((6, 64))
    for i in range(120):
        v = centre[i % 6] + rng.standard_normal(64) * (0.03 if i % 2 else 0.12)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2 if i % 7 else 0))
    rows += [(200, rows[0][1], rows[0][2]), (201, rows[0][1], None), (202, None, 1), (203, [], 1), (204, [0.0] * 64, 1),
             (205, [0.0] * 64, 1), (206, [float("nan")] + [1.0] * 63, 1), (207, [None] + [1.0] * 63, 1), (208, [float("inf")] * 64, 1),
             (3, rows[5][1], 1), (209, [2.0 * x for x in rows[1][1]], rows[1][2]), (210, [1.0, 0.0], 1), (211, [1.0, 0.125], 1),
             (None, rows[3][1], rows[3][2])]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_vectors(spark, block):
    rows = _vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cell string")
    got = vectors.near_duplicates(df, "vec_id", "embedding", "label", ["vec_id", "embedding", "cell"], block=block).collect()
    units = []
    for _, v, label in rows:
        ok = v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok else None)
    n = len(rows)
    link = [[i != j and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2]
             and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= 0.98 for j in range(n)] for i in range(n)]
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(n):
        for j in range(i):
            if link[i][j]:
                parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), 10**9), rows[i][0])
    want = sorted((str(rows[i][0]), str(rows[i][1])[:20], sum(link[i]), str(least.get(find(i)))) for i in range(n))
    assert sorted((str(r.vec_id), str(r.embedding)[:20], r.n_links, str(r.component_id)) for r in got) == want
    assert sum(x[2] for x in want) > 500


def test_nearest_lattice_point_is_nearest():
    rng = np.random.default_rng(1)
    y = rng.uniform(-3, 3, (300, 8))
    best = ((y - vectors.nearest_point(y)) ** 2).sum(axis=1)
    around = vectors.nearest_point(y)[:, None, :] + vectors._OFFSETS[None]
    assert (((y[:, None, :] - around) ** 2).sum(axis=2).min(axis=1) >= best - 1e-9).all() and best.max() <= 1.0 + 1e-9


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicates(df, "vec_id", "embedding", "label", ["vec_id"]).count() == 0


# ---------------------------------------------------------------- WARC

def test_warc_round_trip_and_lookup(spark, monkeypatch):
    page = "<html>" + "é" * 200 + "</html>"
    rows = [(1, "http://a", page), (2, "http://b\r\nX: y", page), (3, None, None), (4, "http://d", ""), (5, "http://e", "tiny"), (6, "http://f", "tiny"),
            (7, "u", page + "!"), (1, "http://a", page), (None, "n", page), (8, "big", "0123456789" * 60_000), (9, "crlf", "a\r\n\r\nb" * 40)]
    df = spark.createDataFrame([(*r, "zz") for r in rows], "page_id long, url string, html string, digest string")
    path = common.scratch_path(spark, "warc")
    warc.write(df, "page_id", "url", "html", path)
    got = warc.read(spark, path, with_payload=True).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = []
    for i, _, t in rows:
        revisit = t == page and i != 1
        want.append((str(i), digest(t), len((t or "").encode()), "revisit" if revisit else "response", "1" if revisit else "None"))
    assert sorted((str(r.key), r.stated_digest, r.stated_bytes, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert all(r.payload_digest == r.stated_digest and r.payload_bytes == r.stated_bytes for r in got if r.record_type == "response")
    found = warc.lookup(spark, path, [7, 8]).collect()
    assert {r.key: bytes(r.payload).decode() for r in found} == {7: page + "!", 8: rows[9][2]}
    # any Zstandard reader takes the files as they are
    for r in spark.read.format("binaryFile").load(path).where("length > 0").collect():
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(r.content)), read_across_frames=True).read()
        assert plain.startswith(b"WARC/1.1\r\n")
    empty = common.scratch_path(spark, "warc")
    warc.write(df.limit(0), "page_id", "url", "html", empty)
    assert warc.read(spark, empty).count() == 0


# ---------------------------------------------------------------- sharding

def test_shards_fit_and_only_large_buckets_split(spark):
    rows = [(i, "x" * (i % 50)) for i in range(3000)] + [(7, "y" * 40)] * 300 + [(5000, "z" * 900), (5001, "w" * 2500), (None, None), (None, "q")]
    limit = 1000
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, shard_name string").repartition(5)
    got = sharding.shard(df, "doc_id", "text", ["doc_id", "text"], limit).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in rows)
    size, keys, sums = {}, {}, {}
    for r in got:
        size.setdefault((r.shard, r.part), []).append(r.n_bytes)
        keys.setdefault(r.shard, set()).add(r.doc_id)
        for d in range(len(r.shard) + 1):
            sums[r.shard[:d]] = sums.get(r.shard[:d], 0) + r.n_bytes
    assert all(sum(x) <= limit or len(x) == 1 for x in size.values())
    assert all(sums[s[:-1]] > limit for s in keys if s)
    assert not any(a != b and b.startswith(a) for a in keys for b in keys)
    assert all(len(keys[s]) == 1 for s, part in size if part > 0)
    assert sharding.shard(df.limit(0), "doc_id", "text", ["doc_id"], limit).count() == 0


# ---------------------------------------------------------------- classifiers

def test_maximal_segments():
    def brute(x):
        """Ruzzo and Tompa's definition: the best segment, then both sides of it."""
        best, at = 0.0, None
        for i in range(len(x)):
            total = 0.0
            for j in range(i, len(x)):
                total += x[j]
                if total > best + 1e-12:
                    best, at = total, (i, j + 1)
        if at is None:
            return []
        i, j = at
        return brute(x[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in brute(x[j:])]
    rng = np.random.default_rng(9)
    for _ in range(200):
        x = rng.integers(-5, 5, rng.integers(0, 25)) + rng.uniform(-0.3, 0.3)
        got = [(s, e, round(v, 6)) for s, e, v in toxicity.segments(np.asarray(x, float))]
        assert [round(v, 6) for _, _, v in got] == [round(v, 6) for _, _, v in brute(list(np.asarray(x, float)))]


@pytest.mark.parametrize("query,label,accuracy,recall", [("op1_toxicity", "toxic", 0.98, 0.9), ("op9_quality", "quality", 0.98, 0.98)])
def test_held_out_accuracy(spark, query, label, accuracy, recall):
    scored = queries.QUERIES[query](spark, SF)
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 500 and ((rows.score >= 0) & (rows.score <= 1)).all()
    assert (rows.predicted == rows[label]).mean() >= accuracy
    assert rows[rows[label] == 1].predicted.mean() >= recall


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_on_awkward_tables(spark, operator):
    docs = spark.createDataFrame([(1, "good words here", "s"), (2, "bad bad idiot scum", "s"), (None, "x", "s"), (4, None, "s"), (5, "", "s"),
                                  (1, "good words here", "s"), (6, "word " * 50_000, "s")], "doc_id long, text string, spans string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (2, 0), (4, 0), (5, None), (None, 1), (77, 1)], "doc_id long, y int")
    for own in (labels, labels.limit(0)):
        model = operator.train(docs, own, "doc_id", "text", "y")
        got = operator.score(docs, model, "text", ["doc_id", "text"]).collect()
        assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if not r.text}) == 1
    assert operator.score(docs.limit(0), model, "text", ["doc_id"]).count() == 0


def test_ftrl_learns_a_separable_set():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(400):
        y = k % 2
        slots = np.unique(np.concatenate([rng.integers(0, 50, 5), rng.integers(100 + 50 * y, 150 + 50 * y, 2)])).astype(np.int32)
        rows.append((slots, np.full(len(slots), 0.4, np.float32), y))
    w = quality.ftrl(rows)
    assert np.mean([(w[-1] + w[s] @ v > 0) == y for s, v, y in rows]) > 0.98


# ---------------------------------------------------------------- the pipeline

def test_pipeline_stages_on_awkward_documents(spark):
    sf = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "", "en", "s", 0), (None, "alpha beta gamma delta", None, None, 22),
                                 (9002, "", "en", "s", 0)], source.schema)
    docs = source.unionByName(odd).withColumn("document", F.lit(1)).withColumn("fp", F.lit("f")).withColumn("__text", F.lit("t"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialise(stage(spark, docs, sf), "stage")
        assert after.columns == docs.columns and 0 < after.count() <= docs.count()
        docs = after
    assert docs.where("text IS NULL OR text = ''").count() <= 1  # near duplicates of each other
    packed = corpus_pipeline.packing_stage(spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    empty = source.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty_after = stage(spark, empty, sf)
        assert empty_after.count() == 0


def test_line_stage_keeps_every_document(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = corpus_pipeline.line_stage(spark, docs, sf)
    assert after.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0 and after.count() == docs.count()
    assert after.where("n_chars <> char_length(text)").count() == docs.where("n_chars <> char_length(text)").count()
