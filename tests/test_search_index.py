"""Ranked search against brute-force scoring."""

import math
import os
import random
import re

import pytest

from vigil.operators import search_index as SX


def _tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def _bm25(docs, terms, k):
    tokens = {i: _tokens(t) for i, t in docs}
    n, mean = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = {t: sum(t in x for x in tokens.values()) for t in terms}
    out = []
    for i, x in tokens.items():
        score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * x.count(t) * (SX.K1 + 1)
                    / (x.count(t) + SX.K1 * (1 - SX.B + SX.B * len(x) / mean)) for t in terms if t in x)
        if score:
            out.append((-score, i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def _documents(seed, first, n):
    rng = random.Random(seed)
    words = ["data", "Quality", "schema", "drift", "été", "42", "pipeline", "the", "the", "the", "catalog", "x"]
    return [(first + i, rng.choice([" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))), "", None]) if i % 9 == 0 else
             " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) + ".") for i in range(n)]


def _same(got, want):
    assert [r.id for r in got] == [i for i, _ in want]
    assert [r.score for r in got] == pytest.approx([s for _, s in want])


def test_top_k_and_updates(spark, tmp_path):
    path, docs = f"{tmp_path}/index", _documents(1, 0, 120)
    SX.add(spark.createDataFrame(docs, "doc long, body string"), "doc", "body", path)
    _same(SX.search(spark, path, "Schema DRIFT 42", 15).collect(), _bm25(docs, ["schema", "drift", "42"], 15))
    before = {f: os.stat(f).st_mtime_ns for d, _, fs in os.walk(path) for f in (os.path.join(d, x) for x in fs)}

    more = _documents(2, 1000, 60) + [(5000, "pipelines of a kind")]
    SX.add(spark.createDataFrame(more, "doc long, body string"), "doc", "body", path)
    assert all(os.stat(f).st_mtime_ns == t for f, t in before.items())  # an update touches only new rows
    everything = docs + more
    for query, terms in (("the été catalog", ["the", "été", "catalog"]), ("quality", ["quality"])):
        _same(SX.search(spark, path, query, 25).collect(), _bm25(everything, terms, 25))
    assert SX.search(spark, path, "nothing-like-it zzzzzzzz").collect() == [] and SX.search(spark, path, "").collect() == []

    # a typo finds the closest term, a term that exists is left alone
    assert SX.closest_terms(spark, path, ["pipelien", "drift", "qualiti", "zzzzzzzz"]) == {"pipelien": "pipeline", "drift": "drift", "qualiti": "quality"}
    _same(SX.search(spark, path, "pipelien", 5).collect(), _bm25(everything, ["pipeline"], 5))

    def times(words):
        return {i: n for i, t in everything if (n := sum(_tokens(t)[j: j + len(words)] == words for j in range(len(_tokens(t)))))}
    for words in (["schema", "drift"], ["the", "the", "the"], ["42"]):
        assert {r.id: r.n for r in SX.phrase(spark, path, " ".join(words)).collect()} == times(words)
    assert SX.phrase(spark, path, "").collect() == []


def test_a_query_reads_its_terms_only(spark, tmp_path):
    path = f"{tmp_path}/index"
    SX.add(spark.createDataFrame(_documents(3, 0, 50), "doc long, body string"), "doc", "body", path)
    plan = SX._matches(spark, path, ["drift", "42"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [42,drift])]" in plan


def test_postings_are_grouped_where_the_document_is_read(spark, monkeypatch):
    """No shuffle before the postings are ranged; documents in parts of any size, null and repeated ids, no terms at all."""
    rng, words = random.Random(4), ["b", "a", "été", "a1", "the"]
    rows = [(rng.choice([None, 7, k]), [rng.choice(words) for _ in range(rng.choice([0, 1, 30]))]) for k in range(80)]
    want = sorted((t, str(i), x.count(t), len(x), [p for p, y in enumerate(x) if y == t]) for i, x in rows for t in set(x))
    base = spark.createDataFrame(rows, "id long, terms array<string>").coalesce(1)
    for part in (1, 50, 1 << 20):
        monkeypatch.setattr(SX, "PART", part)
        made = SX.postings(base)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.term, str(r.id), r.tf, r.length, r.positions) for r in made.collect()) == want
