"""Paths and types of nested JSON against a plain walk."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from vigil.operators import schema as SC


def _type(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    return {int: "integer", float: "number", str: "string", dict: "object", list: "array"}[type(v)]


def _walk(v, path="$"):
    yield path, _type(v)
    for step, x in ([("." + k, x) for k, x in v.items()] if isinstance(v, dict) else [("[]", x) for x in v] if isinstance(v, list) else []):
        yield from _walk(x, path + step)


def _join(types):
    known = sorted(types - {"null"})
    return known[0] if len(known) == 1 else "null" if not known else "number" if known == ["integer", "number"] else "mixed"


def _random(rng, depth):
    kind = rng.random()
    if depth and kind < 0.4:
        return {rng.choice("abcd"): _random(rng, depth - 1) for _ in range(rng.randint(0, 3))}
    if depth and kind < 0.6:
        return [_random(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, 2.5, "x", True, None, 10**12, ""])


def test_paths_of_random_documents(spark):
    rng = random.Random(6)
    docs = [(rng.choice(["before", "after"]), _random(rng, 6)) for _ in range(150)]
    bad = [("before", "{"), ("after", None), ("after", "not json"), ("after", "")]
    df = spark.createDataFrame([(p, json.dumps(d)) for p, d in docs] + bad, "p string, body string")
    counts = Counter((p, path, t) for p, d in docs for path, t in _walk(d))
    got = {(r.period, r.path, r.type): r.n for r in SC.json_path_types(df, "body", {"period": F.col("p")}).collect()}
    assert got == dict(counts) and max(path.count("[]") + path.count(".") for _, path, _ in got) >= 4
    drift = {r.path: r for r in SC.json_path_drift(df, "body", F.col("p")).collect()}
    assert set(drift) == {path for _, path, _ in counts}
    for path, r in drift.items():
        seen = {p: {t for q, x, t in counts if q == p and x == path} for p in ("before", "after")}
        b, a = (_join(seen[p]) if seen[p] else None for p in ("before", "after"))
        assert (r.type_before, r.type_after) == (b, a)
        assert r.n_before == sum(n for (p, x, _), n in counts.items() if p == "before" and x == path)
        if not b or not a:
            assert r.change == ("added" if a else "removed")
        elif a == b:
            nb, na = "null" in seen["before"], "null" in seen["after"]
            assert r.change == ("same" if nb == na else "widened" if na else "narrowed")
        else:
            above = {("null", a), (b, "mixed"), ("integer", "number")}
            below = {(b, "null"), ("mixed", a), ("number", "integer")}
            assert r.change == ("widened" if (b, a) in above else "narrowed" if (b, a) in below else "changed")
    malformed = {r.period: (r.n_rows, r.n_null, r.n_malformed) for r in SC.json_malformed(df, "body", F.col("p")).collect()}
    assert malformed["before"][1:] == (0, 1) and malformed["after"][1:] == (1, 2)


def test_no_documents(spark):
    df = spark.createDataFrame([], "p string, body string")
    assert SC.json_path_drift(df, "body", F.col("p")).collect() == []
