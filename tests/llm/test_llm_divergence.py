"""Source divergence against plain integer arithmetic."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vigil.llm import divergence as DV
from vigil.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, term string"


def _rows(seed, n=160):
    rng = random.Random(seed)
    words = ["the", "The", "été", "Été", "of", "a", "日本", "x1y", "snake_case", "rare" + str(seed), "ÀB", "end."] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(["s0", "s1", "s2", "s3", "s4", "", None, "ü", "S0"])
        text = " ".join(rng.choice(words[: 5 + hash(source or "") % 3 + i % 25]) for _ in range(rng.randint(0, 30)))
        rows.append((i, rng.choice([text, text, text, text, "", None]), rng.choice(["en", "en", "en", "fr", None]), source, "clash"))
    rows += [(900, "alone words here", "xx", "only", "clash"), (900, "alone words here", "xx", "only", "clash"), (901, None, "yy", "p", "c"), (902, "rare", "yy", "q", "c")]
    rows += [(1000 + k, "z" * 30 + " the" * 3000, "en", "s1", "c") for k in range(2)]  # long texts
    return rows


def _expected(rows, least, top):
    groups, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang, source].update(terms)
        docs[lang].update(set(terms))
        langs[lang].add(source)
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        total = Counter()
        for s in sources:
            total.update({t: groups[lang, s][t] for t in kept})

        def p(counts):
            whole = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // whole for t in kept}
        shares, q = {s: p(groups[lang, s]) for s in sources}, p(total)
        for s in sources:
            pairs = [(-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(q[t] - shares[s][t], t.encode()) for t in kept if groups[lang, s][t] > 0 and shares[s][t] > q[t]]
            for part, values in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(values)}
    return out


@pytest.mark.parametrize("groups,terms", [(64, 4096), (2, 3)])
def test_audit(spark, groups, terms):
    rows = _rows(4)
    df = spark.createDataFrame(rows, SCHEMA)
    audit = DV.Audit(df, "text", "lang", "source", min_documents=6, groups=groups, terms=terms)
    got = [tuple(r) for r in DV.ranked(audit, 7).collect()]
    want = _expected(rows, 6, 7)
    assert len(got) == len(want) and set(got) == want
    if groups == 2:
        assert audit.langs.where("group_blocks > 2 AND term_blocks > 3").count() > 0


def test_query_and_no_documents(spark, tmp_path):
    rows = _rows(8, 400)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = queries.op11_divergence(spark, f"{tmp_path}/a")
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == _expected(rows, 30, 50)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert queries.op11_divergence(spark, f"{tmp_path}/b").collect() == []


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(300):
        whole = rng.randint(10, DV.LARGEST)
        counts = [rng.randint(0, whole - 5) for _ in range(20)] + [0, whole - 5]
        assert DV.share(np.array(counts), whole).tolist() == [1 + 10**9 * (c + 5) // whole for c in counts]
    with pytest.raises(OverflowError):
        DV.share(np.array([1]), DV.LARGEST + 1)
