"""BPE encoding and decoding against the library, and the merges against a plain loop."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vigil.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = ["", None, " ", "\n\t\x0b", "one word", "H̱ T̈ İx ΣΣ KK", "don't WE'LL 'S ''s ---'s 's's",
           "<|endoftext|>x <|EndOfText|> a<|startoftext|≯b <|end", "\x1c\x00\x7f a b c\u0085d ½ ²3 4567",
           "a" * 300, "日本語のテキスト、これは。" * 30,
           "क्षत्रिय ไทย", "﻿​ \U0001f600\U0001f44d\U0001f3fd",
           "L’été — “quoted” … 5 € ½ ²³¹¼ ªº µm\u00a0Ÿ\u00ad\u0130ſŉ\u017f\u0149 \u2028x", "soft\u00adhy ~~'s '\u00a0's",
           "́start Été, über. naïve!? ǅx", "one word", "</w> a</w>b <w>"]


def _texts(n=400):
    rng = random.Random(7)
    parts = ["a", "b", "e", "th", "in", "'s", "é", "ß", "Ω", "1", " ", "\n", "!", "the", "ing", "İ", "́", "oo", "o", "A", "<|"]
    return AWKWARD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def _expected(text):
    whole = Tokenizer.from_file(PATH)
    ids = whole.encode(text or "", add_special_tokens=False).ids
    return ids, whole.decode(ids, skip_special_tokens=False)


def test_texts_against_the_library(spark):
    texts = _texts()
    whole = Tokenizer.from_file(PATH)
    found = [x.ids for x in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)] + [(0, texts[4], "again"), (None, "no id", None)],
                               "doc_id long, text string, ids string")
    coded = bpe.encode(df, "text", ["doc_id", "ids"])
    assert coded.columns == ["doc_id", "ids"]  # the result takes the name
    rows = bpe.decode(coded, "ids", ["doc_id", "ids"]).collect()
    assert len(rows) == len(texts) + 2
    seen = set()
    for r in rows:
        if r.doc_id is None or (r.doc_id == 0 and r.ids):
            assert r.ids == _expected("no id" if r.doc_id is None else texts[4])[0]
            continue
        assert r.ids == found[r.doc_id], texts[r.doc_id]
        assert r.decoded == whole.decode(found[r.doc_id], skip_special_tokens=False)
        seen.add(r.doc_id)
    assert len(seen) == len(texts)


def test_query_digests(spark, tmp_path):
    texts = _texts(30)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op12_bpe(spark, str(tmp_path)).collect():
        ids, text = _expected(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_no_rows_and_null_ids(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), "text", ["doc_id"]).collect() == []
    df = spark.createDataFrame([(1, None), (2, []), (3, [320, None, 99999999])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in bpe.decode(df, "ids", ["k"]).collect()} == {1: None, 2: "", 3: "a</w>"}


def test_long_texts_and_full_tables(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 50)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 50)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 50)
    monkeypatch.setattr(bpe, "SEGMENT", 100)
    own, text = bpe.Codec(PATH), " ".join(t for t in _texts(200) if t)
    parts = list(bpe._segments(text))
    assert "".join(parts) == text and len(parts) > 20
    ids = [i for part in parts for i in memoryview(own.encode([part])[0]).cast("I")]
    assert ids == _expected(text)[0]


def _merge(symbols, rank):
    """The plain loop: the lowest-ranked pair, leftmost first."""
    symbols = list(symbols)
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank), default=None)
        if best is None:
            return symbols
        i = best[1]
        symbols[i: i + 2] = [symbols[i] + symbols[i + 1]]


@pytest.mark.parametrize("seed", range(40))
def test_trie_against_the_plain_loop(seed):
    """Random small models, trained as BPE is, over words of repeated letters."""
    rng = random.Random(seed)
    letters, end = "ab" if seed % 2 else "abc", "</w>" if seed % 3 else ""
    corpus = [[*w[:-1], w[-1] + end] for w in ("".join(rng.choice(letters) for _ in range(rng.randint(2, 14))) for _ in range(60))]
    vocab = {c: i for i, c in enumerate(sorted({c for c in letters} | {c + end for c in letters}))}
    merges = []
    for _ in range(25):
        counts = {}
        for w in corpus:
            for p in zip(w, w[1:]):
                counts[p] = counts.get(p, 0) + 1
        if not counts:
            break
        a, b = max(counts, key=lambda p: (counts[p], p))
        if a + b in vocab:
            break
        merges.append([a, b])
        vocab[a + b] = len(vocab)
        corpus = [_merge(w, {(a, b): 0}) for w in corpus]
    own = bpe.Merges(json.loads(json.dumps({"type": "BPE", "vocab": vocab, "merges": merges, "end_of_word_suffix": end or None})))
    rank, name = {tuple(p): r for r, p in enumerate(merges)}, {i: t for t, i in vocab.items()}
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) for _ in range(300)} | {"a" * n for n in range(1, 30)}
    for word, ids in own.encode(words).items():
        assert [name[i] for i in ids] == _merge([*word[:-1], word[-1] + end], rank), word


def test_other_models_are_refused():
    for odd in ({"type": "WordPiece"}, {"byte_fallback": True}, {"merges": [["a", "b"], ["a", "b"]]}):
        with pytest.raises(ValueError):
            bpe.Merges({"type": "BPE", "vocab": {"a": 0, "b": 1, "ab": 2}, "merges": [["a", "b"]], **odd})
