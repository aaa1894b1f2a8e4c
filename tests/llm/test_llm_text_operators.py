"""Text operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vigil.llm import decontam, lines, packing, simhash, suffixes

_RNG = random.Random(7)
VOCABULARY = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta,", "theta.", "42", "iota", "Straße", "naïve"]


def _prose(n):
    return " ".join(_RNG.choice(VOCABULARY) + str(_RNG.randint(0, 60)) for _ in range(n))


def _documents():
    base = [_prose(n) for n in (40, 60, 80, 25)]
    passage = _prose(70)
    rows = [(1, base[0]), (2, base[0]), (3, base[1] + "\n" + base[2]), (4, base[2] + "\n" + base[3]), (4, base[2] + "\n" + base[3]),
            (5, None), (6, ""), (7, "   \n\t "), (8, "short"), (9, "a b"), (None, base[1]), (10, base[1].replace("alpha", "alphas")),
            (11, _prose(30) + " " + passage + " " + _prose(30)), (12, passage + " " + _prose(10)), (13, "x" * 120), (14, "x" * 70),
            (15, _prose(30_000)), (16, "日本語のテキスト " * 20), (17, "日本語のテキスト " * 20), (18, base[0].upper())]
    return [(i, t, "no", 5, "row") for i, t in rows]


DOCUMENTS = _documents()
LAYOUT = "doc_id long, text string, kept string, fp long, node string"  # names that operators use inside


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCUMENTS, LAYOUT).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], LAYOUT)


def groups_of(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


# ---------------------------------------------------------------- SimHash

def simhash_of(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, no_docs):
    rows = simhash.near_duplicates(docs, "doc_id", "text", ["doc_id", "text"]).collect()
    assert len(rows) == len(DOCUMENTS)
    fps = [simhash_of(t) for _, t, *_ in DOCUMENTS]
    group = groups_of(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2)
    smallest = {g: min((DOCUMENTS[i][0] for i in range(len(fps)) if group[i] == g and DOCUMENTS[i][0] is not None), default=None)
                for g in set(group)}
    want = sorted((str(d[0]), str(d[1]), fp, str(smallest[g])) for d, fp, g in zip(DOCUMENTS, fps, group))
    assert sorted((str(r.doc_id), str(r.text), r.fp & (2**64 - 1), str(r.component_id)) for r in rows) == want
    assert sum(r.kept for r in rows) == len(set(group))
    assert simhash.near_duplicates(no_docs, "doc_id", "text", ["doc_id"]).count() == 0


def test_every_close_pair_meets_at_the_home_of_either():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 200, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    (rx, ax, hx), (ry, ay, hy) = simhash.anchors(x), simhash.anchors(y)
    for i in range(200):
        assert set(ax[(rx == i) & hx]) & set(ay[ry == i]) and set(ay[(ry == i) & hy]) & set(ax[rx == i])


def test_large_anchor_groups_find_the_same_links():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (900, 3), dtype=np.uint64)
    fp = np.unique(centre[rng.integers(0, 3, 900)] ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
    plain = {(int(i), int(j)) for a, b in simhash._near(fp, fp, 2) for i, j in zip(a, b)}
    assert {(int(i), int(j)) for a, b in simhash._near_large(fp, fp, 2) for i, j in zip(a, b)} == plain


def test_links_of_close_pairs_that_share_a_home(spark):
    rng = np.random.default_rng(8)
    one = np.uint64(1)
    x = rng.integers(0, 2**63, 600, dtype=np.uint64)
    first, second = rng.integers(0, 64, 600), rng.integers(0, 64, 600)
    first[400:], second[400:] = rng.integers(53, 64, 200), rng.integers(53, 64, 200)  # outside the code: one home
    y = x ^ (one << first.astype(np.uint64))
    y[::2] ^= np.where(first == second, 0, one << second.astype(np.uint64)).astype(np.uint64)[::2]
    fp = np.unique(np.concatenate([x, y]))
    df = spark.createDataFrame([(int(v),) for v in fp.astype(np.int64)], "fp long")
    place = {int(v): i for i, v in enumerate(fp.astype(np.int64))}
    got, want = np.arange(len(fp)), np.arange(len(fp))
    found = [(place[r.a], place[r.b]) for r in simhash.links(df).collect()]
    lines.C.merge_labels(got, *np.array(found).T)
    brute = np.concatenate([np.stack(p) for p in simhash._near(fp, fp, 2)], axis=1)
    lines.C.merge_labels(want, *brute)
    assert len(set(want)) == 600 and got.tolist() == want.tolist()


def test_near_duplicates_of_lightly_changed_documents(spark):
    rng, texts = random.Random(9), []
    for _ in range(60):
        words = [f"w{rng.randint(0, 9999)}" for _ in range(500)]
        texts += [" ".join(words), " ".join([*words[:-1], "changed"])]
    rows = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", ["doc_id"]).collect()
    fps = [simhash_of(t) for t in texts]
    group = groups_of(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2)
    assert len(set(group)) < 100
    assert {r.doc_id: r.component_id for r in rows} == {i: min(k for k in range(len(group)) if group[k] == group[i]) for i in range(len(group))}


# ---------------------------------------------------------------- fuzzy lines

def test_edit_similarity():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]
    rng = random.Random(5)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
        b = "".join(b)
        longer = max(len(a), len(b))
        assert lines.similar(a, b) == (longer == 0 or distance(a, b) <= int(0.2 * longer + 1e-9))


def test_fuzzy_lines(spark, no_docs):
    rng = random.Random(11)
    common = [" ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 9)) for _ in range(30)) for _ in range(6)]
    near = [c + " tail" for c in common] + [c[:-1] for c in common] + [c.upper() for c in common]
    rows = [(None if i == 7 else i, "\n".join(rng.sample(common + near, 4) + ["one two", "", "page 12 of 30 in all"]) + ("\n" if i % 3 else ""))
            for i in range(25)] + [(25, None), (26, ""), (27, "\n\n"), (3, "\n".join(common[:2])), (3, "\n".join(common[:2]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = lines.dedup(df, "doc_id", "text", ["doc_id", "text"]).collect()

    def words(line):
        return re.findall(rb"[0-9a-z\x80-\xff]+", bytes(lines._FOLD[c] for c in line.encode()))

    at = {}
    for row, (i, text) in enumerate(rows):
        for n, line in enumerate(lines.split_lines(text) if text else []):
            ws = words(line)
            if ws:
                at.setdefault(b" ".join(ws), []).append((i is None, i if i is not None else 0, row, n))
    names = list(at)
    group = groups_of(len(names), lambda i, j: lines.similar(names[i].decode(), names[j].decode()))
    gone = {}
    for g in set(group):
        for _, _, row, n in sorted(x for k, v in enumerate(names) if group[k] == g for x in at[v])[1:]:
            gone.setdefault(row, set()).add(n)
    want = []
    for row, (i, text) in enumerate(rows):
        new = text
        if row in gone:
            left = [x for n, x in enumerate(lines.split_lines(text)) if n not in gone[row]]
            new = "\n".join(left) + ("\n" if left and text.endswith("\n") else "")
        want.append((str(i), str(text), str(new), len(gone.get(row, ()))))
    assert sorted((str(r.doc_id), str(r.text), str(r.new_text), r.n_removed) for r in got) == sorted(want)
    assert sum(len(x) for x in gone.values()) > 20
    assert lines.dedup(no_docs, "doc_id", "text", ["doc_id"]).count() == 0


def test_repeated_short_lines_and_scripts_without_spaces(spark):
    body = "All rights reserved.\n日本語の段落は一語として数えられる。\n--\n\nMenu\n"
    rows = [(1, body), (2, body + "only here"), (3, "menu")]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", ["doc_id"]).collect()
    assert {r.doc_id: (r.new_text, r.n_removed) for r in got} == {1: (body, 0), 2: ("--\n\nonly here", 3), 3: ("", 1)}


def test_fuzzy_lines_of_all_lengths_against_edit_similarity(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    texts = []
    for n in (2, 3, 5, 8, 12, 20, 40) * 20:
        a = [word() for _ in range(n)]
        b = list(a)
        for at in rng.sample(range(n), max(1, n // 8)):  # other words, or a letter of one
            b[at] = word() if n > 3 else b[at][:-1] + "é"
        texts += [" ".join(a), " ".join(b)]
    rows = lines.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", ["doc_id"]).collect()
    group = groups_of(len(texts), lambda i, j: lines.similar(texts[i], texts[j]))
    linked = len(texts) - len(set(group))
    assert linked > 100 and 0.97 * linked <= sum(r.n_removed for r in rows) <= linked


def test_long_lines_and_large_groups(spark):
    """Lines above 400 characters and above the segment, and groups that are split into pairs of chunks."""
    rng = random.Random(13)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    texts = []
    for n in (80, 120, 300) * 8:  # 500 to 2,000 characters; a tenth of the words are others
        a = [word() for _ in range(n)]
        b = [word() if rng.random() < 0.1 else w for w in a]
        texts += [" ".join(a), " ".join(b)]
    a = [word() for _ in range(lines.C.SEGMENT // 5)]
    texts += [" ".join(a), " ".join(w if k % 50 else "x" for k, w in enumerate(a))]
    assert len(texts[-1]) > lines.C.SEGMENT
    assert all(lines.similar(x, y) for x, y in zip(texts[:48:2], texts[1:48:2]))
    for n in (4, 12, 40):  # many light variations of one line
        a = [word() for _ in range(n)]
        for k in range(60):
            b = list(a)
            b[rng.randrange(n)] += rng.choice("abcdefghij")
            texts.append(" ".join(b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (lines.CHUNK, 16):
        rows = {r.doc_id: r.n_removed for r in lines.dedup(df, "doc_id", "text", ["doc_id"], chunk=chunk).collect()}
        assert sum(rows[k] for k in range(1, 50, 2)) >= 24 and not any(rows[k] for k in range(0, 50, 2))
        assert sum(rows[k] for k in range(50, len(texts))) >= 0.97 * 177


def _edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_unrelated_long_lines_of_one_vocabulary_do_not_meet():
    """Lines that meet in a key are compared by their sketches there: a copy with a changed word meets, unrelated lines do not."""
    rng = random.Random(17)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(14, 40))) for _ in range(6000)]
    texts[1] = texts[0].rsplit(" ", 1)[0] + " unheardof"
    batch = pa.RecordBatch.from_pydict({"__id": list(range(60)), "__text": ["\n".join(texts[100 * k: 100 * k + 100]) for k in range(60)]})
    marked = list(lines._mark([])([batch]))
    h1 = np.array([x["h1"] for row in marked[0].column("__lines").to_pylist() for x in row], np.int64)
    who = lines._who(h1).tolist()
    met = set()
    for deal in lines._DEALS:
        dealt = pa.Table.from_batches(lines._dealt(*deal)(iter(marked)))
        assert dealt.num_rows < 5000  # rows of a bucket travel together: 6000 lines have some 100,000 keys
        for r in lines._meet(dealt.sort_by("bucket").to_batches(max_chunksize=100)):
            met |= set(zip(r["component"].to_pylist(), r["who"].to_pylist()))
    groups = {}
    for component, line in met:
        groups.setdefault(component, set()).add(line)
    assert {who[0], who[1]} in groups.values()
    assert len(met) < 600, "unrelated lines meet"


def test_won_bits_against_plain_counts():
    rng = np.random.default_rng(3)
    for most in (5, 129, 700):
        size = rng.integers(1, most, 30)
        first = np.concatenate([[0], np.cumsum(size)])
        feature, salts = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (int(first[-1]), 3))
        got = lines.margins(feature, first, salts)
        bits = np.stack([(lines.C.mix64(feature ^ x)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1) for x in salts], axis=1)
        bits = 2 * bits.reshape(len(feature), -1).astype(np.int64) - 1
        assert (got == np.stack([bits[a:b].sum(axis=0) for a, b in zip(first, first[1:])])).all()


def test_distances_of_many_pairs_at_once():
    rng = random.Random(5)
    pairs = [("", ""), ("", "a"), ("a", "")]
    for _ in range(900):
        letters = rng.choice(["ab", "abcdefghij ", "äöü漢字かなabc 🙂"])
        a = [rng.choice(letters) for _ in range(rng.choice([1, 2, 10, 63, 64, 65, 128, 129, 300]) + rng.randint(0, 3))]
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 3))):
            b[(k := rng.randrange(len(b) + 1)): k + rng.randint(0, 1)] = rng.choice(letters) * rng.randint(0, 1)
        pairs.append(("".join(a), "".join(b)))
    want = [lines.similar(a, b) for a, b in pairs]
    assert lines.similar_pairs(pairs).tolist() == want and 100 < sum(want) < 850
    assert lines.similar_pairs([]).tolist() == []


def test_pairs_within_their_distance_near_the_diagonal():
    """Only words near the diagonal are computed and unlike pairs are left early: the answer is that of the whole distance."""
    rng, pairs = random.Random(31), []
    for n in (20, 64, 130, 400):
        for share in (0, 0.1, 0.25, 0.45, 0.7, 0.9, 2):
            for letters in ("ab", "etaoin shr", "日本語 ñé🙂"):
                a = [rng.choice(letters) for _ in range(n + rng.randint(0, 9))]
                b = [rng.choice(letters) for _ in a] if share > 1 else list(a)
                for _ in range(int(share * n) if share < 1 else 0):
                    b[(k := rng.randrange(len(b) + 1)): k + rng.randint(0, 1)] = rng.choice(letters) * rng.randint(0, 1)
                pairs.append(tuple(sorted(("".join(a), "".join(b) or "a"), key=len)))
    size = np.array([(len(a), len(b)) for a, b in pairs])
    allowed = (0.2 * size[:, 1] + 1e-9).astype(int)
    on = np.flatnonzero(size[:, 1] - size[:, 0] <= allowed)
    want = [_edit_distance(*pairs[k]) <= allowed[k] for k in on]
    assert lines._within([pairs[k] for k in on], size[on], allowed[on]).tolist() == want and 20 < sum(want) < len(want) - 12


def test_distances_of_many_groups_are_found_together(monkeypatch):
    """Lines that are alike are linked by their words; the distances of all groups' other pairs take a few rounds, not some for each row."""
    rng, rows = random.Random(32), []
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    for group in range(6):
        base = [rng.choice(words) for _ in range(30)]
        for k in range(lines.FEW_LINES + 6 if group % 2 else 9):
            text = [rng.choice(words) if rng.random() < rng.choice([0.02, 0.3]) else w for w in base]
            rows.append((group, " ".join(text)))
    rows = sorted(set(rows), key=lambda r: (r[0], len(r[1]), r[1]))
    texts, size = [t for _, t in rows], np.array([len(t) for _, t in rows], np.int64)
    made = [pa.array(x.view(np.int64)) for x in lines._sketched(texts, size)]
    zeros = pa.array(np.zeros(len(rows), np.int32))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.array([g for g, _ in rows])), zeros, zeros, zeros, pa.array(size.astype(np.int32)), *made[:4], pa.array(np.arange(len(rows))), pa.array(texts)],
        names=["component", "i", "j", "part", *lines._SKETCH_COLUMNS, "line", "text"])
    calls, similar_pairs = [], lines.similar_pairs
    monkeypatch.setattr(lines, "similar_pairs", lambda pairs, *a: calls.append(len(pairs)) or similar_pairs(pairs, *a))
    found = [(a, b) for r in lines._verify([batch]) for a, b in zip(r["a"].to_pylist(), r["b"].to_pylist())]
    sketch = np.stack([x.to_numpy().view(np.uint64) for x in made])
    want = groups_of(len(rows), lambda i, j: rows[i][0] == rows[j][0] and lines.similar(texts[i], texts[j])
                     and bool(lines._close(size[[i]], sketch[:, [i]], size[[j]], sketch[:, [j]])[0]))
    have = np.arange(len(rows))
    lines.C.merge_labels(have, *np.array(found).T)
    assert len(set(zip(want, have.tolist()))) == len(set(want)) == len(set(have.tolist())) < len(rows)
    assert 0 < len(calls) <= 3


def test_large_keys_give_the_groups_of_small_ones(monkeypatch):
    """Breadth-first search through a key finds the groups that the comparison of all its pairs does."""
    rng = np.random.default_rng(33)
    centres = rng.integers(0, 2**63, (60, 2), dtype=np.uint64)
    rows = np.zeros(900, lines._KEY)
    of = rng.integers(0, 60, 900)
    for c, column in enumerate("ab"):
        rows[column] = centres[of, c]
        for _ in range(11):
            rows[column] ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    step, key = rng.integers(40, 52, 900).astype(np.uint64), rng.integers(0, 3, 900).astype(np.uint64)
    rows["code"] = (key << np.uint64(lines._NAME + 8)) | (step << np.uint64(lines._NAME)) | np.arange(900, dtype=np.uint64)
    for bucket in ((2 * lines.BLOCKS) << 8, (3 * lines.BLOCKS) << 8):
        batch = pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), lines._binaries(rows, np.array([900]))], names=["bucket", "rows"])
        found = []
        for small in (2048, 4):
            monkeypatch.setattr(lines, "SMALL", small)
            found.append(sorted((c, w) for r in lines._meet([batch]) for c, w in zip(r["component"].to_pylist(), r["who"].to_pylist())))
        assert found[0] == found[1] and len({c for c, _ in found[0]}) > 20


def test_unrelated_short_lines_of_one_vocabulary_do_not_hang_together():
    """Links of one group of lines that met: all that are similar, no chains of others, as their number would outgrow the table."""
    rng = random.Random(21)
    syllables = ["th", "in", "er", "an", "re", "on", "tion", "ä"]
    texts = {" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(7)) for _ in range(350)}
    texts |= {t[:-1] + "x" for t in sorted(texts)[:60]}
    texts = sorted({t for t in texts if len(t) < lines.PATTERN}, key=lambda t: (len(t), t))
    size = np.array([len(t) for t in texts], np.int64)
    made = [pa.array(x.view(np.int64)) for x in lines._sketched(texts, size)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(len(texts), np.int64)), pa.array(np.arange(len(texts))), pa.array(size.astype(np.int32)), *made, lines._spelled(texts, size)],
        names=["component", "who", *lines._SKETCH_COLUMNS, "spelled"])
    want = np.array(groups_of(len(texts), lambda i, j: lines.similar(texts[i], texts[j])))
    small = lines.SMALL
    for lines.SMALL in (small, 4):  # step by step, breadth-first
        try:
            found = [(a, b) for r in lines._refine([batch]) for a, b in zip(r["a"].to_pylist(), r["b"].to_pylist())]
        finally:
            lines.SMALL = small
        assert all(want[a] == want[b] for a, b in found)
        assert len(found) >= 0.9 * (len(texts) - len(set(want))) >= 30


def test_edit_distances_of_many_short_pairs_at_once():
    rng, pairs = random.Random(22), []
    for _ in range(400):
        a = "".join(rng.choice("abé日") for _ in range(rng.randint(1, 64)))
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
        b = "".join(b)[:80] or "a"
        pairs += sorted([a, b], key=len) if min(len(a), len(b)) <= 64 else []
    size = np.array([len(t) for t in pairs], np.int64)
    i = np.arange(0, len(pairs), 2)
    got = lines._Spelling(lines._spelled(pairs, size))._distance(size, i, i + 1)
    assert got.tolist() == [_edit_distance(pairs[k], pairs[k + 1]) for k in i]


def test_aligned_words_never_promise_too_few_edits():
    rng, proven = random.Random(23), 0
    for _ in range(600):
        a = [rng.choice(["ab", "c", "the", "of", "", "xyz"]) for _ in range(rng.randint(1, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 2)] = rng.choice([[], ["q"], ["of"], ["the", "c"]])
        a, b = " ".join(a), " ".join(b)
        least = next(n for n in range(200) if lines.aligned(a, b, n))
        assert least >= _edit_distance(a, b) and lines.aligned(a, b, 200)
        proven += least == _edit_distance(a, b)
    assert proven > 100


def test_a_large_component_is_parted_without_pairs_of_chunks(spark):
    """Rows to verify stay in proportion to lines and edges, and the two ends of every edge share a group."""
    n, chunk = 600, 16
    edges = {(k, m) for k in range(0, n, 3) for m in (k + 1, k + 2, k + 3)}  # one long chain of small groups
    small = [(10_000, 10_001), (10_000, 10_002)]
    near = [(0, k) for k in range(n + 1)] + [(10_000, w) for w in (10_000, 10_001, 10_002)]
    made = lines._groups(spark.createDataFrame(near, "component long, who long"),
                         spark.createDataFrame([*edges, *small], "a long, b long"), chunk).collect()
    groups = {}
    for r in made:
        groups.setdefault(r.component, []).append(r.who)
    assert all(len(set(g)) == len(g) <= chunk for g in groups.values()) and sorted(groups[10_000]) == [10_000, 10_001, 10_002]
    assert len(made) <= 2 * len(edges) + 3 and {r.who for r in made} == {w for _, w in near}
    assert all({a, b} <= set(groups[a]) for a, b in edges)


def _brute_links(texts, seeds):
    """All links of the seed lines by edit similarity; only exact bounds (length, letter counts) leave a check out."""
    counts = np.array([[t.count(c) for c in " abcdefghijklmnopqrstuvwxyz0"] + [len(t)] for t in texts])
    for k in seeds:
        longer = np.maximum(counts[:, -1], counts[k, -1])
        allowed = (0.2 * longer + 1e-9).astype(int)
        apart = np.abs(counts[:, -1] - counts[k, -1])
        over = np.maximum(np.clip(counts[:, :-1] - counts[k, :-1], 0, None).sum(axis=1), np.clip(counts[k, :-1] - counts[:, :-1], 0, None).sum(axis=1))
        for m in np.flatnonzero((apart <= allowed) & (over <= allowed)).tolist():
            if m != k and lines.similar(texts[k], texts[m]):
                yield k, m


def test_recall_against_edit_similarity_by_length(spark):
    """Of the links that brute force finds for sampled lines of sf0.01, at least nine in ten end up in one group."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    texts = sorted({n for r in documents for x in (r.text or "").split("\n") if (n := lines.normalise(x.encode()))})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {r.doc_id: r.n_removed for r in lines.dedup(df, "doc_id", "text", ["doc_id"]).collect()}
    rng, found = random.Random(3), {}
    for low, high, n in ((1, 30, 300), (30, 100, 150), (100, 250, 60), (250, 500, 30)):
        pool = [k for k, t in enumerate(texts) if low <= len(t) < high]
        for k, m in _brute_links(texts, rng.sample(pool, n)):
            # of two linked lines the later one goes: it is not the first of its group
            found.setdefault((low, high), []).append(groups[max(k, m)] == 1)
    for length, hits in found.items():
        assert sum(hits) >= 0.9 * len(hits), (length, sum(hits), len(hits))
    assert sum(map(len, found.values())) > 20


# ---------------------------------------------------------------- packing

def test_packing_is_exact_and_gapless(docs, no_docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path(packing.TOKENIZER))
    got = packing.pack(docs.select("doc_id", "text"), "text", ["doc_id", "text"], with_ids=True).collect()
    by_text = {}
    for r in got:
        by_text.setdefault((r.doc_id, r.text), []).append(r)
    assert len(by_text) == len({(i, t) for i, t, *_ in DOCUMENTS})
    for (i, text), parts in by_text.items():
        copies = sum(d[:2] == (i, text) for d in DOCUMENTS)
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        parts = sorted(parts, key=lambda r: r.start)[::copies]
        assert sum((list(r.ids) for r in parts), []) == ids and [r.piece for r in parts] == list(range(len(parts)))
        assert all(r.length == 2048 for r in parts[:-1])
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in parts)
    place = {}
    for r in got:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in place.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= 2048
    assert len(place) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(no_docs, "text", ["doc_id"]).count() == 0


def test_tokens_of_awkward_words():
    from public_tokenizers import path
    from tokenizers import Tokenizer
    tokenizer, words = Tokenizer.from_file(path(packing.TOKENIZER)), packing._words(None)
    for text in ("it's We'LL a<|endoftext|>b <|ENDOFTEXT|> İstanbul ΑΣ ﬁ Ǆ é ́x a b c　d \x1c 12ab3 日本語",
                 "THE!! the!!. don't, dogs' it's!! x'll «é», É. a.b", "", " \n ", "z" * 5000):
        assert np.concatenate(list(packing.pieces_of(np.frombuffer(text.encode(), np.uint8), words))).tolist() == \
            tokenizer.encode(text, add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_every_piece_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5 + seed / 2, 1.0, 20_000).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    planned = packing.plan(counts)
    used = np.zeros(2049, int)
    for parts, n in planned:
        assert sum(parts) <= 2048 and n > 0
        for x in parts:
            used[x] += n
    assert (used == counts).all()
    # no two pieces above half a sequence share one, so both sums bound the optimum from below
    bound = max(-(-lengths.sum() // 2048), (lengths > 1024).sum())
    assert sum(n for _, n in planned) <= 1.02 * bound + 1


# ---------------------------------------------------------------- exact substrings

def removed_by_brute_force(rows, span=50):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: suffixes.NO_ID if i is None else i
    for i, b in texts:
        for s in range(len(b) - span + 1):
            w = b[s:s + span]
            first[w] = min(first.get(w, suffixes.NO_ID), order(i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1):
            if first[b[s:s + span]] < order(i):
                gone[s:s + span] = b"\1" * span
        spans = sum(1 for k, x in enumerate(gone) if x and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bucket", [4096, 2])
def test_substrings(docs, no_docs, bucket):
    rows = [d[:2] for d in DOCUMENTS]
    got = suffixes.dedup(docs, "doc_id", "text", full=True, bucket=bucket).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed_by_brute_force(rows)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed for r in got)
    if bucket == 2:
        assert suffixes.dedup(no_docs, "doc_id", "text").count() == 0


def test_substrings_of_random_texts(spark):
    rng = random.Random(23)
    stock = ["".join(rng.choice("ab ") for _ in range(rng.randint(30, 140))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(stock)[rng.randint(0, 20):] for _ in range(rng.randint(0, 8)))) for i in range(40)]
    rows += [(40, "ab" * 200), (41, "ab" * 40), (42, "a" * 49), (43, "a" * 50), (44, "a" * 51), (44, "a" * 51)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.dedup(df, "doc_id", "text", bucket=8).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed_by_brute_force(rows)


def test_multikey_sort():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, (500, 7)).astype(np.uint64)
    order, group = suffixes.multikey_sort(words)
    rows = [tuple(r) for r in words[order]]
    assert rows == sorted(rows)
    assert all((group[k] == group[k + 1]) == (rows[k] == rows[k + 1]) for k in range(len(rows) - 1))


def test_long_texts_are_cut_into_segments(monkeypatch, spark):
    monkeypatch.setattr(suffixes.C, "SEGMENT", 300)
    text = _prose(400)
    own = suffixes.Suffixes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), np.array([1]))
    monkeypatch.setattr(suffixes.C, "SEGMENT", 1 << 18)
    whole = suffixes.Suffixes(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), np.array([1]))
    assert set(zip(own.at, own.lead, own.around)) == set(zip(whole.at, whole.lead, whole.around))


# ---------------------------------------------------------------- decontamination

def benchmark_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination(spark, docs, no_docs):
    long_doc = benchmark_words(DOCUMENTS[16][1])
    items = [(1, " ".join(long_doc[500:530])), (2, " ".join(long_doc[900:909])), (3, "short"), (4, None), (5, ""),
             (6, _prose(25)), (7, "a b"), (8, "A, b!"), (9, " ".join(long_doc[515:535])), (9, " ".join(long_doc[515:535])),
             (None, " ".join(long_doc[2000:2012])), (10, benchmark_words(DOCUMENTS[0][1])[3] + " " + " ".join(benchmark_words(DOCUMENTS[0][1])[4:15]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, text in items:
        w = benchmark_words(text)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    want = []
    for i, text, *_ in DOCUMENTS:
        w, hit, found = benchmark_words(text), set(), set()
        for n in range(1, 11):
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k:k + n]))
                if ids:
                    hit.update(range(k, k + n))
                    found |= ids
        want.append((str(i), len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    got = decontam.find_hits(docs, bench, "text", "item_id", "text", ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.item_ids)) for r in got) == sorted(want)
    assert all(sum(s.finish - s.fresh for s in r.spans) == r.n_hit for r in got)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_hits(docs, nothing, "text", "item_id", "text", ["doc_id"]).where("n_hit > 0").count() == 0
    assert decontam.find_hits(no_docs, bench, "text", "item_id", "text", ["doc_id"]).count() == 0


# ---------------------------------------------------------------- columns with the operators' names

def test_kept_columns_with_clashing_names(spark):
    from vigil.llm import quality, sharding, toxicity, vectors
    clash = ["rid", "row", "at", "label", "node", "h1", "m", "b0", "cell", "weight", "id", "text", "fine", "key"]
    rows = [(i, _prose(30), [float(i), 1.0], 1) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, body string, vector array<float>, y int").select(
        "*", *[F.lit(c).alias(c) for c in clash], F.lit("x").alias("score"), F.lit("x").alias("kept"), F.lit("x").alias("n_hit"),
        F.lit("x").alias("length"), F.lit("x").alias("shard"), F.lit("x").alias("n_lines"), F.lit("x").alias("fp"))
    keep = [c for c in df.columns if c != "vector"]
    bench = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    model = toxicity.train(df, df.select("doc_id", "y"), "doc_id", "body", "y")
    made = [simhash.near_duplicates(df, "doc_id", "body", keep), lines.dedup(df, "doc_id", "body", keep), packing.pack(df, "body", keep),
            decontam.find_hits(df, bench, "body", "item_id", "text", keep), sharding.shard(df, "doc_id", "body", keep, 100),
            vectors.near_duplicates(df, "doc_id", "vector", "y", keep), toxicity.score(df, model, "body", keep),
            quality.score(df, quality.train(df, df.select("doc_id", "y"), "doc_id", "body", "y"), "body", keep)]
    for out in made:
        got = out.collect()
        assert len({c.lower() for c in out.columns}) == len(out.columns) and {r.doc_id for r in got} == set(range(6))
        assert all(r[c] == c for r in got for c in clash)
