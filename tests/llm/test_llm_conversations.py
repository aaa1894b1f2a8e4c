"""Conversation repair: the lattice against all paths, whole tables against the lattice."""

import hashlib
import random
import zlib

import pytest

from vigil.llm import conversations as CV
from vigil.llm import queries


def _plain(steps, start=0, ends=CV.ENDS):
    """Least (cost, audit) by forward dynamic programming over all labels."""
    def closed(states):
        for _ in range(3):
            for q in range(4):
                if q in states:
                    to = CV.NEXT[q][CV.WANTED[q]]
                    label = (states[q][0] + 5, states[q][1] + "I")
                    states[to] = min(states.get(to, label), label)
        return states

    states = closed({start: (0, "")})
    for initial, fault in steps:
        after = {}

        def offer(q, cost, audit):
            after[q] = min(after.get(q, (cost, audit)), (cost, audit))
        for q, (cost, audit) in states.items():
            offer(q, cost + 2, audit + "D")
            if fault in (CV.FINE, CV.CUT_OFF):
                extra = 5 if fault == CV.CUT_OFF else 0
                if initial in CV.NEXT[q]:
                    offer(CV.NEXT[q][initial], cost + extra, audit + "K")
                offer(CV.NEXT[q][CV.WANTED[q]], cost + extra + 1, audit + "R")
        states = closed(after)
    return min((states[q] for q in ends if q in states), default=None)


def _all_paths(steps, budget):
    """Every audit of at most ``budget``, by depth-first search without any pruning but the cost."""
    out = []

    def walk(i, q, cost, audit):
        if cost > budget:
            return
        if i == len(steps) and q in CV.ENDS:
            out.append((cost, audit))
        for letter, price, (j, r) in CV._after(steps, i, q):
            walk(j, r, cost + price, audit + letter)
    walk(0, 0, 0, "")
    return min(out)


@pytest.mark.parametrize("seed", range(6))
def test_search_against_all_paths(seed):
    rng = random.Random(seed)
    for _ in range(150):
        steps = [(rng.choice("suax") if rng.random() < 0.97 else "", rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(0, 6))]
        assert CV.search(steps) == _plain(steps) == _all_paths(steps, 2 * len(steps)), steps
    for _ in range(40):
        steps = [(rng.choice("ssuuuaaax"), rng.choice((0, 0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(20, 120))]
        for start, ends in ((0, CV.ENDS), (1, (2,)), (3, (3,)), (2, (0,))):
            assert CV.search(steps, start, ends) == _plain(steps, start, ends)


def _expected(rows):
    """Report of one conversation by the rules: rows are (turn, role, text) after damage."""
    rows = sorted(((t, r, x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3)
        seen.add((role, text))
    cost, audit = _plain([(r[:1], f) for (_, r, _), f in zip(rows, faults)])
    lines, i, state = [], 0, 0
    for e in audit:
        if e == "D":
            i += 1
            continue
        role, text = (rows[i][1], rows[i][2]) if e != "I" else ("", "")
        i += e != "I"
        initial = role[:1] if e == "K" else "a" if state == 2 else "u"
        lines.append((role if e == "K" else {"u": "user", "a": "assistant"}[initial]) + ":" + text)
        state = CV.NEXT[state][initial]
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if draw == 1 else "".join(c for c in text if c not in ".!?") if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def _rows(seed, conversations=60, longest=14):
    rng = random.Random(seed)
    texts = ["Hello.", "Hello.", "What?", "cut off", "", " \n", "Ünï!", "tail . ", "x" * 50 + "!", None, " ", "a\nb."]
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, turn if rng.random() < 0.9 else rng.choice([None, turn + 3, 0]),
                         rng.choice(["user", "assistant", "user", "assistant", "system", "unknown", "", None, "Über"]), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _by_conversation(rows):
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in _damaged(rows):
        out[conv].append((turn, role, text))
    return out


@pytest.mark.parametrize("chunk", [CV.CHUNK, 3])
def test_reports_and_turns(spark, chunk):
    rows = _rows(3)
    df = spark.createDataFrame([(*r, "gaps") for r in rows], "conv_id long, turn long, role string, text string, cost string")
    found, turns = CV.repair(CV.damage(df, "conv_id", "turn", "role", "text"), "conv", "turn", "role", "text", "present", chunk=chunk)
    groups = _by_conversation(rows)
    got = {r.conv: r for r in found.collect()}
    assert len(got) == found.count() and set(got) == set(groups)
    repaired = {}
    for r in sorted(turns.collect(), key=lambda r: (r.part, r.place)):
        repaired.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    for conv, own in groups.items():
        want, lines = _expected(own)
        assert tuple(got[conv][c] for c in FIELDS) == want, (conv, own)
        assert repaired.get(conv, []) == lines


def test_long_conversations_by_rows_and_bytes(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"text {rng.randint(0, 400)}{rng.choice(['.', '.', '?', ''])}") for t in range(700)]
    rows += [(2, t, "user" if t % 2 == 0 else "assistant", "y" * 200 + f"{t}.") for t in range(40)] + [(3, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "c long, t long, r string, x string")
    groups = _by_conversation(rows)
    got = {r.conv: r for r in CV.reports(CV.damage(df, "c", "t", "r", "x"), "conv", "turn", "role", "text", "present", chunk=64, buffer=1000).collect()}
    assert {c: tuple(got[c][f] for f in FIELDS) for c in got} == {c: _expected(own)[0] for c, own in groups.items()}


def test_query_on_awkward_tables(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    rows = _rows(5, 80, 8) + [(1000 + k, 1, "user", "Only.") for k in range(60)]  # some lose their only row
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/conversations.parquet")
    groups = _by_conversation(rows)
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in queries.op13_conversations(spark, f"{tmp_path}/a").collect()}
    assert got == {c: _expected(own)[0] for c, own in groups.items()}
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got.values()
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert queries.op13_conversations(spark, f"{tmp_path}/b").collect() == []
