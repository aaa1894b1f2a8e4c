"""Conversation structure repair: bidirectional Dijkstra over the edit lattice.

A conversation is its rows by turn (nulls first; equal turns by role, then text).  The first fault of a row counts:
blank (nothing but white space), duplicate (role and text seen earlier), truncated (no ``.``, ``!`` or ``?`` at the end).
The cheapest edits give role initials ``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 1, Delete 2 (a must for
blank and duplicate rows), Insert an empty user or assistant turn 5; a truncated row that stays adds 5.  Of equally
cheap edits the audit (their initials in order) that is least in ASCII wins.

A node of the lattice is (rows consumed, state of the pattern).  Two heaps search from the start and from the
accepting ends; a label is (cost, audit so far), and among equal costs the heap goes on in the direction of its
search, so Keeps, which cost nothing, are followed in order.  No audit to a node begins another one to it, so the
least audit of a part stays least whatever follows.  The heaps stop only when their tops together exceed the
best cost: every cheapest path then crosses between settled nodes, and the least concatenated audit is taken.

Conversations are dealt by one shuffle and streamed in order; one of up to ``CHUNK`` rows and ``BUFFER`` bytes is solved
where it arrives.  Of a longer one only chunks are ever held: the cheapest edits of a chunk between every two
states are searched chunk by chunk, wherever Spark puts them; the chunks' results are put together in order, and the
digest streams over the repaired rows.  Its audit, one letter per row, is all that grows with it.

Defined results: null role or text counts as one space; a null conversation is one of its own; rows that are not ``present`` only name their
conversation; one without rows has zeros, an empty audit and the digest of nothing; an empty table stays empty; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigil.llm import common as C

CHUNK = 1024
BUFFER = 1 << 25
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5  # costs
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)  # faults
_SPACE = " \t\n\x0b\x0c\r"

# states of the pattern: nothing yet, after system, after user, after assistant
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = ("u", "u", "a", "u")
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}


def damage(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, present): rows faulted by crc32("conv:turn") % 20; nulls of the key, role and text are a space.

    0 takes a row away, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    def spaced(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"),
                      (F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20).alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.col("draw") != 0, F.when(F.col("draw") == 3, 2).otherwise(1)))
    return drawn.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("present"))


# ---------------------------------------------------------------- the lattice

def _after(steps, i, q):
    """Edits from node (i, q): letter, cost, node."""
    wanted = NEXT[q][WANTED[q]]
    yield "I", INSERT, (i, wanted)
    if i < len(steps):
        initial, fault = steps[i]
        yield "D", DELETE, (i + 1, q)
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT_OFF else 0
            if initial in NEXT[q]:
                yield "K", extra, (i + 1, NEXT[q][initial])
            yield "R", REROLE + extra, (i + 1, wanted)


def _before(steps, i, q):
    """Edits that lead to node (i, q): letter, cost, node they come from."""
    from_wanted = [p for p in range(4) if NEXT[p][WANTED[p]] == q]
    for p in from_wanted:
        yield "I", INSERT, (i, p)
    if i:
        initial, fault = steps[i - 1]
        yield "D", DELETE, (i - 1, q)
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT_OFF else 0
            for p in range(4):
                if NEXT[p].get(initial) == q:
                    yield "K", extra, (i - 1, p)
            for p in from_wanted:
                yield "R", REROLE + extra, (i - 1, p)


def search(steps: list[tuple[str, int]], start: int = 0, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of rows given as (role initial, fault), from one state to one of ``ends``."""
    n = len(steps)
    heads, tails = [(0, 0, "", start)], [(0, -n, "", q) for q in ends]
    forth: dict[tuple[int, int], tuple[int, str]] = {}
    back: dict[tuple[int, int], tuple[int, str]] = {}
    best = None
    while heads and tails and (best is None or heads[0][0] + tails[0][0] <= best):
        if heads[0][0] <= tails[0][0]:
            cost, i, audit, q = heappop(heads)
            if (i, q) in forth:
                continue
            forth[i, q] = cost, audit
            if (i, q) in back and (best is None or cost + back[i, q][0] < best):
                best = cost + back[i, q][0]
            for letter, price, node in _after(steps, i, q):
                if node not in forth:
                    heappush(heads, (cost + price, node[0], audit + letter, node[1]))
        else:
            cost, i, audit, q = heappop(tails)
            if (-i, q) in back:
                continue
            back[-i, q] = cost, audit
            if (-i, q) in forth and (best is None or cost + forth[-i, q][0] < best):
                best = cost + forth[-i, q][0]
            for letter, price, node in _before(steps, -i, q):
                if node not in back:
                    heappush(tails, (cost + price, -node[0], letter + audit, node[1]))
    crossings = []
    for (i, q), (cost, audit) in forth.items():
        if (i, q) in back:
            crossings.append((cost + back[i, q][0], audit, "", (i, q)))
        crossings += [(cost + price + back[node][0], audit, letter, node) for letter, price, node in _after(steps, i, q) if node in back]
    if not crossings:
        return None
    least = min(c[0] for c in crossings)
    return least, min(audit + letter + back[node][1] for cost, audit, letter, node in crossings if cost == least)


def apply(audit: str, rows: list[tuple], state: int = 0):
    """(edit, turn, role, text) of the rows that an audit leaves; ``rows`` are (turn, role, text)."""
    i = 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        turn, role, text = (None, "", "") if edit == "I" else rows[i]
        i += edit != "I"
        initial = role[:1] if edit == "K" else WANTED[state]
        yield edit, turn, role if edit == "K" else NAMES[initial], text
        state = NEXT[state][initial]


def fault_of(role: str, text: str, seen: set) -> int:
    trimmed = text.rstrip(_SPACE)
    if not trimmed:
        return BLANK
    if (role, text) in seen:
        return DUPLICATE
    seen.add((role, text))
    return FINE if trimmed[-1] in ".!?" else CUT_OFF


def facts_of(rows: list[tuple], faults: list[int]) -> dict:
    """Counts of consecutive rows, with what is needed to add those of the rows behind them."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return {"low": turns[0] if turns else None, "high": turns[-1] if turns else None,
            "turns": sum(1 for a, b in zip([None, *turns], turns) if a != b),
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT_OFF),
            "illegal": sum(1 for a, b in zip(initials, initials[1:]) if a + b not in LEGAL),
            "first": initials[0] if initials else None, "last": initials[-1] if initials else None}


def added(a: dict | None, b: dict) -> dict:
    """``facts_of`` the rows of ``a`` followed by those of ``b``."""
    if a is None:
        return dict(b)
    out = {k: a[k] + b[k] for k in ("turns", "blank", "duplicate", "truncated", "illegal")}
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out["illegal"] += (a["last"] or "") + (b["first"] or "") not in LEGAL
    out |= {"low": a["low"] if a["low"] is not None else b["low"], "high": b["high"] if b["high"] is not None else a["high"],
            "first": a["first"], "last": b["last"]}
    return out


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def report_of(facts: dict | None, cost: int, audit: str) -> dict:
    counts = {k: facts[k] if facts else 0 for k in _COUNTS}
    gaps = facts["high"] - facts["low"] + 1 - facts["turns"] if facts and facts["low"] is not None else 0
    return {"gaps": gaps, **counts, "cost": cost, "audit": audit}


def digest_of(hasher, turns, empty: bool) -> bool:
    """Add ``role:text`` lines; whether nothing has been added yet."""
    for _, _, role, text in turns:
        hasher.update((("" if empty else "\n") + f"{role}:{text}").encode())
        empty = False
    return empty


# ---------------------------------------------------------------- on Spark

def _rows(batches, columns):
    """Rows of sorted batches as tuples, in slices that bound what is unpacked at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            part = batch.slice(lo, CHUNK)
            yield from zip(*[part.column(c).to_pylist() for c in columns])


def _groups(rows):
    """(key, rows) of consecutive rows with equal first fields; each group must be read before the next."""
    held, ended = next(rows, None), False

    def group(key):
        nonlocal held, ended
        while held is not None and held[0] == key:
            yield held[1:]
            held = next(rows, None)

    while held is not None:
        key = held[0]
        mine = group(key)
        yield key, mine
        for _ in mine:
            pass


def _table(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _full(out: list, size: int) -> bool:
    return len(out) >= CHUNK or size >= BUFFER


def _near(chunk: int, buffer: int, with_turns: bool, schema: pa.Schema):
    """Solves conversations that fit; hands on the rows of the others with their chunk and place (kind 2)."""
    def run(batches):
        out, size = [], 0
        for conv, rows in _groups(_rows(batches, ["conv", "turn", "role", "text", "present"])):
            held, held_size, part, place, long = [], 0, 0, 0, False

            def handed():
                nonlocal place
                for turn, role, text in held:
                    yield {"conv": conv, "kind": 2, "part": part, "place": place, "turn": turn, "role": role, "text": text}
                    place += 1

            for turn, role, text, present in rows:
                if not present:
                    continue
                role, text = " " if role is None else role, " " if text is None else text
                if held and (len(held) >= chunk or held_size + len(text) > buffer):
                    long = True
                    yield _table(schema, list(handed()))
                    held, held_size, part = [], 0, part + 1
                held.append((turn, role, text))
                held_size += len(text)
            if long:
                yield _table(schema, list(handed()))
                continue
            seen: set = set()
            faults = [fault_of(role, text, seen) for _, role, text in held]
            cost, audit = search([(role[:1], fault) for (_, role, _), fault in zip(held, faults)])
            turns = list(apply(audit, held))
            hasher = hashlib.sha256()
            digest_of(hasher, turns, True)
            out.append({"conv": conv, "kind": 0, "repaired_sha256": hasher.hexdigest(),
                        **report_of(facts_of(held, faults) if held else None, cost, audit)})
            if with_turns:
                out += [{"conv": conv, "kind": 1, "place": k, "edit": e, "turn": turn, "role": role, "text": text}
                        for k, (e, turn, role, text) in enumerate(turns)]
                size += held_size
            if _full(out, size):
                yield _table(schema, out)
                out, size = [], 0
        if out:
            yield _table(schema, out)
    return run


def _between(schema: pa.Schema):
    """Per chunk of a long conversation: its facts, and the cheapest edits between every two states."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        rows = list(zip(*[group.column(c).to_pylist() for c in ("turn", "role")]))
        faults = group.column("fault").to_pylist()
        steps = [(role[:1], fault) for (_, role), fault in zip(rows, faults)]
        found = [{"start": q, "end": r, "cost": one[0], "audit": one[1]} for q in range(4) for r in range(4) if (one := search(steps, q, (r,)))]
        line = {"conv": group.column("conv")[0].as_py(), "part": group.column("part")[0].as_py(), "facts": facts_of(rows, faults), "edits": found}
        return pa.Table.from_pylist([line], schema=schema)
    return run


def _joined(schema: pa.Schema):
    """Chunks of each long conversation in order: the report, and each chunk's audit and first state."""
    def run(batches):
        for conv, chunks in _groups(_rows(batches, ["conv", "part", "facts", "edits"])):
            best, facts = {0: (0, "", None)}, None  # state: cost, audit, (chunk's audit, first state, what was before)
            for part, own, edits in chunks:
                facts, after = added(facts, own), {}
                for e in edits:
                    if e["start"] in best:
                        cost, audit, _ = best[e["start"]]
                        label = (cost + e["cost"], audit + e["audit"])
                        if e["end"] not in after or label < after[e["end"]][:2]:
                            after[e["end"]] = (*label, (part, e["audit"], e["start"], best[e["start"]][2]))
                best = after
            cost, audit, way = min((best[q] for q in ENDS if q in best), key=lambda x: x[:2])
            yield _table(schema, [{"conv": conv, "part": -1, **report_of(facts, cost, audit)}])
            while way:
                part, letters, state, way = way
                yield _table(schema, [{"conv": conv, "part": part, "audit": letters, "state": state}])
    return run


def _applied(schema: pa.Schema):
    """Repaired rows of one chunk."""
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        rows = list(zip(*[group.column(c).to_pylist() for c in ("turn", "role", "text")]))
        first = {c: group.column(c)[0].as_py() for c in ("conv", "part", "audit", "state")}
        return pa.Table.from_pylist([{"conv": first["conv"], "part": first["part"], "place": k, "edit": e, "turn": turn, "role": role, "text": text}
                                     for k, (e, turn, role, text) in enumerate(apply(first["audit"], rows, first["state"]))], schema=schema)
    return run


def _digested(schema: pa.Schema):
    def run(batches):
        for conv, rows in _groups(_rows(batches, ["conv", "role", "text"])):
            hasher, empty = hashlib.sha256(), True
            for role, text in rows:
                empty = digest_of(hasher, [(None, None, role, text)], empty)
            yield _table(schema, [{"conv": conv, "repaired_sha256": hasher.hexdigest()}])
    return run


_FACTS = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"
_EDITS = "array<struct<start:int,end:int,cost:long,audit:string>>"


def _solved(df, conv_col, turn_col, role_col, text_col, present_col, chunk, buffer, with_turns):
    present = F.col(present_col) if present_col else F.lit(True)
    source = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"),
                       F.col(text_col).cast("string").alias("text"), present.alias("present"))

    def shape(ddl):
        return C.with_columns(source, ["conv"], ddl)

    dealt = source.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    first = shape(f"kind int, part int, place long, edit string, turn long, role string, text string, {REPORT}, repaired_sha256 string")
    done = C.materialise(C.map_arrow(dealt, _near(chunk, buffer, with_turns, _arrow(first)), first), "conversations")
    return _put_together(done, shape)


def repair(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None = None,
           chunk: int = CHUNK, buffer: int = BUFFER) -> tuple[DataFrame, DataFrame]:
    """(reports, turns): ``conv`` with counts, ``cost``, ``audit`` and ``repaired_sha256``; the repaired rows in ``part``, ``place`` order."""
    return _solved(df, conv_col, turn_col, role_col, text_col, present_col, chunk, buffer, True)


def reports(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None = None,
            chunk: int = CHUNK, buffer: int = BUFFER) -> DataFrame:
    """``repair`` without the repaired rows: only reports and the rows of long conversations are written."""
    return _solved(df, conv_col, turn_col, role_col, text_col, present_col, chunk, buffer, False)[0]


def _put_together(done: DataFrame, shape) -> tuple[DataFrame, DataFrame]:
    counts = ["gaps", *_COUNTS, "cost", "audit"]
    short = done.where("kind = 0").select("conv", *counts, "repaired_sha256")
    turns = done.where("kind = 1").select("conv", F.lit(0).alias("part"), "place", "edit", "turn", "role", "text")
    long = done.where("kind = 2").select("conv", "part", "place", "turn", "role", "text")
    if not long.head(1):
        return short, turns
    trimmed = F.rtrim(F.col("text"), F.lit(_SPACE))
    firsts = long.groupBy(F.col("conv").alias("in_conv"), "role", "text").agg(F.min("place").alias("at")).select("in_conv", "at")
    fault = (F.when(trimmed == "", BLANK).when(F.col("at").isNull(), DUPLICATE)
             .when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT_OFF))
    facts = (long.join(firsts, F.col("conv").eqNullSafe(F.col("in_conv")) & (F.col("place") == F.col("at")), "left")
             .select("conv", "part", "place", "turn", "role", fault.alias("fault")))
    edits = shape(f"part int, facts struct<{', '.join(x.replace(' ', ':') for x in _FACTS.split(', '))}>, edits {_EDITS}")
    between = C.group_arrow(facts, ["conv", "part"], _between(_arrow(edits)), edits)
    whole = shape(f"part int, state int, {REPORT}")
    joined = C.materialise(C.map_arrow(between.repartition("conv").sortWithinPartitions("conv", "part"), _joined(_arrow(whole)), whole), "audits")
    parts = joined.where("part >= 0").select(F.col("conv").alias("in_conv"), F.col("part").alias("in_part"), "audit", "state")
    rows = long.join(parts, F.col("conv").eqNullSafe(F.col("in_conv")) & (F.col("part") == F.col("in_part"))).drop("in_conv", "in_part")
    repaired = shape("part int, place long, edit string, turn long, role string, text string")
    more = C.materialise(C.group_arrow(rows, ["conv", "part"], _applied(_arrow(repaired)), repaired), "repaired")
    digest = shape("repaired_sha256 string")
    ordered = more.repartition("conv").sortWithinPartitions("conv", "part", "place").select("conv", "role", "text")
    digests = C.map_arrow(ordered, _digested(_arrow(digest)), digest).withColumnRenamed("conv", "of_conv")
    heads = joined.where("part = -1").select("conv", *counts)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    longs = (heads.join(digests, F.col("conv").eqNullSafe(F.col("of_conv")), "left")
             .select("conv", *counts, F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")))
    return short.unionByName(longs), turns.unionByName(more)
