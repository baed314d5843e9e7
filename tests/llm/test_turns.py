"""Operator 12 against enumeration of edits and a plain shortest path."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from memlake.llm import turns

WHITE = re.compile(r"[^\x20\x09-\x0D]")
GOAL = re.compile(r"(s?(ua)+)?")
SCHEMA = "text string, conv_id long, role string, turn long, conv int, audit string"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = WHITE.findall(text)
        kind = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def shortest(rows, kinds):
    """Over (row, state) with whole paths as values: cost, audit and the turns, by the rules as the contract words them."""
    best = {(0, 0): (0, "", ())}
    moves = lambda q: [(2, "user")] if q != 2 else [(3, "assistant")]
    for at in range(len(rows) + 1):
        for _ in range(4):
            for q in range(4):
                if (at, q) in best:
                    c, a, t = best[at, q]
                    for to, role in moves(q):
                        new = c + 5, a + "I", t + (f"{role}:",)
                        best[at, to] = min(best.get((at, to), new), new)
        if at == len(rows):
            break
        _, role, text = rows[at]
        for q in range(4):
            if (at, q) not in best:
                continue
            c, a, t = best[at, q]
            options = [(q, 2, "D", ())]
            if kinds[at] not in ("blank", "duplicate"):
                more = 5 * (kinds[at] == "truncated")
                options += [(to, 1 + more, "R", (f"{r}:{text}",)) for to, r in moves(q)]
                kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(q)
                options += [(kept, more, "K", (f"{role}:{text}",))] if kept is not None else []
            for to, cost, letter, said in options:
                new = c + cost, a + letter, t + said
                best[at + 1, to] = min(best.get((at + 1, to), new), new)
    return min(best[k] for k in ((len(rows), 0), (len(rows), 3)) if k in best)


def enumerated(rows, kinds, inserts=3):
    """All edits of a short conversation with at most so many inserts in a place."""
    found = []
    groups = [["", *("".join(x) for n in range(1, inserts + 1) for x in itertools.product("ua", repeat=n))]] * (len(rows) + 1)
    for put in itertools.product(*groups):
        if sum(map(len, put)) > 4:
            continue
        for edits in itertools.product(["K", "Ru", "Ra", "D"], repeat=len(rows)):
            cost, audit, roles = 5 * sum(map(len, put)), "", ""
            for gap, e, (_, role, _), kind in itertools.zip_longest(put, edits, rows, kinds, fillvalue=(None, None, None)):
                audit, roles = audit + "I" * len(gap), roles + gap
                if isinstance(e, str):
                    if e != "D" and kind in ("blank", "duplicate"):
                        break
                    cost += {"K": 0, "D": 2}.get(e, 1) + 5 * (e != "D" and kind == "truncated")
                    audit += e[0]
                    roles += "" if e == "D" else (role[:1] or "?") if e == "K" else e[1]
            else:
                if GOAL.fullmatch(roles):
                    found.append((cost, audit))
    return min(found)


def report(rows):
    """What the operator should say of sorted rows (turn, role, text)."""
    kinds = faults(rows)
    cost, audit, said = shortest(rows, kinds)
    initials = [r[:1] for _, r, _ in rows]
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def random_rows(r, n):
    roles = ["user", "assistant", "system", "tool", "", "User", "a", "s"]
    texts = ["yes.", "no!", "and so", "", " \n", "what? ", "\x1c", "x" * 9 + ".", "ü"]
    return [(r.choice([None, *range(n + 2)]) if r.random() < 0.3 else i, r.choice(roles[: r.choice([2, 3, 8])]), r.choice(texts)) for i in range(n)]


def order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


def test_matrices_against_a_shortest_path_and_enumeration():
    r = random.Random(12)
    for k in range(1500):
        rows = order(random_rows(r, r.randrange(9)))
        kinds = faults(rows)
        codes = "".join("d" if f in ("blank", "duplicate") else turns._code(role, text) for f, (_, role, text) in zip(kinds, rows))
        cost, audit = turns.finish(turns.product(codes))
        assert (cost, audit) == shortest(rows, kinds)[:2]
        if k < 60 and len(rows) <= 3:
            assert (cost, audit) == enumerated(rows, kinds)
        cut = r.randrange(len(codes) + 1)
        assert turns.multiply(turns.product(codes[:cut]), turns.product(codes[cut:])) == turns.product(codes)


def test_equal_costs_take_the_least_audit():
    said = [(0, "user", "a."), (1, "user", "b."), (2, "assistant", "c.")]
    assert enumerated(said, faults(said)) == turns.finish(turns.product("uua")) == (2, "DKK")


@pytest.mark.parametrize("piece_rows", [2, 7, 50_000])
def test_tables(spark, piece_rows):
    r = random.Random(piece_rows)
    held = {i: random_rows(r, r.randrange(1, 12)) for i in range(60)}
    held[7] = random_rows(r, 400)
    held[8] = [(None, "user", "same.")] * 50 + [(3, "user", "same."), (3, "user", "same.")]
    held[9] = [(i, "user" if i % 2 == 0 else "assistant", "ok." if i % 5 == 0 else f"{i}.") for i in range(300)]
    held[None] = [(0, "user", "of no conversation."), (1, None, None), (2, "assistant", "long " * 40_000 + ".")]
    rows = [(t, c, role, turn, 1, "x") for c, own in held.items() for turn, role, t in own]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got, parts = turns.repair(df, with_turns=True, piece_rows=piece_rows)
    reports = {x.conv_id: tuple(x)[1:] for x in got.collect()}
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert reports.keys() == held.keys()
    said = {}
    for x in sorted(parts.collect(), key=lambda x: x.piece):
        said.setdefault(x.conv_id, []).extend((t.role, t.text) for t in x.repaired)
    for c, own in held.items():
        want = report(order([(turn, " " if role is None else role, " " if t is None else t) for turn, role, t in own]))
        assert reports[c] == want, c
        assert hashlib.sha256(turns.joined(said[c]).encode()).hexdigest() == want[-1]
    none, _ = turns.repair(df.limit(0))
    assert none.count() == 0


def damaged(rows):
    """(conversation, turn, role, text) rows after damage, in plain Python."""
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            out += [(c, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (1 + (k == 3))
    return out


def test_query_over_whole_conversations(spark):
    from memlake.llm import queries

    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = {c: [] for c, *_ in rows}
    for c, *row in damaged(rows):
        after[c].append(tuple(row))
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_turns(spark, path).collect()}
    assert got == {c: report(order(own)) for c, own in after.items()}


def test_damage_that_leaves_nothing(spark):
    gone = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([("hello.", gone, "user", 0, 1, "x"), (None, None, None, None, None, None)], SCHEMA)
    rows = {r.conv_id: tuple(r)[1:] for r in turns.repair_damaged(df).collect()}
    assert rows[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert rows[None] == report([(None, "user" if zlib.crc32(b" : ") % 20 == 4 else " ", "" if zlib.crc32(b" : ") % 20 == 1 else " ")] * (1 + (zlib.crc32(b" : ") % 20 == 3))) or zlib.crc32(b" : ") % 20 == 0
    assert turns.repair_damaged(df.limit(0)).count() == 0
