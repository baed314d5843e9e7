"""Repair of the structure of conversations by a min-plus scan of 4x4 matrices (operator 12).

The roles of a repaired conversation begin with ``(s?(ua)+)?``. Its automaton has four states: nothing yet, after system,
after user, after assistant. A turn is a matrix from state to state whose elements are (cost, audit); the product of two
elements adds the costs and joins the audits, the sum is the least of both by cost, then by ASCII. Each turn's matrix is
the closure of inserts before it times its own edits, so the matrices of a conversation multiply to all its repairs, and
the product is associative. That the order of audits agrees with joining needs that of two equal-cost audits of the same
turns from the same state none begins with the other: it does, as the longer one would have more inserts and cost more.
State and audit fix the repaired turns, as an insert or a change of role has one legal role in each state.

Rows are sorted by conversation, turn (nulls first), the first characters of role and text, and a hash of both, and cut by
range. A conversation that lies within a task and a piece (PIECE_ROWS, PIECE_BYTES) is solved where it is read. Of others
the pieces are summed up by themselves, told which of their rows stood in an earlier piece, and multiplied in a tree over
blocks; the whole audit is then dealt back to the pieces, which write their turns. No task holds more than one piece's
texts. What a task does hold of a whole conversation is one letter a row, as the audit is one value, and SHA-256 of a
conversation reads its pieces one after another, a piece at a time, as the digest has no other order.

Nulls in role and text are one space; rows with a null conversation are one conversation. Equal rows keep the place of
their sort; of equal role and text the first counts and the others are duplicates. Blank and very long texts, rows that
repeat and turns that tie are covered by that. An empty table gives no rows. Columns are named by parameters; others may
have any names and are left out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows and bytes of text up to which one task holds a conversation, or a piece of it.
PIECE_ROWS = 50_000
PIECE_BYTES = 8 << 20
#: Blocks of pieces that one step of the tree multiplies.
FANOUT = 16

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_WHITE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
_USER = {0: 2, 1: 2, 3: 2}  # the state after a user's turn; after an assistant's it is 3, from 2 only

Cell = tuple[int, str] | None
Matrix = tuple[Cell, ...]


def _least(cells) -> Cell:
    return min((c for c in cells if c is not None), default=None)


def multiply(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product; elements are (cost, audit) or None where no path leads."""
    out = []
    for i in range(0, 16, 4):
        row = [(k, a[i + k]) for k in range(4) if a[i + k] is not None]
        for j in range(4):
            best = None
            for k, x in row:
                y = b[4 * k + j]
                if y is not None and (best is None or x[0] + y[0] <= best[0]):
                    z = x[0] + y[0], x[1] + y[1]
                    best = z if best is None else min(best, z)
            out.append(best)
    return tuple(out)


def _matrix(cells: dict[tuple[int, int], Cell]) -> Matrix:
    return tuple(cells.get((i, j)) for i in range(4) for j in range(4))


IDENTITY = _matrix({(i, i): (0, "") for i in range(4)})


def closure(one: Matrix) -> Matrix:
    """The sum of all powers of a matrix of positive costs; paths of four states have three steps at most."""
    total = power = IDENTITY
    for _ in range(3):
        power = multiply(power, one)
        total = tuple(_least(pair) for pair in zip(total, power))
    return total


#: Inserts of an empty turn of a user or an assistant.
INSERTS = closure(_matrix({(i, j): (INSERT, "I") for i, j in [*_USER.items(), (2, 3)]}))


@functools.lru_cache(None)
def turn_matrix(code: str) -> Matrix:
    """Of a turn by its code: s, u, a or x (any other role); as capitals if truncated; d if it must go."""
    edits = {(i, i): [(DELETE, "D")] for i in range(4)}
    if code != "d":
        more = TRUNCATED * code.isupper()
        for i, j in [*_USER.items(), (2, 3)]:
            edits.setdefault((i, j), []).append((REROLE + more, "R"))
        kept = {"s": {0: 1}, "u": _USER, "a": {2: 3}}.get(code.lower(), {})
        for i, j in kept.items():
            edits.setdefault((i, j), []).append((KEEP + more, "K"))
    return multiply(INSERTS, _matrix({at: _least(cells) for at, cells in edits.items()}))


@functools.lru_cache(1 << 16)
def _small(codes: str) -> Matrix:
    return turn_matrix(codes) if len(codes) == 1 else multiply(_small(codes[: len(codes) // 2]), _small(codes[len(codes) // 2 :]))


def product(codes: str) -> Matrix:
    """The product of the turns' matrices, by halves."""
    if len(codes) <= 12:
        return _small(codes) if codes else IDENTITY
    return multiply(product(codes[: len(codes) // 2]), product(codes[len(codes) // 2 :]))


def finish(total: Matrix) -> tuple[int, str]:
    """The cheapest repair from nothing to nothing or to a whole pair, with inserts at the end."""
    done = multiply(total, INSERTS)
    return _least((done[0], done[3]))


@functools.lru_cache(1 << 14)
def _solved(codes: str) -> tuple[int, str]:
    return finish(product(codes))


def step(state: int, letter: str, code: str) -> int:
    """The state after an edit."""
    if letter == "D":
        return state
    if letter == "K" and code in "sS":
        return 1
    return 3 if state == 2 else 2


def edited(state: int, audit: str, codes: str, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) that an audit leaves of rows, from a state on."""
    at = 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at]
        code = "" if letter == "I" else codes[at]
        at += letter != "I"
        if letter != "D":
            yield (role if letter == "K" else "assistant" if state == 2 else "user"), text
        state = step(state, letter, code)


def _code(role: str, text: str) -> str:
    """The code of a turn by itself; b is blank."""
    said = text.rstrip(_WHITE)
    if not said:
        return "b"
    code = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return code if said[-1] in ".!?" else code.upper()


def joined(turns) -> str:
    return "\n".join(f"{r}:{t}" for r, t in turns)


class Summary(dict):
    """What is known of consecutive rows of a conversation; an associative product."""

    @classmethod
    def of(cls, codes: str, initials: list[str], turns: list[int | None], repeated: list[bool]) -> Summary:
        known = [t for t in turns if t is not None]
        final = "".join("d" if c == "b" or again else c for c, again in zip(codes, repeated))
        return cls(
            n=len(codes), codes=final, blank=codes.count("b"), duplicate=final.count("d") - codes.count("b"), truncated=sum(c in "SUAX" for c in final),
            illegal=sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])), first=initials[0], last=initials[-1],
            low=known[0] if known else None, high=known[-1] if known else None, different=len(set(known)),
        )

    def gaps(self) -> int:
        return 0 if self["low"] is None else self["high"] - self["low"] + 1 - self["different"]


def _add(a: dict, b: dict) -> dict:
    out = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated", "illegal", "different")}
    out["illegal"] += a["last"] + b["first"] not in _LEGAL
    out["different"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"first": a["first"], "last": b["last"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}


#: Fields of a conversation's report, besides its id.
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SUMMARY = "n long, blank long, duplicate long, truncated long, illegal long, different long, first string, last string, low long, high long"
_CELLS = "cells array<struct<cost: long, audit: string>>"
_TURNS = "array<struct<role: string, text: string>>"


def _frame(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _first_pass(with_turns: bool, schema: str, most_rows: int, most_bytes: int):
    """Solves the conversations that lie within a task and a piece; passes on the rows of others, by piece."""
    made = _arrow(schema)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out: list[dict] = []
        block, piece = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        conv, size, first, cut_before = None, 0, True, False

        def pass_on() -> None:
            nonlocal piece, rows, size
            for seq, (turn, role, text, code) in enumerate(rows):
                digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
                out.append({"conv": conv, "piece": (block << 24) + piece, "seq": seq, "turn": turn, "role": role, "text": text, "code": code, "digest": digest})
            piece += 1
            rows, size = [], 0

        def solve() -> None:
            nonlocal rows, size
            seen: set = set()
            repeated = [(r, t) in seen or bool(seen.add((r, t))) for _, r, t, _ in rows]
            s = Summary.of("".join(c for *_, c in rows), [r[:1] for _, r, _, _ in rows], [t for t, *_ in rows], repeated)
            cost, audit = _solved(s["codes"]) if s["n"] <= 64 else finish(product(s["codes"]))
            turns = list(edited(0, audit, s["codes"], [(r, t) for _, r, t, _ in rows]))
            row = {"conv": conv, "gaps": s.gaps(), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(joined(turns).encode()).hexdigest(), **{k: s[k] for k in ("blank", "duplicate", "truncated", "illegal")}}
            out.append(row | ({"repaired": [{"role": r, "text": t} for r, t in turns]} if with_turns else {}))
            rows, size = [], 0

        for batch in batches:
            for c, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if rows and c != conv:
                    pass_on() if first or cut_before else solve()
                    first = cut_before = False
                elif size > most_bytes or len(rows) >= most_rows:
                    pass_on()
                    cut_before = True
                conv = c
                rows.append((turn, role, text, _code(role, text)))
                size += 4 * len(text)
            if out:
                yield from _frame(out, made).to_batches()
                out.clear()
        if rows:
            pass_on()
            yield from _frame(out, made).to_batches()

    return mapped


def _summed(conv_type: str):
    """Of one piece and the digests of its rows that stood in an earlier piece: its summary, codes and matrix."""
    schema = f"conv {conv_type}, piece long, codes string, {_SUMMARY}, {_CELLS}"
    made = _arrow(schema)

    def summed(rows: pa.Table, earlier: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        seen, repeated = set(earlier.column("digest").to_pylist()), []
        for d in rows.column("digest").to_pylist():
            repeated.append(d in seen)
            seen.add(d)
        s = Summary.of("".join(rows.column("code").to_pylist()), rows.column("initial").to_pylist(), rows.column("turn").to_pylist(), repeated)
        cells = [c and {"cost": c[0], "audit": c[1]} for c in product(s["codes"])]
        return _frame([{**s, "conv": rows.column("conv")[0].as_py(), "piece": rows.column("piece")[0].as_py(), "cells": cells}], made)

    return summed, schema


def _multiplied(conv_type: str):
    """Multiplies the summaries of a group in the order of their pieces."""
    schema = f"conv {conv_type}, piece long, {_SUMMARY}, {_CELLS}"
    made = _arrow(schema)

    def multiplied(group: pa.Table) -> pa.Table:
        parts = group.sort_by("piece").to_pylist()
        matrices = [tuple(c and (c["cost"], c["audit"]) for c in p["cells"]) for p in parts]
        while len(matrices) > 1:
            matrices = [multiply(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
        whole = functools.reduce(_add, parts)
        return _frame([{**whole, "conv": parts[0]["conv"], "piece": parts[0]["piece"], "cells": [c and {"cost": c[0], "audit": c[1]} for c in matrices[0]]}], made)

    return multiplied, schema


def _reported(conv_type: str):
    """The report of a conversation by its whole product, without the digest."""
    schema = f"conv {conv_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    made = _arrow(schema)

    def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                cost, audit = finish(tuple(c and (c["cost"], c["audit"]) for c in p["cells"]))
                yield from _frame([{**p, "gaps": Summary(p).gaps(), "cost": cost, "audit": audit}], made).to_batches()

    return reported, schema


def _dealt():
    """Deals an audit back to the pieces of its conversation: the state before each and its letters; the last takes what is left."""
    schema = "piece long, state int, audit string, codes string"
    made = _arrow(schema)

    def dealt(parts: pa.Table, whole: pa.Table) -> pa.Table:
        if not parts.num_rows:
            return _frame([], made)
        audit, at, state, out = whole.column("audit")[0].as_py(), 0, 0, []
        parts = parts.sort_by("piece").to_pylist()
        for k, p in enumerate(parts):
            begun, n, state_before = at, 0, state
            while at < len(audit) and (n < p["n"] or k == len(parts) - 1):
                letter = audit[at]
                state = step(state, letter, p["codes"][n] if letter != "I" else "")
                n += letter != "I"
                at += 1
            out.append({"piece": p["piece"], "state": state_before, "audit": audit[begun:at], "codes": p["codes"]})
        return _frame(out, made)

    return dealt, schema


def _written(conv_type: str):
    """The repaired turns of a piece."""
    schema = f"conv {conv_type}, piece long, repaired {_TURNS}"
    made = _arrow(schema)

    def written(rows: pa.Table, orders: pa.Table) -> pa.Table:
        rows, order = rows.sort_by("seq"), orders.to_pylist()[0]
        pairs = list(zip(rows.column("role").to_pylist(), rows.column("text").to_pylist()))
        turns = [{"role": r, "text": t} for r, t in edited(order["state"], order["audit"], order["codes"], pairs)]
        return _frame([{"conv": rows.column("conv")[0].as_py(), "piece": order["piece"], "repaired": turns}], made)

    return written, schema


def _digests(conv_type: str):
    """SHA-256 of each conversation from its pieces in order, one at a time."""
    schema = f"conv {conv_type}, repaired_sha256 string"
    made = _arrow(schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, empty = None, None, True
        for batch in batches:
            for k in range(batch.num_rows):
                c, turns = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                if sha is None or c != conv:
                    if sha is not None:
                        yield from _frame([{"conv": conv, "repaired_sha256": sha.hexdigest()}], made).to_batches()
                    conv, sha, empty = c, hashlib.sha256(), True
                if turns:
                    sha.update((b"" if empty else b"\n") + joined((t["role"], t["text"]) for t in turns).encode())
                    empty = False
        if sha is not None:
            yield from _frame([{"conv": conv, "repaired_sha256": sha.hexdigest()}], made).to_batches()

    return digests, schema


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", with_turns: bool = False, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """(report, turns): one row per conversation that has rows, and with *with_turns* its repaired turns in pieces, in order.

    The report has the id and the fields of REPORT; turns have (id, piece, repaired), an array of (role, text) a piece.
    """
    conv_type = rows.schema[conv_col].dataType.simpleString()
    own = rows.select(rows[conv_col].alias("conv"), rows[turn_col].cast("long").alias("turn"), F.coalesce(rows[role_col], F.lit(" ")).alias("role"), F.coalesce(rows[text_col], F.lit(" ")).alias("text"))
    # Range bounds are sampled keys, so they hold beginnings of texts, not texts; the last key parts rows that are equal.
    keys = ["conv", "turn", F.substring("role", 1, 16), F.substring("text", 1, 64), F.xxhash64("role", "text")]
    dealt_rows = own.repartitionByRange(*keys, F.pmod(F.monotonically_increasing_id(), F.lit(1024))).sortWithinPartitions(*keys)
    schema = f"conv {conv_type}, {REPORT}, repaired {_TURNS}, piece long, seq int, turn long, role string, text string, code string, digest binary"
    first = cut(dealt_rows.mapInArrow(_first_pass(with_turns, schema, piece_rows, piece_bytes), schema))
    names = [f.split(" ")[0] for f in REPORT.split(", ")]
    report = first.where("piece IS NULL").select("conv", *names)
    turns = first.where("piece IS NULL").select("conv", F.lit(0).cast("long").alias("piece"), "repaired") if with_turns else None

    open_rows = first.where("piece IS NOT NULL")
    met = open_rows.groupBy("conv", "digest").agg(F.min("piece").alias("at"), F.collect_set("piece").alias("all")).where(F.size("all") > 1)
    earlier = met.select("digest", "at", F.explode("all").alias("piece")).where("piece > at").select("piece", "digest")
    summed, summed_schema = _summed(conv_type)
    narrow = open_rows.select("piece", "conv", "seq", "turn", F.substring("role", 1, 1).alias("initial"), "code", "digest")
    pieces = cut(narrow.groupBy("piece").cogroup(earlier.groupBy("piece")).applyInArrow(summed, summed_schema))
    multiplied, multiplied_schema = _multiplied(conv_type)
    tree, blocks = pieces.drop("codes"), ((pieces.agg(F.max("piece")).first()[0] or 0) >> 24) + 1
    width = 1 << 24
    while True:
        tree = tree.groupBy("conv", F.expr(f"piece div {width}")).applyInArrow(multiplied, multiplied_schema)
        if width >= blocks << 24:
            break
        width *= FANOUT
    reported, reported_schema = _reported(conv_type)
    wholes = cut(tree.mapInArrow(reported, reported_schema))
    dealt, dealt_schema = _dealt()
    orders = pieces.select("conv", "piece", "n", "codes").groupBy("conv").cogroup(wholes.select("conv", "audit").groupBy("conv")).applyInArrow(dealt, dealt_schema)
    written, written_schema = _written(conv_type)
    texts = open_rows.select("piece", "conv", "seq", "role", "text").groupBy("piece").cogroup(orders.groupBy("piece")).applyInArrow(written, written_schema)
    digests, digests_schema = _digests(conv_type)
    hashed = texts.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(digests, digests_schema)
    whole = wholes.join(hashed, wholes["conv"].eqNullSafe(hashed["conv"])).select(wholes["conv"], *[n for n in names])
    report = report.union(whole).select(F.col("conv").alias(conv_col), *names)
    return report, turns.union(texts).select(F.col("conv").alias(conv_col), "piece", "repaired") if with_turns else None


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows damaged by crc32 of ``id:turn`` modulo 20: 0 is dropped, 1 loses its text, 2 its stops, 3 comes twice, 4 is a user's."""
    filled = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    own = rows.select(rows[conv_col], rows[turn_col], filled(role_col).alias(role_col), filled(text_col).alias(text_col), (F.crc32(F.concat(filled(conv_col), F.lit(":"), filled(turn_col))) % 20).alias("__fault"))
    text = F.when(F.col("__fault") == 1, "").when(F.col("__fault") == 2, F.regexp_replace(text_col, "[.!?]", "")).otherwise(F.col(text_col))
    role = F.when(F.col("__fault") == 4, "user").otherwise(F.col(role_col))
    kept = own.where("__fault <> 0").select(conv_col, turn_col, role.alias(role_col), text.alias(text_col), F.when(F.col("__fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("__times"))
    return kept.withColumn("__times", F.explode("__times")).drop("__times")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """One row per conversation of the table: the report of its repair after damage; without any row left, zeros and the digest of nothing."""
    report, _ = repair(damage(rows))
    ids = rows.select("conv_id").distinct()
    met = ids.join(report, ids["conv_id"].eqNullSafe(report["conv_id"]), "left")
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    names = [f.split(" ")[0] for f in REPORT.split(", ")]
    return met.select(ids["conv_id"], *[F.coalesce(report[n], F.lit(nothing.get(n, 0)).cast(report.schema[n].dataType)).alias(n) for n in names])
