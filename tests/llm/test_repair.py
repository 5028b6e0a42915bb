"""Conversation repair against all edits by hand, in one piece and in many."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from awardsift.llm import repair
from tests.llm.helpers import SMALL

SCHEMA = "conv_id long, turn long, role string, text string"


def lightest(roles, faults):
    """All edits with up to two insertions at a place."""
    best = None
    for edits in itertools.product("DKR", repeat=len(roles)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults)):
            continue
        for gaps in itertools.product(range(3), repeat=len(roles) + 1):
            audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))
            written, state, i, cost = "", 0, 0, 0
            for e in audit:
                cost += {"D": 2, "K": 0, "R": 1, "I": 5}[e] + (5 if e in "KR" and faults[i] == "truncated" else 0)
                if e == "K":
                    written += roles[i][:1] or "-"
                elif e != "D":
                    written += "a" if written.endswith("u") else "u"
                i += e != "I"
            if re.fullmatch("(s?(ua)+)?", written) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_derivations_by_hand():
    draw = random.Random(5)
    for _ in range(150):
        n = draw.randrange(5)
        roles = [draw.choice(["user", "assistant", "system", "tool", ""]) for _ in range(n)]
        faults = [draw.choice(["", "", "", "truncated", "blank", "duplicate"]) for _ in range(n)]
        assert next(iter(repair.derive(roles, faults).values())) == lightest(roles, faults)


def by_hand(rows):
    """Whole conversations in one go; rows are (conv_id, turn, role, text) in order."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
        out[conv] = repair.solve(*(list(c) for c in zip(*own))) if own else None
    return out


def collected(spark, rows, piece=repair.PIECE):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in repair.Repair(df, piece).summary().collect()}


def made(seed, lengths):
    draw = random.Random(seed)
    rows = []
    for conv, n in lengths.items():
        for k in range(n):
            role = draw.choice(["user", "assistant"]) if draw.random() < 0.2 else ["user", "assistant"][k % 2]
            rows.append((conv, None if draw.random() < 0.02 else k + (k > 5), role, draw.choice(["", "same words.", f"turn {k}", f"turn {k}.", f"why {k}?", None])))
    return rows


@pytest.mark.parametrize("piece", [1, 3, 256])
def test_pieces(spark, piece):
    """A conversation of 900 rows, short ones, one without an id; any piece size."""
    rows = made(7, {0: 900, 1: 1, 2: 7, 3: 40, None: 12, -4: 2})
    assert collected(spark, rows, piece) == by_hand(rows)


def test_one_row_many_times(spark):
    """A conversation of equal rows is split over tasks although nothing tells its rows apart."""
    rows = [(1, 4, "user", "Yes.")] * 3000 + [(2, 0, "user", "Hello."), (2, 1, "assistant", "Hi.")]
    got = collected(spark, rows)
    assert got[1]["duplicate"] == 2999 and got[1]["cost"] == 6000 and got[1]["audit"] == "D" * 3000 and got[1]["illegal"] == 2999
    assert got[2]["audit"] == "KK" and got[2]["cost"] == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Why?"), (1, 2, "assistant", "So."), (1, 3, "user", " ")]
    df = spark.createDataFrame(rows, SCHEMA)
    fixed = repair.Repair(df, keep=True)
    lines = [(r.role, r.text) for r in fixed.lines().orderBy("part", "seq", "pos").collect()]
    assert lines == [("system", "Be kind."), ("user", "Why?"), ("assistant", "So.")]
    assert fixed.summary().first().repaired_sha256 == hashlib.sha256(b"system:Be kind.\nuser:Why?\nassistant:So.").hexdigest()


def test_damage(spark):
    rows = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()}
    after = {}
    for r in repair.damage(spark.read.parquet(f"{SMALL}/conversations.parquet")).collect():
        after.setdefault((r.conv_id, r.turn), []).append(r)
    for key, row in rows.items():
        kind = zlib.crc32(f"{key[0]}:{key[1]}".encode()) % 20
        text = "" if kind < 2 else re.sub("[.!?]", "", row.text) if kind == 2 else row.text
        assert [(r.role, r.text, r.present) for r in after[key]] == [("user" if kind == 4 else row.role, text, kind != 0)] * (2 if kind == 3 else 1)


def test_awkward(spark):
    rows = [(None, None, None, None), (1, None, "user", ""), (1, 9223372036854775807, "", "x."), (1, -9223372036854775808, "user", "y" * 200_000), (2, 0, "robot", "Beep!")]
    got = collected(spark, rows)
    assert got == by_hand(rows) and got[1]["gaps"] == 9223372036854775807 and got[2]["audit"] == "D"
    gone = spark.createDataFrame([(5, 0, "user", "Hi.", False)], SCHEMA + ", present boolean").selectExpr("*", "'x' AS audit", "1 AS part", "2 AS cost")
    row = repair.Repair(gone).summary().first()
    assert (row.conv_id, row.gaps, row.cost, row.audit, row.repaired_sha256) == (5, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.Repair(gone.limit(0)).summary().count() == 0
