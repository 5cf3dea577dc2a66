"""Conversation repair against all series of edits of short conversations, and over whole tables against a plain recursion."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from furrow.llm import conversations
from furrow.llm.queries import QUERIES
from furrow.session import table

SCHEMA = "conv_id long, turn long, role string, text string, there boolean, kind string, place string, at string, seen string"
BLANK = " \t\n\x0b\x0c\r"


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def apply(rows, audit):
    """The turns that the letters lead to, or None where they can't."""
    out, rest, expected = [], list(rows), "u"
    for letter in audit:
        if letter == "I":
            out.append(("user" if expected == "u" else "assistant", ""))
        else:
            _, role, text = rest.pop(0)
            if letter == "D":
                continue
            if letter == "K" and role[:1] == "s" and not out:
                out.append((role, text))
                expected = "u"
                continue
            out.append((role, text) if letter == "K" else ("user" if expected == "u" else "assistant", text))
            if out[-1][0][:1] != expected:
                return None
        expected = "a" if expected == "u" else "u"
    initials = "".join(r[:1] or "?" for r, _ in out)
    return out if not rest and re.fullmatch("(s?(ua)+)?", initials) else None


def all_edits(rows):
    """(cost, audit) over every series with up to two insertions in each gap."""
    faults, best = faults_of(rows), None
    inserts = ["", "I", "II"]
    for letters in itertools.product(*(("D",) if f in ("blank", "duplicate") else ("D", "K", "R") for f in faults)):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            audit = "".join(g + x for g, x in zip(gaps, [*letters, ""]))
            cost = sum({"D": 4, "R": 3, "I": 3, "K": 0}[x] for x in audit) + sum(3 for x, f in zip(letters, faults) if f == "truncated" and x != "D")
            if (best is None or (cost, audit) < best) and apply(rows, audit) is not None:
                best = cost, audit
    return best


def recursion(rows):
    """(cost, audit) of longer conversations, whole strings compared."""
    faults = faults_of(rows)
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    @cache
    def best(k, q, inserted):
        ways = [(0, "")] if k == len(rows) and q in (0, 3) else []
        if inserted < 2:
            c, a = best(k, after[q], inserted + 1)
            ways.append((c + 3, "I" + a))
        if k < len(rows):
            c, a = best(k + 1, q, 0)
            ways.append((c + 4, "D" + a))
            if faults[k] in ("", "truncated"):
                more, first = 3 * (faults[k] == "truncated"), rows[k][1][:1]
                c, a = best(k + 1, after[q], 0)
                ways.append((c + 3 + more, "R" + a))
                if first == "s" and q == 0 or first == "u" and q != 2 or first == "a" and q == 2:
                    c, a = best(k + 1, 1 if first == "s" else after[q], 0)
                    ways.append((c + more, "K" + a))
        return min(ways, default=(10**9, ""))

    for k in range(len(rows), 0, -50):  # shallow calls
        for q in range(4):
            best(k, q, 0)
    return best(0, 0, 0)


def expected(conv, rows, edits):
    rows = by_turn(rows)
    faults, turns = faults_of(rows), [t for t, _, _ in rows if t is not None]
    cost, audit = edits(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in apply(rows, audit))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_every_series_of_edits(spark):
    rng = random.Random(7)
    convs = {k: [(rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["A b.", "C", " \n", "", "A b.", "x!", "y?\t"])) for _ in range(rng.randint(1, 4))] for k in range(60)}
    df = spark.createDataFrame([(k, *r, True, "x", "x", "x", "x") for k, rows in convs.items() for r in rows], SCHEMA)
    assert rows_of(conversations.repair(df)) == sorted((expected(k, rows, all_edits) for k, rows in convs.items()), key=repr)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_query(spark, small):
    rows = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = sorted((expected(c, own, recursion) for c, own in damaged(rows).items()), key=repr)
    assert rows_of(QUERIES["op12_conversation_repair"](spark, small)) == want


@pytest.fixture(scope="module")
def strange(spark):
    """Nulls in every column, repeated turns and rows, one conversation with nothing left, a long one, extra columns with the names of helpers."""
    rng = random.Random(3)
    rows = [(None, 1, "user", "no id."), (None, None, None, None), (1, None, "system", None), (1, None, None, "Hi."), (1, 3, "user", "Hi."), (1, 3, "user", "Hi."), (1, 3, "assistant", "b. " * 40000), (1, 9, "", "?")]
    rows += [(2, t, "user", "x.") for t in range(400) if zlib.crc32(f"2:{t}".encode()) % 20 == 0][:3]
    rows += [(3, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"Number {t}.", "no", f"so {t}"])) for t in range(2500)]
    return rows


def test_strange_rows(spark, strange, monkeypatch):
    monkeypatch.setattr(conversations, "SPILL", 200)
    df = spark.createDataFrame([(*r, True, "x", "x", "x", "x") for r in strange], SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # conversations that cross batches
    try:
        got = rows_of(conversations.repair(conversations.damage(df), conversations.F.col("there")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {c: own for c, own in damaged(strange).items()}
    assert got == sorted((expected(c, own, recursion) for c, own in want.items()), key=repr)
    assert {r[0]: r for r in got}[2][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_spilled_decisions():
    """Chunks of decisions are read back in the order of the rows."""
    rng = random.Random(5)
    kinds = [rng.choice([0, 4, 5, 8, 9, 6, 12, 13]) for _ in range(3000)]
    whole, parts = conversations._Repair(1), conversations._Repair(1)
    for k in reversed(kinds):
        whole.back(k, None)
    most, conversations.SPILL = conversations.SPILL, 64
    try:
        for k in reversed(kinds):
            parts.back(k, None)
    finally:
        conversations.SPILL = most
    assert len(parts.chunks) > 50 and not whole.chunks
    whole.decide(), parts.decide()
    assert whole.audit == parts.audit and whole.cost == parts.cost


def test_turns(spark, small):
    rows = conversations.damage(table(spark, small, "conversations"))
    turns = {}
    for r in conversations.repaired_turns(rows, conversations.F.col("there")).collect():
        turns.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    for r in conversations.repair(rows, conversations.F.col("there")).collect():
        own = sorted(turns.get(r.conv_id, []))
        assert [p for p, _ in own] == list(range(1, len(own) + 1))
        assert hashlib.sha256("\n".join(t for _, t in own).encode()).hexdigest() == r.repaired_sha256


def test_nothing(spark):
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).count() == 0
