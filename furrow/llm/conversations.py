"""Repair of damaged conversations: the cheapest edits that make the roles alternate, found while the turns stream by.

Rows are dealt by conversation and numbered by turn. Each stands twice in the sorted stream of its task: first without its text from the last turn to the first, then with it from the first
to the last. One pass over the Arrow batches carries the state of a dynamic program from batch to batch. Against the turns, that is the cost of repairing the rest of the
conversation from each of four places of the pattern ``(system? (user assistant)+)?``; what to do with a row from each place fits into a byte, a second one tells system turns, and a
conversation of millions of turns spills its bytes into compressed chunks. At the first turn the edits are read off forwards, so that of the cheapest series of edits the smallest in ASCII is taken exactly; the
second half of the stream applies them. No conversation is held in memory but for its bytes and its edits.

Faults: blank (nothing but white space), duplicate (role and text stood earlier in the conversation), truncated (the last sign is none of ``.!?``); a row counts for the first that holds.

Defined results: rows of one turn stand in the order of role and text; null turns come first; null roles and texts count as one space; a null conversation is one of its own; roles are told
apart by their first letter (none for an empty role, which then never fits); a conversation without rows has zeros, no edits and no turns; an empty table gives an empty result;
other columns are ignored. One conversation's rows go through one task, a row at a time; a single text is held whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.batches import small_batches

#: Bytes of decisions that are kept as they are; fuller series are compressed.
SPILL = 1 << 20
BLANKS = " \t\n\x0b\x0c\r"

# Places of the pattern: 0 before everything, 1 after a system turn, 2 after a user turn, 3 after an assistant turn. At 0 and 3 the conversation may end.
_INSERT = (2, 2, 3, 2)  # the place after a user or assistant turn that fits
_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_INITIALS = "sua"
_ROLES = (None, None, "user", "assistant")  # of a new turn, by the place that it leads to
_LETTERS = "DIKR"
_COST = {"D": 4, "I": 3, "R": 3, "truncated": 3}
_OTHER, _DROPPED = 3, -1
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, role string, text string, edit string"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, there): a fifth to a quarter of the rows damaged by a hash of conversation and turn; a dropped row stays with ``there`` false."""
    space = F.lit(" ")
    own = F.coalesce(F.col(role), space), F.coalesce(F.col(text), space)
    key = F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    spoilt = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(own[1], "[.!?]", "")).otherwise(own[1])
    one = F.struct(F.when(kind == 4, F.lit("user")).otherwise(own[0]).alias("role"), spoilt.alias("text"))
    again = F.when(kind == 3, F.array(one, one)).otherwise(F.array(one))
    out = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), (kind != 0).alias("there"), F.explode(again).alias("row"))
    return out.select("conv_id", "turn", "row.role", "row.text", "there")


def _streams(rows: DataFrame, there: Column) -> DataFrame:
    """(conv_id, at, kind, turn, role, text), dealt by conversation and sorted by (conv_id, at): at < 0 without texts from the last row to the first, at > 0 the same rows forwards."""
    space = F.lit(" ")
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.coalesce(there, F.lit(False)).alias("there")
    )
    # One shuffle: the windows and the sorted stream all find the rows dealt by conversation.
    dealt = own.repartition("conv_id")
    turns = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.desc("there"), F.asc_nulls_first("turn")))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("there"), *turns, F.asc("seen")))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(bare == "", 2).when(F.col("seen") > 1, 3).when(~F.right(bare, F.lit(1)).isin(*".!?"), 1).otherwise(0)
    initial = F.lit(_OTHER)
    for k, c in enumerate(_INITIALS):
        initial = F.when(F.substring("role", 1, 1) == c, k).otherwise(initial)
    kind = F.when(F.col("there"), initial * 4 + fault).otherwise(_DROPPED)
    marked = dealt.withColumn("seen", seen).withColumn("place", place).withColumn("kind", kind)
    both = marked.select("conv_id", "kind", "turn", "role", "text", F.explode(F.when(F.col("there"), F.array(-F.col("place"), F.col("place"))).otherwise(F.array(-F.col("place")))).alias("at"))
    ahead = F.col("at") > 0
    light = both.select("conv_id", "at", "kind", "turn", F.when(ahead, F.col("role")).alias("role"), F.when(ahead, F.col("text")).alias("text"))
    return light.sortWithinPartitions("conv_id", "at")


#: Cost of what is missing at the end, from each place; edits at the end are insertions.
_END = (0, 6, 3, 0)


@cache
def _step(kind: int, rest: tuple[int, ...]) -> tuple[int, tuple[int, ...], int]:
    """(what all costs have in common, the costs above that, decisions) before a row of ``kind``, given the costs ``rest`` after it. Two bits for each place: the first letter to write."""
    initial, fault = divmod(kind, 4)
    more = _COST["truncated"] if fault == 1 else 0
    ways: list[dict[str, int]] = []
    for q in range(4):
        own = {"D": _COST["D"] + rest[q]}
        if fault < 2:
            own["R"] = _COST["R"] + more + rest[_INSERT[q]]
            kept = _KEEP[_INITIALS[initial]][q] if initial != _OTHER else None
            if kept is not None:
                own["K"] = more + rest[kept]
        ways.append(own)
    best = [min(w.values()) for w in ways]
    for _ in range(3):  # an insertion leads to another place before the same row
        best = [min(b, _COST["I"] + best[_INSERT[q]]) for q, b in enumerate(best)]
    decisions = 0
    for q, own in enumerate(ways):
        own["I"] = _COST["I"] + best[_INSERT[q]]
        decisions |= next(k for k, letter in enumerate(_LETTERS) if own.get(letter) == best[q]) << 2 * q
    low = min(best)
    return low, tuple(b - low for b in best), decisions


class _Repair:
    """State of one conversation in the stream."""

    def __init__(self, conv):
        self.conv = conv
        self.counts = [0, 0, 0, 0]  # by fault
        self.illegal, self.later, self.distinct, self.last, self.highest = 0, None, 0, None, None
        self.base, self.rest = 0, _END
        self.bytes, self.chunks = bytearray(), []
        self.audit, self.read, self.q, self.place = None, 0, 0, 0
        self.digest = hashlib.sha256()

    def back(self, kind: int, turn) -> None:
        """The next row against the turns."""
        initial, fault = divmod(kind, 4)
        self.counts[fault] += 1
        if self.later is not None and (initial, self.later) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.later = initial
        if turn is not None and turn != self.last:
            self.distinct += 1
            self.last = turn
            if self.highest is None:
                self.highest = turn
        low, self.rest, decisions = _step(kind, self.rest)
        self.base += low
        self.bytes += bytes((decisions, initial == 0))
        if len(self.bytes) >= SPILL:
            self.chunks.append(zlib.compress(bytes(self.bytes), 1))
            self.bytes = bytearray()

    def decide(self) -> None:
        """Reads the edits off, from the first row on."""
        self.cost = self.base + self.rest[0]
        out, q = bytearray(), 0
        for chunk in [bytes(self.bytes), *map(zlib.decompress, reversed(self.chunks))]:
            for system, decisions in zip(reversed(chunk[1::2]), reversed(chunk[::2])):
                # Until the row is kept, dropped or given a role, turns are inserted before it.
                while (letter := _LETTERS[decisions >> 2 * q & 3]) == "I":
                    out += b"I"
                    q = _INSERT[q]
                out += letter.encode()
                if letter != "D":
                    q = 1 if letter == "K" and system and q == 0 else _INSERT[q]
        while q in (1, 2):
            out += b"I"
            q = _INSERT[q]
        self.audit, self.bytes, self.chunks, self.q = bytes(out), bytearray(), [], 0

    def _write(self, role: str, text: str, edit: str) -> tuple:
        self.digest.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
        self.place += 1
        return self.conv, self.place, role, text, edit

    def _inserted(self) -> Iterator[tuple]:
        while self.audit[self.read : self.read + 1] == b"I":
            self.read += 1
            self.q = _INSERT[self.q]
            yield self._write(_ROLES[self.q], "", "I")

    def ahead(self, kind: int, role: str, text: str) -> Iterator[tuple]:
        """The next row of the second half: the turns that it leads to."""
        if self.audit is None:
            self.decide()
        yield from self._inserted()
        letter = chr(self.audit[self.read])
        self.read += 1
        if letter == "K":
            self.q = _KEEP[_INITIALS[kind // 4]][self.q]
            yield self._write(role, text, letter)
        elif letter == "R":
            self.q = _INSERT[self.q]
            yield self._write(_ROLES[self.q], text, letter)

    def end(self) -> Iterator[tuple]:
        if self.audit is None:
            self.decide()
        yield from self._inserted()

    def summary(self) -> tuple:
        gaps = self.highest - self.last + 1 - self.distinct if self.highest is not None else 0
        _, truncated, blank, duplicate = self.counts
        return self.conv, gaps, blank, duplicate, truncated, self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest()


def _repairs(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[pa.RecordBatch]:
    """The sorted stream to rows of ``TURNS``, else of ``SUMMARY``."""
    names = [x.split()[0] for x in (TURNS if turns else SUMMARY).split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in (TURNS if turns else SUMMARY).split(", ")]
    now: _Repair | None = None

    def finish() -> list[tuple]:
        last = list(now.end())
        return last if turns else [now.summary()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        out: list[tuple] = []
        for conv, at, kind, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    out += finish()
                now = _Repair(conv)
            if kind == _DROPPED:
                continue
            if at < 0:
                now.back(kind, turn)
            else:
                made = list(now.ahead(kind, role, text))
                if turns:
                    out += made
        yield packed(out)
    if now is not None:
        yield packed(finish())


def repair(rows: DataFrame, there: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``rows(conv_id, turn, role, text)``.

    ``there``: rows for which it is not true are no part of their conversation, which returns all the same. ``gaps``: turns missing between the least and the highest; ``illegal``: neighbours whose roles
    may not follow each other; ``audit``: a letter for each edit, K for keep, R for a new role, D for delete, I for an inserted empty turn; the digest is of ``role:text`` of the repaired turns, in lines.
    """
    small_batches(rows.sparkSession)
    return _streams(rows, F.lit(True) if there is None else there).mapInArrow(lambda batches: _repairs(batches, False), SUMMARY)


def repaired_turns(rows: DataFrame, there: Column | None = None) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns of the repaired conversations, numbered from 1; inserted ones are empty."""
    small_batches(rows.sparkSession)
    return _streams(rows, F.lit(True) if there is None else there).mapInArrow(lambda batches: _repairs(batches, True), TURNS)
