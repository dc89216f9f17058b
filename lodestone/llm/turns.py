"""Repair the structure of conversations by aligning their turns to the alternating grammar.

A sound conversation reads ``(s?(ua)+)?`` in the first letters of its roles. Its turns are
aligned to every target string of that grammar at once: all targets end alike, so one
Wagner-Fischer table over (turns left, letters of the target left) serves each feasible
length. A row's cheapest cell of either parity is its incumbent; cells that cost more lie outside
the Ukkonen band, since no cheapest alignment of any length passes them. Cells that tie are
traced until they meet and their audits compared, so a row holds three cells however long a
conversation is.

Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4 (required for blank and duplicate
turns), Insert an empty user or assistant turn 3; a truncated turn that isn't deleted adds 3.
The number of edits that keep a turn decides the target, so an audit fixes the repair.

Rows are ordered inside a conversation by turn (nulls first), then by role, then by a digest of
the text. The table of turns is shuffled by (conversation, turn, role, text) for
duplicates, so copies meet as counts; then each conversation is streamed in order by one task, which holds
a byte per turn (some 300 while it is aligned) and never its texts: an audit is one string
and its digest sequential.

Defined cases: null role or text counts as one space, null turns come first, a null
conversation id is a conversation of its own; a role without letter, or of another first letter
than s, u, a, can't be kept. Repeated rows are duplicates of the first. Very long texts pass
through as they are. Extra columns of any name are not read. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import NULL_ID, staged

WS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Code of a turn: role in the low two bits, state in the next two.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
_ALTERNATE = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


Cell = tuple[int, int, str, "Cell | None"]  # cost, letters of the target left, edit, next cell


def _less(a: Cell, b: Cell) -> bool:
    """The cheaper cell; of equals the one whose audit, traced up to where both meet, is ASCII-least."""
    if a[0] != b[0]:
        return a[0] < b[0]
    while a is not b:
        if a[2] != b[2]:
            return a[2] < b[2]
        a, b = a[3], b[3]
    return True


def _to(cell: Cell, cost: int, edit: str) -> Cell:
    return (cell[0] + cost, cell[1] + (edit != "D"), edit, cell)


def _least(*cells: Cell) -> Cell:
    best = cells[0]
    for c in cells[1:]:
        if _less(c, best):
            best = c
    return best


def _rows(codes: bytes) -> Iterator[tuple[int, Cell, Cell, Cell]]:
    """From the last turn back: the cells of a row that are inside its band.

    A cell costs what the turns from i on cost against the last letters of a target. Targets
    end in ``ua``, so the letter at an even number of letters left is a u, else an a, and any
    feasible length goes on from a cell by its parity alone: ``none`` has no letter
    left, ``even`` two or more, ``odd`` one or more.
    """
    end: Cell = (0, 0, "", None)
    none, odd = end, _to(end, INSERT, "I")
    even = _to(odd, INSERT, "I")
    yield len(codes), none, even, odd
    for i in range(len(codes) - 1, -1, -1):
        role, state = codes[i] & 3, codes[i] >> 2
        to_a, to_u = [_to(odd, DELETE, "D")], [_to(even, DELETE, "D")]
        if state in (SOUND, TRUNCATED):
            cut = CUT if state == TRUNCATED else 0
            rest = _least(none, even)
            to_a.append(_to(rest, cut, "K") if role == ASSISTANT else _to(rest, cut + REROLE, "R"))
            to_u.append(_to(odd, cut, "K") if role == USER else _to(odd, cut + REROLE, "R"))
        none = _to(none, DELETE, "D")
        even = _least(*to_u)
        odd = _least(*to_a, _to(_least(none, even), INSERT, "I"))
        even = _least(even, _to(odd, INSERT, "I"))
        yield i, none, even, odd


@lru_cache(maxsize=4096)
def audit(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest edits, the ASCII-least of those that tie."""
    led: Cell | None = None  # a system turn leads, all turns before it go
    below: Cell | None = None
    for i, none, even, odd in _rows(codes):
        if led is not None:
            led = _to(led, DELETE, "D")
        if i < len(codes) and codes[i] & 3 == SYSTEM and codes[i] >> 2 in (SOUND, TRUNCATED):
            kept = _to(below, CUT if codes[i] >> 2 == TRUNCATED else 0, "K")
            led = kept if led is None else _least(led, kept)
        below = even
    best = _least(none, even) if led is None else _least(none, even, led)
    cost, out = best[0], []
    while best[3] is not None:
        out.append(best[2])
        best = best[3]
    return cost, "".join(out)


def targets(edits: str) -> str:
    """The letters of the target that an audit's edits produce."""
    n = len(edits) - edits.count("D")
    return ("s" if n % 2 else "") + "ua" * (n // 2)


def _order(turns: DataFrame) -> DataFrame:
    """Distinct turns with their number of copies: ``c, t, turn, role, text, h, n``."""
    blank = F.lit(" ")
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("c"),
        F.coalesce(F.col("turn").cast("long"), F.lit(NULL_ID)).alias("t"),
        F.coalesce(F.col("role"), blank).alias("role"),
        F.coalesce(F.col("text"), blank).alias("text"),
    )
    rows = rows.groupBy("c", "t", "role", "text").agg(F.count("*").alias("n"))
    return rows.withColumn("h", F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


def _coded(rows: DataFrame) -> DataFrame:
    """``role`` and ``state`` of each distinct turn as numbers; ``first``: no earlier turn says the same."""
    bare = F.trim(F.col("text"), F.lit(WS))
    role: Column = F.coalesce(*(F.when(F.substring("role", 1, 1) == x, i) for i, x in enumerate("sua")), F.lit(OTHER))
    state = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    seen = rows.groupBy("c", "h").agg(F.min("t").alias("__first"))
    coded = rows.select("c", "t", "role", "h", "n", role.alias("r"), state.alias("s")).join(seen, ["c", "h"])
    return coded.select("c", "t", "role", "h", "n", "r", "s", (F.col("t") == F.col("__first")).alias("first"))


_REPORT = "c long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_REPORT_ARROW = pa.schema([("c", pa.int64()), *((x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])


class _Conversation:
    """What one task holds of the conversation it streams."""

    def __init__(self, key: int):
        self.key, self.codes, self.illegal, self.last = key, bytearray(), 0, None
        self.low, self.high, self.turns, self.before = None, None, 0, None

    def add(self, turn: int, copies: int, role: int, state: int, first: bool) -> None:
        if turn != NULL_ID and turn != self.before:
            self.low, self.high, self.turns, self.before = turn if self.low is None else self.low, turn, self.turns + 1, turn
        if self.last is not None and (self.last, role) not in _ALTERNATE:
            self.illegal += 1
        self.illegal += copies - 1  # copies stand beside each other
        self.last = role
        again = role | (BLANK if state == BLANK else DUPLICATE) << 2
        self.codes += bytes([role | state << 2 if first else again]) + bytes([again]) * (copies - 1)

    def row(self) -> tuple:
        cost, edits = audit(bytes(self.codes))
        states = [sum(self.codes.count(bytes([r | s << 2])) for r in range(4)) for s in (BLANK, DUPLICATE, TRUNCATED)]
        return (self.key, self.high - self.low + 1 - self.turns if self.turns else 0, *states, self.illegal, cost, edits)


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None
    for batch in batches:
        out = []
        for c, t, n, r, s, first in zip(*(batch.column(x).to_pylist() for x in ("c", "t", "n", "r", "s", "first"))):
            if now is None or now.key != c:
                if now is not None:
                    out.append(now.row())
                now = _Conversation(c)
            now.add(t, n, r, s, first)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 8, _REPORT_ARROW)], schema=_REPORT_ARROW)
    if now is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(_REPORT_ARROW.names, now.row()))], schema=_REPORT_ARROW)


_TURNS = "c long, pos long, t long, role string, text string, edit string"
_TURNS_ARROW = pa.schema([("c", pa.int64()), ("pos", pa.int64()), ("t", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
_ROLES = {"u": "user", "a": "assistant"}


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a conversation's audit (kind 0) and then its turns in order; gives the repaired turns."""
    key, edits, want, at, pos = None, "", "", 0, 0
    out: list[tuple] = []

    def put(turn: int | None, role: str | None, text: str) -> None:
        nonlocal at, pos
        e = edits[at]
        at += 1
        if e != "D":
            out.append((key, pos, turn, role if e == "K" else _ROLES[want[pos]], text, e))
            pos += 1

    def inserted() -> None:
        while at < len(edits) and edits[at] == "I":
            put(None, None, "")

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * 6, _TURNS_ARROW)], schema=_TURNS_ARROW)
        out.clear()
        return batch

    for batch in batches:
        for c, kind, t, role, text, n, found in zip(*(batch.column(x).to_pylist() for x in ("c", "kind", "t", "role", "text", "n", "audit"))):
            if kind == 0:
                inserted()
                key, edits, want, at, pos = c, found, targets(found), 0, 0
                continue
            for _ in range(n):
                inserted()
                put(None if t == NULL_ID else t, role, text)
                if len(out) >= 4096:
                    yield flush()
        yield flush()
    inserted()
    yield flush()


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two DataFrames of ``turns`` (conv_id, turn, role, text).

    The report has a row per conversation: ``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit``. The repaired turns have ``conv_id, pos, turn, role, text, edit`` (K,
    R or I; inserted turns have a null turn). A conversation's turns stand in one partition,
    in order of ``pos``.
    """
    rows = staged(_order(turns), "turns")
    by_turn = ["c", "t", "role", "h"]
    report = staged(_coded(rows).repartition("c").sortWithinPartitions(*by_turn).mapInArrow(_reported, _REPORT), "audits")
    heads = report.select("c", F.lit(0).alias("kind"), F.lit(NULL_ID).alias("t"), F.lit("").alias("role"), F.lit("").alias("h"), F.lit("").alias("text"), F.lit(1).cast("long").alias("n"), "audit")
    body = rows.select("c", F.lit(1).alias("kind"), "t", "role", "h", "text", "n", F.lit(None).cast("string").alias("audit"))
    stream = heads.unionByName(body).repartition("c").sortWithinPartitions("c", "kind", "t", "role", "h")
    fixed = stream.select("c", "kind", "t", "role", "text", "n", "audit").mapInArrow(_applied, _TURNS)
    conv = F.nullif(F.col("c"), F.lit(NULL_ID)).alias("conv_id")
    return (
        report.select(conv, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"),
        fixed.select(conv, "pos", F.col("t").alias("turn"), "role", "text", "edit"),
    )


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` over ``role:text`` joined by new lines, streamed in order."""
    import hashlib

    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            ids, done = [], []
            for c, pos, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "pos", "role", "text"))):
                if pos == 0:
                    if state is not None:
                        ids.append(key)
                        done.append(state.hexdigest())
                    key, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(done, pa.string())], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([state.hexdigest()], pa.string())], schema=schema)

    return repaired.select("conv_id", "pos", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Repeatable faults, to measure repair by: of twenty hash classes of ``conv_id:turn`` five drop,
    empty, cut, repeat a turn or make it the user's. Nulls become one space, ids stay null."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), fault.alias("__fault")).where("__fault <> 0")
    text = F.when(F.col("__fault") == 1, "").when(F.col("__fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__fault") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("__fault") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("__copy")).drop("__copy")
