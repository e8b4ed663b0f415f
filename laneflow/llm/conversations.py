"""Repair of conversation structure by iterative-deepening A*.

A conversation is sound if its roles are nothing, or an optional system turn
and then pairs of a user and an assistant turn. Each of its rows is kept,
given the role that is due, or deleted, and rows may be inserted; the edits
have costs. The search for the cheapest edits goes depth first through them in
ASCII order, under a bound on the cost that rises by one until a path is
accepted: that path is the cheapest, and of these the first by its letters.
What failed with a budget is kept in a table and not tried again.

Rows of a conversation pass through one task as a sorted stream, once to plan
and once to apply. A task holds a stretch of rows at a time, not the
conversation: long ones are searched stretch by stretch, from every state to
every state, and the stretches' results are chained.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laneflow.llm.base import fresh, ship_code

__all__ = ["cheapest", "damage", "digests", "plan", "repair"]

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs; the last on top for a truncated row that stays
STRETCH = 128  # rows

# States: nothing yet, after system, after user, after assistant. What follows in each, and who may be kept there.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)
NAMES = (None, None, "user", "assistant")
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
SOUND = (EMPTY, ASSISTANT)
LEGAL = ("su", "ua", "au")
CAN_REACH = ((EMPTY, SYSTEM, USER, ASSISTANT), (SYSTEM, USER, ASSISTANT), (USER, ASSISTANT), (USER, ASSISTANT))

FINE, BLANK, DUPLICATE, CUT = range(4)


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`rows` with the faults that the audit is tried on, by the CRC-32 of `conv_id:turn`, modulo 20.

    0 drops a row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3
    repeats it, 4 makes its role `user`. Nulls of the role, the text and within
    the key are read as one space; the key columns themselves stay as they are.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled(conv_id), F.lit(":"), filled(turn)).cast("binary")) % 20
    k, copy = fresh(rows, "kind"), fresh(rows, "copy")
    return (
        rows.withColumn(k, kind)
        .where(F.col(k) != 0)
        .withColumn(role, F.when(F.col(k) == 4, "user").otherwise(filled(role)))
        .withColumn(
            text,
            F.when(F.col(k) == 1, "").when(F.col(k) == 2, F.regexp_replace(filled(text), "[.!?]", "")).otherwise(filled(text)),
        )
        .withColumn(copy, F.explode(F.when(F.col(k) == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .drop(k, copy)
    )


def _fault(text: Column, again: Column) -> Column:
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", BLANK).when(again, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)


def _marked(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text and the first fault of every row; the key as text, for Python."""
    plain = rows.select(
        F.col(conv_id).cast("string").alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    seen = Window.partitionBy("conv", "role", "text").orderBy(F.asc_nulls_first("turn"))
    again = F.row_number().over(seen) > 1
    return plain.withColumn("again", again).withColumn("fault", _fault(F.col("text"), F.col("again")).cast("int")).drop("again")


ORDER = ("turn", "role", "text", "fault")  # of equal rows, the first is the one that is no duplicate


def _reach(kinds: list[tuple[str, int]]) -> list[int]:
    """For every place, a cost that the rows from there on take at least.

    A row that has to go costs its deletion, one of an unknown role a new
    role; two neighbours that may both stay but not next to each other cost one.
    """
    n = len(kinds)
    least = [DELETE if f else KEEP if r in ("s", "u", "a") else REROLE for r, f in kinds]
    h = [0] * (n + 2)
    for i in range(n - 1, -1, -1):
        h[i] = least[i] + h[i + 1]
        if i + 1 < n and not least[i] and not least[i + 1] and kinds[i][0] + kinds[i + 1][0] not in LEGAL:
            h[i] = max(h[i], 1 + h[i + 2])
    return h


def cheapest(kinds: list[tuple[str, int]], start: int = EMPTY, goal: int | None = None) -> tuple[int, str] | None:
    """Cost and letters of the cheapest edits of rows (role initial, fault), of these the ASCII-least.

    D deletes, I inserts, K keeps, R gives the role that is due. Without a goal
    the conversation has to end sound and rows may be inserted at its end; with
    one, the state after the last row's own edit has to be the goal. None if
    there is no way.
    """
    n = len(kinds)
    if goal is not None and (goal not in CAN_REACH[start] or n == 0 and goal != start):
        return None
    h, failed = _reach(kinds), {}
    for bound in range(h[0], 2 * n + 3 * INSERT + 1):
        letters = _dive(kinds, start, goal, bound, h, failed)
        if letters is not None:
            return bound, letters
    return None


def _dive(kinds, start, goal, bound, h, failed) -> str | None:
    """Depth first within the bound; `failed` holds, for (place, state), the largest budget that led nowhere."""
    n = len(kinds)
    stack, path = [(0, start, bound, _moves(kinds, 0, start, goal))], []
    while stack:
        i, state, budget, moves = stack[-1]
        if i == n and (state in SOUND if goal is None else state == goal):
            return "".join(path)
        for letter, cost, j, after in moves:
            left = budget - cost
            if left >= h[j] and failed.get((j, after), -1) < left:
                path.append(letter)
                stack.append((j, after, left, _moves(kinds, j, after, goal)))
                break
        else:
            failed[i, state] = max(budget, failed.get((i, state), -1))
            stack.pop()
            if path:
                path.pop()
    return None


def _moves(kinds, i, state, goal) -> Iterator[tuple[str, int, int, int]]:
    """(letter, cost, next place, next state) in ASCII order of the letters."""
    n = len(kinds)
    if i < n:
        yield "D", DELETE, i + 1, state
    if i < n or goal is None:
        yield "I", INSERT, i, DUE[state]
    if i < n and kinds[i][1] not in (BLANK, DUPLICATE):
        initial, fault = kinds[i]
        extra = TRUNCATED if fault == CUT else 0
        kept = KEPT[state].get(initial)
        if kept is not None:
            yield "K", KEEP + extra, i + 1, kept
        if kept != DUE[state]:
            yield "R", REROLE + extra, i + 1, DUE[state]


class Chain:
    """The cheapest edits of a conversation that comes row by row.

    For each state that the rows so far can end in: the cost, the rank of its
    letters among the states, and the letters as a chain of pieces. Every piece
    but the last ends with the edit of a row, so of two different ones none is the
    beginning of the other, and the least whole is made of least parts.
    """

    def __init__(self, stretch: int = STRETCH):
        self.stretch, self.pending = stretch, []
        self.best = {EMPTY: (0, 0, None)}

    def add(self, initial: str, fault: int) -> None:
        if len(self.pending) == self.stretch:
            ends = {goal: self._step(goal) for goal in range(4)}
            ends = {goal: end for goal, end in ends.items() if end}
            ranks = sorted((end[1], end[2], goal) for goal, end in ends.items())
            self.best = {goal: (ends[goal][0], r, (ends[goal][3], piece)) for r, (_, piece, goal) in enumerate(ranks)}
            self.pending = []
        self.pending.append((initial, fault))

    def _step(self, goal: int | None):
        """Least (cost, rank of what came before, piece, what came before)."""
        ways = []
        for state, (cost, rank, before) in self.best.items():
            found = cheapest(self.pending, state, goal)
            if found:
                ways.append((cost + found[0], rank, found[1], before))
        return min(ways, key=lambda w: w[:3], default=None)

    def result(self) -> tuple[int, str]:
        cost, _, piece, before = self._step(None)
        pieces = [piece]
        while before:
            before, piece = before
            pieces.append(piece)
        return cost, "".join(reversed(pieces))


class _Audit:
    """Counts and edits of one conversation."""

    def __init__(self):
        self.chain, self.last = Chain(), None
        self.counts, self.illegal = [0, 0, 0, 0], 0
        self.first_turn = self.last_turn = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None and turn != self.last_turn:  # turns come in order
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        self.counts[fault] += 1
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        self.chain.add(initial, fault)

    def row(self, conv: str | None) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return (conv, min(gaps, 2**63 - 1), *self.counts[1:], self.illegal, *self.chain.result())


PLAN = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PLAN_ARROW = pa.schema([("conv", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _in_chunks(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _table(held, schema)
            held = []
    yield _table(held, schema)


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def audits():
        conv, audit = None, None
        for key, turn, initial, fault in _rows_of(batches):
            if audit is None or key != conv:
                if audit is not None:
                    yield audit.row(conv)
                conv, audit = key, _Audit()
            audit.add(turn, initial, fault)
        if audit is not None:
            yield audit.row(conv)

    return _in_chunks(audits(), PLAN_ARROW)


def _plans(marked: DataFrame) -> DataFrame:
    ship_code(marked.sparkSession)
    streamed = marked.repartition("conv").sortWithinPartitions("conv", *ORDER)
    return streamed.select("conv", "turn", F.left("role", F.lit(1)).alias("initial"), "fault").mapInArrow(_audits, PLAN)


def plan(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: what is wrong with it and the cheapest edits that make it sound.

    Columns: the conversation's id, gaps (turn numbers missing between the
    first and the last, nulls left out), blank, duplicate, truncated (rows by
    their first fault), illegal (neighbours whose role initials may not follow
    each other), cost, and audit: a letter per edit, as `cheapest` has them.

    Rows are taken by turn, nulls first; of one turn by role, then text. A
    role or text that is null is one space; such a text is blank. Rows without
    an id are one conversation. Repeated rows are duplicates, all but one. A
    conversation of any length is read as a stream. Other columns do not
    matter; an empty table gives an empty result.
    """
    kind = rows.schema[conv_id].dataType
    found = _plans(_marked(rows, conv_id, turn, role, text))
    return found.select(F.col("conv").cast(kind).alias(conv_id), *found.columns[1:])


REPAIRED = "conv string, place long, role string, text string"
REPAIRED_ARROW = pa.schema([("conv", pa.string()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str, str]]:
    """(conversation, role, text) of every repaired row, in order; each conversation begins with its audit."""
    conv, audit, at, state = None, "", 0, EMPTY

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, DUE[state]
            yield conv, NAMES[state], ""

    for key, new, role, text in _rows_of(batches):
        if new is not None:
            yield from inserted()
            conv, audit, at, state = key, new, 0, EMPTY
            continue
        yield from inserted()
        letter, at = audit[at], at + 1
        if letter == "K":
            state = KEPT[state][role[:1]]
            yield conv, role, text
        elif letter == "R":
            state = DUE[state]
            yield conv, NAMES[state], text
    yield from inserted()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def placed():
        last, place = object(), 0
        for conv, role, text in _edited(batches):
            place = place + 1 if conv == last else 0
            last = conv
            yield conv, place, role, text

    return _in_chunks(placed(), REPAIRED_ARROW)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.string()), ("sha256", pa.string())])

    def hashes():
        last, digest = None, None
        for conv, role, text in _edited(batches):
            if digest is not None and conv == last:
                digest.update(b"\n")
            else:
                if digest is not None:
                    yield last, digest.hexdigest()
                last, digest = conv, hashlib.sha256()
            digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield last, digest.hexdigest()

    return _in_chunks(hashes(), schema)


def _with_audits(marked: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows in order, each conversation after a row with its audit."""
    first = plans.select("conv", F.lit(0).alias("part"), "audit")
    rest = marked.withColumn("part", F.lit(1))
    streamed = first.unionByName(rest, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "part", *ORDER)
    return streamed.select("conv", "audit", "role", "text")


def repair(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The rows of all conversations after their edits: id, place (from 0), role, text.

    Inserted rows have an empty text. Conversations of which nothing stays have
    no rows. Nulls, ties and repeats: see `plan`.
    """
    kind = rows.schema[conv_id].dataType
    marked = _marked(rows, conv_id, turn, role, text)
    found = _with_audits(marked, _plans(marked)).mapInArrow(_repaired, REPAIRED)
    return found.select(F.col("conv").cast(kind).alias(conv_id), "place", F.col("role").alias(role), F.col("text").alias(text))


def digests(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """`plan` with repaired_sha256: the SHA-256 of the repaired `role:text`, joined by line feeds.

    A digest takes the rows one after the other, so those of a conversation go
    through one task, as a stream.
    """
    kind = rows.schema[conv_id].dataType
    marked = _marked(rows, conv_id, turn, role, text)
    plans = _plans(marked)
    hashed = _with_audits(marked, plans).mapInArrow(_hashed, "conv string, sha256 string")
    hashed = hashed.withColumnRenamed("conv", "_conv")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return plans.join(hashed, F.col("conv").eqNullSafe(F.col("_conv")), "left").select(
        F.col("conv").cast(kind).alias(conv_id),
        *plans.columns[1:],
        F.coalesce("sha256", empty).alias("repaired_sha256"),
    )


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audit_damaged(rows: DataFrame) -> DataFrame:
    """`digests` of the damaged `rows`, and a row of zeros for each conversation of which the damage left nothing."""
    ids = rows.select(F.col("conv_id").alias("_id")).distinct()
    found = digests(damage(rows.select("conv_id", "turn", "role", "text")))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )
