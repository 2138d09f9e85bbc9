"""Faults in the structure of conversations, and the cheapest edits that repair it.

A repaired conversation is an optional system turn and then user and assistant turns
in pairs, or nothing.  Rows are kept, given another role or deleted, and empty turns
are inserted; what the rest of a conversation costs depends on how many rows are left
and on the last role alone, four numbers per row.

The cheapest edits need these costs from the end backwards, the ASCII-least edits
need them from the start forwards.  Rows are therefore cut into blocks of the square
root of the conversation's length.  A first pass streams one symbol per row backwards
and stores the four costs only at the checkpoints between blocks.  A second pass
streams the rows forwards with the checkpoint behind each block: it works out the
costs inside one block again, walks through it, writes the edits, and forgets it.
So a conversation of n turns needs the memory of about 2 * sqrt(n) of them.  It is
one task, as a digest of its repaired turns in order asks for it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayweave.llm import common

#: White space that makes a text blank where there is nothing else, and ends of a whole sentence.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: States by the last role: nothing yet, system, user, assistant.  For each: where a turn may lead (initial: state), and the role that an edit gives.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
GIVEN = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
#: Costs behind the last row: only nothing and whole pairs are an end.
NEVER = 1 << 60
LAST = (0, NEVER, NEVER, 0)
EMPTY_SHA256 = hashlib.sha256().hexdigest()
#: Two initials that may stand side by side.
NEIGHBOURS = ("su", "ua", "au")


def inserted(costs: list[int]) -> tuple[int, int, int, int]:
    """Costs with insertions allowed before the next row; from any state two of them come back to it."""
    user, assistant = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
    return min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant


@functools.cache
def options(symbol: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """Edits of a row in the order of their initials: (initial, cost, next state).

    A symbol is d for rows that must go, else the role's initial, in upper case for
    a row that is cut off; any other initial is a dot or a colon.
    """
    found = [("D", DELETE, state)]
    if symbol != "d":
        extra = CUT_OFF if symbol.isupper() or symbol == ":" else 0
        if (then := FOLLOWS[state].get(symbol.lower())) is not None:
            found.append(("K", KEEP + extra, then))
        found.append(("R", REROLE + extra, GIVEN[state][0]))
    return tuple(found)


def before(symbol: str, costs: tuple[int, ...]) -> tuple[int, int, int, int]:
    """Costs before a row from those behind it."""
    return inserted([min([c + costs[s] for _, c, s in options(symbol, state)]) for state in range(4)])


END_COSTS = inserted(list(LAST))


def walk(symbols: str, behind: tuple[int, ...], state: int, last: bool) -> tuple[list[tuple[str, int]], int]:
    """Edits of a block as (initial, place of the row or -1 for an insertion), and the state behind it.

    Among the cheapest edits the ASCII-least are taken, one initial after the other:
    a deletion, an insertion, a kept and a changed row, in this order.
    """
    costs = [behind]
    for symbol in reversed(symbols):
        costs.append(before(symbol, costs[-1]))
    costs.reverse()
    edits, i = [], 0
    while i < len(symbols) or (last and LAST[state] != costs[i][state]):
        here, then = costs[i][state], GIVEN[state][0]
        tight = {e: (c, s) for e, c, s in options(symbols[i], state) if c + costs[i + 1][s] == here} if i < len(symbols) else {}
        if "D" in tight:
            edits.append(("D", i))
            i += 1
        elif INSERT + costs[i][then] == here:
            edits.append(("I", -1))
            state = then
        else:
            chosen = "K" if "K" in tight else "R"
            edits.append((chosen, i))
            state = tight[chosen][1]
            i += 1
    return edits, state


def damaged(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", kinds: int = 20) -> DataFrame:
    """(conv, turn, role, text) after reproducible damage; a dropped row leaves a row with a null role behind.

    A null role or text is one space; a null id or turn is one in the hashed key.
    """
    key = F.concat(F.coalesce(F.col(conv_id).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    who, said, kind = F.coalesce(role, F.lit(" ")), F.coalesce(text, F.lit(" ")), F.crc32(key.cast("binary")) % kinds
    changed = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said)
    rows = df.select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(kind == 0, F.lit(None)).when(kind == 4, F.lit("user")).otherwise(who).alias("role"),
        changed.alias("text"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return rows.drop("copy")


def faulty(rows: DataFrame) -> DataFrame:
    """(conv, block, pos, symbol, fault, turn, role, text): rows by turn (null first), ties by role and text, with their first fault.

    Blocks have as many rows as the square root of their number, rounded up.  Rows
    with a null role stand for their conversation only: pos 0 in block -1.
    """
    trimmed = F.rtrim("text", F.lit(SPACE))
    same = Window.partitionBy("conv", "role", "print").orderBy(F.asc_nulls_first("turn"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "text")
    there = F.col("role").isNotNull()
    dealt = rows.withColumn("print", F.md5("text")).repartition("conv")
    seen = dealt.withColumn("again", F.row_number().over(same) > 1)
    fault = F.when(~there, F.lit(None)).when(trimmed == "", "blank").when(F.col("again"), "duplicate").when(~F.right(trimmed, F.lit(1)).isin(*ENDS), "truncated")
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(".")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.when(known == ".", ":").otherwise(F.upper(known))).otherwise(known)
    placed = seen.withColumn("fault", fault).withColumn("alive", there.cast("long"))
    placed = placed.withColumn("pos", F.when(there, F.sum("alive").over(order.rowsBetween(Window.unboundedPreceding, 0))).otherwise(0))
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.sum("alive").over(Window.partitionBy("conv")))))
    block = F.when(there, F.floor((F.col("pos") - 1) / size)).otherwise(-1)
    return placed.withColumns({"block": block, "symbol": symbol}).select("conv", "block", "pos", "symbol", "fault", "turn", "role", "text")


CHECKPOINTS = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))])


def checkpoints(rows: DataFrame) -> DataFrame:
    """(conv, block, costs): the costs behind every block, from a stream of symbols from the last row to the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, inside, costs = (), None, END_COSTS
        for batch in batches:
            done = []
            for conv, block, symbol in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current != (conv,):
                    current, inside, costs = (conv,), None, END_COSTS
                if block != inside:
                    inside = block
                    done.append((conv, block, list(costs)))
                costs = before(symbol, costs)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), CHECKPOINTS, strict=True)], schema=CHECKPOINTS)

    ordered = rows.where("block >= 0").select("conv", "block", "symbol", "pos").repartition("conv").sortWithinPartitions("conv", F.desc("pos")).drop("pos")
    return common.arrow_map(ordered, run, "conv long, block long, costs array<long>")


class Repairer:
    """Streams one conversation forwards, a block at a time."""

    def __init__(self, conv: int | None, emit: Callable[[str, str, str], None] | None = None):
        self.conv, self.emit, self.state, self.behind, self.block = conv, emit, START, END_COSTS, []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.previous, self.turns, self.first, self.turn = 0, None, 0, None, None
        self.digest, self.written, self.audit, self.cost = hashlib.sha256(), False, [], None

    def checkpoint(self, costs: list[int]) -> None:
        self.flush(False)
        self.behind = tuple(costs)

    def row(self, symbol: str, fault: str | None, turn: int | None, role: str, text: str) -> None:
        if fault:
            self.counts[fault] += 1
        if self.previous is not None and self.previous + role[:1] not in NEIGHBOURS:
            self.illegal += 1
        self.previous = role[:1]
        if turn is not None and (self.turn is None or turn != self.turn):
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        self.block.append((symbol, role, text))

    def flush(self, last: bool) -> None:
        """Works out the block's costs again, walks through it and forgets it."""
        symbols = "".join(b[0] for b in self.block)
        if self.cost is None and symbols:
            costs = self.behind
            for symbol in reversed(symbols):
                costs = before(symbol, costs)
            self.cost = costs[START]
        state = self.state
        edits, self.state = walk(symbols, self.behind, state, last)
        for edit, i in edits:
            self.audit.append(edit)
            if edit == "D":
                continue
            role = self.block[i][1] if edit == "K" else GIVEN[state][1]
            state = FOLLOWS[state][role[:1]]
            text = "" if edit == "I" else self.block[i][2]
            self.digest.update((("\n" if self.written else "") + f"{role}:{text}").encode("utf-8", "replace"))
            self.written = True
        self.block = []

    def result(self) -> tuple:
        if self.block:
            self.flush(True)
        gaps = 0 if self.turn is None else self.turn - self.first + 1 - self.turns
        return self.conv, gaps, *self.counts.values(), self.illegal, self.cost or 0, "".join(self.audit), self.digest.hexdigest()


REPAIRED = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv, turn, role, text): its faults, the cost and initials of its edits, and a digest of its repaired turns.

    gaps: turn numbers that are missing; blank, duplicate, truncated: rows by their
    first fault; illegal: neighbours whose roles do not fit; audit: K(eep),
    R(erole), D(elete) and I(nsert) in order.  Rows with a null role only name
    their conversation; one without other rows has zeros, no edits and the digest of
    nothing.  Rows without a conversation are one of their own.
    """
    placed = common.written(faulty(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Repairer | None = None
        for batch in batches:
            done = []
            for conv, pos, costs, symbol, fault, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or current.conv != conv:
                    if current is not None:
                        done.append(current.result())
                    current = Repairer(conv)
                if costs is not None:
                    current.checkpoint(costs)
                elif pos > 0:
                    current.row(symbol, fault, turn, role, text)
            if done:
                yield _batch(done)
        if current is not None:
            yield _batch([current.result()])

    turns = placed.withColumn("costs", F.lit(None).cast("array<long>"))
    names = ["conv", "block", "pos", "costs", "symbol", "fault", "turn", "role", "text"]
    behind = checkpoints(placed).withColumns({"pos": F.lit(0).cast("long"), **{n: F.lit(None).cast("string") for n in ("symbol", "fault", "role", "text")}, "turn": F.lit(None).cast("long")})
    ordered = turns.select(*names).unionByName(behind.select(*names)).repartition("conv").sortWithinPartitions("conv", "block", "pos")
    return common.arrow_map(ordered.drop("block"), run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), REPAIRED, strict=True)], schema=REPAIRED)


OP13_SQL = r"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
           lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
  FROM damaged),
rows_ AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS previous
  FROM ordered),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id),
best(conv_id, pos, f0, f1, f2, f3) AS (
  SELECT conv_id, n + 1, {'c': 0, 'a': '', 'r': ''}, {'c': 4, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:' || chr(10)}, {'c': 2, 'a': 'I', 'r': 'assistant:' || chr(10)}, {'c': 0, 'a': '', 'r': ''} FROM counts
  UNION ALL
  SELECT conv_id, pos,
         list_sort([g0, {'c': 2 + f2.c, 'a': 'I' || f2.a, 'r': 'user:' || chr(10) || f2.r}])[1],
         list_sort([g1, {'c': 2 + f2.c, 'a': 'I' || f2.a, 'r': 'user:' || chr(10) || f2.r}])[1], f2, f3
  FROM (
    SELECT conv_id, pos, g0, g1, list_sort([g2, {'c': 2 + g3.c, 'a': 'I' || g3.a, 'r': 'assistant:' || chr(10) || g3.r}])[1] AS f2,
           list_sort([g3, {'c': 2 + g2.c, 'a': 'I' || g2.a, 'r': 'user:' || chr(10) || g2.r}])[1] AS f3
    FROM (
      SELECT conv_id, pos,
             list_sort(list_filter([d0, CASE WHEN stays AND initial = 's' THEN {'c': more + v1.c, 'a': 'K' || v1.a, 'r': line || v1.r} END,
               CASE WHEN stays AND initial = 'u' THEN {'c': more + v2.c, 'a': 'K' || v2.a, 'r': line || v2.r} END, CASE WHEN stays THEN ru END], lambda x: x IS NOT NULL))[1] AS g0,
             list_sort(list_filter([d1, CASE WHEN stays AND initial = 'u' THEN {'c': more + v2.c, 'a': 'K' || v2.a, 'r': line || v2.r} END, CASE WHEN stays THEN ru END], lambda x: x IS NOT NULL))[1] AS g1,
             list_sort(list_filter([d2, CASE WHEN stays AND initial = 'a' THEN {'c': more + v3.c, 'a': 'K' || v3.a, 'r': line || v3.r} END,
               CASE WHEN stays THEN {'c': 2 + more + v3.c, 'a': 'R' || v3.a, 'r': 'assistant:' || text || chr(10) || v3.r} END], lambda x: x IS NOT NULL))[1] AS g2,
             list_sort(list_filter([d3, CASE WHEN stays AND initial = 'u' THEN {'c': more + v2.c, 'a': 'K' || v2.a, 'r': line || v2.r} END, CASE WHEN stays THEN ru END], lambda x: x IS NOT NULL))[1] AS g3
      FROM (
        SELECT b.conv_id, r.pos, r.initial, r.text, r.role || ':' || r.text || chr(10) AS line, r.fault IN ('', 'truncated') AS stays, CASE r.fault WHEN 'truncated' THEN 1 ELSE 0 END AS more,
               b.f1 AS v1, b.f2 AS v2, b.f3 AS v3,
               {'c': 3 + b.f0.c, 'a': 'D' || b.f0.a, 'r': b.f0.r} AS d0, {'c': 3 + b.f1.c, 'a': 'D' || b.f1.a, 'r': b.f1.r} AS d1,
               {'c': 3 + b.f2.c, 'a': 'D' || b.f2.a, 'r': b.f2.r} AS d2, {'c': 3 + b.f3.c, 'a': 'D' || b.f3.a, 'r': b.f3.r} AS d3,
               {'c': 2 + CASE r.fault WHEN 'truncated' THEN 1 ELSE 0 END + b.f2.c, 'a': 'R' || b.f2.a, 'r': 'user:' || r.text || chr(10) || b.f2.r} AS ru
        FROM best b JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.pos = b.pos - 1) x) y) z),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, CAST(coalesce(b.f0.c, 0) AS BIGINT) AS cost, coalesce(b.f0.a, '') AS audit,
       sha256(CASE WHEN length(b.f0.r) > 0 THEN left(b.f0.r, length(b.f0.r) - 1) ELSE '' END) AS repaired_sha256
FROM ids i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id AND b.pos = 1
"""
