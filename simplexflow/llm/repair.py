"""Conversation structure repair by Knuth's lightest derivation.

The roles of a repaired conversation read ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn.  Edits
are: keep a row (0), give it another role (3), delete it (4, required for blank and repeated rows), insert an empty
turn (3); a truncated row that stays costs 3 more.

Deduction items are ``turn(i, outcome)``, the ways in which row i stands or goes, and ``rest(i, state)``: rows i and later,
repaired from a state of the grammar on.  A hyperedge joins ``turn(i, o)`` with ``rest(i + 1, next)`` to ``rest(i, state)``, or an inserted
turn with ``rest(i, next)``; its weight is the sum of the costs, and its audit the edit's initial before the audit of the rest, which is
monotone.  The agenda pops items by (cost, rows covered, initial): an edge adds cost or a row, so nothing popped later can
improve an item that is final, and it ends with the goal ``rest(0, start)``.  At an item each initial has one successor,
so the initial alone decides between equal costs, and audits are read off the final choices in the end.

Rows are range-partitioned by conversation and order, so a conversation with very many rows is cut into chunks over many
partitions.  Every partition has at most two cut conversations.  For those a chunk first gives its costs from each entry to each exit
state; these 4 x 4 tables (two per partition at most) are folded on the driver, which tells each chunk its exit costs and entry.

Defined cases: a null role or text is one space; rows are ordered by turn (nulls first), role and text; of equal rows all but one are
repeats; conversations are told apart by id, and a null id is one of them; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplexflow.llm.tables import SPACES, parts_for
from simplexflow.plans.lineage import cut

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow in each state, and where it leads.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The turn that may be inserted, or given to a row, in each state.
MADE = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLE = {"u": "user", "a": "assistant"}
DONE = [0, math.inf, math.inf, 0]
LEGAL = {"su", "ua", "au"}
#: Outcome of an edit that gives the role the state asks for (no initial has two letters).
ANY = "any"


def edits(initial: str, fault: str | None) -> list[tuple[str, int, str | None]]:
    """The ways of a row: initial of the edit, cost and the role's initial that then stands (None: gone, ``ANY``: as the state asks)."""
    if fault in (BLANK, DUPLICATE):
        return [("D", 4, None)]
    more = 3 if fault == TRUNCATED else 0
    return [("D", 4, None), ("K", more, initial), ("R", 3 + more, ANY)]


def follows(state: int, outcome: str | None) -> int | None:
    """The state after an outcome; None where the grammar forbids it."""
    return state if outcome is None else NEXT[state].get(MADE[state] if outcome == ANY else outcome)


def lightest(turns: list[tuple[str, str | None]], ends: list[float], goal: int | None = START) -> tuple[list[list[float]], list[list[str | None]]]:
    """Costs and edits of all final items ``[i][state]``, from the exit costs ``ends``; stops at ``rest(0, goal)``."""
    n = len(turns)
    cost = [[math.inf] * 4 for _ in range(n + 1)]
    edit: list[list[str | None]] = [[None] * 4 for _ in range(n + 1)]
    final = [[False] * 4 for _ in range(n + 1)]
    agenda = [(c, 0, "", state) for state, c in enumerate(ends) if c < math.inf]
    heapq.heapify(agenda)
    while agenda:
        c, covered, initial, state = heapq.heappop(agenda)
        i = n - covered
        if final[i][state]:
            continue
        final[i][state], cost[i][state], edit[i][state] = True, c, initial
        if i == 0 and state == goal:
            break
        for before in range(4):
            if follows(before, ANY) == state and not final[i][before]:
                heapq.heappush(agenda, (c + 3, covered, "I", before))
            if i:
                for letter, more, outcome in edits(*turns[i - 1]):
                    if follows(before, outcome) == state:
                        heapq.heappush(agenda, (c + more, covered + 1, letter, before))
    return cost, edit


def walk(turns: list[tuple[str, str | None]], edit: list[list[str | None]], state: int) -> Iterator[tuple[str, int | None, str | None, int]]:
    """The edits from ``rest(0, state)`` on: initial, row (None: inserted), new role's initial (None: as it is), state after it."""
    i = 0
    while edit[i][state]:
        letter = edit[i][state]
        made = MADE[state] if letter in "RI" else None
        state = follows(state, {"D": None, "K": turns[i][0] if i < len(turns) else None}.get(letter, ANY))
        yield letter, None if letter == "I" else i, made, state
        i += letter != "I"


def fault_columns(role: Column, text: Column) -> dict[str, Column]:
    """``blank``, ``cut_off`` and a digest of role and text."""
    last = F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)
    return {"blank": ~text.rlike(r"[^\x20\x09-\x0D]"), "cut_off": ~last.isin(".", "!", "?"),
            "digest": F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))}


def ordered(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``part, conv, turn, role, text, blank, cut_off, digest, late`` in order; ``late``: role and text stand in an earlier turn."""
    own = rows.select(F.coalesce(F.concat(F.lit("c"), F.col(conv_id).cast("string")), F.lit("")).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
                      F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    own = own.withColumns(fault_columns(F.col("role"), F.col("text")))
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    seen = own.groupBy("conv", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    own = own.join(seen, ["conv", "digest"], "left").withColumn("late", F.coalesce(place > F.col("first"), F.lit(False))).drop("first")
    # The last key only splits equal rows over partitions; their order among themselves changes nothing.
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.monotonically_increasing_id()]
    spread = parts_for(rows.count(), 1 << 16)
    wide = spread > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.withColumn("apart", keys.pop())
    keys.append(F.col("apart"))
    dealt = own.repartitionByRange(spread, *keys) if wide else own.repartitionByRange(*keys)
    return cut(dealt.sortWithinPartitions(*keys).drop("apart").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)))


@dataclass
class Chunk:
    """Rows of one conversation in one partition."""

    part: int
    conv: str
    rows: list[dict]

    def turns(self, before: tuple | None) -> list[tuple[str, str | None]]:
        """Initial and first fault of each row; ``before``: turn and digest of the conversation's row before the chunk."""
        out = []
        for r in self.rows:
            here = (r["turn"], r["digest"])
            fault = BLANK if r["blank"] else DUPLICATE if r["late"] or here == before else TRUNCATED if r["cut_off"] else None
            out.append((r["role"][:1], fault))
            before = here
        return out


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    held: Chunk | None = None
    for batch in batches:
        for row in batch.to_pylist():
            if held is None or held.conv != row["conv"]:
                if held:
                    yield held
                held = Chunk(row["part"], row["conv"], [])
            held.rows.append(row)
    if held:
        yield held


@dataclass
class Border:
    """What a chunk of a cut conversation must know: the row before it, exit costs, entry state, and whether it is the last."""

    before: tuple | None = None
    initial: str | None = None
    ends: list[float] | None = None
    entry: int = START


def _cut_conversations(rows: DataFrame) -> dict[tuple[int, str], Border]:
    """The chunks of conversations that lie in several partitions, with all that ``Border`` says.

    At most the first and the last conversation of a partition are cut, so these tables have two rows per partition at most.
    """
    slim = rows.drop("text")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[Chunk] = []
        for chunk in chunks(batches):
            chunk.rows = chunk.rows[-1:]
            ends = [*ends[:1], chunk]
        out = [(c.part, c.conv, c.rows[-1]["turn"], c.rows[-1]["digest"], c.rows[-1]["role"][:1]) for c in ends]
        yield pa.RecordBatch.from_pylist([dict(zip(EDGE.names, x)) for x in out], schema=EDGE)

    found = sorted((tuple(r) for r in slim.mapInArrow(edges, "part bigint, conv string, turn bigint, digest string, initial string").collect()),
                   key=lambda r: (r[1], r[0]))
    borders: dict[tuple[int, str], Border] = {}
    for a, b in zip(found, found[1:]):
        if a[1] == b[1]:
            borders.setdefault((a[0], a[1]), Border())
            borders[b[0], b[1]] = Border((a[2], a[3]), a[4])
    if not borders:
        return borders

    def of(what):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in chunks(batches):
                border = borders.get((chunk.part, chunk.conv))
                if border:
                    values = what(chunk.turns(border.before), border)
                    yield pa.RecordBatch.from_pylist([{"part": chunk.part, "conv": chunk.conv, "v": [float(v) for v in values]}], schema=VALUES)

        return {(r["part"], r["conv"]): r["v"] for r in slim.mapInArrow(run, "part bigint, conv string, v array<double>").collect()}

    def costs(turns: list, border: Border) -> list[float]:
        """16 costs: for each exit those of the four entries."""
        return [c for x in range(4) for c in lightest(turns, [0 if x == e else math.inf for e in range(4)], None)[0][0]]

    def exits(turns: list, border: Border) -> list[int]:
        """The exit state of each entry under the known exit costs (-1: none)."""
        edit = lightest(turns, border.ends, None)[1]
        return [-1 if edit[0][s] is None else ([s] + [after for *_, after in walk(turns, edit, s)])[-1] for s in range(4)]

    table = of(costs)
    after: tuple | None = None
    for key in sorted(borders, key=lambda k: (k[1], k[0]), reverse=True):
        ends = DONE if after is None or after[1] != key[1] else [
            min(table[after][4 * x + s] + borders[after].ends[x] for x in range(4)) for s in range(4)]
        borders[key].ends = ends
        after = key
    way = of(exits)
    before: tuple | None = None
    for key in sorted(borders, key=lambda k: (k[1], k[0])):
        if before is not None and before[1] == key[1]:
            borders[key].entry = int(way[before][borders[before].entry])
        before = key
    return borders


EDGE = pa.schema([("part", pa.int64()), ("conv", pa.string()), ("turn", pa.int64()), ("digest", pa.string()), ("initial", pa.string())])
VALUES = pa.schema([("part", pa.int64()), ("conv", pa.string()), ("v", pa.list_(pa.float64()))])
TURN = pa.schema([("part", pa.int64()), ("conv", pa.string()), ("whole", pa.bool_()), ("no", pa.int64()), ("edit", pa.string()), ("cost", pa.int64()),
                  ("fault", pa.string()), ("illegal", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
TURN_FIELDS = ("part bigint, conv string, whole boolean, no bigint, edit string, cost bigint, fault string, illegal boolean, turn bigint, role string, "
               "text string")


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every row of the cheapest repair, in order inside its partition ``part`` and by ``no``: its ``edit`` (K, R, D, I), ``cost``, ``fault``, new ``role`` and
    ``text``; ``illegal``: its old role may not follow the one before.  ``conv`` is ``c`` and the id, or empty; ``whole``: not cut by a partition.
    """
    held = ordered(rows, conv_id, turn, role, text)
    borders = _cut_conversations(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for chunk in chunks(batches):
            border = borders.get((chunk.part, chunk.conv))
            at = border or Border(ends=DONE)
            turns, old = chunk.turns(at.before), at.initial
            _, edit = lightest(turns, at.ends, at.entry)
            for no, (letter, i, made, _) in enumerate(walk(turns, edit, at.entry)):
                if i is None:
                    out.append((chunk.part, chunk.conv, border is None, no, letter, 3, None, False, None, ROLE[made], ""))
                    continue
                row, (initial, fault) = chunk.rows[i], turns[i]
                cost = {"D": 4, "K": 0, "R": 3}[letter] + 3 * (letter != "D" and fault == TRUNCATED)
                out.append((chunk.part, chunk.conv, border is None, no, letter, cost, fault, old is not None and old + initial not in LEGAL, row["turn"],
                            ROLE[made] if made else row["role"], row["text"]))
                old = initial
            if len(out) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), TURN)], schema=TURN)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), TURN)], schema=TURN)

    return held.mapInArrow(run, TURN_FIELDS)


SUM = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("whole", pa.bool_()), (BLANK, pa.int64()), (DUPLICATE, pa.int64()), (TRUNCATED, pa.int64()),
                 ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("piece", pa.binary()), ("stands", pa.bool_()), ("sha256", pa.string())])
SUM_FIELDS = (f"conv string, part bigint, whole boolean, {BLANK} bigint, {DUPLICATE} bigint, {TRUNCATED} bigint, illegal bigint, cost bigint, audit string, "
              "piece binary, stands boolean, sha256 string")
COUNTS = [BLANK, DUPLICATE, TRUNCATED, "illegal", "cost"]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk; a chunk of a cut conversation hands on its text instead of a hash."""
    for chunk in chunks(batches):
        rows = chunk.rows
        text = "\n".join(f"{r['role']}:{r['text']}" for r in rows if r["edit"] != "D").encode("utf-8", "surrogatepass")
        whole = rows[0]["whole"]
        yield pa.RecordBatch.from_pylist([{
            "conv": chunk.conv, "part": chunk.part, "whole": whole, **{f: sum(r["fault"] == f for r in rows) for f in (BLANK, DUPLICATE, TRUNCATED)},
            "illegal": sum(r["illegal"] for r in rows), "cost": sum(r["cost"] for r in rows), "audit": "".join(r["edit"] for r in rows),
            "piece": None if whole else text, "stands": any(r["edit"] != "D" for r in rows), "sha256": hashlib.sha256(text).hexdigest() if whole else None}], schema=SUM)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of cut conversations, in order, to one row each: a stream, with one piece of text in memory at a time."""

    def ended(row: dict, audit: list[str], digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([row | {"audit": "".join(audit), "piece": None, "sha256": digest.hexdigest()}], schema=SUM)

    held: dict | None = None
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if held is None or held["conv"] != row["conv"]:
                if held:
                    yield ended(held, audit, digest)
                held, audit, digest = row | dict.fromkeys(COUNTS, 0) | {"stands": False}, [], hashlib.sha256()
            if row["stands"]:
                digest.update((b"\n" if held["stands"] else b"") + row["piece"])
            held |= {c: held[c] + row[c] for c in COUNTS} | {"stands": held["stands"] or row["stands"]}
            audit.append(row["audit"])
    if held:
        yield ended(held, audit, digest)


def summaries(turns: DataFrame) -> DataFrame:
    """``conv, blank, duplicate, truncated, illegal, cost, audit, sha256`` of the conversations of ``repaired``.

    A hash goes over a text in order, so the pieces of a cut conversation meet in one task, which streams them; no other rows move.
    """
    each = cut(turns.mapInArrow(_summed, SUM_FIELDS))
    cut_ones = each.where(~F.col("whole")).repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_joined, SUM_FIELDS)
    return each.where("whole").unionByName(cut_ones).select("conv", *COUNTS, "audit", "sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of conversations with faults made by rule: a row is dropped, emptied, loses its full stops, stands twice or is a user's,
    as the CRC-32 of ``conv_id:turn`` modulo 20 is 0 to 4."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    out = rows.select("conv_id", "turn", "role", "text", (F.crc32(key) % 20).alias("case")).where("case <> 0")
    out = out.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
                     F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                     F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")
