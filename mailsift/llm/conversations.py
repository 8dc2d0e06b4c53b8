"""Conversation structure repair: turns aligned to the grammar ``(s?(ua)+)?`` of role initials at least cost.

Edits: keep a turn (0), give it the role user or assistant (2), delete it (3, required for blank and repeated turns),
insert an empty user or assistant turn (2); a truncated turn that stays adds 1. The result is the cheapest list of
edits whose role initials fit the grammar; of equally cheap ones the audit (initials of the edits in order) that
comes first in ASCII.

Alignment. The grammar's strings are the prefixes of ``uaua...`` and ``suaua...`` that end in ``a``, or nothing. A
Wagner-Fischer table holds the cost from every turn and every place of such a string to the end; strings that
begin alike share one table, with one entry in its last row for each feasible length. A quick repair gives the
incumbent cost; a place further from the diagonal than that cost can pay for (Ukkonen's band) is never
filled. An audit is traced through each table, and the cheaper one, then the lesser one, is taken.

Long conversations. Rows are sorted by ranges of (key, turn, role, text), so one conversation may spread over
many tasks, and are cut into blocks of at most TURNS turns. A block that is not a whole conversation is summed up
by the costs between the states of the grammar at its two ends (nothing yet, after s, after u, after a).
Those few numbers are chained backwards along a conversation, which tells every block what each of its ends
costs from there on; then its state at the start, block by block; then each block is traced by itself. Only
the final digest of a conversation reads its blocks one after the other, since a digest cannot be
split; it holds one block at a time.

Defined cases: null keys are one conversation; null turns come first; null roles and texts are one space; rows of
equal turns are ordered by role, then text; equal rows are duplicates of the first. A role whose initial is not s, u or a
cannot be kept. Extra columns are not read, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from mailsift.llm.common import SLICE_BYTES, small_batches, written

#: Turns of a block at most.
TURNS = 1024
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs beyond any real one.
NEVER = 1 << 40
FINAL = [0, NEVER, NEVER, 0]
_ROLES = {"u": "user", "a": "assistant"}
_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_SPACES = " \t\n\x0b\x0c\r"


def fault(text: str, seen: bool) -> str:
    """b(lank), d(uplicate), t(runcated) or nothing."""
    last = text.rstrip(_SPACES)[-1:]
    return "b" if not last else "d" if seen else "t" if last not in ".!?" else ""


# --- alignment of one block ----------------------------------------------------------------

def _target(entry: int, with_s: bool, length: int) -> np.ndarray:
    """The first letters of the string that goes on from a state."""
    cycle = "au" if entry == USER else "ua"
    return np.array(list((("s" if with_s else "") + cycle * (length // 2 + 1))[:length]))


def _ends(entry: int, target: np.ndarray) -> np.ndarray:
    """The state after each number of letters."""
    return np.array([entry] + [_STATE[x] for x in target])


def incumbent(initials: list[str], faults: list[str], entry: int, ahead: list[int]) -> int:
    """What a quick repair costs, ``ahead`` being the cost from each state at the end on."""
    cost, state = 0, entry
    for initial, bad in zip(initials, faults):
        if bad in ("b", "d"):
            cost += DELETE
            continue
        expected = ASSISTANT if state == USER else USER
        cost += CUT * (bad == "t")
        if initial == "s" and state == START:
            state = SYSTEM
        elif initial in _ROLES and _STATE[initial] != expected:
            cost += INSERT
            state = _STATE[initial]
        else:
            cost += REROLE * (initial not in _ROLES)
            state = expected
    best = NEVER
    for more in range(3):
        best = min(best, cost + INSERT * more + ahead[state])
        state = ASSISTANT if state == USER else USER
    return best


class Table:
    """Costs from (turn, letters of the target so far) to the end, within the band of an incumbent cost."""

    def __init__(self, initials: list[str], faults: list[str], entry: int, with_s: bool, ahead: list[int], limit: int):
        m, left, right = len(initials), limit // DELETE, limit // INSERT
        width = m + right + 1
        self.initials, self.faults = initials, faults
        self.target = _target(entry, with_s, width)
        self.ends = np.array(ahead)[_ends(entry, self.target)]
        self.first = 1 if with_s else 0  # an s is never inserted
        ramp = INSERT * np.arange(width + 1)
        step = {x: np.where(self.target == x, 0, np.where(self.target == "s", NEVER, REROLE)) for x in set(initials)}
        self.cost = np.full((m + 1, width + 1), NEVER)
        for i in range(m, -1, -1):
            a, b = max(0, i - left), min(width, i + right + 1)
            if i == m:
                row = self.ends[a:b].copy()
            else:
                row = DELETE + self.cost[i + 1, a:b]
                if faults[i] not in ("b", "d"):
                    row = np.minimum(row, step[initials[i]][a:b] + CUT * (faults[i] == "t") + self.cost[i + 1, a + 1:b + 1])
            k = max(0, self.first - a)
            row[k:] = np.minimum.accumulate((row + ramp[a:b])[k:][::-1])[::-1] - ramp[a:b][k:]
            self.cost[i, a:b] = np.minimum(row, NEVER)

    def trace(self, last: bool) -> tuple[str, int]:
        """The least audit of the cheapest edits, and the letters used. Turns are inserted before the next turn of the
        conversation, so only its last block ends with inserted ones."""
        i = j = 0
        m, audit = len(self.initials), []
        while i < m or last and self.cost[i, j] != self.ends[j]:
            now = self.cost[i, j]
            if i < m and now == DELETE + self.cost[i + 1, j]:
                audit.append("D")
                i += 1
            elif j >= self.first and now == INSERT + self.cost[i, j + 1]:
                audit.append("I")
                j += 1
            else:
                audit.append("K" if self.initials[i] == self.target[j] else "R")
                i, j = i + 1, j + 1
        return "".join(audit), j


def align(initials: list[str], faults: list[str], entry: int = START, ahead: list[int] = FINAL,
          last: bool = True) -> tuple[str, str, int]:
    """(audit, letters of the target, state at the end) of the cheapest edits, by cost, then by audit."""
    low = min(ahead)
    ahead = [min(NEVER, x - low) for x in ahead]
    limit = incumbent(initials, faults, entry, ahead)
    found = []
    for with_s in ([False, True] if entry == START else [False]):
        table = Table(initials, faults, entry, with_s, ahead, limit)
        if table.cost[0, 0] <= limit:
            audit, used = table.trace(last)
            found.append((int(table.cost[0, 0]), audit, "".join(table.target[:used]), int(_ends(entry, table.target)[used])))
    return min(found)[1:]


def between(initials: list[str], faults: list[str]) -> list[int]:
    """Costs from each state before a block to each one after it, row by row."""
    m = len(initials)
    gone = DELETE * m
    kept = [CUT * (f == "t") for x, f in zip(initials, faults) if x == "s" and f not in ("b", "d")]
    out = []
    for entry in range(4):
        row = [gone if entry == START else NEVER, NEVER, NEVER, NEVER]
        row[SYSTEM] = gone if entry == SYSTEM else gone - DELETE + min(kept) if entry == START and kept else NEVER
        for end in (USER, ASSISTANT):
            ahead = [0 if x == end else NEVER for x in range(4)]
            limit = incumbent(initials, faults, entry, ahead)
            row[end] = min(int(Table(initials, faults, entry, s, ahead, limit).cost[0, 0])
                           for s in ([False, True] if entry == START else [False]))
        out += row
    return out


# --- blocks of sorted rows -------------------------------------------------------------------

_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("fault", pa.string())]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _blocks(turns: int):
    """Sorted rows (id, turn, role, text, seen) cut into blocks (block, id, whole, turns, matrix)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        kind, held, size, before, opening = None, [], 0, None, False

        def flush(closing: bool) -> pa.RecordBatch:
            nonlocal number, held, size
            whole = opening and closing
            matrix = None if whole else between([r[:1] for r, _, _ in held], [f for _, _, f in held])
            values = [[number], [before[0]], [whole], [[dict(zip(("role", "text", "fault"), h)) for h in held]], [matrix]]
            types = [pa.int64(), kind, pa.bool_(), _TURNS, pa.list_(pa.int64())]
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)],
                                              ["block", "id", "whole", "turns", "matrix"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, turn, role, text, seen in zip(*(c.to_pylist() for c in batch.columns)):
                row = (key, turn, role, text)
                changed = before is not None and before[0] != key
                if held and (changed or len(held) >= turns or size >= SLICE_BYTES):
                    yield flush(changed)
                    opening = changed
                elif changed:
                    opening = True
                held.append((role, text, fault(text, seen or row == before)))
                size += len(text)
                before = row
        if held:
            yield flush(False)
    return run


def blocks(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           turns: int = TURNS) -> DataFrame:
    """(block, id, whole, turns, matrix): the rows in order, cut where a conversation or a block ends. Blocks of a
    conversation are numbered upwards."""
    small_batches(rows.sparkSession)
    told = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    known = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{turn}`").alias("turn"), told(role).alias("role"), told(text).alias("text"))
    known = known.withColumn("mark", F.unhex(F.sha2(F.concat("role", F.lit("\n"), "text"), 256)))
    # The first turn that says this: rows of a later turn repeat it; equal rows of one turn are neighbours in a block.
    first = known.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(F.min(F.struct("turn"))["turn"].alias("_turn"))
    marked = known.join(first, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select(
        "id", "turn", "role", "text", (~F.col("turn").eqNullSafe(F.col("_turn"))).alias("seen"))
    # Range borders carry the beginning of role and text only; rows that agree so far stay together.
    begin = F.substring(F.concat("role", F.lit("\0"), "text"), 1, 48)
    ordered = marked.repartitionByRange("id", "turn", begin).sortWithinPartitions("id", "turn", "role", "text")
    kind = rows.schema[key].dataType.simpleString()
    out = ordered.mapInArrow(_blocks(turns), f"block bigint, id {kind}, whole boolean, "
                             "turns array<struct<role:string,text:string,fault:string>>, matrix array<bigint>")
    return written(out, "conversation-blocks")


# --- costs and states along the blocks of a conversation -------------------------------------

def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, block, matrix) by id, last block first: adds ``ahead``, the cost from each state at the block's end on."""
    ahead, now, fresh = FINAL, None, True
    for batch in batches:
        ids, matrices, out, last = batch.column("id").to_pylist(), batch.column("matrix").to_pylist(), [], []
        for key, matrix in zip(ids, matrices):
            if fresh or key != now:
                ahead, now = FINAL, key
                last.append(True)
            else:
                last.append(False)
            fresh = False
            out.append(ahead)
            ahead = [min(min(NEVER, matrix[4 * s + e] + ahead[e]) for e in range(4)) for s in range(4)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("block"), pa.array(out, pa.list_(pa.int64())), pa.array(last)],
            ["id", "block", "ahead", "last"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the state at the end of the block for each state at its start."""
    for batch in batches:
        out = []
        for turns, ahead, last in zip(*(batch.column(c).to_pylist() for c in ("turns", "ahead", "last"))):
            initials, faults = [t["role"][:1] for t in turns], [t["fault"] for t in turns]
            out.append([align(initials, faults, s, ahead, last)[2] if min(ahead) < NEVER else s for s in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("block"), pa.array(out, pa.list_(pa.int32()))],
                                         ["id", "block", "exits"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, block, exits) by id and block: the state at the start of each block."""
    state, now, fresh = START, None, True
    for batch in batches:
        out = []
        for key, exits in zip(batch.column("id").to_pylist(), batch.column("exits").to_pylist()):
            if fresh or key != now:
                state, now, fresh = START, key, False
            out.append(state)
            state = exits[state]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("block"), pa.array(out, pa.int32())],
                                         ["id", "block", "entry"])


_PIECE = ("audit string, cost bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "head string, tail string, repaired array<struct<role:string,text:string>>")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their state at the start and the costs from their end on, repaired."""
    out_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1)
            turns, entry, ahead, last = (part.column(c)[0].as_py() for c in ("turns", "entry", "ahead", "last"))
            initials, faults = [t["role"][:1] for t in turns], [t["fault"] for t in turns]
            audit, letters, _ = align(initials, faults, entry, ahead, last)
            at, letter, cost, repaired = iter(turns), iter(letters), 0, []
            for edit in audit:
                t = next(at) if edit != "I" else {"text": "", "fault": ""}
                if edit == "D":
                    cost += DELETE
                    continue
                x = next(letter)
                cost += {"K": 0, "R": REROLE, "I": INSERT}[edit] + CUT * (t["fault"] == "t")
                repaired.append({"role": t["role"] if edit == "K" else _ROLES[x], "text": t["text"]})
            illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
            values = [audit, cost, *(faults.count(f) for f in "bdt"), illegal, initials[0], initials[-1], repaired]
            kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), out_type]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("block"), part.column("whole"), *(pa.array([v], k) for v, k in zip(values, kinds))],
                ["id", "block", "whole", "audit", "cost", "blank", "duplicate", "truncated", "illegal", "head", "tail", "repaired"])


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           turns: int = TURNS) -> DataFrame:
    """Repaired blocks of conversations: (id, block, whole, audit, cost, counts of faults, head, tail, repaired)."""
    cut = blocks(rows, key, turn, role, text, turns)
    kind = cut.schema["id"].dataType.simpleString()
    parts = cut.where("NOT whole")
    here = ["id", "block"]
    ahead = written(parts.select("id", "block", "matrix").repartition("id").sortWithinPartitions("id", F.desc("block")).mapInArrow(
        _backwards, f"id {kind}, block bigint, ahead array<bigint>, last boolean"), "conversation-ahead")
    known = parts.join(ahead.drop("id"), "block")
    exits = known.mapInArrow(_exits, f"id {kind}, block bigint, exits array<int>")
    entries = written(exits.repartition("id").sortWithinPartitions(*here).mapInArrow(
        _entries, f"id {kind}, block bigint, entry int"), "conversation-entries")
    single = cut.where("whole").withColumns({
        "ahead": F.array(*[F.lit(x).cast("bigint") for x in FINAL]), "last": F.lit(True), "entry": F.lit(START)})
    columns = [*here, "whole", "turns", "ahead", "last", "entry"]
    ready = single.select(columns).unionByName(known.join(entries.drop("id"), "block").select(columns))
    return written(ready.mapInArrow(_pieces, f"id {kind}, block bigint, whole boolean, {_PIECE}"), "conversation-pieces")


def repaired_turns(pieces: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, block, at, role, text): the repaired turns, in order of block and place."""
    return pieces.select(F.col("id").alias(key), "block", F.posexplode("repaired").alias("at", "t")).select(
        key, "block", "at", "t.role", "t.text")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["blank", "duplicate", "truncated", "illegal", "cost"]
    kind, now = None, None

    def told(state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([state["id"]], kind), *(pa.array([state[n]], pa.int64()) for n in names),
             pa.array(["".join(state["audit"])]), pa.array([state["sha"].hexdigest()])],
            ["id", *names, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("id").type
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if now is None or r["whole"] or now["id"] != r["id"]:
                if now is not None:
                    yield told(now)
                now = {"id": r["id"], "audit": [], "sha": hashlib.sha256(), "tail": None, "any": False, **dict.fromkeys(names, 0)}
            for n in names:
                now[n] += r[n]
            now["illegal"] += now["tail"] is not None and now["tail"] + r["head"] not in _LEGAL
            now["tail"] = r["tail"]
            now["audit"].append(r["audit"])
            for t in r["repaired"]:
                now["sha"].update((("\n" if now["any"] else "") + f"{t['role']}:{t['text']}").encode())
                now["any"] = True
    if now is not None:
        yield told(now)


def audits(pieces: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation that has rows."""
    kind = pieces.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
              "repaired_sha256 string")
    parts = pieces.where("NOT whole").repartition("id").sortWithinPartitions("id", "block")
    return pieces.where("whole").mapInArrow(_summaries, schema).unionByName(
        parts.mapInArrow(_summaries, schema)).withColumnRenamed("id", key)


# --- damage, gaps and the whole report ----------------------------------------------------------

def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text) after the damage that crc32 of ``key:turn`` modulo 20 names: 0 drops the row, 1 empties its
    text, 2 removes the full stops, exclamation and question marks, 3 repeats the row, 4 makes it the user's."""
    as_text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    code = F.crc32(F.concat(as_text(key), F.lit(":"), as_text(turn))) % 20
    told = rows.select(F.col(f"`{key}`").alias(key), F.col(f"`{turn}`").alias(turn), as_text(role).alias(role),
                       as_text(text).alias(text), code.alias("_code"))
    times = F.when(F.col("_code") == 0, 0).when(F.col("_code") == 3, 2).otherwise(1)
    changed: Column = F.when(F.col("_code") == 1, "").when(
        F.col("_code") == 2, F.regexp_replace(F.col(f"`{text}`"), "[.!?]", "")).otherwise(F.col(f"`{text}`"))
    return told.withColumns({text: changed, role: F.when(F.col("_code") == 4, "user").otherwise(F.col(f"`{role}`"))}).withColumn(
        "_times", F.explode(F.array_repeat(F.lit(1), times))).drop("_code", "_times")


def gaps(rows: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(key, gaps): turns missing between the first and the last of each conversation."""
    seen = rows.groupBy(F.col(f"`{key}`").alias(key), F.col(f"`{turn}`").alias("t")).agg(F.count(F.lit(1)))
    return seen.groupBy(key).agg(F.coalesce(F.max("t") - F.min("t") + 1 - F.count("t"), F.lit(0)).cast("bigint").alias("gaps"))


def report(original: DataFrame, now: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", turns: int = TURNS) -> DataFrame:
    """One row for each key of ``original``: gaps, faults, cost, audit and digest of its rows in ``now``."""
    found = audits(repair(now, key, turn, role, text, turns), "_a").join(
        gaps(now, key, turn).withColumnRenamed(key, "_g"), F.col("_a").eqNullSafe(F.col("_g")))
    keys = original.select(F.col(f"`{key}`").alias(key)).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return keys.join(found, F.col(f"`{key}`").eqNullSafe(F.col("_a")), "left").select(
        key, *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
