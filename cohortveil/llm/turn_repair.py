"""Repair of the structure of conversations.

The turns of a conversation should read as ``s?(ua)+`` by the initials of their roles, or
be none at all.  The cheapest edits that bring them there are found by aligning the turns
to the grammar's strings of every feasible length (Wagner-Fischer): a turn may be kept
(0), given the role user or assistant (2) or deleted (3), and an empty turn of either role
may be inserted (2).  Blank and repeated turns have to be deleted; a truncated turn that
stays costs 1 more.  Of equally cheap repairs the one with the least audit counts, the
audit being the edits' initials in order.

Strings with the same last symbol share their ends, so one matrix from the end of the
turns serves all lengths: its entry (i, r) is the cost of turns i.. against the last r
symbols.  An incumbent, the cost of editing turn by turn, bounds the cells that can be on a
cheapest path (Ukkonen's band), and the audits of all lengths of least cost are traced
back and compared.

Turns are range-partitioned by conversation and turn, and aligned in blocks of at most
``BLOCK`` turns from each state of the grammar to each other.  A conversation inside one
block is finished at once.  The blocks of a longer one, or of one that crosses partitions,
are chained by their costs and the order of their audits; insertions stand before a turn of
their own block or at the very end, so audits of one block never begin with each other and
their order decides.  No task holds more than a block of a conversation's texts.

Edge cases: null roles and texts are one blank.  A blank turn has no byte other than blank,
tab, newline, vertical tab, form feed and carriage return.  Turns are integers in any order,
nulls first; rows of one turn follow each other by role, then text.  Repeated rows are
repeated turns.  Null conversation ids are one conversation.  No turns, no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Costs of the edits and of keeping a truncated turn.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns, and characters of text, of a block.
BLOCK, BLOCK_CHARS = 512, 8_000_000
#: States of the grammar: nothing yet, after s, before u, before a.
START, SYSTEM, BEFORE_USER, BEFORE_ASSISTANT = range(4)
#: What brings a state to an end of the grammar.
ENDINGS = {START: "", SYSTEM: "II", BEFORE_USER: "", BEFORE_ASSISTANT: "I"}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
_FAR = 1 << 28


def _symbol(end: str, left: int) -> str:
    """Symbol of an alternating string when ``left`` symbols remain, the last one being ``end``."""
    return end if left % 2 else ("u" if end == "a" else "a")


class Alignment:
    """All alignments of one block of turns: initials of roles, turns to delete, and turns that are truncated."""

    def __init__(self, initials: list[str], doomed: list[bool], cut_off: list[bool]):
        self.initials, self.doomed, self.cut_off = initials, doomed, cut_off
        n = len(initials)
        self.bound = self._incumbent()
        self.width = n + self.bound // INSERT
        self.cost = {end: self._matrix(end) for end in "ua"}

    def _incumbent(self) -> int:
        """A cost that no pair of states on a cheapest path exceeds: turns edited one by one, and a symbol or two more."""
        worst = 0
        for want in "ua":
            total = 0
            for letter, doomed, cut_off in zip(self.initials, self.doomed, self.cut_off):
                if doomed:
                    total += DELETE
                else:
                    total += (letter != want) * REROLE + cut_off * TRUNCATED
                    want = "a" if want == "u" else "u"
            worst = max(worst, total)
        return worst + 2 * INSERT

    def _matrix(self, end: str) -> np.ndarray:
        """Costs of turns i.. against the last r symbols, inside the band of the incumbent."""
        n, width = len(self.initials), self.width
        cost = np.full((n + 1, width + 1), _FAR, np.int64)
        cost[n, 0] = 0
        ramp = np.arange(width + 1) * INSERT
        odd = np.arange(width + 1) % 2 == 1
        fits = {letter: odd if letter == end else ~odd for letter in "ua"}
        for i in range(n - 1, -1, -1):
            left = n - i
            low, high = max(0, left - self.bound // DELETE), min(width, left + self.bound // INSERT) + 1
            row = cost[i + 1, low:high] + DELETE
            if not self.doomed[i]:
                letter = self.initials[i]
                step = np.where(fits[letter][low:high], 0, REROLE) if letter in fits else REROLE
                before = np.full(high - low, _FAR, np.int64)
                first = max(low, 1)
                before[first - low:] = cost[i + 1, first - 1:high - 1]
                row = np.minimum(row, before + step + self.cut_off[i] * TRUNCATED)
            row = np.minimum.accumulate(row - ramp[low:high]) + ramp[low:high]
            cost[i, low:high] = np.minimum(row, _FAR)
        return cost

    def trace(self, i: int, left: int, end: str) -> str:
        """Least audit of the cheapest edits from turn i against the last ``left`` symbols."""
        cost, out = self.cost[end], []
        n = len(self.initials)
        while i < n:
            now = cost[i, left]
            if now == cost[i + 1, left] + DELETE:
                out.append("D")
                i += 1
            elif left and now == cost[i, left - 1] + INSERT:
                out.append("I")
                left -= 1
            else:
                out.append("K" if self.initials[i] == _symbol(end, left) else "R")
                i += 1
                left -= 1
        return "".join(out)

    def _from(self, state: int, i: int) -> Iterator[tuple[int, int, int, str]]:
        """(state after, cost, symbols, last symbol) for turns i.. against strings of every feasible length."""
        first = "a" if state == BEFORE_ASSISTANT else "u"
        for end, after in (("a", BEFORE_USER), ("u", BEFORE_ASSISTANT)):
            at = self.cost[end][i]
            for left in np.flatnonzero(at <= self.bound).tolist():
                if left == 0 and end == "a":
                    yield state, int(at[0]), 0, end
                elif left and _symbol(end, left) == first:
                    yield after, int(at[left]), left, end

    def ways(self, states) -> list[tuple[int, int, int, str]]:
        """(state before, state after, cost, audit): the best edits of the block for every pair of states."""
        best: dict[tuple[int, int], tuple[int, list]] = {}
        for state in states:
            options = [(after, cost, "", 0, left, end) for after, cost, left, end in self._from(state, 0)]
            if state == START:
                for k, letter in enumerate(self.initials):
                    if letter == "s" and not self.doomed[k]:
                        # s comes first: turns before it are deleted
                        head = k * DELETE + self.cut_off[k] * TRUNCATED
                        options += [(after, head + cost, "D" * k + "K", k + 1, left, end)
                                    for after, cost, left, end in self._from(SYSTEM, k + 1) if head + cost <= self.bound]
            for after, cost, *way in options:
                known = best.get((state, after))
                if known is None or cost < known[0]:
                    best[state, after] = (cost, [way])
                elif cost == known[0]:
                    known[1].append(way)
        return [(before, after, cost, min(head + self.trace(i, left, end) for head, i, left, end in found))
                for (before, after), (cost, found) in sorted(best.items())]


def chain(blocks: list[list[tuple[int, int, int, object]]]) -> tuple[int, list[tuple[int, int]]]:
    """Cost of the cheapest edits over consecutive blocks, and the (state, way) taken in each.

    A way is (state before, state after, cost, audit or its rank in the block).
    """
    rest = [{state: len(text) * INSERT for state, text in ENDINGS.items()}]
    for ways in reversed(blocks):
        here: dict[int, int] = {}
        for before, after, cost, _ in ways:
            if after in rest[-1]:
                here[before] = min(here.get(before, _FAR), cost + rest[-1][after])
        rest.append(here)
    rest.reverse()
    state, taken = START, []
    for k, ways in enumerate(blocks):
        way = min((w for w in range(len(ways)) if ways[w][0] == state and ways[w][1] in rest[k + 1]
                   and ways[w][2] + rest[k + 1][ways[w][1]] == rest[k][state]), key=lambda w: ways[w][3])
        taken.append((state, way))
        state = ways[way][1]
    return rest[0][START], [*taken, (state, -1)]


def render(audit: str, state: int, turns: list[tuple[str, str]]) -> list[dict]:
    """Repaired turns of a block."""
    out, at = [], 0
    for letter in audit:
        want = "a" if state == BEFORE_ASSISTANT else "u"
        if letter != "I":
            role, text = turns[at]
            at += 1
            if letter == "D":
                continue
            if letter == "K" and state == START and role[:1] == "s":
                want = "s"
            elif letter == "R":
                role = ROLES[want]
        else:
            role, text = ROLES[want], ""
        out.append({"role": role, "text": text})
        state = {"s": SYSTEM, "u": BEFORE_ASSISTANT, "a": BEFORE_USER}[want]
    return out


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_WAYS = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())]))
_COUNTS = ("n", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal")
_BLOCK_SQL = ("segment int, block int, whole boolean, " + ", ".join(f"{c} bigint" for c in _COUNTS)
              + ", first string, last string, cost bigint, audit string,"
              " ways array<struct<before: int, after: int, cost: bigint, rank: int>>, audits array<string>,"
              " held array<struct<role: string, text: string>>")


def _counts(rows: list[tuple]) -> dict:
    """Counts of a block's rows (turn, role, text, fault)."""
    numbers = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    faults = [r[3] for r in rows]
    return {"n": len(rows), "low": min(numbers, default=None), "high": max(numbers, default=None), "turns": len(set(numbers)),
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "first": initials[0], "last": initials[-1]}


def _align(rows: list[tuple], states) -> list[tuple[int, int, int, str]]:
    return Alignment([r[1][:1] for r in rows], [r[3] in ("blank", "duplicate") for r in rows],
                     [r[3] == "truncated" for r in rows]).ways(states)


def _block(rows: list[tuple], whole: bool) -> dict:
    out = {"whole": whole, **_counts(rows)}
    turns = [(r[1], r[2]) for r in rows]
    if whole:
        ways = _align(rows, (START,))
        cost, taken = chain([ways])
        audit = ways[taken[0][1]][3] + ENDINGS[taken[1][0]]
        return {**out, "cost": cost, "audit": audit, "ways": None, "audits": None, "held": render(audit, START, turns)}
    ways = _align(rows, range(4))
    order = {a: k for k, a in enumerate(sorted({w[3] for w in ways}))}
    return {**out, "cost": None, "audit": None, "audits": [w[3] for w in ways],
            "ways": [{"before": w[0], "after": w[1], "cost": w[2], "rank": order[w[3]]} for w in ways],
            "held": [{"role": role, "text": text} for role, text in turns]}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted rows of one partition; whole where a conversation surely ends inside it."""
    kind, segment, number, out, ids = None, TaskContext.get().partitionId(), 0, [], []
    rows: list[tuple] = []
    at, size, inner, mark = None, 0, False, None

    def close(whole: bool):
        nonlocal number, size
        ids.append(at)
        out.append({"segment": segment, "block": number, **_block(rows, whole)})
        number += 1
        size = 0
        rows.clear()

    def flush() -> pa.RecordBatch:
        fields = [pa.field("conv", kind), pa.field("segment", pa.int32()), pa.field("block", pa.int32()), pa.field("whole", pa.bool_()),
                  *(pa.field(c, pa.int64()) for c in _COUNTS), pa.field("first", pa.string()), pa.field("last", pa.string()),
                  pa.field("cost", pa.int64()), pa.field("audit", pa.string()), pa.field("ways", _WAYS),
                  pa.field("audits", pa.list_(pa.string())), pa.field("held", _TURNS)]
        columns = [pa.array(ids, kind), *(pa.array([o[f.name] for o in out], f.type) for f in fields[1:])]
        ids.clear()
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    begun = False
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, turn, role, text, fault, own in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and conv != at:
                close(inner)
                inner = True
            elif rows and (len(rows) >= BLOCK or size + len(text) > BLOCK_CHARS):
                close(False)
                inner = False
            if fault != "blank" and begun and conv == at and own == mark:
                fault = "duplicate"  # rows of one turn with one text are next to each other
            begun, at, mark = True, conv, own
            rows.append((turn, role, text, fault))
            size += len(text)
        if len(out) >= 1000:
            yield flush()
    if rows:
        close(False)
    if out:
        yield flush()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals and chosen ways of conversations of several blocks, or at the edge of a partition."""
    for batch in batches:
        kind = batch.schema.field(0).type
        ids, totals, places = [], [], []
        for conv, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cost, taken = chain([[(w["before"], w["after"], w["cost"], w["rank"]) for w in b["ways"]] for b in blocks])
            total = {k: sum(b[k] for b in blocks) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
            for one, two in zip(blocks, blocks[1:]):
                total["illegal"] += one["last"] + two["first"] not in LEGAL
                total["turns"] -= one["high"] is not None and one["high"] == two["low"]
            low = min((b["low"] for b in blocks if b["low"] is not None), default=None)
            high = max((b["high"] for b in blocks if b["high"] is not None), default=None)
            ids.append(conv)
            totals.append({**total, "low": low, "high": high, "cost": cost})
            places.append([{"segment": b["segment"], "block": b["block"], "state": state, "way": way,
                            "ending": ENDINGS[taken[-1][0]] if k == len(blocks) - 1 else "", "alone": len(blocks) == 1}
                           for k, (b, (state, way)) in enumerate(zip(blocks, taken))])
        names = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost")
        place = pa.struct([("segment", pa.int32()), ("block", pa.int32()), ("state", pa.int32()), ("way", pa.int32()),
                           ("ending", pa.string()), ("alone", pa.bool_())])
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array([t[c] for t in totals], pa.int64()) for c in names),
                                          pa.array(places, pa.list_(place))], names=["conv", *names, "places"])


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        audits, states, held = (batch.column(k).to_pylist() for k in (4, 5, 6))
        repaired = [render(a, s, [(t["role"], t["text"]) for t in h]) for a, s, h in zip(audits, states, held)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(repaired, _TURNS)],
                                         names=["conv", "segment", "block", "alone", "audit", "repaired"])


_PIECE_SQL = "segment int, block int, alone boolean, audit string, repaired array<struct<role: string, text: string>>"


def faults(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, fault, mark): blank, duplicate (of an earlier turn), truncated or null.

    ``mark`` names (conversation, role, text).  Only the earliest turn of each mark that
    occurs again is joined back.
    """
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
                        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"))
    rows = rows.withColumn("mark", F.md5(F.to_json(F.struct("conv", "role", "text")).cast("binary")))
    key = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    firsts = rows.groupBy("mark").agg(F.min(key).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    text = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = (F.when(text == "", "blank").when(F.col("earliest") < key, "duplicate")
             .when(~F.right(text, F.lit(1)).isin(".", "!", "?"), "truncated"))
    return rows.join(firsts, "mark", "left").select("conv", "turn", "role", "text", fault.alias("fault"), "mark")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(summaries, pieces) of the conversations.

    Summaries: conversation, gaps in its turn numbers, blank, duplicate and truncated turns,
    illegal pairs of neighbours, cost.  Pieces: conversation, segment and block (in this
    order), alone (whether it is the only one), the audit and the repaired turns of the piece.
    """
    kind = turns.schema[conv_col].dataType
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "role", F.left("text", F.lit(64)), "mark"]
    rows = faults(turns, conv_col, turn_col, role_col, text_col).repartitionByRange(n, *order).sortWithinPartitions(*order)
    block = T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL(_BLOCK_SQL).fields])
    blocks = cut(rows.mapInArrow(_blocks, block))
    whole, open_ = blocks.where("whole"), blocks.where("not whole")
    shown = ["segment", "block", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last", "ways"]
    listed = open_.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*shown))).alias("blocks"))
    names = ["low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost"]
    total = T.StructType([T.StructField("conv", kind), *(T.StructField(c, T.LongType()) for c in names), *T.StructType.fromDDL(
        "places array<struct<segment: int, block: int, state: int, way: int, ending: string, alone: boolean>>").fields])
    chained = cut(listed.mapInArrow(_chained, total))
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    summaries = whole.select("conv", *names).union(chained.select("conv", *names)).select(
        F.col("conv").alias(conv_col), gaps.cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost")
    taken = chained.select(F.explode("places").alias("p")).select("p.*")
    piece = T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL(_PIECE_SQL).fields])
    later = open_.join(taken, ["segment", "block"]).select(
        "conv", "segment", "block", "alone", F.concat(F.get("audits", F.col("way")), F.col("ending")).alias("audit"), "state", "held")
    pieces = whole.select("conv", "segment", "block", F.lit(True).alias("alone"), "audit", F.col("held").alias("repaired")).union(
        later.mapInArrow(_rendered, piece)).withColumnRenamed("conv", conv_col)
    return summaries, pieces


def digests(pieces: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conversation, audit, repaired_sha256): the whole audit, and the digest of the repaired ``role:text`` lines.

    The pieces of a long conversation pass through one task in their order, a digest being
    sequential, and are held one at a time.
    """
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    one = pieces.where("alone").select(conv_col, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    many = pieces.where("not alone").select(conv_col, "segment", "block", "audit", F.size("repaired").alias("n"), lines.alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, begun, at, audit, digest, lined = None, False, None, [], None, False
        done: list[tuple] = []

        def flush():
            ids, audits, hashes = zip(*done)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(audits, pa.string()), pa.array(hashes, pa.string())],
                                              names=[conv_col, "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, _, _, part, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or conv != at:
                    if begun:
                        done.append((at, "".join(audit), digest.hexdigest()))
                    begun, at, audit, digest, lined = True, conv, [], hashlib.sha256(), False
                audit.append(part)
                if n:
                    digest.update((b"\n" if lined else b"") + text.encode())
                    lined = True
            if done:
                yield flush()
        if begun:
            done.append((at, "".join(audit), digest.hexdigest()))
            yield flush()

    kind = pieces.schema[conv_col].dataType
    schema = T.StructType([T.StructField(conv_col, kind), T.StructField("audit", T.StringType()),
                           T.StructField("repaired_sha256", T.StringType())])
    return one.union(many.repartition(conv_col).sortWithinPartitions(conv_col, "segment", "block").mapInArrow(run, schema))
