"""Conversation structure repair: cheapest edits on an automaton of role and fault signatures that share their ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from driftgrid.llm.common import stored

WHITE = " \t\n\x0b\x0c\r"
BLOCK_BITS = 12                                      # rows of one conversation that one signature covers: 4,096 at most

# Grammar (s?(ua)+)?: what may come next, and where a user or assistant turn leads from each state.
START, S, U, A = range(4)
KEEP = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
NEXT = (U, U, A, U)                                  # the one state that a rerole or an insertion reaches
ROLE = {U: "user", A: "assistant"}
DELETE_COST, CHANGE_COST = 3, 2
NEVER = 1 << 40
END = (0, 4, 2, 0)                                   # insertions still needed when the rows are over
CLOSE = ("", "II", "I", "")


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text after keyed damage: crc32 of `conv:turn` modulo 20 drops a row (0), empties it (1),
    removes its sentence ends (2), repeats it (3) or makes it the user's (4). Nulls are written as one space; turn stays null."""
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    d = F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), d.alias("d")).filter("d <> 0")
    return rows.select("conv", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def ordered_faults(rows: DataFrame) -> DataFrame:
    """Every row in order with its first fault: conv, turn, role, text, fault (blank, duplicate, truncated, none), pos.

    pos rises with (conv, turn, role, hash of the text) over the whole table, nulls first. Distinct (conv, role, text) are one group of
    a combined aggregate, whose earliest turn holds the row that isn't a duplicate; all others are counted apart, without their
    texts, which no repair keeps. Nothing is gathered by conversation: range partitions split a conversation of any length.
    """
    empty = F.translate("text", WHITE, "") == ""
    first = (rows.groupBy("conv", "role", "text").agg(F.min("turn").alias("turn"), F.max(F.col("turn").isNull()).alias("none"))
             .select("conv", F.when(~F.col("none"), F.col("turn")).alias("turn"), "role", "text"))
    ends = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1)).isin(".", "!", "?")
    fault = F.when(empty, "blank").when(~ends, "truncated").otherwise("none")
    mark = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    kept = first.select("conv", "turn", "role", mark.alias("mark"), F.lit(0).cast("long").alias("copy"), fault.alias("fault"), F.when(~empty, F.col("text")).alias("text"))
    light = rows.select("conv", "turn", "role", mark.alias("mark"), empty.alias("blank"), F.lit(1).alias("n"))
    minus = first.select("conv", "turn", "role", mark.alias("mark"), empty.alias("blank"), F.lit(-1).alias("n"))
    again = (light.unionByName(minus).groupBy("conv", "turn", "role", "mark", "blank").agg(F.sum("n").alias("n")).filter("n > 0")
             .select("conv", "turn", "role", "mark", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"),
                     F.when(F.col("blank"), "blank").otherwise("duplicate").alias("fault"), F.lit(None).cast("string").alias("text")))
    order = ["conv", "turn", "role", "mark", "copy"]
    return (kept.unionByName(again).repartitionByRange(*order).sortWithinPartitions(*order)
            .select("conv", "turn", "role", "text", "fault", F.monotonically_increasing_id().alias("pos")))


@cache
def step(symbol: str, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], int, tuple[tuple[str, int], ...]]:
    """One row in front of a rest with costs `ahead` (least 0): costs now (least 0), what was taken off, and (letters, state after) per state.

    Costs to go differ little between states, so few vectors exist and each (symbol, vector) is worked out once.
    """
    late, role = int(symbol.isupper()), symbol.lower()
    best = []
    for g in range(4):
        ways = [(DELETE_COST + ahead[g], "D", g)]
        if symbol != "x":
            if g in KEEP.get(role, {}):
                ways.append((late + ahead[KEEP[role][g]], "K", KEEP[role][g]))
            ways.append((CHANGE_COST + late + ahead[NEXT[g]], "R", NEXT[g]))
        best.append(min(ways))                       # equal costs: the smaller letter comes first
    for _ in range(4):                               # an insertion leads to another state in front of the same row
        best = [min(best[g], (CHANGE_COST + best[NEXT[g]][0], "I" + best[NEXT[g]][1], best[NEXT[g]][2])) for g in range(4)]
    off = min(b[0] for b in best)
    return tuple(min(b[0] - off, NEVER) for b in best), off, tuple((b[1], b[2]) for b in best)


def _solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Costs, states at the end and edits from each of the four states, for signatures sorted by their reversed text.

    Signatures are read from their ends, where sorted neighbours agree: the path that is held is the part of the
    automaton they share, and each of its nodes is made once. A node keeps a link per state (letters, state after), so the best edits
    of a suffix are stored once and read off along the path.
    """
    ahead, before, path = None, "", []
    for f in frames:
        out = []
        for reverse, end in zip(f["reverse"], f["ahead"], strict=True):
            same = 0
            if end == ahead:
                most = min(len(before), len(reverse))
                while same < most and before[same] == reverse[same]:
                    same += 1
            else:
                path = [(tuple(map(int, end.split(","))), 0, None)]
            del path[same + 1:]
            for symbol in reverse[same:]:
                costs, total, _ = path[-1]
                costs, off, links = step(symbol, costs)
                path.append((costs, total + off, links))
            before, ahead = reverse, end
            costs, total, _ = path[-1]
            edits, exits = [], []
            for g in range(4):
                letters = []
                for _, _, links in path[:0:-1]:
                    taken, g = links[g]
                    letters.append(taken)
                edits.append("".join(letters))
                exits.append(g)
            out.append((reverse, end, [min(c + total, NEVER) for c in costs], exits, edits))
        yield pd.DataFrame(out, columns=["reverse", "ahead", "costs", "exits", "edits"])


def solved(signatures: DataFrame) -> DataFrame:
    """(reverse, ahead) with costs, exits, edits by entry state: each distinct signature once over all conversations."""
    each = signatures.distinct().repartitionByRange("ahead", "reverse").sortWithinPartitions("ahead", "reverse")
    return each.mapInPandas(_solve, "reverse string, ahead string, costs array<long>, exits array<int>, edits array<string>")


def _told(v) -> str:
    low = min(v)
    return ",".join(str(min(x - low, NEVER)) for x in v)


def _aheads(f: pd.DataFrame) -> pd.DataFrame:
    """Costs to go at the end of each block of one conversation, from the last block to the first."""
    f = f.sort_values("at", ascending=False)
    v, out = list(END), []
    for at, m in zip(f["at"], f["matrix"], strict=True):
        out.append((at, _told(v)))
        v = [min(m[4 * j + g] + v[j] for j in range(4)) for g in range(4)]
        v = [x - min(v) for x in v]
    return pd.DataFrame(out, columns=["at", "ahead"])


def _entries(f: pd.DataFrame) -> pd.DataFrame:
    """The edits of each block of one conversation, given the state in which the block before it ended."""
    f, g, out = f.sort_values("at"), START, []
    for at, exits, edits in zip(f["at"], f["exits"], f["edits"], strict=True):
        out.append((at, edits[g]))
        g = int(exits[g])
    out[-1] = (out[-1][0], out[-1][1] + CLOSE[g])
    return pd.DataFrame(out, columns=["at", "edits"])


def cheapest_edits(rows: DataFrame) -> DataFrame:
    """conv, at, edits: letters of the cheapest repair for the rows of conv from pos `at` up to the next `at`.

    A block is what one conversation has of 4,096 places in a row; nearly all conversations lie in one. Those of several blocks need
    the costs to go at the end of each: blocks are solved for each of four ends, which gives a 4 x 4 matrix of costs, and the matrices of one
    conversation are multiplied from its end (16 numbers for 4,096 rows). Then blocks are solved with their true ends.
    """
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    block = F.shiftright("pos", BLOCK_BITS)
    blocks = (rows.groupBy("conv", block.alias("block")).agg(F.min("pos").alias("at"), F.array_sort(F.collect_list(F.struct("pos", symbol.alias("c")))).alias("rows"))
              .select("conv", "at", F.reverse(F.array_join(F.col("rows.c"), "")).alias("reverse")))
    spans = blocks.groupBy("conv").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    blocks = stored(blocks.join(spans.withColumnRenamed("conv", "whose"), F.col("conv").eqNullSafe(F.col("whose"))).drop("whose"), "repair-blocks")
    end = F.lit(_told(END))
    single = blocks.filter("first = last").withColumn("ahead", end)
    done = single.join(solved(single.select("reverse", "ahead")).drop("ahead"), "reverse")
    done = done.select("conv", "at", F.concat(F.col("edits")[0], F.element_at(F.array(*map(F.lit, CLOSE)), F.col("exits")[0] + 1)).alias("edits"))

    several = blocks.filter("first <> last")
    units = F.array(*[F.lit(_told([0 if g == j else NEVER for g in range(4)])) for j in range(4)])
    parts = several.select("first", "at", "reverse", F.posexplode(units).alias("j", "ahead"))
    parts = parts.join(solved(parts.select("reverse", "ahead")).select("reverse", "ahead", "costs"), ["reverse", "ahead"])
    matrices = parts.groupBy("first", "at").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("j", "costs"))), lambda x: x["costs"])).alias("matrix"))
    aheads = matrices.groupBy("first").applyInPandas(_aheads, "at long, ahead string")
    known = stored(several.join(aheads, "at"), "repair-ends")
    played = known.join(solved(known.select("reverse", "ahead")).select("reverse", "ahead", "exits", "edits"), ["reverse", "ahead"])
    pieces = played.groupBy("first").applyInPandas(_entries, "at long, edits string")
    return done.unionByName(several.join(pieces, "at").select("conv", "at", "edits"))


class Repair:
    """Plays the rows and edits of one conversation in order; holds counts, the edits and a running hash, never the texts."""

    def __init__(self, conv):
        self.conv, self.state, self.audit, self.edits, self.lines = conv, START, [], iter(""), 0
        self.turns, self.low, self.high, self.turn = 0, None, None, None
        self.faults, self.illegal, self.cost, self.before = {"blank": 0, "duplicate": 0, "truncated": 0, "none": 0}, 0, 0, None
        self.hash = hashlib.sha256()

    def say(self, role: str, text: str) -> tuple[int, str, str]:
        self.hash.update(("\n" * (self.lines > 0) + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1
        return self.lines - 1, role, text

    def insert(self) -> tuple[int, str, str]:
        self.state, self.cost = NEXT[self.state], self.cost + CHANGE_COST
        return self.say(ROLE[self.state], "")

    def take(self, edits: str) -> None:
        self.audit.append(edits)
        self.edits = iter(edits)

    def row(self, turn, role: str, text: str | None, fault: str) -> Iterator[tuple[int, str, str, str]]:
        """The lines that this row leads to: insertions before it, then itself if it stays."""
        if turn is not None and turn != self.turn:
            self.turns, self.low, self.high, self.turn = self.turns + 1, turn if self.low is None else self.low, turn, turn
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        letter = next(self.edits)
        while letter == "I":
            yield (*self.insert(), "insert")
            letter = next(self.edits)
        if letter == "D":
            self.cost += DELETE_COST
            return
        self.cost += fault == "truncated"
        if letter == "R":
            self.cost, self.state = self.cost + CHANGE_COST, NEXT[self.state]
            role = ROLE[self.state]
        else:
            self.state = KEEP[role[0]][self.state]
        yield (*self.say(role, text), "rerole" if letter == "R" else "keep")

    def end(self) -> Iterator[tuple[int, str, str, str]]:
        for _ in self.edits:
            yield (*self.insert(), "insert")

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "place long, role string, text string, edit string"


def _play(names: list[str], kinds, turns: bool):
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def give() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types, strict=True)], schema=schema)

        def over() -> None:
            lines = list(now.end())
            out.extend((now.conv, *line) for line in lines if turns)
            if not turns:
                out.append(now.summary())

        for batch in batches:
            for conv, pos, edits, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "pos", "edits", "turn", "role", "text", "fault")), strict=True):
                if pos < 0:
                    if now is not None:
                        over()
                    now = Repair(conv)
                elif fault is None:
                    now.take(edits)
                else:
                    for line in now.row(turn, role, text, fault):
                        if turns:
                            out.append((conv, *line))
            if len(out):
                yield give()
        if now is not None:
            over()
            yield give()
    return run


def repair(rows: DataFrame, ids: DataFrame, turns: bool = False) -> DataFrame:
    """The cheapest repair of every conversation of rows (conv, turn, role, text; role and text not null) and of ids (conv).

    One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; with turns=True the
    repaired turns instead (conv, place, role, text, edit). Faults, signatures and edits are worked out in blocks of rows, whatever conversation they
    belong to. Only the last step takes a conversation's rows in order, because its digest is one chain of bytes: they stream
    through a task that holds counts and the audit, not the rows.

    Rows of one turn are taken by role, then by hash of the text; null turns come first. Null and repeated conv form conversations
    like others, one row each. Repeated rows are duplicates. A conversation without rows has zeros, no audit and the hash of nothing. Long texts are hashed
    row by row. An empty table gives no rows.
    """
    rows = stored(ordered_faults(rows), "repair-rows")
    none = {"edits": "string", "turn": rows.schema["turn"].dataType, "role": "string", "text": "string", "fault": "string"}

    def record(df: DataFrame, pos: Column) -> DataFrame:
        have = [F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in none.items()]
        return df.select("conv", pos.cast("long").alias("pos"), *have)

    heads = record(ids.select("conv").distinct(), F.lit(-1))
    edits = stored(cheapest_edits(rows), "repair-edits")
    all_ = heads.unionByName(record(edits, F.col("at"))).unionByName(record(rows, F.col("pos")))
    all_ = all_.repartition("conv").sortWithinPartitions("conv", "pos", F.col("fault").isNotNull())
    name = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {name}, {TURNS if turns else SUMMARY}"
    fields = [f.split() for f in schema.split(", ")]
    kinds = [to_arrow_type(rows.schema["conv"].dataType), *(pa.int64() if k == "long" else pa.string() for _, k in fields[1:])]
    return all_.mapInArrow(_play([n for n, _ in fields], kinds, turns), schema)
