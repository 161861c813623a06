"""Repair of conversation structure by cheapest edits, ties to the least edit string.

A conversation's rows become `s?(ua)+` or nothing: an optional system turn, then user and assistant in turns. Edits are
arcs of a graph whose nodes are (place in the conversation, state of that pattern). Minimum costs forward from the start
and backward from the end tell which arcs are tight, that is on a cheapest path; a traversal that keeps the set of nodes
reached so far picks the least letter among the tight arcs at each step.

Conversations are not gathered. All rows are sorted by range and cut into slices of SLICE places. What lies inside a slice is
solved there. A conversation that crosses slices gives a 4 x 4 matrix of least costs from state to state for each slice;
their products give every slice its costs forward and backward, it is then traversed from each state, and the traversals are
chained. A text is only sent with its own row; only the hash over a whole repaired conversation reads it in one
task, as a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import materialize, small_batches

#: Places of a slice, as a power of two.
SLICE_BITS = 12
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the pattern: nothing yet, after the system turn, after a user's, after an assistant's. It may end in START and BOT.
START, SYSTEM, USER, BOT = range(4)
STATES = range(4)
FAR = 1 << 40
#: The state that a turn of a user or an assistant leads to.
NEXT = {START: USER, SYSTEM: USER, USER: BOT, BOT: USER}
#: Codes of an edit: K and D; U and A set the role to user or assistant; u and a insert such a turn. LETTER gives the audit's letter.
LETTER = {"D": "D", "u": "I", "a": "I", "K": "K", "U": "R", "A": "R"}
#: What a blank text consists of.
BLANKS = " \t\n\x0b\f\r"
#: Faults of a row.
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: Costs and inserted turns from each state to the end, after the last row.
END_COST = [0, 2 * INSERT, INSERT, 0]
END_CODES = ["", "ua", "a", ""]


@lru_cache
def arcs(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """For each state the arcs (code, next state, cost) over one row."""
    out: list[list[tuple[str, int, int]]] = [[("D", q, DELETE)] for q in STATES]
    if fault in (BLANK, DUPLICATE):
        return out
    more = TRUNCATED if fault == CUT else 0
    for q in STATES:
        if initial == "s" and q == START:
            out[q].append(("K", SYSTEM, KEEP + more))
        if initial == ("a" if q == USER else "u"):
            out[q].append(("K", NEXT[q], KEEP + more))
        out[q].append(("A" if q == USER else "U", NEXT[q], REROLE + more))
    return out


def _inserted(costs: list[int]) -> list[int]:
    """Costs to the end from before the inserts at a place, given those from behind them."""
    for _ in range(2):
        costs = [min(costs[q], INSERT + costs[NEXT[q]]) for q in STATES]
    return costs


def backward(rows: list[tuple[str, int]], end: list[int]) -> list[list[int]]:
    """Least cost from every node to the end: one list of states for each place."""
    out = [end]
    for initial, fault in reversed(rows):
        after, each = out[-1], arcs(initial, fault)
        out.append(_inserted([min([c + after[to] for _, to, c in each[q]]) for q in STATES]))
    return out[::-1]


def forward(rows: list[tuple[str, int]], begin: list[int]) -> list[list[int]]:
    """Least cost from the start to every node, inserts at its place included (but not after the last row)."""
    out, now = [], begin
    for initial, fault in rows:
        now = list(now)
        for _ in range(2):
            for q in STATES:
                now[NEXT[q]] = min(now[NEXT[q]], now[q] + INSERT)
        out.append(now)
        each, then = arcs(initial, fault), [FAR] * 4
        for q in STATES:
            for _, to, c in each[q]:
                then[to] = min(then[to], now[q] + c)
        now = then
    return [*out, now]


def matrix(rows: list[tuple[str, int]]) -> list[int]:
    """Least costs over the rows from each state to each state, row by row of the matrix."""
    return [c for q in STATES for c in forward(rows, [0 if q == p else FAR for p in STATES])[-1]]


def traverse(rows: list[tuple[str, int]], state: int, ahead: list[list[int]], back: list[list[int]]) -> tuple[list[str], int]:
    """(codes of each row, state behind the last): the least letters along tight arcs from a state on a cheapest path."""
    least, frontier, codes = ahead[0][state] + back[0][state], {state}, []
    for at, (initial, fault) in enumerate(rows):
        code, each = "", arcs(initial, fault)
        while True:
            tight = [(LETTER[x], x, to, False) for q in frontier for x, to, c in each[q] if ahead[at][q] + c + back[at + 1][to] == least]
            tight += [("I", "a" if q == USER else "u", NEXT[q], True) for q in frontier if ahead[at][q] + INSERT + back[at][NEXT[q]] == least]
            letter = min(t[0] for t in tight)
            code += next(x for found, x, _, _ in tight if found == letter)
            frontier = {to for found, _, to, _ in tight if found == letter}
            if letter != "I":
                break
        codes.append(code)
    return codes, min(frontier)


def cheapest(rows: list[tuple[str, int]]) -> list[str]:
    """Codes of each row of a whole conversation, turns inserted at its end with the last row."""
    codes, state = traverse(rows, START, forward(rows, [0, FAR, FAR, FAR]), backward(rows, END_COST))
    codes[-1] += END_CODES[state]
    return codes


def _runs(keys: list[str]) -> list[tuple[int, int]]:
    """First and last but one place of each conversation of rows in order."""
    starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
    return list(zip(starts, starts[1:]))


def _slice(f: pd.DataFrame) -> pd.DataFrame:
    """Codes of the conversations inside a slice; a matrix for those that touch its edges."""
    f = f.sort_values("pos", ignore_index=True)
    rows, pos, keys, place = list(zip(f["initial"].tolist(), f["fault"].tolist())), f["pos"].tolist(), f["key"].tolist(), int(f["slice"].iloc[0])
    out = []
    for a, b in _runs(keys):
        inner = a > 0 and b < len(keys)
        out.append((keys[a], place, pos[a:b] if inner else None, cheapest(rows[a:b]) if inner else None, None if inner else matrix(rows[a:b])))
    return pd.DataFrame(out, columns=["key", "slice", "pos", "codes", "matrix"])


def _costs(f: pd.DataFrame) -> pd.DataFrame:
    """For each slice of a conversation the costs from the start to its first place and from behind its last to the end."""
    f = f.sort_values("slice", ignore_index=True)
    cells, n = [list(m) for m in f["matrix"]], len(f)
    ahead, back = [[0, FAR, FAR, FAR]], [END_COST]
    for m in cells[:-1]:
        ahead.append([min(ahead[-1][p] + m[4 * p + q] for p in STATES) for q in STATES])
    for m in reversed(cells[1:]):
        back.append([min(m[4 * q + p] + back[-1][p] for p in STATES) for q in STATES])
    return f.drop(columns="matrix").assign(ahead=ahead, back=back[::-1], last=[i == n - 1 for i in range(n)])


def _traversals(f: pd.DataFrame, costs: pd.DataFrame) -> pd.DataFrame:
    """A slice's part of a conversation that crosses slices, traversed from each state on a cheapest path."""
    out = []
    if len(f) and len(costs):
        f = f.sort_values("pos", ignore_index=True)
        known = {k: (list(a), list(b), z) for k, a, b, z in zip(costs["key"], costs["ahead"], costs["back"], costs["last"])}
        rows, pos, keys, place = list(zip(f["initial"].tolist(), f["fault"].tolist())), f["pos"].tolist(), f["key"].tolist(), int(f["slice"].iloc[0])
        for a, b in _runs(keys):
            if keys[a] not in known:
                continue
            begin, end, last = known[keys[a]]
            ahead, back = forward(rows[a:b], begin), backward(rows[a:b], end)
            least = min(x + y for x, y in zip(ahead[0], back[0]))
            for q in STATES:
                if ahead[0][q] + back[0][q] == least:
                    codes, state = traverse(rows[a:b], q, ahead, back)
                    if last:
                        codes[-1] += END_CODES[state]
                    out.append((keys[a], place, q, state, pos[a:b], codes))
    return pd.DataFrame(out, columns=["key", "slice", "entry", "exit", "pos", "codes"])


def _chain(f: pd.DataFrame) -> pd.DataFrame:
    """The state in which the path from the start enters each slice of a conversation."""
    step = {(s, q): x for s, q, x in zip(f["slice"], f["entry"], f["exit"])}
    state, out = START, []
    for s in sorted(set(f["slice"])):
        out.append((s, state))
        state = step[s, state]
    return pd.DataFrame(out, columns=["slice", "entry"]).assign(key=f["key"].iloc[0])


def faults(placed: DataFrame) -> DataFrame:
    """(pos, conv_id, turn, initial, fault) of rows with places. A copy is told by the SHA-256 of its text, per
    conversation and role: firsts are aggregated, not windowed, so a text that is repeated without end is no hot group."""
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).alias("end")
    marks = placed.select("pos", "conv_id", "turn", "role", F.substring("role", 1, 1).alias("initial"), F.unhex(F.sha2("text", 256)).alias("of"), end)
    firsts = marks.groupBy("conv_id", "role", "of").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    fault = F.when(F.col("end") == "", BLANK).when(F.col("is_first").isNull(), DUPLICATE).when(~F.col("end").isin(".", "!", "?"), CUT).otherwise(SOUND)
    return marks.join(firsts, "pos", "left").select("pos", "conv_id", "turn", "initial", fault.alias("fault"))


def edits(marks: DataFrame) -> DataFrame:
    """(pos, code): the edit of every row."""
    # A null conversation has the empty key.
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    marks = marks.select(key.alias("key"), "pos", "initial", "fault", F.shiftright("pos", SLICE_BITS).alias("slice"))
    solved = materialize(marks.groupBy("slice").applyInPandas(_slice, "key string, slice long, pos array<long>, codes array<string>, matrix array<long>"), "repair-slices")
    # A conversation of 2^31 rows, the longest whose audit fits one string, has 2^19 slices.
    crossing = solved.where("matrix is not null").select("key", "slice", "matrix")
    costs = materialize(crossing.groupBy("key").applyInPandas(_costs, "key string, slice long, ahead array<long>, back array<long>, last boolean"), "repair-costs")
    paths = marks.join(costs.select("slice").distinct(), "slice", "left_semi").groupBy("slice").cogroup(costs.groupBy("slice"))
    paths = materialize(paths.applyInPandas(_traversals, "key string, slice long, entry int, exit int, pos array<long>, codes array<string>"), "repair-paths")
    entered = paths.select("key", "slice", "entry", "exit").groupBy("key").applyInPandas(_chain, "slice long, entry int, key string")
    chosen = paths.join(entered, ["key", "slice", "entry"]).select("pos", "codes")
    both = solved.where("codes is not null").select("pos", "codes").unionByName(chosen)
    return both.select(F.explode(F.arrays_zip("pos", "codes")).alias("e")).select("e.pos", F.col("e.codes").alias("code"))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, turn, initial, fault, code, lines): every row in its place, its first fault, the codes of its edits
    and the repaired turns that it leaves behind, array<struct<role, text>>.

    Rows stand by turn, nulls first, then role and text. A null role or text counts as one space, a null conversation
    as a conversation of its own. Repeated rows are duplicates; a role that doesn't begin with s, u or a, an empty
    one included, can't be kept. An empty table gives an empty result; other columns are unread."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "repair-placed")
    marks = materialize(faults(placed), "repair-marks")
    each = F.transform(F.filter(F.split("code", ""), lambda c: ~c.isin("", "D")), lambda c: F.struct(_role(c).alias("role"), F.when(c.isin("u", "a"), "").otherwise(F.col("text")).alias("text")))
    return marks.join(edits(marks), "pos").join(placed.select("pos", "role", "text"), "pos").select("conv_id", "pos", "turn", "initial", "fault", "code", each.alias("lines"))


def _role(code: Column) -> Column:
    return F.when(code.isin("u", "U"), "user").when(code.isin("a", "A"), "assistant").otherwise(F.col("role"))


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """(conv_id, pos, place, role, text): the repaired conversations, one row a turn, in order of pos and place."""
    return repaired.select("conv_id", "pos", F.posexplode("lines").alias("place", "line")).select("conv_id", "pos", "place", "line.role", "line.text")


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


class _Tally:
    """What is known of a conversation while its rows pass by in order."""

    def __init__(self):
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.illegal = self.cost = 0
        self.faults = [0, 0, 0, 0]
        self.audit: list[str] = []
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, turn: int | None, initial: str, fault: int, code: str, text: str | None) -> None:
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.faults[fault] += 1
        self.cost += sum({"D": DELETE, "K": KEEP, "R": REROLE, "I": INSERT}[LETTER[c]] for c in code) + TRUNCATED * (fault == CUT and "D" not in code)
        self.audit.append("".join(LETTER[c] for c in code))
        if text is not None:
            self.hash.update(("\n" + text if self.begun else text).encode())
            self.begun = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def summary(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of repair(): gaps in its turns, faults, illegal neighbours, cost, audit and the SHA-256 of
    its repaired `role:text` lines. Such a hash is made from the first byte to the last, so a conversation's lines pass
    through one task: as a stream of batches in order, of which nothing but the hash and the audit's letters is kept."""
    field = repaired.schema["conv_id"]
    small_batches(repaired.sparkSession)
    text = F.when(F.size("lines") > 0, F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n"))
    stream = repaired.select("conv_id", "pos", "turn", "initial", "fault", "code", text.alias("text")).repartition("conv_id").sortWithinPartitions("pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tally = None, None

        def out(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", *SUMMARY])

        kind = None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for conv, _, *row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if tally is None or conv != now:
                    if tally is not None:
                        done.append((now, *tally.row()))
                    now, tally = conv, _Tally()
                tally.add(*row)
            if done:
                yield out(done, kind)
        if tally is not None:
            yield out([(now, *tally.row())], kind)

    return stream.mapInArrow(run, f"conv_id {field.dataType.simpleString()}, " + ", ".join(f"{c} {'string' if c in SUMMARY[-2:] else 'long'}" for c in SUMMARY))
