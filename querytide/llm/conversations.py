"""Repair of conversations by the auction algorithm for shortest paths.

A conversation, in order, is a lattice: a node for each place between rows and each state of the
wanted sequence of roles, and an arc for each edit. Node prices rise, and the path is extended and
contracted, until they are the least costs to the end; the arcs that are tight at those prices
are exactly the ones of cheapest repairs, and the trace takes the least edit at every node.

Long conversations are cut into segments of bounded length. Each segment's least costs between
its two borders form a 4 x 4 matrix; min-plus products of these carry prices from the end of the
conversation to every border and states from its start. No task holds more than one segment, or
the matrices of a bounded number of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytide.llm.common import prepare
from querytide.operators.paging import ranked
from querytide.session import write_and_read

#: What no path costs.
NEVER = 1 << 40

#: States of the wanted sequence `(s?(ua)+)?`: nothing yet, after s, after u, after a.
STATES = 4
START, AFTER_S, AFTER_U, AFTER_A = range(STATES)
#: The initial that a user or assistant row must have in a state, and the state after it.
NEXT = {START: ("u", AFTER_U), AFTER_S: ("u", AFTER_U), AFTER_U: ("a", AFTER_A), AFTER_A: ("u", AFTER_U)}
ROLES = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class RepairParams:
    """Costs of the edits, and the sizes that bound what one task holds."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5
    #: Rows of a segment, and matrices that are multiplied in one task.
    segment: int = 512
    matrices: int = 512


# --- one segment --------------------------------------------------------------------------

#: A row is one letter: `d` if it must be deleted, else the initial `s`, `u`, `a` or `x` (any
#: other), upper case if the text is cut off.
Arc = tuple[str, int, int, int]  # edit, place and state it leads to, cost


class Lattice:
    """The nodes and arcs of a segment; a node is (place, state), the place of `n` is the border.

    Inserts before a row belong to its place, so those at the end of a conversation belong to a
    last segment that has no row left, `open_end`.
    """

    def __init__(self, rows: str, params: RepairParams, open_end: bool = False):
        self.rows, self.params, self.open_end = rows, params, open_end

    def arcs(self, place: int, state: int) -> list[Arc]:
        """The edits at a node, in ASCII order of their letters."""
        p, n = self.params, len(self.rows)
        wanted, after = NEXT[state]
        if place == n:
            return [("I", n, after, p.insert)] if self.open_end else []
        row = self.rows[place]
        found = [("D", place + 1, state, p.delete), ("I", place, after, p.insert)]
        if row != "d":
            extra = p.truncated if row.isupper() else 0
            initial = row.lower()
            if initial == wanted:
                found.append(("K", place + 1, after, extra))
            elif initial == "s" and state == START:
                found.append(("K", place + 1, AFTER_S, extra))
            found.append(("R", place + 1, after, p.rerole + extra))
        return found

    def prices(self, ends: tuple[int, ...]) -> list[list[int]]:
        """The least cost from every node to the end, by place and state.

        `ends` holds the costs from the border's states on. Every node is an origin in turn, from
        the last place to the first. A path starts there; its last node either is dearer than its
        price, then the price rises to the cheapest arc and the path is contracted, or the path
        is extended along that arc. It ends at a node whose price is final: the end, or one of an
        earlier auction; then all nodes that are left on the path have final prices too, as their
        arcs on it are tight.
        """
        n = len(self.rows)
        price = [[0] * STATES for _ in range(n + 1)]
        final = [[False] * STATES for _ in range(n + 1)]
        least = min(ends)
        for place in range(n, -1, -1):
            leads_on = self._leads_on(place, ends, price)
            for origin in range(STATES):
                # No node is nearer to the end than the nearest of the next place.
                price[place][origin] = least if leads_on[origin] else NEVER
                final[place][origin] = not leads_on[origin]
            for origin in range(STATES):
                path = [(place, origin)]
                while not final[path[-1][0]][path[-1][1]]:
                    at, state = path[-1]
                    best, to = (ends[state], None) if at == n else (NEVER, None)
                    for _, to_place, to_state, cost in self.arcs(at, state):
                        if (level := cost + price[to_place][to_state]) < best:
                            best, to = level, (to_place, to_state)
                    if price[at][state] < best:  # contract; the origin stays
                        price[at][state] = best
                        if len(path) > 1:
                            path.pop()
                    elif to is None:  # tight to the end itself
                        final[at][state] = True
                    else:
                        path.append(to)
                for at, state in path:
                    final[at][state] = True
            least = min(price[place])
        return price

    def _leads_on(self, place: int, ends: tuple[int, ...], price: list[list[int]]) -> list[bool]:
        """The states of a place from which the end can be reached; the others have no price."""
        n = len(self.rows)
        found = [place == n and ends[state] < NEVER for state in range(STATES)]
        for _ in range(STATES):  # inserts lead on within the place
            for state in range(STATES):
                found[state] = found[state] or any(
                    found[to_state] if to_place == place else price[to_place][to_state] < NEVER
                    for _, to_place, to_state, _ in self.arcs(place, state)
                )
        return found

    def matrix(self) -> list[list[int]]:
        """The least cost from each state before the segment to each one after it."""
        columns = [self.prices(tuple(0 if s == end else NEVER for s in range(STATES)))[0] for end in range(STATES)]
        return [[columns[end][state] for end in range(STATES)] for state in range(STATES)]

    def trace(self, ends: tuple[int, ...], state: int) -> tuple[str, int]:
        """The least edits along tight arcs from a state before the segment, and the state after it."""
        price, n = self.prices(ends), len(self.rows)
        place, edits = 0, []
        while place < n or price[place][state] != ends[state]:
            for edit, to_place, to_state, cost in self.arcs(place, state):
                if price[place][state] == cost + price[to_place][to_state]:
                    edits.append(edit)
                    place, state = to_place, to_state
                    break
        return "".join(edits), state


@lru_cache(maxsize=8)
def final_prices(params: RepairParams) -> tuple[int, ...]:
    """Costs from the states at the end of a conversation: it may end empty or after a."""
    wanted = tuple(0 if s in (START, AFTER_A) else NEVER for s in range(STATES))
    return tuple(Lattice("", params, open_end=True).prices(wanted)[0])


@lru_cache(maxsize=8)
def final_edits(params: RepairParams) -> tuple[str, ...]:
    """The inserts from the states at the end of a conversation."""
    wanted = tuple(0 if s in (START, AFTER_A) else NEVER for s in range(STATES))
    return tuple(Lattice("", params, open_end=True).trace(wanted, s)[0] for s in range(STATES))


@lru_cache(maxsize=50_000)
def _short_trace(rows: str, params: RepairParams, ends: tuple[int, ...], state: int) -> tuple[str, int]:
    return Lattice(rows, params).trace(ends, state)


def solve(rows: str, params: RepairParams, ends: tuple[int, ...], state: int) -> tuple[str, int]:
    """As `Lattice.trace`; the answers for short segments, which recur, are remembered."""
    return _short_trace(rows, params, ends, state) if len(rows) <= 12 else Lattice(rows, params).trace(ends, state)


# --- all segments -------------------------------------------------------------------------

KEY = ["void", "conv"]  # whether the conversation's id is null, and the id or else 0
SEGMENT_SCHEMA = (
    "void boolean, conv long, place long, turn long, role string, digest binary, letters string, copies array<long>, "
    "blank long, duplicate long, truncated long, illegal long, turns long, "
    "low long, last_turn long, first_initial string, last_initial string"
)
EDIT_SCHEMA = "edits array<string>, tail string, state int, cost long, audit string"


def _keyed(conversations: DataFrame) -> DataFrame:
    """The columns that are read, null roles and texts as one space."""
    conv = F.col("conv_id").cast("long")
    return conversations.select(
        conv.isNull().alias("void"),
        F.coalesce(conv, F.lit(0)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))


def _distinct_rows(keyed: DataFrame) -> DataFrame:
    """Rows without their texts, equal ones once with their number, and whether one like it came before."""
    stripped = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    faults = keyed.select(
        *KEY, "turn", "role", "digest",
        (stripped == "").alias("blank"),
        (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    rows = write_and_read(faults.groupBy(*faults.columns).agg(F.count("*").alias("copies")), "turns")
    first = rows.groupBy(*KEY, "role", "digest").agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("none")
    )
    first = first.select(*KEY, "role", "digest", F.when(~F.col("none"), F.col("least")).alias("first_turn"))
    a, b = rows.alias("a"), first.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*KEY, "role", "digest")]
    same.append(F.col("a.turn").eqNullSafe(F.col("b.first_turn")))
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return a.join(b, condition, "left").select("a.*", F.col("b.role").isNull().alias("repeated"))


def _initial(role: str) -> str:
    return role[:1]


def _legal(one: str, other: str) -> bool:
    return one + other in ("su", "ua", "au") and len(one) == 1


class _Segment:
    """Rows of one conversation in order, as they come."""

    def __init__(self, key: tuple, place: int, turn: int | None, role: str, digest: bytes, linked: tuple | None):
        self.head = (*key, place, turn, role, digest)
        self.letters: list[str] = []
        self.copies: list[int] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low, self.first_initial, self.last = None, _initial(role), linked

    def add(self, turn: int | None, role: str, blank: bool, truncated: bool, copies: int, repeated: bool) -> None:
        initial = _initial(role)
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - (not repeated)
            self.truncated += truncated and not repeated
        if self.last is not None:
            self.illegal += not _legal(self.last[1], initial)
        self.illegal += copies - 1
        self.turns += turn is not None and (self.last is None or self.last[0] != turn)
        self.low = turn if self.low is None else self.low
        letter = initial if initial in ("s", "u", "a") else "x"
        self.letters.append("d" if blank or repeated else letter.upper() if truncated else letter)
        self.copies.append(copies)
        self.last = (turn, initial)

    def row(self) -> tuple:
        counts = (self.blank, self.duplicate, self.truncated, self.illegal, self.turns)
        return (*self.head, "".join(self.letters), self.copies, *counts, self.low, self.last[0], self.first_initial, self.last[1])


def _segments(rows: DataFrame, params: RepairParams) -> DataFrame:
    """Segments of the conversations' rows in the order of turn (null first), role and digest.

    `place` rises along a conversation. Counts take in the step from the row before the segment
    if that is in the same task; the first segment of a task does not know it.
    """
    schema = pa.schema([
        ("void", pa.bool_()), ("conv", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
        ("digest", pa.binary()), ("letters", pa.string()), ("copies", pa.list_(pa.int64())), ("blank", pa.int64()),
        ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()),
        ("low", pa.int64()), ("last_turn", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_segment, place = None, None, TaskContext.get().partitionId() << 40
        for batch in batches:
            done = []
            for void, conv, turn, role, digest, *faults in zip(*(c.to_pylist() for c in batch.columns)):
                if (void, conv) != key or len(open_segment.letters) == params.segment:
                    linked = open_segment.last if (void, conv) == key else None
                    if open_segment is not None:
                        done.append(open_segment.row())
                    key = (void, conv)
                    open_segment = _Segment(key, place, turn, role, digest, linked)
                    place += 1
                open_segment.add(turn, role, *faults)
            yield _batch(done, schema)
        if open_segment is not None:
            yield _batch([open_segment.row()], schema)

    order = [*KEY, "turn", "role", "digest"]
    dealt = rows.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order)
    return dealt.select(*order, "blank", "truncated", "copies", "repeated").mapInArrow(cut, SEGMENT_SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# --- prices and states across segments ----------------------------------------------------


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.minimum((matrix + vector).min(axis=1), NEVER)


def carried(items: DataFrame, vector: tuple[int, ...], backward: bool, most: int) -> DataFrame:
    """For the matrix of each item (KEY, `number` from 0 without gaps) the vector that reaches it.

    Backward, an item gets the product of all matrices after it with `vector`; forward, `vector`
    multiplied with all before it. Items are multiplied in blocks of `most`, and blocks likewise,
    so a conversation of any length is worked on level by level.
    """
    prepare(items.sparkSession)
    width = len(vector)
    items = write_and_read(items.select(*KEY, "number", "matrix"), "matrices")
    listed = F.sort_array(F.collect_list(F.struct("number", "matrix")))
    block = F.floor(F.col("number") / F.lit(most)).cast("long")
    blocks = items.groupBy(*KEY, block.alias("block")).agg(listed.alias("items"))

    def square(entry: dict) -> np.ndarray:
        return np.array(entry["matrix"], "i8").reshape(width, width)

    def product(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            products = []
            for entries in frame["items"]:
                whole = square(entries[0])
                for entry in entries[1:]:
                    whole = np.minimum((whole[:, :, None] + square(entry)[None]).min(axis=1), NEVER)
                products.append(whole.ravel().tolist())
            yield frame[["void", "conv"]].assign(number=frame["block"], matrix=products)

    if (items.agg(F.max("number")).first()[0] or 0) < most:
        reaching = blocks.withColumn("vector", F.array(*[F.lit(v).cast("long") for v in vector]))
    else:
        multiplied = blocks.mapInPandas(product, "void boolean, conv long, number long, matrix array<long>")
        outer = carried(multiplied, vector, backward, most).withColumnRenamed("number", "block")
        reaching = blocks.join(outer, [*KEY, "block"])

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for void, conv, entries, start in zip(frame["void"], frame["conv"], frame["items"], frame["vector"]):
                vector = np.array(start, "i8")
                for entry in reversed(entries) if backward else entries:
                    rows.append((void, conv, entry["number"], vector.tolist()))
                    vector = _times(square(entry) if backward else square(entry).T, vector)
            yield pd.DataFrame(rows, columns=["void", "conv", "number", "vector"])

    return reaching.select(*KEY, "items", "vector").mapInPandas(spread, "void boolean, conv long, number long, vector array<long>")


def _borders(segments: DataFrame, params: RepairParams) -> DataFrame:
    """For segments of conversations with several: prices after and state before, and what precedes."""
    several = segments.groupBy(*KEY).agg(F.count("*").alias("parts")).filter("parts > 1")
    columns = [*KEY, "place", "letters", "turn", "last_turn", "first_initial", "last_initial", "parts"]
    long = ranked(segments.join(several, KEY).select(*columns), KEY, [F.col("place")])
    long = write_and_read(long.withColumnRenamed("rank", "number"), "long-segments")

    def of_rows(function: Callable[..., list[int]], *names: str) -> Column:
        @F.pandas_udf("array<long>")
        def each(letters: pd.Series, vectors: pd.Series) -> pd.Series:
            return pd.Series([function(a, b) for a, b in zip(letters, vectors)])

        return each(*names)

    def matrix(letters: str, _: object) -> list[int]:
        return sum(Lattice(letters, params).matrix(), [])

    def steps(letters: str, ends: list[int]) -> list[int]:
        ends = tuple(int(e) for e in ends)
        after = [solve(letters, params, ends, state)[1] for state in range(STATES)]
        return [0 if to == after[state] else NEVER for state in range(STATES) for to in range(STATES)]

    matrices = long.select(*KEY, "number", of_rows(matrix, "letters", "letters").alias("matrix"))
    ends = write_and_read(carried(matrices, final_prices(params), True, params.matrices), "border-prices")
    priced = long.join(ends.withColumnRenamed("vector", "ends"), [*KEY, "number"])
    moves = priced.select(*KEY, "number", of_rows(steps, "letters", "ends").alias("matrix"))
    at_start = tuple(0 if s == START else NEVER for s in range(STATES))
    states = carried(moves, at_start, False, params.matrices)
    state = (F.array_position("vector", F.lit(0).cast("long")) - 1).cast("int")
    before = long.select(
        *KEY, (F.col("number") + 1).alias("number"),
        F.col("last_turn").alias("turn_before"), F.col("last_initial").alias("initial_before"),
    )
    return (
        priced.join(states.select(*KEY, "number", state.alias("before")), [*KEY, "number"])
        .join(before, [*KEY, "number"], "left")
        .select(
            *KEY, "place", "ends", "before", (F.col("number") < F.col("parts") - 1).alias("goes_on"),
            "turn_before", "initial_before",
        )
    )


# --- the operator -------------------------------------------------------------------------


def plan(conversations: DataFrame, params: RepairParams = RepairParams()) -> DataFrame:
    """The cheapest edits of every conversation, by segments; written to the shared folder.

    Rows are taken by turn (null first), rows of one turn by role and then by a digest of the
    text. Null roles and texts are one space; a null `conv_id` is a conversation of its own. A role
    is known by its first letter; an empty role fits nowhere. An empty table has no segments.
    """
    prepare(conversations.sparkSession)
    segments = write_and_read(_segments(_distinct_rows(_keyed(conversations)), params), "segments")
    borders = write_and_read(_borders(segments, params), "borders")
    last_prices, last_edits = final_prices(params), final_edits(params)

    @F.pandas_udf(EDIT_SCHEMA)
    def edit(letters: pd.Series, copies: pd.Series, ends: pd.Series, state: pd.Series, goes_on: pd.Series) -> pd.DataFrame:
        found = []
        for rows, numbers, prices, at, more in zip(letters, copies, ends, state, goes_on):
            at = START if pd.isna(at) else int(at)
            prices = last_prices if prices is None else tuple(int(p) for p in prices)
            trace, after = solve(rows, params, prices, at)
            tail = "" if more is True or more == 1 else last_edits[after]
            groups, audit, cost, group, row = [], [], params.insert * (len(tail) + trace.count("I")), "", 0
            for letter in trace:
                group += letter
                if letter != "I":
                    again = int(numbers[row]) - 1
                    cost += params.delete * again
                    if letter == "D":
                        cost += params.delete
                    else:
                        cost += params.rerole * (letter == "R") + params.truncated * rows[row].isupper()
                    groups.append(group)
                    audit.append(group + "D" * again)
                    group, row = "", row + 1
            found.append((groups, tail, at, cost, "".join(audit) + tail))
        return pd.DataFrame(found, columns=["edits", "tail", "state", "cost", "audit"])

    # What the first segment of a task could not know of the one before it.
    stepped = F.col("unlinked") & F.col("initial_before").isNotNull()
    pair = F.concat("initial_before", "first_initial")
    whole = segments.join(borders, [*KEY, "place"], "left").withColumn(
        "unlinked", F.col("place") % F.lit(1 << 40) == 0
    )
    planned = whole.select(
        *KEY, "place", "turn", "role", "digest", "low", "last_turn", "blank", "duplicate", "truncated",
        (F.col("illegal") + F.when(stepped & ~pair.isin("su", "ua", "au"), 1).otherwise(0)).alias("illegal"),
        (F.col("turns") - F.when(stepped & (F.col("turn") == F.col("turn_before")), 1).otherwise(0)).alias("turns"),
        edit("letters", "copies", "ends", "before", "goes_on").alias("edit"),
    )
    return write_and_read(planned.select("*", "edit.*").drop("edit"), "repair-plan")


def summary(conversations: DataFrame, planned: DataFrame) -> DataFrame:
    """Faults, cost and edits of each conversation of `conversations`, also of those without a plan."""
    parts = F.sort_array(F.collect_list(F.struct("place", "audit")))
    sums = [F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated", "illegal", "cost", "turns")]
    each = planned.groupBy(*KEY).agg(
        *sums, F.min("low").alias("low"), F.max("last_turn").alias("high"),
        F.concat_ws("", F.transform(parts, lambda p: p["audit"])).alias("audit"),
    )
    conv = F.col("conv_id").cast("long")
    all_ids = conversations.select(conv.isNull().alias("void"), F.coalesce(conv, F.lit(0)).alias("conv")).distinct()
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return all_ids.join(each, KEY, "left").select(
        *KEY, F.when(~F.col("void"), F.col("conv")).alias("conv_id"), gaps.alias("gaps"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
    )


def repaired(conversations: DataFrame, planned: DataFrame) -> DataFrame:
    """The rows that are left or put in: KEY, `edit` (K, R or I), `role` and `text`.

    A partition holds whole conversations, and their rows in order. Texts are shuffled once, sorted
    together with the plan, and merged with it as they stream by, so a long conversation is a
    long stream and is never held.
    """
    prepare(conversations.sparkSession)
    schema = pa.schema([("void", pa.bool_()), ("conv", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    order = [*KEY, "turn", "role", "digest", "kind"]
    plans = planned.select(*order[:-1], F.lit(0).alias("kind"), F.lit("").alias("text"), "edits", "tail", "state")
    rows = _keyed(conversations).select(
        *order[:-1], F.lit(1).alias("kind"), "text", F.lit(None).cast("array<string>").alias("edits"),
        F.lit(None).cast("string").alias("tail"), F.lit(None).cast("int").alias("state"),
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, tail, state, row_before = iter(()), "", START, None
        for batch in batches:
            done = []

            def put(key: tuple, edit: str, role: str, text: str) -> None:
                nonlocal state
                initial = role[:1]
                if edit != "K":
                    initial = NEXT[state][0]
                    role = ROLES[initial]
                state = AFTER_S if initial == "s" else NEXT[state][1]
                done.append((*key, edit, role, text))

            for void, conv, turn, role, digest, kind, text, new_edits, new_tail, new_state in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    edits, tail, state, row_before = iter(new_edits), new_tail, new_state, None
                    left = len(new_edits)
                    continue
                if (turn, role, digest) == row_before:
                    continue  # a copy, which is deleted
                row_before = (turn, role, digest)
                for edit in next(edits):
                    if edit != "D":
                        put((void, conv), edit, role, "" if edit == "I" else text)
                left -= 1
                if left == 0:
                    for edit in tail:
                        put((void, conv), edit, "", "")
            yield _batch(done, schema)

    together = plans.unionByName(rows).repartition(*KEY).sortWithinPartitions(*order)
    return together.mapInArrow(merge, "void boolean, conv long, edit string, role string, text string")


def repaired_digests(rows: DataFrame) -> DataFrame:
    """KEY and `repaired_sha256` of the rows of `repaired`: SHA-256 of `role:text`, joined by newlines."""
    schema = pa.schema([("void", pa.bool_()), ("conv", pa.int64()), ("repaired_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for void, conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("void", "conv", "role", "text"))):
                if (void, conv) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (void, conv), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield _batch(done, schema)
        if key is not None:
            yield _batch([(*key, state.hexdigest())], schema)

    return rows.mapInArrow(digest, "void boolean, conv long, repaired_sha256 string")


def repair_digests(conversations: DataFrame, originals: DataFrame, params: RepairParams = RepairParams()) -> DataFrame:
    """A row for each `conv_id` of `originals`: faults, cost and edits of `conversations`, and the digest."""
    planned = plan(conversations, params)
    digests = repaired_digests(repaired(conversations, planned))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        summary(originals, planned)
        .join(digests, KEY, "left")
        .withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(nothing)))
        .drop(*KEY)
    )
