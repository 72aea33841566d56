"""Repair of the turn structure of conversations by an auction for the shortest path.

A repaired conversation reads, by the initials of its roles, ``(s?(ua)+)?``. Edits
cost: keep 0, give a turn the role user or assistant 2, delete 3 (blank and
duplicate turns must go), insert an empty turn of user or assistant 2; a truncated
turn that stays adds 1. Positions times four states of that pattern are the nodes of a lattice
with integer costs.

The auction (Bertsekas, 1991) keeps a price on each node and one path from the
origin. Where the last node's price is below the cheapest way on, it rises to that and the
path contracts; else the path is extended along that way. When the path arrives, the
origin's price is its distance, and no arc is cheaper than the price difference of its ends. Arcs
that equal it are tight; every cheapest path consists of tight arcs, so the one with the least letters is traced
along tight arcs from which the end can still be reached. Long conversations go through the
auction in windows from their end, each with the exact prices of the next, so work
grows with the number of turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
#: Turns of one window of the auction; windows remembered by their content in a worker.
WINDOW, REMEMBERED = 8, 100_000
#: States: nothing yet, after s, after u, after a. Which initial leads where when kept, and where a new role leads.
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: Price of the end from each state after the last turn: turns still to insert.
ENDS = (0, 4, 2, 0)
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
#: Cheapest edit of a turn by its fault, and what keeping it costs.
LEAST, STAYS = (0, 1, 3, 3), (0, 1)


def arcs(codes: bytes, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, position, state) of each edit at a node, by letter. A code is an initial's place in 'sua-' times 4, plus the fault."""
    initial, fault = "sua-"[codes[i] >> 2], codes[i] & 3
    found = [("D", 3, i + 1, state), ("I", 2, i, NEXT[state])]
    if fault <= TRUNCATED:
        if (state, initial) in KEEP:
            found.append(("K", STAYS[fault], i + 1, KEEP[state, initial]))
        found.append(("R", 2 + STAYS[fault], i + 1, NEXT[state]))
    return found


def auction(codes: bytes, exits: tuple[int, ...]) -> list[list[int]]:
    """Prices of all nodes of a window after an auction from each of its four first nodes; ``exits`` are exact."""
    n = len(codes)
    prices = [list(exits)]
    for code in reversed(codes):  # start below all distances: the cheapest edits of the turns that follow
        prices.append([(min(exits) if len(prices) == 1 else prices[-1][0]) + LEAST[code & 3]] * 4)
    prices.reverse()
    ways = [[arcs(codes, i, s) for s in range(4)] for i in range(n)]
    for origin in range(4 if n else 0):
        path = [(0, origin)]
        while path[-1][0] < n:
            i, state = path[-1]
            cost, j, after = min((c + prices[j][t], j, t) for _, c, j, t in ways[i][state])
            if prices[i][state] < cost:
                prices[i][state] = cost
                if len(path) > 1:
                    path.pop()
            else:
                path.append((j, after))
    return prices


@lru_cache(maxsize=REMEMBERED)
def solve(codes: bytes, exits: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """(prices of the four first nodes, (least letters, state at the exit) from each of them)."""
    n = len(codes)
    prices = auction(codes, exits)
    tight: list[list[list[tuple[str, int, int]]]] = []
    reach = [[False] * 4 for _ in range(n)] + [[True] * 4]
    for i in range(n):
        tight.append([[(x, j, t) for x, c, j, t in arcs(codes, i, s) if prices[i][s] == c + prices[j][t]] for s in range(4)])
    for i in range(n - 1, -1, -1):
        for _ in range(4):  # inserts stay at their position and pass through a few states
            for s in range(4):
                reach[i][s] = reach[i][s] or any(reach[j][t] for _, j, t in tight[i][s])
    traces = []
    for origin in range(4):
        i, s, letters = 0, origin, []
        while i < n:
            x, i, s = next(a for a in tight[i][s] if reach[a[1]][a[2]])
            letters.append(x)
        traces.append(("".join(letters), s))
    return tuple(prices[0]), tuple(traces)


def repair(codes: bytes) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits of one conversation, of equal costs the least letters."""
    exits, base, steps = ENDS, 0, []
    for end in range(len(codes), 0, -WINDOW):
        exits, traces = solve(codes[max(0, end - WINDOW) : end], exits)
        steps.append(traces)
        low = min(exits)
        base, exits = base + low, tuple(p - low for p in exits)
    state, letters = 0, []
    for traces in reversed(steps):
        more, state = traces[state]
        letters.append(more)
    return base + exits[0], "".join(letters) + "I" * (ENDS[state] // 2)


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32(``conv_id:turn``) % 20; nulls in that key, roles and texts are one space.

    0 drops the turn, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it the user's.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _ordered(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    name = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), name.alias("name"))


def fault(text: Column, repeated: Column) -> Column:
    """The first fault of a turn: blank, then duplicate, then truncated (its last character is no ``.``, ``!`` or ``?``)."""
    end = F.rtrim(text, F.lit(SPACES))
    return F.when(end == "", BLANK).when(repeated, DUPLICATE).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)


def audit(turns: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation.

    Turns go by ``turn`` (null first), of equal ones by role, then by a digest of role and text. Null roles and texts are one
    space, a null conv_id is a conversation; a role other than s, u, a by its initial (or empty) can't be kept. gaps counts
    turn numbers missing between the smallest and the largest; illegal counts neighbours whose initials are
    not su, ua or au. Conversations of ``known`` (conv_id) without a turn come with zeros and an empty audit; an
    empty table gives no row. Other columns are ignored.

    Texts stay where they are: what is shuffled is a few bytes a turn. A
    conversation's turns stream sorted through one task, which holds one byte of each.
    """
    rows = _ordered(turns)
    once = Window.partitionBy("conv_id", "name").orderBy(F.asc_nulls_first("turn"))
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.left("role", F.lit(1))), F.lit(0)), F.lit(4)) - 1
    plain = rows.select("conv_id", "turn", F.left("role", F.lit(1)).alias("role"), "role", "name", fault(F.col("text"), F.lit(False)).alias("fault"),
                        F.when(F.col("role") == "", 3).otherwise(initial).alias("initial")).toDF("conv_id", "turn", "first", "role", "name", "fault", "initial")
    seen = plain.withColumn("again", F.row_number().over(once) > 1).select(
        "conv_id", "turn", "role", "name",
        (F.col("initial") * 4 + F.when(F.col("again") & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))).cast("int").alias("code"))
    if known is not None:
        none = known.select("conv_id").distinct().select(
            "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("name"), F.lit(-1).alias("code"))
        seen = seen.unionByName(none)
    kind = turns.schema["conv_id"].dataType.simpleString()
    streamed = seen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "name").select("conv_id", "turn", "code")
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        own, codes, low, high, numbers, last = None, bytearray(), None, None, 0, None

        def close() -> tuple:
            initials = [c >> 2 for c in codes]
            faults = [0] * 4
            for c in codes:
                faults[c & 3] += 1
            wrong = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:]))
            cost, letters = repair(bytes(codes))
            return (own[0], high - low + 1 - numbers if numbers else 0, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], wrong, cost, letters)

        def packed(kinds: list[pa.DataType]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in schema.split(", ")])

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string()]
            for i, turn, code in zip(*(c.to_pylist() for c in batch.columns)):
                if own != (i,):
                    if own is not None:
                        out.append(close())
                        if len(out) >= 4096:
                            yield packed(kinds)
                            out.clear()
                    own, codes, low, high, numbers, last = (i,), bytearray(), None, None, 0, None
                if code < 0:
                    continue
                codes.append(code)
                if turn is not None and turn != last:
                    low, high, numbers, last = turn if low is None else low, turn, numbers + 1, turn
        if own is not None:
            out.append(close())
            yield packed(kinds)

    return streamed.mapInArrow(run, schema)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, letter, role, text) of each turn that stays or is new, and (conv_id, None, (values, letters), None) where a conversation begins.

    The stream has each conversation's audit, then its turns in order.
    """
    own, letters, at, state = None, "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            yield own, "I", ROLE[state], ""
            at, state = at + 1, NEXT[state]

    for batch in batches:
        for i, values, letters_, role, text in zip(*(c.to_pylist() if k != 4 else c for k, c in enumerate(batch.columns))):
            if letters_ is not None:
                yield from inserted()
                own, letters, at, state = i, letters_, 0, 0
                yield own, None, (*values, letters), None
                continue
            yield from inserted()
            letter, at = letters[at], at + 1
            if letter == "R":
                yield own, letter, ROLE[state], text.as_py()
                state = NEXT[state]
            elif letter == "K":
                yield own, letter, role, text.as_py()
                state = KEEP[state, role[0]]
    yield from inserted()


def _together(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit, then its turns in order, in one partition."""
    rows = _ordered(turns).withColumns({"kind": F.lit(1), "values": F.lit(None).cast("array<long>"), "audit": F.lit(None).cast("string")})
    values = F.array("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    heads = audits.select("conv_id", values.alias("values"), "audit").withColumn("kind", F.lit(0))
    both = rows.unionByName(heads, allowMissingColumns=True).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", "kind", "turn", "role", "name").select("conv_id", "values", "audit", "role", "text")


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of each repaired conversation in order; edit is K, R or I.

    ``audits`` come from ``audit`` over the same turns. Turns stream sorted through the tasks; nothing but the letters
    of one conversation is held. Nulls and ties as there; a conversation without turns has no row.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out, first = 0, [], None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal first
            for batch in batches:
                first = batch.schema.field(0).type
                yield batch

        def packed() -> pa.RecordBatch:
            kinds = [first, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "place", "edit", "role", "text"])

        for i, letter, role, text in _edits(typed()):
            if letter is None:
                place = 0
                continue
            out.append((i, place, letter, role, text))
            place += 1
            if len(out) >= 2048:
                yield packed()
                out.clear()
        if out:
            yield packed()

    return _together(turns, audits).mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")


def digest(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """``audits`` with repaired_sha256: of the repaired ``role:text`` lines, hashed as they stream by."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first = [], None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal first
            for batch in batches:
                first = batch.schema.field(0).type
                yield batch

        def packed() -> pa.RecordBatch:
            kinds = [first, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        head, total, begun = None, None, False
        for i, letter, role, text in _edits(typed()):
            if letter is None:
                if head is not None:
                    out.append((*head, total.hexdigest()))
                    if len(out) >= 4096:
                        yield packed()
                        out.clear()
                head, total, begun = (i, *role), hashlib.sha256(), False
                continue
            total.update((("\n" if begun else "") + role + ":" + text).encode())
            begun = True
        if head is not None:
            out.append((*head, total.hexdigest()))
            yield packed()

    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _together(turns, audits).mapInArrow(run, schema)
