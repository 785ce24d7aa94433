"""Operator 13: conversation structure repair by the auction shortest-path algorithm.

A conversation's rows (by turn) become one with the role initials ``(s?(ua)+)?`` at least
cost. Edits: Keep 0; Rerole to user or assistant 1; Delete 2 (required for blank and
duplicate rows); Insert an empty user or assistant message anywhere 5; a truncated row that
is not deleted adds 5. Faults: blank (no character outside ``\\x20\\x09-\\x0D``), else
duplicate (role and text seen earlier), else truncated (last such character not one of ``.!?``).

The edits are the arcs of a lattice: levels are the rows consumed, and a level has one node
for each state of the pattern. Node prices p stay dual feasible (p_i <= cost_ij + p_j). From
an origin a path is extended over its last node's tight arc; where there is none, the node's
price rises to the least cost_ij + p_j and the path contracts by one node, until it reaches
a node whose price is its exact distance to the end. Costs are integers, so every rise is at
least one. Levels are converged in blocks from the end, all four entries of a block, so the
work is linear in the rows. All cheapest repairs consist of tight arcs; the one with the
ASCII-least string of edit initials is traced over tight arcs that lead to the end.

Spark: faults and roles are judged row by row, rows are sorted per conversation after one
exchange on its id, and only one character per row goes to the auction (equal conversations
are solved once per worker); edits come back as row numbers and are applied in the JVM. The
edit string of a conversation is one value by contract, so a conversation is one task's work.

Defined results: null roles and texts are read as one space; null turns sort first; a null
conv_id is a conversation of its own; rows of one turn are ordered by role, then text;
repeated rows are duplicates; conversations whose rows are all lost have zeros, an empty
audit and no messages; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

BLANKS = "\t\n\x0b\x0c\r "
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
BLOCK = 64                            # levels that are converged together
START, SYSTEM, USER, ASSISTANT = range(4)   # what the repaired conversation ends in so far
STATES = 4
_SPEAKS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # who may come next, unless kept as system
_KEPT = {"u": USER, "a": ASSISTANT, "s": SYSTEM}
_MEMO = 200_000


def _arcs(code: str, state: int) -> list[tuple[str, int, int, int]]:
    """(initial, cost, rows consumed, next state) of a row's edits; at most one per initial. ``code``: one character per row, see ``repair``."""
    after = _SPEAKS[state]
    out = [(DELETE, COST[DELETE], 1, state)] if code else []
    out.append((INSERT, COST[INSERT], 0, after))
    if code and code != "x":
        more, kept = TRUNCATED if code.isupper() else 0, _KEPT.get(code.lower())
        if kept == after or kept == SYSTEM and state == START:
            out.append((KEEP, COST[KEEP] + more, 1, kept))
        out.append((REROLE, COST[REROLE] + more, 1, after))
    return out


#: Arcs by row code; "" is the end, from which only inserts lead on.
ARCS = {c: [_arcs(c, s) for s in range(STATES)] for c in ["", *"xsuaoSUAO"]}


def _auction(origin: int, ends: list[int], price: list[float], arcs: list[list[tuple[int, int]]]) -> None:
    """Raise ``price`` until the path from ``origin`` reaches a node of known distance (``ends[node]``)."""
    path = [origin]
    while not ends[path[-1]]:
        node = path[-1]
        least, to = min((cost + price[j], j) for cost, j in arcs[node])
        if price[node] < least:
            price[node] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def _choices(codes: str, block: int) -> tuple[int, bytes]:
    """(least cost, for each node the arc to take: 1 + its index in ARCS, 0 for none or the end)."""
    n = len(codes)
    take = bytearray(STATES * (n + 1))
    beyond: list[int] = []              # exact prices of the level after the block
    for low in reversed(range(0, n + 1, block)):
        levels = codes[low : low + block]
        here = [*levels, ""] if low + block > n else list(levels)
        size = STATES * len(here)
        last = not beyond
        # the end is one node, reached from START and ASSISTANT of the last level at no cost
        known = [0] if last else beyond
        base = min(known)
        price, ends = [base] * size + known, [0] * size + [1] * len(known)
        arcs: list[list[tuple[int, int]]] = []
        for k, code in enumerate(here):
            for state in range(STATES):
                out = [(cost, STATES * (k + step) + to) for _, cost, step, to in ARCS[code][state]]
                if code == "" and state in (START, ASSISTANT):
                    out.append((0, size))
                arcs.append(out)
        for state in range(STATES):
            _auction(state, ends, price, arcs)
        # tight arcs that lead to the end; inserts stay on their level and go to smaller prices
        leads = [False] * size + [True] * len(known)
        for k in reversed(range(len(here))):
            for node in sorted(range(STATES * k, STATES * (k + 1)), key=price.__getitem__):
                if here[k] == "" and price[node] == 0 and node % STATES in (START, ASSISTANT):
                    leads[node] = True
                    continue
                for i, (_, cost, step, to) in enumerate(ARCS[here[k]][node % STATES]):
                    to += STATES * (k + step)
                    if price[node] == cost + price[to] and leads[to]:
                        leads[node], take[STATES * low + node] = True, i + 1
                        break
        beyond = price[:STATES]
    return beyond[START], bytes(take)


def repair_codes(codes: str, block: int = BLOCK) -> tuple[int, str, list[int]]:
    """(cost, audit, plan) of one conversation given as one character per row.

    ``plan`` has an entry for each repaired message: 3 * row + 0 (own role), 1 (user) or 2
    (assistant); inserted messages have the row number ``len(codes)``.
    """
    cost, take = _choices(codes, block)
    audit, plan, row, state = [], [], 0, START
    while chosen := take[STATES * row + state]:
        letter, _, step, to = ARCS[codes[row] if row < len(codes) else ""][state][chosen - 1]
        audit.append(letter)
        if letter != DELETE:
            plan.append(3 * (row if step else len(codes)) + (0 if letter == KEEP else 1 if to == USER else 2))
        row, state = row + step, to
    return cost, "".join(audit), plan


_remembered = lru_cache(_MEMO)(repair_codes)


def _repaired(codes: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in codes:
        found = [_remembered(c) if len(c) <= 64 else repair_codes(c) for c in batch.to_pylist()]
        yield pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()),
             pa.array([f[2] for f in found], pa.list_(pa.int32()))], names=["cost", "audit", "plan"])


def _last(text: Column) -> Column:
    """Last character that is not blank; empty if there is none."""
    return F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): rows damaged by crc32 of ``conv_id:turn`` mod 20; lost rows are only marked."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("lost"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def repair(conversations: DataFrame, lost: Column | None = None) -> DataFrame:
    """One row per conv_id: counts of the faults, cost, audit and the repaired messages.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    messages array<struct<role,text>>. ``lost`` marks rows that take no part but name their conversation.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.lit(False) if lost is None else F.coalesce(lost, F.lit(False))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"),
                                text("text").alias("text"), gone.alias("gone"))
    known = F.col("turn").isNotNull()
    # one exchange on conv_id serves the window and the aggregate; equal rows of a turn are interchangeable
    seen = Window.partitionBy("conv_id", "role", "text").orderBy("gone", known, "turn")
    end = _last(F.col("text"))
    initial = F.left("role", F.lit(1))
    fault = (F.when(end == "", "blank").when(F.col("copy") > 1, "duplicate")
             .when(~end.isin(".", "!", "?"), "truncated").otherwise(""))
    judged = (rows.repartition("conv_id").withColumn("copy", F.row_number().over(seen))
              .withColumn("initial", initial).withColumn("fault", fault))
    row = F.struct(known.alias("known"), "turn", "role", "text", "copy", "initial", "fault")
    whole = judged.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(~F.col("gone"), row))).alias("rows"))
    # one character per row: x must go; initial, or o if it has no place in the pattern; upper case if truncated
    code = lambda r: F.when(r["fault"].isin("blank", "duplicate"), "x").otherwise(
        F.when(r["fault"] == "truncated", F.upper(_place(r["initial"]))).otherwise(_place(r["initial"])))
    best = arrow_udf(_repaired, "cost long, audit string, plan array<int>")
    solved = whole.withColumn("codes", F.array_join(F.transform("rows", code), "")).withColumn("best", best("codes"))

    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    count = lambda kind: F.size(F.filter("rows", lambda r: r["fault"] == kind)).cast("long").alias(kind)
    pairs = F.zip_with(F.slice("rows", 1, F.greatest(F.size("rows") - 1, F.lit(0))), F.slice("rows", 2, F.size("rows")),
                       lambda a, b: F.concat(a["initial"], F.lit("|"), b["initial"]))
    message = lambda at: F.struct(
        F.when(at % 3 == 1, "user").when(at % 3 == 2, "assistant").otherwise(F.get("rows", _row(at))["role"]).alias("role"),
        F.when(_row(at) < F.size("rows"), F.get("rows", _row(at))["text"]).otherwise("").alias("text"))
    return solved.select(
        "conv_id",
        F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0)).cast("long").alias("gaps"),
        count("blank"), count("duplicate"), count("truncated"),
        F.size(F.filter(pairs, lambda p: ~p.isin("s|u", "u|a", "a|u"))).cast("long").alias("illegal"),
        F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"),
        F.transform("best.plan", message).alias("messages"))


def _place(initial: Column) -> Column:
    return F.when(initial.isin("s", "u", "a"), initial).otherwise("o")


def _row(at: Column) -> Column:
    return F.floor(at / 3).cast("int")


def transcript(messages: str = "messages") -> Column:
    """``role:text`` of the repaired messages, joined by line ends."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
