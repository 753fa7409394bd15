"""Operator 3: chat formatting with minimum-cost role repair.

A legal conversation has at most one system turn, at its head, then user and
assistant turns in alternation, and ends with the assistant.  An automaton over
the states head, system, user, assistant says so.  Every turn is a 4 x 4 matrix
of costs (from the state before it to the state after it) over the choices keep,
relabel, merge into the turn before, and insert empty turns ahead; the cheapest
path through the matrices, by dynamic programming, is the repair.

Matrices compose in the (min, +) algebra, and composition is associative.  So a
conversation of any length may be cut: turns are range-partitioned by
(conversation, turn), each part sums up the conversations that its borders cut,
the driver chains these few matrices (at most two for each part), and each part
then traces its own turns.  No conversation has to fit in a task.

Of equally cheap repairs the one is taken whose states, compared from the last
turn to the first, come first in the order head, system, user, assistant.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.common import land

HEAD, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ["", "system", "user", "assistant"]
FAR = 1 << 40
MERGE, RELABEL, INSERT = 1, 2, 3
# Other names of the roles.
ALIASES = {"human": "user", "customer": "user", "prompter": "user", "bot": "assistant", "ai": "assistant", "gpt": "assistant", "model": "assistant", "developer": "system"}
OPEN, CLOSE = "<|im_start|>{role}\n", "<|im_end|>\n"
MARK = re.compile(r"<\|(\\*im_(?:start|end)\|>)")
PART_BYTES = 32_000_000  # of text in one part, about

NEXT = {HEAD: [SYSTEM, USER], SYSTEM: [USER], USER: [ASSISTANT], ASSISTANT: [USER]}


def _between() -> dict[tuple[int, int], list[int]]:
    """Fewest states to insert on a legal way from one state to another."""
    found = {}
    for p in range(4):
        ways = [(q, []) for q in NEXT[p]]
        for q, path in ways:  # breadth first, grows while it runs
            if (p, q) not in found:
                found[p, q] = path
                ways += [(r, [*path, q]) for r in NEXT[q] if (p, r) not in found]
    return found


BETWEEN = _between()
ENDING = {q: ([] if q == ASSISTANT else [*BETWEEN[q, ASSISTANT], ASSISTANT]) for q in (SYSTEM, USER, ASSISTANT)}


def role_of(name: str | None) -> int:
    """State of a role name, 0 for a null or unknown one."""
    plain = (name or "").strip().lower()
    plain = ALIASES.get(plain, plain)
    return NAMES.index(plain) if plain in NAMES[1:] else 0


def choice(p: int, q: int, role: int) -> tuple[int, str, list[int]]:
    """Cheapest way to take a turn of that role from state p to state q: cost,
    action, states of the empty turns inserted ahead.  Of two equally cheap ways,
    the turn stays a turn of its own."""
    change = 0 if q == role else RELABEL
    best = (FAR, "", [])
    if q != HEAD and (p, q) in BETWEEN:
        path = BETWEEN[p, q]
        best = (change + INSERT * len(path), "relabel" if change else "keep", path)
    if p == q != HEAD and MERGE + change < best[0]:
        best = (MERGE + change, "merge", [])
    return best


CHOICES = [[[choice(p, q, role) for q in range(4)] for p in range(4)] for role in range(4)]
COSTS = [[[c[0] for c in row] for row in of] for of in CHOICES]
START = [0, FAR, FAR, FAR]
END = [FAR, *(INSERT * len(ENDING[q]) for q in (SYSTEM, USER, ASSISTANT))]


def step(ahead: list[int], cost: list[list[int]]) -> list[int]:
    return [min(ahead[p] + cost[p][q] for p in range(4)) for q in range(4)]


def matrix(roles: list[int]) -> list[list[int]]:
    """Composition of the turns' matrices: a row for each state before them."""
    rows = [[0 if p == q else FAR for q in range(4)] for p in range(4)]
    for r in roles:
        rows = [step(row, COSTS[r]) for row in rows]
    return rows


def trace(roles: list[int], ahead: list[int], last: int) -> list[int]:
    """States before the first turn and after each, on the cheapest way that
    comes in with costs ``ahead`` and goes out in state ``last``."""
    costs = [ahead]
    for r in roles:
        costs.append(step(costs[-1], COSTS[r]))
    states = [last]
    for i in range(len(roles) - 1, -1, -1):
        q, cost = states[-1], COSTS[roles[i]]
        states.append(min(range(4), key=lambda p: (costs[i][p] + cost[p][q], p)))
    return states[::-1]


def best_end(ahead: list[int]) -> int:
    return min(range(4), key=lambda q: (ahead[q] + END[q], q))


def escaped(text: str) -> str:
    """Markers inside a text get a backslash behind ``<|``, and one more where they
    have some, so that no text can forge a turn; taking one away undoes it."""
    return MARK.sub(r"<|\\\1", text)


def rendered(states: list[int], roles: list[int], texts: list[str], ends: bool) -> list[tuple]:
    """final_role, action, inserted, cost and segment of each turn.  A segment
    closes the turn before it; joined in order they are the conversation."""
    out = []
    for i, (role, text) in enumerate(zip(roles, texts)):
        p, q, text = states[i], states[i + 1], escaped(text)
        cost, action, path = CHOICES[role][p][q]
        inserted = [NAMES[x] for x in path]
        if action == "merge":
            segment = "\n" + text
        else:
            segment = (CLOSE if p != HEAD else "") + "".join(OPEN.format(role=x) + CLOSE for x in inserted) + OPEN.format(role=NAMES[q]) + text
        if ends and i == len(roles) - 1:
            closing = [NAMES[x] for x in ENDING[q]]
            cost += INSERT * len(closing)
            inserted += closing
            segment += CLOSE + "".join(OPEN.format(role=x) + CLOSE for x in closing)
        out.append((NAMES[q], action, inserted, cost, segment))
    return out


def _runs(ids: list) -> list[tuple[int, int]]:
    """Bounds of equal neighbours."""
    cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _part_rows(table: pa.Table, columns: list[str]):
    table = table.sort_by("pos")
    return [table.column(c).to_pylist() for c in columns]


def repair(
    spark: SparkSession, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per turn: conv_id, turn, role, final_role, action, inserted, cost,
    segment.

    ``inserted`` lists the roles of empty turns added ahead of this one and, for
    the last turn, behind it; a conversation's costs sum to that of its repair,
    its segments in order to its rendered text.  Null ids form one conversation;
    turns sort by number, nulls first, then by a hash of role and text, then by
    these themselves; a null text is empty; null and unknown roles are relabelled.
    Repeated rows are turns of their own.  Markers inside texts are ``escaped``.  Ids and
    turns must be integers; other columns are ignored.  An empty table gives no rows.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(role_col), F.col(text_col)).alias("tie"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    order = ["conv_id", "turn", "tie", "role", "text"]
    rows = rows.repartitionByRange(parts, "conv_id", "turn", "tie").sortWithinPartitions(*order)
    rows = rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()).drop("tie")
    rows = land(spark, rows, "chat-turns")
    slim = rows.select("part", "pos", "conv_id", "role")

    def borders(table: pa.Table) -> pa.Table:
        ids, names = _part_rows(table, ["conv_id", "role"])
        roles, runs = [role_of(x) for x in names], _runs(ids)
        cut = runs if len(runs) < 3 else [runs[0], runs[-1]]
        return pa.table(
            [pa.array([table.column("part")[0].as_py()] * len(cut), pa.int32()), pa.array([ids[a] for a, _ in cut], pa.int64()),
             pa.array([a == 0 for a, _ in cut]), pa.array([b == len(ids) for _, b in cut]),
             pa.array([sum(matrix(roles[a:b]), []) for a, b in cut], pa.list_(pa.int64()))],
            names=["part", "conv_id", "first", "last", "costs"],
        )

    found = slim.groupBy("part").applyInArrow(borders, "part int, conv_id long, first boolean, last boolean, costs array<long>").collect()
    chains = _chains(sorted(found, key=lambda r: (r["part"], not r["first"])))
    entry: dict[int, list[int]] = {}  # part -> costs with which its first conversation comes in
    leave: dict[int, int] = {}  # part -> state in which its last conversation goes on
    final: dict[int, int] = {}  # part that ends a chain -> state at the end
    for chain in chains:
        ahead = START
        for block in chain:
            if block is not chain[0]:
                entry[block["part"]] = ahead
            c = block["costs"]
            ahead = [min(ahead[p] + c[4 * p + q] for p in range(4)) for q in range(4)]
        final[chain[-1]["part"]] = best_end(ahead)
    if chains:

        def ways(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py()
            ids, names = _part_rows(table, ["conv_id", "role"])
            roles = [role_of(x) for x in names[: _runs(ids)[0][1]]]
            return pa.table([pa.array([part], pa.int32()), pa.array([[trace(roles, entry[part], q)[0] for q in range(4)]], pa.list_(pa.int32()))], names=["part", "of"])

        wanted = slim.where(F.col("part").isin(list(entry)))
        came = {r["part"]: r["of"] for r in wanted.groupBy("part").applyInArrow(ways, "part int, of array<int>").collect()}
        for chain in chains:
            state = final[chain[-1]["part"]]
            for block, before in zip(chain[:0:-1], chain[-2::-1]):
                state = came[block["part"]][state]
                leave[before["part"]] = state

    def traced(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        ids, turn, names, texts = _part_rows(table, ["conv_id", "turn", "role", "text"])
        roles, made = [role_of(x) for x in names], []
        runs = _runs(ids)
        for a, b in runs:
            ahead = entry.get(part, START) if a == 0 else START
            goes_on = b == len(ids) and part in leave
            if goes_on:
                last = leave[part]
            else:
                costs = ahead
                for r in roles[a:b]:
                    costs = step(costs, COSTS[r])
                last = best_end(costs)
            made += rendered(trace(roles[a:b], ahead, last), roles[a:b], texts[a:b], not goes_on)
        final_role, action, inserted, cost, segment = zip(*made)
        return pa.table(
            [pa.array(ids, pa.int64()), pa.array(turn, pa.int64()), pa.array(names, pa.string()), pa.array(final_role), pa.array(action),
             pa.array(inserted, pa.list_(pa.string())), pa.array(cost, pa.int64()), pa.array(segment)],
            names=["conv_id", "turn", "role", "final_role", "action", "inserted", "cost", "segment"],
        )

    return rows.groupBy("part").applyInArrow(
        traced, "conv_id long, turn long, role string, final_role string, action string, inserted array<string>, cost long, segment string"
    )


def _chains(blocks: list) -> list[list]:
    """Conversations that go over a part's end, as lists of their blocks."""
    chains, open_ = [], None
    for block in blocks:
        if open_ and block["first"] and block["conv_id"] == open_[-1]["conv_id"]:
            open_.append(block)
        else:
            if open_ and len(open_) > 1:
                chains.append(open_)
            open_ = None
        if block["last"]:
            if not (open_ and open_[-1] is block):
                open_ = [block]
        elif open_ and open_[-1] is block:
            chains.append(open_)
            open_ = None
    if open_ and len(open_) > 1:
        chains.append(open_)
    return chains
