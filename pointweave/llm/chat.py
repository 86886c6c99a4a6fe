"""Chat formatting with minimum-cost role repair.

Legal conversations are those an automaton accepts: an optional system turn, then user and assistant turns by turns,
the last one by the assistant. Dynamic programming over the automaton finds the cheapest mixture of keeping a turn,
merging it into the one before, relabelling it and inserting empty turns. Costs of a run of turns form a matrix between
the automaton's states under (min, +), so a conversation of any length is cut in segments: each segment gives its
matrix, the few matrices are chained, and each segment is repaired between the two states found for it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, shuffle_partitions, table

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the role of the last turn written.
STATES = ("start", *ROLES)
#: (from, to) pairs that the automaton allows without an insertion.
LEGAL = {("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
MERGE, RELABEL, INSERT, UNKNOWN = 1.0, 2.0, 3.0, 0.5
#: Turns that one segment spans at most, and bytes of their texts unless one turn is longer.
SEGMENT, SEGMENT_BYTES = 4096, 1 << 22
#: Ids of longer conversations that are broadcast at most.
BROADCAST_LONG = 1_000_000
CHATML = "<|im_start|>{role}\n{text}<|im_end|>\n"


def _insertions() -> dict[tuple[str, str], list[str]]:
    """Shortest list of empty turns that leads from a state to writing a role."""
    found = {}
    for a in STATES:
        paths, seen = [(a, [])], {a}
        while paths:
            state, put = paths.pop(0)
            for b in ROLES:
                if (state, b) in LEGAL:
                    found.setdefault((a, b), put)
                    if b not in seen:
                        seen.add(b)
                        paths.append((b, [*put, b]))
    return found


INSERTIONS = _insertions()


def step_options(role: str | None) -> list[tuple[int, int, float, str, str]]:
    """(from state, to state, cost, action, role written) for one turn."""
    options = []
    known = role in ROLES
    for a, state in enumerate(STATES):
        if state != "start":
            cost = MERGE if role == state else MERGE + (RELABEL if known else UNKNOWN)
            options.append((a, a, cost, "merge", state))
        for new in ROLES:
            if (state, new) not in INSERTIONS:
                continue
            cost = 0.0 if role == new else RELABEL if known else UNKNOWN
            cost += INSERT * len(INSERTIONS[state, new])
            options.append((a, STATES.index(new), cost, "keep" if role == new else "relabel", new))
    return options


OPTIONS = {r: step_options(r) for r in (*ROLES, None)}
END_COST = [
    0.0 if s == "assistant" else INSERT * (len(INSERTIONS[s, "assistant"]) + 1) if s != "start" else 0.0 for s in STATES
]


def matrix(roles: list[str | None]) -> np.ndarray:
    """Least cost of writing the turns from each state to each state."""
    k = len(STATES)
    best = np.where(np.eye(k, dtype=bool), 0.0, np.inf)
    for role in roles:
        step = np.full((k, k), np.inf)
        for a, b, cost, _, _ in OPTIONS[role if role in ROLES else None]:
            step[a, b] = min(step[a, b], cost)
        best = (best[:, :, None] + step[None]).min(1)
    return best


def repair(roles: list[str | None], start: int, end: int) -> list[tuple[str, str, list[str]]]:
    """(action, role, roles of empty turns before it) for each turn, at least cost from start to end.

    Among equal costs the first option in the order of OPTIONS wins.
    """
    k = len(STATES)
    cost = np.full(k, np.inf)
    cost[start] = 0
    back = []
    for role in roles:
        new, how = np.full(k, np.inf), [None] * k
        for a, b, c, action, written in OPTIONS[role if role in ROLES else None]:
            if cost[a] + c < new[b]:
                new[b], how[b] = cost[a] + c, (a, action, written)
        back.append(how)
        cost = new
    out, state = [], end
    for how in reversed(back):
        a, action, written = how[state]
        out.append((action, written, INSERTIONS[STATES[a], written] if action != "merge" else []))
        state = a
    return out[::-1]


def cut_segments(turns: DataFrame, segment: int) -> DataFrame:
    """(conv_id, role, text, segment, place): turns in order, cut in segments that one task can hold.

    Turns are in the order of turn, nulls first, ties by a hash of role and text. A conversation of up to so many rows and
    SEGMENT_BYTES of text is one segment. Longer ones are numbered over range partitions, by running sums of the
    partitions' rows and bytes, and cut wherever either passes a multiple of its bound: the same cuts whatever the
    partitions, and no conversation is in one task.
    """
    spark = turns.sparkSession
    order = ["turn", "text_key"]
    slim = turns.select(
        "conv_id", "turn", F.lower(F.trim("role")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("role", "text").alias("text_key"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"),
    )
    sizes = slim.groupBy("conv_id").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))
    long = materialize(sizes.where((F.col("rows") > segment) | (F.col("bytes") > SEGMENT_BYTES)).select(F.col("conv_id").alias("_long")))
    few, same = broadcast_if_small(long, BROADCAST_LONG), F.col("conv_id").eqNullSafe(F.col("_long"))
    columns = ["conv_id", "role", "text", "segment", "place"]
    place = (F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)) - 1).cast("long")
    short = slim.join(few, same, "left_anti").withColumns({"place": place, "segment": F.lit(0).cast("long")}).select(*columns)
    if long.isEmpty():
        return short
    ranged = slim.join(few, same, "left_semi").repartitionByRange(shuffle_partitions(spark), "conv_id", *order)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("rows"), F.sum("bytes").alias("size"))
    # a row for each conversation in each partition
    offsets = total.select(
        F.col("conv_id").alias("_conv_id"), F.col("part").alias("_part"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size"),
    )
    met = ranged.join(offsets, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("part") == F.col("_part")))
    within = Window.partitionBy("conv_id", "part").orderBy(*order)
    met = met.withColumn("place", F.col("rows") + F.row_number().over(within) - 1)
    met = met.withColumn("first", F.col("size") + F.sum("bytes").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes"))
    cut = F.expr(f"place div {segment} + first div {SEGMENT_BYTES}")
    return short.unionAll(met.withColumn("segment", cut).select(*columns))


def chain(rows):
    """(conv_id, segment, piece, state before, state after, last, cost of the conversation) of its segments."""
    k = len(STATES)
    steps = [np.array(r[2]).reshape(k, k) for r in rows]
    cost = np.full(k, np.inf)
    cost[0] = 0
    seen = [cost]
    for m in steps:
        seen.append((seen[-1][:, None] + m).min(0))
    final = seen[-1] + np.array(END_COST)
    ends = [int(np.argmin(final))]
    for before, m in zip(reversed(seen[:-1]), reversed(steps), strict=True):
        ends.append(int(np.argmin(before + m[:, ends[-1]])))
    ends = ends[::-1]
    return [(*r[:2], i, ends[i], ends[i + 1], int(i == len(rows) - 1), float(final.min())) for i, r in enumerate(rows)]


def render(roles, texts, start: int, end: int, last: bool, template: str) -> tuple[str, int, int]:
    """A segment's text, turns written and repairs. A turn is closed by the next one, or at the end by the last segment."""
    before, after = template.split("{text}")
    opening = lambda role: before.replace("{role}", role)
    out, turns, repairs = [], 0, 0
    open_ = STATES[start] != "start"
    for (action, role, inserted), text in zip(repair(roles, start, end), texts, strict=True):
        repairs += (action != "keep") + len(inserted)
        if action == "merge":
            out += ["\n", text]
            continue
        out += [after] if open_ else []
        out += [opening(r) + after for r in inserted]
        out += [opening(role), text]
        turns, open_ = turns + 1 + len(inserted), True
    if last:
        final = STATES[end]
        closing = [] if final in ("assistant", "start") else [*INSERTIONS[final, "assistant"], "assistant"]
        out += [after] if open_ else []
        out += [opening(r) + after for r in closing]
        turns, repairs = turns + len(closing), repairs + len(closing)
    return "".join(out), turns, repairs


ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
}


def by_group(df: DataFrame, keys: list[str], order: list[str], work, schema: str) -> DataFrame:
    """The rows that work(rows of one group, in order) returns for each group of df.

    Groups lie together after one shuffle and a sort inside partitions; they stream through the task one at a time.
    """
    at = [df.columns.index(k) for k in keys]
    fields = pa.schema([(name, ARROW[kind]) for name, kind in (f.strip().split(" ", 1) for f in schema.split(","))])

    def run(batches):
        def batch_of(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

        key, held, done = None, [], []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (k := tuple(row[i] for i in at)) != key:
                    done += work(held)
                    held = []
                    if len(done) >= 5000:
                        yield batch_of(done)
                        done = []
                key = tuple(row[i] for i in at)
                held.append(row)
        done += work(held) if held else []
        if done:
            yield batch_of(done)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def format_chat(turns: DataFrame, template: str = CHATML, segment: int = SEGMENT) -> DataFrame:
    """Pieces of each repaired conversation: conv_id, piece, turns, cost, repairs and rendered.

    The rendered texts of a conversation's pieces, in order, are the conversation; one of up to segment turns and
    SEGMENT_BYTES of text is one piece, so no row grows with a conversation, and pieces are the same on any number of
    partitions. cost is that of the whole conversation. A
    merged turn follows the one before after a line break. Roles are compared without case and outer blanks; null and
    unknown roles fit any role at a small cost. Null texts are empty. Rows without conv_id are one conversation.
    Repeated rows are turns of their own. An empty table gives no rows. Columns other than conv_id, turn, role and text
    are ignored.
    """
    conv = dict(turns.dtypes)["conv_id"]
    key = ["conv_id", "segment"]
    # written once: the turns of a segment meet its states again below
    placed = materialize(cut_segments(turns.select("conv_id", "turn", "role", "text"), segment))

    def matrices(rows):
        return [(*rows[0][:2], [float(x) for x in matrix([r[2] for r in rows]).ravel()])]

    def rewrite(rows):
        *_, piece, start, end, last, cost = rows[0]
        text, turns, repairs = render([r[2] for r in rows], [r[4] for r in rows], start, end, bool(last), template)
        return [(rows[0][0], piece, turns, cost, repairs, text)]

    found = by_group(
        placed.select(*key, "role", "place"), key, ["place"], matrices,
        f"conv_id {conv}, segment bigint, m array<double>",
    )
    states = by_group(
        found, ["conv_id"], ["segment"], chain,
        f"conv_id {conv}, segment bigint, piece bigint, a int, b int, last int, cost double",
    )
    states = states.withColumnsRenamed({c: f"_{c}" for c in key})
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id"))
    met = placed.join(states, same & (F.col("segment") == F.col("_segment")))
    return by_group(
        met.select(*key, "role", "place", "text", "piece", "a", "b", "last", "cost"), key, ["place"], rewrite,
        f"conv_id {conv}, piece bigint, turns int, cost double, repairs int, rendered string",
    )


def op6_chat_repair(spark, sf_dir) -> DataFrame:
    return format_chat(table(spark, sf_dir, "conversations"))
