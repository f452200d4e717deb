"""Chat formatting: the cheapest repair of a conversation's roles under an automaton of legal turns, then its rendering.

Legal: perhaps a system turn first, then user and assistant turns in turn, the user's first, the assistant's last. Each
turn may be relabelled, may be merged into the turn before it, and empty turns may be inserted. Costs add up along a
conversation, so the best costs from state to state of a run of turns form a matrix, and runs compose by the (min, +)
product. A conversation is cut into blocks of turns; only the blocks' matrices meet, however long the conversation is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States: what the turn before was.
START, SYSTEM, USER, ASSISTANT = range(4)
FIRST = np.array([0.0, np.inf, np.inf, np.inf])
NAMES = ("", "system", "user", "assistant")
#: What may follow what.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Turn numbers in a block; rows of a block from which it is cut by turn, role and text hash, into parts of about so many.
BLOCK, MANY, PART = 256, 4096, 1024
#: Blocks whose matrices, and blocks whose ways, leave a task at once.
AT_ONCE = 2048
INF = float("inf")


@dataclass(frozen=True)
class Costs:
    merge: float = 1.0
    insert: float = 1.5
    relabel: float = 2.0
    #: A role that is none of the three has no label to keep.
    unknown: float = 0.25


@dataclass(frozen=True)
class Step:
    cost: float
    #: keep or merge, the label, and the states of empty turns inserted before it
    merged: bool
    label: int
    inserted: tuple[int, ...]


def paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest empty turns to insert so that `to` may follow `state`."""
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for state in LEGAL:
        level: list[tuple[int, tuple[int, ...]]] = [(state, ())]
        for _ in range(4):
            after = []
            for at, way in level:
                for to in LEGAL[at]:
                    if (state, to) not in found:
                        found[state, to] = way
                        after.append((to, (*way, to)))
            level = after
    return found


class Repair:
    """The automaton's steps for each role, tabled once."""

    def __init__(self, costs: Costs = Costs()):
        self.costs, way = costs, paths()
        self.steps: dict[tuple[int, int, int], Step] = {}
        for state, role, label in product(range(4), range(4), (SYSTEM, USER, ASSISTANT)):
            price = costs.unknown if role == START else 0.0 if role == label else costs.relabel
            options = [Step(price + costs.merge, True, label, ())] if state == label else []
            if (state, label) in way:
                options.append(Step(price + costs.insert * len(way[state, label]), False, label, way[state, label]))
            if options:
                self.steps[state, role, label] = min(options, key=lambda s: (s.cost, s.merged))
        # [role, from, to]
        self.matrix = np.full((4, 4, 4), INF)
        for (state, role, label), step in self.steps.items():
            self.matrix[role, state, label] = step.cost
        #: What ends a conversation: an assistant turn, or nothing at all.
        self.end = np.array([0.0, 2 * costs.insert, costs.insert, 0.0])

    def block(self, roles: list[int]) -> np.ndarray:
        """Best costs from each state before these turns to each state after them."""
        out = np.where(np.eye(4) > 0, 0.0, INF)
        for r in roles:
            out = (out[:, :, None] + self.matrix[r][None]).min(axis=1)
        return out

    def through(self, best: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Least costs after a block from those before it, and for each state after it the one before; ties go to the lower state."""
        all_ = best[:, None] + matrix
        return all_.min(axis=0), all_.argmin(axis=0).astype(np.uint8).tobytes()

    def way(self, best: np.ndarray, back: list[bytes]) -> tuple[float, list[tuple[int, int]]]:
        """The least cost of a conversation, and the states before and after each block on the way."""
        at = int((best + self.end).argmin())
        cost, out = float((best + self.end)[at]), []
        for b in reversed(back):
            out.append((b[at], at))
            at = b[at]
        return cost, out[::-1]

    def labels(self, roles: list[int], before: int, after: int) -> list[Step]:
        """The steps of a block's turns, from the state before to the state after."""
        best, back = np.full(4, INF), []
        best[before] = 0.0
        for r in roles:
            all_ = best[:, None] + self.matrix[r]
            back.append(all_.argmin(axis=0))
            best = all_.min(axis=0)
        at, out = after, []
        for r, b in zip(reversed(roles), reversed(back), strict=True):
            out.append(self.steps[int(b[at]), r, at])
            at = int(b[at])
        return out[::-1]


def role_code(role: str | None) -> int:
    name = (role or "").strip().lower()
    return NAMES.index(name) if name in NAMES[1:] else START


def head(label: int) -> str:
    return f"<|im_start|>{NAMES[label]}\n"


TAIL = "<|im_end|>\n"
EMPTY = {label: head(label) + TAIL for label in (SYSTEM, USER, ASSISTANT)}


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
    """Runs of rows of equal first column, whatever batches they come in."""
    key, rows = None, []
    for batch in batches:
        for s in range(0, batch.num_rows, 64):
            for row in zip(*(c.to_pylist() for c in batch.slice(s, 64).columns), strict=True):
                if row[0] != key:
                    if rows:
                        yield key, rows
                    key, rows = row[0], []
                rows.append(row)
    if rows:
        yield key, rows


def repair(turns: DataFrame, costs: Costs = Costs(), block: int = BLOCK, many: int = MANY) -> DataFrame:
    """conv_id, turn, role, new_role, action, inserted, cost, rendered; a row per distinct turn.

    Columns conv_id, turn, role and text are read. action: keep, relabel, merge or relabel+merge; inserted: roles of the
    empty turns before it, joined by commas; cost: the whole conversation's. A conversation's repaired text is its rows'
    `rendered` in order of turn, role and the text's XXH64, nulls first; closing empty turns belong to the last row. Rows
    that are equal in all four columns count once. A null or unknown role may become any role. A null text is empty. A
    null conv_id is a conversation of its own, a null turn comes first. Extra columns are ignored.

    Blocks are runs of turn numbers, so that tasks are dealt blocks, not conversations; a block of many rows, such as turns
    that all share one number, is cut further by turn, role and ranges of the text's hash. Copies of a row are dropped with
    map-side combining. Of a conversation only the blocks' matrices meet in one task, which keeps 4 bytes and a key of
    each. An empty table gives no rows.
    """
    fix, spark = Repair(costs), turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = {f.name: f.dataType.simpleString() for f in turns.schema}
    at = F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))).cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), at.alias("block"), "conv_id", "turn", F.col("role").cast("string").alias("role"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = rows.dropDuplicates(["conv", "turn", "role", "th"])
    sizes = rows.groupBy("conv", "block").agg(F.count("*").alias("n")).where(F.col("n") > many)
    bits = F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / (many / MANY * PART)))).cast("int")
    rows = rows.join(sizes.select(F.col("conv").alias("_c"), F.col("block").alias("_b"), bits.alias("bits")), (F.col("conv") == F.col("_c")) & (F.col("block") == F.col("_b")), "left")
    hot = F.col("bits").isNotNull()
    rows = rows.withColumn("t", F.when(hot, F.col("turn"))).withColumn("r", F.when(hot, F.col("role"))).withColumn("b", F.when(hot, F.expr("shiftright(th, 64 - bits)")).otherwise(F.lit(0)).cast("long"))
    name = [F.coalesce(F.col("t").cast("string"), F.lit("-")), F.coalesce(F.concat(F.length("r").cast("string"), F.lit("="), F.col("r")), F.lit("-"))]
    rows = rows.withColumn("key", F.concat_ws(" ", "block", *name, "b", "conv")).select("key", "conv", "block", "t", "r", "b", "conv_id", "turn", "role", "th", "text")
    order = ["key", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "th"]

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, schema = [], None

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], f.type) for c, f in enumerate(schema)], schema=schema)

        for _, group in groups(note(batches, kinds := {})):
            schema = schema or pa.schema([(c, kinds[c]) for c in ("key", "conv", "block", "t", "r", "b")] + [("m", pa.list_(pa.float64()))])
            out.append((*group[0][:6], fix.block([role_code(x[7]) for x in group]).ravel().tolist()))
            if len(out) == AT_ONCE:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("way_key", pa.string()), ("before", pa.int32()), ("after", pa.int32()), ("cost", pa.float64()), ("last", pa.bool_())])

        def flush() -> Iterator[pa.RecordBatch]:
            cost, way = fix.way(best, back)
            for s in range(0, len(keys), AT_ONCE):
                z = min(s + AT_ONCE, len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys[s:z]), pa.array([x for x, _ in way[s:z]], pa.int32()), pa.array([y for _, y in way[s:z]], pa.int32()), pa.array([cost] * (z - s)), pa.array([k == len(keys) - 1 for k in range(s, z)])], schema=kinds)

        conv, best, keys, back = None, FIRST, [], []
        for batch in batches:
            every = np.asarray(batch.column(2).flatten()).reshape(-1, 4, 4)
            for c, key, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), every, strict=True):
                if c != conv:
                    if keys:
                        yield from flush()
                    conv, best, keys, back = c, FIRST, [], []
                best, b = fix.through(best, m)
                keys.append(key)
                back.append(b)
        if keys:
            yield from flush()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches_of(groups(note(batches, kinds := {}))):
            schema = schema or pa.schema([("conv_id", kinds["conv_id"]), ("turn", kinds["turn"]), *((x, pa.string()) for x in ("role", "new_role", "action", "inserted")), ("cost", pa.float64()), ("rendered", pa.string())])
            out = []
            for group in batch:
                before, after, cost, last = group[0][6:]
                steps, state = fix.labels([role_code(r[3]) for r in group], before, after), before
                for row, step in zip(group, steps, strict=True):
                    # a turn is closed by what follows it, so that a merge only adds a line
                    part = "\n" + row[5] if step.merged else (TAIL if state != START else "") + "".join(EMPTY[x] for x in step.inserted) + head(step.label) + row[5]
                    change = "+".join(x for x in ("relabel" if role_code(row[3]) != step.label else "", "merge" if step.merged else "") if x)
                    out.append((row[1], row[2], row[3], NAMES[step.label], change or "keep", ",".join(NAMES[x] for x in step.inserted), cost, part))
                    state = step.label
                if last:
                    add = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,)}.get(state, ())
                    out[-1] = (*out[-1][:7], out[-1][7] + TAIL + "".join(EMPTY[x] for x in add))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], f.type) for c, f in enumerate(schema)], schema=schema)

    slim = rows.drop("text", "conv_id").repartition(parts, "key").sortWithinPartitions(*order)
    blocks = slim.mapInArrow(matrices, f"key string, conv string, block long, t {kind['turn']}, r string, b long, m array<double>")
    line = ["conv", "block", F.col("t").asc_nulls_first(), F.col("r").asc_nulls_first(), "b"]
    way = blocks.repartition(parts, "conv").sortWithinPartitions(*line).select("conv", "key", "m").mapInArrow(ways, "way_key string, before int, after int, cost double, last boolean")
    both = rows.join(way, rows["key"] == way["way_key"]).select("key", "conv_id", "turn", "role", "th", "text", "before", "after", "cost", "last")
    return both.repartition(parts, "key").sortWithinPartitions(*order).mapInArrow(render, f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, new_role string, action string, inserted string, cost double, rendered string")


def note(batches: Iterator[pa.RecordBatch], kinds: dict) -> Iterator[pa.RecordBatch]:
    """The batches; kinds gets the types of their columns."""
    for batch in batches:
        kinds |= {f.name: f.type for f in batch.schema}
        yield batch


def batches_of(found: Iterator[tuple[str, list[tuple]]], rows: int = 4096, size: int = 4 << 20) -> Iterator[list[list[tuple]]]:
    """Groups of about so many rows, or characters of text (their sixth column), at once."""
    held, n, long = [], 0, 0
    for _, group in found:
        held.append(group)
        n += len(group)
        long += sum(len(row[5]) for row in group)
        if n >= rows or long >= size:
            yield held
            held, n, long = [], 0, 0
    if held:
        yield held


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
