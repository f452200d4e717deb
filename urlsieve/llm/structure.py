"""Repairing the turn structure of conversations at least cost, by a (min, +) scan of 4x4 matrices.

States are what stands before a turn: nothing, a system turn, a user turn, an assistant turn. A turn's matrix has, from each
state to each, the cheapest way of inserting turns before it and then keeping, reroling or deleting it, with the letters of
these edits (the audit). Matrices compose associatively, so turns meet in a binary tree: within runs of neighbouring turns of
a conversation first, wherever they are, then runs with runs.

Audits needn't be carried as text. All audits of one matrix have as many turns' letters and end in one, so none is the
beginning of another, and the letters from a given state decide the state after them. So in a product, ways over different
middle states differ already in the left factor, and an element needs only its cost and its audit's rank among those of its
row. Going down the tree again from the best way of the whole conversation gives each turn its states, hence its letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.llm.common import scope, written

START, SYSTEM, USER, ASSISTANT = range(4)
#: How a turn counts in costs.
SOUND, CUT_OFF, GONE = range(3)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: More than any cost.
FAR = 1 << 40
#: Turns in a run; turns, or runs, whose matrices a task holds at once (of a conversation, all runs).
RUN, AT_ONCE = 1 << 14, 1 << 14
#: White space, which alone makes a turn blank, and the ends of a sentence.
SPACES, ENDS = r"\x20\x09-\x0D", ".!?"
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: What may be inserted after a state, and the way to each state by insertions.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What closes a conversation that ends in a state.
CLOSING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _inserted() -> dict[tuple[int, int], tuple[int, ...]]:
    """The turns to insert from a state to another; from a state to itself, none."""
    out = {}
    for state in NEXT:
        at, way = state, ()
        for _ in range(3):
            out.setdefault((state, at), way)
            at = NEXT[at]
            way = (*way, at)
    return out


class Edits:
    """Costs, ranks and edits by kind of turn: its role's state (or START for any other role) times 3, plus how it counts."""

    def __init__(self):
        self.cost = np.full((12, 4, 4), FAR, np.int64)
        self.rank = np.zeros((12, 4, 4), np.int8)
        #: By kind and states before and after: the turns inserted before it, its letter, and its new role's state if it is reroled.
        self.edit: dict[tuple[int, int, int], tuple[tuple[int, ...], str, int]] = {}
        for role, count in product(range(4), range(3)):
            kind = role * 3 + count
            audit = np.full((4, 4), "~", "U8")
            for (state, mid), way in _inserted().items():
                steps = [("D", mid, DELETE)]
                if count != GONE:
                    more = TRUNCATED if count == CUT_OFF else 0
                    steps += [("R", to, REROLE + more) for to in (USER, ASSISTANT) if to == NEXT[mid]]
                    fits = role == SYSTEM and mid == START or role in (USER, ASSISTANT) and role == NEXT[mid]
                    steps += [("K", role, more)] if fits else []
                for letter, to, price in steps:
                    found = (price + INSERT * len(way), "I" * len(way) + letter)
                    if found < (self.cost[kind, state, to], audit[state, to]):
                        self.cost[kind, state, to], audit[state, to] = found
                        self.edit[kind, state, to] = way, letter, to if letter == "R" else 0
            self.rank[kind] = audit.argsort(axis=1).argsort(axis=1)


EDITS = Edits()


class Tree:
    """Products of matrices that stand side by side in a group, by pairs; groups are runs of equal numbers."""

    def __init__(self, cost: np.ndarray, rank: np.ndarray, group: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            n = len(group)
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
            if len(first) == n:
                break
            place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
            left = np.flatnonzero(place % 2 == 0)
            paired = np.append(group[1:] == group[:-1], False)[left]
            a, b = left[paired], left[paired] + 1
            through = cost[a][:, :, :, None] + cost[b][:, None, :, :]
            middle = (through * 4 + rank[a][:, :, :, None]).argmin(axis=2)
            spot = np.arange(len(a))[:, None, None]
            row, column = np.arange(4)[None, :, None], np.arange(4)[None, None, :]
            best = np.minimum(through[spot, row, middle, column], FAR)
            # ways that differ on the left rank by it, others by the right
            order = rank[a][spot, row, middle].astype(np.int16) * 4 + rank[b][spot, middle, column]
            order[best >= FAR] += 16
            new_cost, new_rank = cost[left], rank[left]
            new_cost[paired], new_rank[paired] = best, (order[:, :, None, :] < order[:, :, :, None]).sum(axis=3)
            ways = np.zeros((len(left), 4, 4), np.int8)
            ways[paired] = middle
            self.levels.append((paired, ways))
            cost, rank, group = new_cost, new_rank, group[left]
        self.cost, self.rank = cost, rank

    def down(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States before and after each matrix, from those before and after each group."""
        for paired, ways in reversed(self.levels):
            mid = np.where(paired, ways[np.arange(len(paired)), before, after], after)
            last = np.cumsum(1 + paired)
            new_before, new_after = np.zeros((2, int(last[-1]) if len(last) else 0), np.int8)
            head = last - 1 - paired
            new_before[head], new_after[head] = before, mid
            new_before[last[paired] - 1], new_after[last[paired] - 1] = mid[paired], after[paired]
            before, after = new_before, new_after
        return before, after


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by CRC-32 of `conv_id:turn`, modulo 20.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 sets role user; others stay. A null in
    the key, in a role or in a text counts as one blank.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), (F.crc32(key) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    rows = rows.where("fault != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("col")


def _marked(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, hash, copy, fault, kind): a row per turn, without its text, with its first fault and kind.

    Rows that are equal in all columns, and those that are equal in conversation, role and text, are counted with map-side
    combining; only texts that occur more than once are joined back.
    """
    text = F.col("text")
    blank, cut_off = ~text.rlike(f"[^{SPACES}]"), ~text.rlike(f"[{ENDS}][{SPACES}]*\\z")
    rows = turns.select("conv_id", "turn", "role", F.md5(text).alias("hash"), blank.alias("blank"), cut_off.alias("cut_off"))
    rows = rows.groupBy("conv_id", "turn", "role", "hash", "blank", "cut_off").agg(F.count("*").cast("int").alias("n"))
    time = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy("conv_id", "role", "hash").agg(F.min(time).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    first = first.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("hash").alias("_hash"), "first")
    same = rows["conv_id"].eqNullSafe(F.col("_conv")) & (rows["role"] == F.col("_role")) & (rows["hash"] == F.col("_hash"))
    later = F.coalesce(time > F.col("first"), F.lit(False))
    rows = rows.join(first, same, "left").withColumn("later", later).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    fault = F.when(F.col("blank"), "blank").when(F.col("later") | (F.col("copy") > 1), "duplicate").when(F.col("cut_off"), "truncated")
    rows = rows.select("conv_id", "turn", "role", "hash", "copy", fault.alias("fault"))
    first_letter = F.substring("role", 1, 1)
    role = F.when(first_letter == "s", SYSTEM).when(first_letter == "u", USER).when(first_letter == "a", ASSISTANT).otherwise(START)
    count = F.when(F.col("fault") == "truncated", CUT_OFF).when(F.col("fault").isNotNull(), GONE).otherwise(SOUND)
    return rows.withColumn("kind", (role * 3 + count).cast("int"))


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("hash").asc(), F.col("copy").asc()]


def _numbered(rows: DataFrame, run: int) -> DataFrame:
    """Rows in order, with the run that each is in and its place in it; runs are numbered in order and end with a conversation or a task."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, place = (TaskContext.get().partitionId() << 32) - 1, object(), 0
        for batch in batches:
            conv = batch.column(0).to_pylist()
            runs, places = np.empty(len(conv), np.int64), np.empty(len(conv), np.int32)
            for k, c in enumerate(conv):
                if c != last or place + 1 == run:
                    at, last, place = at + 1, c, -1
                place += 1
                runs[k], places[k] = at, place
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs), pa.array(places)], [*batch.schema.names, "run", "place"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *_order()).sortWithinPartitions(*_order()).mapInArrow(number, kinds + ", run long, place int")


def _groups(batches: Iterator[pa.RecordBatch], size: int, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of about `size` at once; with `whole`, never a conversation (the first column) in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            every = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            upto = every.num_rows
            if whole:
                conv = every.column(0).to_pylist()
                while upto and conv[upto - 1] == conv[-1]:
                    upto -= 1
            if upto:
                yield every.slice(0, upto)
            held = [every.slice(upto)] if upto < every.num_rows else []
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _kinds_of(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """The turns' kinds of all runs of a batch, and each turn's run."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _elements(runs: DataFrame, conv: str) -> DataFrame:
    """(conv_id, run, cost, rank): each run's matrix."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_turns(batch):
                kinds, group = _kinds_of(part, 2)
                tree = Tree(EDITS.cost[kinds], EDITS.rank[kinds], group)
                flat = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.int64)), 16).cast(pa.list_(pa.int64())) for x in (tree.cost, tree.rank)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *flat], ["conv_id", "run", "cost", "rank"])

    return runs.select("conv_id", "run", "kinds").mapInArrow(reduce, f"conv_id {conv}, run long, cost array<long>, rank array<long>")


def _by_turns(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices with about AT_ONCE turns, the third column being runs' turns."""
    ends = np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def _states(elements: DataFrame, conv: str) -> DataFrame:
    """(run, before, after, closing, total): the states around each run on its conversation's best way, what is inserted after it, and the cost."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing = np.array([INSERT * len(CLOSING[s]) for s in range(4)])
        for part in _groups(batches, AT_ONCE, whole=True):
            convs = part.column(0).to_pylist()
            group = np.cumsum([k == 0 or c != convs[k - 1] for k, c in enumerate(convs)]) - 1
            cost, rank = (part.column(c).flatten().to_numpy().reshape(-1, 4, 4) for c in (2, 3))
            tree = Tree(cost, rank.astype(np.int8), group)
            total = tree.cost[:, START] + closing
            after = (total * 4 + tree.rank[:, START]).argmin(axis=1)
            before, states = tree.down(np.zeros(len(after), np.int8), after.astype(np.int8))
            last = np.append(group[1:] != group[:-1], True)
            added = [",".join(NAMES[x] for x in CLOSING[int(s)]) if z else "" for s, z in zip(states, last, strict=True)]
            least = total[np.arange(len(after)), after][group]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(before.astype(np.int32)), pa.array(states.astype(np.int32)), pa.array(added), pa.array(least)], ["run", "before", "after", "closing", "total"])

    parts = int(elements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = elements.repartition(parts, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "run")
    return rows.mapInArrow(solve, "run long, before int, after int, closing string, total long")


def _letters(runs: DataFrame) -> DataFrame:
    """(run, edits, closing, total): an edit per turn, as a letter for its kind and states: see _edit_of()."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_turns(batch):
                kinds, group = _kinds_of(part, 2)
                tree = Tree(EDITS.cost[kinds], EDITS.rank[kinds], group)
                before, after = tree.down(*(part.column(c).to_numpy().astype(np.int8) for c in (3, 4)))
                codes = (kinds.astype(np.int32) * 16 + before * 4 + after).astype(np.int32)
                edits = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(group, minlength=part.num_rows))).astype(np.int32)), pa.array(codes))
                yield pa.RecordBatch.from_arrays([part.column(1), edits, part.column(5), part.column(6)], ["run", "edits", "closing", "total"])

    rows = runs.select("conv_id", "run", "kinds", "before", "after", "closing", "total")
    return rows.mapInArrow(spell, "run long, edits array<int>, closing string, total long")


def _edit_of(code: Column) -> tuple[Column, Column, Column]:
    """The roles inserted before a turn, its letter and its new role if it is reroled, by kind * 16 + state before * 4 + state after."""
    entries = sorted((kind * 16 + i * 4 + j, ",".join(NAMES[x] for x in way), letter, NAMES.get(to, "")) for (kind, i, j), (way, letter, to) in EDITS.edit.items())
    tables = [F.create_map(*[F.lit(x) for e in entries for x in (e[0], e[c])]) for c in (1, 2, 3)]
    return tables[0][code], tables[1][code], tables[2][code]


def repair(turns: DataFrame, run: int = RUN) -> DataFrame:
    """A row per turn, a written table: conv_id, turn, role, text, fault, inserted, edit, new_role, closing, cost, run, place.

    Columns conv_id, turn, role and text are read; the last two must not be null. fault: blank, duplicate (of an earlier turn
    of the conversation, by role and text), truncated, or null. edit: K, R or D (keep, rerole, delete); inserted: the roles of
    empty turns before it, joined by commas, closing those after it; cost: the conversation's. Turns stand in order of turn
    (null first), role, the text's MD5 and copy, which is the order of run and place. Texts are equal if their MD5 is. A null
    conv_id is a conversation of its own. Repeated rows are turns of their own. An empty table gives no rows.

    Texts take no part in ordering and scanning. A conversation may be in many tasks, of runs of up to `run` turns; what one
    task sees of a whole conversation is 300 bytes a run.
    """
    conv = turns.schema["conv_id"].dataType.simpleString()
    with scope(turns.sparkSession) as keep:
        rows = written(_numbered(_marked(turns), run), "turns")
        kinds = F.transform(F.sort_array(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"])
        runs = written(rows.groupBy("conv_id", "run").agg(kinds.alias("kinds")), "runs")
        states = _states(_elements(runs, conv), conv)
        letters = written(_letters(runs.join(states, "run")), "letters")
        rows = rows.join(letters, "run")
        inserted, edit, new_role = _edit_of(F.get("edits", F.col("place")))
        closing = F.when(F.col("place") == F.size("edits") - 1, F.col("closing")).otherwise("")
        rows = rows.select("conv_id", "turn", "role", "hash", "copy", "fault", inserted.alias("inserted"), edit.alias("edit"), new_role.alias("new_role"), closing.alias("closing"), F.col("total").alias("cost"), "run", "place")
        key = [F.col(c).alias(f"_{c}") for c in ("conv_id", "turn", "role")]
        texts = turns.select(*key, F.md5("text").alias("_hash"), "text").dropDuplicates(["_conv_id", "_turn", "_role", "_hash"])
        same = rows["conv_id"].eqNullSafe(F.col("_conv_id")) & rows["turn"].eqNullSafe(F.col("_turn")) & (rows["role"] == F.col("_role")) & (rows["hash"] == F.col("_hash"))
        out = rows.join(texts, same).select("conv_id", "turn", "role", "text", "fault", "inserted", "edit", "new_role", "closing", "cost", "run", "place")
        return keep(written(out, "repaired"))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row per conversation of repair()'s rows.

    A SHA-256 goes from turn to turn, so a conversation's turns pass through one task, one at a time.
    """
    conv = repaired.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last, one = object(), None
        for batch in batches:
            schema = pa.schema([pa.field("conv_id", batch.schema.field(0).type), *((n, pa.int64()) for n in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last or one is None:
                    if one:
                        out.append((last, *one.result()))
                    last, one = row[0], Digest()
                one.add(*row[1:])
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out = []
        if one:
            out.append((last, *one.result()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    parts = int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = repaired.repartition(parts, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "run", "place")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "fault", "inserted", "edit", "new_role", "closing", "cost")
    kinds = ", ".join([f"conv_id {conv}", *(f"{n} long" for n in COUNTS), "audit string", "repaired_sha256 string"])
    return rows.mapInArrow(digest, kinds)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Digest:
    """What digests() says of one conversation, from its turns in order."""

    def __init__(self):
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.low = self.high = self.initial = None
        self.distinct = self.illegal = self.cost = self.lines = 0
        self.audit: list[str] = []
        self.hash = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.hash.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
        self.lines += 1

    def add(self, turn, role, text, fault, inserted, edit, new_role, closing, cost) -> None:
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial, self.cost = role[:1], cost
        if fault:
            self.counts[fault] += 1
        for r in filter(None, inserted.split(",")):
            self.audit.append("I")
            self._line(r, "")
        self.audit.append(edit)
        if edit != "D":
            self._line(new_role if edit == "R" else role, text)
        for r in filter(None, closing.split(",")):
            self.audit.append("I")
            self._line(r, "")

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    with scope(spark) as keep:
        found = digests(repair(damage(turns))).withColumnRenamed("conv_id", "_conv_id")
        every = turns.select("conv_id").distinct()
        empty = {c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in COUNTS}
        rows = every.join(found, every["conv_id"].eqNullSafe(F.col("_conv_id")), "left")
        audit, digest = F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
        return keep(written(rows.select("conv_id", *empty.values(), audit, digest), "structure"))


def _sql() -> str:
    def more(x: str, letter: str, price: str, line: str | None) -> str:
        text = f"{x}.t || chr(10) || {line}" if line else f"{x}.t"
        return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {price}, 'a': {x}.a || '{letter}', 't': {text}}} END"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    # after insertions: s0 and s1 as they are, then a user turn, then an assistant turn
    u = least("s2", *[more(x, "I", "2", "'user:'") for x in ("s0", "s1", "s3")])
    closed = f"SELECT *, {least('s3', more('u', 'I', '2', "'assistant:'"))} AS w FROM (SELECT *, {u} AS u FROM p)"
    gone = "coalesce(r.kind, '') IN ('blank', 'duplicate')"
    cut = "CASE WHEN r.kind = 'truncated' THEN 1 ELSE 0 END"

    def kept(x: str, to: str, name: str) -> list[str]:
        keep = f"CASE WHEN NOT {gone} AND r.first = '{to}' THEN {more(x, 'K', cut, "r.role || ':' || r.text")} END"
        change = f"CASE WHEN NOT {gone} THEN {more(x, 'R', '2 + ' + cut, f"'{name}:' || r.text")} END"
        return [keep, change] if name else [keep]

    steps = {
        "s0": [more("s0", "D", "3", None)],
        "s1": [more("s1", "D", "3", None), *kept("s0", "s", "")],
        "s2": [more("u", "D", "3", None), *[k for x in ("s0", "s1", "w") for k in kept(x, "u", "user")]],
        "s3": [more("w", "D", "3", None), *kept("u", "a", "assistant")],
    }
    stepped = ", ".join(f"{least(*options)} AS {name}" for name, options in steps.items())
    byte = "lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    crc = f"lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], {byte})"
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c))::BIGINT[] AS b FROM conversations),
f AS (SELECT *, xor(list_reduce([4294967295]::BIGINT[] || b, {crc}), 4294967295) % 20 AS fault FROM k),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE fault <> 0),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
r AS (SELECT *, left(role, 1) AS first, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS kind,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM i),
p AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM r
  UNION ALL SELECT r.conv_id, r.i, {stepped} FROM ({closed}) x JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = x.i + 1),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(kind = 'blank') AS blank,
    count_if(kind = 'duplicate') AS duplicate, count_if(kind = 'truncated') AS truncated,
    count_if(before IS NOT NULL AND before || first NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
e AS (SELECT x.conv_id, {least('s0', 'w')} AS best FROM ({closed}) x JOIN n ON n.conv_id IS NOT DISTINCT FROM x.conv_id AND n.n = x.i),
o AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(n.duplicate, 0)::BIGINT AS duplicate,
  coalesce(n.truncated, 0)::BIGINT AS truncated, coalesce(n.illegal, 0)::BIGINT AS illegal, coalesce(e.best.c, 0)::BIGINT AS cost,
  coalesce(e.best.a, '') AS audit, sha256(coalesce(substr(e.best.t, 2), '')) AS repaired_sha256
FROM o LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL = _sql()
