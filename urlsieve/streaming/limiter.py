"""A token bucket per client, over a table or a stream. Denied requests write their state back, too."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.functions import values as V
from urlsieve.sources import folders

OUT = "client string, event_id long, ts timestamp, allowed boolean, retry_after int"


def step(tokens: float, at: float, now: float, capacity: int, rate: float) -> tuple[float, bool, int | None]:
    """Tokens after a request at `now`, whether it may pass, and else the whole seconds to wait."""
    tokens = min(float(capacity), tokens + max(0.0, now - at) * rate)
    if tokens >= 1:
        return tokens - 1, True, None
    return tokens, False, math.ceil((1 - tokens) / rate)


def _recent(batches: Iterator[pa.RecordBatch], most: int, order: OrderedDict[str | None, None], held: list | None) -> None:
    """Goes through rows (block, client, ...) in order, keeping the `most` clients of latest rows; notes in held which rows' clients it lacked."""
    for b in batches:
        for name in b.column(1).to_pylist():
            known = name in order
            if held is not None:
                held.append(not known)
            order[name] = None
            order.move_to_end(name)
            if len(order) > most:
                order.popitem(last=False)


def forgotten(events: DataFrame, most: int, client: str = "user_id", parts: int | None = None) -> DataFrame:
    """client, event_id, ts and fresh of every event: whether a store of the `most` clients seen last has no bucket for its client.

    That is so where a client is new, or `most` others were seen since its last event, in order of time and event id. Events
    are cut by time into blocks. What the store holds after a block depends on its latest clients and, where they are fewer
    than `most`, on the store before it; so each block gives its latest clients, one task goes through these, at most `most` a
    block, and each block then starts from its own store. Blocks should hold many times `most` events.
    """
    spark = events.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(F.col(client).cast("string").alias("client"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    path = folders.fresh(spark, "blocks")
    rows.repartitionByRange(n, "ts", "event_id").select(F.spark_partition_id().alias("block"), "client", "event_id", "ts").write.parquet(path)
    rows = spark.read.parquet(path)

    def latest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, order = None, OrderedDict()

        def out() -> pa.RecordBatch:
            names = list(order)
            return pa.RecordBatch.from_arrays([pa.array([block] * len(names), pa.int32()), pa.array(names, pa.string()), pa.array(range(len(names)), pa.int32())], ["block", "client", "place"])

        for b in batches:
            ids = b.column(0).to_numpy()
            for s, z in _runs(ids):
                if ids[s] != block:
                    if order:
                        yield out()
                    block, order = int(ids[s]), OrderedDict()
                _recent([b.slice(s, z - s)], most, order, None)
        if order:
            yield out()

    def stores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the store holds before each block, from all blocks' latest clients in order."""
        block, order = None, OrderedDict()
        for b in batches:
            ids = b.column(0).to_numpy()
            for s, z in _runs(ids):
                if ids[s] != block:
                    block = int(ids[s])
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([list(order)], pa.list_(pa.string()))], ["block", "store"])
                _recent([b.slice(s, z - s)], most, order, None)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, order = None, OrderedDict()
        for b in batches:
            ids = b.column(0).to_numpy()
            for s, z in _runs(ids):
                part = b.slice(s, z - s)
                if ids[s] != block:
                    # the first row of a block carries the store
                    block, order = int(ids[s]), OrderedDict.fromkeys(part.column(4)[0].as_py() or ())
                held: list[bool] = []
                _recent([part], most, order, held)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), pa.array(held, pa.bool_())], ["client", "event_id", "ts", "fresh"])

    ordered = rows.repartition(n, "block").sortWithinPartitions("block", "ts", "event_id")
    seen = ordered.select("block", "client").mapInArrow(latest, "block int, client string, place int")
    store = seen.repartition(1).sortWithinPartitions("block", "place").mapInArrow(stores, "block int, store array<string>")
    first = rows.groupBy("block").agg(F.min(F.struct("ts", "event_id")).alias("first")).join(store, "block").select(F.col("block").alias("_block"), "first", "store")
    marked = rows.join(first, (F.col("block") == F.col("_block")) & (F.struct("ts", "event_id") == F.col("first")), "left")
    marked = marked.select("block", "client", "event_id", "ts", "store").repartition(n, "block").sortWithinPartitions("block", "ts", "event_id", F.col("store").isNull())
    return marked.mapInArrow(judge, f"client string, event_id {rows.schema['event_id'].dataType.simpleString()}, ts timestamp, fresh boolean")


def _runs(ids: np.ndarray) -> list[tuple[int, int]]:
    """Where equal neighbours start and end."""
    start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    return list(zip(start.tolist(), np.append(start[1:], len(ids)).tolist(), strict=True)) if len(ids) else []


def batch(events: DataFrame, client: str = "user_id", capacity: int = V.BUCKET_REQUESTS, seconds: float = V.BUCKET_SECONDS, most: int | None = None) -> DataFrame:
    """client, event_id, ts, allowed and retry_after of every event, in order of time and event id per client.

    With `most`, only the buckets of that many clients seen last are kept, see forgotten(); a client that was dropped starts
    with a full one. Clients are dealt to tasks by hash and sorted there; a task streams through its events and holds one
    bucket at a time, so a client of any number of events takes no more memory.
    """
    rate = capacity / seconds
    rows = events.select(F.col(client).cast("string").alias("client"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(False).alias("new"))
    if most is not None:
        rows = forgotten(events, most, client).withColumnRenamed("fresh", "new")
    rows = rows.select("client", "event_id", "ts", F.unix_micros("ts").alias("us"), "new")
    rows = rows.repartition("client").sortWithinPartitions("client", "ts", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens, at, fresh = None, 0.0, 0.0, True
        for b in batches:
            allowed, wait = [], []
            for name, us, new in zip(*(b.column(c).to_pylist() for c in (0, 3, 4)), strict=True):
                now = us / 1e6
                if fresh or new or name != last:
                    last, tokens, at, fresh = name, float(capacity), now, False
                tokens, ok, retry = step(tokens, at, now, capacity, rate)
                at = now
                allowed.append(ok)
                wait.append(retry)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(allowed, pa.bool_()), pa.array(wait, pa.int32())], ["client", "event_id", "ts", "allowed", "retry_after"])

    return rows.mapInArrow(run, OUT)


def stream(events: DataFrame, client: str = "user_id", capacity: int = V.BUCKET_REQUESTS, seconds: float = V.BUCKET_SECONDS, delay: str = "1 minute") -> DataFrame:
    """The same over a stream with a watermark on ts. A bucket idle for a whole window of event time is full again, so its
    state is dropped once the watermark says so, without loss; this bounds the number of buckets where a service would
    drop the least recently used. A request later than another counts at the other's time: time never runs back.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    rate = capacity / seconds

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, at = state.get if state.exists else (float(capacity), None)
        for pdf in frames:
            pdf = pdf.sort_values(["ts", "event_id"])
            allowed, wait = [], []
            for us in pdf.us:
                now = us / 1e6 if at is None else max(at, us / 1e6)
                tokens, ok, retry = step(tokens, now if at is None else at, now, capacity, rate)
                at = now
                allowed.append(ok)
                wait.append(retry)
            yield pd.DataFrame({"client": key[0], "event_id": pdf.event_id, "ts": pdf.ts, "allowed": allowed, "retry_after": pd.array(wait, "Int32")})
        state.update((tokens, at))
        state.setTimeoutTimestamp(max(int((at + seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    ts = F.col("ts").cast("timestamp")
    rows = events.select(F.col(client).cast("string").alias("client"), "event_id", ts.alias("ts")).withWatermark("ts", delay)
    rows = rows.withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("client").applyInPandasWithState(run, OUT, "tokens double, at double", "append", GroupStateTimeout.EventTimeTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed_stream(events: DataFrame, client: str = "user_id", capacity: int = V.BUCKET_REQUESTS, seconds: float = V.BUCKET_SECONDS, delay: str = "1 minute") -> DataFrame:
    """The rows of stream(), with a bucket as a value state and an event-time timer that clears it once it is full again.

    spark.sql.streaming.stateStore.providerClass must name a RocksDB provider. Of one client's requests in a micro-batch, those
    of a frame are put in order, and frames follow one another; time never runs back.
    """
    from pyspark.sql.streaming import StatefulProcessor

    provider = events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if "RocksDB" not in provider:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be such as {ROCKS}")
    rate = capacity / seconds

    class Bucket(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("bucket", "tokens double, at double")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            tokens, at = self.state.get() if self.state.exists() else (float(capacity), None)
            for pdf in rows:
                pdf = pdf.sort_values(["ts", "event_id"])
                allowed, wait = [], []
                for us in pdf.us:
                    now = us / 1e6 if at is None else max(at, us / 1e6)
                    tokens, ok, retry = step(tokens, now if at is None else at, now, capacity, rate)
                    at = now
                    allowed.append(ok)
                    wait.append(retry)
                yield pd.DataFrame({"client": key[0], "event_id": pdf.event_id, "ts": pdf.ts, "allowed": allowed, "retry_after": pd.array(wait, "Int32")})
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.state.update((tokens, at))
            self.handle.registerTimer(max(int((at + seconds) * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.state.clear()
            return iter(())

        def close(self) -> None:
            pass

    ts = F.col("ts").cast("timestamp")
    rows = events.select(F.col(client).cast("string").alias("client"), "event_id", ts.alias("ts")).withWatermark("ts", delay)
    rows = rows.withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("client").transformWithStateInPandas(statefulProcessor=Bucket(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
