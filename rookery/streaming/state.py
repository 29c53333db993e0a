"""Streaming twins of the keyed operators, on transformWithStateInPandas.

Rows of a key wait in state until the watermark passes them, then go through
the machine in (time, seq, rule_pos) order, so a stream gives what the batch
operators give over the same events; rows later than the watermark are dropped
by Spark and counted in its metrics.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import limit_step, seconds

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Ordered(StatefulProcessor):
    """Buffers rows and replays them in order once the watermark is past."""

    ROW = "t long, seq long, rule_pos int, n long, s long, op string"
    STATE = "c long, u long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.ROW)
        self.state = handle.getValueState("state", self.STATE)

    def step(self, state, row):
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for pdf in rows:
            held += list(pdf[["t", "seq", "rule_pos", "n", "s", "op"]].itertuples(index=False, name=None))
        self.rows.put([tuple(x) for x in held])
        self.handle.registerTimer(int(min(h[0] for h in held)) * 1000 + 999)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.rows.get())
        due, rest = [h for h in held if h[0] * 1000 + 999 <= mark], [h for h in held if h[0] * 1000 + 999 > mark]
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for h in due:
            state, emit = self.step(state, h)
            if emit:
                out.append((key[0], h[1], h[2]))
        if state is not None:
            self.state.update(tuple(state))
        if rest:
            self.rows.put(rest)
            self.handle.registerTimer(int(min(h[0] for h in rest)) * 1000 + 999)
        else:
            self.rows.clear()
        yield pd.DataFrame(out, columns=["key", "event_seq", "rule_pos"])

    def close(self) -> None:
        pass


def _processor(mode: str) -> StatefulProcessor:
    class Counter(_Ordered):
        def step(self, state, row):
            return limit_step(state, row[0], row[3], row[4], mode)

    class Bit(_Ordered):
        def step(self, state, row):
            if row[5] in ("set", "unset"):
                return (0, row[0] + row[4] if row[5] == "set" else -1), False
            live = state is not None and row[0] < state[1]
            return (state if state is not None else (0, -1)), live == (row[5] == "isset")

    return Bit() if mode == "xbit" else Counter()


def stateful(df: DataFrame, mode: str, delay: str = "1 minute") -> DataFrame:
    """(key, event_seq, rule_pos) of rows that pass: mode limit, suppress, after or xbit.

    df(key string, event_time, event_seq, rule_pos, n, s, op): n and s are
    count and seconds (for a set, s is its expiry); op is set, unset, isset or
    isnotset for xbit and empty else.
    """
    df.sparkSession.conf.set(*STORE)
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField("event_seq", T.LongType()), T.StructField("rule_pos", T.IntegerType())])
    rows = df.withWatermark("event_time", delay).select("key", "event_time", seconds().alias("t"), F.col("event_seq").cast("long").alias("seq"), F.col("rule_pos").cast("int").alias("rule_pos"), F.col("n").cast("long").alias("n"), F.col("s").cast("long").alias("s"), "op")
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_processor(mode), outputStructType=out, outputMode="Append", timeMode="EventTime")


class _Silence(StatefulProcessor):
    """Last time a host was heard, and whether it is down; a timer at the end of its timeout."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last long, down boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(t) for pdf in rows for t in pdf["t"])
        last, down = tuple(self.state.get()) if self.state.exists() else (None, False)
        out = []
        for t in times:
            if last is not None and t - last >= self.timeout:
                if not down:  # the watermark has not told yet
                    out.append((key[0], last + self.timeout, "down", last))
                out.append((key[0], t, "up", last))
                down = False
            last = t if last is None else max(last, t)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(old))
        if not down:
            self.handle.registerTimer((last + self.timeout) * 1000)
        self.state.update((last, down))
        yield pd.DataFrame(out, columns=["host", "at", "status", "last_seen"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, down = tuple(self.state.get())
        out = [] if down else [(key[0], last + self.timeout, "down", last)]
        self.state.update((last, True))
        yield pd.DataFrame(out, columns=["host", "at", "status", "last_seen"])

    def close(self) -> None:
        pass


def track_clients(events: DataFrame, timeout_minutes: int, delay: str = "1 minute", host: str = "src_ip") -> DataFrame:
    """(host, at, status, last_seen): "down" when nothing is heard for the timeout, "up" when a host that was down is heard again.

    A host goes down when the watermark passes its last event by the timeout,
    or with its next event if that comes first. Rows without a host are left out.
    """
    events.sparkSession.conf.set(*STORE)
    out = T.StructType([T.StructField("host", T.StringType()), T.StructField("at", T.LongType()), T.StructField("status", T.StringType()), T.StructField("last_seen", T.LongType())])
    rows = events.where(F.col(host).isNotNull()).withWatermark("event_time", delay).select(F.col(host).cast("string").alias("host"), "event_time", seconds().alias("t"))
    return rows.groupBy("host").transformWithStateInPandas(statefulProcessor=_Silence(timeout_minutes * 60), outputStructType=out, outputMode="Append", timeMode="EventTime")


def client_windows(events: DataFrame, every: str, delay: str, key: str = "src_ip") -> DataFrame:
    """Tumbling totals of events and message bytes by host, final once the watermark is past."""
    g = events.withWatermark("event_time", delay).groupBy(F.window("event_time", every), key)
    return g.agg(F.count("*").alias("events"), F.sum(F.coalesce(F.length("message"), F.lit(0))).alias("bytes")).select(F.col("window.start").alias("start"), key, "events", "bytes")
