"""Keyed, time-expiring operators over finished sets of events, in event time.

Rows are ordered by (event_time, event_seq, rule_pos). Rate control keeps one
counter a key; bits are named records that expire. Everything is partitioned by
the key, so no state is shared between partitions; running() also cuts a key's
rows by time, so that a key of a third of all rows is many tasks' work.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import to_seconds

ORDER = ("event_time", "event_seq", "rule_pos")


def seconds(c: Column | str = "event_time") -> Column:
    """Whole epoch seconds of a timestamp."""
    return F.floor(F.unix_micros(F.col(c) if isinstance(c, str) else c) / 1_000_000).cast("long")


def limit_step(state, t: int, count: int, secs: int, mode: str):
    """One event of the counter machines: (new state (c, u), emit)."""
    if state is None:
        return (1, t), mode != "after"
    c, u = state
    c += 1
    old = t - u
    if mode == "suppress":
        u = t
        if old > secs:
            c = 1
        return (c, u), c <= count
    if old > secs:
        c, u = 1, t
    if mode == "limit":
        return (c, u), c <= count
    if c > count:
        return (c, t), True
    return (c, u), False


def _fold(mode: str, state_only: bool):
    """One pass over seconds sorted by __k. Those of __c not null give a key's state (c, u) from before.

    Gives the rows of its counter before each second, for seconds in which rows
    may pass; or each key's state at the end. All rows of a second are of one
    window, as no gap is shorter.
    """

    def run(batches):
        now, c, u, known = object(), 0, 0, False
        out: list[tuple] = []
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            key, ts, rows, n, s, old = (batch.column(at[x]).to_pylist() for x in ("__k", "__t", "__rows", "__n", "__s", "__c"))
            keep, before = [], []
            for i, k in enumerate(key):
                t = ts[i]
                if k != now:
                    if state_only and known:
                        out.append((now, c, u))
                    now, known = k, old[i] is not None
                    if known:
                        c, u = old[i], t
                        continue
                    c, u = 0, t
                if not known or t - u > s[i]:
                    c, u, known = 0, t, True
                if mode == "after":
                    if c + rows[i] > n[i]:
                        u = t
                        keep.append(i)
                        before.append(c)
                else:
                    if mode == "suppress":
                        u = t
                    if c < n[i]:
                        keep.append(i)
                        before.append(c)
                c += rows[i]
            if not state_only:
                x = batch.select(["__k", "__t"]).take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(before, pa.int64())], names=["__k", "__t", "__before"])
        if state_only:
            if known:
                out.append((now, c, u))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], names=["k", "c", "u"])

    return run


def _key(keys: list[str]) -> Column:
    return F.concat_ws("\u0001", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))


#: The second of rows without a time, before all others.
_NEVER = -(1 << 62)


def _wide(df, keys, count, secs, order):
    return df.withColumns({"__k": _key(keys), "__t": F.coalesce(seconds(order[0]), F.lit(_NEVER)), "__n": count.cast("long"), "__s": secs.cast("long")})


def _seconds(wide, before):
    """A key's seconds in order, each with its number of rows, after its state from before."""
    each = wide.groupBy("__k", "__t").agg(F.count("*").alias("__rows"), F.first("__n").alias("__n"), F.first("__s").alias("__s")).withColumn("__c", F.lit(None).cast("long"))
    if before is not None:
        each = each.unionByName(before.select(F.col("k").alias("__k"), F.col("u").alias("__t"), F.col("c").alias("__c")), allowMissingColumns=True)
    return each.repartition("__k").sortWithinPartitions("__k", F.col("__c").isNull(), "__t")


def counted(df: DataFrame, keys: list[str], count: Column, secs: Column, mode: str, order: tuple[str, ...] = ORDER, before: DataFrame | None = None) -> DataFrame:
    """Rows that `limit` or `suppress` lets pass or at which `after` fires; windows are anchored at a key's first event.

    count and secs are the same for all rows of a key. The machine looks at its
    own past decisions, which no window function can, but only at whole
    seconds: one pass goes over a key's seconds and their numbers of rows, and
    rows are numbered inside their own second, so that a key of all rows is
    many tasks' work. df is read twice. before(k, c, u): the keys' states from
    earlier batches (counter_state()).
    """
    wide = _wide(df, keys, count, secs, order)
    start = _seconds(wide, before).mapInArrow(_fold(mode, False), "__k string, __t long, __before long")
    n = F.row_number().over(Window.partitionBy("__k", "__t").orderBy(*order))
    total = F.col("__before") + F.col("__i")
    fits = total > F.col("__n") if mode == "after" else total <= F.col("__n")
    return wide.join(start, ["__k", "__t"]).withColumn("__i", n).where(fits).select(df.columns)


def counter_state(df: DataFrame, keys: list[str], count: Column, secs: Column, mode: str, order: tuple[str, ...] = ORDER, before: DataFrame | None = None) -> DataFrame:
    """(k, c, u): each key's state after counted() has seen these rows."""
    return _seconds(_wide(df, keys, count, secs, order), before).mapInArrow(_fold(mode, True), "k string, c long, u long")


#: Seconds of a key's rows that one task goes through in running().
BUCKET = 3600


def running(df: DataFrame, keys: list[str], value: Column, how: str, name: str, order: tuple[str, ...] = ORDER, after: bool = False) -> DataFrame:
    """df with `name`: max, min or sum of a value over the rows of the key before each row (or after it), the row itself left out.

    Rows are cut by time: totals of each BUCKET seconds are carried over the
    buckets, and rows are gone through inside their own.
    """
    agg = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    wide = df.withColumn("__b", F.floor(seconds(order[0]) / BUCKET)).withColumn("__v", value)
    every, inside = Window.partitionBy(*keys).orderBy("__b"), Window.partitionBy(*keys, "__b").orderBy(*order)
    span = (1, Window.unboundedFollowing) if after else (Window.unboundedPreceding, -1)
    total = wide.groupBy(*keys, "__b").agg(agg("__v").alias("__p"))
    total = total.withColumn("__far", agg("__p").over(every.rowsBetween(*span))).drop("__p")
    near = wide.withColumn("__near", agg("__v").over(inside.rowsBetween(*span)))
    both = F.coalesce("__far", F.lit(0)) + F.coalesce("__near", F.lit(0)) if how == "sum" else (F.greatest if how == "max" else F.least)("__far", "__near")
    return near.join(total, [*keys, "__b"]).withColumn(name, both).drop("__b", "__v", "__far", "__near")


def suppress(df: DataFrame, keys: list[str], count: Column, secs: Column, order: tuple[str, ...] = ORDER) -> DataFrame:
    """First `count` rows of each session, sessions ending at gaps of over `secs` seconds."""
    return counted(df, keys, count, secs, "suppress", order)


XKEYS = {"ip_src": ("src_ip",), "ip_dst": ("dst_ip",), "ip_pair": ("src_ip", "dst_ip")}


def xbit_key(track: str) -> Column:
    return F.concat_ws("\u0001", *(F.coalesce(F.col(c), F.lit("")) for c in XKEYS[track]))


def _at(*cols) -> Column:
    """A moment in the order of rows."""
    return F.struct(*(c.alias(n) for c, n in zip(cols, ORDER)))


def _now() -> Column:
    return _at(*map(F.col, ORDER))


def xbit_state(tests: DataFrame, ops: DataFrame) -> DataFrame:
    """tests(id, name, key, event_time, event_seq, rule_pos) with `is_set` and `by` (event_seq of the set).

    ops(name, key, event_time, event_seq, rule_pos, expire): expire in seconds
    for a set, null for an unset. A bit is set while t < set + expire, strictly;
    the last operation before the test counts.
    """
    until = F.when(F.col("expire").isNotNull(), seconds() + F.col("expire")).otherwise(-1)
    both = tests.select("name", "key", *ORDER, F.lit(0).alias("is_op"), F.lit(None).cast("long").alias("until"), "id").unionByName(ops.select("name", "key", *ORDER, F.lit(1).alias("is_op"), until.alias("until"), F.lit(None).cast(tests.schema["id"].dataType).alias("id")))
    last = F.when(F.col("is_op") == 1, F.struct(_now().alias("at"), "until", F.col("event_seq").alias("by")))
    seen = running(both, ["name", "key"], last, "max", "__s", (*ORDER, "is_op"))
    return seen.where("is_op = 0").select("id", "name", "key", *ORDER, F.coalesce(seconds() < F.col("__s.until"), F.lit(False)).alias("is_set"), F.col("__s.by").alias("by"))


def xbit_left(ops: DataFrame) -> DataFrame:
    """The last operation of each bit: all that later batches need."""
    last = F.max(F.struct(*ORDER, "expire")).alias("o")
    return ops.groupBy("name", "key").agg(last).select("name", "key", "o.*")


#: Flexbit directions: pairs (record column, event column) that must agree.
FLEX = {
    "none": (),
    "both": (("src_ip", "src_ip"), ("dst_ip", "dst_ip")),
    "by_src": (("src_ip", "src_ip"),),
    "by_dst": (("dst_ip", "dst_ip"),),
    "reverse": (("src_ip", "dst_ip"), ("dst_ip", "src_ip")),
    "src_xbitdst": (("dst_ip", "src_ip"),),
    "dst_xbitsrc": (("src_ip", "dst_ip"),),
    "username": (("username", "username"),),
}
_PORTS = {"both": (("src_port", "src_port"), ("dst_port", "dst_port")), "by_src": (("src_port", "src_port"),), "by_dst": (("dst_port", "dst_port"),), "reverse": (("src_port", "dst_port"), ("dst_port", "src_port")), "src_xbitdst": (("dst_port", "src_port"),), "dst_xbitsrc": (("src_port", "dst_port"),)}
for _k, _v in _PORTS.items():
    FLEX[_k + "_p"] = FLEX[_k] + _v
_WHO = ("src_ip", "dst_ip", "src_port", "dst_port", "username")


def _who(direction: str, side: int) -> Column:
    """Key of the record's (0) or the event's (1) columns that a direction compares."""
    return F.concat_ws("\u0001", *(F.coalesce(F.col(p[side]).cast("string"), F.lit("")) for p in FLEX[direction]))


def flexbit_lives(sets: DataFrame, unsets: DataFrame | None = None, directions: tuple[str, ...] = tuple(FLEX)) -> DataFrame:
    """Lives of records: (name, the five, event_time, event_seq, rule_pos, expire, stop).

    sets(name, src_ip, dst_ip, src_port, dst_port, username, event_time,
    event_seq, rule_pos, expire). A life ends when it expires, when its record
    is set again (which begins another), or with the first later unset that
    matches it; stop is the earliest of these moments. unsets(name, direction,
    the five, ...); directions: those that occur in unsets.
    """
    life = sets.select("name", *_WHO, *ORDER, "expire").withColumn("__key", _who("both_p", 0)).withColumn("__key", F.concat_ws("\u0001", "__key", F.coalesce("username", F.lit(""))))
    life = running(life, ["name", "__key"], _now(), "min", "stop", after=True)
    end = _at(F.timestamp_seconds(seconds() + F.col("expire")), F.lit(-1).cast(sets.schema["event_seq"].dataType), F.lit(-1).cast(sets.schema["rule_pos"].dataType))
    life = life.withColumn("stop", F.least("stop", end)).drop("__key")
    if unsets is None:
        return life
    for d in directions:
        mine = unsets.where(F.col("direction") == d).select("name", *ORDER, _who(d, 1).alias("__key"), F.lit(True).alias("__ends"))
        both = life.withColumn("__key", _who(d, 0)).withColumn("__ends", F.lit(False)).unionByName(mine, allowMissingColumns=True)
        both = running(both, ["name", "__key"], F.when(F.col("__ends"), _now()), "min", "__end", after=True)
        life = both.where("not __ends").withColumn("stop", F.least("stop", "__end")).drop("__key", "__ends", "__end")
    return life


def flexbit_matches(tests: DataFrame, lives: DataFrame, direction: str, count: bool = False) -> DataFrame:
    """(id, records, by) of every test: is a record alive (records 1 or 0) and the setting event of the one that lives longest; or how many are alive.

    tests(id, name, the five, event_time, event_seq, rule_pos). A running
    maximum of the ends of lives, or a running sum of births and ends, over
    rows that a direction's columns bring together; nothing is paired.
    """
    asked = tests.select("name", *ORDER, _who(direction, 1).alias("__key"), "id", F.lit(True).alias("__ask"))
    born = lives.select("name", *ORDER, _who(direction, 0).alias("__key"), "stop", F.lit(False).alias("__ask"), F.lit(1).alias("__n"))
    if count:
        gone = lives.select("name", *(F.col(f"stop.{c}").alias(c) for c in ORDER), _who(direction, 0).alias("__key"), F.lit(False).alias("__ask"), F.lit(-1).alias("__n"))
        both = asked.unionByName(born.drop("stop"), allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)
        got = running(both, ["name", "__key"], F.coalesce("__n", F.lit(0)), "sum", "records", (*ORDER, "__n"))
        return got.where("__ask").select("id", "records", F.lit(None).cast("long").alias("by"))
    both = asked.unionByName(born, allowMissingColumns=True)
    got = running(both, ["name", "__key"], F.when(~F.col("__ask"), F.struct("stop", F.col("event_seq").alias("by"))), "max", "__s")
    alive = F.coalesce(F.col("__s.stop") > _now(), F.lit(False))
    return got.where("__ask").select("id", F.when(alive, 1).otherwise(0).alias("records"), F.when(alive, F.col("__s.by")).alias("by"))


def flexbit_left(lives: DataFrame, since: Column) -> DataFrame:
    """The sets that nothing but their expiry ends, and that after a moment (seconds): all that later batches need."""
    return lives.where((F.col("stop.event_seq") == -1) & (seconds(F.col("stop.event_time")) > since)).drop("stop")


def simulate_bits(rows: list[dict]) -> list[bool]:
    """Reference machine of xbits for tests: rows in order, each {op, name, key, t, expire}; the tests' results."""
    until: dict = {}
    out = []
    for r in rows:
        k = (r["name"], r["key"])
        if r["op"] == "set":
            until[k] = r["t"] + r["expire"]
        elif r["op"] == "unset":
            until[k] = -1
        else:
            out.append((r["t"] < until.get(k, -1)) == (r["op"] == "isset"))
    return out


def track_clients(events: DataFrame, timeout_minutes: int, until: Column, host: str = "src_ip") -> DataFrame:
    """(host, last_seen, down_from, up_again): silences of at least the timeout.

    down_from is last_seen plus the timeout; up_again is null while the host
    stays silent up to `until`.
    """
    w = Window.partitionBy(host).orderBy("event_time", "event_seq")
    t = seconds()
    nxt = F.lead(t).over(w)
    gaps = events.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), t.alias("last_seen"), nxt.alias("up_again"))
    wait = timeout_minutes * 60
    return gaps.where(F.coalesce(F.col("up_again"), seconds(until)) - F.col("last_seen") >= wait).withColumn("down_from", F.col("last_seen") + wait).select("host", "last_seen", "down_from", "up_again")


def client_stats(events: DataFrame, key: str = "src_ip", private_only: bool = False) -> DataFrame:
    """(key, events, bytes, last_seen, program, message): totals of a host or tag, with its last row's text."""
    from ..functions.net import not_routable

    e = events.where(F.col(key).isNotNull())
    if private_only:
        e = e.where(not_routable(F.col(key)))
    fields = [c for c in ("host", "facility", "priority", "level", "tag", "date", "time", "program", "message") if c in events.columns]
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in fields), F.lit(9))
    last = F.max_by(F.struct(*(c for c in ("program", "message") if c in events.columns)), F.struct("event_time", "event_seq"))
    return e.groupBy(key).agg(F.count("*").alias("events"), F.sum(size).cast("long").alias("bytes"), F.max(seconds()).alias("last_seen"), last.alias("last")).select(key, "events", "bytes", "last_seen", "last.*")


def counters(events: DataFrame, every: str) -> DataFrame:
    """(window_start, received, bytes, max_bytes, hosts, programs, eps, delta): counters of each period and their change.

    bytes and max_bytes are of messages; delta is the change of received since
    the period before, which is the last one that has events.
    """
    sec = to_seconds(every)
    size = F.coalesce(F.octet_length("message"), F.lit(0))
    g = events.groupBy((F.floor(seconds() / sec) * sec).cast("long").alias("window_start")).agg(F.count("*").alias("received"), F.sum(size).alias("bytes"), F.max(size).alias("max_bytes"), F.countDistinct("host").alias("hosts"), F.countDistinct("program").alias("programs"))
    w = Window.partitionBy(F.lit(0)).orderBy("window_start")  # one row a period
    return g.withColumn("eps", F.col("received") / float(sec)).withColumn("delta", F.col("received") - F.coalesce(F.lag("received").over(w), F.lit(0)))
