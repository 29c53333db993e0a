"""Renderings of alerts and events, and writers."""

from __future__ import annotations

import shlex
import subprocess
import threading
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.text import percent

PROTO = {1: "ICMP", 6: "TCP", 17: "UDP"}


def _col(df: DataFrame, c: str) -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast("string")


def _proto(c: Column) -> Column:
    out = F.lit("UNKNOWN")
    for n, name in PROTO.items():
        out = F.when(c == n, name).otherwise(out)
    return out


def _time(c: str = "event_time") -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSZ")


def eve(a: DataFrame, base64: bool = True, in_iface: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON object an alert, event_type alert; metadata, correlation, normalize and reputation as objects where an alert has them.

    in_iface: name of the interface to report. A column `reputation` (JSON
    text) may be joined by the caller. keep: columns of the alerts to hand on.
    """
    payload = F.base64(F.encode("message", "UTF-8")) if base64 else F.col("message")
    body = F.struct(
        _time().alias("timestamp"), _col(a, "flow_id").alias("flow_id"), *([F.lit(in_iface).alias("in_iface")] if in_iface else []), F.lit("alert").alias("event_type"), "src_ip", "src_port", F.col("dst_ip").alias("dest_ip"), F.col("dst_port").alias("dest_port"), _proto(F.col("proto")).alias("proto"),
        payload.alias("payload"), F.lit(0).alias("stream"), F.col("host").alias("xff"), *(_col(a, c).alias(c) for c in ("facility", "priority", "level", "tag", "program", "host")),
        F.struct("action", F.lit(1).alias("gid"), F.col("sid").alias("signature_id"), "rev", F.col("msg").alias("signature"), "category", "severity", "rule").alias("alert"),
        F.from_json(F.nullif("metadata", F.lit("")), "map<string,array<string>>").alias("metadata"), F.from_json("correlation", "map<string,string>").alias("correlation"),
        F.from_json(_col(a, "normalized"), "map<string,string>").alias("normalize"), F.from_json(_col(a, "reputation"), "map<string,string>").alias("reputation"),
    )
    return a.where("not noeve").select("event_seq", "sid", *keep, F.to_json(body).alias("value"))


def eve_log(events: DataFrame) -> DataFrame:
    """One JSON object an event, event_type log."""
    cols = [c for c in ("host", "facility", "priority", "level", "tag", "program", "message") if c in events.columns]
    return events.select("event_seq", F.to_json(F.struct(_time().alias("timestamp"), F.lit("log").alias("event_type"), *cols)).alias("value"))


def fast(a: DataFrame) -> DataFrame:
    """One line an alert."""
    line = F.concat(F.date_format("event_time", "MM/dd/yyyy-HH:mm:ss.SSSSSS"), F.lit("  [**] ["), F.lit("1:"), F.col("sid").cast("string"), F.lit(":"), F.col("rev").cast("string"), F.lit("] "), "msg", F.lit(" [**] [Classification: "), "category", F.lit("] [Priority: "), F.coalesce(F.col("severity").cast("string"), F.lit("0")), F.lit("] [Program: "), F.coalesce("program", F.lit("")), F.lit("] {"), _proto(F.col("proto")), F.lit("} "), F.coalesce("src_ip", F.lit("")), F.lit(":"), F.col("src_port").cast("string"), F.lit(" -> "), F.coalesce("dst_ip", F.lit("")), F.lit(":"), F.col("dst_port").cast("string"))
    return a.select("event_seq", "sid", line.alias("value"))


def full(a: DataFrame) -> DataFrame:
    """The multi-line alert text; rules whose xbits say `noalert` are left out of it, and of it alone."""
    a = a.where("not nolog") if "nolog" in a.columns else a
    xref = [F.col("xref")] if "xref" in a.columns else []
    head = F.concat(F.lit("[**] [1:"), F.col("sid").cast("string"), F.lit(":"), F.col("rev").cast("string"), F.lit("] "), "msg", F.lit(" [**]"))
    cls = F.concat(F.lit("[Classification: "), "category", F.lit("] [Priority: "), F.coalesce(F.col("severity").cast("string"), F.lit("0")), F.lit("]"))
    way = F.concat(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.coalesce("src_ip", F.lit("")), F.lit(":"), F.col("src_port").cast("string"), F.lit(" -> "), F.coalesce("dst_ip", F.lit("")), F.lit(":"), F.col("dst_port").cast("string"))
    return a.select("event_seq", "sid", F.concat_ws("\n", head, cls, way, F.concat(F.lit("Message: "), "message"), *xref).alias("value"))


def syslog(a: DataFrame) -> DataFrame:
    """The fast line's core with the message, for a syslog writer."""
    line = F.concat(F.lit("[1:"), F.col("sid").cast("string"), F.lit(":"), F.col("rev").cast("string"), F.lit("] "), "msg", F.lit(" [Classification: "), "category", F.lit("] {"), _proto(F.col("proto")), F.lit("} - "), "message")
    return a.select("event_seq", "sid", line.alias("value"))


def mail(a: DataFrame) -> DataFrame:
    """(to, subject, body) of alerts whose rule names an address; sending is the caller's foreachBatch."""
    return a.where("email <> ''").select("event_seq", F.col("email").alias("to"), F.concat(F.lit("[alert] "), "msg").alias("subject"), F.concat_ws("\n", "msg", "message").alias("body"))


#: Output lines of a program that are handed on at once.
LINES = 5000


def _through(command: str, lines: Iterable[str]) -> Iterator[list[str]]:
    """A program's output lines for input lines, some at a time while it still reads; each of the command's words is taken as it stands."""
    failed: list[BaseException] = []
    run = subprocess.Popen(shlex.split(command), stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def feed() -> None:
        try:
            with run.stdin:
                for x in lines:
                    run.stdin.write(x.encode() + b"\n")
        except BrokenPipeError:  # it needs no more
            pass
        except BaseException as e:
            failed.append(e)

    feeder = threading.Thread(target=feed, daemon=True)
    feeder.start()
    try:
        with run.stdout:
            while some := [x.decode().rstrip("\r\n") for x in islice(run.stdout, LINES)]:
                yield some
        feeder.join()
        if failed:
            raise failed[0]
        if run.wait():
            raise subprocess.CalledProcessError(run.returncode, command)
    finally:
        if run.poll() is None:
            run.kill()
            run.wait()


def pipe_external(a: DataFrame, command: str | None = None) -> DataFrame:
    """(command, value): output lines of programs that get the EVE lines on their input.

    command: one for all alerts; without it each alert goes to the program that
    its rule's `external` names. A program runs once for each partition that has
    lines for it, and reads and writes at once, so that no lines are gathered;
    a failing one fails the task, and retried tasks run it again.
    """
    if command is None:
        lines = eve(a.where("external <> ''"), keep=("external",)).select(F.col("external").alias("command"), "value").sortWithinPartitions("command")
    else:
        lines = eve(a).select(F.lit(command).alias("command"), "value")

    def run(batches):
        rows = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for c, own in groupby(rows, itemgetter(0)):
            for got in _through(c, (v for _, v in own)):
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(got), pa.string()), pa.array(got, pa.string())], names=["command", "value"])

    return lines.mapInArrow(run, "command string, value string")


def dispatch(a: DataFrame, writers: dict) -> None:
    """Calls each writer with its rendering of the alerts, in order of the outputs.

    writers: any of eve, full, fast, syslog, mail -> function(DataFrame).
    """
    for name, render in (("eve", eve), ("full", full), ("fast", fast), ("syslog", syslog), ("mail", mail)):
        if name in writers:
            writers[name](render(a))


def report(counts: dict[str, DataFrame], whole: str) -> DataFrame:
    """(name, count, percent): rows of each frame, and their part of those of `whole`; the console's statistics."""
    out = None
    for n, (name, df) in enumerate(counts.items()):
        one = df.agg(F.count("*").alias("count")).select(F.lit(n).alias("n"), F.lit(name).alias("name"), "count")
        out = one if out is None else out.unionByName(one)
    total = F.max(F.when(F.col("name") == whole, F.col("count"))).over(Window.partitionBy(F.lit(0)))  # one row a counter
    return out.select("n", "name", "count", percent(F.col("count"), total).alias("percent")).orderBy("n").drop("n")


def write_text(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select("value").write.mode(mode).text(path)
