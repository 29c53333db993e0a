"""Live sources, the streaming host tracker, the state inspector, sinks and the indicator file."""

import socket
import threading
import time

from pyspark.sql import functions as F

from rookery import sinks
from rookery.operators import state
from rookery.plans import engine
from rookery.plans.rules import parse_rules
from rookery.sources import config, logs
from rookery.streaming.inspect import live_state
from rookery.streaming.state import track_clients


def _heard(spark):
    rows = [(0, 0, "a"), (1, 30, "b"), (2, 100, "a"), (3, 1000, "a"), (4, 1010, "c"), (5, 1020, None), (6, 5000, "b"), (7, 9000, "z")]
    return spark.createDataFrame(rows, "event_seq long, t long, src_ip string").withColumn("event_time", F.timestamp_seconds(F.col("t") + 1_700_000_000)).drop("t")


def test_hosts_go_down_and_up(spark, tmp_path):
    events = _heard(spark)
    for i, part in enumerate(("event_seq < 3", "event_seq between 3 and 5", "event_seq = 6", "event_seq = 7")):
        events.where(part).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    src = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = track_clients(src, 10).writeStream.format("memory").queryName("hosts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = sorted((r.host, r.at - 1_700_000_000, r.status) for r in spark.table("hosts").collect())
    assert got == [("a", 700, "down"), ("a", 1000, "up"), ("a", 1600, "down"), ("b", 630, "down"), ("b", 5000, "up"), ("b", 5600, "down"), ("c", 1610, "down")]
    batch = state.track_clients(events, 10, F.timestamp_seconds(F.lit(1_700_009_000))).collect()
    assert {(r.host, r.down_from - 1_700_000_000) for r in batch} == {(h, t) for h, t, s in got if s == "down"}
    assert {r.key[0] for r in live_state(spark, str(tmp_path / "ck")).select("key").collect()} >= {"a", "b", "c"}


def test_a_socket_is_read(spark, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        c, _ = server.accept()
        c.sendall(b"10.1.1.1|auth|info|info|26|d|t|sshd| one\\n10.1.1.2|auth\\n".replace(b"\\n", b"\n"))
        time.sleep(20)
        c.close()

    threading.Thread(target=serve, daemon=True).start()
    lines = logs.read_live(spark, "socket", host="127.0.0.1", port=server.getsockname()[1])
    q = logs.decode_pipe(lines).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for _ in range(60):
            if spark.table("lines").count() == 2:
                break
            time.sleep(0.5)
        assert {(r.host, r.program, r.malformed) for r in spark.table("lines").collect()} == {("10.1.1.1", "sshd", False), ("10.1.1.2", None, True)}
    finally:
        q.stop()
        server.close()


def test_indicator_file(spark, tmp_path):
    (tmp_path / "i.dat").write_text("#fields\nEvil.example\tIntel::DOMAIN\tx\nevil.example\tIntel::DOMAIN\ty\n9.9.9.9\tIntel::ADDR\tz\n")
    got = {(r.indicator, r.type) for r in config.intel(spark, str(tmp_path / "i.dat")).collect()}
    assert got == {("evil.example", "DOMAIN"), ("9.9.9.9", "ADDR")}


def test_dispatch(spark, tmp_path):
    events = _heard(spark).withColumns({"program": F.lit("p"), "message": F.lit(" m"), "host": F.lit("10.1.1.1")})
    rules = parse_rules('alert any any any -> any any (msg:"a"; email: x@y.org; xbits: noeve; sid:1; rev:1;)')
    got = {}
    writers = {n: lambda df, n=n: got.update({n: df.count()}) for n in ("eve", "full", "fast", "syslog", "mail")}
    sinks.dispatch(engine.alerts(events, rules), writers)
    assert got == {"eve": 0, "full": 8, "fast": 8, "syslog": 8, "mail": 8}
    sinks.write_text(sinks.fast(engine.alerts(events, rules)), str(tmp_path / "fast"))
    assert spark.read.text(str(tmp_path / "fast")).count() == 8
