"""Readers of log lines, for batch and streams alike."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonflat
from ..functions.net import ip_key

PIPE = ("host", "facility", "priority", "level", "tag", "date", "time", "program", "message")
MAP_FIELDS = {"syslog-source-ip": "host", "dest_ip": "dst_ip", "dest_port": "dst_port"}


def read_lines(spark: SparkSession, path: str, stream: bool = False, per_trigger: int = 100) -> DataFrame:
    """Lines of files or globs, .gz included; a stream takes new files of a folder as they come."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path) if stream else spark.read.text(path)


def read_live(spark: SparkSession, kind: str, **options) -> DataFrame:
    """(value): a stream of lines from a live source: "socket" (host, port), "kafka" (Kafka's options), or any that gives a column `value`.

    A stream waits where its readers can't keep up; nothing is dropped.
    """
    return spark.readStream.format(kind).options(**options).load().select(F.col("value").cast("string").alias("value"))


#: Fields of journald's JSON lines (`journalctl -o json`), for decode_json().
JOURNALD = {"host": ["._HOSTNAME"], "facility": [".SYSLOG_FACILITY"], "priority": [".PRIORITY"], "level": [".PRIORITY"], "program": [".SYSLOG_IDENTIFIER", "._COMM"], "message": [".MESSAGE"], "username": ["._UID"]}


def ignore(lines: DataFrame, needles: list[str], column: str = "value") -> DataFrame:
    """Lines that hold none of the substrings; dropped before anything is parsed."""
    out = lines
    for n in needles:
        if n.strip() and n[0] not in "#;":
            out = out.where(~F.contains(F.col(column), F.lit(n)))
    return out


def decode_pipe(lines: DataFrame, default_host: str | None = None, missing: str | None = None, column: str = "value") -> DataFrame:
    """Nine fields divided by |, the message being the rest of the line, and `malformed`.

    Missing fields are null, or, with missing="{} ERROR", that text with the
    field's name in capitals, for readers that expect one. A host that is no address becomes the
    default host.
    """
    p = F.split(F.regexp_replace(F.col(column), r"[\r\n]+$", ""), r"\|", 9)
    out = [F.get(p, F.lit(i)).alias(n) for i, n in enumerate(PIPE)]
    df = lines.select(*[c for c in lines.columns if c != column], *out, (F.size(p) < 9).alias("malformed"))
    if default_host is not None:
        df = df.withColumn("host", F.when(ip_key(F.col("host")).isNotNull(), F.col("host")).otherwise(F.lit(default_host)))
    if missing is not None:
        for n in PIPE:
            df = df.withColumn(n, F.coalesce(F.col(n), F.lit(missing.format(n.upper()))))
    return df


def load_json_map(text: str, software: str) -> dict[str, list[str]]:
    """Field -> alternative keys of one software in a map of JSON lines."""
    for line in text.splitlines():
        if line.strip() and line[0] not in "#;":
            m = json.loads(line)
            if m.get("software") == software:
                return {MAP_FIELDS.get(k, k): v.split("|") for k, v in m.items() if k != "software"}
    raise KeyError(software)


def decode_json(lines: DataFrame, fields: dict[str, list[str]], column: str = "value") -> DataFrame:
    """Mapped fields of JSON lines, with `json` pairs and `json_original`.

    A field has the first pair, in order of the document, whose key is an
    alternative; %JSON% is the whole document. Messages get a leading blank;
    fields without a pair are "UNDEFINED", hosts 0.0.0.0.
    """
    ints = ("src_port", "dst_port", "proto", "flow_id")
    df = lines.withColumn("json", jsonflat.flatten(F.col(column)))
    cols = []
    for f, keys in fields.items():
        v = F.col(column) if keys == ["%JSON%"] else jsonflat.first_of(F.col("json"), keys)
        if f == "message":
            v = F.concat(F.lit(" "), v)
        if f == "proto":
            low = F.lower(v)
            v = F.when(low == "tcp", "6").when(low == "udp", "17").when(low == "icmp", "1").otherwise(v)
        cols.append((v.try_cast("long" if f == "flow_id" else "int") if f in ints else v).alias(f))
    out = df.select(*[c for c in df.columns if c not in (column, *fields)], F.col(column).alias("json_original"), *cols)
    for f in PIPE:
        default = F.lit("0.0.0.0" if f == "host" else "UNDEFINED")
        out = out.withColumn(f, F.coalesce(F.col(f), default) if f in out.columns else default)
    return out


def json_in_message(events: DataFrame) -> DataFrame:
    """`json` of events whose message holds a document in its first 3 characters; a program that begins one is put before the message."""
    split = F.contains(F.substring("program", 1, 2), F.lit("{"))
    m = F.when(split, F.concat("program", "message")).otherwise(F.col("message"))
    return events.withColumn("message", m).withColumn("json", F.when(F.contains(F.substring("message", 1, 3), F.lit("{")), jsonflat.flatten(F.trim("message"))))


def events_as_logs(events: DataFrame) -> DataFrame:
    """The driver's events as log events."""
    user = F.col("user_id")
    octet = lambda n: F.pmod(F.floor(user / n), F.lit(256)).cast("string")
    return events.select(
        F.col("event_id").alias("event_seq"),
        F.col("ts").cast("timestamp").alias("event_time"),
        F.lit("10.0.0.1").alias("host"),
        F.when(F.col("event_type") == "purchase", "auth").otherwise("user").alias("facility"),
        F.when(F.col("event_type") == "error", "alert").otherwise("info").alias("priority"),
        F.when(F.col("event_type") == "error", "err").otherwise("info").alias("level"),
        F.lit("00").alias("tag"),
        F.col("event_type").alias("program"),
        F.concat(F.lit(" "), "event_type", F.lit(" user="), user.cast("string"), F.lit(" cents="), F.round(F.col("value") * 100).cast("bigint").cast("string")).alias("message"),
        F.concat(F.lit("10."), octet(65536), F.lit("."), octet(256), F.lit("."), octet(1)).alias("src_ip"),
        user.cast("string").alias("username"),
        F.col("props").alias("json_original"),
    )


def documents_as_logs(docs: DataFrame) -> DataFrame:
    """The driver's documents as log events of one moment."""
    return docs.select(F.col("doc_id").alias("event_seq"), F.timestamp_seconds("doc_id").alias("event_time"), F.lit("10.0.0.1").alias("host"), F.lit("user").alias("facility"), F.lit("info").alias("priority"), F.lit("info").alias("level"), F.col("lang").alias("tag"), F.col("source").alias("program"), F.col("text").alias("message"))


def pages_as_logs(pages: DataFrame) -> DataFrame:
    """The driver's pages as log events."""
    return pages.select(F.col("page_id").alias("event_seq"), F.timestamp_seconds("page_id").alias("event_time"), F.lit("10.0.0.1").alias("host"), F.lit("web").alias("program"), F.col("html").alias("message"), "url")


