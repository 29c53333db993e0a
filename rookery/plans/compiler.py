"""Rule -> Column expressions.

compile_rule() gives tests of the event and the fields the rule extracts from
it. candidates() evaluates all rules in one pass over the events and explodes
the numbers of those that match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonflat, net, text
from .rules import Rule

#: Fields a rule may extract, with their types.
FIELDS = {"src_ip": "string", "dst_ip": "string", "src_port": "int", "dst_port": "int", "proto": "int", "username": "string", "event_id": "string", "md5": "string", "sha1": "string", "sha256": "string", "filename": "string", "hostname": "string", "url": "string", "ja3": "string", "flow_id": "bigint", "normalized": "string"}
#: Rules of one array of numbers; more would outgrow a generated method.
CHUNK = 40


@dataclass
class Templates:
    """What `normalize` and protocol look-ups use: named-group expressions and (needle, proto, nocase) lists."""

    patterns: list[str]
    message_protos: list[tuple[str, int, bool]]
    program_protos: list[tuple[str, int, bool]]
    default_host: str = ""


NONE = Templates([], [], [])


def lookup_proto(c: Column, table: list[tuple[str, int, bool]]) -> Column:
    """Number of the first needle found."""
    out = F.lit(None).cast("int")
    for needle, n, nocase in reversed(table):
        hit = F.contains(F.lower(c), F.lit(needle.lower())) if nocase else F.contains(c, F.lit(needle))
        out = F.when(hit, n).otherwise(out)
    return out


def alert_time(ts: Column, days: frozenset[int] | None, hours: tuple[int, int] | None) -> Column:
    """Day of week (Sunday 0) and HHMM inside; hours that cross midnight reach into the next day."""
    day, now = F.dayofweek(ts) - 1, F.hour(ts) * 100 + F.minute(ts)
    on = lambda d: d.isin(sorted(days)) if days is not None else F.lit(True)
    if hours is None:
        return on(day)
    lo, hi = hours
    if lo <= hi:
        return on(day) & now.between(lo, hi)
    return (on(day) & (now >= lo)) | (on(F.pmod(day - 1, F.lit(7))) & (now <= hi))


def _normalized(message: Column, patterns: list[str], name: str) -> Column:
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        groups = re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", p)).groupindex
        p = re.sub(r"\(\?<[A-Za-z]\w*>", "(", p)  # Java's group names have no underscores
        if name in groups:
            out = F.when(message.rlike(p), F.nullif(F.regexp_extract(message, p, groups[name]), F.lit(""))).otherwise(out)
        else:
            out = F.when(message.rlike(p), F.lit(None).cast("string")).otherwise(out)
    return out


@dataclass
class Compiled:
    """What a rule becomes: header is a plain test of columns, for the scan, or None; plain are the tests that need no addresses, flow those that do."""

    header: Column | None
    plain: Column
    flow: Column | None
    fields: dict[str, Column]
    message: Column


def profile(r: Rule) -> tuple:
    """What decides how a rule's fields are extracted: rules of equal profiles share their fields."""
    return (tuple(r.json_map.items()), r.append_program, r.normalize, tuple(r.event_ids), r.parse_src_ip, r.parse_dst_ip, tuple(r.parse_hashes), r.parse_proto, r.parse_proto_program, r.default_proto, r.default_src_port, r.default_dst_port)


class _Fields(dict):
    """A field's column, made when it is asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, name: str) -> Column:
        self[name] = self.make(name)
        return self[name]


def compile_rule(r: Rule, columns: list[str], t: Templates = NONE, ips: Column | None = None, keys: tuple[Column, Column] | None = None, fields: bool = True, shared: dict | None = None) -> Compiled:
    """A rule's tests and fields; columns that events lack count as null. Without `fields`, only those are made that its tests need.

    ips: the message's scanned addresses where they are a column already; keys:
    the same of the source's and the destination's sortable address. shared:
    expressions that rules have in common, as each costs the driver time.
    """
    shared = {} if shared is None else shared
    col = lambda c, kind="string": F.col(c) if c in columns else F.lit(None).cast(kind)
    pairs = F.col("json") if "json" in columns else F.lit(None).cast("array<struct<key:string,value:string>>")
    f = _Fields(lambda n: col(n, FIELDS[n]).cast(FIELDS[n]))
    late_needed = bool(r.proto or r.src_nets or r.dst_nets or r.src_ports or r.dst_ports)
    message, program = col("message"), col("program")
    numbers = {"tcp": 6, "udp": 17, "icmp": 1}
    for name, key in r.json_map.items():
        v = jsonflat.get(pairs, key)
        if name == "message":
            message = F.coalesce(v, message)
        elif name == "program":
            program = F.coalesce(v, program)
        elif name == "proto":
            low, named = F.lower(v), F.lit(None).cast("int")
            for k, n in numbers.items():
                named = F.when(F.contains(low, F.lit(k)), n).otherwise(named)
            f["proto"] = F.coalesce(named, v.try_cast("int"), f["proto"])
        elif name in FIELDS:
            f[name] = F.coalesce(v.try_cast(FIELDS[name]), f[name])
    if r.append_program:
        message = F.when(F.coalesce(program, F.lit("")) != "", F.concat(message, F.lit(" | "), program)).otherwise(message)
    tests: list[Column] = []
    header = None
    if r.programs:
        tests.append(text.any_glob(program, r.programs))
        if "program" in columns and "program" not in r.json_map and not any(set(p) & set("*?") for p in r.programs):
            header = tests[-1]
    for name, values in (("facility", r.facilities), ("level", r.levels), ("tag", r.tags), ("priority", r.priorities)):
        if values:
            tests.append(col(name).isin(values))
            header = tests[-1] if header is None and name in columns else header
    if r.contents or r.pcres or r.metas or r.json_pcres or r.json_contents or r.json_metas or r.event_ids:
        own = (r.append_program, r.json_map.get("message"), r.append_program and r.json_map.get("program"))
        if own not in shared:
            shared[own] = text.valid_message(message)
        tests.append(shared[own])
    if r.contents:
        tests.append(text.contents(message, r.contents))
    tests += [message.rlike(p) for p in r.pcres]
    if r.metas:
        tests.append(text.contents(message, r.metas))
    tests += [jsonflat.json_pcre(pairs, *p) for p in r.json_pcres]
    tests += [jsonflat.json_content(pairs, c) for c in r.json_contents]
    tests += [jsonflat.json_meta_content(pairs, c) for c in r.json_metas]
    if r.normalize and t.patterns:
        for n, k in FIELDS.items():
            if n != "normalized":
                f[n] = F.coalesce(_normalized(message, t.patterns, n).try_cast(k), f[n])
        found = F.struct(*(_normalized(message, t.patterns, n).alias(n) for n in FIELDS if any(f"<{n}>" in p for p in t.patterns)))
        f["normalized"] = F.nullif(F.to_json(found), F.lit("{}"))
    if r.event_ids:
        f["event_id"] = text.event_id(message, f["event_id"], r.event_ids)
        tests.append(f["event_id"].isNotNull())
    if r.alert_days is not None or r.alert_hours is not None:
        tests.append(alert_time(F.col("event_time"), r.alert_days, r.alert_hours))
    both = lambda xs: F.coalesce(reduce(lambda a, b: a & b, xs), F.lit(False)) if xs else None
    plain = both(tests)
    plain = F.lit(True) if plain is None else plain
    if not fields and not late_needed:
        return Compiled(header, plain, None, f, message)
    if r.parse_src_ip or r.parse_dst_ip:
        ips = net.ip_scan(message) if ips is None else ips
        for n, ip, port in ((r.parse_src_ip, "src_ip", "src_port"), (r.parse_dst_ip, "dst_ip", "dst_port")):
            if n:
                got = F.get(ips, F.lit(n - 1))
                f[ip] = F.coalesce(f[ip], got["ip"])
                f[port] = F.coalesce(f[port], F.nullif(got["port"], F.lit(0)))
        f["proto"] = F.coalesce(f["proto"], net.proto_scan(message))
    for h in r.parse_hashes:
        f[h] = F.coalesce(f[h], net.hash_scan(message, h))
    if r.parse_proto:
        f["proto"] = F.coalesce(lookup_proto(message, t.message_protos), f["proto"])
    if r.parse_proto_program:
        f["proto"] = F.coalesce(lookup_proto(program, t.program_protos), f["proto"])
    if r.default_proto:
        f["proto"] = F.coalesce(F.nullif(f["proto"], F.lit(0)), F.lit(r.default_proto))
    f["src_port"] = F.coalesce(f["src_port"], F.lit(r.default_src_port))
    f["dst_port"] = F.coalesce(f["dst_port"], F.lit(r.default_dst_port))
    f["proto"] = F.coalesce(f["proto"], F.lit(0))
    host = F.when(col("host").rlike(r"^(127\.|::1$)"), F.lit(t.default_host)).otherwise(col("host")) if t.default_host else col("host")
    for ip in ("src_ip", "dst_ip"):
        f[ip] = F.when(f[ip].rlike(net.REMOTE), f[ip]).otherwise(host)
    late: list[Column] = [f["proto"] == r.proto] if r.proto else []
    key = dict(zip(("src_ip", "dst_ip"), keys)) if keys else {}

    def flow(a, ap, b, bp):
        out = F.lit(True)
        for c, nets in ((a, r.src_nets), (b, r.dst_nets)):
            if nets:
                out = out & net.nets_match(key[c] if key else net.ip_key(f[c]), nets)
        for c, ports in ((ap, r.src_ports), (bp, r.dst_ports)):
            if ports:
                out = out & net.ports_match(f[c], ports)
        return out

    if r.src_nets or r.dst_nets or r.src_ports or r.dst_ports:
        there, back = ("src_ip", "src_port", "dst_ip", "dst_port"), ("dst_ip", "dst_port", "src_ip", "src_port")
        late.append(flow(*there) if r.direction == "->" else flow(*back) if r.direction == "<-" else flow(*there) | flow(*back))
    return Compiled(header, plain, both(late), f, message)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def candidates(events: DataFrame, rules: list[Rule], t: Templates = NONE) -> DataFrame:
    """Events x rules whose stateless tests hold: the event's columns, `rule_pos`, and the rule's fields.

    One scan of the events. Tests of header columns that every rule has reach
    the scan. Where rules look at networks, events go on which no plain test
    holds, and addresses and their keys are made once an event for each
    profile. Rule numbers alone are exploded; fields are made after, for matches.
    """
    keep = [c for c in events.columns if c not in FIELDS]
    if not rules:
        return events.where("false").select(*keep, F.lit(None).cast("int").alias("rule_pos"), *(F.lit(None).cast(k).alias(n) for n, k in FIELDS.items()))
    groups: dict[tuple, list[Rule]] = {}
    for r in rules:
        groups.setdefault(profile(r), []).append(r)
    columns, shared = events.columns, {}
    compiled = {r.position: compile_rule(r, columns, t, fields=False, shared=shared) for r in rules}
    if all(c.header is not None for c in compiled.values()):
        events = events.where(_any([c.header for c in compiled.values()]))
    if any(r.src_nets or r.dst_nets for r in rules):  # addresses are dear: not for events that match no rule anyway
        events = events.where(_any([c.plain for c in compiled.values()]))
    made = []

    def also(**new: Column) -> None:
        nonlocal events
        events = events.withColumns(new)
        made.extend(new)

    for n, g in enumerate(groups.values()):
        if not any(x.src_nets or x.dst_nets for x in g):
            continue
        ips = None
        if g[0].parse_src_ip or g[0].parse_dst_ip:
            also(**{f"__ips{n}": net.ip_scan(compiled[g[0].position].message)})
            ips = F.col(f"__ips{n}")
        f = compile_rule(g[0], columns, t, ips).fields
        also(**{f"__src{n}": f["src_ip"], f"__dst{n}": f["dst_ip"]})
        also(**{f"__from{n}": net.ip_key(F.col(f"__src{n}")), f"__to{n}": net.ip_key(F.col(f"__dst{n}"))})
        for r in g:
            compiled[r.position] = compile_rule(r, columns, t, ips, (F.col(f"__from{n}"), F.col(f"__to{n}")), False, shared)
    number = [F.when(c.plain if c.flow is None else c.plain & c.flow, p).otherwise(-1) for p, c in compiled.items()]
    parts = [F.array_remove(F.array(*number[i : i + CHUNK]), -1) for i in range(0, len(number), CHUNK)]
    hit = events.select(*[c for c in events.columns if c not in made], F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("rule_pos"))
    mine = {p: F.col("rule_pos").isin([r.position for r in g]) for p, g in groups.items()}
    scans = {p: F.when(mine[p], net.ip_scan(compiled[g[0].position].message)) for p, g in groups.items() if g[0].parse_src_ip or g[0].parse_dst_ip}
    names = {p: f"__scan{i}" for i, p in enumerate(scans)}
    if scans:
        hit = hit.withColumns({names[p]: c for p, c in scans.items()})
    fields = {p: compile_rule(g[0], columns, t, F.col(names[p]) if p in names else None).fields for p, g in groups.items()}
    first, *others = groups
    out = []
    for n, k in FIELDS.items():
        c = fields[first][n].cast(k)
        for p in others:
            c = F.when(mine[p], fields[p][n].cast(k)).otherwise(c)
        out.append(c.alias(n))
    return hit.select(*keep, "rule_pos", *out)
