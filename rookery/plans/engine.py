"""The rule engine: events x rules -> alerts.

Rules are staged so that a rule that tests a bit comes after those that set it,
and all rules after a `pass` come after it. Each stage is one pass of candidate
matches through look-ups, bit tests, after, threshold and effects; a stage's
emitted setters are what later stages test. Rules of one kind of look-up or bit
test go through it together, in one join, however many they are. A stream is
the same over its batches, with what counters and bits remember in between.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import ip_key, ips, may_have_ip
from ..operators import lookups, state
from ..operators.cut import cut
from .compiler import NONE, Templates, candidates
from .rules import Rule, metadata_json


class CycleError(ValueError):
    """Rules that test and set each other's bits in a circle."""


@dataclass
class Tables:
    """Dimension tables that look-up options need; missing ones match nothing."""

    blacklist: DataFrame | None = None
    intel: DataFrame | None = None
    geo: DataFrame | None = None
    geo_skip: DataFrame | None = None
    reputation: DataFrame | None = None
    categories: dict[str, int] = field(default_factory=dict)
    classes: DataFrame | None = None
    templates: Templates = field(default_factory=lambda: NONE)
    offload: dict = field(default_factory=dict)
    #: Prefixes of cross references, by their name.
    references: dict[str, str] = field(default_factory=dict)


def stages(rules: list[Rule]) -> list[list[Rule]]:
    """Rules in levels: setters before testers, passes before all later rules. Raises CycleError on circles."""
    sets: dict[tuple, list[int]] = {}
    for i, r in enumerate(rules):
        for kind, bits in (("x", r.xbits), ("f", r.flexbits)):
            for b in bits:
                if b.action.startswith("set") or b.action == "unset":
                    sets.setdefault((kind, b.name), []).append(i)
    need: list[set[int]] = [set() for _ in rules]
    passes = [i for i, r in enumerate(rules) if r.action == "pass"]
    for i, r in enumerate(rules):
        for kind, bits in (("x", r.xbits), ("f", r.flexbits)):
            for b in bits:
                if b.action in ("isset", "isnotset", "count"):
                    need[i] |= set(sets.get((kind, b.name), ()))
        need[i] |= {p for p in passes if rules[p].position < r.position}
    level = [0] * len(rules)
    for turn in range(len(rules) + 1):
        moved = False
        for i, n in enumerate(need):
            at = max((level[j] + 1 for j in n), default=0)
            if at > level[i]:
                level[i], moved = at, True
        if not moved:
            break
        if turn == len(rules):
            raise CycleError("rules test bits that they set in a circle: " + ", ".join(str(rules[i].sid) for i in range(len(rules)) if i in need[i]))
    out: dict[int, list[Rule]] = {}
    for i, r in enumerate(rules):
        out.setdefault(level[i], []).append(r)
    return [out[k] for k in sorted(out)]


def _only(m: DataFrame, r: Rule) -> DataFrame:
    return m.where(F.col("rule_pos") == r.position)


def _rest(m: DataFrame, rules: list[Rule], held: list[int]) -> DataFrame | None:
    """Matches of the rules that are not held; None where all are, so that nothing is read for no rows."""
    left = [r.position for r in rules if r.position not in held]
    return m.where(F.col("rule_pos").isin(left)) if left else None


def _plus(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _looks(r: Rule) -> bool:
    return bool(r.blacklist or r.intel or r.country or r.reputation or r.offload)


@dataclass
class Passing:
    """What look-ups ask that is small enough to go along with the matches: countries' ranges, and string indicators by their type."""

    places: lookups.Places | None = None
    needles: dict[str, list[str]] = field(default_factory=dict)


_SIDES = {"by_src": ["src_ip"], "by_dst": ["dst_ip"], "both": ["src_ip", "dst_ip"]}


def _passing(rules: list[Rule], t: Tables) -> Passing:
    kinds = dict.fromkeys(k.upper() for r in rules for k in r.intel if k != "all" and k not in _SIDES) if t.intel is not None else {}
    few = {k: lookups.few_needles(t.intel, k) for k in kinds}
    return Passing(lookups.places(t.geo, t.geo_skip) if t.geo is not None and any(r.country for r in rules) else None, {k: v for k, v in few.items() if v is not None})


def _looks_apart(r: Rule, p: Passing) -> bool:
    """Whether its look-ups read the matches once more."""
    return bool(r.blacklist or r.reputation or r.offload) or any(k.upper() not in p.needles for k in r.intel) or bool(r.country) and p.places is None


def _tests(r: Rule) -> bool:
    return any(b.action in ("isset", "isnotset", "count") for b in r.xbits + r.flexbits)


def _readings(rules: list[Rule], passing: Passing) -> int:
    """How often a level's matches would be read if they weren't written."""
    apart = [r for r in rules if _looks_apart(r, passing)]
    plain = [r for r in rules if not (r in apart or _tests(r) or r.after or r.threshold)]
    return 2 * bool(apart) + 2 * any(map(_tests, rules)) + len({(*q.keys, q.kind) for r in rules for q in (r.after, r.threshold) if q}) + bool(plain)


_IDENT = ["event_seq", "rule_pos"]


def _table(df: DataFrame, rows: list[tuple], columns: str) -> DataFrame:
    """What rules ask for, as small as the rule set."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, columns))


def _scanned(m: DataFrame) -> DataFrame:
    """(event_seq, ip): the addresses in the messages of matches; messages without any are not shuffled."""
    return m.select("event_seq", "message").where(may_have_ip(F.col("message"))).dropDuplicates(["event_seq"]).select("event_seq", F.explode(ips(F.col("message"))).alias("ip"))


def _gate(m: DataFrame, rules: list[Rule], t: Tables, passing: Passing) -> DataFrame:
    """Matches whose look-ups hold. All rules of one kind of look-up share one join; the rows to keep are found from m itself, or told as they pass."""
    looks = [r for r in rules if _looks(r)]
    if not looks:
        return m
    asks: dict[tuple, list[int]] = {}
    for r in looks:
        for mode in r.blacklist:
            asks.setdefault(("blacklist", mode), []).append(r.position)
        for kind in r.intel:
            asks.setdefault(("intel", kind), []).append(r.position)
        for kind, track, cats, mdate, cdate in r.reputation:
            asks.setdefault(("reputation", kind, track, tuple(cats), mdate, cdate), []).append(r.position)
        if r.country:
            asks.setdefault(("country", r.country[0]), []).append(r.position)
        if r.offload:
            asks.setdefault(("offload", r.offload), []).append(r.position)
    tables = {"blacklist": t.blacklist, "intel": t.intel, "reputation": t.reputation, "country": t.geo, "offload": t.offload.get}
    out = m
    for (what, *how), positions in asks.items():
        mine = F.col("rule_pos").isin(positions)
        if tables[what] is None:
            out = out.where(~mine)
            continue
        x = m.where(mine)

        def by_address(out, found, sides, both_valid=False, mine=mine):
            """Rows of these rules stay if a side is among found(ip)."""
            hit = F.lit(False)
            for n, side in enumerate(sides):
                f = found.select(F.col("ip").alias(f"__ip{n}"))
                out = out.join(f, F.col(side) == F.col(f"__ip{n}"), "left")
                hit = hit | F.col(f"__ip{n}").isNotNull()
            if both_valid:
                hit = hit & ip_key(F.col("src_ip")).isNotNull() & ip_key(F.col("dst_ip")).isNotNull()
            return out.where(~mine | hit).drop(*(f"__ip{n}" for n in range(len(sides))))

        def by_event(out, found, on="event_seq", mine=mine):
            """Rows of these rules stay if their event (or match) is found."""
            on = [on] if isinstance(on, str) else on
            return out.join(found.select(*on).distinct().withColumn("__found", F.lit(True)), on, "left").where(~mine | F.col("__found").isNotNull()).drop("__found")

        if what == "blacklist":
            (mode,) = how
            if mode == "all":
                out = by_event(out, lookups.range_join(_scanned(x), "ip", t.blacklist))
            else:
                out = by_address(out, lookups.range_join(lookups.addresses(x, *_SIDES[mode]), "ip", t.blacklist), _SIDES[mode], mode == "both")
        elif what == "intel":
            (kind,) = how
            if kind == "all":
                out = by_event(out, lookups.intel_addresses(_scanned(x), t.intel, "ip"))
            elif kind in _SIDES:
                out = by_address(out, lookups.intel_addresses(lookups.addresses(x, *_SIDES[kind]), t.intel, "ip"), _SIDES[kind])
            elif kind.upper() in passing.needles:
                out = out.where(~mine | lookups.holds_any(F.col("message"), passing.needles[kind.upper()]))
            else:
                out = by_event(out, lookups.intel_strings(x.select("event_seq", "message").dropDuplicates(["event_seq"]), t.intel, kind.upper()))
        elif what == "country":
            side = _SIDES[how[0]][0]
            wants = _table(m, [(r.position, r.country[1], r.country[2]) for r in looks if r.country and r.country[0] == how[0]], "rule_pos int, __inside boolean, __codes array<string>")
            if passing.places is not None:
                out = lookups.located(out, F.when(mine, F.col(side)), passing.places, "__known")
            else:
                known = lookups.countries(lookups.addresses(x, side), t.geo, t.geo_skip).withColumnsRenamed({"ip": "__ip", "countries": "__known"})
                out = out.join(known, F.col(side) == F.col("__ip"), "left")
            out = out.join(wants, "rule_pos", "left")
            good = F.when(F.col("__inside"), F.arrays_overlap("__known", "__codes")).otherwise(F.size(F.array_except("__known", "__codes")) > 0)
            out = out.where(~mine | F.coalesce(F.col("__known").isNotNull() & good, F.lit(False))).select(m.columns)
        elif what == "reputation":
            kind, track, cats, mdate, cdate = how
            if kind == "file_hash":
                values = F.array("md5", "sha1", "sha256")
            elif kind in ("url", "filename", "ja3"):
                values = F.array(kind)
            elif track == "both":  # both have to be valid, as for block lists
                values = F.when(ip_key(F.col("src_ip")).isNotNull() & ip_key(F.col("dst_ip")).isNotNull(), F.array("src_ip", "dst_ip"))
            elif track == "all":
                values = ips(F.col("message"))
            else:
                values = F.array("dst_ip" if track == "by_dst" else "src_ip")
            look = x.select(*_IDENT, "event_time", F.explode(values).alias("__value"))
            out = by_event(out, lookups.reputation(look, t.reputation, kind, "__value", list(cats), t.categories, mdate, cdate), _IDENT)
        else:
            call = t.offload.get(how[0])
            out = out.where(~mine | call(F.concat_ws("|", *nine_fields(m))) if call else ~mine)
    return out


def nine_fields(df: DataFrame) -> list[Column]:
    """host, facility, priority, level, tag, date, time, program, message; date and time from event_time where they are no columns."""
    given = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    clock = {"date": F.date_format("event_time", "yyyy-MM-dd"), "time": F.date_format("event_time", "HH:mm:ss")}
    return [clock[c] if c in clock and c not in df.columns else given(c) for c in ("host", "facility", "priority", "level", "tag", "date", "time", "program", "message")]


def _bits(m: DataFrame, rules: list[Rule], xops: DataFrame | None, fsets: DataFrame | None, funsets: DataFrame | None, ends: tuple[str, ...]) -> DataFrame:
    """Matches whose isset, isnotset and count conditions hold; `correlation` names the setting event of the first.

    All xbits of a level are one pass, and all flexbits of one direction.
    """
    m = m.withColumn("correlation", F.lit(None).cast("string"))
    testers = [r for r in rules if _tests(r)]
    if not testers:
        return m
    asks = [(r.position, n, kind, b) for r in testers for n, (kind, b) in enumerate([*(("xbit", b) for b in r.xbits), *(("flexbit", b) for b in r.flexbits)]) if b.action in ("isset", "isnotset", "count")]
    ident = F.struct("event_seq", "rule_pos", F.col("__n").alias("n"), "name", F.col("__op").alias("op"), F.col("__number").alias("number"))
    kinds: dict[tuple, list] = {}
    for p, n, kind, b in asks:
        kinds.setdefault((kind, "" if kind == "xbit" else b.track, b.action == "count"), []).append((p, n, b.name, b.track, b.action if b.action != "count" else b.op, b.number))
    results = None
    lives = state.flexbit_lives(fsets, funsets, ends) if fsets is not None else None
    for (kind, track, count), rows in kinds.items():
        x = m.join(_table(m, rows, "rule_pos int, __n int, name string, __track string, __op string, __number int"), "rule_pos")
        if kind == "xbit":
            key = F.lit(None).cast("string")
            for k in state.XKEYS:
                key = F.when(F.col("__track") == k, F.concat_ws("|", F.lit(k), state.xbit_key(k))).otherwise(key)
            tests = x.select(ident.alias("id"), "name", key.alias("key"), *state.ORDER)
            got = state.xbit_state(tests, xops).select("id", F.col("is_set").cast("int").alias("records"), "by") if xops is not None else tests.select("id", F.lit(0).alias("records"), F.lit(None).cast("long").alias("by"))
        else:
            tests = x.select(ident.alias("id"), "name", *state._WHO, *state.ORDER)
            got = state.flexbit_matches(tests, lives, track, count).select("id", F.col("records").cast("int").alias("records"), "by") if lives is not None else tests.select("id", F.lit(0).alias("records"), F.lit(None).cast("long").alias("by"))
        found = F.when(F.col("id.op") == "isset", F.to_json(F.struct(F.col("id.name").alias(kind), F.col("by").alias("event_seq"))))
        n, op, k = F.col("records"), F.col("id.op"), F.col("id.number")
        ok = F.when(op == "isset", n > 0).when(op == "isnotset", n == 0).when(op == ">", n > k).when(op == "<", n < k).otherwise(n == k)
        got = got.select("id.event_seq", "id.rule_pos", "id.n", ok.alias("ok"), found.alias("found"))
        results = got if results is None else results.unionByName(got)
    verdict = results.groupBy(*_IDENT).agg(F.min("ok").alias("__ok"), F.min_by("found", F.when(F.col("found").isNotNull(), F.col("n"))).alias("__found"))
    mine = F.col("rule_pos").isin([r.position for r in testers])
    out = m.join(verdict, _IDENT, "left").where(~mine | F.coalesce("__ok", F.lit(False)))
    return out.withColumn("correlation", F.col("__found")).drop("__ok", "__found")


def _groups(rules: list[Rule], what: str) -> dict[tuple, list[Rule]]:
    groups: dict[tuple, list[Rule]] = {}
    for r in rules:
        q = getattr(r, what)
        if q:
            groups.setdefault((what, tuple(q.keys), "after" if what == "after" else q.kind), []).append(r)
    return groups


def _rate(m: DataFrame, rules: list[Rule], memory: Memory | None, left: Memory | None) -> DataFrame:
    """after, then threshold over what is left; one pass for all rules of equal tracks and mode.

    left: gets the counters' states for later batches, and memory has those of earlier ones.
    """
    for what in ("after", "threshold"):
        groups = _groups(rules, what)
        if not groups:
            continue
        if left is not None:
            m = cut(m)  # read for the rows and for the states
        held = [r.position for g in groups.values() for r in g]
        out = _rest(m, rules, held)
        for group, g in groups.items():
            _, keys, mode = group
            x = m.where(F.col("rule_pos").isin([r.position for r in g]))
            pick = lambda attr, g=g, what=what: F.create_map(*(F.lit(v) for r in g for v in (r.position, getattr(getattr(r, what), attr))))[F.col("rule_pos")]
            keyed = ["rule_pos", *keys]
            if left is None:
                new = state.suppress(x, keyed, pick("count"), pick("seconds")) if mode == "suppress" else state.counted(x, keyed, pick("count"), pick("seconds"), mode)
            else:
                name = "|".join((what, mode, *keys))
                old = memory.counters.where(F.col("name") == name).drop("name") if memory is not None else None
                new = state.counted(x, keyed, pick("count"), pick("seconds"), mode, before=old)
                now = state.counter_state(x, keyed, pick("count"), pick("seconds"), mode, before=old).withColumn("name", F.lit(name))
                left.counters = now if left.counters is None else left.counters.unionByName(now)
            out = _plus(out, new)
        m = out
    return m


@dataclass
class Memory:
    """What counters and bits remember between the batches of a stream."""

    counters: DataFrame | None = None
    xops: DataFrame | None = None
    fsets: DataFrame | None = None


def stateful(rules: list[Rule]) -> bool:
    """Whether rules remember events, so that a stream of them has to go through stream()."""
    return any(r.xbits or r.flexbits or r.after or r.threshold or r.action == "pass" for r in rules)


def run(events: DataFrame, rules: list[Rule], tables: Tables | None = None, memory: Memory | None = None, left: Memory | None = None) -> DataFrame:
    """Matches that fire: the event's columns, rule_pos, extracted fields and correlation.

    Stages before the last are written to the shared folder. Rules of `noalert`
    fire too (they set bits); alerts() leaves them out. A streaming frame gives
    a streaming frame for rules without memory and look-ups of many rows;
    stream() runs all rules. memory and left: what earlier batches of a stream
    left, and what this one leaves.
    """
    t = tables or Tables()
    if events.isStreaming and (stateful(rules) or any(map(_looks, rules))):
        raise ValueError("rules that remember events or look things up run over a stream by stream()")
    fired = funsets = stopped = None
    xops, fsets = (memory.xops, memory.fsets) if memory is not None else (None, None)
    ends: tuple[str, ...] = tuple(dict.fromkeys(b.track for r in rules for b in r.flexbits if b.action == "unset"))
    levels = stages(rules)
    passing = _passing(rules, t)
    for level in levels:
        m = candidates(events, level, t.templates)
        if stopped is not None:
            m = m.join(stopped, "event_seq", "left").where(F.col("stop").isNull() | (F.col("rule_pos") < F.col("stop"))).drop("stop")
        if _readings(level, passing) > 1:
            m = cut(m)
        m = _rate(_bits(_gate(m, level, t, passing), level, xops, fsets, funsets, ends), level, memory, left)
        setting = any(b.action.startswith("set") or b.action == "unset" for r in level for b in r.xbits + r.flexbits)
        if level is not levels[-1] or left is not None and setting:  # read again by each later stage, or kept
            m = cut(m)
        keys, bits, undone = [], [], []
        for r in level:
            keys += [(r.position, b.name, b.track, b.seconds if b.action == "set" else None) for b in r.xbits if b.action in ("set", "unset")]
            bits += [(r.position, b.name, b.action in ("set_srcport", "set_ports"), b.action in ("set_dstport", "set_ports"), b.seconds) for b in r.flexbits if b.action.startswith("set")]
            undone += [(r.position, b.name, b.track) for b in r.flexbits if b.action == "unset"]
        if keys:
            key = F.lit(None).cast("string")
            for k in state.XKEYS:
                key = F.when(F.col("__track") == k, F.concat_ws("|", F.lit(k), state.xbit_key(k))).otherwise(key)
            new = m.join(_table(m, keys, "rule_pos int, name string, __track string, expire long"), "rule_pos").select("name", key.alias("key"), *state.ORDER, "expire")
            xops = new if xops is None else xops.unionByName(new)
        who = ["name", "src_ip", "dst_ip", "src_port", "dst_port", F.coalesce("username", F.lit("")).alias("username"), *state.ORDER]
        if bits:
            new = m.join(_table(m, bits, "rule_pos int, name string, __sp boolean, __dp boolean, expire long"), "rule_pos").withColumns({c: F.when(F.col(k), F.col(c)).otherwise(0) for c, k in (("src_port", "__sp"), ("dst_port", "__dp"))}).select(*who, "expire")
            fsets = new if fsets is None else fsets.unionByName(new)
        if undone:
            new = m.join(_table(m, undone, "rule_pos int, name string, direction string"), "rule_pos").select(*who, "direction")
            funsets = new if funsets is None else funsets.unionByName(new)
        passing = [r.position for r in level if r.action == "pass"]
        if passing:
            now = m.where(F.col("rule_pos").isin(passing)).groupBy("event_seq").agg(F.min("rule_pos").alias("stop"))
            stopped = now if stopped is None else stopped.unionByName(now).groupBy("event_seq").agg(F.min("stop").alias("stop"))
        fired = m if fired is None else fired.unionByName(m)
    if left is not None:
        left.xops = state.xbit_left(xops) if xops is not None else None
        if fsets is not None:
            since = F.lit(events.agg(F.min(state.seconds())).first()[0] or 0)
            left.fsets = state.flexbit_left(state.flexbit_lives(fsets, funsets, ends), since)
    return fired if fired is not None else candidates(events, [], t.templates).withColumn("correlation", F.lit(None).cast("string"))


_MEMORY = {"counters": "name string, k string, c long, u long", "xops": "name string, key string, event_time timestamp, event_seq long, rule_pos int, expire long", "fsets": "name string, src_ip string, dst_ip string, src_port int, dst_port int, username string, event_time timestamp, event_seq long, rule_pos int, expire long"}


def stream(events: DataFrame, rules: list[Rule], out: Callable[[DataFrame, int], None], memory_dir: str, tables: Tables | None = None):
    """A writer of a streaming frame (start it with a checkpoint): out(fired, batch) gets what fires in every batch.

    Each batch goes through run() with what counters and bits remember. That is
    written to memory_dir under the batch's number before out is called, so a
    batch that runs again begins from the same and gives the same; the memory
    before the last batch's is deleted. Events that come in order of time give
    what run() gives over all of them; late ones are taken in as they come.
    """
    spark = events.sparkSession
    stages(rules)  # refuse what can't run before the stream starts
    base = memory_dir.rstrip("/")

    def one(df: DataFrame, batch: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
        old = Memory(**{n: spark.read.schema(k).parquet(f"{base}/{batch - 1}/{n}") for n, k in _MEMORY.items()}) if fs.exists(path(f"{base}/{batch - 1}/done")) else None
        left = Memory()
        fired = cut(run(cut(df), rules, tables, old, left))
        for n, k in _MEMORY.items():
            new = getattr(left, n)
            if new is None:
                new = getattr(old, n) if old is not None else spark.createDataFrame([], k)
            if n == "counters" and old is not None:  # keys that this batch didn't meet
                names = [f.split()[0] for f in k.split(", ")]
                new = new.unionByName(old.counters.join(new.select("name", "k"), ["name", "k"], "left_anti").select(*names))
            cast = [F.col(f.split()[0]).cast(f.split()[1]) for f in k.split(", ")]
            new.select(*cast).write.mode("overwrite").parquet(f"{base}/{batch}/{n}")
        fs.create(path(f"{base}/{batch}/done"), True).close()
        out(fired, batch)
        fs.delete(path(f"{base}/{batch - 2}"), True)

    return events.writeStream.foreachBatch(one)


_RULE = "rule_pos int, sid long, rev int, msg string, classtype string, severity int, action string, metadata string, ruleset string, noalert boolean, nolog boolean, noeve boolean, email string, external string, rule string, xref string"


def cross_reference(r: Rule, prefixes: dict[str, str]) -> str | None:
    """A rule's references as "[Xref => url]", in their order; those of unknown kinds are left out."""
    return " ".join(f"[Xref => {prefixes[k]}{v}]" for k, v in r.references if k in prefixes) or None


def rules_table(events: DataFrame, rules: list[Rule], references: dict[str, str] | None = None) -> DataFrame:
    """One row a rule, for the metadata join; as small as the rule set."""
    rows = [(r.position, r.sid, r.rev, r.msg, r.classtype, r.priority, "blocked" if r.action == "drop" else "allowed", metadata_json(r), r.ruleset, r.noalert, r.nolog, r.noeve, r.email, r.external, r.text, cross_reference(r, references or {})) for r in rules]
    return events.sparkSession.createDataFrame(rows, _RULE)


def alerts(events: DataFrame, rules: list[Rule], tables: Tables | None = None, fired: DataFrame | None = None) -> DataFrame:
    """Alert rows of all fired rules that aren't `noalert`, with the rule's own columns."""
    t = tables or Tables()
    m = fired if fired is not None else run(events, rules, t)
    out = m.join(F.broadcast(rules_table(events, rules, t.references)), "rule_pos").where("not noalert")
    if t.classes is not None:
        return lookups.classify(out, t.classes)
    return out.withColumn("category", F.lit("UNKNOWN"))


def fired_rulesets(fired: DataFrame, rules: list[Rule]) -> DataFrame:
    """(ruleset, fired): matches of each rule file, those that never fired with 0."""
    r = rules_table(fired, rules).select("rule_pos", "ruleset")
    return F.broadcast(r).join(fired.select("rule_pos"), "rule_pos", "left").groupBy("ruleset").agg(F.count(fired["rule_pos"]).alias("fired"))


def dynamic(events: DataFrame, rules: list[Rule], load, sample: int, tables: Tables | None = None, mode: str = "load") -> list[Rule]:
    """The rules to run: those given, without `dynamic_load`, and, in mode "load", the rule sets that their dynamic ones call for.

    Dynamic rules look at every sample-th event; load(path) gives a rule set's
    rules. In the modes "log" and "alert" nothing is loaded: dynamic_calls()
    says what would be.
    """
    if mode not in ("load", "log", "alert"):
        raise ValueError(f"unknown mode {mode!r}")
    rest = [r for r in rules if not r.dynamic_load]
    if mode == "load":
        on = {r.ruleset for r in dynamic_calls(events, rules, sample, tables).select("ruleset").collect()}  # at most one row a dynamic rule
        for path in dict.fromkeys(r.dynamic_load for r in rules if r.dynamic_load in on):
            for r in load(path):
                r.position = len(rules) + len(rest)
                rest.append(r)
    return rest


def dynamic_calls(events: DataFrame, rules: list[Rule], sample: int, tables: Tables | None = None) -> DataFrame:
    """(ruleset, sid, msg, event_seq): the first event, of every sample-th, that calls for each rule set; for its log line or alert."""
    dyn = [r for r in rules if r.dynamic_load]
    named = _table(events, [(r.position, r.dynamic_load, r.sid, r.msg) for r in dyn], "rule_pos int, ruleset string, sid long, msg string")
    hit = run(events.where(F.col("event_seq") % sample == 0), dyn, tables).select(*state.ORDER)
    return hit.join(named, "rule_pos").groupBy("ruleset").agg(F.min_by(F.struct("sid", "msg", "event_seq"), F.struct(*state.ORDER)).alias("x")).select("ruleset", "x.*")
