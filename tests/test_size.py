"""What only shows on larger or odd inputs."""

import pytest
from pyspark.sql import functions as F

from rookery.operators import lookups


def test_thousands_of_short_indicators(spark):
    long = "x" * 70
    needles = [f"red {i}" for i in range(3000)] + ["é", "Straße 5", long + "ab", "nd"]
    texts = ["a RED 2999 b", "red 3", "red", "", None, "cafÉ", "die STRASSE 5", "die straße 5", long + "ac", long + "AB", "an", "d an", "xan d", "red\t1", "and"]
    docs = spark.createDataFrame(list(enumerate(texts)), "event_seq long, message string")
    intel = spark.createDataFrame([(n, "X") for n in needles], "indicator string, type string")
    got = {r.event_seq for r in lookups.intel_strings(docs, intel, "X").collect()}
    assert got == {i for i, t in enumerate(texts) if t and any(n.lower() in t.lower() for n in needles)} == {0, 1, 5, 7, 9, 14}


def test_programs_get_their_lines_as_they_come(spark):
    from rookery import sinks
    from rookery.plans import engine
    from rookery.plans.rules import parse_rules

    head = "alert any any any -> any any"
    rules = parse_rules(f'{head} (msg:"a"; external: "cat"; program: a; sid:1; rev:1;)\n{head} (msg:"b"; external: "head -n 3"; program: b; sid:2; rev:1;)\n{head} (msg:"c"; program: c; sid:3; rev:1;)')
    log = spark.range(0, 90_000, 1, 3).selectExpr("id as event_seq", "timestamp_seconds(id) as event_time", "substr('abc', cast(id % 3 as int) + 1, 1) as program", "concat(' one two ', id) as message", "'10.0.0.1' as host")
    out = sinks.pipe_external(engine.alerts(log, rules))
    assert out.rdd.getNumPartitions() == 3
    got = {r.command: r["count"] for r in out.groupBy("command").count().collect()}
    assert got == {"cat": 30_000, "head -n 3": 9}
    with pytest.raises(Exception, match="CalledProcessError"):
        sinks.pipe_external(engine.alerts(log, rules), "false").count()
    begun = list(zip(range(3), sinks._through("cat", (str(n) for n in iter(int, 1)))))  # input that never ends
    assert len(begun) == 3 and begun[0][1][0] == "0"


def test_addresses_cost_little_where_there_are_none(spark):
    import time

    from rookery.functions import net

    odd = spark.createDataFrame([(0, "a 1.2.3.4 :443  b"), (1, "fe80::10000#53 fe80::ffff#53"), (2, "x_y#7.7.7.7. 8.8.8.8 Source Port: 53, 9.9.9.9"), (3, None), (4, "12:30:45 1:2:3:4:5:6:7:8 port 7")], "i int, m string")
    got = {r.i: [tuple(x) for x in r.x or []] for r in odd.select("i", net.ip_scan(F.col("m")).alias("x")).collect()}
    assert got == {0: [("1.2.3.4", 0)], 1: [("fe80::ffff", 53)], 2: [("7.7.7.7", 0), ("8.8.8.8", 53), ("9.9.9.9", 0)], 3: [], 4: [("1:2:3:4:5:6:7:8", 7)]}
    texts = spark.range(0, 400, 1, 8).select(F.repeat(F.concat(F.lit("some words (of prose), and: "), F.col("id").cast("string"), F.lit(" numbers. ")), 2000).alias("m")).cache()
    texts.count()

    def took(c):
        best = 1e9
        for _ in range(3):
            t = time.time()
            texts.select(c.alias("x")).where("x").count()
            best = min(best, time.time() - t)
        return best

    assert took(F.size(net.ip_scan(F.col("m"))) > 0) < 0.2 + 4 * took(F.col("m").rlike(r"\d\.\d{1,3}\.\d{1,3}\.\d|::"))


@pytest.mark.parametrize("mode", ["limit", "suppress", "after"])
def test_one_key_is_many_tasks_work(spark, mode):
    from rookery.operators import state

    rows = [(i, 0, t) for i, t in enumerate(sorted((j * j * 7) % 400 // 3 * 3 for j in range(4000)))]
    df = spark.createDataFrame(rows, "event_seq long, rule_pos int, t long").select("event_seq", "rule_pos", F.timestamp_seconds("t").alias("event_time"), F.lit("k").alias("key"))
    n, want, st = 30, set(), None
    for i, _, t in rows:
        st, emit = state.limit_step(st, t, n, 5, mode)
        want |= {i} if emit else set()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = state.suppress if mode == "suppress" else lambda *a: state.counted(*a, mode)
        got = f(df, ["key"], F.lit(n), F.lit(5)).select("event_seq", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.event_seq for r in got} == want and len(got) == len(want) > 20
    assert mode == "suppress" or len({r.p for r in got}) > 1


def test_messages_without_addresses_are_not_shuffled(spark):
    from rookery.plans import engine

    m = spark.range(10).selectExpr("id as event_seq", "concat('from ', id, '.2.3.', if(id = 3, '4', 'x')) as message")
    found = engine._scanned(m)
    assert [tuple(r) for r in found.collect()] == [(3, "3.2.3.4")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan[plan.index("Aggregate") :].split("\n", 1)[1]


def test_protocol_words_are_looked_for_where_they_can_be(spark):
    from rookery.functions import net

    odd = spark.createDataFrame([(0, "a TCP b"), (1, "x udp"), (2, "IcMp."), (3, "-icmp-"), (4, "xtcp udpx"), (5, "İCMP tcpdump"), (6, None), (7, "udp tcp")], "i int, m string")
    c = net.proto_scan(F.col("m")).alias("p")
    assert {r.i: r.p for r in odd.select("i", c).collect()} == {0: 6, 1: 17, 2: None, 3: 1, 4: None, 5: None, 6: None, 7: 6}
    plan = odd.select(c)._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.index("Contains(lower(") < plan.index("RLIKE")


def test_indicators_are_tested_instead_of_rows(spark):
    from rookery.functions import net

    m = spark.range(12).selectExpr("id as event_seq", "concat('from ', if(id % 2 = 0, '8.8.8.', '10.0.0.'), id % 4, ' port 7') as message")
    scanned = m.select("event_seq", F.explode(net.ips(F.col("message"))).alias("src_ip"))
    intel = spark.createDataFrame([("8.8.8.0", "ADDR"), ("8.8.8.0", "ADDR"), ("10.0.0.1", "ADDR"), ("8.8.8.2", "URL"), (None, "ADDR"), ("none", "ADDR")], "indicator string, type string")
    found = lookups.intel_addresses(scanned, intel)
    assert sorted((r.event_seq, r.src_ip) for r in found.collect()) == [(0, "8.8.8.0"), (4, "8.8.8.0"), (8, "8.8.8.0")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    rows = plan[plan.index("Join LeftSemi") : plan.index("Aggregate")]
    assert "format_string" in plan and "format_string" not in rows and "destination" not in rows


_CIDRS = [("8.0.0.0/7", "de"), ("8.8.0.0/16", "FR"), ("8.8.8.0/24", None), ("9.9.9.9", "US"), ("20.0.0.0/8", None), ("0.0.0.0/0", "XX"), ("2001:db8::/32", "JP"), ("2001:db8:1::/48", "us"), ("10.0.0.0/8", "DE"), ("bad", "DE")]
_ODD = ["8.8.8.8", "8.8.9.8", "9.1.1.1", "9.9.9.9", "9.9.200.1", "20.1.1.1", "10.0.0.7", "127.0.0.1", "::ffff:8.8.8.8", "2001:db8::1", "2001:DB8:1::1", "2001:db8:2::1", "2002::1", "fe80::1", "300.1.1.1", "name", "", None, "8.8.8.8"]


def _places(spark):
    geo = lookups.ranges(spark, _CIDRS, "cidr string, country string")
    skip = lookups.ranges(spark, [("9.9.0.0/17",), ("2001:db8:2::/48",), ("9.9.0.0/18",)])
    return geo, skip, spark.createDataFrame(list(enumerate(_ODD)), "event_seq long, src_ip string")


def test_country_rules_write_no_messages(spark, monkeypatch):
    from rookery.plans import engine
    from rookery.plans.rules import parse_rules

    geo, skip, df = _places(spark)
    log = df.selectExpr("event_seq", "timestamp_seconds(event_seq) as event_time", "concat('from ', src_ip, ' on') as message", "'10.0.0.1' as host")
    rules = parse_rules('alert any any any -> any any (msg:"a"; parse_src_ip: 1; country_code: track by_src, isnot [DE,XX]; sid:1; rev:1;)\nalert any any any -> any any (msg:"b"; parse_src_ip: 1; country_code: track by_src, is [US]; sid:2; rev:1;)\nalert any any any -> any any (msg:"c"; sid:3; rev:1;)')
    run = lambda: engine.run(log, rules, engine.Tables(geo=geo, geo_skip=skip)).select("event_seq", "rule_pos")
    cuts = []
    monkeypatch.setattr(engine, "cut", lambda df, cut=engine.cut: cuts.append(1) or cut(df))
    few = run()
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert not cuts and plan.count("regexp_extract_all") == 1
    rows = sorted(map(tuple, few.collect()))
    assert {r for r in rows if r[1] < 2} == {(0, 0), (1, 0), (9, 0), (10, 0), (10, 1), (18, 0)} and sum(p == 2 for _, p in rows) == len(_ODD)
    monkeypatch.setattr(lookups, "FEW_RANGES", 2)  # more than these are joined with the distinct addresses
    assert lookups.places(geo) is None and lookups.places(geo.limit(1), geo) is None
    assert sorted(map(tuple, run().collect())) == rows and cuts


def test_countries_of_few_ranges_go_along(spark):
    geo, skip, df = _places(spark)
    for table, places in ((None, lookups.places(geo)), (skip, lookups.places(geo, skip))):
        want = {r.ip: sorted(r.countries) for r in lookups.countries(lookups.addresses(df, "src_ip"), geo, table).collect()}
        got = lookups.located(df, F.col("src_ip"), places, "known").collect()
        assert len(got) == len(_ODD) and {r.event_seq: sorted(r.known or []) for r in got} == {i: want.get(ip, []) for i, ip in enumerate(_ODD)}


def test_few_strings_are_tested_in_passing(spark, monkeypatch):
    from rookery.plans import engine
    from rookery.plans.rules import parse_rules

    texts = ["An MIT License", "mail1.EXAMPLE.com", "none", None, "mit license of mail1.example.com", ""]
    log = spark.createDataFrame(list(enumerate(texts)), "event_seq long, message string").selectExpr("*", "timestamp_seconds(event_seq) as event_time", "'10.0.0.1' as host")
    intel = spark.createDataFrame([("MIT license", "SOFTWARE"), ("", "SOFTWARE"), (None, "DOMAIN"), ("mail1.example.com", "DOMAIN")], "indicator string, type string")
    rules = parse_rules("\n".join(f'alert any any any -> any any (msg:"a"; {o} sid:{i}; rev:1;)' for i, o in enumerate(("zeek-intel: software;", "zeek-intel: domain;", "zeek-intel: domain,software;", "zeek-intel: url;", 'content:"none";'), 1)))
    run = lambda: engine.run(log, rules, engine.Tables(intel=intel)).select("event_seq", "rule_pos")
    cuts = []
    monkeypatch.setattr(engine, "cut", lambda df, cut=engine.cut: cuts.append(1) or cut(df))
    few = run()
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert not cuts and "Join" not in plan and "Aggregate" not in plan
    rows = sorted(map(tuple, few.collect()))
    assert rows == [(0, 0), (1, 1), (2, 4), (4, 0), (4, 1), (4, 2)]
    monkeypatch.setattr(lookups, "FEW_NEEDLES", 0)
    assert sorted(map(tuple, run().collect())) == rows and cuts
