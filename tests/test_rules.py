"""Rule text, state machines and streams."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rookery.operators import state
from rookery.plans import engine
from rookery.plans.rules import RuleError, load_variables, parse_rule, parse_rules, pcre_to_java, to_seconds, unhex
from rookery.sources.logs import documents_as_logs

HEAD = "alert any any any -> any any"


def test_a_full_rule():
    r = parse_rule('alert tcp [!10.0.0.0/8, 192.168.0.0/16] any -> $HOME 22:25 (msg:"a; b: c"; program: sshd|drop*; content:"x|3b|y"; nocase; content:!"z"; offset: 3; depth: 9; pcre:"/a\\d+/i"; parse_src_ip: 1; threshold: type suppress, track by_src&by_dstport, count 5, seconds 300; classtype: misc; priority: 1; metadata: a b c, d e; sid: 7; rev: 2;)', {"HOME": "172.16.0.0/12"}, {"misc": 3})
    assert (r.msg, r.sid, r.rev, r.priority, r.proto) == ("a; b: c", 7, 2, 1, 6)
    assert r.src_nets == [(True, "10.0.0.0/8"), (False, "192.168.0.0/16")] and r.dst_nets == [(False, "172.16.0.0/12")] and r.dst_ports == [(False, 22, 25)]
    assert r.contents[0].needles == ["x;y"] and r.contents[0].nocase and r.contents[1].negated and r.contents[1].depth == 9
    assert r.pcres == ["(?i)a\\d+"] and r.threshold.keys == ["src_ip", "dst_port"] and r.metadata == {"a": ["b", "c"], "d": ["e"]}
    assert parse_rule(r.text, {"HOME": "172.16.0.0/12"}, {"misc": 3}) == r


@pytest.mark.parametrize("text", [f'{HEAD} (msg:"a"; sid:1;)', f'{HEAD} (msg:"a"; rev:1;)', f"{HEAD} (sid:1; rev:1;)", f'{HEAD} (msg:"a"; nonsense: 1; sid:1; rev:1;)', f'{HEAD} (msg:"a"; classtype: no; sid:1; rev:1;)', 'alert any [10.0.0.0/8 any -> any any (msg:"a"; sid:1; rev:1;)', 'alert any 10.0.0.300 any -> any any (msg:"a"; sid:1; rev:1;)', f'{HEAD} (msg:"a"; pcre:"/a/R"; sid:1; rev:1;)', f'{HEAD} (msg:"a"; pcre:"/a/U"; sid:1; rev:1;)', f'{HEAD} (msg:"a"; threshold: type limit, track by_src, count 0, seconds 3; sid:1; rev:1;)', 'shout any any any -> any any (msg:"a"; sid:1; rev:1;)'])
def test_what_is_no_rule(text):
    with pytest.raises(RuleError):
        parse_rule(text, {}, {"misc": 1})


def test_files_and_values(tmp_path):
    one = f'{HEAD} (msg:"a"; sid:1; rev:1;)'
    assert len(parse_rules(f"# c\n\n;x\n{one}\n")) == 1
    with pytest.raises(RuleError):
        parse_rules(f"{one}\n{one}")
    (tmp_path / "l").write_text("a\n#b\nc\n")
    assert load_variables({"A": "file:l", "B": "x,$A"}, str(tmp_path)) == {"A": "a,c", "B": "x,a,c"}
    assert unhex("a|41 42|") == "aAB" and pcre_to_java("/a$/iE") == "(?i)a\\z" and to_seconds("3 days") == 259200


def test_bit_circles_are_refused():
    rules = parse_rules(f'{HEAD} (msg:"a"; xbits: isset,x,track ip_src; xbits: set,y,track ip_src,expire 9; sid:1; rev:1;)\n{HEAD} (msg:"b"; xbits: isset,y,track ip_src; xbits: set,x,track ip_src,expire 9; sid:2; rev:1;)')
    with pytest.raises(engine.CycleError):
        engine.stages(rules)


@given(st.lists(st.integers(0, 60), max_size=30), st.integers(1, 3), st.integers(1, 15), st.sampled_from(["limit", "suppress", "after"]))
def test_counter_machine(gaps, n, s, mode):
    """The step function against the machines written out."""
    t, got, want = 0, [], []
    st_, c, u = None, 0, 0
    for i, g in enumerate(gaps):
        t += g
        st_, emit = state.limit_step(st_, t, n, s, mode)
        got.append(emit)
        if i == 0:
            c, u = 1, t
            want.append(mode != "after")
            continue
        c, old = c + 1, t - u
        if mode == "suppress":
            u = t
        if old > s:
            c, u = 1, t
        if mode == "after":
            if c > n:
                u = t
            want.append(c > n)
        else:
            want.append(c <= n)
    assert got == want


def _sequence(spark):
    import random

    rng = random.Random(6)
    rows, t = [], 1_700_000_000
    for i in range(600):
        t += rng.choice([0, 0, 1, 3, 10, 11, 40])
        rows.append((i, t, f"k{rng.randrange(5)}", 0, rng.choice(["set", "unset", "isset", "isnotset"])))
    return rows, spark.createDataFrame(rows, "event_seq long, t long, key string, rule_pos int, op string").withColumn("event_time", F.timestamp_seconds("t"))


@pytest.mark.parametrize("mode", ["limit", "suppress", "after"])
def test_batch_operators_follow_the_machine(spark, mode):
    rows, df = _sequence(spark)
    states, want = {}, set()
    for i, t, k, _, _ in rows:
        states[k], emit = state.limit_step(states.get(k), t, 3, 10, mode)
        if emit:
            want.add(i)
    out = state.suppress(df, ["key"], F.lit(3), F.lit(10)) if mode == "suppress" else state.counted(df, ["key"], F.lit(3), F.lit(10), mode)
    assert {r.event_seq for r in out.collect()} == want


def test_xbits_follow_the_machine(spark):
    rows, df = _sequence(spark)
    want = state.simulate_bits([{"op": o, "name": "n", "key": k, "t": t, "expire": 20} for _, t, k, _, o in rows])
    tests = df.where("op like 'is%'").withColumn("name", F.lit("n")).withColumn("id", F.col("event_seq"))
    ops = df.where("op not like 'is%'").withColumn("name", F.lit("n")).withColumn("expire", F.when(F.col("op") == "set", 20).cast("long"))
    got = {r.id: r.is_set for r in state.xbit_state(tests, ops).collect()}
    kinds = [(i, o) for i, _, _, _, o in rows if o.startswith("is")]
    assert [got[i] == (o == "isset") for i, o in kinds] == want


@pytest.mark.parametrize("mode", ["after", "xbit"])
def test_streams_equal_batches(spark, tmp_path, mode):
    from rookery.streaming.state import stateful

    rows, df = _sequence(spark)
    full = df.withColumn("n", F.lit(3)).withColumn("s", F.lit(10)).drop("t")
    last = spark.createDataFrame([(10_000, "zz", 0, "set" if mode == "xbit" else "")], "event_seq long, key string, rule_pos int, op string").withColumn("event_time", F.timestamp_seconds(F.lit(1_800_000_000))).withColumn("n", F.lit(3)).withColumn("s", F.lit(10))
    for i, part in enumerate((full.where("event_seq < 300"), full.where("event_seq >= 300"), last)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    src = spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = stateful(src, mode).writeStream.format("memory").queryName(f"out_{mode}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_seq for r in spark.table(f"out_{mode}").collect()}
    if mode == "after":
        want = {r.event_seq for r in state.counted(full, ["key"], F.col("n"), F.col("s"), "after").collect()}
    else:
        res = state.simulate_bits([{"op": o, "name": "n", "key": k, "t": t, "expire": 10} for _, t, k, _, o in rows])
        want = {i for i, ok in zip([i for i, _, _, _, o in rows if o.startswith("is")], res) if ok}
    assert got == want


def test_reputation_tracks_and_hashes(spark):
    sha1, sha256, md5 = "ab" * 20, "cd" * 32, "ef" * 16
    texts = ["from 8.8.8.8 to 9.9.9.9 by 7.7.7.7", "from 9.9.9.9 to 8.8.8.8 by 7.7.7.7", "from 8.8.8.8 to 7.7.7.7 by 9.9.9.9", "from 9.9.9.9", f"file {sha1} x", f"file {sha256} x", f"file {md5} x"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rep = spark.createDataFrame([("ip_reputation", "9.9.9.9", 1, 0, 0), *[("file_hash", x, 1, 0, 0) for x in (sha1, sha256, md5)]], "kind string, value string, code int, ctime long, mtime long")

    def got(option):
        rules = parse_rules(f'{HEAD} (msg:"a"; parse_src_ip: 1; parse_dst_ip: 2; parse_hash: md5; parse_hash: sha1; parse_hash: sha256; reputation: {option}, bad; sid:1; rev:1;)')
        return sorted(r.event_seq for r in engine.run(documents_as_logs(docs), rules, engine.Tables(reputation=rep, categories={"bad": 1})).collect())

    assert got("type ip_reputation, track by_dst") == [0] and got("type ip_reputation, track both") == [0, 1, 3]  # an address missing from the message is the host
    assert got("type ip_reputation, track all") == [0, 1, 2, 3] and got("type ip_reputation, track by_src") == [1, 3]
    assert got("type file_hash") == [4, 5, 6]
    for bad in ("type ip_reputation, track any", "type unknown"):
        with pytest.raises(RuleError):
            got(bad)


def test_negated_networks_without_brackets():
    r = parse_rule('alert any not 10.0.0.0/8 any -> !192.168.0.0/16 not 80 (msg:"a"; sid:1; rev:1;)')
    assert r.src_nets == [(True, "10.0.0.0/8")] and r.dst_nets == [(True, "192.168.0.0/16")] and r.dst_ports == [(True, 80, 80)]


def test_running_is_a_window_cut_by_time(spark, monkeypatch):
    from pyspark.sql import Window

    _, df = _sequence(spark)
    value = F.col("event_seq") % 17
    w = Window.partitionBy("key").orderBy(*state.ORDER)
    for seconds_ in (7, 3600):
        monkeypatch.setattr(state, "BUCKET", seconds_)
        for how, f in (("max", F.max), ("min", F.min), ("sum", F.sum)):
            for after, span in ((False, (Window.unboundedPreceding, -1)), (True, (1, Window.unboundedFollowing))):
                got = {r.event_seq: r.x for r in state.running(df, ["key"], value, how, "x", after=after).select("event_seq", "x").collect()}
                want = {r.event_seq: r.x for r in df.withColumn("x", f(value).over(w.rowsBetween(*span))).select("event_seq", "x").collect()}
                assert got == {k: (v or 0) if how == "sum" else v for k, v in want.items()}


RULES = f"""
{HEAD} (msg:"plain"; content:"c"; sid:1; rev:1;)
{HEAD} (msg:"limit"; program: a|b; threshold: type limit, track by_src, count 2, seconds 60; sid:2; rev:1;)
{HEAD} (msg:"suppress"; program: b; threshold: type suppress, track by_username, count 1, seconds 20; sid:3; rev:1;)
{HEAD} (msg:"after"; after: track by_src, count 4, seconds 100; sid:4; rev:1;)
{HEAD} (msg:"set"; program: a; xbits: set,x,track ip_src,expire 40; flexbits: set,f,70; sid:5; rev:1;)
{HEAD} (msg:"unset"; program: b; xbits: unset,x,track ip_src; flexbits: unset,by_src,f; sid:6; rev:1;)
{HEAD} (msg:"is"; program: c; xbits: isset,x,track ip_src; sid:7; rev:1;)
{HEAD} (msg:"is not"; program: c; xbits: isnotset,x,track ip_src; sid:8; rev:1;)
{HEAD} (msg:"flex"; program: c; flexbits: isset,username,f; sid:9; rev:1;)
{HEAD} (msg:"flex not"; program: c; flexbits: isnotset,by_src,f; sid:10; rev:1;)
{HEAD} (msg:"count"; program: c; flexbits: count,by_dst,f,>1; sid:11; rev:1;)
pass any any any -> any any (msg:"pass"; content:"c9"; sid:12; rev:1;)
{HEAD} (msg:"later"; program: c; sid:13; rev:1;)
"""


def _log(spark, n=500):
    import random

    rng = random.Random(15)
    rows, t = [], 1_700_000_000
    for i in range(n):
        t += rng.choice([0, 1, 5, 20, 30])
        p, k = rng.choice("abc"), rng.randrange(4)
        rows.append((i, t, p, f" {p}{rng.randrange(12)}", f"10.0.0.{k}", "10.1.1.1", f"u{(k + rng.randrange(2)) % 3}"))
    return spark.createDataFrame(rows, "event_seq long, t long, program string, message string, src_ip string, host string, username string").withColumn("event_time", F.timestamp_seconds("t")).drop("t")


def test_a_stream_of_rules_equals_the_batch(spark, tmp_path):
    events, rules = _log(spark), parse_rules(RULES)
    want = sorted((r.event_seq, r.rule_pos) for r in engine.run(events, rules).collect())
    assert {p for _, p in want} == set(range(13))
    for i in range(3):
        events.where(f"event_seq >= {i * 170} and event_seq < {i * 170 + 170}").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    src = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = engine.stream(src, rules, lambda df, n: df.select("event_seq", "rule_pos").write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}")), str(tmp_path / "memory")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(600)
    assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.event_seq, r.rule_pos) for r in got.collect()) == want and got.select("batch").distinct().count() == 3


def test_rules_without_memory_run_on_a_streaming_frame(spark, tmp_path):
    events = _log(spark, 50)
    events.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    plain = parse_rules(f'{HEAD} (msg:"p"; content:"c"; sid:1; rev:1;)')
    q = engine.run(src, plain).writeStream.format("memory").queryName("plain").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("plain").count() == events.where("message like '%c%'").count()
    with pytest.raises(ValueError, match="stream"):
        engine.run(src, parse_rules(RULES))


def test_the_shared_folder_has_to_be_named_on_a_cluster():
    from types import SimpleNamespace

    from rookery.operators.cut import shared_path

    none = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_path(none)


def test_flattened_json_of_any_depth(spark):
    from rookery.functions import jsonflat

    deep = "{" + '"a":{' * 300 + '"b":"x"' + "}" * 301
    rows = [(0, deep), (1, '{"a":{"b":{"c":{"d":{"e":{"f":6}}}}}}'), (2, "{bad"), (3, None), (4, "{}"), (5, '{"s":"{\\"t\\":{\\"u\\":1}}","l":[{"m":1}]}')]
    got = {r.i: dict(r.p) if r.p is not None else None for r in spark.createDataFrame(rows, "i int, j string").select("i", jsonflat.flatten(F.col("j")).alias("p")).collect()}
    assert got[0][".a" * 300 + ".b"] == "x" and len(got[0]) == 302 and got[1][".a.b.c.d.e.f"] == "6" and len(got[1]) == 7
    assert got[2] == {"": "{bad"} and got[3] is None and got[4] == {"": "{}"} and got[5][".s.t.u"] == "1" and got[5][".l"] == '[{"m":1}]'
