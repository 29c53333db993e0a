"""Queries over the driver's tables for the operators of the inventory, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions import jsonflat, net, text
from .operators import lookups, state
from .operators.cut import shared_path
from .plans import engine
from .plans.compiler import Templates
from .plans.rules import Rule, parse_rules
from .sources import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EV = """ev as (select event_id as event_seq, ts as event_time, cast(floor(epoch(ts)) as bigint) as t, event_type as program,
 case when event_type = 'purchase' then 'auth' else 'user' end as facility, case when event_type = 'error' then 'alert' else 'info' end as priority,
 case when event_type = 'error' then 'err' else 'info' end as level, '10.0.0.1' as host,
 ' ' || event_type || ' user=' || user_id || ' cents=' || cast(round(value * 100) as bigint) as message,
 '10.' || ((user_id // 65536) % 256) || '.' || ((user_id // 256) % 256) || '.' || (user_id % 256) as src_ip, '10.0.0.1' as dst_ip,
 cast(user_id as varchar) as username, user_id, props as json_original from events)"""
DOC = "doc as (select doc_id as event_seq, source as program, lang as tag, text as message from documents)"
VALID = "length(message) >= 2 and not regexp_matches(substr(message, 1, 2), '[\\r\\n]')"


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark, d) -> DataFrame:
    return logs.events_as_logs(_table(spark, d, "events"))


def _docs(spark, d) -> DataFrame:
    return logs.documents_as_logs(_table(spark, d, "documents"))


def _json(e: DataFrame) -> DataFrame:
    return e.withColumn("json", jsonflat.flatten(F.col("json_original")))


def rule(options: str, sid: int = 1, head: str = "alert any any any -> any any") -> str:
    return f'{head} (msg:"rule {sid}"; {options} sid:{sid}; rev:1;)'


def _rules(*options: str, **kw) -> list[Rule]:
    return parse_rules("\n".join(o if o.split()[0] in ("alert", "pass", "drop") else rule(o, i + 1) for i, o in enumerate(options)), **kw)


def _add(name: str, f, sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE_SQL[name] = sql


def _stateless(name, source, options, where, columns=(), sql_columns="", templates=None, json=False):
    """A query of one rule's matches, and SQL with the same condition."""

    def run(spark, d):
        e = _docs(spark, d) if source == "doc" else _events(spark, d)
        t = engine.Tables(templates=templates) if templates else None
        return engine.run(_json(e) if json else e, _rules(options), t).select("event_seq", *columns)

    _add(name, run, f"with {DOC if source == 'doc' else EV} select event_seq{sql_columns} from {source} where {where}")


_stateless("header_program_glob", "doc", "program: src1*|src?;", "regexp_matches(program, '^(src1.*|src.)$')")
_stateless("header_tag", "doc", "syslog_tag: en|fr;", "tag in ('en', 'fr')")
_stateless("header_level", "ev", "syslog_level: err|warn;", "level = 'err'")
_stateless("header_facility", "ev", "syslog_facility: auth|mail;", "facility = 'auth'")
_stateless("header_priority", "ev", "syslog_priority: alert;", "priority = 'alert'")
_stateless("content", "doc", 'content:"the ";', f"{VALID} and contains(message, 'the ')")
_stateless("content_not", "doc", 'content:!"the "; content:"de";', f"{VALID} and not contains(message, 'the ') and contains(message, 'de')")
_stateless("content_nocase", "doc", 'content:"LICENSE"; nocase;', f"{VALID} and contains(lower(message), 'license')")
_stateless("content_hex", "ev", 'content:"|75 73|er|3d|1"; content:!"|73 3d 39|";', "contains(message, 'user=1') and not contains(message, 's=9')")
_stateless("content_offset_depth", "doc", 'content:"an"; offset: 5; depth: 20;', f"{VALID} and contains(substr(message, 6, 21), 'an')")
_stateless("content_distance_within", "doc", 'content:"e"; depth: 10; content:"th"; distance: 3; within: 30;', f"{VALID} and contains(substr(message, 1, 11), 'e') and contains(substr(message, 15, 30), 'th')")
_stateless("pcre", "doc", 'pcre:"/token = .[0-9a-f]{10}/";', f"{VALID} and regexp_matches(message, 'token = .[0-9a-f]{{10}}')")
_stateless("pcre_flags", "doc", 'pcre:"/licen[cs]e.*version/is";', f"{VALID} and regexp_matches(message, '(?is)licen[cs]e.*version')")
_stateless("meta_content", "doc", 'meta_content:"%item% License",MIT,Apache,Public;', f"{VALID} and (contains(message, 'MIT License') or contains(message, 'Apache License') or contains(message, 'Public License'))")
_stateless("meta_content_not", "doc", 'meta_content:!" %item% ",the,de,le;', f"{VALID} and not (contains(message, ' the ') or contains(message, ' de ') or contains(message, ' le '))")
_stateless("meta_content_window", "doc", 'meta_content:"%item%",THE,DER; meta_nocase; meta_offset: 2; meta_depth: 40;', f"{VALID} and (contains(lower(substr(message, 3, 41)), 'the') or contains(lower(substr(message, 3, 41)), 'der'))")
_stateless("append_program", "doc", 'append_program; content:" | src7";', f"{VALID} and contains(message || ' | ' || program, ' | src7')")
_stateless("json_content", "ev", 'json_content:".k","7";', "json_extract_string(json_original, '$.k') = '7'", json=True)
_stateless("json_content_not", "ev", 'json_content:!".k","7";', "json_extract_string(json_original, '$.k') <> '7'", json=True)
_stateless("json_contains", "ev", 'json_content:".k","1"; json_contains; json_nocase;', "contains(json_extract_string(json_original, '$.k'), '1')", json=True)
_stateless("json_pcre", "ev", 'json_pcre:".k","/^[1-3]\\d$/"; json_pcre:".absent","/x/";', "regexp_matches(json_extract_string(json_original, '$.k'), '^[1-3]\\d$')", json=True)
_stateless("json_meta_content", "ev", 'json_meta_content:".k",1,2,3,50;', "json_extract_string(json_original, '$.k') in ('1', '2', '3', '50')", json=True)
_stateless("json_meta_content_not", "ev", 'json_meta_content:!".k",1,2,3,50;', "json_extract_string(json_original, '$.k') not in ('1', '2', '3', '50')", json=True)
_stateless("json_map", "ev", 'json_map:"src_port",".k"; json_map:"username",".k"; program: click;', "program = 'click'", ("src_port", "username"), ", cast(json_extract_string(json_original, '$.k') as integer) as src_port, json_extract_string(json_original, '$.k') as username", json=True)
_stateless("flow_cidr", "ev", "alert any [10.0.0.0/26,10.0.0.128/25] any -> any any (msg:\"f\"; sid:1; rev:1;)", "(user_id < 64 or user_id between 128 and 255)")
_stateless("flow_negated", "ev", "alert any [10.0.0.0/16,!10.0.0.64/26] any -> !10.0.0.2 any (msg:\"f\"; sid:1; rev:1;)", "user_id < 65536 and not user_id between 64 and 127")
_stateless("flow_ports", "ev", 'alert any any !1000:2000 -> any [80,443] (msg:"f"; program: view; default_src_port: 4000; default_dst_port: 443; sid:1; rev:1;)', "program = 'view'", ("src_port", "dst_port"), ", 4000 as src_port, 443 as dst_port")
_stateless("flow_reverse", "ev", 'alert any 10.0.0.1 any <- 10.0.0.0/27 any (msg:"f"; sid:1; rev:1;)', "user_id < 32")
_stateless("flow_both_ways", "ev", 'alert any 10.0.0.1 any <> 10.0.0.0/27 any (msg:"f"; sid:1; rev:1;)', "user_id < 32")
_stateless("flow_proto", "ev", 'alert tcp any any -> any any (msg:"f"; default_proto: tcp; program: error; sid:1; rev:1;)', "program = 'error'", ("proto",), ", 6 as proto")
_stateless("alert_time", "ev", "alert_time: days 135, hours 0900-1700;", "dayofweek(event_time) in (1, 3, 5) and hour(event_time) * 100 + minute(event_time) between 900 and 1700")
_stateless("alert_time_midnight", "ev", "alert_time: days 06, hours 2200-0400;", "(dayofweek(event_time) in (0, 6) and hour(event_time) * 100 + minute(event_time) >= 2200) or ((dayofweek(event_time) + 6) % 7 in (0, 6) and hour(event_time) * 100 + minute(event_time) <= 400)")
_stateless("parse_proto", "doc", "parse_proto; program: src1;", "program = 'src1'", ("proto",), ", case when contains(lower(message), 'the ') then 6 when contains(message, 'der') then 17 else 0 end as proto", Templates([], [("THE ", 6, True), ("der", 17, False)], []))
_stateless("parse_proto_program", "doc", "parse_proto_program;", "true", ("proto",), ", case when contains(program, '11') then 6 when contains(program, '1') then 17 else 0 end as proto", Templates([], [], [("11", 6, False), ("1", 17, False)]))
_stateless("normalize", "ev", "normalize; program: purchase;", "program = 'purchase'", ("username", "src_port"), ", coalesce(nullif(regexp_extract(message, 'purchase user=(\\d+) cents=(\\d)', 1), ''), username) as username, coalesce(try_cast(nullif(regexp_extract(message, 'purchase user=(\\d+) cents=(\\d)', 2), '') as integer), 0) as src_port", Templates([r"purchase user=(?<username>\d+) cents=(?<src_port>\d)"], [], []))

# field extraction
_MARKS_SQL = "trim(regexp_replace(translate(message, '\"()[]<>{},/@=-!|_+&%$~^''', repeat(' ', 24)), '\\s+', ' ', 'g'))"
_V4 = r"((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPS = f"w as (select event_seq, unnest(string_split({_MARKS_SQL}, ' ')) as tok, generate_subscripts(string_split({_MARKS_SQL}, ' '), 1) as i from doc), ip as (select event_seq, regexp_replace(tok, '\\.$', '') as ip, row_number() over (partition by event_seq order by i) as n from w where regexp_matches(tok, '^{_V4}\\.?$'))"
_add("ip_scan", lambda s, d: _docs(s, d).select("event_seq", F.posexplode(net.ip_scan(F.col("message"))).alias("n", "x")).select("event_seq", F.col("n").alias("n"), "x.ip", "x.port"), f"with {DOC}, {_IPS} select event_seq, cast(n - 1 as integer) as n, ip, 0 as port from ip")
_add("parse_src_ip", lambda s, d: engine.run(_docs(s, d), _rules("parse_src_ip: 1; parse_dst_ip: 2; program: src*;")).select("event_seq", "src_ip", "dst_ip"), f"with {DOC}, {_IPS} select event_seq, case when a.ip not like '127.%' then a.ip else '10.0.0.1' end as src_ip, case when b.ip not like '127.%' then b.ip else '10.0.0.1' end as dst_ip from doc left join (select * from ip where n = 1) a using (event_seq) left join (select * from ip where n = 2) b using (event_seq)")
_add("parse_hash", lambda s, d: engine.run(_docs(s, d), _rules('parse_hash: sha1; parse_hash: md5; content:"token";')).select("event_seq", "sha1", "md5"), f"with {DOC} select event_seq, nullif(regexp_extract(' ' || regexp_replace(message, '[\"()\\[\\]<>{{}},/@=\\-!|_+&%$~^''.:;#]', ' ', 'g') || ' ', '\\s([0-9A-Fa-f]{{40}})\\s', 1), '') as sha1, nullif(regexp_extract(' ' || regexp_replace(message, '[\"()\\[\\]<>{{}},/@=\\-!|_+&%$~^''.:;#]', ' ', 'g') || ' ', '\\s([0-9A-Fa-f]{{32}})\\s', 1), '') as md5 from doc where {VALID} and contains(message, 'token')")
_add("ip_helpers", lambda s, d: _events(s, d).select("event_seq", net.ipv4_long(F.col("src_ip")).alias("n"), net.long_ipv4(net.ipv4_long(F.col("src_ip"))).alias("back"), net.ip_key(F.concat(F.lit("::ffff:"), "src_ip")).alias("ip_key"), net.not_routable(F.col("src_ip")).alias("private")), f"with {EV} select event_seq, 167772160 + user_id as n, src_ip as back, '4' || lower(lpad(printf('%x', 167772160 + user_id), 8, '0')) as ip_key, true as private from ev")
_add("text_helpers", lambda s, d: _events(s, d).select("event_seq", text.human_age(state.seconds() - 1704067200).alias("age"), text.glob(F.col("program"), "c*k").alias("glob")), f"with {EV}, x as (select event_seq, program, t - 1704067200 as s from ev) select event_seq, (s // 86400) || ' days, ' || lpad(cast(s % 86400 // 3600 as varchar), 2, '0') || ':' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') as age, program = 'click' as glob from x")
_add("json_flatten", lambda s, d: _json(_events(s, d)).select("event_seq", F.explode("json").alias("p")).select("event_seq", "p.key", "p.value"), f"with {EV} select event_seq, '' as key, json_original as value from ev where json_original is not null union all select event_seq, '.k' as key, json_extract_string(json_original, '$.k') as value from ev where json_extract_string(json_original, '$.k') is not null")


def _json_base64(s, d):
    e = _events(s, d).withColumn("json", jsonflat.flatten(F.to_json(F.struct(F.struct(F.base64(F.encode("message", "UTF-8")).alias("b")).alias("a")))))
    return engine.run(e, _rules('json_content:".a.b","user=1"; json_contains; json_decode_base64; json_pcre:".a.b","/cents=\\d{4}$/"; json_decode_base64_pcre;')).select("event_seq")


_add("json_base64", _json_base64, f"with {EV} select event_seq from ev where contains(message, 'user=1') and regexp_matches(message, 'cents=\\d{{4}}$')")


# sources
def _pipe_lines(s, d):
    e = _events(s, d)
    line = F.when(F.col("event_seq") % 7 == 0, F.concat_ws("|", F.lit("not-an-ip"), F.lit("auth"))).otherwise(F.concat_ws("|", "src_ip", F.lit("auth"), F.lit("info"), "level", F.lit("26"), F.lit("2024-01-05"), F.lit("10:20:30"), "program", F.concat(F.col("message"), F.lit("|tail"))))
    return e.select("event_seq", line.alias("value"))


_add("decode_pipe", lambda s, d: logs.decode_pipe(_pipe_lines(s, d), "10.9.9.9").select("event_seq", "host", "facility", "program", "message", "malformed"), f"with {EV} select event_seq, case when event_seq % 7 = 0 then '10.9.9.9' else src_ip end as host, 'auth' as facility, case when event_seq % 7 = 0 then null else program end as program, case when event_seq % 7 = 0 then null else message || '|tail' end as message, event_seq % 7 = 0 as malformed from ev")
_add("decode_pipe_strict", lambda s, d: logs.decode_pipe(_pipe_lines(s, d), "10.9.9.9", missing="{} ERROR").groupBy("program").agg(F.count("*").alias("n"), F.sum(F.col("malformed").cast("int")).alias("malformed")), f"with {EV}, x as (select case when event_seq % 7 = 0 then 'PROGRAM ERROR' else program end as program, case when event_seq % 7 = 0 then 1 else 0 end as bad from ev) select program, count(*) as n, sum(bad) as malformed from x group by program")
_JMAP = {"host": [".HOST"], "level": [".SEV", ".LEVEL"], "program": [".PROG"], "message": [".MSG"], "src_ip": [".net.src"], "src_port": [".k"]}
_add("decode_json", lambda s, d: logs.decode_json(_events(s, d).select("event_seq", F.to_json(F.struct(F.col("program").alias("PROG"), F.col("level").alias("LEVEL"), F.col("message").alias("MSG"), F.struct(F.col("src_ip").alias("src")).alias("net"), F.get_json_object("json_original", "$.k").alias("k"))).alias("value")), _JMAP).select("event_seq", "host", "level", "program", "message", "src_ip", "src_port", "tag"), f"with {EV} select event_seq, '0.0.0.0' as host, level, program, ' ' || message as message, src_ip, cast(json_extract_string(json_original, '$.k') as integer) as src_port, 'UNDEFINED' as tag from ev")
_add("ignore_list", lambda s, d: logs.ignore(_events(s, d).select("event_seq", "message"), ["click", "user=1", "# note"], "message").select("event_seq"), f"with {EV} select event_seq from ev where not contains(message, 'click') and not contains(message, 'user=1')")
_add("json_in_message", lambda s, d: logs.json_in_message(_events(s, d).withColumn("message", F.col("json_original"))).select("event_seq", jsonflat.get(F.col("json"), ".k").alias("k")), f"with {EV} select event_seq, json_extract_string(json_original, '$.k') as k from ev")


# look-ups
_BL = [("10.0.0.0/28",), ("10.0.0.77",), ("10.0.0.64/30",), ("bad",), ("10.0.0.77",)]
_IN_BL = "(user_id < 16 or user_id = 77 or user_id between 64 and 67)"
_add("blacklist_by_src", lambda s, d: engine.run(_events(s, d), _rules("blacklist: by_src;"), engine.Tables(blacklist=lookups.ranges(s, _BL))).select("event_seq"), f"with {EV} select event_seq from ev where {_IN_BL}")
_add("blacklist_both", lambda s, d: engine.run(_events(s, d), _rules("blacklist: both; program: view;"), engine.Tables(blacklist=lookups.ranges(s, _BL[1:]))).select("event_seq"), f"with {EV} select event_seq from ev where program = 'view' and (user_id = 77 or user_id between 64 and 67)")
_add("blacklist_all", lambda s, d: engine.run(_docs(s, d), _rules("blacklist: all;"), engine.Tables(blacklist=lookups.ranges(s, [("0.0.0.0/2",), ("128.0.0.0/1",)]))).select("event_seq"), f"with {DOC}, {_IPS} select distinct event_seq from ip where (cast(split_part(ip, '.', 1) as integer) < 64 or cast(split_part(ip, '.', 1) as integer) >= 128)")


def _intel(s):
    return s.createDataFrame([("10.0.0.5", "ADDR"), ("mail1.example.com", "DOMAIN"), ("MAIL5.example.com", "DOMAIN"), ("apache license", "SOFTWARE"), ("mit license", "SOFTWARE")], "indicator string, type string")


_add("intel_addr", lambda s, d: lookups.intel_addresses(_docs(s, d).select("event_seq", F.explode(net.ips(F.col("message"))).alias("src_ip")), _docs(s, d).where("program = 'src1'").select(F.explode(net.ips(F.col("message"))).alias("indicator")).select("indicator", F.lit("ADDR").alias("type"))), f"with {DOC}, {_IPS}, i as (select distinct ip from ip join doc using (event_seq) where program = 'src1') select event_seq, ip as src_ip from ip where ip in (select ip from i) and not (ip like '10.%' or ip like '127.%' or ip like '0.%' or ip like '192.168.%' or ip like '169.254.%' or (ip like '172.%' and cast(split_part(ip, '.', 2) as integer) between 16 and 31) or cast(split_part(ip, '.', 1) as integer) between 224 and 239)")
_add("intel_domain", lambda s, d: engine.run(_docs(s, d), _rules("zeek-intel: domain;"), engine.Tables(intel=_intel(s))).select("event_seq"), f"with {DOC} select event_seq from doc where contains(lower(message), 'mail1.example.com') or contains(lower(message), 'mail5.example.com')")
_add("intel_software", lambda s, d: engine.run(_docs(s, d), _rules("zeek-intel: software;"), engine.Tables(intel=_intel(s))).select("event_seq"), f"with {DOC} select event_seq from doc where contains(lower(message), 'apache license') or contains(lower(message), 'mit license')")


def _geo(s):
    return lookups.ranges(s, [(f"{16 * i}.0.0.0/4", ("DE", "FR", "US", "JP")[i % 4]) for i in range(14)], "cidr string, country string")


_GEO = "case cast(split_part(ip, '.', 1) as integer) // 16 % 4 when 0 then 'DE' when 1 then 'FR' when 2 then 'US' else 'JP' end"
_ROUTE = "ip not like '10.%' and ip not like '127.%' and ip not like '0.%' and ip not like '192.168.%' and ip not like '169.254.%' and not (ip like '172.%' and cast(split_part(ip, '.', 2) as integer) between 16 and 31) and cast(split_part(ip, '.', 1) as integer) < 224"
for _name, _is in (("country_code_is", "is"), ("country_code_isnot", "isnot")):
    _add(_name, lambda s, d, k=_is: engine.run(_docs(s, d), _rules(f"parse_src_ip: 1; country_code: track by_src, {k} [DE,US];"), engine.Tables(geo=_geo(s), geo_skip=lookups.ranges(s, [("32.0.0.0/6",)]))).select("event_seq", "src_ip"), f"with {DOC}, {_IPS} select event_seq, ip as src_ip from ip where n = 1 and {_ROUTE} and not cast(split_part(ip, '.', 1) as integer) between 32 and 35 and {_GEO} {'in' if _is == 'is' else 'not in'} ('DE', 'US')")


def _reputation(s, d):
    rep = _table(s, d, "events").groupBy("user_id").agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("mtime"), F.min(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("ctime"))
    rep = rep.select(F.lit("ip_reputation").alias("kind"), F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("value"), (F.col("user_id") % 5).cast("int").alias("code"), "ctime", "mtime")
    t = engine.Tables(reputation=rep, categories={"scanner": 1, "malware": 3})
    return engine.run(_events(s, d), _rules("reputation: type ip_reputation, track by_src, cdate_effective_period 10 days, scanner,malware;"), t).select("event_seq")


_add("reputation", _reputation, f"with {EV}, r as (select user_id, cast(floor(epoch(min(ts))) as bigint) as c from events group by user_id) select event_seq from ev join r using (user_id) where user_id < 256 and user_id % 5 in (1, 3) and t - c <= 864000")
_add("classification", lambda s, d: lookups.classify(_events(s, d).select("event_seq", F.col("program").alias("classtype")), s.createDataFrame([("error", "An error", 1), ("view", "A view", 3)], "short string, description string, priority int")).select("event_seq", "category"), f"with {EV} select event_seq, case program when 'error' then 'An error' when 'view' then 'A view' else 'UNKNOWN' end as category from ev")
_add("cross_references", lambda s, d: lookups.cross_references(_table(s, d, "nation").select(F.col("n_regionkey").cast("long").alias("sid"), F.col("n_nationkey").alias("n"), F.when(F.col("n_nationkey") % 2 == 0, "url").otherwise("cve").alias("id"), F.col("n_name").alias("value")), s.createDataFrame([("url", "http://"), ("cve", "http://cve/")], "id string, url_prefix string")), "select cast(n_regionkey as bigint) as sid, string_agg('[Xref => ' || case when n_nationkey % 2 = 0 then 'http://' else 'http://cve/' end || n_name || ']', ' ' order by n_nationkey) as xref from nation group by n_regionkey")
_add("resolve_hosts", lambda s, d: lookups.resolve_hosts(_docs(s, d).select("event_seq", F.col("program").alias("host")), s.createDataFrame([("src1", "192.0.2.1"), ("src2", "192.0.2.2")], "host string, ip string"), "192.0.2.99"), f"with {DOC} select event_seq, case program when 'src1' then '192.0.2.1' when 'src2' then '192.0.2.2' else '192.0.2.99' end as host from doc")

# rate control
_FOLD = """o as (select event_seq, t, src_ip, row_number() over (partition by src_ip order by t, event_seq) as i from x),
f as (select src_ip, event_seq, t, i, cast(1 as bigint) as c, t as u, {first} as emit from o where i = 1
 union all
 select o.src_ip, o.event_seq, o.t, o.i, {c}, {u}, {emit} from f join o on o.src_ip = f.src_ip and o.i = f.i + 1)"""


def _fold_sql(source: str, n: int, s: int, mode: str) -> str:
    c = f"case when o.t - f.u > {s} then 1 else f.c + 1 end"
    u = f"case when o.t - f.u > {s} then o.t else f.u end"
    emit = f"{c} <= {n}"
    if mode == "after":
        emit, u = f"{c} > {n}", f"case when {c} > {n} then o.t else {u} end"
    return f"with recursive {EV}, x as ({source}), " + _FOLD.format(first="false" if mode == "after" else "true", c=c, u=u, emit=emit)


_add("threshold_limit", lambda s, d: engine.run(_events(s, d), _rules("program: click|view; threshold: type limit, track by_src, count 2, seconds 86400;")).select("event_seq"), _fold_sql("select * from ev where program in ('click', 'view')", 2, 86400, "limit") + " select event_seq from f where emit")
_add("after", lambda s, d: engine.run(_events(s, d), _rules("program: click|view|error; after: track by_src, count 3, seconds 172800;")).select("event_seq"), _fold_sql("select * from ev where program in ('click', 'view', 'error')", 3, 172800, "after") + " select event_seq from f where emit")
_SUPPRESS = "g as (select *, case when t - lag(t) over (partition by src_ip order by t, event_seq) > {s} then 1 else 0 end as gap from {x}), h as (select *, sum(gap) over (partition by src_ip order by t, event_seq) as sess from g), n as (select *, row_number() over (partition by src_ip, sess order by t, event_seq) as rn from h)"
_add("threshold_suppress", lambda s, d: engine.run(_events(s, d), _rules("program: error; threshold: type suppress, track by_src, count 1, seconds 100000;")).select("event_seq"), f"with {EV}, x as (select * from ev where program = 'error'), {_SUPPRESS.format(s=100000, x='x')} select event_seq from n where rn <= 1")
_add("after_then_threshold", lambda s, d: engine.run(_events(s, d), _rules("after: track by_src, count 2, seconds 200000; threshold: type suppress, track by_src, count 1, seconds 90000;")).select("event_seq"), _fold_sql("select * from ev", 2, 200000, "after") + f", y as (select * from f where emit), {_SUPPRESS.format(s=90000, x='y')} select event_seq from n where rn <= 1")
_add("threshold_two_keys", lambda s, d: engine.run(_events(s, d), _rules("threshold: type limit, track by_src&by_username, count 1, seconds 5000000;")).select("event_seq"), f"with {EV} select min_by(event_seq, (t, event_seq)) as event_seq from ev group by src_ip, username")

# bits
_LAST = "(select max(e.event_seq) from ev e where e.program = '{p}' and e.src_ip = v.src_ip and (e.t, e.event_seq) < (v.t, v.event_seq))"
_add("xbit_isset", lambda s, d: engine.run(_events(s, d), _rules("program: error; xbits: set,err,track ip_src,expire 90000;", "program: purchase; xbits: isset,err,track ip_src;")).where("rule_pos = 1").select("event_seq"), f"with {EV} select v.event_seq from ev v where program = 'purchase' and exists (select 1 from ev e where e.program = 'error' and e.src_ip = v.src_ip and e.event_seq < v.event_seq and v.t < e.t + 90000)")
_add("xbit_isnotset", lambda s, d: engine.run(_events(s, d), _rules("program: error; xbits: set,err,track ip_pair,expire 90000;", "program: purchase; xbits: isnotset,err,track ip_pair;")).where("rule_pos = 1").select("event_seq"), f"with {EV} select v.event_seq from ev v where program = 'purchase' and not exists (select 1 from ev e where e.program = 'error' and e.src_ip = v.src_ip and e.event_seq < v.event_seq and v.t < e.t + 90000)")
_add("xbit_unset", lambda s, d: engine.run(_events(s, d), _rules("program: error; xbits: set,err,track ip_src,expire 900000;", "program: signup; xbits: unset,err,track ip_src;", "program: purchase; xbits: isset,err,track ip_src;")).where("rule_pos = 2").select("event_seq"), f"with {EV}, o as (select *, (select max(e.event_seq) from ev e where e.program in ('error', 'signup') and e.src_ip = v.src_ip and e.event_seq < v.event_seq) as last from ev v where v.program = 'purchase') select o.event_seq from o join ev e on e.event_seq = o.last where e.program = 'error' and o.t < e.t + 900000")
_FLEXSET = "program: view; flexbits: set,seen,90000; flexbits: noalert;"
for _d, _on in (("by_src", "e.src_ip = v.src_ip"), ("by_dst", "e.dst_ip = v.dst_ip"), ("both", "e.src_ip = v.src_ip and e.dst_ip = v.dst_ip"), ("username", "e.username = v.username"), ("none", "true"), ("reverse", "e.src_ip = v.dst_ip and e.dst_ip = v.src_ip"), ("src_xbitdst", "e.dst_ip = v.src_ip"), ("dst_xbitsrc", "e.src_ip = v.dst_ip")):
    _add(f"flexbit_{_d}", lambda s, d, k=_d: engine.run(_events(s, d), _rules(_FLEXSET, f"program: click; flexbits: isset,{k},seen;")).where("rule_pos = 1").select("event_seq"), f"with {EV} select v.event_seq from ev v where program = 'click' and exists (select 1 from ev e where e.program = 'view' and {_on} and e.event_seq < v.event_seq and v.t < e.t + 90000)")
_add("flexbit_isnotset", lambda s, d: engine.run(_events(s, d), _rules(_FLEXSET, "program: click; flexbits: isnotset,by_src,seen;")).where("rule_pos = 1").select("event_seq"), f"with {EV} select v.event_seq from ev v where program = 'click' and not exists (select 1 from ev e where e.program = 'view' and e.src_ip = v.src_ip and e.event_seq < v.event_seq and v.t < e.t + 90000)")
_add("flexbit_unset", lambda s, d: engine.run(_events(s, d), _rules(_FLEXSET, "program: signup; flexbits: unset,by_src,seen;", "program: click; flexbits: isset,by_src,seen;")).where("rule_pos = 2").select("event_seq"), f"with {EV} select v.event_seq from ev v where program = 'click' and exists (select 1 from ev e where e.program = 'view' and e.src_ip = v.src_ip and e.event_seq < v.event_seq and v.t < e.t + 90000 and not exists (select 1 from ev u where u.program = 'signup' and u.src_ip = e.src_ip and u.event_seq > e.event_seq and u.event_seq < v.event_seq))")
_add("flexbit_count", lambda s, d: engine.run(_events(s, d), _rules('default_src_port: 1; program: view; flexbits: set_srcport,seen,90000; flexbits: noalert;', "program: click; flexbits: count,by_dst,seen,>3;")).where("rule_pos = 1").select("event_seq"), f"with {EV} select v.event_seq from ev v where program = 'click' and (select count(distinct e.src_ip) from ev e where e.program = 'view' and e.event_seq < v.event_seq and v.t < e.t + 90000) > 3")
_add("flexbit_ports", lambda s, d: engine.run(_json(_events(s, d)), _rules('json_map:"src_port",".k"; program: view; flexbits: set_srcport,seen,900000; flexbits: noalert;', 'json_map:"src_port",".k"; program: click; flexbits: isset,by_src_p,seen;')).where("rule_pos = 1").select("event_seq"), f"with {EV} select v.event_seq from ev v where program = 'click' and exists (select 1 from ev e where e.program = 'view' and e.src_ip = v.src_ip and e.json_original = v.json_original and e.event_seq < v.event_seq and v.t < e.t + 900000)")

# gate, effects, reports
_add("pass_stops_rules", lambda s, d: engine.run(_events(s, d), _rules("program: error;", rule("program: error; syslog_level: err;", 2, "pass any any any -> any any"), 'content:"user=1";')).select("event_seq", "rule_pos"), f"with {EV} select event_seq, 0 as rule_pos from ev where program = 'error' union all select event_seq, 1 as rule_pos from ev where program = 'error' union all select event_seq, 2 as rule_pos from ev where program <> 'error' and contains(message, 'user=1')")
_MANY = [rule(f"program: {p}; content:\"user={u}\";", 10 * u + i) for u in range(1, 10) for i, p in enumerate(("click", "view", "error", "signup", "purchase"))]
_add("many_rules", lambda s, d: engine.run(_events(s, d), _rules(*_MANY)).groupBy("rule_pos").agg(F.count("*").alias("n")), f"with {EV}, r as (select u, i, p, (u - 1) * 5 + i as pos from (select unnest(range(1, 10)) as u) a, (values (0, 'click'), (1, 'view'), (2, 'error'), (3, 'signup'), (4, 'purchase')) b(i, p)) select cast(pos as integer) as rule_pos, count(*) as n from ev join r on ev.program = r.p and contains(ev.message, 'user=' || r.u) group by pos")


def _alerts(s, d):
    rules = parse_rules(rule('program: error; content:"user="; classtype: misc; reference: url,example.com; metadata: a b c, d e; threshold: type suppress, track by_src, count 5, seconds 3600;', 1) + "\n" + rule("program: purchase; classtype: other; priority: 2; default_proto: tcp; default_dst_port: 443;", 2, "drop any any any -> any any"))
    classes = s.createDataFrame([("misc", "Miscellaneous", 3)], "short string, description string, priority int")
    return engine.alerts(_events(s, d), rules, engine.Tables(classes=classes))


_ALERT = f"with {EV}, x as (select * from ev where program = 'error'), {_SUPPRESS.format(s=3600, x='x')}, a as (select event_seq, event_time, t, src_ip, dst_ip, program, message, 1 as sid, 'rule 1' as msg, 'Miscellaneous' as category, 'allowed' as action, cast(null as integer) as severity, 'UNKNOWN' as proto, 0 as dp from n where rn <= 5 union all select event_seq, event_time, t, src_ip, dst_ip, program, message, 2, 'rule 2', 'UNKNOWN', 'blocked', 2, 'TCP', 443 from ev where program = 'purchase')"
_add("alerts", lambda s, d: _alerts(s, d).select("event_seq", "sid", "msg", "category", "action", F.coalesce("severity", F.lit(0)).alias("severity"), "src_ip", "dst_port"), _ALERT + " select event_seq, cast(sid as bigint) as sid, msg, category, action, coalesce(severity, 0) as severity, src_ip, dp as dst_port from a")
_add("eve_alert", lambda s, d: sinks.eve(_alerts(s, d)).select("event_seq", F.get_json_object("value", "$.src_ip").alias("src_ip"), F.get_json_object("value", "$.alert.signature_id").cast("int").alias("sid"), F.get_json_object("value", "$.proto").alias("proto"), F.unbase64(F.get_json_object("value", "$.payload")).cast("string").alias("payload")), _ALERT + " select event_seq, src_ip, sid, proto, message as payload from a")
_add("eve_log", lambda s, d: sinks.eve_log(_events(s, d)).select("event_seq", F.get_json_object("value", "$.message").alias("message"), F.get_json_object("value", "$.event_type").alias("kind")), f"with {EV} select event_seq, message, 'log' as kind from ev")
_add("fast_log", lambda s, d: sinks.fast(_alerts(s, d)).select("value"), _ALERT + " select strftime(event_time, '%m/%d/%Y-%H:%M:%S.%f') || '  [**] [1:' || sid || ':1] ' || msg || ' [**] [Classification: ' || category || '] [Priority: ' || coalesce(severity, 0) || '] [Program: ' || program || '] {' || proto || '} ' || src_ip || ':0 -> ' || dst_ip || ':' || dp as value from a")
_add("alert_log", lambda s, d: sinks.full(_alerts(s, d)).select("value"), _ALERT + " select '[**] [1:' || sid || ':1] ' || msg || ' [**]' || chr(10) || '[Classification: ' || category || '] [Priority: ' || coalesce(severity, 0) || ']' || chr(10) || strftime(event_time, '%Y-%m-%d %H:%M:%S') || ' ' || src_ip || ':0 -> ' || dst_ip || ':' || dp || chr(10) || 'Message: ' || message as value from a")
_add("syslog_out", lambda s, d: sinks.syslog(_alerts(s, d)).select("value"), _ALERT + " select '[1:' || sid || ':1] ' || msg || ' [Classification: ' || category || '] {' || proto || '} - ' || message as value from a")
_add("client_stats", lambda s, d: state.client_stats(_events(s, d), "src_ip", private_only=True), f"with {EV} select src_ip, count(*) as events, cast(sum(9 + 8 + length(facility) + length(priority) + length(level) + 2 + length(program) + length(message)) as bigint) as bytes, max(t) as last_seen, max_by(program, event_seq) as program, max_by(message, event_seq) as message from ev group by src_ip")
_add("client_stats_by_tag", lambda s, d: state.client_stats(_docs(s, d), "tag").select("tag", "events", "bytes"), f"with {DOC} select tag, count(*) as events, cast(sum(9 + 8 + 4 + 4 + 4 + length(tag) + length(program) + length(message)) as bigint) as bytes from doc group by tag")
_add("track_clients", lambda s, d: state.track_clients(_events(s, d), 1440, F.timestamp_seconds(F.lit(1706745600))).fillna(-1, ["up_again"]), f"with {EV}, g as (select src_ip as host, t as last_seen, lead(t) over (partition by src_ip order by t, event_seq) as up_again from ev) select host, last_seen, last_seen + 86400 as down_from, coalesce(up_again, -1) as up_again from g where coalesce(up_again, 1706745600) - last_seen >= 86400")
_add("stats_counters", lambda s, d: state.counters(_events(s, d), "1 hour"), f"with {EV}, g as (select t // 3600 * 3600 as window_start, count(*) as received, cast(sum(strlen(message)) as bigint) as bytes, cast(max(strlen(message)) as integer) as max_bytes, count(distinct host) as hosts, count(distinct program) as programs from ev group by 1) select window_start, received, bytes, max_bytes, hosts, programs, received / 3600.0 as eps, received - coalesce(lag(received) over (order by window_start), 0) as delta from g")
_add("rule_tracking", lambda s, d: engine.fired_rulesets(engine.run(_events(s, d), parse_rules(rule("program: click;", 1), ruleset="a.rules") + parse_rules(rule("program: nothing;", 2), ruleset="b.rules", first=1) + parse_rules(rule("program: view;", 3), ruleset="c.rules", first=2)), parse_rules(rule("program: click;", 1), ruleset="a.rules") + parse_rules(rule("program: nothing;", 2), ruleset="b.rules", first=1) + parse_rules(rule("program: view;", 3), ruleset="c.rules", first=2)), f"with {EV} select 'a.rules' as ruleset, count(*) as fired from ev where program = 'click' union all select 'b.rules', 0 union all select 'c.rules', count(*) from ev where program = 'view'")


def _dynamic(s, d):
    rules = _rules("program: error; dynamic_load: extra.rules;", "program: nothing; dynamic_load: never.rules;", "program: view;")
    more = {"extra.rules": rule("program: signup;", 50), "never.rules": rule("program: click;", 60)}
    e = _events(s, d)
    return engine.run(e, engine.dynamic(e, rules, lambda p: parse_rules(more[p], ruleset=p), 10)).groupBy("program").agg(F.count("*").alias("n"))


_add("dynamic_rules", _dynamic, f"with {EV} select program, count(*) as n from ev where program in ('view', 'signup') group by program")


def brute_force_then_login(spark, d) -> DataFrame:
    """The flagship: bursts of errors set a bit, a purchase by the same source within a day is an alert."""
    rules = _rules('program: error; content:"user="; after: track by_src, count 1, seconds 259200; xbits: set,burst,track ip_src,expire 86400; threshold: type limit, track by_src, count 5, seconds 3600;', "program: purchase; xbits: isset,burst,track ip_src;")
    a = engine.alerts(_events(spark, d), rules)
    return a.select("event_seq", "sid", "msg", "src_ip", "category")


_add("brute_force_then_login", brute_force_then_login, _fold_sql("select * from ev where program = 'error'", 1, 259200, "after") + ", y as (select src_ip, event_seq, t from f where emit), o2 as (select *, row_number() over (partition by src_ip order by t, event_seq) as k from y), f2 as (select src_ip, event_seq, t, k, cast(1 as bigint) as c, t as u, true as emit from o2 where k = 1 union all select o2.src_ip, o2.event_seq, o2.t, o2.k, case when o2.t - f2.u > 3600 then 1 else f2.c + 1 end, case when o2.t - f2.u > 3600 then o2.t else f2.u end, case when o2.t - f2.u > 3600 then true else f2.c + 1 <= 5 end from f2 join o2 on o2.src_ip = f2.src_ip and o2.k = f2.k + 1), z as (select * from f2 where emit) select event_seq, cast(1 as bigint) as sid, 'rule 1' as msg, src_ip, 'UNKNOWN' as category from z union all select v.event_seq, cast(2 as bigint), 'rule 2', v.src_ip, 'UNKNOWN' from ev v where v.program = 'purchase' and exists (select 1 from z where z.src_ip = v.src_ip and z.event_seq < v.event_seq and v.t < z.t + 86400)")


# options and outputs beside the ones above
def _event_id(s, d):
    e = _events(s, d).withColumn("message", F.concat(F.lit(" "), F.regexp_extract("message", r"user=(\d+)", 1), F.lit(": "), F.col("program")))
    return engine.run(e, _rules("event_id: 7,12,33;")).select("event_seq", "event_id")


_add("event_id", _event_id, f"with {EV} select event_seq, cast(user_id as varchar) as event_id from ev where user_id in (7, 12, 33)")
_add("json_missing_key", lambda s, d: engine.run(_json(_events(s, d)), _rules('json_content:!".absent","1";', 'json_content:!".k","1";', 'json_meta_content:!".absent",1,2;')).select("event_seq", "rule_pos"), f"with {EV} select event_seq, 1 as rule_pos from ev where json_extract_string(json_original, '$.k') <> '1'")


def _nested(s, d):
    e = _events(s, d)
    doc = F.to_json(F.struct(F.struct(F.upper("program").alias("P"), F.struct(F.struct(F.struct(F.struct(F.col("username").cast("long").alias("f")).alias("e")).alias("d")).alias("c")).alias("b")).alias("a"), F.lit('{"z": {"y": null}}').alias("s")))
    return e.withColumn("json", jsonflat.flatten(doc))


_add("json_nocase", lambda s, d: engine.run(_nested(s, d), _rules('json_content:".a.P","click"; json_nocase;', 'json_content:".a.P","view";', 'json_content:".a.P","rr"; json_nocase; json_contains;')).select("event_seq", "rule_pos"), f"with {EV} select event_seq, 0 as rule_pos from ev where program = 'click' union all select event_seq, 2 from ev where program = 'error'")
_add("json_meta_nocase", lambda s, d: engine.run(_nested(s, d), _rules('json_meta_content:".a.P",click,view; json_meta_nocase;', 'json_meta_content:!".a.P",cli,err; json_meta_nocase; json_meta_contains;')).select("event_seq", "rule_pos"), f"with {EV} select event_seq, 0 as rule_pos from ev where program in ('click', 'view') union all select event_seq, 1 from ev where program not in ('click', 'error')")
_add("json_deep", lambda s, d: engine.run(_nested(s, d), _rules('json_pcre:".a.b.c.d.e.f","/^\\d$/"; json_content:".s.z.y","null";')).select("event_seq", F.size("json").alias("pairs")), f"with {EV} select event_seq, 11 as pairs from ev where user_id < 10")


def _files(s, d, gz):
    path = shared_path(s)
    _pipe_lines(s, d).select("value").repartition(3).write.option("compression", "gzip" if gz else "none").text(path)
    return logs.decode_pipe(logs.read_lines(s, f"{path}/part-*{'.gz' if gz else '.txt'}"), "10.9.9.9").groupBy("host", "program", "malformed").agg(F.count("*").alias("n"))


for _name, _gz in (("read_gzip_files", True), ("read_text_files", False)):
    _add(_name, lambda s, d, gz=_gz: _files(s, d, gz), f"with {EV} select case when event_seq % 7 = 0 then '10.9.9.9' else src_ip end as host, case when event_seq % 7 = 0 then null else program end as program, event_seq % 7 = 0 as malformed, count(*) as n from ev group by all")
_add("journald", lambda s, d: logs.decode_json(_events(s, d).select("event_seq", F.to_json(F.struct(F.col("src_ip").alias("_HOSTNAME"), F.lit("3").alias("PRIORITY"), F.when(F.col("program") != "view", F.col("program")).alias("SYSLOG_IDENTIFIER"), F.lit("comm").alias("_COMM"), F.col("message").alias("MESSAGE"))).alias("value")), logs.JOURNALD).select("event_seq", "host", "level", "program", "message"), f"with {EV} select event_seq, src_ip as host, '3' as level, case program when 'view' then 'comm' else program end as program, ' ' || message as message from ev")


def _ported(s, d):
    n = F.col("username").cast("long")
    text_ = F.concat(F.lit(" from 192.0.2.7:"), (n + 1024).cast("string"), F.lit(" to fe80::"), F.lower(F.hex(n + 1)), F.lit("#53 and [198.51.100.9] port "), (n + 1).cast("string"), F.lit(" via eth0:203.0.113.5, client 203.0.113.6."))
    return _events(s, d).drop("src_ip").withColumn("message", text_)


_add("ip_scan_ports", lambda s, d: _ported(s, d).select("event_seq", F.explode(net.ip_scan(F.col("message"))).alias("x")).select("event_seq", "x.ip", "x.port"), f"with {EV} select event_seq, '192.0.2.7' as ip, cast(user_id + 1024 as integer) as port from ev union all select event_seq, 'fe80::' || printf('%x', user_id + 1), 53 from ev union all select event_seq, '198.51.100.9', cast(user_id + 1 as integer) from ev union all select event_seq, '203.0.113.5', 0 from ev union all select event_seq, '203.0.113.6', 0 from ev")
_add("flow_ipv6", lambda s, d: engine.run(_ported(s, d), _rules('alert any 192.0.2.0/24 1024:1100 -> [fe80::/122,!fe80::10/124] 53 (msg:"f"; parse_src_ip: 1; parse_dst_ip: 2; sid:1; rev:1;)')).select("event_seq", "dst_ip"), f"with {EV} select event_seq, 'fe80::' || printf('%x', user_id + 1) as dst_ip from ev where user_id <= 62 and not user_id + 1 between 16 and 31")
_K2 = [("192.0.2.7", "ADDR"), ("203.0.113.6", "ADDR"), ("ETH0", "EMAIL"), ("client 203", "USER_NAME"), ("port 12 ", "FILE_NAME")]
for _mode, _n, _sql in (("by_src", 2, "true"), ("by_dst", 5, "true"), ("both", 5, "true"), ("all", 3, "true"), ("email", 1, "true"), ("user_name", 1, "true"), ("file_name", 1, "user_id = 11")):
    _add(f"intel_{_mode}", lambda s, d, k=_mode, n=_n: engine.run(_ported(s, d), _rules(f"program: click; parse_src_ip: 1; parse_dst_ip: {n}; zeek-intel: {k};", f"program: view; parse_src_ip: 2; parse_dst_ip: 3; zeek-intel: {k};"), engine.Tables(intel=s.createDataFrame(_K2, "indicator string, type string"))).select("event_seq", "rule_pos"), f"with {EV} select event_seq, 0 as rule_pos from ev where program = 'click' and {_sql}" + (f" union all select event_seq, 1 from ev where program = 'view' and {_sql}" if _mode not in ("by_src", "by_dst", "both") else ""))
_NEEDLES = "select distinct lower(needle) as needle from (select 'token = ''' || substr(md5(cast(c_custkey as varchar)), 1, 1) as needle from customer union select substr(p_name, 1, 4) || p_partkey from part union select 'an,' union select 'License')"


def _many_needles(s, d):
    some = [_table(s, d, "customer").select(F.concat(F.lit("token = '"), F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 1)).alias("indicator")), _table(s, d, "part").select(F.concat(F.substring("p_name", 1, 4), F.col("p_partkey").cast("string"))), s.createDataFrame([("an,",), ("License",)], "indicator string")]
    return lookups.intel_strings(_docs(s, d), some[0].union(some[1]).union(some[2]).withColumn("type", F.lit("SOFTWARE")), "SOFTWARE").select("event_seq")


_add("intel_many", _many_needles, f"with {DOC}, n as ({_NEEDLES}) select event_seq from doc where exists (select 1 from n where contains(lower(message), needle))")
_add("many_blacklists", lambda s, d: engine.run(_events(s, d), _rules(*(f"program: {p}; blacklist: by_src;" for p in ("click", "view", "error", "signup")), "program: purchase;"), engine.Tables(blacklist=lookups.ranges(s, _BL))).groupBy("rule_pos").agg(F.count("*").alias("n")), f"with {EV} select case program when 'click' then 0 when 'view' then 1 when 'error' then 2 when 'signup' then 3 else 4 end as rule_pos, count(*) as n from ev where program = 'purchase' or {_IN_BL} group by 1")
_add("offload", lambda s, d: engine.run(_events(s, d), _rules('offload: "http://x";'), engine.Tables(offload={"http://x": lambda c: c.rlike(r"^10\.0\.0\.1\|auth\|info\|info\|00\|\d{4}-\d\d-\d\d\|\d\d:\d\d:\d\d\|purchase\| purchase user=1")})).select("event_seq"), f"with {EV} select event_seq from ev where program = 'purchase' and contains(message, 'user=1')")
for _track, _on in (("by_dst", "dst_ip"), ("by_string", "username"), ("by_username", "username"), ("by_srcport", "json_original"), ("by_dstport", "json_original")):
    _add(f"threshold_{_track}", lambda s, d, k=_track: engine.run(_json(_events(s, d)), _rules(f'json_map:"src_port",".k"; json_map:"dst_port",".k"; threshold: type limit, track {k}, count 1, seconds 50000000;')).select("event_seq"), f"with {EV} select min_by(event_seq, (t, event_seq)) as event_seq from ev group by {_on}")
_PORTED = 'json_map:"src_port",".k"; json_map:"dst_port",".k";'
for _d, _on in (("both_p", "e.src_ip = v.src_ip and e.dst_ip = v.dst_ip"), ("by_dst_p", "e.dst_ip = v.dst_ip"), ("reverse_p", "e.src_ip = v.dst_ip and e.dst_ip = v.src_ip"), ("src_xbitdst_p", "e.dst_ip = v.src_ip"), ("dst_xbitsrc_p", "e.src_ip = v.dst_ip")):
    _add(f"flexbit_{_d}", lambda s, d, k=_d: engine.run(_json(_events(s, d)), _rules(_PORTED + "program: view; flexbits: set_ports,seen,900000; flexbits: noalert;", _PORTED + f"program: click; flexbits: isset,{k},seen;")).where("rule_pos = 1").select("event_seq"), f"with {EV} select v.event_seq from ev v where program = 'click' and exists (select 1 from ev e where e.program = 'view' and {_on} and e.json_original = v.json_original and e.event_seq < v.event_seq and v.t < e.t + 900000)")
_add("flexbit_set_dstport", lambda s, d: engine.run(_json(_events(s, d)), _rules(_PORTED + "program: view; flexbits: set_dstport,seen,90000; flexbits: noalert;", _PORTED + "program: click; flexbits: count,by_src,seen,=2;", _PORTED + "program: click; flexbits: count,by_src,seen,<1;")).where("rule_pos > 0").select("event_seq", "rule_pos"), f"with {EV}, n as (select v.event_seq, (select count(distinct e.json_original) from ev e where e.program = 'view' and e.src_ip = v.src_ip and e.event_seq < v.event_seq and v.t < e.t + 90000) as n from ev v where v.program = 'click') select event_seq, case n when 2 then 1 else 2 end as rule_pos from n where n in (0, 2)")
_add("correlation", lambda s, d: engine.run(_events(s, d), _rules("program: error; xbits: set,err,track ip_src,expire 90000; flexbits: set,bad,90000;", "program: purchase; xbits: isset,err,track ip_src;", "program: signup; flexbits: isset,by_src,bad;")).where("rule_pos > 0").select("event_seq", F.get_json_object("correlation", "$.xbit").alias("xbit"), F.get_json_object("correlation", "$.flexbit").alias("flexbit"), F.get_json_object("correlation", "$.event_seq").cast("long").alias("set_by")), f"with {EV}, x as (select v.*, (select max(e.event_seq) from ev e where e.program = 'error' and e.src_ip = v.src_ip and e.event_seq < v.event_seq and v.t < e.t + 90000) as set_by from ev v where v.program in ('purchase', 'signup')) select event_seq, case program when 'purchase' then 'err' end as xbit, case program when 'signup' then 'bad' end as flexbit, set_by from x where set_by is not null")


def _quiet(s, d):
    a = engine.alerts(_events(s, d), _rules("program: click; xbits: noalert;", "program: view; xbits: noeve;", "program: error; flexbits: noalert;", "program: signup;"))
    out = None
    for name, df in (("full", sinks.full(a)), ("eve", sinks.eve(a)), ("fast", sinks.fast(a)), ("syslog", sinks.syslog(a))):
        one = df.groupBy("sid").agg(F.count("*").alias("n")).withColumn("sink", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_add("quiet_bits", _quiet, f"with {EV}, k as (select case program when 'click' then 1 when 'view' then 2 else 4 end as sid, count(*) as n from ev where program in ('click', 'view', 'signup') group by 1) select cast(sid as bigint) as sid, n, sink from k, (values ('full'), ('eve'), ('fast'), ('syslog')) s(sink) where not (sid = 1 and sink = 'full') and not (sid = 2 and sink = 'eve')")


def _rich(s, d):
    rules = _rules('program: purchase; email: ops@example.org; external: "cat"; reference: url,example.com/1; reference: cve,2024-1; reference: other,x; metadata: team red, tag a b; normalize;', "program: signup;")
    t = engine.Tables(templates=Templates([r"purchase user=(?<username>\d+)"], [], []), references={"url": "http://", "cve": "http://cve/"})
    return engine.alerts(_events(s, d), rules, t)


_add("eve_blocks", lambda s, d: sinks.eve(_rich(s, d), in_iface="eth1").select("event_seq", *(F.get_json_object("value", p).alias(n) for n, p in (("in_iface", "$.in_iface"), ("team", "$.metadata.team[0]"), ("tag", "$.metadata.tag[1]"), ("username", "$.normalize.username")))), f"with {EV} select event_seq, 'eth1' as in_iface, case program when 'purchase' then 'red' end as team, case program when 'purchase' then 'b' end as tag, case program when 'purchase' then username end as username from ev where program in ('purchase', 'signup')")
_add("alert_xref", lambda s, d: sinks.full(_rich(s, d)).select("event_seq", F.element_at(F.split("value", "\n"), -1).alias("last")), f"with {EV} select event_seq, case program when 'purchase' then '[Xref => http://example.com/1] [Xref => http://cve/2024-1]' else 'Message: ' || message end as last from ev where program in ('purchase', 'signup')")
_add("mail", lambda s, d: sinks.mail(_rich(s, d)), f"with {EV} select event_seq, 'ops@example.org' as \"to\", '[alert] rule 1' as subject, 'rule 1' || chr(10) || message as body from ev where program = 'purchase'")
_add("external", lambda s, d: sinks.pipe_external(_rich(s, d)).select("command", F.get_json_object("value", "$.program").alias("program"), F.get_json_object("value", "$.src_ip").alias("src_ip")), f"with {EV} select 'cat' as command, program, src_ip from ev where program = 'purchase'")
_add("report", lambda s, d: sinks.report({"received": _events(s, d), "errors": _events(s, d).where("program = 'error'"), "none": _events(s, d).where("program = ''")}, "received").select("name", "count", "percent"), f"with {EV} select 'received' as name, count(*) as count, 100.0::double as percent from ev union all select 'errors', count(*) filter (program = 'error'), count(*) filter (program = 'error') * 100.0::double / count(*) from ev union all select 'none', count(*) filter (program = ''), 0.0::double from ev")
_add("dynamic_calls", lambda s, d: engine.dynamic_calls(_events(s, d), _rules('program: view; dynamic_load: "v.rules";', 'program: signup; dynamic_load: "s.rules";'), 10), f"with {EV} select case program when 'view' then 'v.rules' else 's.rules' end as ruleset, cast(case program when 'view' then 1 else 2 end as bigint) as sid, case program when 'view' then 'rule 1' else 'rule 2' end as msg, min_by(event_seq, (t, event_seq)) as event_seq from ev where event_seq % 10 = 0 and program in ('view', 'signup') group by 1, 2, 3")
