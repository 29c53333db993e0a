"""Enrichment: network ranges, indicators, geography, reputation, dimensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.net import PRIVATE, cidr_range, in_nets, ip_key, not_routable
from .needles import holders


#: Rows of a dimension up to which it is broadcast; a larger one is joined as Catalyst sees fit.
SMALL = 200_000


def small(df: DataFrame) -> DataFrame:
    """A dimension, with a broadcast hint if no more than SMALL rows of it are counted."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def ranges(spark: SparkSession, cidrs: list[tuple], columns: str = "cidr string") -> DataFrame:
    """(lo, hi, family, ...) of networks given as (cidr, ...) rows; invalid and repeated ones are left out."""
    out, seen = [], set()
    for row in cidrs:
        try:
            lo, hi = cidr_range(row[0])
        except ValueError:
            continue
        if (lo, hi) not in seen:
            seen.add((lo, hi))
            out.append((lo, hi, *row))
    return spark.createDataFrame(out, f"lo string, hi string, {columns}")


#: Characters of a key by which ranges are bucketed.
DIGITS = 3


def bucketed(r: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Ranges once for each prefix of `digits` characters that they touch: '4' and the first hex digits."""
    number = lambda c: F.conv(F.substring(c, 2, digits - 1), 16, 10).cast("long")
    return r.withColumn("bucket", F.explode(F.transform(F.sequence(number(F.col("lo")), number(F.col("hi"))), lambda n: F.concat(F.substring("lo", 1, 1), F.lpad(F.lower(F.hex(n)), digits - 1, "0")))))


def range_join(df: DataFrame, ip: str, r: DataFrame, how: str = "left_semi", digits: int = DIGITS) -> DataFrame:
    """Rows joined to the ranges that hold their address: an equi join on the key's prefix, then the bounds.

    Without the prefix Spark would compare every row with every range.
    """
    b = bucketed(r, digits)
    wide = df.withColumn("__ip", ip_key(F.col(ip))).withColumn("__bucket", F.substring("__ip", 1, digits))
    return wide.join(b, (F.col("__bucket") == F.col("bucket")) & F.col("__ip").between(F.col("lo"), F.col("hi")), how).drop("__ip", "__bucket", "bucket", "lo", "hi")


#: Ranges of one bucket up to which they go along as one row, each tested for the addresses of the bucket.
FEW_RANGES = 64


def by_bucket(r: DataFrame, *columns: str) -> DataFrame | None:
    """(bucket, ranges): the ranges, with some of their columns, in one row a bucket, to be broadcast; None where they are too many for that."""
    b = bucketed(r.select("lo", "hi", *columns))
    total, most = b.groupBy("bucket").count().agg(F.sum("count"), F.max("count")).first()
    if total is not None and (total > SMALL or most > FEW_RANGES):
        return None
    return F.broadcast(b.groupBy("bucket").agg(F.collect_set(F.struct("lo", "hi", *columns)).alias("ranges")))


def blacklisted(df: DataFrame, r: DataFrame, mode: str, key: str) -> DataFrame:
    """Distinct keys of rows whose source, destination, either (both valid), or any scanned address is in the ranges.

    mode: by_src, by_dst, both, all (needs a column `ips` of addresses).
    """
    if mode == "all":
        return range_join(df.select(key, F.explode("ips").alias("ip")), "ip", r).select(key).distinct()
    if mode == "both":
        ok = df.where(ip_key(F.col("src_ip")).isNotNull() & ip_key(F.col("dst_ip")).isNotNull())
        sides = ok.select(key, F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
        return range_join(sides, "ip", r).select(key).distinct()
    return range_join(df, {"by_src": "src_ip", "by_dst": "dst_ip"}[mode], r).select(key).distinct()


def intel_addresses(df: DataFrame, intel: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Rows whose address is an indicator of type ADDR; addresses that aren't routable never are.

    That is asked of the indicators, once each, instead of every row. As an
    aggregate's result it stays there: Catalyst would put a filter of the join's
    key on both sides.
    """
    mine = intel.where("type = 'ADDR'").groupBy(F.col("indicator").alias(ip)).agg(F.max(~not_routable(F.col("indicator"))).alias("__ok")).where("__ok")
    return df.join(mine.select(ip), ip, "left_semi")


#: Needles up to which a text is tested for each; beyond, texts are searched for all at once.
FEW_NEEDLES = 64


def few_needles(intel: DataFrame, kind: str) -> list[str] | None:
    """The indicators of a type in lower case; None where there are more than FEW_NEEDLES."""
    few = intel.where(F.col("type") == kind).select(F.lower("indicator").alias("needle")).where("needle <> ''").distinct().limit(FEW_NEEDLES + 1).collect()
    return [n.needle for n in few] if len(few) <= FEW_NEEDLES else None


def holds_any(text: Column, needles: list[str]) -> Column:
    """Whether a text holds one of a few needles of few_needles(), in any case."""
    hit, low = F.lit(False), F.lower(text)
    for n in needles:
        hit = hit | F.contains(low, F.lit(n))
    return hit


def intel_strings(df: DataFrame, intel: DataFrame, kind: str, column: str = "message", key: str = "event_seq") -> DataFrame:
    """Rows whose text holds an indicator of a type, in any case: a few indicators become one expression, many go through needles.holders()."""
    few = few_needles(intel, kind)
    if few is not None:
        return df.where(holds_any(F.col(column), few))
    mine = intel.where(F.col("type") == kind).select(F.lower("indicator").alias("needle")).where("needle <> ''").distinct()
    return df.join(holders(df.select(key, F.lower(F.col(column)).alias("__low")), mine, key, "__low"), key, "left_semi")


def addresses(df: DataFrame, *columns: str) -> DataFrame:
    """(ip): the distinct addresses of some columns."""
    return df.select(F.explode(F.array(*columns)).alias("ip")).where("ip is not null").distinct()


def countries(ips: DataFrame, geo: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """(ip, countries) of addresses(ip) that are routable, known and not skipped; countries in upper case."""
    known = ips.where(~not_routable(F.col("ip")))
    if skip is not None:
        known = range_join(known, "ip", skip, "left_anti")
    return range_join(known, "ip", geo.select("lo", "hi", F.upper("country").alias("__c")), "inner").groupBy("ip").agg(F.collect_set("__c").alias("countries"))


@dataclass
class Places:
    """Ranges of countries, and those to skip, as by_bucket() has them; skip may be None."""

    geo: DataFrame
    skip: DataFrame | None = None


def places(geo: DataFrame, skip: DataFrame | None = None) -> Places | None:
    """For located(); None where the ranges are too many for it, so that countries() has to be asked."""
    near = by_bucket(geo.select("lo", "hi", F.upper("country").alias("country")).where("country is not null"), "country")
    apart = by_bucket(skip) if skip is not None else None
    return None if near is None or skip is not None and apart is None else Places(near, apart)


def located(df: DataFrame, ip: Column, p: Places, name: str) -> DataFrame:
    """The rows with what countries() says of their address in a column more, null where it has nothing; no row is moved or read twice."""
    held = lambda ranges: F.filter(ranges, lambda x: F.col("__key").between(x["lo"], x["hi"]))
    out = df.withColumn("__key", ip_key(ip)).withColumn("__key", F.when(~in_nets(F.col("__key"), list(PRIVATE)), F.col("__key"))).withColumn("__bucket", F.substring("__key", 1, DIGITS))
    out = out.join(p.geo.select(F.col("bucket").alias("__b"), F.col("ranges").alias("__in")), F.col("__bucket") == F.col("__b"), "left").drop("__b")
    found = F.array_distinct(F.transform(held(F.col("__in")), lambda x: x["country"]))
    ok = F.size(found) > 0
    if p.skip is not None:
        out = out.join(p.skip.select(F.col("bucket").alias("__b"), F.col("ranges").alias("__not")), F.col("__bucket") == F.col("__b"), "left").drop("__b")
        ok = ok & (F.col("__not").isNull() | (F.size(held(F.col("__not"))) == 0))
    return out.withColumn(name, F.when(ok, found)).select(*df.columns, name)


def country(df: DataFrame, geo: DataFrame, ip: str, codes: list[str], inside: bool, skip: DataFrame | None = None) -> DataFrame:
    """Rows whose address is (or isn't) in countries; not routable, skipped and unknown addresses are neither."""
    c = countries(addresses(df, ip), geo, skip).withColumnsRenamed({"ip": "__i", "countries": "__c"})
    return df.join(c, F.col(ip) == F.col("__i")).where(F.exists("__c", lambda x: x.isin(codes) if inside else ~x.isin(codes))).drop("__i", "__c")


def reputation(df: DataFrame, rep: DataFrame, kind: str, column: str, categories: list[str], names: dict[str, int], mdate: int | None = None, cdate: int | None = None, now: Column | None = None) -> DataFrame:
    """Rows whose value has a reputation code of the categories that is not out of date."""
    codes = [names[c] for c in categories if c in names]
    r = rep.where((F.col("kind") == kind) & F.col("code").isin(codes))
    now = now if now is not None else F.unix_timestamp("event_time")
    on = F.col(column) == r["value"]
    if mdate is not None:
        on = on & (now - r["mtime"] <= mdate)
    if cdate is not None:
        on = on & (now - r["ctime"] <= cdate)
    return df.join(r, on, "left_semi")


def classify(alerts: DataFrame, classes: DataFrame) -> DataFrame:
    """Description of each class name, UNKNOWN where there is none."""
    return alerts.join(small(classes.select(F.col("short").alias("classtype"), F.col("description").alias("category"))), "classtype", "left").withColumn("category", F.coalesce("category", F.lit("UNKNOWN")))


def cross_references(rules_refs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(sid, xref): all references of a rule as "[Xref => url]", in their order."""
    j = rules_refs.join(small(prefixes), "id")
    return j.groupBy("sid").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("n", "url_prefix", "value"))), lambda x: F.concat(F.lit("[Xref => "), x["url_prefix"], x["value"], F.lit("]")))).alias("xref"))


def resolve_hosts(df: DataFrame, dns: DataFrame, default_host: str) -> DataFrame:
    """Host names replaced by their addresses from a table (host, ip); unknown names by the default."""
    j = df.join(small(dns.select(F.col("host").alias("__h"), F.col("ip").alias("__ip"))), F.col("host") == F.col("__h"), "left")
    return j.withColumn("host", F.when(ip_key(F.col("host")).isNotNull(), F.col("host")).otherwise(F.coalesce("__ip", F.lit(default_host)))).drop("__h", "__ip")
