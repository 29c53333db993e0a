"""Addresses, networks, ports and hashes found in text, as Column expressions.

An address becomes a key that sorts as text: '4' and 8 hex digits, or '6' and
32. Networks are ranges of such keys, so the families never mix and a range
test is a string comparison that Catalyst can push anywhere.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

V4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V6 = r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}"

#: What looks like an address and is not the machine's own.
REMOTE = rf"^(?!127\.|::1$)(?:{V4}|{V6})$"


def is_ipv4(c: Column) -> Column:
    return c.rlike(f"^{V4}$")


def ipv4_long(c: Column) -> Column:
    """A dotted quad as a number; anything else is null."""
    p = F.split(c, r"\.")
    n = lambda i: F.get(p, F.lit(i)).cast("long")
    return F.when(is_ipv4(c), ((n(0) * 256 + n(1)) * 256 + n(2)) * 256 + n(3))


def long_ipv4(c: Column) -> Column:
    """A number as a dotted quad."""
    part = lambda s: F.shiftright(c, s).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


def ip_key(c: Column) -> Column:
    """Sortable key of an address of either family; null where the text is none. IPv4-mapped IPv6 counts as IPv4."""
    c = F.when(F.contains(c, F.lit(":")), F.regexp_replace(c, r"^(?i)::ffff:(?=\d+\.)", "")).otherwise(c)
    halves = F.split(F.lower(c), "::")
    groups = lambda h: F.filter(F.split(h, ":"), lambda x: x != "")
    left, right = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    fill = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    full = F.when(F.size(halves) == 2, F.concat(left, fill, right)).otherwise(left)
    six = F.concat(F.lit("6"), F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))
    p = F.split(c, r"\.")
    four = F.lower(F.format_string("4%02X%02X%02X%02X", *(F.get(p, F.lit(i)).cast("int") for i in range(4))))
    return F.when(is_ipv4(c), four).when(F.contains(c, F.lit(":")) & c.rlike(f"^{V6}$") & (F.size(halves) <= 2) & (F.size(full) == 8), six)


def key_of(ip) -> str:
    """ip_key() of a driver-side address."""
    a = ipaddress.ip_address(ip)
    if a.version == 6 and a.ipv4_mapped:
        a = a.ipv4_mapped
    return f"{a.version}{int(a):0{8 if a.version == 4 else 32}x}"


def cidr_range(cidr: str) -> tuple[str, str]:
    """First and last key of a network or a single address."""
    n = ipaddress.ip_network(cidr.strip(), strict=False)
    return key_of(n[0]), key_of(n[-1])


def in_nets(key: Column, nets: list[str]) -> Column:
    """Whether a key falls in any of a short list of networks."""
    out = F.lit(False)
    for n in nets:
        lo, hi = cidr_range(n)
        out = out | key.between(lo, hi)
    return F.coalesce(out, F.lit(False))


def nets_match(key: Column, nets: list[tuple[bool, str]]) -> Column:
    """No negated network holds the address of this key, and a positive one does if there are any."""
    no, yes = [n for neg, n in nets if neg], [n for neg, n in nets if not neg]
    out = F.lit(True)
    if no:
        out = out & ~in_nets(key, no)
    return out & in_nets(key, yes) if yes else out


def ports_match(port: Column, ports: list[tuple[bool, int, int]]) -> Column:
    """The same for ports."""
    one = lambda lo, hi: F.coalesce(port.between(lo, hi), F.lit(False))
    out, yes = F.lit(True), [(a, b) for neg, a, b in ports if not neg]
    for neg, a, b in ports:
        if neg:
            out = out & ~one(a, b)
    if yes:
        hit = F.lit(False)
        for a, b in yes:
            hit = hit | one(a, b)
        out = out & hit
    return out


PRIVATE = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "255.255.255.255/32", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8")


def not_routable(ip: Column) -> Column:
    """Private, link-local, multicast, loopback and broadcast addresses, and what is no address."""
    key = ip_key(ip)
    return key.isNull() | in_nets(key, list(PRIVATE))


_MARKS = "\"()[]<>{},/@=-!|_+&%$~^'"
#: What divides words, and what words are made of.
_GAP = r"[\s\"()\[\]<>{},/@=\-!|_+&%$~^']"
_WORD = r"[^\s\"()\[\]<>{},/@=\-!|_+&%$~^']"
_END = rf"(?={_GAP}|$)"
#: What every address has, of either family.
_SIGNS = (r"\d\.\d{1,3}\.\d{1,3}\.\d", r":[0-9A-Fa-f]{0,4}:")
_SIGN = "|".join(_SIGNS)
_HEX = "[0-9A-Fa-f]"
#: An IPv6 address that ip_key() takes: eight groups, or one "::".
_SIX = rf"(?:{_HEX}{{1,4}}(?::{_HEX}{{1,4}}){{7}}|(?=:*{_HEX})(?=[0-9A-Fa-f:]*::)(?![0-9A-Fa-f:]*::[0-9A-Fa-f:]*::){V6})"
#: The address in a word, and the port in it or in the next three.
_ADDRESS = rf"^(?:[A-Za-z][A-Za-z0-9.]*[:#](?={V4}\.?{_END})|(?={V4}(?:[:#]\d{{1,5}})?\.?{_END})|(?={V6}#\d{{1,5}}{_END})|(?={_SIX}\.?{_END}))({V4}(?!\d)|{V6})"
_PORT = rf"^(?:(?:[^#\s\"()\[\]<>{{}},/@=\-!|_+&%$~^']*#|{V4}:)(?=\d{{1,5}}\.?{_END})|{_WORD}+{_GAP}+(?:(?i:(?:(?:source|destination|client):?{_GAP}+)?port:?){_GAP}+(?=\d{{1,5}}\.?:?{_END})|:(?=\d{{1,5}}{_END})))(\d{{1,5}})"


def may_have_ip(message: Column) -> Column:
    """Whether ip_scan() has to look at the words of a message. Two searches, as Java's are fast for what begins in one way only."""
    four, six = _SIGNS
    return message.rlike(four) | (F.contains(message, F.lit(":")) & message.rlike(six))


def _near(message: Column) -> Column:
    """array<struct<x, ip>>: the addresses in a message, each with its word and the next three."""
    near = F.when(may_have_ip(message), F.regexp_extract_all(message, F.lit(rf"(?<!{_WORD})(?=({_WORD}*?(?:{_SIGN}){_WORD}*(?:{_GAP}+{_WORD}+){{0,3}})){_WORD}+"), 1)).otherwise(F.array().cast("array<string>"))
    # one transform a step: inside a lambda nothing that is named twice is kept
    return F.filter(F.transform(near, lambda x: F.struct(x.alias("x"), F.regexp_extract(x, _ADDRESS, 1).alias("ip"))), lambda y: y["ip"] != "")


def ips(message: Column) -> Column:
    """array<string> of what ip_scan() finds, for readers that need no ports; these aren't looked for."""
    return F.transform(_near(message), lambda y: y["ip"])


def ip_scan(message: Column, limit: int | None = None) -> Column:
    """array<struct<ip, port>> of the addresses in a message, in order.

    Shapes: an address, with a final dot, ip:port, ip#port, name:ip, name#ip,
    and IPv6; a port can follow as "port N", "source|destination|client port
    N" or ":443". limit: addresses to keep, for readers that expect a bound
    (the original has 30).

    Messages are searched for what every address has, and only the words that
    have it are cut out, each with the next three; other text costs no more
    than that search.
    """
    found = _near(message)
    found = F.transform(found, lambda y: F.struct(y["ip"].alias("ip"), F.regexp_extract(y["x"], _PORT, 1).alias("port")))
    found = F.transform(found, lambda y: F.struct(y["ip"].alias("ip"), F.when(y["port"] != "", y["port"].cast("int")).otherwise(F.lit(0)).alias("port")))
    return F.slice(found, 1, limit) if limit else found


def proto_scan(message: Column) -> Column:
    """6, 17 or 1 where a word of the message is tcp, udp or icmp; else null."""
    word = lambda *names: message.rlike("(?i)(?:" + "|".join(rf"{n}(?<!{_WORD}.{{{len(n)}}})" for n in names) + f")(?!{_WORD})")
    low = F.lower(message)  # most texts have none of these; "cmp", as a locale may lower I to something else
    may = F.contains(low, F.lit("tcp")) | F.contains(low, F.lit("udp")) | F.contains(low, F.lit("cmp"))
    return F.when(may & word("tcp", "udp", "icmp"), F.when(word("tcp"), 6).when(word("udp"), 17).otherwise(1))


HASH_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64}


def hash_scan(message: Column, kind: str) -> Column:
    """First word of a hash's length that is all hex digits, punctuation taken off; null if none."""
    marks = _MARKS + ".:;#"
    text = F.concat(F.lit(" "), F.translate(message, marks, " " * len(marks)), F.lit(" "))
    found = F.regexp_extract(text, rf"\s([0-9A-Fa-f]{{{HASH_LENGTHS[kind]}}})\s", 1)
    return F.when(found != "", found)
