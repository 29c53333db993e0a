"""String predicates of the signature language as Column expressions. Offsets count characters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rules import Content


def valid_message(m: Column) -> Column:
    """Two characters at least, neither a line break."""
    breaks = ["\r", "\n", "\0"]
    return F.coalesce((F.length(m) >= 2) & ~F.substring(m, 1, 1).isin(breaks) & ~F.substring(m, 2, 1).isin(breaks), F.lit(False))


def glob(c: Column, pattern: str) -> Column:
    """Whole match with * and ?, case-sensitive."""
    if not set(pattern) & set("*?"):
        return c == pattern
    return c.rlike("^(?s)" + "".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in pattern) + "$")


def any_glob(c: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns matches; null where the column is."""
    plain = [p for p in patterns if not set(p) & set("*?")]
    tests = [c == plain[0] if len(plain) == 1 else c.isin(plain)] if plain else []
    return reduce(lambda a, b: a | b, [*tests, *(glob(c, p) for p in patterns if p not in plain)])


def window(m: Column, c: Content, previous: Content | None) -> Column:
    """The part of a message in which a content is sought.

    offset n starts after n characters, depth n keeps n + 1. distance n starts
    n + 1 characters after the previous content's depth and replaces both;
    within n then keeps n characters.
    """
    if c.distance is not None:
        begin = (previous.depth or 0 if previous else 0) + c.distance + 1
        out = F.substring(m, begin + 1, 1 << 30)
        return F.substring(out, 1, c.within) if c.within is not None and c.distance else out
    out = F.substring(m, c.offset + 1, 1 << 30) if c.offset else m
    return F.substring(out, 1, c.depth + 1) if c.depth is not None else out


def content(m: Column, c: Content, previous: Content | None = None) -> Column:
    """Whether one of the needles is there, or, negated, none; null where the message is."""
    hay = window(m, c, previous)
    if c.nocase:
        hay = F.lower(hay)
    needles = [n.lower() if c.nocase else n for n in c.needles]
    if len(needles) > 8:
        out = hay.rlike("|".join(map(re.escape, needles)))
    else:
        out = reduce(lambda a, b: a | b, [hay.contains(n) for n in needles]) if needles else F.lit(False)
    return ~out if c.negated else out


def contents(m: Column, cs: list[Content]) -> Column:
    return reduce(lambda a, b: a & b, [content(m, c, cs[i - 1] if i else None) for i, c in enumerate(cs)])


def event_id(m: Column, current: Column, ids: list[str]) -> Column:
    """The event id that a rule finds: the given one, or one that stands as "ID: " in the first 9 characters."""
    out = F.when(current.isin(ids), current)
    head = F.substring(m, 1, 9)
    for i in ids:
        out = F.coalesce(out, F.when(F.coalesce(current, F.lit("")) == "", F.when(F.contains(head, F.lit(f" {i}: ")), F.lit(i))))
    return out


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part * 100.0 / whole)


def human_age(seconds: Column) -> Column:
    """'1 days, 02:03:04' of a number of seconds."""
    p = lambda v: F.lpad(v.cast("string"), 2, "0")
    s = seconds.cast("long")
    day, hour, minute = F.floor(s / 86400), F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.concat(day.cast("string"), F.lit(" days, "), p(hour), F.lit(":"), p(minute), F.lit(":"), p(F.pmod(s, F.lit(60))))
