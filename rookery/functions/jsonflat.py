"""Flattened JSON: pairs of path and text, breadth first, and predicates over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.rules import Content

_PAIRS = "array<struct<key:string,value:string>>"


def _children(doc: Column, prefix: Column) -> Column:
    pairs = F.map_entries(F.from_json(doc, "map<string,string>"))
    return F.transform(F.coalesce(pairs, F.array().cast(_PAIRS)), lambda p: F.struct(F.concat(prefix, F.lit("."), p["key"]).alias("key"), F.coalesce(p["value"], F.lit("null")).alias("value")))


def flatten(doc: Column, limit: int | None = None) -> Column:
    """array<struct<key, value>>: ("", document), then ".a", then ".a.b", level by level, however deep it is.

    Values with a brace among their first three characters are opened, strings
    that hold JSON included; arrays stay text; null is "null". Text that is no
    object gives the first pair alone, null gives null. limit: pairs to keep,
    for readers that expect a bound (the original has 256).
    """
    level = _children(doc, F.lit(""))
    start = F.struct(F.concat(F.array(F.struct(F.lit("").alias("key"), doc.alias("value"))), level).alias("out"), level.alias("open"))

    def deeper(seen: Column, _: Column) -> Column:
        inner = F.filter(seen["open"], lambda p: F.contains(F.substring(p["value"], 1, 3), F.lit("{")))
        new = F.flatten(F.transform(inner, lambda p: _children(p["value"], p["key"])))
        return F.struct(F.concat(seen["out"], new).alias("out"), new.alias("open"))

    # each level opens a brace, so there are no more levels than braces
    braces = F.length(doc) - F.length(F.translate(doc, "{", ""))
    rounds = F.when(braces > 1, F.sequence(F.lit(2), braces)).otherwise(F.array().cast("array<int>"))
    out = F.aggregate(rounds, start, deeper)["out"]
    return F.when(doc.isNotNull(), F.slice(out, 1, limit) if limit else out)


def get(pairs: Column, key: str) -> Column:
    """Value of the first pair with a key."""
    return F.get(F.filter(pairs, lambda p: p["key"] == key), F.lit(0))["value"]


def first_of(pairs: Column, keys: list[str]) -> Column:
    """Value of the first pair, in order of the document, whose key is among several."""
    return F.get(F.filter(pairs, lambda p: p["key"].isin(keys)), F.lit(0))["value"]


def _value(v: Column, c: Content) -> Column:
    if c.base64:
        v = F.coalesce(F.try_to_binary(v, F.lit("base64")).cast("string"), F.lit(""))
    return F.lower(v) if c.nocase else v


def _one(v: Column, c: Content, needle: str) -> Column:
    n = needle.lower() if c.nocase else needle
    return F.contains(v, F.lit(n)) if c.contains else v == n


def json_content(pairs: Column, c: Content) -> Column:
    """The key is there and every value under it is (or, negated, is not) the text."""
    mine = F.filter(pairs, lambda p: p["key"] == c.key)

    def ok(p):
        hit = _one(_value(p["value"], c), c, c.needles[0])
        return ~hit if c.negated else hit

    return F.coalesce((F.size(mine) > 0) & F.forall(mine, ok), F.lit(False))


def json_pcre(pairs: Column, key: str, regex: str, base64: bool = False) -> Column:
    """Every value under the key matches; a missing key passes."""
    c = Content([], base64=base64)
    return F.coalesce(F.forall(F.filter(pairs, lambda p: p["key"] == key), lambda p: _value(p["value"], c).rlike(regex)), F.lit(True))


def json_meta_content(pairs: Column, c: Content) -> Column:
    """Every value under the key is one (or, negated, none) of the list; a missing key fails."""
    mine = F.filter(pairs, lambda p: p["key"] == c.key)

    def ok(p):
        v, hit = _value(p["value"], c), F.lit(False)
        for n in c.needles:
            hit = hit | _one(v, c, n)
        return ~hit if c.negated else hit

    return F.coalesce((F.size(mine) > 0) & F.forall(mine, ok), F.lit(False))
