"""Chat formatting with tool-call linking.

Calls and results meet in a hash join on (conversation, identifier). Inside a
conversation calls are ordered topologically by what they depend on, arguments
are validated against the tool's JSON schema, and the conversation becomes
canonical JSON: sorted keys, no blanks, each call with its result.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v.is_integer()),
}
_ONE, _MANY, _NAMED = ("not", "items", "additionalProperties", "propertyNames", "contains", "if", "then", "else"), ("anyOf", "oneOf", "allOf", "prefixItems"), ("properties", "patternProperties", "$defs", "definitions")
#: Keywords that are checked, and those that only describe.
KNOWN = frozenset((*_ONE, *_MANY, *_NAMED, *"type enum const $ref minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minItems maxItems uniqueItems minProperties maxProperties required dependentRequired".split()))
NOTES = frozenset("title description default examples format deprecated readOnly writeOnly $schema $id $comment".split())


class SchemaError(ValueError):
    """A schema that can't be checked against."""


def check_schema(schema, root=None, at: str = "#") -> None:
    """Raises SchemaError where a schema has an unknown keyword or type, an invalid pattern or a reference that leads nowhere or in a circle."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise SchemaError(f"{at}: no schema")
    root = schema if root is None else root
    if strange := sorted(set(schema) - KNOWN - NOTES):
        raise SchemaError(f"{at}: unknown {', '.join(strange)}")
    kinds = schema.get("type", [])
    if strange := [k for k in ([kinds] if isinstance(kinds, str) else kinds) if k not in _TYPES]:
        raise SchemaError(f"{at}: unknown type {strange[0]!r}")
    for p in [*([schema["pattern"]] if "pattern" in schema else []), *schema.get("patternProperties", ())]:
        try:
            re.compile(p)
        except re.error as e:
            raise SchemaError(f"{at}: pattern {p!r}: {e}") from None
    seen, s = [], schema
    while isinstance(s, dict) and "$ref" in s:
        if s["$ref"] in seen:
            raise SchemaError(f"{at}: $ref in a circle")
        seen.append(s["$ref"])
        s = _target(root, s["$ref"])
    for k in _ONE:
        if k in schema:
            check_schema(schema[k], root, f"{at}/{k}")
    for k in _MANY:
        for i, s in enumerate(schema.get(k, ())):
            check_schema(s, root, f"{at}/{k}/{i}")
    for k in _NAMED:
        for n, s in schema.get(k, {}).items():
            check_schema(s, root, f"{at}/{k}/{n}")


def _target(root, ref: str):
    """The schema that a reference inside the document names."""
    if ref != "#" and not ref.startswith("#/"):
        raise SchemaError(f"$ref {ref!r} leads outside")
    out = root
    for k in ref[2:].split("/") if ref != "#" else ():
        k = k.replace("~1", "/").replace("~0", "~")
        try:
            out = out[int(k)] if isinstance(out, list) else out[k]
        except (KeyError, IndexError, ValueError, TypeError):
            raise SchemaError(f"$ref {ref!r} leads nowhere") from None
    return out


def _tidy(v):
    """Whole floats as integers, no NaN or infinity, halves of surrogate pairs joined or replaced."""
    if isinstance(v, str):
        return v if v.isascii() else v.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if isinstance(v, float):
        if not math.isfinite(v):
            return None
        return int(v) if v.is_integer() and abs(v) < 1 << 53 else v
    if isinstance(v, dict):
        return {_tidy(k): _tidy(x) for k, x in v.items()}
    return [_tidy(x) for x in v] if isinstance(v, list) else v


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; whole floats as integers, no NaN. Of keys that become equal the last stays."""
    return json.dumps(_tidy(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def violations(value, schema, at: str = "$", root=None) -> list[str]:
    """What in a value breaks a JSON schema that check_schema() accepts. Equality is that of JSON: 1 equals 1.0, not true."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: nothing is allowed"]
    root = schema if root is None else root
    look = lambda s, v=value, a=at: violations(v, s, a, root)
    out = look(_target(root, schema["$ref"])) if "$ref" in schema else []
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [*out, f"{at}: not {kinds}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not const")
    for s in schema.get("allOf", ()):
        out += look(s)
    if "anyOf" in schema and all(look(s) for s in schema["anyOf"]):
        out.append(f"{at}: none of anyOf")
    if "oneOf" in schema and sum(not look(s) for s in schema["oneOf"]) != 1:
        out.append(f"{at}: not one of oneOf")
    if "not" in schema and not look(schema["not"]):
        out.append(f"{at}: not allowed")
    if "if" in schema:
        out += look(schema.get("else" if look(schema["if"]) else "then", True))
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf) or value <= schema.get("exclusiveMinimum", -math.inf) or value >= schema.get("exclusiveMaximum", math.inf):
            out.append(f"{at}: range")
        if "multipleOf" in schema and Fraction(str(value)) % Fraction(str(schema["multipleOf"])):
            out.append(f"{at}: multiple")
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", math.inf):
            out.append(f"{at}: size")
        if schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value):
            out.append(f"{at}: repeated items")
        if "contains" in schema and all(look(schema["contains"], x) for x in value):
            out.append(f"{at}: contains none")
        first = schema.get("prefixItems", [])
        for i, x in enumerate(value):
            if i < len(first) or "items" in schema:
                out += look(first[i] if i < len(first) else schema["items"], x, f"{at}[{i}]")
    elif isinstance(value, dict):
        if len(value) < schema.get("minProperties", 0) or len(value) > schema.get("maxProperties", math.inf):
            out.append(f"{at}: size")
        known, by = schema.get("properties", {}), schema.get("patternProperties", {})
        need = [*schema.get("required", ()), *(k for n, more in schema.get("dependentRequired", {}).items() if n in value for k in more)]
        out += [f"{at}.{k}: missing" for k in need if k not in value]
        for k in sorted(value):
            if "propertyNames" in schema:
                out += look(schema["propertyNames"], k, f"{at}.{k}")
            mine = [*([known[k]] if k in known else []), *(s for p, s in by.items() if re.search(p, k))]
            for s in mine:
                out += look(s, value[k], f"{at}.{k}")
            if not mine and "additionalProperties" in schema:
                more = schema["additionalProperties"]
                out += [f"{at}.{k}: unknown"] if more is False else look(more, value[k], f"{at}.{k}")
    return out


def _no_constant(name: str):
    raise ValueError(name)


def checked(arguments: str | None, schema) -> tuple[object, list[str]]:
    """A call's arguments, and what is wrong with them. What is no JSON, or nested too deeply to be gone through, stays text."""
    try:
        args = _tidy(json.loads(arguments or "{}", parse_constant=_no_constant))
        wrong = ["$: no such tool"] if schema is None else violations(args, schema)
        canonical(args)
        return args, wrong
    except ValueError:
        return arguments, ["$: not JSON"]
    except RecursionError:
        return arguments, ["$: nested too deeply"]


def ordered(calls: list[dict]) -> tuple[list[dict], int]:
    """Calls after all they depend on, else by (turn, id, arguments); and how many are in or behind a cycle, which come last."""
    rank = lambda c: (c["turn"] is None, c["turn"] or 0, c["call_id"] or "", c["arguments"] or "")
    calls = sorted(calls, key=rank)
    by: dict = {}
    for i, c in enumerate(calls):
        by.setdefault(c["call_id"], []).append(i)
    need = [{j for d in c["depends"] or () for j in by.get(d, ()) if d is not None} for c in calls]
    behind: dict[int, list[int]] = {}
    for i, n in enumerate(need):
        for j in n:
            behind.setdefault(j, []).append(i)
    left = [len(n) for n in need]
    ready = [i for i, n in enumerate(left) if not n]
    heapq.heapify(ready)
    out = []
    while ready:
        i = heapq.heappop(ready)
        out.append(i)
        for k in behind.get(i, ()):
            left[k] -= 1
            if not left[k]:
                heapq.heappush(ready, k)
    done = set(out)
    rest = [i for i in range(len(calls)) if i not in done]
    return [calls[i] for i in out + rest], len(rest)


def chat(messages: list[dict], linked: list[dict], schemas: dict) -> dict:
    """One conversation as canonical JSON, with its counts."""
    calls, cyclic = ordered([x for x in linked if x["called"]])
    invalid, out_calls = 0, []
    for c in calls:
        args, wrong = checked(c["arguments"], schemas.get(c["name"]))
        invalid += bool(wrong)
        one = {"id": c["call_id"], "name": c["name"], "arguments": args, "results": sorted(x for x in c["results"] or () if x is not None)}
        out_calls.append(one | ({"errors": wrong} if wrong else {}))
    orphans = sorted(x for o in linked if not o["called"] for x in o["results"] or () if x is not None)
    key = lambda m: (m["turn"] is None, m["turn"] or 0, m["role"] or "", m["text"] or "")
    body = {"messages": [{"role": m["role"], "content": m["text"]} for m in sorted(messages, key=key)], "calls": out_calls}
    if orphans:
        body["orphans"] = orphans
    return {"chat": canonical(body), "calls": len(calls), "answered": sum(bool(c["results"]) for c in calls), "invalid": invalid, "orphans": len(orphans), "cyclic": cyclic}


_OUT = "chat string, calls int, answered int, invalid int, orphans int, cyclic int"


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, chat, calls, answered, invalid, orphans, cyclic): every conversation that has a message, call or result.

    messages(conv_id, turn, role, text); calls(conv_id, call_id, name,
    arguments as JSON text, turn, depends array<string>); results(conv_id,
    call_id, content). A call with several results has all of them, in order of
    their text; two calls of one id both get them. Results without a call, or
    with a null id, are orphans; calls of a null id are never answered. Null
    arguments are {}. Ties of turns are ordered by role and text, null turns
    come last, rows of a null conversation are left out, repeated rows stay.
    Arguments that are no JSON, or nested too deeply, are kept as text and
    invalid; halves of surrogate pairs become U+FFFD. A schema with a keyword,
    type or pattern that can't be checked raises SchemaError. Further columns
    are not read. A conversation becomes one value, so it has to fit a task.
    """
    for s in schemas.values():
        check_schema(s)
    c = calls.select("conv_id", "call_id", "name", "arguments", F.col("turn").cast("long").alias("turn"), "depends", F.lit(True).alias("called"))
    r = results.select("conv_id", "call_id", "content").groupBy("conv_id", "call_id").agg(F.collect_list(F.coalesce("content", F.lit(""))).alias("results"))
    linked = c.join(r, ["conv_id", "call_id"], "full_outer").withColumn("called", F.coalesce("called", F.lit(False)))
    m = messages.where("conv_id is not null").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")).alias("messages"))
    k = linked.where("conv_id is not null").groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "name", "arguments", "turn", "depends", "called", "results")).alias("linked"))
    both = m.join(k, "conv_id", "full_outer").select("conv_id", "messages", "linked")
    kind = both.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [chat(x or [], y or [], schemas) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            names = ["chat", "calls", "answered", "invalid", "orphans", "cyclic"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[n] for g in got], pa.string() if n == "chat" else pa.int32()) for n in names)], names=["conv_id", *names])

    return both.mapInArrow(run, f"conv_id {kind}, {_OUT}")


#: What a user turn, taken as a call of the assistant, may look like.
ASK_SCHEMAS = {"ask": {"type": "object", "required": ["query", "turn"], "properties": {"query": {"type": "string", "minLength": 20, "maxLength": 1500}, "turn": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, calls, results) of conversations without tools: user turns are calls, assistant turns results of the last user turn before them, all other rows messages.

    A call depends on the call before it. Of rows of one turn users come first.
    Rows without a turn come before all others: their calls have no id, their
    answers are orphans, as are answers before any call.
    """
    ident = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    turn, user = F.col("turn"), F.coalesce(F.col("role") == "user", F.lit(False))
    order = Window.partitionBy("conv_id").orderBy(turn, F.when(user, 0).otherwise(1))
    asked = F.last(F.when(user, turn), ignorenulls=True)
    rows = conversations.select("conv_id", "turn", "role", "text", asked.over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("asked"), asked.over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    messages = rows.where("role is null or role not in ('user', 'assistant')").select("conv_id", "turn", "role", "text")
    calls = rows.where(user).select("conv_id", ident(turn).alias("call_id"), F.lit("ask").alias("name"), F.to_json(F.struct(F.col("text").alias("query"), turn.alias("turn"))).alias("arguments"), "turn", F.when(F.col("before") < turn, F.array(ident(F.col("before")))).alias("depends"))
    results = rows.where("role = 'assistant'").select("conv_id", F.when(turn.isNotNull(), ident(F.col("asked"))).alias("call_id"), F.col("text").alias("content"))
    return messages, calls, results
