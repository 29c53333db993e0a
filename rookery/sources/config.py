"""Configuration, variables and dimension files."""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rules import Rule, check_duplicates, load_variables, parse_rules

_SKIP = "#; \n"


def _lines(path: str) -> list[str]:
    return [x for x in Path(path).read_text().splitlines() if x and x[0] not in _SKIP]


def load_config(path: str) -> dict:
    """YAML with `include` files merged in and variables resolved."""
    raw = yaml.safe_load(Path(path).read_text()) or {}
    inc = raw.pop("include", [])
    for p in [inc] if isinstance(inc, str) else inc:
        for k, v in load_config(str(Path(path).parent / p)).items():
            raw[k] = {**v, **raw[k]} if isinstance(raw.get(k), dict) and isinstance(v, dict) else raw.get(k, v)
    groups = raw.get("vars", {}) or {}
    flat: dict[str, str] = {}
    for k, v in groups.items():
        flat.update(v if isinstance(v, dict) else {k: v})
    raw["vars"] = load_variables({k: str(v) for k, v in flat.items()}, str(Path(path).parent))
    return raw


def load_ruleset(config: dict, base: str = ".", classes: dict[str, int] | None = None) -> list[Rule]:
    """Rules of all files named in `rules-files`; a sid may occur once."""
    out: list[Rule] = []
    for f in config.get("rules-files", []):
        for k, v in config["vars"].items():
            f = f.replace("$" + k, v)
        out += parse_rules(Path(base, f).read_text(), config["vars"], classes, f, len(out))
    check_duplicates(out)
    return out


def validate(path: str) -> int:
    """Loads a configuration with all its rules and gives their number; raises what is wrong."""
    cfg = load_config(path)
    base = str(Path(path).parent)
    classes = None
    if "classification" in cfg:
        classes = {a: c for a, _, c in classifications(str(Path(base, cfg["classification"])))}
    return len(load_ruleset(cfg, base, classes))


def classifications(path: str) -> list[tuple[str, str, int]]:
    out = []
    for x in _lines(path):
        a, b, c = (p.strip() for p in x.split(":", 1)[1].split(",", 2))
        c = int(c)
        if not c:
            raise ValueError(f"priority 0: {x}")
        out.append((a, b, c))
    return out


def references(path: str) -> list[tuple[str, str]]:
    return [tuple(p.strip() for p in x.split(":", 1)[1].split(",", 1)) for x in _lines(path)]


def protocol_map(path: str) -> tuple[list[tuple[str, int, bool]], list[tuple[str, int, bool]]]:
    """(message, program) lists of (needle, number, nocase)."""
    m, p = [], []
    for x in _lines(path):
        j = json.loads(x)
        (m if j["type"] == "message" else p).append((j["string"], int(j["protocol_number"]), str(j.get("case_sensitive", "false")).lower() != "true"))
    return m, p


def blacklist(path: str) -> list[tuple[str]]:
    return [(x.split()[0],) for x in _lines(path)]


def ignore_list(path: str) -> list[str]:
    return _lines(path)


def intel(spark: SparkSession, path: str) -> DataFrame:
    """(indicator, type, description) in lower case, each once."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="indicator string, type string, description string")
    t = F.upper(F.regexp_replace("type", "^Intel::", ""))
    return raw.select(F.lower("indicator").alias("indicator"), t.alias("type"), "description").where("indicator is not null").dropDuplicates(["indicator", "type"])


def categories(path: str) -> dict[str, int]:
    return {n.strip().lower(): int(c) for c, n in (x.split("|", 1) for x in _lines(path))}
