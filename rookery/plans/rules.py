"""Rule text to Rule objects: a quote-aware parser of the signature language."""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

ACTIONS = ("alert", "drop", "pass")
PROTOCOLS = {"any": 0, "ip": 0, "icmp": 1, "tcp": 6, "udp": 17, "syslog": 0}
OPTIONS = frozenset(
    """parse_port parse_proto parse_proto_program flexbits_upause xbits_upause flexbits_pause xbits_pause
    default_proto default_src_port default_dst_port parse_src_ip parse_dst_ip parse_hash xbits flexbits
    dynamic_load country_code meta_content meta_nocase rev classtype program event_type reference sid
    syslog_tag syslog_facility syslog_level syslog_priority tag facility level pri priority email normalize
    msg content nocase offset meta_offset depth meta_depth distance meta_distance within meta_within pcre
    alert_time threshold after blacklist bro-intel zeek-intel external reputation metadata event_id
    json_content json_nocase json_contains json_strstr json_pcre json_meta_content json_meta_nocase
    json_meta_contains json_meta_strstr json_map json_decode_base64 json_decode_base64_pcre
    json_decode_base64_meta json_base64_decode json_base64_decode_pcre json_base64_decode_meta
    append_program offload""".split()
)
TRACKS = {"by_src": "src_ip", "by_dst": "dst_ip", "by_username": "username", "by_string": "username", "by_srcport": "src_port", "by_dstport": "dst_port"}


#: The place in a meta_content template that each item of its list takes.
PLACE = re.compile(r"%[a-z]+%")


class RuleError(ValueError):
    """A rule that can't be loaded."""


@dataclass
class Content:
    """A content, meta_content or json_content test with its modifiers."""

    needles: list[str]
    negated: bool = False
    nocase: bool = False
    offset: int | None = None
    depth: int | None = None
    distance: int | None = None
    within: int | None = None
    key: str | None = None
    contains: bool = False
    base64: bool = False


@dataclass
class Rate:
    """threshold or after."""

    keys: list[str]
    count: int
    seconds: int
    kind: str = "limit"


@dataclass
class Bit:
    """One xbits or flexbits action."""

    action: str
    name: str = ""
    track: str = ""
    seconds: int = 0
    op: str = ""
    number: int = 0


@dataclass
class Rule:
    """A compiled signature; unset options have no effect."""

    action: str = "alert"
    proto: int = 0
    src_nets: list[tuple[bool, str]] = field(default_factory=list)
    src_ports: list[tuple[bool, int, int]] = field(default_factory=list)
    direction: str = "->"
    dst_nets: list[tuple[bool, str]] = field(default_factory=list)
    dst_ports: list[tuple[bool, int, int]] = field(default_factory=list)
    msg: str = ""
    sid: int = 0
    rev: int = 0
    classtype: str = ""
    priority: int | None = None
    references: list[tuple[str, str]] = field(default_factory=list)
    email: str = ""
    metadata: dict[str, list[str]] = field(default_factory=dict)
    programs: list[str] = field(default_factory=list)
    facilities: list[str] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    priorities: list[str] = field(default_factory=list)
    append_program: bool = False
    contents: list[Content] = field(default_factory=list)
    pcres: list[str] = field(default_factory=list)
    metas: list[Content] = field(default_factory=list)
    json_contents: list[Content] = field(default_factory=list)
    json_pcres: list[tuple[str, str, bool]] = field(default_factory=list)
    json_metas: list[Content] = field(default_factory=list)
    json_map: dict[str, str] = field(default_factory=dict)
    event_ids: list[str] = field(default_factory=list)
    parse_src_ip: int = 0
    parse_dst_ip: int = 0
    parse_hashes: list[str] = field(default_factory=list)
    parse_proto: bool = False
    parse_proto_program: bool = False
    default_proto: int = 0
    default_src_port: int = 0
    default_dst_port: int = 0
    normalize: bool = False
    xbits: list[Bit] = field(default_factory=list)
    flexbits: list[Bit] = field(default_factory=list)
    noalert: bool = False
    #: Kept out of the alert log alone, and of EVE alone.
    nolog: bool = False
    noeve: bool = False
    threshold: Rate | None = None
    after: Rate | None = None
    alert_days: frozenset[int] | None = None
    alert_hours: tuple[int, int] | None = None
    blacklist: list[str] = field(default_factory=list)
    intel: list[str] = field(default_factory=list)
    country: tuple[str, bool, list[str]] | None = None
    reputation: list[tuple[str, str, list[str], int | None, int | None]] = field(default_factory=list)
    dynamic_load: str = ""
    offload: str = ""
    external: str = ""
    ruleset: str = ""
    position: int = 0
    text: str = ""

    @property
    def has_flow(self) -> bool:
        return bool(self.proto or self.src_nets or self.dst_nets or self.src_ports or self.dst_ports)


def substitute(text: str, variables: dict[str, str]) -> str:
    """$NAME replaced by its value, in order of declaration."""
    for k in variables:
        text = re.sub(rf"\${re.escape(k)}\b", lambda m, v=variables[k]: v, text)
    return text


def load_variables(raw: dict[str, str], base: str = ".") -> dict[str, str]:
    """Variables in order; `file:/path` is read as one value a line, joined by commas; earlier ones are substituted in later."""
    out: dict[str, str] = {}
    for k, v in raw.items():
        v = str(v)
        if v.startswith("file:"):
            v = ",".join(x.strip() for x in Path(base, v[5:]).read_text().splitlines() if x.strip() and x[0] not in "#;")
        out[k] = substitute(v, out)
    return out


def _split(text: str, sep: str) -> list[str]:
    """Split outside of double quotes and brackets."""
    out, at, quoted, deep = [], 0, False, 0
    for i, c in enumerate(text):
        if c == '"' and (i == 0 or text[i - 1] != "\\"):
            quoted = not quoted
        elif not quoted and c in "[(":
            deep += 1
        elif not quoted and c in "])":
            deep -= 1
        elif c == sep and not quoted and (deep <= 0 or sep == ";"):
            out.append(text[at:i])
            at = i + 1
    out.append(text[at:])
    return out


def unquote(v: str) -> tuple[bool, str]:
    """(negated, text between the outer quotes)."""
    v = v.strip()
    a = v.find('"')
    neg = v.startswith("!") or "!" in (v[:a] if a >= 0 else "")
    if a < 0:
        return neg, v.lstrip("!").strip()
    b = v.rfind('"')
    return neg, v[a + 1 : b if b > a else None].replace('\\"', '"')


def unhex(v: str) -> str:
    """|41 42| escapes as characters."""
    def one(m):
        try:
            return bytes.fromhex(m.group(1).replace(" ", "")).decode("utf-8", "replace")
        except ValueError:
            raise RuleError(f"bad hex in {v!r}") from None

    return re.sub(r"\|([^|]*)\|", one, v)


def pcre_to_java(v: str) -> str:
    """/re/flags as a Java expression; flags i s m x A E, and G, which changes nothing for a test. Others (R, U) are refused."""
    v = v.strip()
    a, b = v.find("/"), v.rfind("/")
    if a < 0 or b <= a:
        raise RuleError(f"bad pcre {v!r}")
    body, flags = v[a + 1 : b], v[b + 1 :]
    if set(flags) - set("ismxAEG"):
        raise RuleError(f"bad pcre flags {flags!r}")
    if "E" in flags:
        body = re.sub(r"(?<!\\)\$$", r"\\z", body)
    if "A" in flags:
        body = r"\A(?:" + body + ")"
    inline = "".join(f for f in "ismx" if f in flags)
    return (f"(?{inline})" if inline else "") + body


def _list(v: str) -> list[str]:
    return [x.strip() for x in v.replace("|", ",").split(",") if x.strip()]


def _nets(tok: str) -> list[tuple[bool, str]]:
    tok = tok.strip()
    whole = tok.startswith("!") or tok.startswith("not ")
    tok = tok.lstrip("!").removeprefix("not ").strip()
    if tok.count("[") != tok.count("]"):
        raise RuleError(f"unbalanced list {tok!r}")
    out = []
    for x in tok.strip("[]").split(","):
        x = x.strip()
        neg = whole ^ (x.startswith("!") or x.startswith("not "))
        x = x.lstrip("!").removeprefix("not ").strip()
        if x and x != "any":
            out.append((neg, x))
    return out


def _networks(tok: str) -> list[tuple[bool, str]]:
    out = _nets(tok)
    for _, x in out:
        try:
            ipaddress.ip_network(x, strict=False)
        except ValueError:
            raise RuleError(f"bad network {x!r}") from None
    return out


def _ports(tok: str) -> list[tuple[bool, int, int]]:
    out = []
    for neg, x in _nets(tok):
        lo, _, hi = x.partition(":")
        try:
            lo_n = int(lo or 0)
            hi_n = int(hi) if hi else (65535 if ":" in x else lo_n)
        except ValueError:
            raise RuleError(f"bad port {x!r}") from None
        out.append((neg, lo_n, hi_n))
    return out


def _number(name: str, v: str) -> int:
    try:
        return int(v.strip())
    except ValueError:
        raise RuleError(f"{name} needs a number, has {v!r}") from None


def _rate(v: str, what: str) -> Rate:
    kind, keys, count, seconds = "limit", [], 0, 0
    for part in v.split(","):
        word, _, rest = part.strip().partition(" ")
        if word == "type":
            kind = rest.strip()
        elif word == "track":
            for k in rest.split("&"):
                if k.strip() not in TRACKS:
                    raise RuleError(f"{what}: unknown track {k!r}")
                keys.append(TRACKS[k.strip()])
        elif word == "count":
            count = _number(what, rest)
        elif word == "seconds":
            seconds = _number(what, rest)
        else:
            raise RuleError(f"{what}: unknown {word!r}")
    if not keys or count <= 0 or seconds <= 0 or kind not in ("limit", "suppress"):
        raise RuleError(f"{what} needs track, count and seconds: {v!r}")
    return Rate(list(dict.fromkeys(keys)), count, seconds, kind)


UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}


def to_seconds(v: str) -> int:
    """'3 days' in seconds."""
    n, _, unit = v.strip().partition(" ")
    return int(n) * UNITS[(unit.strip() or "second").rstrip("s")]


DIRECTIONS = ("none", "both", "by_src", "by_dst", "reverse", "src_xbitdst", "dst_xbitsrc", "both_p", "by_src_p", "by_dst_p", "reverse_p", "src_xbitdst_p", "dst_xbitsrc_p", "username")


def _xbits(v: str) -> Bit:
    p = [x.strip() for x in v.split(",")]
    if p[0] in ("noalert", "nounified2", "noeve"):
        return Bit(p[0])
    if p[0] not in ("set", "unset", "isset", "isnotset") or len(p) < 3:
        raise RuleError(f"xbits: {v!r}")
    track = p[2].removeprefix("track ").strip()
    if track not in ("ip_src", "ip_dst", "ip_pair"):
        raise RuleError(f"xbits: unknown track {track!r}")
    sec = 0
    if p[0] == "set":
        if len(p) < 4:
            raise RuleError("xbits: set needs expire")
        sec = _number("xbits", p[3].removeprefix("expire "))
    return Bit(p[0], p[1], track, sec)


def _flexbits(v: str) -> Bit:
    p = [x.strip() for x in v.split(",")]
    if p[0] in ("noalert", "nounified2", "noeve"):
        return Bit(p[0])
    if p[0] in ("set", "set_srcport", "set_dstport", "set_ports") and len(p) == 3:
        return Bit(p[0], p[1], "", _number("flexbits", p[2]))
    if p[0] in ("unset", "isset", "isnotset") and len(p) == 3:
        if p[1] not in DIRECTIONS:
            raise RuleError(f"flexbits: unknown direction {p[1]!r}")
        return Bit(p[0], p[2], p[1])
    if p[0] == "count" and len(p) == 4 and p[1] in ("by_src", "by_dst"):
        m = re.fullmatch(r"([<>=])\s*(\d+)", p[3])
        if m:
            return Bit("count", p[2], p[1], 0, m[1], int(m[2]))
    raise RuleError(f"flexbits: {v!r}")


def parse_rule(line: str, variables: dict[str, str] | None = None, classes: dict[str, int] | None = None, position: int = 0, ruleset: str = "", aliases: dict[str, str] | None = None) -> Rule:
    """One rule. Raises RuleError where the text is no rule.

    aliases: other names of options, such as a vendor's for `reputation`.
    """
    text = substitute(line.strip(), variables or {})
    a, b = text.find("("), text.rfind(")")
    if a < 0 or b < a:
        raise RuleError("no option list")
    head = re.sub(r"\[([^\]]*)\]", lambda m: "[" + m[1].replace(" ", "") + "]", text[:a])
    head = re.sub(r"\bnot\s+(?=\S)", "!", head).split()
    if len(head) != 7:
        raise RuleError(f"header of {len(head)} parts")
    action, proto, sn, sp, direction, dn, dp = head
    if action not in ACTIONS:
        raise RuleError(f"unknown action {action!r}")
    if proto not in PROTOCOLS:
        raise RuleError(f"unknown protocol {proto!r}")
    if direction not in ("->", "<-", "<>", "any", "<->"):
        raise RuleError(f"unknown direction {direction!r}")
    r = Rule(action, PROTOCOLS[proto], _networks(sn), _ports(sp), "<>" if direction in ("any", "<->") else direction, _networks(dn), _ports(dp), position=position, ruleset=ruleset, text=line.strip())
    last: Content | None = None
    seen = set()
    for opt in _split(text[a + 1 : b], ";"):
        if not opt.strip():
            continue
        name, _, v = opt.strip().partition(":")
        name, v = (aliases or {}).get(name.strip(), name.strip()), v.strip()
        if name not in OPTIONS:
            raise RuleError(f"unknown option {name!r}")
        seen.add(name)
        if name in ("msg", "normalize", "email", "external", "offload", "dynamic_load"):
            val = unquote(v)[1]
            setattr(r, name, True if name == "normalize" else val)
        elif name in ("sid", "rev", "parse_src_ip", "parse_dst_ip", "default_src_port", "default_dst_port"):
            setattr(r, name, _number(name, v))
        elif name == "classtype":
            if classes is not None:
                if v not in classes:
                    raise RuleError(f"unknown classtype {v!r}")
                r.priority = classes[v]
            r.classtype = v
        elif name in ("priority", "pri"):
            r.priority = _number(name, v)
        elif name == "reference":
            k, _, ref = v.partition(",")
            r.references.append((k.strip(), ref.strip()))
        elif name == "metadata":
            for item in v.split(","):
                words = item.split()
                if words:
                    r.metadata.setdefault(words[0], []).extend(words[1:])
        elif name in ("program", "event_type"):
            r.programs = [x.strip() for x in v.split("|") if x.strip()]
        elif name in ("syslog_facility", "facility"):
            r.facilities = _list(v)
        elif name in ("syslog_level", "level"):
            r.levels = _list(v)
        elif name in ("syslog_tag", "tag"):
            r.tags = _list(v)
        elif name == "syslog_priority":
            r.priorities = _list(v)
        elif name == "append_program":
            r.append_program = True
        elif name == "content":
            neg, s = unquote(v)
            last = Content([unhex(s)], neg)
            r.contents.append(last)
        elif name == "meta_content":
            parts = _split(v, ",")
            neg, tpl = unquote(parts[0])
            last = Content([PLACE.sub(lambda m, x=x: x.strip(), unhex(tpl), count=1) for x in parts[1:] if x.strip()], neg)
            r.metas.append(last)
        elif name in ("nocase", "meta_nocase"):
            (r.metas if name[0] == "m" else r.contents)[-1].nocase = True
        elif name in ("offset", "depth", "distance", "within", "meta_offset", "meta_depth", "meta_distance", "meta_within"):
            group = r.metas if name.startswith("meta_") else r.contents
            if not group:
                raise RuleError(f"{name} without content")
            setattr(group[-1], name.removeprefix("meta_"), _number(name, v))
        elif name == "pcre":
            r.pcres.append(pcre_to_java(unquote(v)[1]))
        elif name == "event_id":
            r.event_ids = _list(v)
        elif name == "json_content":
            k, rest = _split(v, ",")[0], ",".join(_split(v, ",")[1:])
            neg0, key = unquote(k)
            neg1, s = unquote(rest)
            r.json_contents.append(Content([unhex(s)], neg0 or neg1, key=key))
        elif name == "json_meta_content":
            parts = _split(v, ",")
            neg0, key = unquote(parts[0])
            items = [unquote(x) for x in parts[1:] if x.strip()]
            r.json_metas.append(Content([unhex(x) for _, x in items], neg0 or any(n for n, _ in items[:1]), key=key))
        elif name in ("json_nocase", "json_contains", "json_strstr"):
            setattr(r.json_contents[-1], "nocase" if name == "json_nocase" else "contains", True)
        elif name in ("json_meta_nocase", "json_meta_contains", "json_meta_strstr"):
            setattr(r.json_metas[-1], "nocase" if name == "json_meta_nocase" else "contains", True)
        elif name == "json_pcre":
            k, rest = _split(v, ",")[0], ",".join(_split(v, ",")[1:])
            r.json_pcres.append((unquote(k)[1], pcre_to_java(unquote(rest)[1]), False))
        elif name in ("json_decode_base64", "json_base64_decode"):
            r.json_contents[-1].base64 = True
        elif name in ("json_decode_base64_meta", "json_base64_decode_meta"):
            r.json_metas[-1].base64 = True
        elif name in ("json_decode_base64_pcre", "json_base64_decode_pcre"):
            r.json_pcres[-1] = (*r.json_pcres[-1][:2], True)
        elif name == "json_map":
            k, val = (unquote(x)[1] for x in _split(v, ",")[:2])
            r.json_map[{"dest_ip": "dst_ip", "dest_port": "dst_port"}.get(k, k)] = val
        elif name == "parse_hash":
            for x in _list(v):
                if x not in ("md5", "sha1", "sha256"):
                    raise RuleError(f"unknown hash {x!r}")
                r.parse_hashes.append(x)
        elif name in ("parse_proto", "parse_proto_program"):
            setattr(r, name, True)
        elif name == "default_proto":
            r.default_proto = PROTOCOLS[v] if v in PROTOCOLS else _number(name, v)
        elif name == "xbits":
            bit = _xbits(v)
            if bit.action == "noalert":
                r.nolog = True
            elif bit.action == "noeve":
                r.noeve = True
            elif bit.action != "nounified2":
                r.xbits.append(bit)
        elif name == "flexbits":
            bit = _flexbits(v)
            if bit.action in ("noalert", "noeve"):
                setattr(r, bit.action, True)
            elif bit.action != "nounified2":
                r.flexbits.append(bit)
        elif name == "threshold":
            r.threshold = _rate(v, name)
        elif name == "after":
            r.after = _rate(v, name)
        elif name == "alert_time":
            for part in v.split(","):
                word, _, rest = part.strip().partition(" ")
                if word == "days":
                    r.alert_days = frozenset(int(c) for c in rest.strip() if c.isdigit())
                elif word == "hours":
                    lo, _, hi = rest.strip().partition("-")
                    r.alert_hours = (int(lo), int(hi))
        elif name == "blacklist":
            r.blacklist = _list(v)
        elif name in ("zeek-intel", "bro-intel"):
            r.intel = [x.removeprefix("src_ipaddr") or "by_src" for x in _list(v)]
        elif name == "country_code":
            m = re.fullmatch(r"track\s+(by_src|by_dst)\s*,\s*(isnot|is)\s+(.*)", v)
            if not m:
                raise RuleError(f"country_code: {v!r}")
            r.country = (m[1], m[2] == "is", [x.strip().upper() for x in m[3].strip("[]").split(",") if x.strip()])
        elif name == "reputation":
            m = re.fullmatch(r"type\s+(\w+)\s*(?:,\s*track\s+(\w+)\s*)?((?:,\s*(?:mdate|cdate)_effective_period\s+[\w ]+)*),\s*(.*)", v)
            if not m:
                raise RuleError(f"reputation: {v!r}")
            if m[1] not in ("ip_reputation", "file_hash", "url", "filename", "ja3"):
                raise RuleError(f"reputation: unknown type {m[1]!r}")
            if m[2] and m[2] not in ("by_src", "by_dst", "both", "all"):
                raise RuleError(f"reputation: unknown track {m[2]!r}")
            per = {k: to_seconds(p) for k, p in re.findall(r"(mdate|cdate)_effective_period\s+([\w ]+)", m[3])}
            r.reputation.append((m[1], m[2] or "", [x.strip().lower() for x in m[4].split(",")], per.get("mdate"), per.get("cdate")))
    for need in ("msg", "sid", "rev"):
        if need not in seen:
            raise RuleError(f"no {need}")
    return r


def parse_rules(text: str, variables: dict[str, str] | None = None, classes: dict[str, int] | None = None, ruleset: str = "", first: int = 0, aliases: dict[str, str] | None = None) -> list[Rule]:
    """All rules of a file's text; comment and blank lines are skipped, a sid met twice is an error."""
    out: list[Rule] = []
    for line in text.splitlines():
        if line.strip() and line[0] not in "#; ":
            out.append(parse_rule(line, variables, classes, first + len(out), ruleset, aliases))
    check_duplicates(out)
    return out


def check_duplicates(rules: Iterable[Rule]) -> None:
    """Raises RuleError where two rules share a sid."""
    seen: set[int] = set()
    for r in rules:
        if r.sid in seen:
            raise RuleError(f"duplicate sid {r.sid}")
        seen.add(r.sid)


def metadata_json(r: Rule) -> str:
    return json.dumps(r.metadata, separators=(",", ":")) if r.metadata else ""
