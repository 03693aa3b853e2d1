"""Snort rules: parsed on the driver, compiled to signatures, translated to Sigma."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field
from pathlib import Path

from .config import SignatureCfg

#: A port range wider than this constrains nothing.
WIDEST_RANGE = 64
# What a class type says about severity and technique.
HIGH_CLASSES = {"trojan-activity", "malware", "attempted-dos", "suspicious-login", "successful-admin"}
CLASS_TECHNIQUES = {
    "trojan-activity": "T1071",
    "malware": "T1071",
    "suspicious-login": "T1110",
    "attempted-admin": "T1190",
    "successful-admin": "T1190",
    "attempted-dos": "T1499",
    "policy-violation": "T1568",
}
PROTOCOLS = {6: "tcp", 17: "udp", 1: "icmp", 58: "icmp"}


def decode_content(text: str) -> bytes:
    """Literal bytes, with groups of hexadecimal bytes between bars; bad ones are skipped."""
    out = bytearray()
    for i, part in enumerate(text.encode().split(b"|")):
        if i % 2 == 0:
            out += part
            continue
        for word in part.split():
            if re.fullmatch(rb"\+?[0-9a-fA-F]+", word) and int(word, 16) < 256:
                out.append(int(word, 16))
    return bytes(out)


def _number(text: str, most: int = 2**64 - 1) -> int | None:
    text = text.strip()
    return int(text) if re.fullmatch(r"\+?[0-9]+", text) and int(text) <= most else None


class Variables:
    """`$NAME` to networks; the dollar sign is optional when set, and `any` is dropped."""

    def __init__(self, values: dict[str, str] | None = None):
        self.nets: dict[str, list[str]] = {}
        for name, value in (values or {}).items():
            self.set(name, value)

    def set(self, name: str, value: str) -> None:
        self.nets[name.lstrip("$")] = [n for part in value.strip("[] ").split(",") if (n := _net(part))]

    def resolve(self, token: str) -> list[str] | None:
        return self.nets.get(token[1:]) if token.startswith("$") else None


def _net(token: str) -> str | None:
    try:
        return str(ipaddress.ip_network(token.strip(), strict=False))
    except ValueError:
        return None


def parse_nets(token: str, variables: Variables) -> list[str] | None:
    """Networks of a host token; None is any, and so is what can't be read."""
    token = token.strip()
    if token.lower() == "any":
        return None
    if (found := variables.resolve(token)) is not None:
        return found or None
    nets: list[str] = []
    for part in (p.strip() for p in token.strip("[]").split(",")):
        if (found := variables.resolve(part)) is not None:
            nets += found
        elif n := _net(part):
            nets.append(n)
    return nets or None


def parse_ports(token: str) -> list[tuple[int, int]] | None:
    """Inclusive ranges of a port token; None is any, and so is what can't be read."""
    if token.strip().lower() == "any":
        return None
    ranges = []
    for part in (p.strip() for p in token.strip().strip("[]").split(",")):
        low, colon, high = part.partition(":")
        if colon:
            a, b = _number(low, 65535), _number(high, 65535)
            ranges.append(tuple(sorted((0 if a is None else a, 65535 if b is None else b))))
        elif (n := _number(part, 65535)) is not None:
            ranges.append((n, n))
    return ranges or None


@dataclass
class Content:
    raw: str
    depth: int | None = None
    offset: int | None = None
    nocase: bool = False


@dataclass
class SnortRule:
    action: str
    proto: str
    src: str
    src_nets: list[str] | None
    src_ports: list[tuple[int, int]] | None
    dst: str
    dst_nets: list[str] | None
    dst_ports: list[tuple[int, int]] | None
    msg: str = ""
    sid: int = 0
    rev: int = 0
    flow: list[str] = field(default_factory=list)
    contents: list[Content] = field(default_factory=list)
    classtype: str | None = None
    references: list[tuple[str, str]] = field(default_factory=list)
    pcre: bool = False
    flowbits: bool = False

    @property
    def unsupported(self) -> str | None:
        """Why the rule can't be enforced: state or expressions without any content."""
        if self.contents or not (self.pcre or self.flowbits):
            return None
        return "flowbits state" if self.flowbits else "pcre-only"

    def direction(self) -> str | None:
        """By the names of the variables, as written."""
        src, dst = self.src.upper(), self.dst.upper()
        if "HOME" not in src and "HOME" in dst:
            return "in"
        if "HOME" in src and ("EXTERNAL" in dst or dst == "ANY"):
            return "out"
        return None

    def ports(self) -> list[int]:
        ranges = [r for rs in (self.src_ports, self.dst_ports) for r in rs or [] if r[1] - r[0] <= WIDEST_RANGE]
        return sorted({p for a, b in ranges for p in range(a, b + 1)})

    @property
    def severity(self) -> str:
        return "high" if self.classtype in HIGH_CLASSES else "medium"

    def techniques(self) -> list[str]:
        found = [m[1] for kind, value in self.references if kind == "url" and "attack.mitre.org/techniques/" in value and (m := re.search(r"techniques/([A-Za-z0-9.]+)", value))]
        return found or ([CLASS_TECHNIQUES[self.classtype]] if self.classtype in CLASS_TECHNIQUES else [])

    def signature(self) -> SignatureCfg | None:
        """The rule as a signature, or None if it can't be enforced or would match everything."""
        content = self.contents[0] if self.contents else None
        if self.unsupported or not (content or self.ports() or self.src_nets or self.direction()):
            return None
        return SignatureCfg(
            name=f"snort-{self.sid}", protocol=self.proto, direction=self.direction(), ports=self.ports(), peer_cidr=list(self.src_nets or []), severity=self.severity,
            content=content.raw if content else None, nocase=bool(content and content.nocase), depth=content.depth if content else None,
            offset=content.offset if content else None, msg=self.msg, sid=self.sid,
        )


def _options(text: str) -> list[str]:
    """Pieces between semicolons that stand outside double quotes."""
    return [m.strip() for m in re.findall(r'(?:"[^"]*(?:"|$)|[^;"])+', text) if m.strip()]


def _quoted(text: str) -> str:
    m = re.search(r'"([^"]*)"', text)
    return m[1] if m else text.lstrip(":").strip()


def _content(value: str) -> Content | None:
    m = re.search(r'"([^"]*)"(.*)', value, re.S)
    if not m:
        return None
    out = Content(m[1])
    for word in (w.strip() for w in m[2].split(",")):
        if word.lower() == "nocase":
            out.nocase = True
        for name in ("depth", "offset"):
            if word.startswith(name):
                setattr(out, name, _number(word[len(name) :]))
    return out


def parse_line(line: str, variables: Variables | None = None) -> SnortRule | None:
    """A rule, or None for comments, settings and what is no rule."""
    variables = variables or Variables()
    line = line.strip()
    head, bracket, body = line.partition("(")
    words = head.split()
    arrows = [i for i, w in enumerate(words) if w in ("->", "<>", "<-")]
    if line.startswith("#") or re.match(r"(var|config|include) ", line, re.I) or not bracket or len(words) < 4 or not arrows:
        return None
    at = arrows[0]
    if at < 2 or len(words) < at + 3:
        return None
    number = _number(words[1], 255)
    proto = words[1] if words[1] in ("tcp", "udp", "icmp") else PROTOCOLS.get(number, str(number or 0))
    src, sport, dst, dport = words[at - 2], words[at - 1], words[at + 1], words[at + 2]
    rule = SnortRule(words[0].lower(), proto, src, parse_nets(src, variables), parse_ports(sport), dst, parse_nets(dst, variables), parse_ports(dport))
    for option in _options(body.strip().removesuffix(")")):
        name, _, value = option.partition(":")
        name, last = name.strip().lower(), rule.contents[-1] if rule.contents else None
        if name == "msg":
            rule.msg = _quoted(value)
        elif name in ("sid", "rev"):
            setattr(rule, name, _number(value.strip().strip('"'), 2**32 - 1) or 0)
        elif name == "flow":
            rule.flow = [x.strip().lower() for x in value.split(",")]
        elif name == "content":
            if c := _content(value):
                rule.contents.append(c)
        elif name == "nocase" and last:
            last.nocase = True
        elif name in ("depth", "offset") and last:
            setattr(last, name, _number(value))
        elif name in ("pcre", "flowbits"):
            setattr(rule, name, True)
        elif name == "classtype":
            rule.classtype = value.strip()
        elif name == "reference":
            kind, _, target = value.partition(",")
            rule.references.append((kind.strip(), target.strip()))
    return rule


def parse(text: str, variables: Variables | None = None) -> list[SnortRule]:
    return [r for line in text.splitlines() if (r := parse_line(line, variables))]


def load(path: str, variables: Variables | None = None) -> list[SnortRule]:
    return parse(Path(path).read_text(), variables)


def signatures(text: str, variables: Variables | None = None) -> list[SignatureCfg]:
    return [s for r in parse(text, variables) if (s := r.signature())]
