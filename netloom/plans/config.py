"""Rule configuration: dataclasses with defaults, strict about keys, and a validation that lists every problem."""

from __future__ import annotations

import difflib
import ipaddress
import tomllib
import warnings
from dataclasses import dataclass, field, fields
from pathlib import Path

# Ports of authentication services, reflectors and backdoors.
AUTH_PORTS = [21, 22, 23, 139, 445, 1433, 3306, 3389, 5900, 5901, 5902, 5903, 5985, 5986]
REFLECTOR_PORTS = [53, 123, 161, 389, 1900, 11211]
BACKDOOR_PORTS = [1234, 1971, 4444, 5005, 5555, 6666, 6667, 6697, 7777, 8080, 8443, 9001, 10000, 12345, 12346, 31337]


@dataclass
class Section:
    enabled: bool = True
    cooldown_s: int = 300
    severity: str = "medium"


@dataclass
class CountCfg(Section):
    threshold: int = 10
    window_s: int = 60


@dataclass
class RateCfg(Section):
    severity: str = "high"
    threshold: int = 5000
    window_s: int = 5


@dataclass
class PortScanCfg(Section):
    min_targets: int = 15
    window_s: int = 30


@dataclass
class BruteForceCfg(Section):
    cooldown_s: int = 600
    severity: str = "high"
    threshold: int = 20
    window_s: int = 60
    ports: list[int] = field(default_factory=lambda: list(AUTH_PORTS))


@dataclass
class SynFloodCfg(Section):
    severity: str = "high"
    threshold: int = 2000
    window_s: int = 5
    max_completion_ratio: float = 0.10


@dataclass
class ReflectionCfg(Section):
    severity: str = "high"
    ports: list[int] = field(default_factory=lambda: list(REFLECTOR_PORTS))
    min_response_bytes: int = 512
    threshold: int = 10
    window_s: int = 10


@dataclass
class DnsTunnelCfg(Section):
    cooldown_s: int = 600
    entropy_threshold: float = 4.0
    qname_len_threshold: int = 60
    label_len_threshold: int = 40
    subdomain_threshold: int = 50
    txt_threshold: int = 100
    window_s: int = 120


@dataclass
class IcmpTunnelCfg(Section):
    cooldown_s: int = 600
    max_payload: int = 1000
    threshold: int = 20
    window_s: int = 60


@dataclass
class BeaconingCfg(Section):
    cooldown_s: int = 3600
    severity: str = "high"
    min_samples: int = 8
    max_jitter_cv: float = 0.15
    window_s: int = 3600
    max_samples: int = 256


@dataclass
class SimpleCfg(Section):
    cooldown_s: int = 3600
    severity: str = "high"
    suppress_after: int | None = None


@dataclass
class PortListCfg(Section):
    cooldown_s: int = 600
    severity: str = "low"
    ports: list[int] = field(default_factory=lambda: list(BACKDOOR_PORTS))


@dataclass
class NewListenerCfg(Section):
    cooldown_s: int = 600
    severity: str = "low"
    min_sources: int = 20
    window_s: int = 120


@dataclass
class SignatureCfg:
    name: str = ""
    enabled: bool = True
    protocol: str | None = None
    direction: str | None = None
    ports: list[int] = field(default_factory=list)
    peer_cidr: list[str] = field(default_factory=list)
    severity: str | None = None
    content: str | None = None
    nocase: bool = False
    depth: int | None = None
    offset: int | None = None
    msg: str | None = None
    sid: int | None = None

    @property
    def label(self) -> str:
        if self.sid is None:
            return self.msg if self.msg is not None else self.name
        return f"sid {self.sid}" + (f": {self.msg}" if self.msg is not None else "")


# Limits that configurations must keep (section, field, least, most).
LIMITS = (
    ("port_scan", "min_targets", 2, None), ("brute_force", "threshold", 2, None), ("syn_flood", "max_completion_ratio", 0, 1),
    ("reflection_amplification", "min_response_bytes", 1, None), ("dns_tunnel", "entropy_threshold", 0, 8), ("icmp_tunnel", "max_payload", 8, None),
    ("beaconing", "min_samples", 3, None), ("beaconing", "max_jitter_cv", 0, 1), ("new_listener", "min_sources", 2, None),
)


@dataclass
class RulesCfg:
    """`[rules.*]`; section names with dashes are the rules' own."""

    max_tracked_keys: int = 200_000
    port_scan: PortScanCfg = field(default_factory=PortScanCfg)
    invalid_tcp_flags: CountCfg = field(default_factory=CountCfg)
    brute_force: BruteForceCfg = field(default_factory=BruteForceCfg)
    syn_flood: SynFloodCfg = field(default_factory=SynFloodCfg)
    udp_flood: RateCfg = field(default_factory=RateCfg)
    icmp_flood: RateCfg = field(default_factory=RateCfg)
    reflection_amplification: ReflectionCfg = field(default_factory=ReflectionCfg)
    dns_tunnel: DnsTunnelCfg = field(default_factory=DnsTunnelCfg)
    icmp_tunnel: IcmpTunnelCfg = field(default_factory=IcmpTunnelCfg)
    beaconing: BeaconingCfg = field(default_factory=BeaconingCfg)
    threat_intel: SimpleCfg = field(default_factory=SimpleCfg)
    suspicious_port: PortListCfg = field(default_factory=PortListCfg)
    new_listener: NewListenerCfg = field(default_factory=NewListenerCfg)
    custom_signature: SimpleCfg = field(default_factory=SimpleCfg)
    signature: list[SignatureCfg] = field(default_factory=list)

    @classmethod
    def from_dict(cls, table: dict) -> RulesCfg:
        """Raises ValueError with every unknown key."""
        problems: list[str] = []

        def fill(kind, values, where):
            known = {f.name: f for f in fields(kind)}
            out = kind()
            for key, value in values.items():
                name = key.replace("-", "_")
                if name not in known or ("_" in key and name in cls.__dataclass_fields__ and where == "rules" and key not in ("max_tracked_keys",)):
                    problems.append(f"{where}: unknown key {key!r}")
                elif name == "signature" and where == "rules":
                    out.signature = [fill(SignatureCfg, v, f"signature #{i}") for i, v in enumerate(value)]
                elif isinstance(value, dict):
                    setattr(out, name, fill(type(getattr(out, name)), value, key))
                else:
                    setattr(out, name, value)
            return out

        cfg = fill(cls, table, "rules")
        if problems:
            raise ValueError("; ".join(problems))
        return cfg

    @classmethod
    def from_toml(cls, text: str) -> RulesCfg:
        table = tomllib.loads(text)
        # a table that looks like a misspelt [rules] is refused, others belong to other parts of a configuration
        if near := [k for k in table if k != "rules" and difflib.get_close_matches(k, ["rules"], 1, 0.6)]:
            raise ValueError(f"unknown table {near[0]!r}; rules stand under [rules]")
        cfg = cls.from_dict(table.get("rules", {}))
        if cfg.max_tracked_keys != cls.max_tracked_keys:
            warnings.warn("max_tracked_keys has no effect: state ends by time, no live key is dropped", stacklevel=2)
        if problems := cfg.validate():
            raise ValueError("; ".join(problems))
        return cfg

    @classmethod
    def load(cls, path: str) -> RulesCfg:
        return cls.from_toml(Path(path).read_text())

    def validate(self) -> list[str]:
        """Every problem, in one list: sections in the order of their fields, then single limits, then signatures."""
        sections = [(f.name, getattr(self, f.name)) for f in fields(self) if isinstance(getattr(self, f.name), Section)]
        checks = [("rules", "max_tracked_keys", self.max_tracked_keys, 1000, None)]
        out = []
        for name, section in sections:
            if hasattr(section, "severity") and section.severity not in ("low", "medium", "high"):
                out.append(f"[{name.replace('_', '-')}] severity is {section.severity!r}, not one of low, medium, high")
            if hasattr(section, "ports") and not section.ports:
                out.append(f"[{name.replace('_', '-')}] ports lists no port")
            timed = ("window_s", "cooldown_s") if hasattr(section, "window_s") else ("cooldown_s",) if name == "custom_signature" else ()
            checks += [(name, key, getattr(section, key), 1, None) for key in timed]
        checks += [(name, key, getattr(getattr(self, name), key), least, most) for name, key, least, most in LIMITS]
        checks.append(("beaconing", "max_samples", self.beaconing.max_samples, self.beaconing.min_samples, None))
        for name, key, value, least, most in checks:
            if value < least or (most is not None and value > most):
                out.append(f"[{name.replace('_', '-')}] {key} is {value}, allowed is {least} to {most if most is not None else 'any'}")

        def need(ok: bool, text: str) -> None:
            if not ok:
                out.append(text)

        for i, s in enumerate(self.signature):
            need(bool(s.name.strip()), f"signature {i} has no name")
            need(s.protocol in (None, "tcp", "udp", "icmp"), f"signature {s.name!r} names the unknown protocol {s.protocol!r}")
            need(s.direction in (None, "in", "out"), f"signature {s.name!r} names the unknown direction {s.direction!r}")
            need(bool(s.protocol or s.direction or s.ports or s.peer_cidr), f"signature {s.name!r} would match every packet: it needs a protocol, direction, port or peer")
            for cidr in s.peer_cidr:
                try:
                    ipaddress.ip_network(cidr, strict=False)
                    need("/" in cidr, f"signature {s.name!r} has {cidr!r} among its peers, which is no prefix")
                except ValueError:
                    out.append(f"signature {s.name!r} has {cidr!r} among its peers, which is no prefix")
        return out
