"""Options with their defaults: defaults < TOML file < overrides."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass
class Flow:
    timeout_secs: float = 60.0
    max_flows: int = 100_000


@dataclass
class Stats:
    interval_ms: int = 1000
    top_flows: int = 0


@dataclass
class Analysis:
    rtt: bool = True
    retrans: bool = True
    out_of_order: bool = True
    anomalies: bool = False


@dataclass
class SynFlood:
    window_secs: float = 5.0
    syn_threshold: int = 200
    unique_src_threshold: int = 50
    cooldown_secs: float = 10.0


@dataclass
class PortScan:
    window_secs: float = 10.0
    unique_ports_threshold: int = 25
    unique_hosts_threshold: int = 10
    cooldown_secs: float = 30.0


@dataclass
class Web:
    tick_ms: int = 1000
    top_n: int = 10
    packet_buffer: int = 2000
    sample_rate: int = 1
    payload_bytes: int = 256


@dataclass
class Output:
    write_pcap: str | None = None
    rotate_mb: int | None = None
    keep_files: int | None = None


@dataclass
class Options:
    filter: str = ""
    count: int = 0
    flow: Flow = field(default_factory=Flow)
    stats: Stats = field(default_factory=Stats)
    analysis: Analysis = field(default_factory=Analysis)
    syn_flood: SynFlood = field(default_factory=SynFlood)
    port_scan: PortScan = field(default_factory=PortScan)
    web: Web = field(default_factory=Web)
    output: Output = field(default_factory=Output)

    def validate(self) -> Options:
        if (self.output.rotate_mb is None) != (self.output.keep_files is None):
            raise ValueError("rotate_mb and keep_files go together")
        if self.output.rotate_mb is not None and self.output.write_pcap is None:
            raise ValueError("rotation needs write_pcap")
        if self.web.tick_ms < 16:
            raise ValueError("tick_ms must be at least 16")
        if self.stats.interval_ms <= 0:
            raise ValueError("interval_ms must be positive")
        return self


def _merge(into, values: dict) -> None:
    known = {f.name for f in fields(into)}
    for k, v in values.items():
        if k not in known:
            raise ValueError(f"unknown option {k}")
        if is_dataclass(now := getattr(into, k)):
            _merge(now, v)
        elif v is not None:
            setattr(into, k, v)


def load(path: str | None = None, overrides: dict | None = None) -> Options:
    out = Options()
    if path is not None:
        _merge(out, tomllib.loads(Path(path).read_text()))
    _merge(out, overrides or {})
    return out.validate()


def to_dict(options: Options) -> dict:
    return asdict(options)
