"""A subset of the capture filter language, compiled to a Column over packets.

tcp, udp, icmp, icmp6, ip, ip6; [src|dst] host A, net A/N, port N, portrange N-M,
with tcp or udp in front; less N, greater N; and, or, not (&&, ||, !); parentheses.
"""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(&&|\|\||[()!]|[^\s()!]+)")
_PROTO = {"tcp": 6, "udp": 17, "icmp": 1, "icmp6": 58}
_STOP = {"and", "or", "not", "&&", "||", "!", "(", ")"}


class _Parser:
    def __init__(self, text: str, frames: bool = False) -> None:
        self.frames = frames
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        t = self.peek()
        if t is None:
            raise ValueError("the filter ends too early")
        self.at += 1
        return t

    def any(self) -> Column:
        out = self.all()
        while self.peek() in ("or", "||"):
            self.take()
            out = out | self.all()
        return out

    def all(self) -> Column:
        out = self.one()
        while self.peek() in ("and", "&&"):
            self.take()
            out = out & self.one()
        return out

    def one(self) -> Column:
        t = self.peek()
        if t in ("not", "!"):
            self.take()
            return ~self.one()
        if t == "(":
            self.take()
            out = self.any()
            if self.take() != ")":
                raise ValueError("a parenthesis is not closed")
            return out
        return self.primitive()

    def primitive(self) -> Column:
        # frames without the field that is asked for do not match, so that "not" takes them
        return F.coalesce(self.test(), F.lit(False)) if self.frames else self.test()

    def end(self, side: str, lo, hi) -> Column:
        """Whether the address at a side is between two of the same version."""
        if self.frames:
            c = F.col(f"{side}_addr")
            return (F.octet_length(c) == len(lo.packed)) & c.between(F.lit(bytearray(lo.packed)), F.lit(bytearray(hi.packed)))
        return F.col(f"{side}_ip").between(int(lo), int(hi)) if lo.version == 4 else F.lit(False)

    def test(self) -> Column:
        t, parts, side = self.take(), [], None
        if t in ("ip", "ip6"):
            version = 6 if t == "ip6" else 4  # packets with numbers for addresses are IPv4
            parts.append(F.col("ip_version") == version if self.frames else F.lit(version == 4))
        elif t in _PROTO:
            parts.append(F.col("proto") == _PROTO[t])
        if parts:
            if self.peek() not in ("src", "dst", "host", "net", "port", "portrange"):
                return parts[0]
            t = self.take()
        if t in ("src", "dst"):
            side, t = t, self.take()
        if t in ("less", "greater"):
            n = int(self.take())
            return F.col("wire_len") <= n if t == "less" else F.col("wire_len") >= n
        either = lambda f: f(side) if side else f("src") | f("dst")
        if t == "host":
            a = ipaddress.ip_address(self.take())
            parts.append(either(lambda s: self.end(s, a, a)))
        elif t == "net":
            n = ipaddress.ip_network(self.take(), strict=False)
            parts.append(either(lambda s: self.end(s, n.network_address, n.broadcast_address)))
        elif t in ("port", "portrange"):
            lo, _, hi = self.take().partition("-")
            lo, hi = int(lo), int(hi or lo)
            parts.append(F.col("proto").isin(6, 17) & either(lambda s: F.col(f"{s}_port").between(lo, hi)))
        else:
            raise ValueError(f"unknown word in filter: {t}")
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


def compile_filter(text: str | None, frames: bool = False) -> Column:
    """A predicate over packets, or over parsed frames of any kind (decode.parse); an empty filter takes all."""
    if not text or not text.strip():
        return F.lit(True)
    p = _Parser(text, frames)
    out = p.any()
    if p.peek() is not None:
        raise ValueError(f"unexpected {p.peek()}")
    return out
