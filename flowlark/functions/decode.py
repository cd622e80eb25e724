"""Header decoders over BINARY frames: all layers' offsets and numbers in numpy, a batch at a time; texts as expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from flowlark.functions.net import mac_text


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def cut(data: Column, pos, n) -> Column:
    """n bytes from 0-based pos."""
    return F.substring(data, _c(pos) + 1, _c(n))


def uint(data: Column, pos, n: int) -> Column:
    """Big-endian unsigned integer of n bytes at pos; null past the end."""
    piece = cut(data, pos, n)
    return F.when(F.octet_length(piece) == n, F.conv(F.hex(piece), 16, 10).cast("long"))


def _label(x: Column, names: dict[int, str], other: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in names.items():
        out = out.when(x == k, v)
    return out.otherwise(other)


# Numbers of the formats and their names.
LINK_TYPES = {1: "ethernet", 113: "linux_sll", 0: "null", 108: "loop", 12: "raw_ip", 101: "raw_ip"}
ETHER_TYPES = {0x0800: "IPv4", 0x86DD: "IPv6", 0x0806: "ARP", 0x8100: "VLAN", 0x8847: "MPLS", 0x8848: "MPLS-MC"}
IP_PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 44: "IPv6-Frag", 58: "ICMPv6"}
ICMP_TYPES = {0: "echo_reply", 3: "destination_unreachable", 5: "redirect", 8: "echo_request", 11: "time_exceeded"}
ICMPV6_TYPES = {1: "destination_unreachable", 2: "packet_too_big", 3: "time_exceeded", 4: "parameter_problem", 128: "echo_request", 129: "echo_reply", 133: "router_solicitation", 134: "router_advertisement", 135: "neighbor_solicitation", 136: "neighbor_advertisement", 137: "redirect"}
SLL_PACKET_TYPES = {0: "host", 1: "broadcast", 2: "multicast", 3: "otherhost", 4: "outgoing"}
LINK_BYTES = {1: 14, 113: 16, 0: 4, 108: 4, 12: 0, 101: 0}


def ether_type_text(x: Column) -> Column:
    return _label(x, ETHER_TYPES, F.format_string("Unknown(0x%04x)", x))


def ip_protocol_text(x: Column) -> Column:
    return _label(x, IP_PROTOCOLS, F.format_string("Proto(%d)", x))


# What the batch decoder gives; parse() names the fields in Spark, so that texts nobody asks for are not made.
_OFFSETS = "net_at int, l4_at int, l4_end int, payload_at int, captured int"
_NUMBERS = (
    "link int, ether_type long, sll_type int, sll_size int, loop_family long, tci int, ip_version int, v4_size int, v4_tos int, v4_total int, v4_id int, v4_word int, ttl int, v4_checksum int, "
    "v6_word long, v6_size int, proto int, l4 int, src_port long, dst_port long, seq long, ack long, tcp_size int, flags int, window int, checksum int, urgent int, udp_size int, "
    "icmp_type int, icmp_code int, echo_id int, echo_seq int, payload_len long"
)
_SCHEMA = f"error string, is_fragment boolean, {_OFFSETS}, {_NUMBERS}"
_FIELDS = [x.split() for x in _SCHEMA.split(", ")]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_TCP, _UDP, _ICMP, _ICMP6 = 1, 2, 3, 4
_KINDS = {_TCP: "tcp", _UDP: "udp", _ICMP: "icmp", _ICMP6: "icmpv6"}
#: Option headers of IPv6, the fragment header, the authentication header; at most so many headers are passed.
_OPTIONS, _FRAGMENT, _AUTH, _STEPS = (0, 43, 60, 135, 139, 140), 44, 51, 8


class _Frames:
    """Big-endian integers at positions of each frame of a batch, all frames at once."""

    def __init__(self, data: pa.Array) -> None:
        data = data.cast(pa.large_binary())
        _, offsets, octets = data.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[data.offset : data.offset + len(data) + 1]
        self.start, self.size = ends[:-1], np.diff(ends)
        raw = np.frombuffer(octets, dtype=np.uint8) if octets is not None else np.zeros(0, dtype=np.uint8)
        self.octets = np.concatenate([raw[: ends[-1]], np.zeros(8, dtype=np.uint8)])

    def has(self, at, n: int) -> np.ndarray:
        return (at >= 0) & (at + n <= self.size)

    def get(self, at, n: int) -> np.ndarray:
        """0 where the frame is too short: ask has()."""
        ok = self.has(at, n)
        first = np.where(ok, self.start + at, 0)
        out = np.zeros(len(self.size), dtype=np.int64)
        for k in range(n):
            out = out << 8 | self.octets[first + k]
        return np.where(ok, out, 0)


def _decode(f: _Frames, link: np.ndarray) -> dict[str, tuple]:
    """Each field's values, and where it has one."""
    n = len(link)
    out: dict[str, tuple] = {}
    errors = np.full(n, None, dtype=object)
    size = f.size

    def fail(where: np.ndarray, text) -> None:
        for i in np.flatnonzero(where & fine()):
            errors[i] = text(i)

    def fine() -> np.ndarray:
        return np.equal(errors, None)

    too_short = lambda need, got: lambda i: f"packet too short: need {need[i]} bytes, got {got[i]}"

    # link layer
    need = np.full(n, -1, dtype=np.int64)
    for k, v in LINK_BYTES.items():
        need[link == k] = v
    eth, sll, raw = link == 1, link == 113, (link == 12) | (link == 101)
    fail(need < 0, lambda i: f"invalid header: unsupported link type {link[i]}")
    fail(size < need, too_short(need, size))
    fail(raw & (size == 0), too_short(np.ones(n, dtype=np.int64), size))
    outer = np.where(eth, f.get(np.full(n, 12), 2), np.where(sll, f.get(np.full(n, 14), 2), -1))
    tagged = fine() & (outer == 0x8100)
    fail(tagged & (size < need + 4), too_short(need + 4, size))
    ok = fine()
    typed = ok & (eth | sll)
    ether = np.where(tagged, f.get(need + 2, 2), outer)
    swapped = f.get(np.zeros(n, dtype=np.int64), 4).astype(np.uint32)
    family = np.where(link == 0, swapped.byteswap(), swapped).astype(np.int64)
    out |= {"link": (link, need >= 0), "ether_type": (ether, typed), "loop_family": (family, ok & ((link == 0) | (link == 108))), "tci": (f.get(need, 2), ok & tagged)}
    out |= {"sll_type": (f.get(np.zeros(n, dtype=np.int64), 2), ok & sll), "sll_size": (np.minimum(f.get(np.full(n, 4), 2), 8), ok & sll)}
    at = need + 4 * tagged
    out["net_at"] = (at, ok)

    # network layer
    first = f.get(at, 1)
    seen, nibble, ihl, left = f.has(at, 1), first >> 4, first & 15, size - at
    four = ok & np.where(typed, ether == 0x0800, ~(eth | sll) & seen & (nibble == 4))
    six = ok & ~four & np.where(typed, ether == 0x86DD, ~(eth | sll) & seen & (nibble == 6))
    fail(four & (left < 20), too_short(np.full(n, 20), left))
    fail(four & (nibble != 4), lambda i: "invalid header: IPv4 version")
    fail(four & (ihl < 5), lambda i: "invalid header: IPv4 header length")
    fail(four & (left < ihl * 4), too_short(ihl * 4, left))
    fail(six & (left < 40), too_short(np.full(n, 40), left))
    fail(six & (nibble != 6), lambda i: "invalid header: IPv6 version")
    good = fine()
    four, six = four & good, six & good
    ip = four | six
    word, total, head = f.get(at + 6, 2), f.get(at + 2, 2), ihl * 4
    out |= {"ip_version": (np.where(four, 4, 6), ip), "v4_size": (head, four), "v4_tos": (f.get(at + 1, 1), four), "v4_total": (total, four), "v4_id": (f.get(at + 4, 2), four), "v4_word": (word, four)}
    out |= {"ttl": (f.get(np.where(four, at + 8, at + 7), 1), ip), "v4_checksum": (f.get(at + 10, 2), four), "v6_word": (f.get(at, 4), six), "v6_size": (f.get(at + 4, 2), six)}
    end = np.where(four, np.minimum(size, at + np.maximum(total, head)), np.minimum(size, at + 40 + f.get(at + 4, 2)))
    pos, nxt = np.where(four, at + head, at + 40), f.get(np.where(four, at + 9, at + 6), 1)
    later = four & (word & 0x1FFF > 0)
    on = six.copy()
    for _ in range(_STEPS):
        on &= np.isin(nxt, (*_OPTIONS, _FRAGMENT, _AUTH)) & f.has(pos, 2)
        if not on.any():
            break
        fragment = nxt == _FRAGMENT
        length = f.get(pos + 1, 1)
        step = np.where(fragment, 8, np.where(nxt == _AUTH, (length + 2) * 4, (length + 1) * 8))
        on &= pos + step <= end
        cut_off = on & fragment & (f.get(pos + 2, 2) >> 3 > 0)
        nxt = np.where(cut_off, _FRAGMENT, np.where(on, f.get(pos, 1), nxt))
        pos = np.where(on, pos + step, pos)
        later |= cut_off
        on &= ~cut_off
    out |= {"proto": (nxt, ip), "l4_at": (pos, ip), "l4_end": (end, ip), "is_fragment": (later, ip)}

    # transport layer; a bad header is no error
    room, whole = end - pos, ip & ~later
    words = f.get(pos + 12, 1) >> 4
    tcp = whole & (nxt == 6) & (room >= 20) & (words >= 5) & (room >= words * 4)
    udp, icmp, icmp6 = (whole & (nxt == p) & (room >= 8) for p in (17, 1, 58))
    other = icmp | icmp6
    kind = np.select([tcp, udp, icmp, icmp6], [_TCP, _UDP, _ICMP, _ICMP6], 0)
    what = f.get(pos, 1)
    echo = (icmp & np.isin(what, (0, 8))) | (icmp6 & np.isin(what, (128, 129)))
    udp_size = f.get(pos + 4, 2)
    out |= {"l4": (kind, kind > 0), "src_port": (f.get(pos, 2), tcp | udp), "dst_port": (f.get(pos + 2, 2), tcp | udp), "seq": (f.get(pos + 4, 4), tcp), "ack": (f.get(pos + 8, 4), tcp), "tcp_size": (words * 4, tcp)}
    out |= {"flags": (np.where(tcp, f.get(pos + 13, 1), 0), tcp | udp), "window": (f.get(pos + 14, 2), tcp), "checksum": (f.get(np.select([tcp, udp], [pos + 16, pos + 6], pos + 2), 2), kind > 0), "urgent": (f.get(pos + 18, 2), tcp), "udp_size": (udp_size, udp)}
    out |= {"icmp_type": (what, other), "icmp_code": (f.get(pos + 1, 1), other), "echo_id": (udp_size, echo), "echo_seq": (f.get(pos + 6, 2), echo)}
    body = pos + np.select([tcp, kind > 0], [words * 4, 8], 0)
    stop = np.where(udp, np.minimum(end, pos + np.maximum(udp_size, 8)), end)
    captured = np.maximum(stop - body, 0)
    # sequence lengths count what the IPv4 header says was sent, also if it was not captured
    sent = np.where(tcp & four, np.maximum(total - head - words * 4, 0), captured)
    out |= {"payload_at": (body, ip), "captured": (captured, ip), "payload_len": (sent, kind > 0), "error": (errors, ~good)}
    return out


def _decoder(data: int, link_type: int, passed: list[int]):
    def run(batches):
        for b in batches:
            fields = _decode(_Frames(b.column(data)), b.column(link_type).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64))
            made = [pa.array(v.tolist() if t == "string" else v, _ARROW[t], **({} if t == "string" else {"mask": ~ok})) for (v, ok), t in ((fields[name], t) for name, t in _FIELDS)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in passed), *made], names=[*(b.schema.names[i] for i in passed), *(f"d_{name}" for name, _ in _FIELDS)])

    return run


def parse(frames: DataFrame, data: str = "data", link_type: str = "link_type") -> DataFrame:
    """All layers of each frame; parse_error is set where link or network headers are bad, and then the rest is null.

    A bad transport header leaves l4_kind null, without an error. Offsets and
    numbers of all layers come from one pass over Arrow batches in numpy; texts,
    addresses and payloads are cut out by expressions, as far as they are asked for.
    """
    kept = list(frames.columns)
    made = ", ".join(f"d_{x}" for x in _SCHEMA.split(", "))
    schema = StructType([*frames.schema.fields, *_parse_schema(made)])
    rows = frames.mapInArrow(_decoder(kept.index(data), kept.index(link_type), list(range(len(kept)))), schema)
    c = lambda name: F.col(f"d_{name}")
    d, at = F.col(data), c("net_at")
    eth, sll = c("link") == 1, c("link") == 113
    version, kind, tci, word = c("ip_version"), c("l4"), c("tci"), c("v4_word")
    name = F.when(F.lit(False), F.lit(""))
    for k, v in LINK_TYPES.items():
        name = name.when(c("link") == k, v)
    layer = F.when(F.lit(False), F.lit(""))
    for k, v in _KINDS.items():
        layer = layer.when(kind == k, v)
    linked = at.isNotNull()
    icmp = lambda names: _label(c("icmp_type"), names, F.format_string("type(%d)", c("icmp_type")))
    fields = {
        "link_kind": name, "parse_error": c("error"), "eth_dst": F.when(linked & eth, mac_text(cut(d, 0, 6))), "eth_src": F.when(linked & eth, mac_text(cut(d, 6, 6))), "ether_type": c("ether_type"),
        "sll_packet_type": F.when(linked & sll, _label(c("sll_type"), SLL_PACKET_TYPES, F.format_string("type(%d)", c("sll_type")))), "sll_address": F.when(linked & sll, mac_text(cut(d, 6, c("sll_size")))), "loop_family": c("loop_family"),
        "vlan_priority": F.shiftright(tci, 13), "vlan_dei": F.shiftright(tci, 12).bitwiseAND(1) == 1, "vlan_id": tci.bitwiseAND(0xFFF), "net_at": at, "ip_version": version,
        "ip_header_len": c("v4_size"), "ip_dscp": F.shiftright(c("v4_tos"), 2), "ip_ecn": c("v4_tos").bitwiseAND(3), "ip_total_length": c("v4_total"), "ip_id": c("v4_id"), "ip_df": word.bitwiseAND(0x4000) != 0, "ip_mf": word.bitwiseAND(0x2000) != 0,
        "ip_fragment_offset": word.bitwiseAND(0x1FFF) * 8, "ip_ttl": c("ttl"), "ip_checksum": c("v4_checksum"), "ip6_flow_label": c("v6_word").bitwiseAND(0xFFFFF), "ip6_traffic_class": F.shiftright(c("v6_word"), 20).bitwiseAND(255).cast("int"), "ip6_payload_length": c("v6_size"),
        "src_addr": F.when(version == 4, cut(d, at + 12, 4)).when(version == 6, cut(d, at + 8, 16)), "dst_addr": F.when(version == 4, cut(d, at + 16, 4)).when(version == 6, cut(d, at + 24, 16)),
        "proto": c("proto"), "l4_at": c("l4_at"), "l4_end": c("l4_end"), "is_fragment": c("is_fragment"), "l4_kind": layer, "src_port": c("src_port"), "dst_port": c("dst_port"), "seq": c("seq"), "ack": c("ack"), "tcp_header_len": c("tcp_size"), "flags": c("flags"),
        "window": c("window"), "checksum": c("checksum"), "urgent": c("urgent"), "udp_length": c("udp_size"), "icmp_type": c("icmp_type"), "icmp_code": c("icmp_code"), "echo_id": c("echo_id"), "echo_seq": c("echo_seq"),
        "icmp_text": F.when(kind == _ICMP, icmp(ICMP_TYPES)).when(kind == _ICMP6, icmp(ICMPV6_TYPES)), "payload_at": c("payload_at"), "payload_len": c("payload_len"), "payload": F.when(version.isNotNull(), cut(d, c("payload_at"), c("captured"))),
    }
    return rows.select(*[F.col(f"`{x}`") for x in kept if x not in fields], *[x.alias(k) for k, x in fields.items()])


def _parse_schema(text: str) -> list[StructField]:
    kinds = {"int": IntegerType(), "long": LongType(), "string": StringType(), "boolean": BooleanType()}
    return [StructField(name, kinds[kind]) for name, kind in (x.split() for x in text.split(", "))]


def address_number(addr: Column) -> Column:
    """An IPv4 address as an unsigned integer."""
    return F.when(F.octet_length(addr) == 4, uint(addr, 0, 4))


def as_packets(parsed: DataFrame) -> DataFrame:
    """Parsed TCP and UDP frames in the shape that the flow operators take; addresses are 4 or 16 bytes, which order as the numbers do."""
    rows = parsed.where("l4_kind in ('tcp', 'udp')")
    zero = F.lit(0).cast("long")
    return rows.select("id", "ts_us", "proto", F.col("src_addr").alias("src_ip"), "src_port", F.col("dst_addr").alias("dst_ip"), "dst_port", "flags", F.coalesce("seq", zero).alias("seq"), F.coalesce("ack", zero).alias("ack"), "wire_len", "payload_len", "is_fragment")


def ipv4_checksum_ok(data: Column, at: Column, header_len: Column) -> Column:
    """Whether the header's 16-bit words add up to 0xFFFF in one's complement."""
    words = F.sequence(F.lit(0), (header_len / 2 - 1).cast("int"))
    total = F.aggregate(words, F.lit(0).cast("long"), lambda a, k: a + uint(data, at + k * 2, 2))
    once = F.shiftright(total, 16) + total.bitwiseAND(0xFFFF)
    return F.shiftright(once, 16) + once.bitwiseAND(0xFFFF) == 0xFFFF
