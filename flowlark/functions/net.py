"""Scalar helpers: addresses, labels, rates, dumps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ipv4_text(ip: Column) -> Column:
    """Dotted quad of an unsigned 32-bit integer."""
    part = lambda n: F.shiftright(ip.cast("long"), n).bitwiseAND(255).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


def ipv6_text(b: Column) -> Column:
    """The shortest form (RFC 5952) of 16 bytes; IPv4-mapped addresses end in a dotted quad."""
    digits = F.lower(F.hex(b))
    whole = F.concat_ws(":", *[F.regexp_replace(F.substring(digits, 4 * i + 1, 4), "^0{1,3}", "") for i in range(8)])
    out = whole
    for n in range(2, 9):  # the longest run of zero groups goes, the first of equal ones: so the longest is asked for first
        run = rf"(?:^|:)0(?::0){{{n - 1}}}(?::|$)"
        out = F.when(whole.rlike(run), F.regexp_replace(whole, rf"^(.*?){run}(.*)$", "$1::$2")).otherwise(out)
    mapped = F.concat(F.lit("::ffff:"), ipv4_text(F.conv(F.substring(digits, 25, 8), 16, 10).cast("long")))
    return F.when(F.substring(digits, 1, 24) == "0" * 20 + "ffff", mapped).otherwise(out)


#: What addresses are in a packets table: IPv4 as unsigned integers, or 4 or 16 bytes.
NUMBER, BYTES = "bigint", "binary"


def address_kind(rows: DataFrame, column: str) -> str:
    return dict(rows.dtypes)[column]


def ip_text(ip: Column, kind: str) -> Column:
    if kind != BYTES:
        return ipv4_text(ip)
    four = ipv4_text(F.conv(F.hex(ip), 16, 10).cast("long"))
    return F.when(F.octet_length(ip) == 4, four).when(F.octet_length(ip) == 16, ipv6_text(ip))


def mac_text(b: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(b)), "(..)(?!$)", "$1:")


def flags_text(flags: Column) -> Column:
    """SYN, ACK, FIN, RST, PSH, URG, in this order."""
    named = F.array(*[F.when(flags.bitwiseAND(bit) != 0, name) for bit, name in ((2, "SYN"), (16, "ACK"), (1, "FIN"), (4, "RST"), (8, "PSH"), (32, "URG"))])
    return F.concat_ws(",", F.array_compact(named))


def protocol_text(proto: Column) -> Column:
    return F.when(proto == 6, "tcp").when(proto == 17, "udp").otherwise(F.concat(F.lit("proto("), proto.cast("string"), F.lit(")")))


def endpoint_text(ip: Column, port: Column, kind: str = NUMBER) -> Column:
    """address:port, with an IPv6 address in brackets."""
    text = ip_text(ip, kind)
    if kind == BYTES:
        text = F.when(F.octet_length(ip) == 16, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    return F.concat(text, F.lit(":"), port.cast("string"))


def mbps(octets: Column, seconds: Column) -> Column:
    return octets * 8 / F.greatest(seconds, F.lit(0.001)) / 1e6


def pps(count: Column, seconds: Column) -> Column:
    return count / F.greatest(seconds, F.lit(0.001))


def clock_text(ts_us: Column) -> Column:
    """HH:MM:SS.micros in UTC."""
    day = F.pmod(ts_us, F.lit(86_400_000_000))
    sec = F.floor(day / 1_000_000)
    return F.format_string("%02d:%02d:%02d.%06d", F.floor(sec / 3600), F.floor(sec / 60) % 60, sec % 60, day % 1_000_000)


def fixed(value: Column, digits: int) -> Column:
    """A double with so many decimals, as C's printf has it: its exact binary value rounded, ties to even.

    format_string rounds up the ties of the shortest decimal that stands for the double, so it needs a batch function.
    """

    def batch(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f"{x:.{digits}f}" for x in v.to_pylist()], pa.string())

    return F.arrow_udf(batch, "string")(value.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)


def prometheus_label(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def stable_shard(key: Column, shards: int) -> Column:
    """A shard that both directions of a flow share, given its canonical key."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def frame_shard(src: Column, src_port: Column, dst: Column, dst_port: Column, proto: Column, data: Column, known: Column, shards: int) -> Column:
    """The shard of any frame: by both ends where there are addresses (no ports: 0), else by all bytes; 0 if the link type is not known."""
    end = lambda a, p: F.struct(a.alias("ip"), F.coalesce(p.cast("long"), F.lit(0).cast("long")).alias("port"))
    a, b = end(src, src_port), end(dst, dst_port)
    ends = stable_shard(F.struct(proto.alias("proto"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")), shards)
    return F.when(~known, 0).when(src.isNull() | dst.isNull(), stable_shard(data, shards)).otherwise(ends)


def hex_dump(data: Column) -> Column:
    """Sixteen bytes a line: offset, hex with a gap after eight, and printable ASCII."""
    n = F.octet_length(data)

    def line(off: Column) -> Column:
        chunk = F.substring(data, off + 1, F.lit(16))
        pairs = F.regexp_replace(F.lower(F.hex(chunk)), "(..)", "$1 ")
        left, right = F.rpad(F.substring(pairs, 1, 24), 24, " "), F.rpad(F.substring(pairs, 25, 24), 24, " ")
        text = F.regexp_replace(F.decode(chunk, "ISO-8859-1"), "[^\\x20-\\x7e]", ".")
        return F.concat(F.lower(F.lpad(F.hex(off), 4, "0")), F.lit("  "), left, F.lit(" "), right, F.lit(" |"), text, F.lit("|"))

    offsets = F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)).cast("long"), F.lit(16).cast("long"))
    return F.when(n > 0, F.array_join(F.transform(offsets, line), "\n")).otherwise("")
