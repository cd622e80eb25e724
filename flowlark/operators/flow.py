"""The flow table: canonical keys, keyed aggregation, TCP analytics, expiry and eviction.

Every operator takes a packets DataFrame (see sources.packets); packet order is id.
Addresses are IPv4 numbers, or 4 or 16 bytes (see decode.as_packets).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlark.functions.net import NUMBER, address_kind, endpoint_text, ip_text, protocol_text

KEY = ("proto", "a_ip", "a_port", "b_ip", "b_port")
FIN, SYN, RST, ACK = 1, 2, 4, 16
MOD = 1 << 32


def with_key(packets: DataFrame) -> DataFrame:
    """Packets of flows (TCP and UDP, no later fragments) with the direction-less key and dir: 0 is a to b."""
    if "is_fragment" in packets.columns:
        packets = packets.where(~F.coalesce(F.col("is_fragment"), F.lit(False)))
    forth = F.struct(F.col("src_ip").alias("i"), F.col("src_port").alias("p")) <= F.struct(F.col("dst_ip").alias("i"), F.col("dst_port").alias("p"))
    rows = packets.where(F.col("proto").isin(6, 17) & F.col("src_port").isNotNull()).withColumn("dir", F.when(forth, 0).otherwise(1))
    pick = lambda a, b: F.when(F.col("dir") == 0, F.col(a)).otherwise(F.col(b))
    return rows.withColumns({"a_ip": pick("src_ip", "dst_ip"), "a_port": pick("src_port", "dst_port"), "b_ip": pick("dst_ip", "src_ip"), "b_port": pick("dst_port", "src_port")})


def _counts() -> list[Column]:
    there, back = F.col("dir") == 0, F.col("dir") == 1
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("wire_len"))), F.lit(0)).cast("long")
    return [
        F.min_by("ts_us", "id").alias("first_us"), F.max_by("ts_us", "id").alias("last_us"),
        F.count_if(there).alias("packets_a_to_b"), F.count_if(back).alias("packets_b_to_a"), total(there).alias("bytes_a_to_b"), total(back).alias("bytes_b_to_a"),
    ]


def counters(keyed: DataFrame, *extra: str) -> DataFrame:
    """Per flow: first and last packet's time, and packets and bytes by direction; map-side partial aggregation only."""
    return keyed.groupBy(*KEY, *extra).agg(*_counts())


def _duration() -> Column:
    return F.greatest(F.col("last_us") - F.col("first_us"), F.lit(0)) / 1e6


def snapshot(flows: DataFrame) -> DataFrame:
    """Flow counters as exported: text keys, seconds, totals, average bit rate."""
    total = F.col("bytes_a_to_b") + F.col("bytes_b_to_a")
    rate = F.when(_duration() > 0, total * 8 / _duration()).otherwise(0.0)
    kind = address_kind(flows, "a_ip")
    rest = [c for c in flows.columns if c not in (*KEY, "first_us", "last_us", "packets_a_to_b", "packets_b_to_a", "bytes_a_to_b", "bytes_b_to_a")]
    return flows.select(
        protocol_text(F.col("proto")).alias("protocol"), ip_text(F.col("a_ip"), kind).alias("a_ip"), F.col("a_port"), ip_text(F.col("b_ip"), kind).alias("b_ip"), F.col("b_port"),
        (F.col("first_us") / 1e6).alias("first_seen"), (F.col("last_us") / 1e6).alias("last_seen"), _duration().alias("duration_secs"),
        "packets_a_to_b", "packets_b_to_a", "bytes_a_to_b", "bytes_b_to_a", (F.col("packets_a_to_b") + F.col("packets_b_to_a")).alias("packets_total"), total.alias("bytes_total"), F.round(rate, 3).alias("avg_bps"), *rest,
    )


def flow_table(packets: DataFrame) -> DataFrame:
    """All flows, counters only (no TCP analytics)."""
    return snapshot(counters(with_key(packets)))


def _has(bit: int) -> Column:
    return F.col("flags").bitwiseAND(bit) != 0


def tcp_kind() -> Column:
    """R(ST), S(YN), B(oth SYN and ACK), F(IN), A(CK) or null, the first that applies."""
    return F.when(_has(RST), "R").when(_has(SYN) & ~_has(ACK), "S").when(_has(SYN), "B").when(_has(FIN), "F").when(_has(ACK), "A")


def _state_rows(keyed: DataFrame, *extra: str) -> DataFrame:
    """Adds kind and at, the id of the flow's last RST or SYN packet."""
    rows = keyed.withColumn("kind", F.when(F.col("proto") == 6, tcp_kind()))
    return rows.withColumn("at", F.max(F.when(F.col("kind").isin("R", "S", "B"), F.col("id"))).over(Window.partitionBy(*KEY, *extra)))


def _state_sums() -> list[Column]:
    after = F.col("at").isNull() | (F.col("id") > F.col("at"))
    return [
        F.count_if(after & (F.col("kind") == "F")).alias("nf"), F.count_if(after & (F.col("kind") == "A")).alias("nk"),
        F.max_by(F.when(F.col("id") == F.col("at"), F.col("kind")), F.when(F.col("id") == F.col("at"), F.col("id"))).alias("r"),
        F.min_by("dir", F.when(F.col("kind") == "S", F.col("id"))).alias("client_dir"), F.count_if(F.col("kind") == "S").alias("ns"),
    ]


def _state_columns() -> tuple[Column, Column]:
    r = F.col("r")
    state = F.when(F.col("nf") % 2 == 1, "fin_wait").when(F.col("nf") > 0, "closed").when(r == "R", "reset").when(F.col("nk") > 0, "established").when(r == "S", "syn_sent").when(r == "B", "syn_ack").otherwise("unknown")
    client = F.when(F.col("ns") > 0, F.when(F.col("client_dir") == 0, "a_to_b").otherwise("b_to_a"))
    return state.alias("tcp_state"), client.alias("client")


def tcp_state(keyed: DataFrame, *extra: str) -> DataFrame:
    """Per TCP flow: state and client endpoint.

    After the last RST or SYN kind, FINs toggle between fin_wait and closed;
    without one, a plain ACK establishes. So the state follows from the last such
    packet and two counts after it: one window over the flow, one aggregation.
    """
    agg = _state_rows(keyed.where("proto = 6"), *extra).groupBy(*KEY, *extra).agg(*_state_sums())
    return agg.select(*KEY, *extra, *_state_columns())


def _sequence(keyed: DataFrame, *extra: str) -> DataFrame:
    """Packets with seq_len, and seq_end (ue) and ack (ua) unwrapped from 32 bits, relative to the first value of their space; null for UDP."""
    tcp = F.col("proto") == 6
    rows = keyed.withColumn("seq_len", F.when(tcp, F.col("payload_len") + F.when(_has(SYN), 1).otherwise(0) + F.when(_has(FIN), 1).otherwise(0)))
    rows = rows.withColumn("end", (F.col("seq") + F.col("seq_len")) % MOD).withColumn("acked", F.when(tcp & _has(ACK), F.col("ack")))
    whole = Window.partitionBy(*KEY, *extra).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = lambda d: F.first(F.when(F.col("dir") == d, F.when(F.col("seq_len") > 0, F.col("end"))).otherwise(F.col("acked")), ignorenulls=True).over(whole)
    rows = rows.withColumn("base0", base(0)).withColumn("base1", base(1))
    mine = F.when(F.col("dir") == 0, F.col("base0")).otherwise(F.col("base1"))
    theirs = F.when(F.col("dir") == 0, F.col("base1")).otherwise(F.col("base0"))
    unwrap = lambda x, b: (x - b + (1 << 31) + MOD) % MOD - (1 << 31)
    return rows.withColumn("ue", F.when(F.col("seq_len") > 0, unwrap(F.col("end"), mine))).withColumn("ua", unwrap(F.col("acked"), theirs))


def segments(keyed: DataFrame, *extra: str) -> DataFrame:
    """Packets with status advanced, retransmission or out_of_order (null without sequence length).

    All windows share one partitioning and order, so one exchange and one sort.
    """
    before = Window.partitionBy(*KEY, *extra).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = _sequence(keyed, *extra)
    top = lambda d: F.max(F.when(F.col("dir") == d, F.col("ue"))).over(before)
    peer = lambda d: F.last(F.when(F.col("dir") != d, F.col("ua")), ignorenulls=True).over(before)
    rows = rows.withColumns({"top0": top(0), "top1": top(1), "peer0": peer(0), "peer1": peer(1)})
    most = F.when(F.col("dir") == 0, F.col("top0")).otherwise(F.col("top1"))
    peer_ack = F.when(F.col("dir") == 0, F.col("peer0")).otherwise(F.col("peer1"))
    status = F.when(F.col("seq_len") > 0, F.when(most.isNull() | (F.col("ue") > most), "advanced").when(F.col("ue") <= peer_ack, "retransmission").otherwise("out_of_order"))
    return rows.withColumn("status", status)


def _segment_sums() -> list[Column]:
    return [F.count_if(F.col("status") == "retransmission").alias("retransmissions"), F.count_if(F.col("status") == "out_of_order").alias("out_of_order")]


def retransmissions(keyed: DataFrame, *extra: str) -> DataFrame:
    return segments(keyed.where("proto = 6"), *extra).groupBy(*KEY, *extra).agg(*_segment_sums())


FIFO = 128


def rtt_samples(keyed: DataFrame, *extra: str) -> DataFrame:
    """Per sample: key, segment id, ack id, rtt_us. An advanced segment waits in a FIFO of 128 (the oldest goes) for the peer's ack to cover it.

    The FIFO makes this a fold over a flow's packets, streamed in order with that
    much state; flows are spread by key.
    """
    names = [*KEY, *extra]
    rows = segments(keyed.where("proto = 6"), *extra).select(*names, "id", "ts_us", "dir", "ue", "ua", (F.col("status") == "advanced").alias("adv"))
    rows = _dealt(rows.where("ua is not null or adv"), names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(names)]) + ", seg_id long, ack_id long, rtt_us long"

    def run(batches):
        from collections import deque

        at, wait = None, (deque(), deque())
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(len(names))), strict=True))
            out = []
            for r, (i, ts, d, ue, ua, adv) in enumerate(zip(*(b.column(len(names) + j).to_pylist() for j in range(6)), strict=True)):
                if keys[r] != at:
                    at, wait = keys[r], (deque(maxlen=FIFO), deque(maxlen=FIFO))
                if ua is not None:
                    q = wait[1 - d]
                    while q and q[0][0] <= ua:
                        _, seg, sent = q.popleft()
                        out.append((*at, seg, i, max(ts - sent, 0)))
                if adv:
                    wait[d].append((ue, i, ts))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, b.schema.field(i).type if i < len(names) else pa.int64()) for i, c in enumerate(cols)], names=[*names, "seg_id", "ack_id", "rtt_us"])

    return rows.mapInArrow(run, schema)


def rtt(keyed: DataFrame, *extra: str) -> DataFrame:
    """Per flow with samples: last, minimum, moving average (7/8 old, 1/8 new) in ms, and their number.

    rtt_samples() gives a flow's samples in order, one flow after another in the
    task that its key leads to, so that four numbers are all a second fold holds.
    """
    names = [*KEY, *extra]
    samples = rtt_samples(keyed, *extra)
    fields = samples.schema.fields[: len(names)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", rtt_last_ms double, rtt_min_ms double, rtt_ewma_ms double, rtt_samples long"

    def run(batches):
        at, last, least, mean, n, kinds = None, 0.0, 0.0, 0.0, 0, []
        out: list[tuple] = []

        def rows():
            types = [*kinds, pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        for b in batches:
            kinds = [b.schema.field(i).type for i in range(len(names))]
            keys = zip(*(b.column(i).to_pylist() for i in range(len(names))), strict=True)
            for key, us in zip(keys, b.column(len(names) + 2).to_pylist(), strict=True):
                ms = us / 1000
                if key != at:
                    if n:
                        out.append((*at, last, least, mean, n))
                    at, least, mean, n = key, ms, ms, 0
                else:
                    least, mean = min(least, ms), 0.875 * mean + 0.125 * ms
                last, n = ms, n + 1
            if len(out) > 5000:
                yield rows()
                out.clear()
        if n:
            out.append((*at, last, least, mean, n))
        if out:
            yield rows()

    return samples.mapInArrow(run, schema)


def _dealt(rows: DataFrame, names: list[str]) -> DataFrame:
    """Each flow's packets in one task, one flow after another, by id."""
    return rows.repartition(*names).sortWithinPartitions(*names, "id")


def full_table(packets: DataFrame, track_rtt: bool = True, track_retransmissions: bool = True, track_out_of_order: bool = True, generation: str | None = None) -> DataFrame:
    """The flow table with TCP analytics; a feature that is off costs nothing and reports 0 or null. generation: a column that splits flows.

    Counters, state and segments come from one exchange: the windows' partitioning
    is the aggregation's. Round trips are a fold with an exchange of its own.
    """
    extra = () if generation is None else (generation,)
    keyed = with_key(packets)
    rows = _state_rows(keyed, *extra)
    sums = [*_counts(), *_state_sums(), F.max(F.col("proto") == 6).alias("tcp")]
    segmented = track_retransmissions or track_out_of_order
    if segmented:
        rows, sums = segments(rows, *extra), [*sums, *_segment_sums()]
    out = rows.groupBy(*KEY, *extra).agg(*sums)
    state, client = _state_columns()
    out = out.withColumns({"tcp_state": F.when(F.col("tcp"), state), "client": client})
    zero = F.lit(0).cast("long")
    on = lambda name, used: (F.coalesce(name, zero) if used else zero).alias(name)
    if track_rtt:
        out = out.join(rtt(keyed, *extra), [*KEY, *extra], "left")
    times = [F.col(c) if track_rtt else F.lit(None).cast("double").alias(c) for c in ("rtt_last_ms", "rtt_min_ms", "rtt_ewma_ms")]
    first = ["first_us", "last_us", "packets_a_to_b", "packets_b_to_a", "bytes_a_to_b", "bytes_b_to_a"]
    return snapshot(out.select(*KEY, *extra, *first, "tcp_state", "client", on("retransmissions", track_retransmissions), on("out_of_order", track_out_of_order), *times, on("rtt_samples", track_rtt)))


def session_generations(packets: DataFrame, timeout_us: int) -> DataFrame:
    """Keyed packets with generation: a flow is split where its gap exceeds the timeout (0 or less: never). Scales with flows."""
    order = Window.partitionBy(*KEY).orderBy("id")
    gap = F.col("ts_us") - F.lag("ts_us").over(order)
    split = F.when(gap > timeout_us, 1).otherwise(0) if timeout_us > 0 else F.lit(0)
    return with_key(packets).withColumn("split", split).withColumn("generation", F.sum("split").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("split")


def prune_instants(packets: DataFrame, cadence_us: int = 1_000_000) -> DataFrame:
    """p_id, p_us of the packets at which flows are pruned: a second after the last such, backwards time resets the gate.

    A chain through the packets in order: one task streams two columns with one number of state.
    """

    def run(batches):
        gate = 0
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t < gate:
                    gate = t
                elif t - gate >= cadence_us:
                    gate = t
                    out.append((i, t))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["p_id", "p_us"])

    return packets.select("id", "ts_us").repartitionByRange("id").sortWithinPartitions("id").coalesce(1).sortWithinPartitions("id").mapInArrow(run, "p_id long, p_us long")


def exact_generations(packets: DataFrame, timeout_us: int, cadence_us: int = 1_000_000) -> DataFrame:
    """Keyed packets with generation and expired_us: a flow ends at a packet if a prune instant before its next packet is later by more than the timeout.

    The first instant after packet time + timeout is looked up by second: a table
    of one row per capture second holds the instant in it and the next one, so
    the join is on equality. Packet times must not decrease.
    """
    inst = prune_instants(packets, cadence_us).withColumn("s", F.floor(F.col("p_us") / cadence_us))
    span = inst.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    seconds = span.select(F.explode(F.sequence(F.col("lo") - F.lit(timeout_us // cadence_us + 2), F.col("hi"))).alias("k"))
    later = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    # one row a second of capture, seen backwards: what comes next is the last that was seen
    index = seconds.join(inst, seconds["k"] == inst["s"], "left").select("k", F.when(F.col("p_us").isNotNull(), F.struct("p_us", "p_id")).alias("here"))
    index = index.withColumn("next", F.last("here", ignorenulls=True).over(later))
    order = Window.partitionBy(*KEY).orderBy("id")
    rows = with_key(packets).withColumn("next_id", F.lead("id").over(order)).withColumn("due", F.col("ts_us") + timeout_us)
    rows = rows.join(index, F.floor(F.col("due") / cadence_us) == F.col("k"), "left")
    hit = F.when(F.col("here.p_us") > F.col("due"), F.col("here")).otherwise(F.col("next"))
    ends = hit.isNotNull() & (F.col("next_id").isNull() | (hit["p_id"] < F.col("next_id"))) & F.lit(timeout_us > 0)
    rows = rows.withColumn("expired_us", F.when(ends, hit["p_us"]))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("generation", F.coalesce(F.count("expired_us").over(before), F.lit(0)).cast("long")).drop("next_id", "due", "k", "here", "next")


def expired(packets: DataFrame, timeout_us: int) -> DataFrame:
    """Flows that the exact rule expired: ts of the event, reason, and the counters."""
    rows = exact_generations(packets, timeout_us)
    ts = rows.groupBy(*KEY, "generation").agg(F.max("expired_us").alias("expired_us"))
    out = counters(rows, "generation").join(ts, [*KEY, "generation"]).where("expired_us is not null")
    return snapshot(out.withColumn("ts", F.col("expired_us") / 1e6).withColumn("reason", F.lit("timeout")).drop("expired_us"))


def remaining(packets: DataFrame, timeout_us: int) -> DataFrame:
    """Flows still in the table at the end."""
    rows = exact_generations(packets, timeout_us)
    ts = rows.groupBy(*KEY, "generation").agg(F.max("expired_us").alias("expired_us"))
    return snapshot(counters(rows, "generation").join(ts, [*KEY, "generation"]).where("expired_us is null").drop("expired_us"))


def event_schema(address: str) -> str:
    return f"p_id long, ts_us long, reason string, proto int, a_ip {address}, a_port long, b_ip {address}, b_port long, first_us long, last_us long, packets long, bytes long"


def evictions(packets: DataFrame, timeout_us: int, max_flows: int, cadence_us: int = 1_000_000) -> DataFrame:
    """Timeout and eviction events with a cap on flows: at a prune instant, after timeouts, the flows over max_flows last seen longest ago go.

    The cap couples all flows, so this is one fold in packet order with the table
    as state (max_flows plus what a second brings); use expired() where no cap binds.
    p_id is the packet at which the flow goes.
    """
    rows = with_key(packets).select("id", "ts_us", "proto", "a_ip", "a_port", "b_ip", "b_port", "wire_len")
    schema = event_schema(address_kind(rows, "a_ip"))

    def run(batches):
        gate, live = 0, {}
        for b in batches:
            out = []
            for i, t, p, ai, ap, bi, bp, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f = live.setdefault((p, ai, ap, bi, bp), [t, t, 0, 0, i])
                f[1], f[2], f[3], f[4] = t, f[2] + 1, f[3] + n, i
                if t < gate:
                    gate = t
                elif t - gate >= cadence_us:
                    gate = t
                    gone = [(k, "timeout") for k, v in live.items() if timeout_us > 0 and t - v[1] > timeout_us]
                    over = len(live) - len(gone) - max_flows if max_flows > 0 else 0
                    if over > 0:
                        dead = {k for k, _ in gone}
                        gone += [(k, "eviction") for k, _ in sorted(((k, v) for k, v in live.items() if k not in dead), key=lambda x: (x[1][1], x[1][4]))[:over]]
                    for k, why in gone:
                        v = live.pop(k)
                        out.append((i, t, why, *k, *v[:4]))
            if out:
                ip = b.schema.field(3).type
                types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), ip, pa.int64(), ip, *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return rows.repartition(1).sortWithinPartitions("id").mapInArrow(run, schema)


def capped_generations(packets: DataFrame, timeout_us: int, max_flows: int) -> DataFrame:
    """Keyed packets with generation, and live: whether it is still in the table at the end, under a cap on flows.

    The events of evictions() meet the packets by key: a packet's generation is the number of events of its flow before it.
    """
    rows = with_key(packets)
    gone = evictions(packets, timeout_us, max_flows).select(*KEY, F.col("p_id").alias("id"), F.lit(1).alias("ends"))
    both = rows.withColumn("ends", F.lit(0)).unionByName(gone, allowMissingColumns=True)
    order = Window.partitionBy(*KEY).orderBy("id", "ends")
    both = both.withColumn("generation", F.coalesce(F.sum("ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    both = both.withColumn("live", F.col("generation") == F.sum("ends").over(Window.partitionBy(*KEY)))
    return both.where("ends = 0").drop("ends")


def live_packets(packets: DataFrame, timeout_us: int, max_flows: int = 0) -> DataFrame:
    """The packets of the flows that are in the table at the end, without those of the flows' earlier generations.

    The cap binds only if there are more flows than it allows: only then are evictions folded.
    """
    if max_flows > 0 and with_key(packets).select(*KEY).distinct().count() > max_flows:
        return capped_generations(packets, timeout_us, max_flows).where("live").drop("generation", "live", "dir", *KEY[1:])
    if timeout_us <= 0:
        return packets
    rows = exact_generations(packets, timeout_us)
    ended = F.max("expired_us").over(Window.partitionBy(*KEY, "generation"))
    return rows.withColumn("ended", ended).where("ended is null").drop("ended", "expired_us", "generation", "dir", *KEY[1:])


def gone(packets: DataFrame, timeout_us: int, max_flows: int = 0) -> DataFrame:
    """What expired() gives, with the flows that a cap puts out if it binds."""
    if not (max_flows > 0 and with_key(packets).select(*KEY).distinct().count() > max_flows):
        return expired(packets, timeout_us)
    rows = capped_generations(packets, timeout_us, max_flows).where("not live")
    events = evictions(packets, timeout_us, max_flows).select(*KEY, F.row_number().over(Window.partitionBy(*KEY).orderBy("p_id")).cast("long").alias("nth"), (F.col("ts_us") / 1e6).alias("ts"), "reason")
    out = counters(rows, "generation").join(events.withColumn("generation", F.col("nth") - 1).drop("nth"), [*KEY, "generation"])
    return snapshot(out)


def active_flows(packets: DataFrame, timeout_us: int, interval_us: int) -> DataFrame:
    """tick, active_flows: how many flows are in the table at the end of each tick that has a flow's packet (0 or less: no timeout)."""
    tick = lambda c: F.floor(F.col(c) / interval_us).cast("long")
    if timeout_us > 0:
        rows = exact_generations(packets, timeout_us)
    else:
        rows = with_key(packets).withColumns({"generation": F.lit(0).cast("long"), "expired_us": F.lit(None).cast("long")})
    lives = rows.groupBy(*KEY, "generation").agg(F.min("ts_us").alias("born"), F.max("expired_us").alias("died"))
    steps = lives.select(tick("born").alias("tick"), F.lit(1).alias("step")).unionByName(lives.where("died is not null").select(tick("died").alias("tick"), F.lit(-1).alias("step")))
    change = steps.groupBy("tick").agg(F.sum("step").alias("step"))
    # one row a tick
    ticks = rows.select(tick("ts_us").alias("tick")).distinct().withColumn("step", F.lit(0)).unionByName(change).groupBy("tick").agg(F.sum("step").alias("step"))
    return ticks.select("tick", F.sum("step").over(Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("active_flows"))


def flow_text(kind: str = NUMBER) -> Column:
    end = lambda s: endpoint_text(F.col(f"{s}_ip"), F.col(f"{s}_port"), kind)
    return F.concat(protocol_text(F.col("proto")), F.lit(" "), end("a"), F.lit(" <-> "), end("b"))
