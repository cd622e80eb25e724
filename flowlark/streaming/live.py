"""Structured Streaming forms of the flow, tick and alert operators. Time is event time; late rows go beyond the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlark.functions.net import BYTES, address_kind, ip_text
from flowlark.operators import anomaly
from flowlark.operators.flow import KEY, with_key


def with_time(packets: DataFrame, delay: str = "10 seconds") -> DataFrame:
    return packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)


def ticks(packets: DataFrame, interval: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Packets and bytes per tumbling window."""
    w = F.window("ts", interval)
    return with_time(packets, delay).groupBy(w).agg(F.count("*").alias("packets"), F.sum("wire_len").cast("long").alias("bytes")).select(F.col("window.start").alias("tick"), "packets", "bytes")


def sessions(packets: DataFrame, timeout: str = "60 seconds", delay: str = "10 seconds") -> DataFrame:
    """Flows closed by a gap of timeout: counters per session window (append mode gives each once, when it has expired)."""
    rows = with_key(with_time(packets, delay))
    there = F.col("dir") == 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("wire_len"))), F.lit(0)).cast("long")
    agg = rows.groupBy(F.session_window("ts", timeout), *KEY).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count_if(there).alias("packets_a_to_b"), F.count_if(~there).alias("packets_b_to_a"), total(there).alias("bytes_a_to_b"), total(~there).alias("bytes_b_to_a"))
    return agg.select(*KEY, "first_us", "last_us", "packets_a_to_b", "packets_b_to_a", "bytes_a_to_b", "bytes_b_to_a")


_STATE = "until long, ts array<long>, a array<long>, b array<long>"
_OUT = "id long, ts_us long, key string, n1 long, n2 long"


def _detector(window_us: int, cooldown_us: int, values: int, fires):
    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        k = anomaly.SlidingKey(window_us, cooldown_us, values)
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            until, ts, a, b = state.get
            for t, *v in zip(ts, a, b, strict=True):
                k.add(t, tuple(v[:values]))
            k.until = until if until >= 0 else None
        out = []
        rows = pd.concat(list(pdfs)).sort_values("id")
        for i, t, a, b in zip(rows["id"], rows["ts_us"], rows["a"], rows["b"], strict=True):
            got = k.add(int(t), (int(a), int(b))[:values])
            if got is not None and fires(got):
                k.fire(int(t))
                out.append((int(i), int(t), ":".join(map(str, key)), *got[-2:]))
        events = list(k.events)
        state.update((k.until if k.until is not None else -1, [e[0] for e in events], [e[1][0] for e in events], [e[1][-1] for e in events]))
        last = max(k.until or 0, (events[-1][0] if events else 0) + k.window)
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=["id", "ts_us", "key", "n1", "n2"])

    return run


def _plain(rows: DataFrame) -> DataFrame:
    """Addresses of bytes as text where they are keys, and as a hash where they are counted (h_src_ip, h_dst_ip)."""
    for c in ("src_ip", "dst_ip"):
        octets = address_kind(rows, c) == BYTES
        rows = rows.withColumn(f"h_{c}", F.xxhash64(c) if octets else F.col(c))
        if octets:
            rows = rows.withColumn(c, ip_text(F.col(c), BYTES))
    return rows


def flood_alerts(packets: DataFrame, window_us: int, syns: int, sources: int, cooldown_us: int, delay: str = "10 seconds") -> DataFrame:
    """SYN flood alerts; state per target: its window and cooldown, dropped once both have passed."""
    rows = _plain(with_time(anomaly.flood_input(packets), delay)).select("id", "ts_us", "ts", "dst_ip", "dst_port", F.col("h_src_ip").alias("a"), F.lit(0).cast("long").alias("b"))
    return rows.groupBy("dst_ip", "dst_port").applyInPandasWithState(_detector(window_us, cooldown_us, 1, lambda g: g[0] >= syns and g[1] >= sources), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def scan_alerts(packets: DataFrame, window_us: int, ports: int, hosts: int, cooldown_us: int, delay: str = "10 seconds") -> DataFrame:
    """Port scan alerts; state per source."""
    rows = _plain(with_time(anomaly.scan_input(packets), delay)).select("id", "ts_us", "ts", "src_ip", F.col("dst_port").cast("long").alias("a"), F.col("h_dst_ip").alias("b"))
    return rows.groupBy("src_ip").applyInPandasWithState(_detector(window_us, cooldown_us, 2, lambda g: g[1] >= ports or g[2] >= hosts), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def write_jsonl(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append a stream's rows to a folder of JSON lines; once stops when what is there has been read."""
    w = stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
