"""Flows over a stream of packets with the states and retransmissions that the batch finds.

A flow's state is one row: counts, flags that were seen, last attributes, and for each
direction how far its sequence numbers have reached.  A flow ends when a packet comes more
than the idle time after its last one, or when the watermark passes that time; then its row
is emitted and its state goes.  Packets count in the order of their numbers within a
micro-batch, so the rows do not depend on where a stream of ordered files is cut.

A task holds the narrow rows that a micro-batch has of one flow; ``files_per_batch`` bounds
them.  State lives in RocksDB, so open flows need no room on the heap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewire.functions import packet as P
from tidewire.operators import flows as W
from tidewire.streaming.traffic import timed

SUMS = ("packets", "bytes", "packets_forward", "packets_backward", "bytes_forward", "bytes_backward", "payload_bytes", "retransmissions")
LAST_TEXTS = ("_strong", "a_mac", "b_mac", "dns_name", "http_host", "http_uri", "tls_sni")
LAST_NUMBERS = ("last_ttl", "last_window", "http_status")
SEEN = ("_fins_forward", "_fins_backward", "_acked", "_syn_acked", "_syn")
#: Furthest ends by direction and the timer that is set; -1 for none.
REACHED = ("_end_forward", "_end_backward")

_LONG, _TEXT, _FLAG = T.LongType(), T.StringType(), T.BooleanType()
_STATE = T.StructType(
    [T.StructField(n, _LONG) for n in (*SUMS, "first_us", "last_us")]
    + [T.StructField(n, _TEXT) for n in ("_first", *LAST_TEXTS)]
    + [T.StructField(n, _LONG) for n in LAST_NUMBERS]
    + [T.StructField(n, _FLAG) for n in ("_last_is_reset", *SEEN)]
    + [T.StructField(n, _LONG) for n in (*REACHED, "_timer_ms")]
)
_KEY = T.StructType([T.StructField("a_ip", _TEXT), T.StructField("a_port", T.IntegerType()), T.StructField("b_ip", _TEXT), T.StructField("b_port", T.IntegerType()), T.StructField("proto", _TEXT)])
_OUT = T.StructType(_KEY.fields + [f for f in _STATE.fields if f.name not in (*REACHED, "_timer_ms")])


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful operators of this kind need the RocksDB state store; set it before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _last(values: pd.Series, before):
    """The last value that is there, else the one from before."""
    given = values.to_numpy(dtype=object)[values.notna().to_numpy()]
    return given[-1] if len(given) else before


def fold(state: dict | None, rows: pd.DataFrame) -> dict:
    """A flow's state after more of its packets, which are in order."""
    s = dict(state) if state else {**{n: None for n in _STATE.names}, **dict.fromkeys(SUMS, 0), **dict.fromkeys(SEEN, False), **dict.fromkeys((*REACHED, "_timer_ms"), -1)}
    forward = rows["forward"].to_numpy(dtype=bool)
    size, payload = rows["size"].to_numpy(dtype=np.int64), rows["payload"].to_numpy(dtype=np.int64)
    times = rows["ts_us"].to_numpy(dtype=np.int64)
    s["packets"] += len(rows)
    s["bytes"] += int(size.sum())
    s["payload_bytes"] += int(payload.sum())
    ends = (rows["seq"].to_numpy(dtype=np.int64) + payload) & 0xFFFFFFFF
    sent = rows["tcp"].to_numpy(dtype=bool) & (payload > 0)
    for side, mask in (("forward", forward), ("backward", ~forward)):
        s[f"packets_{side}"] += int(mask.sum())
        s[f"bytes_{side}"] += int(size[mask].sum())
        reached = np.maximum.accumulate(np.concatenate(([s[f"_end_{side}"]], ends[mask & sent])))
        s["retransmissions"] += int((ends[mask & sent] <= reached[:-1]).sum())
        s[f"_end_{side}"] = int(reached[-1])
    s["first_us"] = int(times.min()) if s["first_us"] is None else min(s["first_us"], int(times.min()))
    s["last_us"] = int(times.max()) if s["last_us"] is None else max(s["last_us"], int(times.max()))
    s["_first"] = rows["protocol"].iloc[0] if state is None else s["_first"]
    for n in LAST_TEXTS:
        s[n] = _last(rows[n.lstrip("_")], s[n])
    for n in LAST_NUMBERS:
        value = _last(rows[n], s[n])
        s[n] = None if value is None else int(value)
    closing = _last(rows["closing"], s["_last_is_reset"])
    s["_last_is_reset"] = None if closing is None else bool(closing)
    for n in SEEN:
        s[n] = bool(s[n] or rows[n.lstrip("_")].any())
    return s


class _Flows(StatefulProcessor):
    def __init__(self, idle_tcp: int, idle_other: int):
        self.idle_tcp, self.idle_other = idle_tcp, idle_other

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flow", _STATE)

    def _row(self, key: tuple, s: dict) -> dict:
        return {**dict(zip(_KEY.names, key)), **{n: s[n] for n in _OUT.names if n in s}}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        idle = (self.idle_tcp if key[4] == "tcp" else self.idle_other) * 1_000_000
        given = pd.concat(list(rows), ignore_index=True).sort_values("number", kind="stable", ignore_index=True)
        kept = self.state.get() if self.state.exists() else None
        s = dict(zip(_STATE.names, kept)) if kept is not None else None
        timer = s["_timer_ms"] if s else -1
        times = given["ts_us"].to_numpy(dtype=np.int64)
        start = np.iinfo(np.int64).min // 2 if s is None else s["last_us"]
        before = np.maximum.accumulate(np.concatenate(([start], times)))[:-1]
        fresh = times - before > idle
        if s is None:
            fresh[0] = False
        cuts = [0, *np.flatnonzero(fresh), len(given)]
        ended = []
        for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
            if k:
                ended.append(self._row(key, s))
                s = None
            if high > low:
                s = fold(s, given.iloc[low:high])
        if timer >= 0:
            self.handle.deleteTimer(timer)
        s["_timer_ms"] = (s["last_us"] + idle) // 1000 + 1
        self.handle.registerTimer(s["_timer_ms"])
        self.state.update(tuple(s[n] for n in _STATE.names))
        if ended:
            yield _frame(ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            s = dict(zip(_STATE.names, self.state.get()))
            self.state.clear()
            yield _frame([self._row(key, s)])

    def close(self) -> None:
        pass


def _frame(rows: list[dict]) -> pd.DataFrame:
    """Rows as columns that keep missing numbers missing."""
    kinds = {_LONG: "Int64", _FLAG: "boolean"}
    return pd.DataFrame({f.name: pd.array([r[f.name] for r in rows], dtype=kinds.get(f.dataType, "Int32" if f.dataType == T.IntegerType() else object)) for f in _OUT.fields})


def _narrow(packets: DataFrame) -> DataFrame:
    """What a flow's state takes of each packet; attributes are NULL where a packet does not count for them.

    No name starts with ``_``: such columns come to the processor under other names.
    """
    c, tcp = F.col, F.col("proto") == "tcp"
    some = lambda name: F.nullif(c(name), F.lit(""))
    seen: dict[str, Column] = {
        "acked": P.flag(P.ACK) & ~P.flag(P.SYN),
        "syn_acked": P.flag(P.ACK) & P.flag(P.SYN),
        "syn": P.flag(P.SYN),
    }
    fin = P.flag(P.FIN) & ~P.flag(P.RST) & ~P.flag(P.SYN)
    strong = c("protocol").isin(*W.STRONG) | c("protocol").startswith("TLS")
    return W.keyed(packets).select(
        *W.KEY,
        "event_time",
        "number",
        "ts_us",
        "forward",
        tcp.alias("tcp"),
        c("frame_len").cast("long").alias("size"),
        F.coalesce(c("payload_len"), F.lit(0)).cast("long").alias("payload"),
        F.coalesce(c("seq"), F.lit(0)).cast("long").alias("seq"),
        "protocol",
        F.when(strong, c("protocol")).alias("strong"),
        F.when(c("ttl") > 0, c("ttl")).cast("long").alias("last_ttl"),
        F.when(tcp, c("tcp_window")).cast("long").alias("last_window"),
        F.when(c("forward"), c("src_mac")).alias("a_mac"),
        F.when(~c("forward"), c("src_mac")).alias("b_mac"),
        c("dns_qname").alias("dns_name"),
        some("http_host").alias("http_host"),
        some("http_uri").alias("http_uri"),
        F.when(c("http_status") > 0, c("http_status")).cast("long").alias("http_status"),
        some("tls_sni").alias("tls_sni"),
        F.when(tcp & (P.flag(P.RST) | fin), P.flag(P.RST)).alias("closing"),
        F.coalesce(tcp & fin & c("forward"), F.lit(False)).alias("fins_forward"),
        F.coalesce(tcp & fin & ~c("forward"), F.lit(False)).alias("fins_backward"),
        *[F.coalesce(tcp & v, F.lit(False)).alias(n) for n, v in seen.items()],
    )


def live_flows(packets: DataFrame, late: str = "10 seconds", idle_tcp: int = W.IDLE_TCP, idle_other: int = W.IDLE_OTHER) -> DataFrame:
    """The rows of :func:`tidewire.operators.flows.flows` over a stream, each when its flow has ended.

    Call :func:`use_rocksdb` first.  Packets behind the watermark are left out, as in every
    stateful query; packets without addresses have no flow.
    """
    ended = (
        _narrow(timed(packets, late))
        .groupBy(*W.KEY)
        .transformWithStateInPandas(statefulProcessor=_Flows(idle_tcp, idle_other), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
    )
    told = ended.withColumns({"state": W.state_of(), "application": F.coalesce("_strong", "_first"), "duration_us": F.greatest(F.lit(0), F.col("last_us") - F.col("first_us"))})
    return told.select(*[c for c in told.columns if not c.startswith("_")])
