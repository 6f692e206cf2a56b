"""Leases of a stream: state a key with event-time timers, so that a lease ends by the watermark even if nothing more is heard of its key.

The rule is that of ``operators.completion.lease_ends``, for events within the watermark. State is one row a
key with a lease in force; it goes with the lease. Timers and state are the state store's, so a lost
executor resumes from the checkpoint. The store must support timers: set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENDED = "url_key long, lease_id string, at_ms long, end_ms long, ending string"
#: Of events at the same instant, what ends a lease goes before what starts one.
ORDER = {"complete": 0, "release": 1, "lease": 2}


class LeaseProcessor(StatefulProcessor):
    """Emits a row for every lease that ends: completed, released, superseded or expired."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("lease", "lease_id string, at_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.held.get()
        for r in sorted(rows, key=lambda r: (r["at_ms"], ORDER.get(r["event"], 3), r["lease_id"])):
            if held and r["at_ms"] >= held[1] + self.ttl_ms:
                ends = r["at_ms"] == held[1] + self.ttl_ms and (r["event"] == "lease" or r["lease_id"] == held[0])
                if not ends:  # a timer would have told it by now
                    yield self.ended(key, held, held[1] + self.ttl_ms, "expired")
                    held = None
            if r["event"] == "lease":
                if held and held[0] == r["lease_id"]:
                    continue
                if held:
                    yield self.ended(key, held, r["at_ms"], "superseded")
                held = (r["lease_id"], r["at_ms"])
                self.handle.registerTimer(held[1] + self.ttl_ms)
            elif held and held[0] == r["lease_id"] and r["event"] in ORDER:
                yield self.ended(key, held, r["at_ms"], "completed" if r["event"] == "complete" else "released")
                held = None
        if held:
            self.held.update(held)
        else:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        if held and held[1] + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield self.ended(key, held, held[1] + self.ttl_ms, "expired")

    def ended(self, key, held, end_ms: int, how: str) -> Row:
        return Row(url_key=key[0], lease_id=held[0], at_ms=held[1], end_ms=end_ms, ending=how)

    def close(self) -> None:
        pass


def ended_leases(events: DataFrame, ttl_ms: int, late: str) -> DataFrame:
    """The ends of leases of a stream of ``url_key, lease_id, ts, event`` as they become known; ``late`` is how long late events are waited for."""
    rows = events.withWatermark("ts", late).select(F.col("url_key").cast("long").alias("url_key"), "lease_id", "event", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return rows.groupBy("url_key").transformWithState(LeaseProcessor(ttl_ms), ENDED, "append", "EventTime")
