"""Leases of a stream end as those of the same events in a batch."""

import random
from datetime import datetime, timedelta

from gristmill.operators import completion
from gristmill.streaming.leases import ended_leases

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = datetime(2024, 1, 1)


def run(spark, tmp_path, batches, ttl_ms, late="10 seconds"):
    folder, out = tmp_path / "in", tmp_path / "out"
    for rows in batches:
        df = spark.createDataFrame([(k, lease, START + timedelta(milliseconds=at), e) for k, lease, at, e in rows], "url_key long, lease_id string, ts timestamp, event string")
        df.coalesce(1).write.mode("append").parquet(str(folder))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        stream = spark.readStream.schema("url_key long, lease_id string, ts timestamp, event string").option("maxFilesPerTrigger", 1).parquet(str(folder))
        ended_leases(stream, ttl_ms, late).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    base = int((START - datetime(1970, 1, 1)).total_seconds() * 1000)
    return sorted((r["url_key"], r["lease_id"], r["at_ms"] - base, r["end_ms"] - base, r["ending"]) for r in spark.read.parquet(str(out)).collect())


def test_leases_expire_by_the_watermark(spark, tmp_path):
    """Nothing is heard of keys 1 and 2 again: other keys' events move the watermark, and the timers end their leases."""
    batches = [
        [(1, "a", 0, "lease"), (2, "b", 1000, "lease"), (3, "c", 0, "lease")],
        [(3, "c", 5000, "complete"), (2, "other", 6000, "complete"), (4, "d", 20_000, "lease")],
        [(4, "d", 25_000, "release"), (5, "e", 90_000, "lease")],
        [(6, "f", 95_000, "lease"), (5, "g", 96_000, "lease")],
    ]
    got = run(spark, tmp_path, batches, 30_000)
    assert got == [(1, "a", 0, 30_000, "expired"), (2, "b", 1000, 31_000, "expired"), (3, "c", 0, 5000, "completed"), (4, "d", 20_000, 25_000, "released"), (5, "e", 90_000, 96_000, "superseded")]


def test_stream_and_batch_agree(spark, tmp_path):
    r, events = random.Random(1), []
    for key in range(15):
        at = 0
        for n in range(r.randint(1, 6)):
            at += r.choice([3000, 20_000, 50_000])
            lease = f"{key}-{n}"
            events.append((key, lease, at, "lease"))
            if r.random() < 0.7:
                events.append((key, lease, at + r.choice([1000, 15_000, 29_999, 40_000]), r.choice(["complete", "release"])))
    events.sort(key=lambda e: (e[2], e[3]))
    last = events[-1][2]
    batches = [events[i : i + 12] for i in range(0, len(events), 12)] + [[(99, "z", last + 100_000, "lease")], [(98, "y", last + 100_001, "lease")]]
    got = run(spark, tmp_path, batches, 30_000)
    batch = completion.lease_ends(spark.createDataFrame(events, "url_key long, lease_id string, at_ms long, event string"), 30_000, last + 90_000)
    assert got == sorted(map(tuple, batch.collect()))
    assert len({x[-1] for x in got}) == 4
