"""Poll changes and visits brought forward against sequential rules, in batch and stream."""

import random

from gristmill.operators import polls
from gristmill.streaming.polls import changes
from test_leases import PROVIDER

SCHEMA = "url string, published_ms long, polled_ms long, place int"


def made(seed, n=400):
    r = random.Random(seed)
    return [(f"u{r.randint(0, 40)}", r.choice([None, 1, 2, 3]), i // 5, i) for i in range(n)] + [(None, 1, 2, n)]


def by_hand(rows):
    seen, out = {}, []
    for url, published, at, _ in sorted((x for x in rows if x[0] is not None), key=lambda x: x[2:]):
        if url not in seen:
            out.append((url, "item", published, at))
        elif published is not None and published != seen[url]:
            out.append((url, "updated", published, at))
        else:
            continue
        seen[url] = published
    return sorted(out, key=str)


def test_changes(spark):
    rows = made(1)
    got = sorted((tuple(x) for x in polls.poll_changes(spark.createDataFrame(rows, SCHEMA), "place").collect()), key=str)
    assert got == by_hand(rows) and {x[1] for x in got} == {"item", "updated"}
    assert polls.poll_changes(spark.createDataFrame([], SCHEMA), "place").count() == 0


def test_stream(spark, tmp_path):
    rows = made(2)
    for at in range(0, len(rows), 100):
        spark.createDataFrame(rows[at : at + 100][::-1], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == by_hand(rows)


def test_bring_forward(spark):
    r = random.Random(3)
    ledger = [(k, r.randint(0, 4), r.choice([None, False, True]), r.choice([None, 0, 50]), r.randint(0, 100)) for k in range(300)]
    found = [(r.randint(0, 330), r.choice([None, 0, 40, 50, 51, 90]), r.choice([None, r.randint(0, 100)])) for _ in range(900)]
    due = {k: d for k, *_, d in ledger}
    rows = {k: x for k, *x in ledger}
    for key, lastmod, at in found:
        if key in rows and lastmod is not None and at is not None:
            state, leased, last, _ = rows[key]
            if not leased and state in (0, 1, 2) and lastmod > (last or 0) and due[key] > at:
                due[key] = at
    want = {(k, x[3], due[k]) for k, x in rows.items() if due[k] != x[3]}
    frames = spark.createDataFrame(ledger, "url_key int, state int, leased boolean, last_fetch_ms long, next_due_ms long"), spark.createDataFrame(found, "url_key int, lastmod_ms long, discovered_ms long")
    got = polls.bring_forward(*frames).collect()
    assert len(got) == len(want) > 30 and {tuple(x) for x in got} == want
