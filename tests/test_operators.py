"""State, publishing and folds on small fixtures; streams run to their end."""

import math
import random

import duckdb
from gristmill.operators import folds, publish, state
from gristmill.operators.graph import components
from gristmill.streaming import events as streams
from pyspark.sql import functions as F


def test_lease_caps_and_quotas(spark):
    rows = [(i, i % 3, i % 2, 100 - i, 0, 1 + i % 2, 10) for i in range(60)]
    df = spark.createDataFrame(rows, "url_key long, host_id long, pld_id long, priority long, next_due_ms long, refresh_class int, delay_ms long")
    got = sorted(state.lease(df, batch=10, max_per_host=5, max_per_pld=100, quotas={1: 3, 2: 2}).collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 11))
    assert [sum(r["refresh_class"] == c for r in got[:5]) for c in (1, 2)] == [3, 2]
    assert all(sum(r["host_id"] == h for r in got) <= 5 for h in range(3))
    assert {r["slot_ms"] for r in got if r["host_id"] == 0} == {10 * k for k in range(sum(r["host_id"] == 0 for r in got))}


def test_admit(spark):
    found = spark.createDataFrame([(1, 1, True), (2, 2, True), (3, 3, False), (4, 3, True)], "url_key long, host_id long, ok boolean")
    got = state.admit(found, found.where("url_key = 1"), found.where("host_id = 2"), F.col("ok"))
    assert {r["url_key"]: r["verdict"] for r in got.collect()} == {1: "seen", 2: "excluded", 3: "held", 4: "admitted"}


def test_chain(spark):
    entries = spark.createDataFrame([("2024-01-01", "a", 1, 5), ("2024-01-02", "b", 2, 5), ("2024-01-02", "c", 3, 5), ("2024-01-03", "d", 1, 1)], "day string, path string, rows long, bytes long")
    days = publish.manifests(entries)
    assert publish.verify_chain(days).count() == 0
    broken = days.withColumn("prev", F.when(F.col("day") == "2024-01-03", "x").otherwise(F.col("prev")))
    assert [r["day"] for r in publish.verify_chain(broken).collect()] == ["2024-01-03"]
    after = publish.manifests(publish.retract(entries, entries.where("path in ('b', 'd')")))
    assert {r["day"]: r["status"] for r in publish.changed_days(days, after).collect()} == {"2024-01-02": "changed", "2024-01-03": "removed"}


def test_clamped_products(spark):
    r = random.Random(1)
    rows = [(k, t, r.choice([2.0, 0.9, 0.5, 4.0])) for k in range(3) for t in range(50)]
    df = spark.createDataFrame(rows, "k long, t long, f double")
    got = {r["k"]: r["value"] for r in folds.clamped_products(df, "k", F.floor(F.col("t") / 7), ["t"], F.col("f"), start=100, low=50, high=1000).collect()}
    for k in range(3):
        x = 100.0
        for _, _, f in sorted(row for row in rows if row[0] == k):
            x = min(max(x * f, 50), 1000)
        assert abs(got[k] - x) < 1e-9


def test_plausibility_is_told_before_rounding_and_without_spread(spark):
    """As the SQL of the query implausible tells it, where a key of equal values gives 0 / 0."""
    values = {"a": [0.0] * 29 + [1.0, 6.0], "b": [3.0, 3.0, None], "c": [7.0], "d": [None]}
    rows = [(k, i, x) for k, xs in values.items() for i, x in enumerate(xs)]
    df, con = spark.createDataFrame(rows, "k string, i int, x double"), duckdb.connect()
    con.sql("create table r (k varchar, i int, x double)")
    con.executemany("insert into r values (?, ?, ?)", rows)
    per = "r join (select k, avg(x) as m, stddev_pop(x) as s from r group by k) using (k)"
    far = con.sql(f"select max((x - m) / s) from {per} where s > 0").fetchall()[0][0]
    up, down = math.ceil(far * 1e4) / 1e4, math.floor(far * 1e4) / 1e4
    for beyond in (down, (far + round(far, 4)) / 2, up, 2.5):
        want = con.sql(f"select k, i, case when s > 0 then round((x - m) / s, 4) else 0.0 end from {per} where abs((x - m) / s) > {beyond!r}").fetchall()
        got = folds.plausibility(df, "k", "x", beyond).select("k", "i", "z").collect()
        assert sorted(map(tuple, got)) == sorted((k, i, float(z)) for k, i, z in want) and ("c", 0, 0.0) in want
    assert folds.plausibility(df, "k", "x").count() == len(rows)


def test_arrival_gate(spark):
    r = random.Random(2)
    rows = [(k, i, r.randrange(100)) for k in range(2) for i in range(40)]
    got = folds.arrival_gate(spark.createDataFrame(rows, "k long, i long, t long"), "k", ["t", "i"], "t", 3, 4).collect()
    for k in range(2):
        tat = 0
        for _, i, t in sorted((x for x in rows if x[0] == k), key=lambda x: (x[2], x[1])):
            tat = max(tat, t) + 3 if tat else t + 3
            row = next(g for g in got if (g["k"], g["i"]) == (k, i))
            assert (row["tat_ms"], row["passes"]) == (tat, tat - t <= 12)


def test_latest_wins(spark):
    kept = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k long, at long, v string")
    new = spark.createDataFrame([(1, 6, "c"), (2, 4, "d"), (3, 1, "e")], "k long, at long, v string")
    assert {r["k"]: r["v"] for r in folds.latest_wins(kept, new, "k", "at").collect()} == {1: "c", 2: "b", 3: "e"}


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8)], "u long, v long")
    assert {r["node"]: r["comp"] for r in components(links).collect()} == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}
    assert components(links.limit(0)).count() == 0


def events(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    return batch, spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    batch, stream = events(spark)
    want = {tuple(r) for r in streams.tumbling(batch, "1 day", "event_type").collect()}
    stamped = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(streams.tumbling(stamped, "1 day", "event_type", late="1 hour"), "tumbling", "complete")
    assert {(r["event_type"], r["n"], r["total"]) for r in got.collect()} == {(t, n, total) for _, t, n, total in want}
    first = run(streams.first_sightings(stamped, "user_id", "40 days"), "firsts", "append")
    assert first.count() == batch.select("user_id").distinct().count()
    paced = run(streams.paced(stamped), "paced", "update").collect()
    by_hand = {}
    for r in batch.orderBy("ts", "event_id").collect():
        delay = by_hand.get(r["user_id"], 1000.0)
        by_hand[r["user_id"]] = min(max(delay * (2.0 if r["event_type"] == "error" else 0.9), 1000.0), 60000.0)
    assert {r["user_id"]: round(r["delay_ms"], 6) for r in paced} == {k: round(v, 6) for k, v in by_hand.items()}
    streams.write_new(stream, f"{tmp_path}/out", f"{tmp_path}/check", "event_id").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == batch.count()


def test_blocks_and_lifts(spark):
    from gristmill.operators import state

    day = 86_400_000
    rows = spark.createDataFrame(
        [(1, 7, 0, 5, 2, None), (2, 7, 4, 5, 2, 99 * day), (3, 7, 3, 5, 2, 1), (4, 8, 4, 5, 2, 90 * day), (5, 8, 4, 5, 2, None), (6, 8, 1, 5, 2, 1), (7, None, 0, 5, 2, 1)],
        "url_key int, pld_id int, state int, next_due_ms long, refresh_class int, last_fetch_ms long",
    )
    blocks = spark.createDataFrame([(7, None), (8, 100 * day)], "pld_id int, lifted_ms long")
    out = {r.url_key: (r.effect, r.state, r.next_due_ms, r.refresh_class) for r in state.apply_blocks(rows, blocks).collect()}
    assert out[1] == ("excluded", 4, state.NEVER, 2)
    assert out[2] == (None, 4, 5, 2) and out[3] == (None, 3, 5, 2)
    assert out[4] == ("restored", 0, 100 * day, 3) and out[5] == ("restored", 0, 100 * day, 5)
    assert out[6] == (None, 1, 5, 2) and out[7] == (None, 0, 5, 2)
