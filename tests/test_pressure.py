"""Ladders against a sequential fold."""

import random

import pytest
from gristmill.operators import pressure
from pyspark.sql import functions as F


class Rung:
    """The rule as it is told: up at once, down a rung after an unbroken hold, which then starts again."""

    def __init__(self):
        self.level, self.easing = 0, None

    def settle(self, demand, now, hold):
        if demand > self.level:
            self.level, self.easing = demand, None
        elif demand == self.level:
            self.easing = None
        else:
            if self.easing is None:
                self.easing = now
            if now - self.easing >= hold:
                self.level, self.easing = self.level - 1, now
        return self.level


def ladder(r, n, top):
    t, out = 0, []
    for i in range(n):
        t += r.choice([0, 1, 2, 5, 30, 90])
        out.append((t, i, r.choice([0, 0, 0, 1, top, r.randint(0, top)])))
    return out


@pytest.mark.parametrize("chunk_ms", [1, 40, 100_000])
def test_levels_of_every_order_of_demands(spark, chunk_ms):
    r, rows, want = random.Random(chunk_ms), [], {}
    for key in range(25):
        rung = Rung()
        for t, i, demand in ladder(r, r.randint(1, 60), 4):
            rows.append((key, t, i, demand if demand or r.random() < 0.7 else None))
            want[key, i] = rung.settle(demand, t, 50)
    df = spark.createDataFrame(rows, "k int, at long, id int, demand int").repartition(5)
    got = {(x["k"], x["id"]): x["level"] for x in pressure.settled(df, ["k"], ["at", "id"], "demand", 4, hold_ms=50, chunk_ms=chunk_ms).collect()}
    assert got == want and len(set(want.values())) == 5
    levels = spark.createDataFrame([(k, t, i, want[k, i]) for k, t, i, _ in rows], "k int, at long, id int, level int")
    moved = {(x["k"], x["id"]): (x["before"], x["level"]) for x in pressure.transitions(levels, ["k"], ["at", "id"], "level", chunk_ms=chunk_ms).collect()}
    steps = {(k, i): (want.get((k, i - 1), 0), v) for (k, i), v in want.items()}
    assert moved == {k: v for k, v in steps.items() if v[0] != v[1]}


@pytest.mark.parametrize("chunk_ms", [1, 25, 10_000])
def test_since_when_a_condition_holds(spark, chunk_ms):
    r, rows, want = random.Random(7), [], {}
    for key in range(20):
        since, broken, t = None, False, 0
        for i in range(r.randint(1, 40)):
            t += r.choice([0, 1, 9, 40])
            holds = r.choice([True, True, True, False, None])
            rows.append((key, t, i, holds))
            since = None if not holds else t if since is None else since
            broken |= not holds
            want[key, i] = (since, broken)
    df = spark.createDataFrame(rows, "k int, at long, id int, c boolean")
    got = {(x["k"], x["id"]): (x["since"], x["broken"]) for x in pressure.held_since(df, ["k"], ["at", "id"], F.col("c"), chunk_ms).collect()}
    assert got == want


def test_all_ladders_together(spark):
    r, rows, want, gb = random.Random(3), [], {}, 1 << 30
    for key in range(8):
        disk, cpu, memory, saturated, pressed, t = Rung(), Rung(), Rung(), None, None, 0
        for i in range(60):
            t += r.choice([1000, 20_000, 200_000])
            s = (r.choice([0, 4 * gb, 5 * gb, 17 * gb]), r.choice([0, 1_200_000, 1_200_001, 9_000_000]), r.choice([80, 80, 40, 24, 4]) * gb, r.choice([0, 0, 2000, 2001]), r.random() < 0.7, r.choice([10, 84, 85, 95, 200]), r.choice([100, 100, 0]))
            rows.append((key, t, i, *s))
            demand = max(sum(s[0] > x * gb for x in (4, 8, 16)), sum(s[1] > x * 60_000 for x in (20, 45, 90)), sum(s[2] < x * gb for x in (40, 25, 15, 5)))
            saturated = None if not s[4] else t if saturated is None else saturated
            press = s[3] > 2000 or saturated is not None and t - saturated >= 30_000
            pressed = None if not press else t if pressed is None else pressed
            load = 0 if not press else 2 if t - pressed >= 30_000 else 1
            use = 100 * s[5] // s[6] if s[6] else 0
            want[key, i] = (disk.settle(demand, t, 600_000), cpu.settle(load, t, 600_000), memory.settle((use >= 85) + (use >= 95), t, 600_000))
    df = spark.createDataFrame(rows, "k int, at long, id int, unpublished long, lag_ms long, free long, queue int, saturated boolean, rss long, budget long")
    got = {(x["k"], x["id"]): (x["disk"], x["cpu"], x["memory"]) for x in pressure.ladder_levels(df, ["k"], ["at", "id"], chunk_ms=3_000_000).collect()}
    assert got == want
    assert pressure.ladder_levels(df.limit(0), ["k"], ["at", "id"]).count() == 0


def test_what_rungs_allow(spark):
    rows = [(d, c, m) for d in range(5) for c in range(3) for m in range(3)]
    for x in pressure.allowance(spark.createDataFrame(rows, "disk int, cpu int, memory int")).collect():
        d, c, m = x["disk"], x["cpu"], x["memory"]
        tier = min(1 if d >= 1 else 2, 0 if c >= 1 else 2)
        scale = min(50 if d >= 2 else 100, 0 if d >= 3 else 100, 50 if c >= 2 else 100, 0 if m >= 2 else 100)
        assert (x["max_tier"], x["lease_scale"], x["discovery"], x["community"], x["accepts"], x["seals"], x["evicts"]) == (tier, scale, 15 if d else 35, d < 2, d < 4, d >= 4, m >= 1)
    shares = spark.createDataFrame([(65, 35), (85, 15), (10, 99), (0, 35), (10, 0), (200, 90)], "rest int, percent int")
    assert [r[0] for r in shares.select(pressure.discovery_share(F.col("rest"), F.col("percent"))).collect()] == [35, 15, 190, None, 1, 255]
