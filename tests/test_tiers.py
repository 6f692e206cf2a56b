"""Tier policies against a fold by hand."""

import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import tiers


def by_hand(rows):
    preferred, most, won, blocks, clock, render = 1, 2, 1, 0, 0, False
    for at, _, signal, tier in sorted(rows):
        tier = max(tier, 1)
        if signal == "success":
            blocks, won = 0, tier
            if tier < preferred:
                preferred, clock = tier, at
        elif signal == "blocked":
            blocks, clock, preferred = blocks + 1, at, min(preferred + 1, most) if preferred < 3 else preferred
        else:
            preferred, most, clock, render = 3, 3, at, True
    wait = 0 if not blocks else ([60_000, 300_000, 1_500_000, 7_200_000, 43_200_000] + [86_400_000] * blocks)[blocks - 1]
    return preferred, most, won, blocks, clock, render, wait, blocks >= 35 and preferred >= most


@pytest.mark.parametrize("hour_ms", [1, 40, 10_000])
def test_policies(spark, hour_ms):
    r, rows = random.Random(hour_ms), []
    for host in range(60):
        signals = r.choice([["success", "blocked"], ["success", "blocked", "shell"], ["blocked"], ["success"], ["success"] * 8 + ["blocked"] * 9 + ["shell"]])
        rows += [(host, r.randint(0, 200), host * 1000 + i, r.choice(signals), r.randint(0, 3)) for i in range(r.randint(1, 60))]
    want = {h: by_hand([x[1:] for x in rows if x[0] == h]) for h in range(60)}
    odd = [(900, 5, 1, None, 1), (901, 5, 1, "other", 1), (1, 300, 9, None, 3), (None, 1, 5, "blocked", 1)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows + odd, "host_id int, at_ms long, fetch_id int, signal string, tier int")
    made = tiers.tier_policies(df, hour_ms)
    got = {x[0]: tuple(x)[1:] for x in made.collect()}
    assert got == want | {None: (2, 2, 1, 1, 1, False, 60_000, False)}
    assert {w[0] for w in want.values()} == {1, 2, 3} and any(w[7] for w in want.values())
    starts = {x["host_id"]: x["s"] for x in made.select("host_id", tiers.starting_tier(F.lit(tiers.PROBE_EVERY_MS + 100)).alias("s")).collect()}
    assert all(starts[h] == (w[2] if w[0] > w[2] and w[4] <= 100 else w[0]) for h, w in want.items() if w[2] <= w[1])
    assert tiers.tier_policies(df.limit(0)).count() == 0
