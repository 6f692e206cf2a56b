"""Refresh times, classes, ladders and priorities, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
LEAST, FIRST, MOST = 5 * MINUTE, DAY, 180 * DAY
#: Waits after the first, second, ... failure in a row (fixed values).
LADDER = (60_000, 300_000, 1_500_000, 7_200_000, 43_200_000, 86_400_000)
CLASSES = ((HOUR, "realtime"), (6 * HOUR, "hourly"), (3 * DAY, "daily"), (30 * DAY, "weekly"))


def refresh_interval_ms(fetches: Column, changes: Column, observed_ms: Column) -> Column:
    """When to look again: half the mean time between changes, as n looks with x changes over the observed time tell it, within bounds. The first change is the first sight of the page and does not count."""
    x = F.greatest(changes - 1, F.lit(0)).cast("double")
    n = fetches.cast("double")
    rate = -F.ln((n - x + 0.5) / (n + 0.5)) * n / observed_ms
    guess = F.when((observed_ms <= 0) | (fetches < 2), F.lit(float(FIRST))).when(x == 0, 2.0 * observed_ms).otherwise(0.5 / rate)
    return F.floor(F.least(F.greatest(guess, F.lit(float(LEAST))), F.lit(float(MOST)))).cast("long")


def refresh_class(interval_ms: Column) -> Column:
    out = F.lit("dormant")
    for bound, name in reversed(CLASSES):
        out = F.when(interval_ms < bound, name).otherwise(out)
    return F.when(interval_ms.isNull(), "discovery").otherwise(out)


def retry_ms(streak: Column) -> Column:
    steps = F.array(*[F.lit(x).cast("long") for x in LADDER])
    return F.element_at(steps, F.least(F.greatest(streak, F.lit(1)), F.lit(len(LADDER))).cast("int"))


def depth_score(depth: Column) -> Column:
    return F.floor(F.lit(60_000) / (depth + 1)).cast("long")


def quota(batch: Column | int, share_percent: Column) -> Column:
    """A class's part of a batch, at least 1 where its share is more than nothing."""
    part = F.floor(F.lit(batch) * share_percent / 100).cast("long") if isinstance(batch, int) else F.floor(batch * share_percent / 100).cast("long")
    return F.when(share_percent > 0, F.greatest(part, F.lit(1).cast("long"))).otherwise(0)
