"""Backpressure: ladders that climb at once and step down a rung after a hold, without a fold over all events of a machine.

A ladder looks sequential, but each rung alone is not. "At rung k or above" is true at an
event if the demand is k or more or the ladder is above k; after the last such event it stays
true until the demand has been lower for ``hold_ms`` without a break. So rungs are settled from the
top one down, each by asking since when a condition has held (``held_since``), and that question
composes: what a chunk of time does to the answer is either its own last break or nothing.
Chunks are worked through in parallel and only one row a chunk meets in a window by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.storage import durable

# Fixed values of the ladders.
GB, MINUTE = 1 << 30, 60_000
HOLD_MS = 10 * MINUTE
DISK_UNPUBLISHED, DISK_LAG_MS, DISK_FREE = (4 * GB, 8 * GB, 16 * GB), (20 * MINUTE, 45 * MINUTE, 90 * MINUTE), (40 * GB, 25 * GB, 15 * GB, 5 * GB)
CPU_QUEUE, CPU_SATURATED_MS, CPU_ESCALATE_MS = 2000, 30_000, 30_000
MEMORY_PERCENT = (85, 95)
DISCOVERY_NORMAL, DISCOVERY_UNDER_PRESSURE = 35, 15
TOP = {"disk": 4, "cpu": 2, "memory": 2}


def held_since(rows: DataFrame, key: list[str], order: list[str], condition: Column, chunk_ms: int, resume: Column | None = None) -> DataFrame:
    """The rows with ``since``, the instant at which the unbroken run of ``condition`` began (null where it does not hold), and ``broken``, whether it ever failed before.

    A run begins with its first event, or at ``resume`` of the failing event before it where that is not null. ``before`` tells of the
    event before: its instant and whether the condition held (null at a key's first). ``order`` begins with the
    instant in milliseconds. A null condition does not hold. ``rows`` are read twice and should be a written table.
    """
    at = order[0]
    rows = rows.withColumn("_chunk", F.floor(F.col(at) / chunk_ms)).withColumn("_holds", F.coalesce(condition, F.lit(False)))
    rows = rows.withColumn("_resume", F.lit(None).cast("long") if resume is None else resume.cast("long"))
    inside = Window.partitionBy(*key, "_chunk").orderBy(*order)
    own = F.struct((~F.col("_holds")).alias("broke"), F.when(~F.col("_holds"), F.col("_resume")).otherwise(F.coalesce(F.lag("_resume").over(inside), F.col(at))).alias("start"))
    #: What the last break left, or the run that began after it; null where the chunk has had no break.
    mark = F.when(~F.col("_holds") | ~F.lag("_holds").over(inside), own)
    marked = rows.withColumn("_run", F.last(mark, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    marked = marked.withColumn("before", F.lag(F.struct(F.col(at).alias("at"), F.col("_holds").alias("held"))).over(inside))
    latest = lambda c: F.max_by(c, F.struct(*order))
    chunks = marked.groupBy(*key, "_chunk").agg(latest("_run").alias("_out"), latest(F.struct(F.col(at).alias("at"), F.col("_holds").alias("held"))).alias("_last"), F.min(at).alias("_first"))
    along = Window.partitionBy(*key).orderBy("_chunk")
    # A chunk that ends in a break lets the run begin with the next chunk's first event.
    chunks = chunks.withColumn("_end", F.when(F.col("_out.broke"), F.coalesce("_out.start", F.lead("_first").over(along))).otherwise(F.col("_out.start")))
    carried = F.last("_end", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    start = F.first("_first").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chunks = chunks.select(*key, "_chunk", carried.alias("_carried"), start.alias("_start"), F.lag("_last").over(along).alias("_before"))
    out = marked.join(chunks, [*key, "_chunk"])
    known = F.coalesce("_run.start", "_carried")
    out = out.withColumn("since", F.when(F.col("_holds"), F.coalesce(known, F.col("_start")))).withColumn("broken", F.col("_run").isNotNull() | F.col("_carried").isNotNull())
    return out.withColumn("before", F.coalesce("before", "_before")).drop("_chunk", "_holds", "_resume", "_run", "_carried", "_start", "_before")


def settled(rows: DataFrame, key: list[str], order: list[str], demand: str, top: int, *, hold_ms: int = HOLD_MS, chunk_ms: int = 6 * 60 * MINUTE) -> DataFrame:
    """The rows with ``level``: up to the demand at once, one rung down whenever the demand has been lower for ``hold_ms``.

    A step down starts the hold of the rung below anew, also where the demand is for that rung just then.
    """
    at = F.col(order[0])
    out = rows.withColumns({"level": F.lit(0), "_above": F.lit(False), "_dropped": F.lit(None).cast("long")})
    for rung in range(top, 0, -1):
        strong = F.coalesce(F.col(demand) >= rung, F.lit(False)) | F.col("_above")
        timed = held_since(durable(out, "rung"), key, order, ~strong, chunk_ms, F.col("_dropped"))
        on = strong | F.col("broken") & (at - F.col("since") < hold_ms)
        was_on = F.coalesce(~F.col("before.held") | F.col("broken") & (F.col("before.at") - F.col("since") < hold_ms), F.lit(False))
        dropped = F.when(F.col("broken") & (at - F.col("since") >= hold_ms) & was_on, at)
        out = timed.withColumns({"_dropped": dropped, "_above": on, "level": F.col("level") + on.cast("int")}).drop("since", "broken", "before")
    return out.drop("_above", "_dropped")


def _steps(value: Column, limits: tuple[int, ...], below: bool = False) -> Column:
    """How many limits in a row the value passes."""
    passed = [(value < x if below else value > x).cast("int") for x in limits]
    total = passed[0]
    for p in passed[1:]:
        total = total + p
    return F.coalesce(total, F.lit(0))


def disk_demand(unpublished: Column, lag_ms: Column, free: Column) -> Column:
    return F.greatest(_steps(unpublished, DISK_UNPUBLISHED), _steps(lag_ms, DISK_LAG_MS), _steps(free, DISK_FREE, True))


def memory_demand(rss: Column, budget: Column) -> Column:
    """A budget of zero or null leaves the ladder alone."""
    percent = F.when(budget > 0, F.floor(rss * 100 / budget))
    return F.coalesce((percent >= MEMORY_PERCENT[0]).cast("int") + (percent >= MEMORY_PERCENT[1]).cast("int"), F.lit(0))


def ladder_levels(signals: DataFrame, key: list[str], order: list[str], *, hold_ms: int = HOLD_MS, saturated_ms: int = CPU_SATURATED_MS, escalate_ms: int = CPU_ESCALATE_MS, chunk_ms: int = 6 * 60 * MINUTE) -> DataFrame:
    """``key, order, disk, cpu, memory`` an observation; signals have ``unpublished, lag_ms, free, queue, saturated, rss, budget``.

    The three ladders are settled side by side as one table, keyed by ladder too.
    """
    at = F.col(order[0])
    first = signals.select(*key, *order, disk_demand(F.col("unpublished"), F.col("lag_ms"), F.col("free")).alias("disk"), memory_demand(F.col("rss"), F.col("budget")).alias("memory"), "queue", "saturated")
    timed = held_since(durable(first, "signals"), key, order, F.col("saturated"), chunk_ms)
    pressed = F.coalesce(F.col("queue") > CPU_QUEUE, F.lit(False)) | F.coalesce(at - F.col("since") >= saturated_ms, F.lit(False))
    timed = held_since(durable(timed.withColumn("pressed", pressed).drop("since", "broken", "before"), "pressed"), key, order, F.col("pressed"), chunk_ms)
    cpu = F.when(F.col("pressed"), F.when(at - F.col("since") >= escalate_ms, 2).otherwise(1)).otherwise(0)
    wide = timed.select(*key, *order, "disk", cpu.alias("cpu"), "memory")
    long = wide.select(*key, *order, F.explode(F.create_map(*[x for name in TOP for x in (F.lit(name), F.col(name))])).alias("ladder", "demand"))
    levels = settled(long, [*key, "ladder"], order, "demand", max(TOP.values()), hold_ms=hold_ms, chunk_ms=chunk_ms)
    return levels.groupBy(*key, *order).agg(*[F.max(F.when(F.col("ladder") == name, F.col("level"))).alias(name) for name in TOP])


def allowance(levels: DataFrame) -> DataFrame:
    """What the rungs allow: each field is the most restrictive of the three ladders (``max_tier`` 0 plain, 1 emulated, 2 rendered; rates and shares in percent)."""
    disk, cpu, memory = (F.col(c) for c in TOP)
    scale = F.when((disk >= 3) | (memory >= 2), 0).when((disk >= 2) | (cpu >= 2), 50).otherwise(100)
    return levels.withColumns(
        {
            "max_tier": F.when(cpu >= 1, 0).when(disk >= 1, 1).otherwise(2),
            "discovery": F.when(disk >= 1, DISCOVERY_UNDER_PRESSURE).otherwise(DISCOVERY_NORMAL),
            "lease_scale": scale, "community": disk < 2, "known_plain": disk >= 2, "accepts": disk < 4, "seals": disk >= 4, "evicts": memory >= 1,
        }
    )


def discovery_share(rest: Column, percent: Column) -> Column:
    """The share of the discovery class that makes it so many percent beside the ``rest`` of the shares; at least 1, null where there is no rest."""
    capped = F.least(F.greatest(percent, F.lit(0)), F.lit(95))
    return F.when(rest > 0, F.least(F.greatest(F.ceil(rest * capped / (100 - capped)), F.lit(1)), F.lit(255)).cast("int"))


def transitions(levels: DataFrame, key: list[str], order: list[str], level: str, *, chunk_ms: int = 6 * 60 * MINUTE) -> DataFrame:
    """Observations at which the level changed: ``key, order, before, level``; before the first one it is 0. Read twice, so better a written table."""
    rows = levels.withColumn("_chunk", F.floor(F.col(order[0]) / chunk_ms))
    last = rows.groupBy(*key, "_chunk").agg(F.max_by(level, F.struct(*order)).alias("_last"))
    last = last.select(*key, "_chunk", F.lag("_last").over(Window.partitionBy(*key).orderBy("_chunk")).alias("_carried"))
    before = F.coalesce(F.lag(level).over(Window.partitionBy(*key, "_chunk").orderBy(*order)), F.col("_carried"), F.lit(0))
    return rows.join(last, [*key, "_chunk"]).withColumn("before", before).where(F.col("before") != F.col(level)).select(*key, *order, "before", F.col(level).alias("level"))
