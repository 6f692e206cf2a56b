"""The tier a host is fetched at, learned from its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.storage import durable

#: Tiers, the first ceiling, the time to a probe of a cheaper tier, waits after consecutive blocks and beyond them, blocks that are a refusal.
PLAIN, EMULATED, RENDERED = 1, 2, 3
PROBE_EVERY_MS = 7 * 24 * 60 * 60 * 1000
BACKOFF_MS = (60_000, 300_000, 1_500_000, 7_200_000, 43_200_000)
BACKOFF_FLOOR_MS = 24 * 60 * 60 * 1000
REFUSING_AFTER = 35


def capped_sums(rows: DataFrame, key: str, chunk: Column, order: list[str], step: Column, cap: Column, start: int) -> DataFrame:
    """``rows`` with ``before`` and ``after``: x starts at ``start`` and each row of its key, in order, makes it min(x + step, cap).

    x after row n is S(n) + min(start, cap(k) - S(k) for all k to n), S the running
    sum of steps. Both running values are taken within chunks of time, then over a
    key's chunks, so no task sorts all rows of a key.
    """
    dealt = durable(rows.withColumns({"_chunk": chunk, "_step": step.cast("long"), "_cap": cap.cast("long")}), "chunks")
    within = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = durable(dealt.withColumn("_sum", F.sum("_step").over(within)).withColumn("_low", F.min(F.col("_cap") - F.col("_sum")).over(within)), "within")
    totals = local.groupBy(key, "_chunk").agg(F.sum("_step").alias("_total"), F.min("_low").alias("_least"))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summed = totals.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    low = F.least(F.lit(start).cast("long"), F.min(F.col("_least") - F.col("_base")).over(earlier))
    carried = summed.withColumn("_held", low).select(F.col(key).alias("_key"), F.col("_chunk").alias("_at"), "_base", "_held")
    joined = local.join(carried, (F.col("_key").eqNullSafe(F.col(key))) & (F.col("_at") == F.col("_chunk")))
    after = F.col("_base") + F.col("_sum") + F.least("_held", F.col("_low") - F.col("_base"))
    # Before its own step, a row has what the row before it left.
    last = F.lag("_after").over(Window.partitionBy(key, "_chunk").orderBy(*order))
    out = joined.withColumn("_after", after).withColumn("before", F.coalesce(last, F.col("_base") + F.col("_held")))
    return out.select(*rows.columns, "before", F.col("_after").alias("after"))


def tier_policies(answers: DataFrame, hour_ms: int = 3_600_000) -> DataFrame:
    """The policy of each host after all its ``answers``: ``host_id, at_ms, fetch_id, signal, tier``.

    A block moves a host up a tier, to EMULATED at most until an answer was a shell;
    a shell moves it to RENDERED; a success below its tier brings it down to that.
    Every move of the kind, and every block or shell, starts the clock of the next
    probe. ``tier`` 0, a revalidation, counts as PLAIN. Other signals and null ones
    change nothing, and a host that has no other gets no row. Answers of one instant
    go by ``fetch_id``, which tells a host's rows apart.
    """
    signal, tier = F.col("signal"), F.greatest(F.col("tier"), F.lit(PLAIN))
    known = answers.where(signal.isin("success", "blocked", "shell")).select("host_id", "at_ms", "fetch_id", "signal", tier.alias("tier"))
    when = F.struct("at_ms", "fetch_id")
    facts = known.groupBy("host_id").agg(
        F.min(F.when(signal == "shell", when)).alias("first_shell"), F.max(F.when(signal == "success", F.struct("at_ms", "fetch_id", "tier"))).alias("won"),
    )
    facts = durable(facts, "hosts")
    joined = known.join(facts.select(F.col("host_id").alias("_host"), "first_shell", F.struct("won.at_ms", "won.fetch_id").alias("last_won"), F.col("won").isNotNull().alias("has_won")), F.col("_host").eqNullSafe(F.col("host_id")))
    ceiling = F.when(when >= F.col("first_shell"), RENDERED).otherwise(EMULATED)
    step = F.when(signal == "blocked", 1).when(signal == "shell", RENDERED).otherwise(0)
    cap = F.when(signal == "blocked", ceiling).when(signal == "shell", RENDERED).otherwise(F.col("tier"))
    moved = capped_sums(joined.drop("_host"), "host_id", F.floor(F.col("at_ms") / hour_ms), ["at_ms", "fetch_id"], step, cap, PLAIN)
    clock = (signal != "success") | (F.col("tier") < F.col("before"))
    since = (signal == "blocked") & (~F.col("has_won") | (when > F.col("last_won")))
    out = moved.groupBy("host_id").agg(
        F.max(F.struct("at_ms", "fetch_id", "after"))["after"].cast("int").alias("preferred"), F.count_if(since).alias("blocks"),
        F.coalesce(F.max(F.when(clock, F.col("at_ms"))), F.lit(0)).alias("probe_clock_ms"),
        F.max(signal == "shell").alias("render_required"), F.max(F.struct("last_won", F.when(when == F.col("last_won"), F.col("tier")).alias("t")))["t"].alias("_won"),
    )
    most = F.when(F.col("render_required"), RENDERED).otherwise(EMULATED)
    wait = F.when(F.col("blocks") == 0, 0).otherwise(F.coalesce(F.get(F.array(*map(F.lit, BACKOFF_MS)), (F.col("blocks") - 1).cast("int")), F.lit(BACKOFF_FLOOR_MS)))
    return out.select(
        "host_id", "preferred", most.alias("most"), F.coalesce("_won", F.lit(PLAIN)).cast("int").alias("last_success"), "blocks", "probe_clock_ms", "render_required",
        wait.cast("long").alias("backoff_ms"), ((F.col("blocks") >= REFUSING_AFTER) & (F.col("preferred") >= most)).alias("refusing"),
    )


def starting_tier(now_ms: Column) -> Column:
    """The tier of a policy's next fetch: the last that succeeded once a probe is due, else the preferred one, never over ``most``."""
    due = (F.col("preferred") > F.col("last_success")) & (now_ms >= F.col("probe_clock_ms") + PROBE_EVERY_MS)
    return F.least(F.when(due, F.col("last_success")).otherwise(F.col("preferred")), F.col("most"))
