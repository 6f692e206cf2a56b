"""Crawl state as DataFrame programs: counters, admission, leasing, restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.schedule import CLASSES
from gristmill.sources.crawl_tables import FAILED, FETCHED, PENDING

SCHEDULABLE = (PENDING, FETCHED, FAILED)
EXCLUDED = 4
#: When an excluded row is due.
NEVER = (1 << 63) - 1


def counts(ledger: DataFrame) -> DataFrame:
    """Counters of all states in one pass."""
    states = {"pending": PENDING, "fetched": FETCHED, "failed": FAILED}
    return ledger.agg(F.count("*").alias("urls"), *[F.count_if(F.col("state") == v).alias(k) for k, v in states.items()])


def reconcile(counted: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Where kept counters (``key, n``) and counted ones differ; absent is 0."""
    a, b = counted.withColumnRenamed("n", "counted"), kept.withColumnRenamed("n", "kept")
    both = a.join(b, key, "full_outer").select(key, F.coalesce("counted", F.lit(0)).alias("counted"), F.coalesce("kept", F.lit(0)).alias("kept"))
    return both.where("counted <> kept")


def is_due(now_ms: Column | int) -> Column:
    return F.col("state").isin(*SCHEDULABLE) & (F.col("next_due_ms") <= now_ms)


def with_hosts(ledger: DataFrame, hosts: DataFrame, default_delay_ms: int = 1000) -> DataFrame:
    """The ledger with its hosts' columns; a host that is not known takes the defaults."""
    joined = ledger.join(hosts, "host_id", "left")
    return joined.withColumns({"blocked": F.coalesce("blocked", F.lit(False)), "delay_ms": F.coalesce("delay_ms", F.lit(default_delay_ms).cast("long"))})


def candidates(ledger: DataFrame, hosts: DataFrame, now_ms: int) -> DataFrame:
    """Rows that may be leased: due, on a host that is not blocked. The filter on the ledger runs below the join."""
    return with_hosts(ledger.where(is_due(F.lit(now_ms))), hosts).where("not blocked")


#: High priority first, then the longest due, then by key: a total order.
LEASE_ORDER = (F.desc, "priority"), (F.asc, "next_due_ms"), (F.asc, "url_key")


def lease_order() -> list[Column]:
    return [f(c) for f, c in LEASE_ORDER]


def lease(rows: DataFrame, *, batch: int, max_per_host: int, max_per_pld: int, quotas: dict[int, int]) -> DataFrame:
    """``url_key, host_id, pld_id, refresh_class, rank, slot_ms``: the batch to fetch next.

    Caps are applied host first, then domain. A class takes up to its quota in
    lease order; what is over is spare and fills the batch, also in order. The
    nth row of a host starts n delays later. Windows are keyed by host, domain
    and class; each is cut to its cap by a group limit below its sort, so a host
    with a third of all rows sends max_per_host rows on. The final rank is a top-k.
    """
    over = lambda *keys: Window.partitionBy(*keys).orderBy(*lease_order())
    rows = rows.withColumn("of_host", F.row_number().over(over("host_id"))).where(F.col("of_host") <= max_per_host)
    rows = rows.withColumn("of_pld", F.row_number().over(over("pld_id"))).where(F.col("of_pld") <= max_per_pld)
    # No class can send more rows than the batch holds.
    rows = rows.withColumn("of_class", F.row_number().over(over("refresh_class"))).where(F.col("of_class") <= batch)
    quota = F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(quotas.items()) for x in kv])[F.col("refresh_class")], F.lit(0))
    rows = rows.withColumn("spare", (F.col("of_class") > quota).cast("int"))
    rows = rows.orderBy("spare", *lease_order()).limit(batch)
    rank = F.row_number().over(Window.orderBy("spare", *lease_order()))  # over one batch at most
    slot = (F.row_number().over(over("host_id")) - 1) * F.col("delay_ms")
    return rows.select("url_key", "host_id", "pld_id", "refresh_class", rank.cast("long").alias("rank"), slot.cast("long").alias("slot_ms"))


def admit(found: DataFrame, seen: DataFrame, excluded: DataFrame, trusted: Column) -> DataFrame:
    """Each candidate's verdict: ``seen``, ``excluded``, ``held`` (of an untrusted source) or ``admitted``; the first that fits."""
    rows = found.join(seen.select("url_key").distinct().withColumn("_seen", F.lit(True)), "url_key", "left")
    rows = rows.join(excluded.select("host_id").distinct().withColumn("_out", F.lit(True)), "host_id", "left")
    verdict = F.when(F.col("_seen"), "seen").when(F.col("_out"), "excluded").when(~trusted, "held").otherwise("admitted")
    return rows.withColumn("verdict", verdict).drop("_seen", "_out")


def fresher_than(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """Incoming rows but those for which the host has a row as fresh or fresher. One row a host is compared, its freshest."""
    newest = held.groupBy("host_id").agg(F.max("at_ms").alias("_held_ms"))
    return incoming.join(newest, "host_id", "left").where(F.col("_held_ms").isNull() | (F.col("_held_ms") < F.col("at_ms"))).drop("_held_ms")


def restore(local: DataFrame, spilled: DataFrame, key: str) -> DataFrame:
    """Local rows, and spilled ones with keys that are not local."""
    return local.unionByName(spilled.join(local.select(key), key, "left_anti"))


def page_after(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """Keyset paging: the next rows in key order. The filter reaches the scan, and the limit is a top-k."""
    return rows.where(F.col(key) > after).orderBy(key).limit(size)


def best_answer(fetches: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given total order."""
    w = Window.partitionBy(key).orderBy(*order)
    return fetches.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def changes(fetches: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Per key: fetches, and how many brought another value than the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.lag(value).over(w) != F.col(value)
    return fetches.withColumn("_changed", changed).groupBy(key).agg(F.count("*").alias("fetches"), F.count_if("_changed").alias("changes"))


def apply_blocks(ledger: DataFrame, blocks: DataFrame) -> DataFrame:
    """The ledger after ``blocks`` (``pld_id, lifted_ms``, one row a domain; null: in force), with ``effect``.

    A block excludes the domain's schedulable rows. A lift makes all its excluded
    rows pending and due at once, whatever excluded them, and counts their class
    anew from ``last_fetch_ms`` (null: never fetched). Other rows, and those with
    no domain, stay as they are; their effect is null.
    """
    marks = blocks.select("pld_id", "lifted_ms", F.lit(True).alias("_named"))
    rows = ledger.join(marks, "pld_id", "left")
    out = F.col("_named") & F.col("lifted_ms").isNull() & F.col("state").isin(*SCHEDULABLE)
    back = F.col("lifted_ms").isNotNull() & (F.col("state") == EXCLUDED)
    age = F.col("lifted_ms") - F.col("last_fetch_ms")
    kind = F.lit(len(CLASSES))
    for i, (bound, _) in reversed(list(enumerate(CLASSES))):
        kind = F.when(age < bound, i).otherwise(kind)
    kind = F.when(age.isNull(), len(CLASSES) + 1).otherwise(kind)
    pick = lambda c, gone, again: F.when(out, gone).when(back, again).otherwise(F.col(c))
    changed = {
        "effect": F.when(out, "excluded").when(back, "restored"),
        "state": pick("state", F.lit(EXCLUDED), F.lit(PENDING)),
        "next_due_ms": pick("next_due_ms", F.lit(NEVER), F.col("lifted_ms")),
        "refresh_class": pick("refresh_class", F.col("refresh_class"), kind),
    }
    return rows.withColumns(changed).drop("_named", "lifted_ms")
