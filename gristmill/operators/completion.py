"""Completions of fetches as change sets, counters maintained from them, and the ends of leases.

An outcome counts only if it is newer than what its row has recorded. So outcomes that are
repeated, or late behind a newer one, change nothing but clear a lease that is still theirs, and a
batch can be run again. Within a batch the outcomes that count are the new maxima of
``finished_ms`` in order of arrival; everything else about a row follows from those by
grouping, so a batch is folded by one window and one grouping, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.schedule import refresh_interval_ms, retry_ms
from gristmill.operators.state import EXCLUDED, NEVER
from gristmill.sources.crawl_tables import FAILED, FETCHED

GONE = 3
#: What a ledger row records, besides its key.
RECORD = ("state", "status", "fetch_count", "change_count", "first_fetch_ms", "last_fetch_ms", "last_change_ms", "content_hash", "fail_streak", "next_due_ms", "lease_id", "lease_until_ms")
_SEEN = ("fetched", "not_modified")


def change_set(ledger: DataFrame, outcomes: DataFrame, refused: DataFrame | None = None, key: str = "url_key") -> DataFrame:
    """``key, before, after``: the rows that a batch changes, with RECORD before and after.

    ``ledger`` has one row a key with ``host_id`` and RECORD; ``outcomes`` have ``key, seq, lease_id, finished_ms, kind,
    status, content_hash``, ``kind`` being fetched, not_modified, failed, gone or excluded and ``seq`` the order of arrival.
    Outcomes for unknown keys, of unknown kinds or without an instant are dropped. Rows of hosts in ``refused`` are excluded
    once something is recorded for them. A row that would not change is left out.
    """
    good = outcomes.where(F.col("finished_ms").isNotNull() & F.col("kind").isin(*_SEEN, "failed", "gone", "excluded"))
    held = ledger.select(key, "host_id", F.struct(*RECORD).alias("before"))
    rows = good.select(key, "seq", F.col("lease_id").alias("by"), "finished_ms", "kind", F.col("status").alias("answer"), F.col("content_hash").alias("hash")).join(held, key)
    arrival = Window.partitionBy(key).orderBy("seq", "finished_ms")
    newest = F.max("finished_ms").over(arrival.rowsBetween(Window.unboundedPreceding, -1))
    known = F.greatest(F.coalesce(newest, F.lit(-NEVER)), F.coalesce("before.last_fetch_ms", F.lit(-NEVER)))
    rows = rows.withColumn("counts", F.col("finished_ms") > known)
    # Of what counts: the content before each full answer, and whether a success follows.
    body = F.when(F.col("counts") & (F.col("kind") == "fetched"), F.struct("hash"))
    last_body = F.coalesce(F.last(body, ignorenulls=True).over(arrival.rowsBetween(Window.unboundedPreceding, -1)), F.struct(F.col("before.content_hash").alias("hash")))
    changed = body.isNotNull() & ~F.col("hash").eqNullSafe(last_body["hash"])
    later = F.count_if(F.col("counts") & F.col("kind").isin(*_SEEN)).over(arrival.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns({"changed": changed, "open": F.col("counts") & (later == 0)})
    counted = lambda c: F.count_if(F.col("counts") & c)
    latest = lambda c, when: F.max_by(c, F.when(when, F.col("finished_ms")))
    kind = F.col("kind")
    batch = rows.groupBy(key, "host_id").agg(
        F.first("before").alias("before"), F.count_if("counts").alias("n"), latest(kind, F.col("counts")).alias("kind"), latest(F.struct(F.when(kind == "failed", F.coalesce("answer", F.lit(0))).otherwise(F.col("answer")).alias("status")), F.col("counts") & (kind != "excluded")).alias("answer"),
        F.max(F.when(F.col("counts"), F.col("finished_ms"))).alias("at"), F.min(F.when(F.col("counts") & kind.isin(*_SEEN), F.col("finished_ms"))).alias("first_at"),
        counted(kind.isin(*_SEEN)).alias("seen"), F.count_if("changed").alias("changes"), F.max(F.when(F.col("changed"), F.col("finished_ms"))).alias("changed_at"),
        counted(kind == "fetched").alias("bodies"), latest(F.struct("hash"), F.col("counts") & (kind == "fetched")).alias("body"),
        F.count_if(F.col("open") & (kind == "failed")).alias("failures"), F.collect_set("by").alias("by"),
    )
    if refused is None:
        batch = batch.withColumn("refused", F.lit(False))
    else:
        batch = batch.join(refused.select("host_id").distinct().withColumn("refused", F.lit(True)), "host_id", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))
    b = lambda c: F.col(f"before.{c}")
    any_, kind = F.col("n") > 0, F.col("kind")
    fetches, changes = F.coalesce(b("fetch_count"), F.lit(0)) + F.col("seen"), F.coalesce(b("change_count"), F.lit(0)) + F.col("changes")
    first = F.coalesce(b("first_fetch_ms"), F.col("first_at"))
    streak = F.when(F.col("seen") > 0, 0).otherwise(F.coalesce(b("fail_streak"), F.lit(0))) + F.col("failures")
    due = F.when(kind.isin(*_SEEN), F.col("at") + refresh_interval_ms(fetches, changes, F.col("at") - first)).when(kind == "failed", F.col("at") + retry_ms(streak)).otherwise(NEVER)
    state = F.when(kind.isin(*_SEEN), FETCHED).when(kind == "failed", FAILED).when(kind == "gone", GONE).otherwise(EXCLUDED)
    status = F.when(F.col("answer").isNotNull(), F.col("answer.status")).otherwise(b("status"))
    cleared = any_ | F.coalesce(F.array_contains("by", b("lease_id")), F.lit(False))
    new = {
        "state": F.when(F.col("refused"), EXCLUDED).otherwise(state), "status": status, "fetch_count": fetches, "change_count": changes, "first_fetch_ms": first, "last_fetch_ms": F.col("at"),
        "last_change_ms": F.coalesce("changed_at", b("last_change_ms")), "content_hash": F.when(F.col("bodies") > 0, F.col("body.hash")).otherwise(b("content_hash")),
        "fail_streak": streak, "next_due_ms": F.when(F.col("refused"), NEVER).otherwise(due),
    }
    types = {f.name: f.dataType for f in ledger.select(*RECORD).schema}
    fields = [F.when(any_, new[c]).otherwise(b(c)).cast(types[c]).alias(c) for c in RECORD[:-2]] + [F.when(~cleared, b(c)).cast(types[c]).alias(c) for c in RECORD[-2:]]
    return batch.select(key, "host_id", "before", F.struct(*fields).alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))


def applied(ledger: DataFrame, changes: DataFrame, key: str = "url_key") -> DataFrame:
    """The ledger with the changed rows' records replaced."""
    joined = ledger.join(changes.select(key, "after"), key, "left")
    return joined.withColumns({c: F.when(F.col("after").isNotNull(), F.col(f"after.{c}")).otherwise(F.col(c)) for c in RECORD}).drop("after").select(*ledger.columns)


def counted(ledger: DataFrame, *keys: str) -> DataFrame:
    """Counters by a full scan: ``keys, state, urls, leased, fetches``."""
    return ledger.groupBy(*keys, "state").agg(F.count("*").alias("urls"), F.count("lease_id").alias("leased"), F.sum(F.coalesce("fetch_count", F.lit(0))).cast("long").alias("fetches"))


def maintained(counters: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """Counters after a change set, without a look at the ledger: each change takes its before image out and puts its after image in. Counters that come to nothing go."""
    image = lambda side, sign: changes.select(
        *keys, F.col(f"{side}.state").alias("state"), F.lit(sign).alias("urls"), (F.col(f"{side}.lease_id").isNotNull().cast("int") * sign).alias("leased"), (F.coalesce(f"{side}.fetch_count", F.lit(0)) * sign).alias("fetches")
    )
    totals = [F.sum(c).cast("long").alias(c) for c in ("urls", "leased", "fetches")]
    deltas = image("before", -1).unionByName(image("after", 1)).groupBy(*keys, "state").agg(*totals)
    return counters.unionByName(deltas).groupBy(*keys, "state").agg(*totals).where("urls <> 0")


def lease_ends(events: DataFrame, ttl_ms: int, now_ms: int, key: str = "url_key") -> DataFrame:
    """Every lease with how it ended: ``key, lease_id, at_ms, end_ms, ending`` (completed, released, superseded, expired, or open).

    ``events`` have ``key, lease_id, at_ms, event`` (lease, complete, release). A lease ends at the first of: its own completion or release,
    the next lease of the key, and ``ttl_ms`` after its start; of equal instants in this order. What names an unknown lease, or comes before it, is no
    event of it. A lease id is taken once a key: its first start counts.
    """
    started = events.where("event = 'lease'").groupBy(key, "lease_id").agg(F.min("at_ms").alias("at_ms"))
    nexts = F.lead("at_ms").over(Window.partitionBy(key).orderBy("at_ms", "lease_id"))
    closes = events.where("event IN ('complete', 'release')").select(key, "lease_id", F.col("at_ms").alias("closed_ms"), "event")
    rows = started.withColumn("next_ms", nexts).join(closes, [key, "lease_id"], "left")
    within = F.col("closed_ms") >= F.col("at_ms")
    end = lambda when, at, rank, name: F.when(when, F.struct(at.cast("long").alias("end_ms"), F.lit(rank).alias("rank"), F.lit(name).alias("ending")))
    first = F.least(end(within & (F.col("event") == "complete"), F.col("closed_ms"), 0, "completed"), end(within & (F.col("event") == "release"), F.col("closed_ms"), 1, "released"),
                    end(F.col("next_ms").isNotNull(), F.col("next_ms"), 2, "superseded"), end(F.lit(True), F.col("at_ms") + ttl_ms, 3, "expired"))
    done = rows.groupBy(key, "lease_id", "at_ms").agg(F.min(first).alias("e"))
    over = F.col("e.end_ms") <= now_ms
    return done.select(key, "lease_id", "at_ms", F.when(over, F.col("e.end_ms")).alias("end_ms"), F.when(over, F.col("e.ending")).otherwise("open").alias("ending"))


def pen_kept(pen: DataFrame, now_ms: int, ttl_ms: int, most: int, key: str = "url_key", by: str = "source") -> DataFrame:
    """The holding pen after expiry and caps: ``by, key, at_ms, fate``: expired, over (a source keeps its ``most`` oldest entries), or kept.

    An entry is its first sighting by a source. The cap is a group limit by source over entries that have not expired.
    """
    first = pen.groupBy(by, key).agg(F.min("at_ms").alias("at_ms"))
    old = F.col("at_ms") + ttl_ms <= now_ms
    place = F.row_number().over(Window.partitionBy(by, "_old").orderBy("at_ms", key))
    rows = first.withColumn("_old", old).withColumn("_n", place)
    return rows.select(by, key, "at_ms", F.when(F.col("_old"), "expired").when(F.col("_n") > most, "over").otherwise("kept").alias("fate"))
