"""Queries over the crawl's state tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import reports, state
from gristmill.plans.registry import query
from gristmill.sources.crawl_tables import FETCHES_SQL, HOSTS_SQL, LEDGER_SQL, fetches, hosts, ledger

#: 1998-01-01 as epoch milliseconds, the instant the lease queries ask at.
NOW = 883_612_800_000
WITH = f"WITH ledger AS ({LEDGER_SQL}), hosts AS ({HOSTS_SQL}), fetches AS ({FETCHES_SQL})"
_LEASABLE = f"""SELECT l.*, h.pld_id, coalesce(h.delay_ms, 1000) AS delay_ms FROM ledger l LEFT JOIN hosts h USING (host_id)
  WHERE state IN (0, 1, 2) AND next_due_ms <= {NOW} AND NOT coalesce(blocked, false)"""


@query("""SELECT count(*)::BIGINT AS urls, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS pending, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS fetched,
  count(*) FILTER (o_orderstatus NOT IN ('O', 'F'))::BIGINT AS failed FROM orders""")
def state_counts(t):
    return state.counts(ledger(t.orders))


@query(WITH + " SELECT host_id, count(*)::BIGINT AS urls, count(*) FILTER (state = 0)::BIGINT AS pending, max(priority)::BIGINT AS top FROM ledger GROUP BY host_id")
def host_counts(t):
    return ledger(t.orders).groupBy("host_id").agg(F.count("*").alias("urls"), F.count_if(F.col("state") == 0).alias("pending"), F.max("priority").alias("top"))


@query(WITH + """, c AS (SELECT host_id AS k, count(*) AS counted FROM ledger GROUP BY host_id), m AS (SELECT c_custkey AS k, c_nationkey AS kept FROM customer)
SELECT k, coalesce(counted, 0)::BIGINT AS counted, coalesce(kept, 0)::BIGINT AS kept FROM c FULL JOIN m USING (k) WHERE coalesce(counted, 0) <> coalesce(kept, 0)""")
def counters_reconciled(t):
    counted = ledger(t.orders).groupBy(F.col("host_id").alias("k")).agg(F.count("*").alias("n"))
    return state.reconcile(counted, t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("n")), "k")


@query(WITH + f" SELECT url_key, host_id, pld_id, priority, next_due_ms, delay_ms FROM ({_LEASABLE})")
def lease_candidates(t):
    return state.candidates(ledger(t.orders), hosts(t.customer), NOW).select("url_key", "host_id", "pld_id", "priority", "next_due_ms", "delay_ms")


@query(WITH + f""", c AS ({_LEASABLE}),
h AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY priority DESC, next_due_ms, url_key) AS oh FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY pld_id ORDER BY priority DESC, next_due_ms, url_key) AS op FROM h WHERE oh <= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY refresh_class ORDER BY priority DESC, next_due_ms, url_key) AS oc FROM p WHERE op <= 20),
b AS (SELECT *, CASE WHEN oc > CASE refresh_class WHEN 1 THEN 40 WHEN 2 THEN 30 WHEN 3 THEN 10 ELSE 0 END THEN 1 ELSE 0 END AS spare FROM k),
x AS (SELECT *, row_number() OVER (ORDER BY spare, priority DESC, next_due_ms, url_key) AS rank FROM b)
SELECT url_key, host_id, pld_id, refresh_class, rank::BIGINT AS rank, ((row_number() OVER (PARTITION BY host_id ORDER BY priority DESC, next_due_ms, url_key) - 1) * delay_ms)::BIGINT AS slot_ms
FROM x WHERE rank <= 100""")
def lease(t):
    return state.lease(state.candidates(ledger(t.orders), hosts(t.customer), NOW), batch=100, max_per_host=2, max_per_pld=20, quotas={1: 40, 2: 30, 3: 10})


@query(WITH + f" SELECT url_key, host_id, priority FROM ({_LEASABLE}) ORDER BY priority DESC, next_due_ms, url_key LIMIT 50")
def lease_top(t):
    return state.candidates(ledger(t.orders), hosts(t.customer), NOW).orderBy(*state.lease_order()).limit(50).select("url_key", "host_id", "priority")


@query(WITH + """ SELECT l.url_key, CASE WHEN l.url_key IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'seen'
  WHEN h.blocked THEN 'excluded' WHEN l.refresh_class > 3 THEN 'held' ELSE 'admitted' END AS verdict FROM ledger l LEFT JOIN hosts h USING (host_id)""")
def admit_classified(t):
    seen = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("url_key"))
    return state.admit(ledger(t.orders), seen, hosts(t.customer).where("blocked"), F.col("refresh_class") <= 3).select("url_key", "verdict")


@query(WITH + " SELECT l.* FROM ledger l WHERE host_id NOT IN (SELECT host_id FROM hosts WHERE blocked)")
def blocked_anti(t):
    return ledger(t.orders).join(hosts(t.customer).where("blocked"), "host_id", "left_anti")


@query(WITH + " SELECT l.* FROM ledger l WHERE host_id IN (SELECT host_id FROM hosts WHERE tier = 'BUILDING' AND NOT blocked)")
def wanted_semi(t):
    return ledger(t.orders).join(hosts(t.customer).where("tier = 'BUILDING' and not blocked"), "host_id", "left_semi")


@query(WITH + """ SELECT i.fetch_id, i.host_id, i.at_ms FROM fetches i WHERE outcome = 'view' AND NOT EXISTS
  (SELECT 1 FROM fetches h WHERE h.outcome = 'click' AND h.host_id = i.host_id AND h.at_ms >= i.at_ms)""")
def fresher_anti(t):
    all_ = fetches(t.events)
    return state.fresher_than(all_.where("outcome = 'view'"), all_.where("outcome = 'click'")).select("fetch_id", "host_id", "at_ms")


@query(WITH + """, a AS (SELECT * FROM ledger WHERE state <> 2), b AS (SELECT url_key, host_id, 2 AS state, 0::BIGINT AS priority, next_due_ms, refresh_class FROM ledger WHERE priority > 100)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE url_key NOT IN (SELECT url_key FROM a)""")
def restore_if_absent(t):
    rows = ledger(t.orders)
    spilled = rows.where("priority > 100").withColumns({"state": F.lit(2), "priority": F.lit(0).cast("long")})
    return state.restore(rows.where("state <> 2"), spilled, "url_key")


@query(WITH + " SELECT url_key, host_id FROM ledger WHERE url_key > 5000 ORDER BY url_key LIMIT 200")
def keyset_page(t):
    return state.page_after(ledger(t.orders), "url_key", 5000, 200).select("url_key", "host_id")


@query(WITH + " SELECT url_key, next_due_ms FROM ledger ORDER BY next_due_ms, url_key LIMIT 30 OFFSET 10")
def skip_then_limit(t):
    return ledger(t.orders).orderBy("next_due_ms", "url_key").offset(10).limit(30).select("url_key", "next_due_ms")


@query(WITH + """ SELECT host_id, fetch_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY (outcome = 'purchase') DESC, latency DESC, fetch_id) AS n FROM fetches) WHERE n = 1""")
def best_answer(t):
    return state.best_answer(fetches(t.events), "host_id", F.desc(F.col("outcome") == "purchase"), F.desc("latency"), F.asc("fetch_id")).select("host_id", "fetch_id", "outcome")


@query(WITH + """ SELECT host_id, count(*)::BIGINT AS fetches, count(*) FILTER (outcome <> before)::BIGINT AS changes FROM
  (SELECT *, lag(outcome) OVER (PARTITION BY host_id ORDER BY at_ms, fetch_id) AS before FROM fetches) GROUP BY host_id""")
def change_detection(t):
    return state.changes(fetches(t.events), "host_id", "outcome", "at_ms", "fetch_id")


@query(WITH + """ SELECT host_id, min(at_ms - before)::BIGINT AS least_gap_ms, count(*) FILTER (at_ms - before < 60000)::BIGINT AS too_close FROM
  (SELECT *, lag(at_ms) OVER (PARTITION BY host_id ORDER BY at_ms, fetch_id) AS before FROM fetches) GROUP BY host_id""")
def politeness_gaps(t):
    from pyspark.sql import Window

    gap = F.col("at_ms") - F.lag("at_ms").over(Window.partitionBy("host_id").orderBy("at_ms", "fetch_id"))
    return fetches(t.events).withColumn("gap", gap).groupBy("host_id").agg(F.min("gap").alias("least_gap_ms"), F.count_if(F.col("gap") < 60_000).alias("too_close"))


@query(WITH + """ SELECT fetch_id, (SELECT count(*) FROM fetches o WHERE o.host_id = e.host_id AND o.at_ms > e.at_ms AND o.at_ms <= e.at_ms + 3600000)::BIGINT AS within FROM fetches e WHERE outcome = 'error'""")
def retry_after_window(t):
    from pyspark.sql import Window

    after = Window.partitionBy("host_id").orderBy("at_ms").rangeBetween(1, 3_600_000)
    return fetches(t.events).withColumn("within", F.count("*").over(after)).where("outcome = 'error'").select("fetch_id", "within")


@query(WITH + """ SELECT host_id, fetch_id, sum(latency_ms) OVER (PARTITION BY host_id ORDER BY at_ms, fetch_id ROWS UNBOUNDED PRECEDING)::BIGINT AS owed_ms
  FROM (SELECT *, CAST(floor(latency * 1000) AS BIGINT) AS latency_ms FROM fetches)""")
def owed_so_far(t):
    from pyspark.sql import Window

    w = Window.partitionBy("host_id").orderBy("at_ms", "fetch_id").rowsBetween(Window.unboundedPreceding, 0)
    return fetches(t.events).withColumn("ms", F.floor(F.col("latency") * 1000).cast("long")).select("host_id", "fetch_id", F.sum("ms").over(w).alias("owed_ms"))


@query(WITH + """, f AS (SELECT host_id, min(at_ms) AS first_ms FROM fetches WHERE outcome = 'purchase' GROUP BY host_id)
SELECT e.fetch_id, CASE WHEN f.first_ms IS NULL THEN 'missed' WHEN f.first_ms < e.at_ms THEN 'early' ELSE 'on time' END AS verdict, CASE WHEN f.first_ms >= e.at_ms THEN f.first_ms - e.at_ms END AS wait_ms
FROM fetches e LEFT JOIN f USING (host_id) WHERE e.outcome = 'signup'""")
def first_fetch_join(t):
    rows = fetches(t.events)
    first = rows.where("outcome = 'purchase'").groupBy("host_id").agg(F.min("at_ms").alias("first_ms"))
    late = F.col("first_ms") >= F.col("at_ms")
    verdict = F.when(F.col("first_ms").isNull(), "missed").when(~late, "early").otherwise("on time")
    return rows.where("outcome = 'signup'").join(first, "host_id", "left").select("fetch_id", verdict.alias("verdict"), F.when(late, F.col("first_ms") - F.col("at_ms")).alias("wait_ms"))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O'), l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45) SELECT k FROM o UNION SELECT k FROM l""")
def set_union(t):
    return t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k")).union(t.lineitem.where("l_quantity > 45").select("l_orderkey")).distinct()


@query("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
def set_except(t):
    return t.orders.select(F.col("o_orderkey").alias("k")).subtract(t.lineitem.where("l_quantity > 45").select("l_orderkey"))


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def set_intersect(t):
    return t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")).intersect(t.lineitem.where("l_returnflag = 'R'").select("l_orderkey"))


@query(WITH + """ SELECT CASE WHEN priority < 10 THEN 'low' WHEN next_due_ms > 883612800000 THEN 'stale' WHEN state = 2 THEN 'failed' ELSE 'accepted' END AS reason, count(*)::BIGINT AS n FROM ledger GROUP BY 1""")
def reject_reasons(t):
    return reports.reasons(ledger(t.orders), {"low": F.col("priority") < 10, "stale": F.col("next_due_ms") > NOW, "failed": F.col("state") == 2})


@query(WITH + f""", l AS (SELECT l.*, h.pld_id, CASE WHEN state = 0 THEN NULL ELSE next_due_ms END AS last_fetch_ms FROM ledger l JOIN hosts h USING (host_id)),
b AS (SELECT *, state <= 2 AND pld_id % 2 = 0 AS gone FROM l), k AS (SELECT *, gone AND pld_id % 3 = 0 AS back, {NOW} - last_fetch_ms AS age FROM b)
SELECT url_key, pld_id, CASE WHEN back THEN 'restored' END AS effect, CASE WHEN back THEN 0 WHEN gone THEN 4 ELSE state END AS state,
  CASE WHEN back THEN {NOW} WHEN gone THEN 9223372036854775807 ELSE next_due_ms END AS next_due_ms,
  CASE WHEN NOT back THEN refresh_class WHEN age IS NULL THEN 5 WHEN age < 3600000 THEN 0 WHEN age < 21600000 THEN 1 WHEN age < 259200000 THEN 2 WHEN age < 2592000000 THEN 3 ELSE 4 END AS refresh_class FROM k""")
def domain_blocks(t):
    """Domains with an even number are blocked, then those that three divides lifted."""
    last = F.when(F.col("state") != 0, F.col("next_due_ms"))
    rows = ledger(t.orders).withColumn("last_fetch_ms", last).join(hosts(t.customer).select("host_id", "pld_id"), "host_id")
    domains = hosts(t.customer).select("pld_id").distinct()
    blocked = state.apply_blocks(rows, domains.where("pld_id % 2 = 0").withColumn("lifted_ms", F.lit(None).cast("long"))).drop("effect")
    lifted = state.apply_blocks(blocked, domains.where("pld_id % 3 = 0").withColumn("lifted_ms", F.lit(NOW)))
    return lifted.select("url_key", "pld_id", "effect", "state", "next_due_ms", "refresh_class")


@query("""SELECT l_returnflag AS stream, count(*) FILTER (l_linenumber = 1)::BIGINT AS local, count(*) FILTER (l_linenumber = 2)::BIGINT AS quorum, count(*) FILTER (l_linenumber = 3)::BIGINT AS replayed,
  count(*) FILTER (l_linenumber > 3)::BIGINT AS unverified FROM lineitem GROUP BY l_returnflag""")
def verification_tally(t):
    return reports.verification_tally(t.lineitem.withColumnRenamed("l_returnflag", "stream"), F.col("l_linenumber") - 1, "stream")


@query("""WITH d AS (SELECT l_suppkey, coalesce(max(l_linenumber) FILTER (l_returnflag = 'R'), 0) AS deepest, count(*) AS n FROM lineitem GROUP BY l_suppkey)
SELECT deepest, count(*)::BIGINT AS domains, sum(n)::BIGINT AS urls FROM d GROUP BY deepest""")
def deepest_tiers(t):
    return reports.deepest_tiers(t.lineitem, "l_suppkey", F.col("l_returnflag") == "R", F.col("l_linenumber"))
