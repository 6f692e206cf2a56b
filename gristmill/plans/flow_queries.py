"""Queries over what moves the crawl's state: completions, counters, leases, the pen, backpressure. Their twins are sequential folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import completion, discovery, polls, pressure, tiers
from gristmill.plans.registry import query
from gristmill.plans.state_queries import NOW, WITH
from gristmill.sources.crawl_tables import fetches, hosts, ledger, millis
from gristmill.storage import durable

DAY = 86_400_000
NEVER = (1 << 63) - 1


def _kind(flag, status, quantity):
    return F.when((flag == "R") & (status == "O"), "failed").when(quantity > 47, "gone").when(quantity < 3, "excluded").when(flag == "A", "not_modified").otherwise("fetched")


_KIND = "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'failed' WHEN l_quantity > 47 THEN 'gone' WHEN l_quantity < 3 THEN 'excluded' WHEN l_returnflag = 'A' THEN 'not_modified' ELSE 'fetched' END"
_AT = "epoch_us(l_shipdate) // 1000"
_FOLD = f"""WITH RECURSIVE start AS (SELECT o_orderkey AS url_key, o_custkey AS host_id, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS state, epoch_us(o_orderdate) // 1000 AS ms FROM orders),
l AS (SELECT url_key, host_id, state, CASE state WHEN 1 THEN 200 ELSE 0 END AS status, CASE state WHEN 1 THEN 3 ELSE 0 END::BIGINT AS fetch_count, CASE state WHEN 1 THEN 2 ELSE 0 END::BIGINT AS change_count,
  CASE state WHEN 1 THEN ms END AS first_fetch_ms, CASE WHEN state > 0 THEN ms END AS last_fetch_ms, CASE state WHEN 1 THEN ms END AS last_change_ms, CASE state WHEN 1 THEN '0' END AS content_hash,
  CASE state WHEN 2 THEN 2 ELSE 0 END AS fail_streak, CASE WHEN url_key % 3 > 0 THEN 'l' || url_key % 4 END AS lease_id, CASE WHEN url_key % 3 > 0 THEN ms + 1000 END AS lease_until_ms, ms AS next_due_ms FROM start),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq, ms) AS i FROM (SELECT l_orderkey AS k, l_linenumber * 10000000 + l_partkey AS seq, {_AT} AS ms, {_KIND} AS kind, (l_suppkey % 3)::VARCHAR AS hash, 'l' || l_linenumber % 4 AS lid, l_linenumber % 2 AS odd FROM lineitem)),
bad AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
f AS (SELECT *, 0::BIGINT AS i, false AS touched FROM l UNION ALL
  SELECT url_key, host_id, CASE WHEN NOT new THEN state WHEN host_id IN (FROM bad) THEN 4 WHEN seen THEN 1 WHEN kind = 'failed' THEN 2 WHEN kind = 'gone' THEN 3 ELSE 4 END,
    CASE WHEN NOT new OR kind = 'excluded' THEN status WHEN kind = 'fetched' THEN 200 WHEN kind = 'not_modified' THEN 304 WHEN kind = 'gone' THEN 410 ELSE 503 * odd END,
    fetch_count + (new AND seen)::BIGINT, change_count + (new AND changed)::BIGINT, CASE WHEN new AND seen THEN coalesce(first_fetch_ms, ms) ELSE first_fetch_ms END, CASE WHEN new THEN ms ELSE last_fetch_ms END,
    CASE WHEN new AND changed THEN ms ELSE last_change_ms END, CASE WHEN new AND kind = 'fetched' THEN hash ELSE content_hash END,
    CASE WHEN new AND seen THEN 0 WHEN new AND kind = 'failed' THEN fail_streak + 1 ELSE fail_streak END,
    CASE WHEN NOT new AND lease_id IS DISTINCT FROM lid THEN lease_id END, CASE WHEN NOT new AND lease_id IS DISTINCT FROM lid THEN lease_until_ms END,
    CASE WHEN NOT new THEN next_due_ms WHEN host_id IN (FROM bad) OR kind IN ('gone', 'excluded') THEN {NEVER} WHEN seen THEN NULL
      ELSE ms + ([60000, 300000, 1500000, 7200000, 43200000, 86400000])[least(fail_streak + 1, 6)] END, i, touched OR new OR lease_id IS NOT DISTINCT FROM lid
  FROM (SELECT f.* EXCLUDE (i), o.i, ms, kind, hash, lid, odd, ms > coalesce(last_fetch_ms, -1) AS new, kind IN ('fetched', 'not_modified') AS seen, kind = 'fetched' AND hash IS DISTINCT FROM content_hash AS changed
    FROM f JOIN o ON o.k = f.url_key AND o.i = f.i + 1)),
done AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY i DESC) = 1)"""


def _held(t):
    rows = ledger(t.orders).select("url_key", "host_id", "state", F.col("next_due_ms").alias("at"))
    fetched, leased = F.col("state") == 1, F.col("url_key") % 3 > 0
    count = lambda n: F.when(fetched, n).otherwise(0).cast("long")
    return rows.select(
        "url_key", "host_id", "state", F.when(fetched, 200).otherwise(0).alias("status"), count(3).alias("fetch_count"), count(2).alias("change_count"), F.when(fetched, F.col("at")).alias("first_fetch_ms"),
        F.when(F.col("state") > 0, F.col("at")).alias("last_fetch_ms"), F.when(fetched, F.col("at")).alias("last_change_ms"), F.when(fetched, "0").alias("content_hash"), F.when(F.col("state") == 2, 2).otherwise(0).alias("fail_streak"),
        F.col("at").alias("next_due_ms"), F.when(leased, F.concat(F.lit("l"), F.col("url_key") % 4)).alias("lease_id"), F.when(leased, F.col("at") + 1000).alias("lease_until_ms"),
    )


def _outcomes(lineitem):
    kind = _kind(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity"))
    status = F.when(F.col("kind") == "fetched", 200).when(F.col("kind") == "not_modified", 304).when(F.col("kind") == "gone", 410).when((F.col("kind") == "failed") & (F.col("l_linenumber") % 2 == 1), 503)
    rows = lineitem.withColumn("kind", kind)
    return rows.select(
        F.col("l_orderkey").alias("url_key"), (F.col("l_linenumber") * F.lit(10_000_000).cast("long") + F.col("l_partkey")).alias("seq"), F.concat(F.lit("l"), F.col("l_linenumber") % 4).alias("lease_id"),
        millis(F.col("l_shipdate")).alias("finished_ms"), "kind", status.alias("status"), (F.col("l_suppkey") % 3).cast("string").alias("content_hash"),
    )


def _changes(t):
    held = durable(_held(t), "ledger")
    return held, completion.change_set(held, _outcomes(t.lineitem), hosts(t.customer).where("blocked"))


@query(_FOLD + """ SELECT url_key, state, status, fetch_count, change_count, first_fetch_ms, last_fetch_ms, last_change_ms, content_hash, fail_streak, lease_id, lease_until_ms,
  CASE WHEN state <> 1 THEN next_due_ms END AS retry_ms FROM done WHERE touched""")
def completion_changes(t):
    after = _changes(t)[1].select("url_key", "after.*")
    return after.withColumn("retry_ms", F.when(F.col("state") != 1, F.col("next_due_ms"))).drop("next_due_ms")


@query(_FOLD + """ SELECT host_id, state, count(*)::BIGINT AS urls, count(lease_id)::BIGINT AS leased, sum(fetch_count)::BIGINT AS fetches FROM done GROUP BY host_id, state""")
def completion_counters(t):
    held, changes = _changes(t)
    return completion.maintained(completion.counted(held, "host_id"), changes, "host_id")


_LEASES = f"""e AS (SELECT l_orderkey AS url_key, l_linenumber::VARCHAR AS lease_id, {_AT} AS ms, CASE WHEN l_returnflag = 'A' THEN 'completed' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'released' END AS how, {_AT} + CAST(l_quantity AS BIGINT) * {DAY} // 2 AS closed FROM lineitem),
s AS (SELECT url_key, lease_id, min(ms) AS ms FROM e GROUP BY ALL), n AS (SELECT *, lead(ms) OVER (PARTITION BY url_key ORDER BY ms, lease_id) AS nxt FROM s),
c AS (SELECT url_key, lease_id, n.ms, closed AS stop, CASE how WHEN 'completed' THEN 0 ELSE 1 END AS rank, how FROM n JOIN e USING (url_key, lease_id) WHERE how IS NOT NULL AND closed >= n.ms
  UNION ALL SELECT url_key, lease_id, ms, nxt, 2, 'superseded' FROM n WHERE nxt IS NOT NULL UNION ALL SELECT url_key, lease_id, ms, ms + 10 * {DAY}, 3, 'expired' FROM n),
x AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY url_key, lease_id ORDER BY stop, rank) = 1)"""


@query(f"WITH {_LEASES} SELECT url_key, lease_id, ms AS at_ms, CASE WHEN stop <= {NOW} THEN stop END AS end_ms, CASE WHEN stop <= {NOW} THEN how ELSE 'open' END AS ending FROM x")
def lease_endings(t):
    at, closed = millis(F.col("l_shipdate")), F.floor(F.col("l_quantity").cast("long") * DAY / 2).cast("long")
    rows = t.lineitem.select(F.col("l_orderkey").alias("url_key"), F.col("l_linenumber").cast("string").alias("lease_id"), at.alias("at_ms"), (at + closed).alias("closed"), "l_returnflag", "l_linestatus")
    starts = rows.select("url_key", "lease_id", "at_ms", F.lit("lease").alias("event"))
    how = F.when(F.col("l_returnflag") == "A", "complete").when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "release")
    closes = rows.select("url_key", "lease_id", F.col("closed").alias("at_ms"), how.alias("event")).where("event is not null")
    return completion.lease_ends(starts.unionByName(closes), 10 * DAY, NOW)


_PEN_NOW = 1_706_659_200_000  # 2024-01-31


@query(WITH + f""", p AS (SELECT host_id AS source, CAST(floor(latency) AS BIGINT) AS url_key, min(at_ms) AS at_ms FROM fetches GROUP BY ALL), n AS (SELECT *, at_ms + 20 * {DAY} <= {_PEN_NOW} AS old FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY source, old ORDER BY at_ms, url_key) AS i FROM n)
SELECT source, url_key, at_ms, CASE WHEN old THEN 'expired' WHEN i > 25 THEN 'over' ELSE 'kept' END AS fate FROM k""")
def pen_expiry(t):
    pen = fetches(t.events).select(F.col("host_id").alias("source"), F.floor("latency").cast("long").alias("url_key"), "at_ms")
    return completion.pen_kept(pen, _PEN_NOW, 20 * DAY, 25)


#: Holds in the queries, wide enough for the events' pace: a rung, saturation, escalation.
_HOLD, _SATURATED, _ESCALATE = 6 * 3_600_000, 1_800_000, 3_600_000


def _settle(name: str, demand: str) -> str:
    rung, easing = f"{name}_level", f"{name}_easing"
    return f"""CASE WHEN {demand} > {rung} THEN {demand} WHEN {demand} < {rung} AND at_ms - coalesce({easing}, at_ms) >= {_HOLD} THEN {rung} - 1 ELSE {rung} END AS {rung},
  CASE WHEN {demand} >= {rung} THEN NULL WHEN at_ms - coalesce({easing}, at_ms) >= {_HOLD} THEN at_ms ELSE coalesce({easing}, at_ms) END AS {easing}"""


_LADDERS = WITH.replace("WITH ", "WITH RECURSIVE ", 1) + f""", r AS (SELECT fetch_id, host_id % 8 AS machine, at_ms, CAST(floor(latency * 60000000) AS BIGINT) AS unpublished, CAST(floor(latency * 20000) AS BIGINT) AS lag, CAST(floor(60000000000 - latency * 200000000) AS BIGINT) AS free,
  latency * 10 > 2000 AS queued, outcome IN ('error', 'click', 'view') AS saturated, CAST(floor(latency) AS BIGINT) * 100 // 120 AS percent FROM fetches),
s AS MATERIALIZED (SELECT *, greatest((unpublished > 4294967296)::INT + (unpublished > 8589934592)::INT + (unpublished > 17179869184)::INT, (lag > 1200000)::INT + (lag > 2700000)::INT + (lag > 5400000)::INT,
  (free < 42949672960)::INT + (free < 26843545600)::INT + (free < 16106127360)::INT + (free < 5368709120)::INT) AS disk, (percent >= 85)::INT + (percent >= 95)::INT AS memory, row_number() OVER (PARTITION BY machine ORDER BY at_ms, fetch_id) AS i FROM r),
f AS (SELECT DISTINCT machine, 0::BIGINT AS i, NULL::BIGINT AS fetch_id, NULL::BIGINT AS at_ms, NULL::BIGINT AS sat, NULL::BIGINT AS press, 0 AS disk_level, NULL::BIGINT AS disk_easing, 0 AS cpu_level, NULL::BIGINT AS cpu_easing, 0 AS memory_level, NULL::BIGINT AS memory_easing, 0 AS was FROM s UNION ALL
  SELECT machine, i, fetch_id, at_ms, sat, press, {_settle('disk', 'disk')}, {_settle('cpu', 'cpu')}, {_settle('memory', 'memory')}, disk_level AS was
  FROM (SELECT *, CASE WHEN press IS NULL THEN 0 WHEN at_ms - press >= {_ESCALATE} THEN 2 ELSE 1 END AS cpu FROM
    (SELECT * EXCLUDE (before), CASE WHEN queued OR at_ms - sat >= {_SATURATED} THEN coalesce(before, at_ms) END AS press FROM
      (SELECT s.*, CASE WHEN saturated THEN coalesce(sat, s.at_ms) END AS sat, press AS before, disk_level, disk_easing, cpu_level, cpu_easing, memory_level, memory_easing FROM f JOIN s ON s.machine = f.machine AND s.i = f.i + 1))))"""


def _signals(t):
    v = F.col("latency")
    whole = lambda c: F.floor(c).cast("long")
    return fetches(t.events).select(
        (F.col("host_id") % 8).alias("machine"), "at_ms", "fetch_id", whole(v * 60_000_000).alias("unpublished"), whole(v * 20_000).alias("lag_ms"), whole(F.lit(60_000_000_000) - v * 200_000_000).alias("free"),
        (v * 10).alias("queue"), F.col("outcome").isin("error", "click", "view").alias("saturated"), whole(v).alias("rss"), F.lit(120).cast("long").alias("budget"),
    )


def _levels(t):
    return pressure.ladder_levels(_signals(t), ["machine"], ["at_ms", "fetch_id"], hold_ms=_HOLD, saturated_ms=_SATURATED, escalate_ms=_ESCALATE, chunk_ms=DAY)


@query(_LADDERS + """ SELECT machine, at_ms, fetch_id, disk_level AS disk, cpu_level AS cpu, memory_level AS memory, least(CASE WHEN disk_level >= 3 THEN 0 WHEN disk_level = 2 THEN 50 ELSE 100 END, CASE WHEN cpu_level = 2 THEN 50 ELSE 100 END, CASE WHEN memory_level = 2 THEN 0 ELSE 100 END) AS lease_scale,
  least(CASE WHEN disk_level >= 1 THEN 1 ELSE 2 END, CASE WHEN cpu_level >= 1 THEN 0 ELSE 2 END) AS max_tier, CASE WHEN disk_level >= 1 THEN 12 ELSE 35 END AS share FROM f WHERE i > 0""")
def backpressure_levels(t):
    allowed = pressure.allowance(_levels(t))
    return allowed.select("machine", "at_ms", "fetch_id", "disk", "cpu", "memory", "lease_scale", "max_tier", pressure.discovery_share(F.lit(65), F.col("discovery")).alias("share"))


@query(_LADDERS + " SELECT machine, at_ms, fetch_id, was AS before, disk_level AS level FROM f WHERE i > 0 AND was <> disk_level")
def backpressure_moves(t):
    return pressure.transitions(durable(_levels(t), "levels"), ["machine"], ["at_ms", "fetch_id"], "disk", chunk_ms=DAY)


_SITEMAPS = """files AS (SELECT 's' || o_orderkey AS file, CAST(floor(o_totalprice / 10000) AS BIGINT) AS n_urls, o_orderkey % 7 <> 0 AS allowed FROM orders),
nested AS (SELECT 's' || l_orderkey AS file, l_linenumber AS place, 's' || (l_orderkey + 40 * l_partkey + (l_linenumber = 7)::INT) % 20000 AS target FROM lineitem),
starts AS (SELECT DISTINCT c_custkey % 40 AS origin, 's' || (c_custkey % 40 + 40 * (c_custkey % 13)) AS file, c_custkey % 13 AS place FROM customer),
w AS (SELECT origin, file, 0 AS depth, lpad(place::VARCHAR, 8, '0') || file || ' ' AS way FROM starts UNION ALL
  SELECT w.origin, n.target, depth + 1, way || lpad(n.place::VARCHAR, 8, '0') || n.target || ' ' FROM w JOIN files f USING (file) JOIN nested n USING (file) WHERE depth < 3 AND allowed AND substr(w.file, 2)::BIGINT % 40 = w.origin),
d AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY origin, file ORDER BY depth, way) = 1),
k AS (SELECT d.*, n_urls, CASE WHEN substr(file, 2)::BIGINT % 40 <> origin THEN 'off_origin' WHEN n_urls IS NULL THEN 'missing' WHEN NOT allowed THEN 'disallowed' ELSE 'fetched' END AS fate FROM d LEFT JOIN files USING (file)),
c AS (SELECT *, coalesce(count(*) FILTER (fate = 'fetched') OVER p, 0) AS nf, coalesce(sum(n_urls) FILTER (fate = 'fetched') OVER p, 0) AS nu FROM k WINDOW p AS (PARTITION BY origin ORDER BY depth, way ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, nf >= 60 OR nu >= 900 AS capped, CASE WHEN fate = 'fetched' AND nf < 60 AND nu < 900 THEN least(n_urls, 900 - nu) ELSE 0 END AS taken FROM c)"""


def _sitemaps(t):
    files = t.orders.select(F.concat(F.lit("s"), "o_orderkey").alias("file"), F.floor(F.col("o_totalprice") / 10_000).cast("long").alias("n_urls"), (F.col("o_orderkey") % 7 != 0).alias("allowed"))
    target = (F.col("l_orderkey") + 40 * F.col("l_partkey") + (F.col("l_linenumber") == 7).cast("int")) % 20_000
    nested = t.lineitem.select(F.concat(F.lit("s"), "l_orderkey").alias("file"), F.col("l_linenumber").alias("place"), F.concat(F.lit("s"), target).alias("target"))
    key = F.col("c_custkey")
    starts = t.customer.select((key % 40).alias("origin"), (key % 13).alias("place"), F.concat(F.lit("s"), key % 40 + 40 * (key % 13)).alias("file"))
    own = F.substring("file", 2, 18).cast("long") % 40 == F.col("origin")
    return discovery.discover(starts, files, nested, max_depth=3, max_files=60, max_urls=900, same_origin=own)


@query("WITH RECURSIVE " + _SITEMAPS + " SELECT origin, file, depth, CASE WHEN capped THEN 'capped' ELSE fate END AS fate, taken::BIGINT AS taken FROM x")
def sitemap_discovery(t):
    return _sitemaps(t).select("origin", "file", "depth", "fate", "taken")


@query("WITH RECURSIVE " + _SITEMAPS + """ SELECT origin, count(*) FILTER (fate = 'fetched' AND NOT capped)::BIGINT AS files, sum(taken)::BIGINT AS urls, count(*) FILTER (fate = 'off_origin' AND NOT capped)::BIGINT AS off_origin,
  count(*) FILTER (fate = 'disallowed' AND NOT capped)::BIGINT AS disallowed, count(*) FILTER (fate = 'missing' AND NOT capped)::BIGINT AS missing, bool_or(capped OR fate = 'fetched' AND taken < n_urls) AS truncated FROM x GROUP BY origin""")
def sitemap_report(t):
    return discovery.discovery_report(_sitemaps(t))


_ANSWERS = """SELECT host_id, at_ms, fetch_id, CASE WHEN outcome = 'error' OR outcome = 'click' AND host_id % 3 = 0 THEN 'blocked' WHEN outcome = 'signup' AND host_id % 5 = 0 THEN 'shell' ELSE 'success' END AS signal, greatest(fetch_id % 4, 1) AS tier FROM fetches"""


@query(WITH.replace("WITH", "WITH RECURSIVE", 1) + f""", n AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY at_ms, fetch_id) AS k FROM ({_ANSWERS})),
f AS (SELECT host_id, 0::BIGINT AS k, 1::BIGINT AS p, 2 AS m, 1::BIGINT AS w, 0::BIGINT AS b, 0::BIGINT AS c, false AS r FROM n WHERE k = 1 UNION ALL
  SELECT f.host_id, n.k, CASE signal WHEN 'success' THEN least(p, tier) WHEN 'blocked' THEN least(p + 1, m) ELSE 3 END, CASE signal WHEN 'shell' THEN 3 ELSE m END, CASE signal WHEN 'success' THEN tier ELSE w END,
    CASE signal WHEN 'success' THEN 0 WHEN 'blocked' THEN b + 1 ELSE b END, CASE WHEN signal <> 'success' OR tier < p THEN at_ms ELSE c END, r OR signal = 'shell' FROM f JOIN n ON n.host_id = f.host_id AND n.k = f.k + 1)
SELECT host_id, p::INTEGER AS preferred, m AS most, w::INTEGER AS last_success, b AS blocks, c AS probe_clock_ms, r AS render_required,
  CASE WHEN b = 0 THEN 0 ELSE coalesce([60000, 300000, 1500000, 7200000, 43200000][b], 86400000) END::BIGINT AS backoff_ms, b >= 35 AND p >= m AS refusing FROM f QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY k DESC) = 1""")
def tier_policies(t):
    rows, outcome, host = fetches(t.events), F.col("outcome"), F.col("host_id")
    blocked = (outcome == "error") | ((outcome == "click") & (host % 3 == 0))
    signal = F.when(blocked, "blocked").when((outcome == "signup") & (host % 5 == 0), "shell").otherwise("success")
    return tiers.tier_policies(rows.select("host_id", "at_ms", "fetch_id", signal.alias("signal"), (F.col("fetch_id") % 4).alias("tier")), hour_ms=DAY)


_POLLED = "SELECT 'u' || l_partkey AS url, CASE l_returnflag WHEN 'N' THEN NULL ELSE epoch_us(date_trunc('month', l_shipdate)) // 1000 END AS published_ms, epoch_us(l_shipdate) // 1000 AS polled_ms, l_orderkey, l_linenumber FROM lineitem"


@query(f"""WITH p AS ({_POLLED}), w AS (SELECT *, row_number() OVER o AS n, max_by(published_ms, (polled_ms, l_orderkey, l_linenumber)) FILTER (published_ms IS NOT NULL) OVER (PARTITION BY url ORDER BY polled_ms, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known
  FROM p WINDOW o AS (PARTITION BY url ORDER BY polled_ms, l_orderkey, l_linenumber))
SELECT url, CASE n WHEN 1 THEN 'item' ELSE 'updated' END AS kind, published_ms::BIGINT AS published_ms, polled_ms::BIGINT AS polled_ms FROM w WHERE n = 1 OR published_ms IS NOT NULL AND published_ms IS DISTINCT FROM known""")
def feed_changes(t):
    published = F.when(F.col("l_returnflag") != "N", millis(F.date_trunc("month", "l_shipdate")))
    rows = t.lineitem.select(F.concat(F.lit("u"), F.col("l_partkey").cast("string")).alias("url"), published.alias("published_ms"), millis(F.col("l_shipdate")).alias("polled_ms"), "l_orderkey", "l_linenumber")
    return polls.poll_changes(rows, "l_orderkey", "l_linenumber")


@query(f"""WITH g AS (SELECT o_orderkey AS url_key, epoch_us(o_orderdate) // 1000 AS ms, o_orderstatus AS s FROM orders), c AS (SELECT l_orderkey AS url_key, epoch_us(l_shipdate) // 1000 + (l_linenumber::BIGINT - 4) * 10 * {DAY}::BIGINT AS lastmod, epoch_us(l_shipdate) // 1000 AS found FROM lineitem)
SELECT url_key, (ms + 60 * {DAY}::BIGINT)::BIGINT AS due_before, min(found)::BIGINT AS next_due_ms FROM g JOIN c USING (url_key) WHERE lastmod > CASE s WHEN 'O' THEN 0 ELSE ms + 30 * {DAY}::BIGINT END AND found < ms + 60 * {DAY}::BIGINT GROUP BY url_key, ms""")
def brought_forward(t):
    at = millis(F.col("o_orderdate"))
    last = F.when(F.col("o_orderstatus") != "O", at + 30 * DAY)
    rows = ledger(t.orders).join(t.orders.select(F.col("o_orderkey").alias("url_key"), last.alias("last_fetch_ms")), "url_key")
    rows = rows.withColumn("next_due_ms", F.col("next_due_ms") + 60 * DAY).withColumn("leased", F.lit(False))
    found = t.lineitem.select(F.col("l_orderkey").alias("url_key"), (millis(F.col("l_shipdate")) + (F.col("l_linenumber").cast("long") - 4) * 10 * DAY).alias("lastmod_ms"), millis(F.col("l_shipdate")).alias("discovered_ms"))
    return polls.bring_forward(rows, found)
