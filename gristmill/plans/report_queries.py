"""Corpus reports and published files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.operators import clusters, publish, reports
from gristmill.plans.registry import query
from gristmill.plans.state_queries import WITH
from gristmill.sources.crawl_tables import fetches, hosts, ledger

_LEDGER_HOSTS = "SELECT l.*, h.pld_id, h.tier FROM ledger l JOIN hosts h USING (host_id)"
_DAY = 86_400_000


@query(WITH + f" SELECT pld_id, count(*)::BIGINT AS urls, count(*) FILTER (state = 1)::BIGINT AS fetched, max(next_due_ms)::BIGINT AS newest_ms FROM ({_LEDGER_HOSTS}) GROUP BY pld_id ORDER BY urls DESC, pld_id LIMIT 100")
def coverage_by_domain(t):
    return reports.coverage(ledger(t.orders).join(hosts(t.customer), "host_id"), "pld_id", fetched=F.col("state") == 1, at="next_due_ms", limit=100)


@query(WITH + f" SELECT pld_id, tier, count(*)::BIGINT AS urls, count(*) FILTER (state = 1)::BIGINT AS fetched, grouping(pld_id, tier)::BIGINT AS level FROM ({_LEDGER_HOSTS}) GROUP BY ROLLUP (pld_id, tier)")
def coverage_rollup(t):
    return reports.coverage_rollup(ledger(t.orders).join(hosts(t.customer), "host_id"), "pld_id", "tier", F.col("state") == 1)


@query(WITH + f" SELECT refresh_class, CAST(floor((1000000000000 - next_due_ms) / (30 * {_DAY}::DOUBLE)) AS BIGINT) AS bucket, count(*)::BIGINT AS n FROM ledger WHERE state = 1 GROUP BY ALL")
def staleness_histogram(t):
    return reports.staleness_histogram(ledger(t.orders).where("state = 1"), "next_due_ms", 1_000_000_000_000, 30 * _DAY, "refresh_class")


@query(WITH + " SELECT host_id, count(*)::BIGINT AS n, round(avg(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END), 6) AS share FROM fetches GROUP BY host_id HAVING count(*) > 20 ORDER BY share DESC, host_id LIMIT 50")
def tier_mix(t):
    return reports.mix(fetches(t.events), "host_id", F.col("outcome") == "error", 20, 50)


@query(WITH + " SELECT CAST(floor(at_ms / 3600000.0) AS BIGINT) AS hour, count(*)::BIGINT AS segments, round(avg(latency), 6) AS mean_s FROM fetches GROUP BY 1")
def publish_health_hourly(t):
    return fetches(t.events).groupBy(F.floor(F.col("at_ms") / 3_600_000).cast("long").alias("hour")).agg(F.count("*").alias("segments"), F.round(F.avg("latency"), 6).alias("mean_s"))


@query(WITH + """ SELECT outcome, count(*)::BIGINT AS n, min(latency) AS least, round(quantile_cont(latency, 0.25), 6) AS p25, round(quantile_cont(latency, 0.5), 6) AS median, round(quantile_cont(latency, 0.75), 6) AS p75,
  round(quantile_cont(latency, 0.9), 6) AS p90, max(latency) AS most, round(avg(CASE WHEN latency <= 50 THEN 1 ELSE 0 END), 6) AS within FROM fetches GROUP BY outcome""")
def staleness_percentiles(t):
    return reports.spread(fetches(t.events), "latency", 50, "outcome")


@query(WITH + " SELECT b.bound::DOUBLE AS bound, (SELECT count(*) FROM fetches WHERE latency <= b.bound)::BIGINT AS n FROM (VALUES (1), (5), (25), (100), (400)) b(bound)")
def latency_buckets(t):
    return reports.cumulative_buckets(fetches(t.events), "latency", [1, 5, 25, 100, 400])


@query(WITH + """ SELECT tier, count(*) FILTER (state = 0)::BIGINT AS pending, count(*) FILTER (state = 1)::BIGINT AS fetched, count(*) FILTER (state = 2)::BIGINT AS failed FROM (""" + _LEDGER_HOSTS + """) GROUP BY tier""")
def stratum_pivot(t):
    rows = ledger(t.orders).join(hosts(t.customer), "host_id")
    made = rows.groupBy("tier").pivot("state", [0, 1, 2]).agg(F.count("url_key"))
    return made.select("tier", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(n) for k, n in ((0, "pending"), (1, "fetched"), (2, "failed"))])


@query(WITH + " SELECT outcome, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM fetches GROUP BY outcome")
def outcome_shares(t):
    n = F.count("*")
    return fetches(t.events).groupBy("outcome").agg(n.alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


_ENTRIES = """entries AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, 'data/' || strftime(l_shipdate, '%Y/%m/%d') || '/part-' || (l_suppkey % 2)::VARCHAR || '.parquet' AS path,
  count(*)::BIGINT AS rows, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1, 2)"""
_DAYS = """days AS (SELECT day, count(*)::BIGINT AS files, sum(rows)::BIGINT AS rows, sum(bytes)::BIGINT AS bytes,
  sha256(string_agg(path || ' ' || rows || ' ' || bytes, chr(10) ORDER BY path || ' ' || rows || ' ' || bytes)) AS digest FROM {0} GROUP BY day)"""


def _entries(t):
    return publish.file_entries(t.lineitem, F.col("l_shipdate"), F.col("l_suppkey") % 2, F.floor("l_extendedprice").cast("long"))


@query(f"WITH {_ENTRIES}, {_DAYS.format('entries')} SELECT *, lag(digest) OVER (ORDER BY day) AS prev FROM days")
def manifest_chain(t):
    return publish.manifests(_entries(t))


@query(f"""WITH {_ENTRIES}, {_DAYS.format('entries')}, after AS (SELECT day, sha256(string_agg(path || ' ' || rows || ' ' || bytes, chr(10) ORDER BY path || ' ' || rows || ' ' || bytes)) AS digest
  FROM entries WHERE bytes <= 500000 GROUP BY day) SELECT coalesce(d.day, a.day) AS day, CASE WHEN a.digest IS NULL THEN 'removed' WHEN d.digest IS NULL THEN 'added' ELSE 'changed' END AS status
FROM days d FULL JOIN after a ON d.day = a.day WHERE d.digest IS DISTINCT FROM a.digest""")
def retraction_changes(t):
    entries = _entries(t)
    return publish.changed_days(publish.manifests(entries), publish.manifests(publish.retract(entries, entries.where("bytes > 500000"))))


@query(f"""WITH {_ENTRIES}, held AS (SELECT path, bytes + CASE WHEN rows = 7 THEN 1 ELSE 0 END AS bytes FROM entries WHERE rows <> 11 UNION ALL SELECT 'extra/' || path, bytes FROM entries WHERE rows = 13)
SELECT coalesce(e.path, h.path) AS path, CASE WHEN h.bytes IS NULL THEN 'missing' WHEN e.bytes IS NULL THEN 'unnamed' WHEN h.bytes <> e.bytes THEN 'size' ELSE 'ok' END AS status FROM entries e FULL JOIN held h ON e.path = h.path""")
def hub_full_outer(t):
    entries = _entries(t)
    held = entries.where("rows <> 11").select("path", (F.col("bytes") + F.when(F.col("rows") == 7, 1).otherwise(0)).alias("bytes"))
    return publish.compare_listing(entries, held.union(entries.where("rows = 13").select(F.concat(F.lit("extra/"), "path"), "bytes")))


@query(f"""WITH {_ENTRIES} SELECT path, CASE WHEN rows = 3 THEN 'not recorded' WHEN rows = 5 THEN 'not listed' WHEN bytes > 600000 THEN 'not same_size' WHEN bytes > 400000 THEN 'not chained' END AS reason,
  NOT (rows = 3 OR rows = 5 OR bytes > 600000 OR bytes > 400000) AS clear FROM entries""")
def gc_evidence(t):
    e = _entries(t).selectExpr("path", "rows <> 3 AS recorded", "rows <> 5 AS listed", "bytes <= 600000 AS same_size", "bytes <= 400000 AS chained")
    return publish.deletable(e).select("path", "reason", "clear")


@query(r"""SELECT digest, first_doc, members FROM (SELECT sha256(trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g'))) AS digest, min(doc_id)::BIGINT AS first_doc, count(*)::BIGINT AS members FROM documents GROUP BY 1) WHERE members > 1""")
def exact_dup_clusters(t):
    return clusters.exact_clusters(t.documents)


@query(r"""WITH d AS (SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g'))) AS digest FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY digest)::BIGINT AS first_doc FROM d QUALIFY count(*) OVER (PARTITION BY digest) > 1""")
def exact_dup_join(t):
    from gristmill.functions.fingerprint import text_digest

    docs = t.documents.select("doc_id", text_digest(F.col("text")).alias("digest"))
    return docs.join(clusters.exact_clusters(t.documents), "digest").select("doc_id", "first_doc")


#: Near-duplicate classes from all pairs: distinct collapsed texts, their sets of 5-token shingles, every pair at 75 percent, components.
NEAR = r"""x AS MATERIALIZED (SELECT source, doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\f\r]+', ' ', 'g')) AS t FROM documents),
u AS MATERIALIZED (SELECT t, min(doc_id) AS rep FROM x GROUP BY t), w AS (SELECT rep, string_split(t, ' ') AS ws FROM u),
s AS MATERIALIZED (SELECT DISTINCT rep, array_to_string(ws[i : i + 4], ' ') AS sh FROM w, generate_series(1, greatest(len(ws) - 4, 1)) g(i)),
k AS MATERIALIZED (SELECT rep, count(*) AS n FROM s GROUP BY rep),
link AS MATERIALIZED (SELECT a, b FROM (SELECT p.rep AS a, q.rep AS b, count(*) AS shared FROM s p JOIN s q USING (sh) WHERE p.rep < q.rep GROUP BY ALL) y
  JOIN k ka ON ka.rep = a JOIN k kb ON kb.rep = b WHERE 100 * shared >= 75 * (ka.n + kb.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r AS (SELECT a AS node, least(a, b) AS reach FROM e UNION SELECT e.b, r.reach FROM r JOIN e ON e.a = r.node),
near AS MATERIALIZED (SELECT source, doc_id, coalesce(c.comp, rep)::BIGINT AS cluster FROM x JOIN u USING (t) LEFT JOIN (SELECT node, min(reach) AS comp FROM r GROUP BY node) c ON c.node = rep)"""


@query(f"WITH RECURSIVE {NEAR} SELECT doc_id, cluster FROM near")
def near_dup_clusters(t):
    return clusters.near_clusters(t.documents)


@query(f"""WITH RECURSIVE {NEAR}, c AS (SELECT source, cluster, count(*) AS n FROM near GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS docs, max(n)::BIGINT AS commonest, max(n) * 10 > sum(n) * 6 AS soft_404 FROM c GROUP BY source""")
def soft_404_hosts(t):
    return clusters.top_share(t.documents)


@query(r"""WITH d AS (SELECT DISTINCT source AS host, sha256(trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g'))) AS digest FROM documents), s AS (SELECT host, count(*) AS n FROM d GROUP BY host),
p AS (SELECT l.host AS a, r.host AS b, count(*) AS common FROM d l JOIN d r USING (digest) WHERE l.host < r.host GROUP BY ALL)
SELECT a, b, common::BIGINT AS common, least(x.n, y.n)::BIGINT AS smaller FROM p JOIN s x ON x.host = a JOIN s y ON y.host = b WHERE common >= 0.01 * least(x.n, y.n)""")
def mirror_hosts(t):
    return clusters.host_pairs(t.documents, 0.01)
