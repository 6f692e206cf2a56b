"""Queries over dates, sitemaps and feeds, scope, trust, link sets and chunk trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import dates, merkle, names, robots, urls
from gristmill.operators import scope, trust
from gristmill.plans.registry import query
from gristmill.plans.state_queries import WITH
from gristmill.plans.text_queries import _HOST, _PLD
from gristmill.sources import feeds
from gristmill.sources.crawl_tables import fetches, ledger, millis

_ZONE_MS = "CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 7200000 ELSE -19800000 END"


@query(f"SELECT event_id, (epoch_us(ts) // 1000000 * 1000 - {_ZONE_MS})::BIGINT AS at_ms FROM events")
def w3c_dates(t):
    zone = F.element_at(F.array(F.lit("Z"), F.lit("+02:00"), F.lit("-0530")), (F.col("event_id") % 3 + 1).cast("int"))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return t.events.select("event_id", dates.any_date(text).alias("at_ms"))


@query("SELECT event_id, (epoch_us(ts) // 1000000 * 1000 + 18000000)::BIGINT AS at_ms FROM events")
def rfc822_dates(t):
    text = F.concat(F.lit("Mon, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" EST"))
    return t.events.select("event_id", dates.any_date(text).alias("at_ms"))


@query("SELECT isoyear(o_orderdate) || '-W' || lpad(weekofyear(o_orderdate)::VARCHAR, 2, '0') AS week, count(*)::BIGINT AS n, min(strftime(o_orderdate, '%Y%m%d')) AS first_folder FROM orders GROUP BY 1")
def iso_weeks(t):
    return t.orders.groupBy(dates.iso_week(F.col("o_orderdate").cast("date")).alias("week")).agg(F.count("*").alias("n"), F.min(F.date_format("o_orderdate", "yyyyMMdd")).alias("first_folder"))


@query("SELECT page_id, url, (1704067200000 + page_id % 28 * 86400000)::BIGINT AS lastmod_ms, page_id % 2 = 0 AS is_index FROM pages")
def sitemap_entries(t):
    tag = F.when(F.col("page_id") % 2 == 0, "sitemap").otherwise("url")
    day = F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    xml = F.concat(F.lit("<?xml version='1.0'?><x><"), tag, F.lit(">\n<loc> "), escaped, F.lit(" </loc><lastmod>2024-01-"), day, F.lit("</lastmod></"), tag, F.lit("></x>"))
    return t.pages.select("page_id", F.explode(feeds.sitemap(xml)).alias("e")).select("page_id", "e.url", "e.lastmod_ms", "e.is_index")


@query("SELECT page_id, url, 1706868610000::BIGINT AS updated_ms FROM pages")
def feed_items(t):
    escaped = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    rss = F.concat(F.lit("<rss><channel><link>http://no/</link><item><title>t</title><link>"), escaped, F.lit("</link><pubDate>Fri, 02 Feb 2024 10:10:10 GMT</pubDate></item></channel></rss>"))
    atom = F.concat(F.lit("<feed><entry><link rel='alternate' href='"), escaped, F.lit("'/><published>2023-01-01</published><updated>2024-02-02T10:10:10Z</updated></entry></feed>"))
    text = F.when(F.col("page_id") % 2 == 0, rss).otherwise(atom)
    return t.pages.select("page_id", F.explode(feeds.feed(text)).alias("e")).select("page_id", "e.url", "e.updated_ms")


@query(f"SELECT page_id FROM pages WHERE (({_HOST}) = 'example.com' OR ({_HOST}) LIKE '%.example.com') AND NOT regexp_matches(url, '^(?:.*page=[0-9]+.*)$')")
def scoped_pages(t):
    return t.pages.where(scope.in_scope(F.col("url"), [("suffix", "example.com")], [("regex", ".*page=[0-9]+.*")])).select("page_id")


@query(f"SELECT page_id FROM pages WHERE ({_HOST}) IN ('example.org', 'm.example.net') OR ({_HOST}) LIKE '%.example.org' OR ({_HOST}) LIKE '%.m.example.net'")
def blocked_with_parents(t):
    blocks = t.spark.createDataFrame([("example.org",), ("m.example.net",)], "domain string")
    return scope.blocked_with_parents(t.pages.withColumn("host", urls.host(F.col("url"))), "host", blocks).select("page_id")


@query("SELECT c_custkey AS domain, arg_max(peer, md5(peer || '/' || c_custkey::VARCHAR)) AS owner FROM customer, (VALUES ('p1'), ('p2'), ('p3')) p(peer) GROUP BY 1")
def domain_owners(t):
    return scope.owners(t.customer.select(F.col("c_custkey").alias("domain")), "domain", ["p1", "p2", "p3"])


@query("SELECT l_partkey AS part, count(DISTINCT l_suppkey)::BIGINT AS sources, bool_or(l_returnflag = 'R') OR count(DISTINCT l_suppkey) >= 20 AS graduates FROM lineitem GROUP BY 1")
def pen_graduation(t):
    return scope.corroborated(t.lineitem.withColumnRenamed("l_partkey", "part"), "part", "l_suppkey", F.col("l_returnflag") == "R", 20)


@query(WITH + " SELECT fetch_id, host_id FROM (SELECT *, row_number() OVER (PARTITION BY host_id, at_ms // 86400000 ORDER BY latency DESC, fetch_id) AS n FROM fetches) WHERE n <= 2")
def daily_cap(t):
    return scope.daily_cap(fetches(t.events), "host_id", F.floor(F.col("at_ms") / 86_400_000), [F.desc("latency"), F.asc("fetch_id")], 2).select("fetch_id", "host_id")


@query(f"""WITH p AS (SELECT {_HOST} AS host, '/' || string_split(CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END, '/')[2] AS prefix, url FROM pages)
SELECT host, prefix, count(DISTINCT url)::BIGINT AS urls FROM p GROUP BY ALL HAVING count(DISTINCT url) > 1""")
def prefix_budget(t):
    return scope.over_budget_prefixes(t.pages, "url", 1)


@query(WITH + """ SELECT host_id, round(list_reduce(list_prepend({'a': 0.5::DOUBLE, 'k': ''}, list({'a': 0.0::DOUBLE, 'k': outcome} ORDER BY at_ms, fetch_id)),
  lambda s, e: {'a': CASE e.k WHEN 'purchase' THEN s.a * 0.98 + 0.02 WHEN 'click' THEN s.a * 0.9 WHEN 'error' THEN s.a * 0.5 ELSE s.a END, 'k': ''}).a, 6) AS reputation FROM fetches GROUP BY host_id""")
def reputation_fold(t):
    rows = fetches(t.events)
    verdict = F.when(F.col("outcome") == "purchase", "pass").when(F.col("outcome") == "click", "soft").when(F.col("outcome") == "error", "hard")
    return trust.reputation(rows, "host_id", F.floor(F.col("at_ms") / 3_600_000), ["at_ms", "fetch_id"], verdict).select("host_id", F.round("value", 6).alias("reputation"))


@query(WITH + """, w AS (SELECT host_id, at_ms // 604800000 AS week, count(*) AS n FROM fetches GROUP BY ALL), l AS (SELECT *, lag(n) OVER o AS before, lag(week) OVER o AS bw FROM w WINDOW o AS (PARTITION BY host_id ORDER BY week))
SELECT host_id, week::BIGINT AS week, before::BIGINT AS before, n::BIGINT AS n FROM l WHERE bw = week - 1 AND n >= 4 AND n >= 2 * before""")
def weekly_doubling(t):
    weeks = fetches(t.events).groupBy("host_id", F.floor(F.col("at_ms") / 604_800_000).cast("long").alias("week")).agg(F.count("*").alias("n"))
    return trust.doubled(weeks, "host_id", "week", "n", 4)


@query(WITH + " SELECT url_key FROM ledger WHERE CAST('0x' || left(sha256(url_key::VARCHAR), 8) AS BIGINT) / 4294967296.0 < CASE WHEN priority > 200 THEN 0.2 ELSE 0.02 END")
def replay_sample(t):
    return ledger(t.orders).where(trust.replayed(F.col("url_key"), F.when(F.col("priority") > 200, 0.2).otherwise(0.02))).select("url_key")


@query("""WITH e AS (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS s FROM pages)
SELECT a.page_id AS a, b.page_id AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM e a JOIN e b ON b.page_id = a.page_id + 1 WHERE len(a.s) + len(b.s) > 0""")
def link_jaccard(t):
    sets = t.pages.select("page_id", F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("s"))
    pairs = sets.select(F.col("page_id").alias("a"), F.col("s").alias("sa"), (F.col("page_id") + 1).alias("b")).join(sets.select(F.col("page_id").alias("b"), F.col("s").alias("sb")), "b")
    union = F.size(F.array_union("sa", "sb"))
    return pairs.where(union > 0).select("a", "b", F.round(F.size(F.array_intersect("sa", "sb")) / union, 6).alias("jaccard"))


@query("""WITH e AS (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS s FROM pages) SELECT page_id, sha256(array_to_string(s, chr(10))) AS digest FROM e""")
def link_set_digest(t):
    links = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))))
    return t.pages.select("page_id", F.sha2(F.array_join(links, "\n"), 256).alias("digest"))


@query()
def chunk_roots(t):
    return t.pages.select("page_id", merkle.chunk_root(F.col("html")).alias("root"))


@query(f"""WITH p AS (SELECT {_HOST} AS host FROM pages), d AS (SELECT host, {_PLD} AS pld FROM p) SELECT pld, host, count(*)::BIGINT AS pages, grouping(pld, host)::BIGINT AS level FROM d GROUP BY CUBE (pld, host)""")
def host_cube(t):
    hosts = t.pages.select(urls.host(F.col("url")).alias("host")).withColumn("pld", urls.pay_level_domain(F.col("host")))
    return hosts.cube("pld", "host").agg(F.count("*").alias("pages"), F.grouping_id().cast("long").alias("level"))


@query(WITH + " SELECT f.fetch_id, max(o.o_orderdate) AS before FROM fetches f JOIN orders o ON o.o_custkey = f.host_id WHERE o.o_orderstatus = 'F' GROUP BY f.fetch_id")
def as_of_order(t):
    from pyspark.sql import Window

    # As-of: the latest order before each fetch, by one ordered pass over the union of both.
    rows = fetches(t.events).select("host_id", "at_ms", "fetch_id", F.lit(None).cast("timestamp_ntz").alias("at"))
    past = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("host_id"), millis(F.col("o_orderdate")).alias("at_ms"), F.lit(None).cast("long").alias("fetch_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    w = Window.partitionBy("host_id").orderBy("at_ms", F.col("fetch_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.unionByName(past).withColumn("before", F.last("at", ignorenulls=True).over(w)).where("fetch_id is not null and before is not null").select("fetch_id", "before")


_BASE32 = "'0123456789ABCDEFGHJKMNPQRSTVWXYZ'"


def _base32_sql(value: str, n: int) -> str:
    return " || ".join(f"substring({_BASE32}, ((({value}) >> {5 * i}) & 31)::INTEGER + 1, 1)" for i in reversed(range(n)))


@query(f"""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, sha256(event_id::VARCHAR) AS h FROM events),
v AS (SELECT *, ('0x' || substring(h, 1, 10))::BIGINT AS a, ('0x' || substring(h, 11, 10))::BIGINT AS b FROM e)
SELECT event_id, {_base32_sql("ms", 10)} || {_base32_sql("a", 8)} || {_base32_sql("b", 8)} AS name, ms AS at_ms FROM v""")
def sortable_names(t):
    name = names.ulid(F.col("at_ms"), F.sha2(F.col("event_id").cast("string"), 256))
    return t.events.select("event_id", millis(F.col("ts")).alias("at_ms")).select("event_id", name.alias("name")).withColumn("at_ms", names.ulid_millis(F.lower("name")))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'n' WHEN 'view' THEN 'n' WHEN 'purchase' THEN 'y' END AS train_ai, CASE event_type WHEN 'click' THEN 'y' WHEN 'view' THEN 'n' END AS search,
  CASE event_type WHEN 'error' THEN 'foo=1|train-ai' WHEN 'purchase' THEN 'search=maybe' ELSE '' END AS unreadable FROM events""")
def usage_preferences(t):
    kind = F.col("event_type")
    line = F.when(kind == "click", "train-ai=n, search=y").when(kind == "view", "search=N,,train-ai=y,train-ai = n").when(kind == "error", "foo=1, train-ai").when(kind == "purchase", " Train-AI = Y ,search=maybe").otherwise("")
    return t.events.select("event_id", robots.usage(line).alias("u")).select("event_id", "u.train_ai", "u.search", F.array_join("u.unreadable", "|").alias("unreadable"))


@query("""SELECT l_orderkey AS url_key, count(DISTINCT l_suppkey)::BIGINT AS networks, CASE WHEN min(l_returnflag) <> max(l_returnflag) THEN 'replay'
  WHEN count(DISTINCT l_suppkey) >= CASE WHEN l_orderkey % 10 = 0 THEN 3 WHEN l_orderkey * 100 <= 100000 THEN 2 ELSE 1 END THEN 'quorum' ELSE 'waiting' END AS verdict FROM lineitem GROUP BY l_orderkey""")
def quorum_verdicts(t):
    size = trust.quorum_size(F.col("url_key") * 100, F.col("url_key") % 10 == 0)
    return trust.quorum(t.lineitem.withColumnRenamed("l_orderkey", "url_key"), "url_key", "l_returnflag", "l_suppkey", size)
