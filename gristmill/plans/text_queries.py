"""Queries over pages, documents and events: URLs, links, sketches, sampling, schedules, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import classify, fingerprint, html, robots, schedule, urls
from gristmill.operators import clusters, folds, hamming, sampling
from gristmill.plans.registry import query
from gristmill.plans.state_queries import WITH
from gristmill.sources.crawl_tables import fetches
from gristmill.storage import durable
from gristmill.streaming import events as streams

_URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
_HOST = f"lower(regexp_extract(url, {_URL}, 2))"
_SECOND = """'co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'me.uk', 'net.uk', 'sch.uk', 'com.au', 'net.au', 'org.au', 'edu.au', 'gov.au', 'co.nz', 'org.nz', 'net.nz', 'govt.nz', 'co.jp', 'or.jp', 'ne.jp', 'ac.jp', 'go.jp',
  'com.br', 'net.br', 'org.br', 'gov.br', 'com.cn', 'net.cn', 'org.cn', 'gov.cn', 'edu.cn', 'co.in', 'net.in', 'org.in', 'gov.in', 'com.mx', 'com.ar', 'com.tr', 'com.tw', 'com.hk', 'com.sg', 'com.my', 'co.kr', 'or.kr',
  'co.za', 'org.za', 'com.pl', 'com.ua', 'co.il', 'com.vn', 'net.vn', 'org.vn', 'gov.vn', 'edu.vn'"""
_PLD = f"""CASE WHEN regexp_matches(host, '^[0-9]+(\\.[0-9]+){{3}}$') OR len(string_split(host, '.')) <= 2 THEN host
  WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({_SECOND}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END"""
_TRACK = """regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|gclid|gclsrc|dclid|wbraid|gbraid|_ga|_gl|fbclid|msclkid|twclid|igshid|yclid|ttclid|li_fat_id|epik|rdt_cid|wickedid|s_kwcid|mc_cid|mc_eid|mkt_tok|vero_id|vero_conv|_hsenc|_hsmi|oly_anon_id|oly_enc_id|at_.*|piwik_.*|pk_.*|matomo_.*|ref_src|ref_url|spm|scm|sessionid|jsessionid|phpsessid|aspsessionid.*|cfid|cftoken)$')
  OR lower(split_part(p, '=', 1)) = 'sid' AND regexp_matches(substr(p, 5), '^[A-Za-z0-9_-]{16,}$') AND regexp_matches(substr(p, 5), '[0-9]')"""


def _hrefs():
    return F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))



@query(f"SELECT page_id, lower(regexp_extract(url, {_URL}, 1)) AS scheme, {_HOST} AS host, CASE WHEN regexp_extract(url, {_URL}, 4) = '' THEN '/' ELSE regexp_extract(url, {_URL}, 4) END AS path, regexp_extract(url, {_URL}, 5) AS query FROM pages")
def url_parts(t):
    u = F.col("url")
    return t.pages.select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query_string(u).alias("query"))


@query(f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id, {_PLD} AS pld FROM h")
def registrable_domain(t):
    return t.pages.select("page_id", urls.pay_level_domain(urls.host(F.col("url"))).alias("pld"))


@query(f"""SELECT page_id, coalesce(array_to_string(list_filter(string_split(regexp_extract(url, {_URL}, 5), '&'), lambda p: p <> '' AND p[1] <> '=' AND NOT ({_TRACK})), '&'), '') AS query FROM pages""")
def query_filtered(t):
    return t.pages.select("page_id", urls.filter_query(urls.query_string(F.col("url"))).alias("query"))


@query(f"WITH h AS (SELECT page_id, url, {_HOST} AS host FROM pages), k AS (SELECT *, {_PLD} AS p FROM h) SELECT page_id, left(sha256(p), 16) AS pld, left(sha256(host), 16) AS host, left(sha256(url), 20) AS url FROM k")
def row_keys(t):
    return t.pages.select("page_id", urls.row_key(F.col("url")).alias("k")).select("page_id", "k.pld", "k.host", "k.url")


@query()
def canonical_urls(t):
    return t.pages.select("page_id", urls.canonical(F.col("url")).alias("c")).select("page_id", F.col("c.url").alias("url"), F.col("c.error").alias("error"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""")
def link_edges(t):
    return t.pages.select("page_id", _hrefs().alias("href"))


@query("""SELECT href, count(*)::BIGINT AS links, count(DISTINCT page_id)::BIGINT AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY href""")
def link_degree(t):
    return t.pages.select("page_id", _hrefs().alias("href")).groupBy("href").agg(F.count("*").alias("links"), F.count_distinct("page_id").alias("pages"))


@query(f"""WITH e AS (SELECT {_HOST} AS host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages), p AS (SELECT href, {_PLD} AS pld FROM e)
SELECT href, count(DISTINCT pld)::BIGINT AS domains, least(CAST(floor(round(log2(1 + count(DISTINCT pld)), 9)) AS BIGINT), 8) AS evidence FROM p GROUP BY href""")
def link_evidence(t):
    rows = t.pages.select(urls.pay_level_domain(urls.host(F.col("url"))).alias("pld"), _hrefs().alias("href"))
    out = rows.groupBy("href").agg(F.count_distinct("pld").alias("domains"))
    return out.withColumn("evidence", F.least(F.floor(F.round(F.log2(1 + F.col("domains")), 9)).cast("long"), F.lit(8).cast("long")))


@query("""SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \\t\\n\\f\\r]+', ' ', 'g')) AS title FROM pages WHERE regexp_matches(html, '<title>[^<&]*[^<& ][^<&]*</title>')""")
def page_title(t):
    titled = t.pages.where(F.col("html").rlike("<title>[^<&]*[^<& ][^<&]*</title>"))
    return titled.select("page_id", html.title(F.col("html"), F.col("url")).alias("title"))


@query()
def page_extract(t):
    x = t.pages.select("page_id", html.extract(F.col("html"), F.col("url")).alias("x"))
    return x.select("page_id", "x.title", "x.description", "x.lang", F.sha2("x.text", 256).alias("text_digest"), F.octet_length("x.text").alias("text_bytes"), "x.link_density", F.size("x.links").alias("links"), F.size("x.headings").alias("headings"))


@query()
def page_markdown_text(t):
    return t.pages.select("page_id", html.extract(F.col("html"), F.col("url")).alias("x")).select("page_id", "x.markdown", "x.text")


@query()
def link_graph(t):
    links = t.pages.select("page_id", F.explode(html.extract(F.col("html"), F.col("url"))["links"]).alias("l"))
    return links.select("page_id", F.col("l.href").alias("href"), F.col("l.kind").alias("kind"), F.col("l.anchor").alias("anchor"))


_CLEAN = r"trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_CLEAN}) AS digest, left(sha256({_CLEAN}), 16) AS content_hash, CASE WHEN strlen(text) = 0 THEN 0 ELSE CAST(floor(log2(strlen(text))) AS INTEGER) + 1 END AS bucket FROM documents")
def doc_digests(t):
    return t.documents.select("doc_id", fingerprint.text_digest(F.col("text")).alias("digest"), fingerprint.content_hash(F.col("text")).alias("content_hash"), fingerprint.length_bucket(F.octet_length("text")).alias("bucket"))


def _sketch_sql(columns: str) -> str:
    mins = ", ".join(f"min(({a} * h + {b}) % {fingerprint.PRIME}) AS m{i}" for i, (a, b) in enumerate(fingerprint.permutations()))
    return f"""WITH t AS (SELECT doc_id, string_split({_CLEAN}, ' ') AS t FROM documents), s AS (SELECT DISTINCT doc_id, (CAST('0x' || left(md5(array_to_string(t[i : i + 4], ' ')), 16) AS UBIGINT) % {fingerprint.PRIME})::BIGINT AS h
  FROM t, generate_series(1, greatest(len(t) - 4, 1)) g(i) WHERE t <> ['']), k AS (SELECT doc_id, {mins} FROM s GROUP BY doc_id) {columns}"""


_SLOTS = [f"m{i}" for i in range(fingerprint.SLOTS)]
_JOINED = "concat_ws(',', " + ", ".join(_SLOTS) + ")"


@query(_sketch_sql(f"SELECT doc_id, {_JOINED} AS sketch FROM k"))
def near_dup_sketch(t):
    return fingerprint.sketches(t.documents).select("doc_id", F.concat_ws(",", *[F.col(s).cast("string") for s in _SLOTS]).alias("sketch"))


_VOTES = ", ".join(f"sum(((h{w} >> {b}) & 1) * 2 - 1) AS {w}{b}" for w in "ab" for b in range(32))
_SIMHASH = f"""t AS (SELECT doc_id, string_split({_CLEAN}, ' ') AS t FROM documents), s AS (SELECT doc_id, md5(array_to_string(t[i : i + 4], ' ')) AS m FROM t, generate_series(1, len(t) - 4) g(i)),
v AS (SELECT doc_id, {_VOTES} FROM (SELECT doc_id, CAST('0x' || left(m, 8) AS BIGINT) AS ha, CAST('0x' || substr(m, 9, 8) AS BIGINT) AS hb FROM s) GROUP BY doc_id),
sim AS MATERIALIZED (SELECT doc_id, {' + '.join(f'CASE WHEN a{b} > 0 THEN {1 << b}::BIGINT ELSE 0 END' for b in range(32))} AS high, {' + '.join(f'CASE WHEN b{b} > 0 THEN {1 << b}::BIGINT ELSE 0 END' for b in range(32))} AS low FROM v)"""


@query(f"WITH {_SIMHASH} SELECT d.doc_id, coalesce(high, 0)::BIGINT AS high, coalesce(low, 0)::BIGINT AS low FROM documents d LEFT JOIN sim USING (doc_id)")
def simhashes(t):
    return fingerprint.simhashes(t.documents).select("doc_id", F.shiftrightunsigned("simhash", 32).alias("high"), F.col("simhash").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))


@query(f"""WITH {_SIMHASH}, u AS MATERIALIZED (SELECT high, low, min(doc_id) AS first, count(*)::BIGINT AS n FROM sim WHERE high + low > 0 GROUP BY high, low)
SELECT x.first AS a, y.first AS b, (bit_count(xor(x.high, y.high)) + bit_count(xor(x.low, y.low)))::INTEGER AS bits, x.n AS n_a, y.n AS n_b FROM u x JOIN u y ON x.first < y.first AND bit_count(xor(x.high, y.high)) + bit_count(xor(x.low, y.low)) <= 3""")
def simhash_pairs(t):
    return hamming.close_pairs(durable(fingerprint.simhashes(t.documents), "simhashes"))


_BANDS = " UNION ALL ".join(f"SELECT doc_id, md5(concat_ws(',', {b}, {', '.join(_SLOTS[b * 8 : b * 8 + 8])})) AS band FROM k" for b in range(8))


@query(_sketch_sql(_BANDS))
def near_dup_bands(t):
    made = fingerprint.sketches(t.documents)
    return made.select("doc_id", F.explode(F.array(*fingerprint.band_keys([F.col(s) for s in _SLOTS]))).alias("band"))


_SHARED = " + ".join(f"CASE WHEN x.m{i} = y.m{i} THEN 1 ELSE 0 END" for i in range(64))


_REPS = f", m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_JOINED}) AS rep FROM k)"


@query(_sketch_sql(f""", m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_CLEAN}) AS rep FROM documents WHERE {_CLEAN} <> ''), b AS ({_BANDS}), r AS (SELECT b.* FROM b JOIN m USING (doc_id) WHERE doc_id = rep),
p AS (SELECT DISTINCT l.doc_id AS a, r.doc_id AS b FROM r l JOIN r USING (band) WHERE l.doc_id < r.doc_id)
SELECT p.a, p.b, {_SHARED} AS shared FROM p JOIN k x ON x.doc_id = p.a JOIN k y ON y.doc_id = p.b UNION ALL SELECT rep, doc_id, {fingerprint.SLOTS} FROM m WHERE doc_id > rep"""))
def near_dup_pairs(t):
    """Pairs of different texts, and of each text's first document with its other copies."""
    return clusters.near_pairs(t.documents)


@query(_sketch_sql(f"{_REPS} SELECT doc_id, rep FROM m"))
def near_dup_members(t):
    return clusters.near_candidates(t.documents)[1]


@query(f"""WITH t AS (SELECT 'd' AS kind, doc_id AS id, string_split({_CLEAN}, ' ') AS t FROM documents UNION ALL SELECT 'b', item_id, string_split({_CLEAN}, ' ') FROM benchmark),
s AS (SELECT DISTINCT kind, id, md5(array_to_string(t[i : i + 4], ' ')) AS h FROM t, generate_series(1, len(t) - 4) g(i) WHERE len(t) >= 5)
SELECT d.id AS doc_id, b.id AS item_id, count(*)::BIGINT AS shared FROM s d JOIN s b USING (h) WHERE d.kind = 'd' AND b.kind = 'b' GROUP BY ALL HAVING count(*) >= 3""")
def contamination_pairs(t):
    return clusters.shared_shingles(t.documents, t.benchmark.select("item_id", "text"), 3)


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(ltrim(left(html, 1445))), '^<(!doctype html|html|head|body|title|meta|script|div|p|h1|table|a |!--)') THEN 'html' ELSE 'text' END AS media FROM pages""")
def media_sniff(t):
    return t.pages.select("page_id", classify.media(F.lit("text/plain; charset=utf-8"), F.col("html")).alias("media"))


_ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /*?page=\nAllow: /*ref=x$\nDisallow: /private/ # all of it\n"


@query()
def robots_allowed(t):
    path = urls.robots_path(F.col("url"))
    return t.pages.select("page_id", path.alias("path"), robots.allows(robots.rules(F.lit(_ROBOTS), "gristmill"), path).alias("allowed"))


_OBSERVED = """, s AS (SELECT host_id, count(*) AS n, max(at_ms) - min(at_ms) AS o FROM fetches GROUP BY host_id), x AS (SELECT host_id, count(*) FILTER (outcome <> b) AS x FROM
  (SELECT *, lag(outcome) OVER (PARTITION BY host_id ORDER BY at_ms, fetch_id) AS b FROM fetches) GROUP BY host_id)"""


@query(WITH + _OBSERVED + """, i AS (SELECT host_id, greatest(x - 1, 0)::DOUBLE AS x, n::DOUBLE AS n, o FROM s JOIN x USING (host_id)),
r AS (SELECT host_id, CASE WHEN o <= 0 OR n < 2 THEN 86400000.0 WHEN x = 0 THEN 2.0 * o ELSE 0.5 / (-ln((n - x + 0.5) / (n + 0.5)) * n / o) END AS g FROM i)
SELECT host_id, CASE WHEN least(greatest(g, 300000), 15552000000) < 3600000 THEN 'realtime' WHEN g < 21600000 THEN 'hourly' WHEN g < 259200000 THEN 'daily' WHEN g < 2592000000 THEN 'weekly' ELSE 'dormant' END AS class FROM r""")
def refresh_class(t):
    from gristmill.operators.state import changes

    rows = fetches(t.events)
    seen = changes(rows, "host_id", "outcome", "at_ms", "fetch_id").join(rows.groupBy("host_id").agg((F.max("at_ms") - F.min("at_ms")).alias("observed")), "host_id")
    return seen.select("host_id", schedule.refresh_class(schedule.refresh_interval_ms(F.col("fetches"), F.col("changes"), F.col("observed"))).alias("class"))


@query(WITH + """ SELECT host_id, round(list_reduce(list_prepend(1000.0::DOUBLE, list(CASE outcome WHEN 'error' THEN 2.0 ELSE 0.9 END::DOUBLE ORDER BY at_ms, fetch_id)), lambda d, f: least(greatest(d * f, 1000.0), 60000.0)), 3) AS delay_ms FROM fetches GROUP BY host_id""")
def pacing_fold(t):
    rows = fetches(t.events)
    factor = F.when(F.col("outcome") == "error", 2.0).otherwise(0.9)
    out = folds.clamped_products(rows, "host_id", F.floor(F.col("at_ms") / 3_600_000), ["at_ms", "fetch_id"], factor, start=1000, low=1000, high=60_000)
    return out.select("host_id", F.round("value", 3).alias("delay_ms"))


@query(WITH + """, n AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY at_ms, fetch_id) AS k FROM fetches), g AS (SELECT *, max(at_ms - k * 7200000) OVER (PARTITION BY host_id ORDER BY k) + (k + 1) * 7200000 AS tat FROM n)
SELECT fetch_id, tat::BIGINT AS tat_ms, tat - at_ms <= 7200000 * 5 AS passes FROM g""")
def gate_gcra(t):
    return folds.arrival_gate(fetches(t.events), "host_id", ["at_ms", "fetch_id"], "at_ms", 7_200_000, 5).select("fetch_id", "tat_ms", "passes")


@query(WITH + " SELECT host_id, arg_max(outcome, (at_ms, fetch_id)) AS outcome, max(at_ms)::BIGINT AS at_ms FROM fetches GROUP BY host_id")
def latest_wins(t):
    rows = fetches(t.events).select("host_id", "at_ms", "fetch_id", "outcome")
    return folds.latest_wins(rows.where("outcome in ('view', 'click')"), rows.where("outcome not in ('view', 'click')"), "host_id", "at_ms", "fetch_id").select("host_id", "outcome", "at_ms")


@query(WITH + """ SELECT fetch_id, CASE WHEN s > 0 THEN round((latency - m) / s, 4) ELSE 0.0 END AS z FROM fetches JOIN (SELECT host_id, avg(latency) AS m, stddev_pop(latency) AS s FROM fetches GROUP BY host_id) USING (host_id) WHERE abs((latency - m) / s) > 2.5""")
def implausible(t):
    return folds.plausibility(fetches(t.events), "host_id", "latency", beyond=2.5).select("fetch_id", "z")


_INDEX = """r AS (SELECT c_custkey AS domain, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), st(stratum, lo, hi0) AS (VALUES ('head', 1, 100), ('middle', 101, 600), ('tail', 601, NULL)),
s AS (SELECT stratum, lo, coalesce(hi0, (SELECT max(rank) FROM r)) AS hi FROM st), d AS (SELECT domain, rank, stratum FROM r JOIN s ON rank BETWEEN lo AND hi WHERE (rank - lo) % greatest((hi - lo + 1) // 40, 1) = 0)"""


def _domains(t):
    ranked = sampling.global_rank(t.customer.select(F.col("c_custkey").alias("domain"), "c_acctbal"), F.desc("c_acctbal"), F.asc("domain"))
    last = t.customer.count()
    return sampling.systematic(ranked, sampling.strata(t.spark, [("head", 1, 100), ("middle", 101, 600), ("tail", 601, None)], last), "rank", 40).select("domain", "rank", "stratum")


@query(f"WITH {_INDEX} SELECT domain, rank::BIGINT AS rank, stratum FROM d")
def stratified_sample(t):
    return _domains(t)


_PICKS = f"""{_INDEX}, p AS (SELECT o_orderkey AS url, domain, stratum, row_number() OVER (PARTITION BY domain ORDER BY md5(o_orderkey::VARCHAR)) AS pick FROM orders JOIN d ON o_custkey = domain WHERE o_orderstatus <> 'P')"""


def _picks(t):
    rows = t.orders.where("o_orderstatus <> 'P'").join(_domains(t), F.col("o_custkey") == F.col("domain"))
    return sampling.picks(rows.select(F.col("o_orderkey").alias("url"), "domain", "stratum", F.md5(F.col("o_orderkey").cast("string")).alias("h")), "domain", "h", 5)


@query(f"WITH {_PICKS} SELECT url, domain, stratum, pick::INTEGER AS pick FROM p WHERE pick <= 5")
def per_domain_pick(t):
    return _picks(t).select("url", "domain", "stratum", "pick")


@query(f"WITH {_PICKS}, x AS (SELECT url, stratum, row_number() OVER (PARTITION BY stratum ORDER BY pick, md5(url::VARCHAR)) AS place FROM p WHERE pick <= 5) SELECT url, stratum, place::INTEGER AS place FROM x WHERE place <= 60")
def round_robin_trim(t):
    return sampling.round_robin(_picks(t), "stratum", "h", 60).select("url", "stratum", "place")


@query(f"WITH {_PICKS} SELECT stratum, count(*)::BIGINT AS urls, count(DISTINCT domain)::BIGINT AS domains, min(rank)::BIGINT AS least, max(rank)::BIGINT AS most FROM p JOIN d USING (domain, stratum) WHERE pick <= 5 GROUP BY stratum")
def stratum_report(t):
    rows = _picks(t).join(_domains(t), ["domain", "stratum"])
    return rows.groupBy("stratum").agg(F.count("*").alias("urls"), F.count_distinct("domain").alias("domains"), F.min("rank").alias("least"), F.max("rank").alias("most"))


@query("SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY md5(html) ORDER BY url) AS n FROM pages WHERE html <> '') WHERE n = 1 ORDER BY url LIMIT 100")
def golden_corpus(t):
    first = t.pages.where("html <> ''").groupBy(F.md5("html").alias("h")).agg(F.min(F.struct("url", "page_id")).alias("x"))
    return first.select("x.page_id", "x.url").orderBy("url").limit(100)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(t):
    return streams.tumbling(t.events, "1 hour", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT s AS start, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE,
  time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS s FROM events) GROUP BY s""")
def events_sliding(t):
    return streams.sliding(t.events, "1 hour", "15 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) SELECT min(ts) AS start, user_id, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM k GROUP BY user_id, s""")
def events_session(t):
    return streams.sessions(t.events, "6 hours", "user_id").withColumn("start", F.col("start").cast("timestamp_ntz"))
