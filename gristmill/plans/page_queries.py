"""Queries over the node rows of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import jsonld
from gristmill.operators import content, proofs, traps
from gristmill.plans.registry import query
from gristmill.storage import durable


@query()
def page_root(t):
    return content.content_roots(content.page_nodes(t.pages))


@query()
def page_content(t):
    rows = durable(content.page_nodes(t.pages), "nodes")
    return content.root_texts(rows, content.content_roots(rows)).withColumn("text_digest", F.sha2("text", 256))


_PIECE = 256


@query(f"""WITH RECURSIVE b AS (SELECT page_id, hex(encode(html)) AS x FROM pages WHERE html IS NOT NULL), c AS (SELECT page_id, i AS leaf, substr(x, 1 + {2 * _PIECE} * i, {2 * _PIECE}) AS chunk, greatest((len(x) // 2 + {_PIECE - 1}) // {_PIECE}, 1) AS width
  FROM b, generate_series(0, greatest((len(x) // 2 + {_PIECE - 1}) // {_PIECE}, 1) - 1) g(i)),
n AS (SELECT page_id, 0 AS level, leaf AS i, sha256(unhex('00' || chunk)) AS d, width FROM c UNION ALL
  SELECT page_id, level + 1, i // 2, CASE WHEN count(*) = 2 THEN sha256(unhex('01' || min_by(d, i) || max_by(d, i))) ELSE min(d) END, (width + 1) // 2 FROM n WHERE width > 1 GROUP BY page_id, level, i // 2, width),
s AS (SELECT c.page_id, c.leaf, count(*) AS steps, sha256(string_agg(n.d, ',' ORDER BY n.level)) AS path_sha256 FROM c JOIN n ON n.page_id = c.page_id AND n.width > 1 AND n.i = xor(c.leaf >> n.level, 1) GROUP BY ALL)
SELECT c.page_id, c.leaf::BIGINT AS leaf, r.d AS root, coalesce(steps, 0)::INTEGER AS steps, coalesce(path_sha256, sha256('')) AS path_sha256, true AS proven, true AS refused
FROM c JOIN n r ON r.page_id = c.page_id AND r.width = 1 LEFT JOIN s ON s.page_id = c.page_id AND s.leaf = c.leaf""")
def chunk_proofs(t):
    """Every leaf of every page with its proof: the proof holds, and not for a leaf that was tampered with."""
    leaves = durable(proofs.chunks(t.pages, size=_PIECE).withColumn("digest", proofs.leaf_digest(F.col("chunk"))), "chunks")
    levels = proofs.tree_levels(leaves)
    rows = proofs.proofs(levels).join(leaves, ["page_id", "leaf"]).join(proofs.roots(levels), "page_id")
    holds = lambda digest: proofs.proves(F.col("root"), F.col("leaf"), F.col("width"), digest, F.col("path"))
    path = F.transform("path", lambda x: F.lower(F.hex(x)))
    return rows.select(
        "page_id", "leaf", F.lower(F.hex("root")).alias("root"), F.size("path").alias("steps"), F.sha2(F.array_join(path, ","), 256).alias("path_sha256"),
        holds(F.col("digest")).alias("proven"), (~holds(proofs.leaf_digest(F.concat("chunk", F.lit("x").cast("binary"))))).alias("refused"),
    )


@query("""WITH x AS (SELECT page_id, html IS NOT NULL AS has, url, trim(regexp_replace(regexp_extract(html, '<title>([^<&]*)</title>', 1), '[ \t\n\f\r]+', ' ', 'g')) AS t FROM pages)
SELECT page_id, CASE WHEN has THEN 'WebPage,NewsArticle,Person' ELSE '' END AS types, CASE WHEN has AND t <> '' THEN left(t, list_max(list_filter(range(0, 129), lambda k: strlen(left(t, k)) <= 128))) END AS headline,
CASE WHEN has THEN left(url, list_max(list_filter(range(0, 129), lambda k: strlen(left(url, k)) <= 128))) END AS author, CASE WHEN has THEN '2024-01-02' END AS published FROM x""")
def page_json_ld(t):
    """Structured data of pages that carry a block made from their own title and url, beside what else they have."""
    title = F.regexp_extract("html", "<title>([^<&]*)</title>", 1)
    typed = lambda name, *more: F.struct(F.lit(name).alias("@type"), *more)
    author = F.array(F.to_variant_object(typed("Person")), F.to_variant_object(typed("Person", F.col("url").alias("name")))).alias("author")
    article = F.struct(F.array(F.lit("NewsArticle"), F.lit("WebPage")).alias("@type"), title.alias("headline"), F.lit("2024-01-02").alias("datePublished"), author)
    block = F.to_json(typed("WebPage", F.array(F.to_variant_object(article), F.to_variant_object(typed("Person"))).alias("@graph")))
    marked = F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script>"), "html")
    found = t.pages.select("page_id", jsonld.structured(jsonld.objects(jsonld.blocks(marked))).alias("s"))
    return found.select("page_id", F.array_join("s.types", ",").alias("types"), "s.headline", "s.author", "s.published")


_PATHS = """WITH u AS (SELECT DISTINCT 'h' || o_custkey % 40 AS host, CASE WHEN o_orderstatus = 'F' THEN '/s/' || left(md5(o_orderkey::VARCHAR), 16) || '/' || o_orderpriority ELSE '/item/' || o_orderkey END AS path FROM orders),
t AS (SELECT host, path, string_split(path, '/') AS t FROM u), p AS (SELECT host, path, i, array_to_string(list_transform(t, lambda s, k: CASE WHEN k = i THEN '*' ELSE s END), '/') AS hole
  FROM t, generate_series(1, len(t)) g(i) WHERE len(t[i]) >= 8 AND round(list_aggregate(string_split(t[i], ''), 'entropy'), 9) >= 2.75),
w AS (SELECT host, path, list(i) AS holes FROM (SELECT *, count(*) OVER (PARTITION BY host, i, hole) AS n FROM p) WHERE n >= 2 GROUP BY host, path),
f AS (SELECT host, path, array_to_string(list_transform(t, lambda s, k: CASE WHEN list_contains(coalesce(holes, []), k) THEN '*' ELSE s END), '/') AS pattern FROM t LEFT JOIN w USING (host, path))"""


def _crawled(t):
    """Paths of a shop whose finished orders carry a session identifier."""
    session = F.concat(F.lit("/s/"), F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 16), F.lit("/"), "o_orderpriority")
    path = F.when(F.col("o_orderstatus") == "F", session).otherwise(F.concat(F.lit("/item/"), F.col("o_orderkey").cast("string")))
    return t.orders.select(F.concat(F.lit("h"), (F.col("o_custkey") % 40).cast("string")).alias("host"), path.alias("path"))


@query(f"{_PATHS} SELECT host, pattern, count(*)::BIGINT AS paths FROM f GROUP BY host, pattern")
def trap_patterns(t):
    return traps.wildcard_paths(_crawled(t)).groupBy("host", "pattern").agg(F.count("*").alias("paths"))


@query(f"""{_PATHS} SELECT host, array_to_string(string_split(pattern, '/')[1:3], '/') AS prefix, count(*)::BIGINT AS urls, count(DISTINCT pattern)::BIGINT AS patterns, count(*) > 30 AS over FROM f GROUP BY ALL""")
def trap_prefixes(t):
    return traps.prefixes(traps.wildcard_paths(_crawled(t)), budget=30)
