"""Sitemaps, feeds, seed lists, dates, chunk trees, scope."""

import pytest
from gristmill.functions import dates, merkle
from gristmill.operators import scope
from gristmill.sources import feeds
from pyspark.sql import functions as F


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("text, want", [
    ("2024", 1704067200000), ("2024-02", 1706745600000), ("2024-02-03", 1706918400000), ("2024-02-03T10:11Z", 1706955060000), ("2024-02-03T10:11:12.5+02:00", 1706947872500),
    ("2024-02-30", None), ("yesterday", None), ("", None), (None, None),
    ("Sat, 03 Feb 2024 10:11:12 GMT", 1706955072000), ("3 Feb 24 10:11 -0100", 1706958660000), ("Saturday, 03 February 2024 10:11:12 EST", 1706973072000), ("Sat, 03 Foo 2024 10:11:12 GMT", None),
])
def test_dates(spark, text, want):
    assert one(spark, text, dates.any_date) == want


def test_sitemaps(spark):
    xml = """<?xml version="1.0"?><urlset xmlns="x"><!-- <url><loc>http://no/</loc></url> --><url><loc>http://a/?x=1&amp;y=2</loc><lastmod>2024-01-01</lastmod></url>
      <url><lastmod>2024</lastmod></url><url><image:image><image:loc>http://img/</image:loc></image:image><loc><![CDATA[http://b/]]></loc></url></urlset>"""
    got = [tuple(r) for r in one(spark, xml, feeds.sitemap)]
    assert got[0] == ("http://a/?x=1&y=2", 1704067200000, False) and len(got) == 2
    assert [tuple(r) for r in one(spark, "<sitemapindex><sitemap><loc>http://a/s.xml</loc></sitemap></sitemapindex>", feeds.sitemap)] == [("http://a/s.xml", None, True)]
    assert [r["url"] for r in one(spark, "http://a/\r\nnot a url\nhttps://b/\n", feeds.sitemap)] == ["http://a/", "https://b/"]
    assert one(spark, "", feeds.sitemap) == []


def test_feeds(spark):
    rss = """<rss><channel><link>http://site/</link><item><title>x</title><guid isPermaLink="false">id-1</guid></item><item><guid>http://a/1</guid><pubDate>Sat, 03 Feb 2024 10:11:12 GMT</pubDate></item></channel></rss>"""
    assert [tuple(r) for r in one(spark, rss, feeds.feed)] == [("http://a/1", 1706955072000)]
    atom = """<feed><entry><link rel="self" href="http://no/"/><link href="http://a/2"/><published>2023-01-01</published><updated>2024-02-03</updated></entry></feed>"""
    assert [tuple(r) for r in one(spark, atom, feeds.feed)] == [("http://a/2", 1706918400000)]


def test_seeds(spark):
    lines = spark.createDataFrame([(x,) for x in ["# note", "", "http://A.org", "http://a.org/#x", "nonsense", "http://b/" + "x" * 3000]], "value string")
    assert sorted(map(tuple, feeds.seeds(lines).collect()), key=str) == sorted([("http://a.org/", None), (None, "scheme")], key=str)


@pytest.mark.parametrize("size", [0, 1, merkle.CHUNK, merkle.CHUNK + 1, 5 * merkle.CHUNK, 7 * merkle.CHUNK - 3])
def test_chunk_tree(size):
    body = bytes(i * 31 % 251 for i in range(size))
    root = merkle.levels(body)[-1][0]
    for i in range(max(1, -(-size // merkle.CHUNK))):
        chunk = body[i * merkle.CHUNK : (i + 1) * merkle.CHUNK]
        assert merkle.verify(root, i, chunk, merkle.proof(body, i))
        assert not merkle.verify(root, i, chunk + b"x", merkle.proof(body, i))


def test_chunk_root_column(spark):
    assert one(spark, "abc", merkle.chunk_root) == merkle.levels(b"abc")[-1][0].hex()
    assert one(spark, None, merkle.chunk_root) is None


def test_scope(spark):
    rows = spark.createDataFrame([("http://www.a.org/x",), ("http://b.org/private/y",), ("http://nota.org/",)], "u string")
    u = F.col("u")
    pick = lambda include, exclude: [r["u"] for r in rows.where(scope.in_scope(u, include, exclude)).collect()]
    assert pick([], []) == [r["u"] for r in rows.collect()]
    assert pick([("suffix", "a.org")], []) == ["http://www.a.org/x"]
    assert pick([], [("path", "/private"), ("host", "nota.org")]) == ["http://www.a.org/x"]
    assert pick([("pld", "b.org"), ("regex", "http://nota.*")], []) == ["http://b.org/private/y", "http://nota.org/"]
    with pytest.raises(ValueError):
        scope.matches(u, "colour", "red")
    blocks = spark.createDataFrame([("a.org",)], "domain string")
    hosts = spark.createDataFrame([("www.a.org",), ("a.org",), ("nota.org",)], "h string")
    assert sorted(r["h"] for r in scope.blocked_with_parents(hosts, "h", blocks).collect()) == ["a.org", "www.a.org"]
