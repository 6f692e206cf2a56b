"""Scalar functions on small tables of cases."""

import pytest
from gristmill.functions import classify, html, names, robots, schedule, urls
from pyspark.sql import functions as F


def values(spark, rows, schema, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    "url, want, error",
    [
        ("HTTP://Example.COM:80", "http://example.com/", None),
        ("https://example.com:8443/a/./b/../c", "https://example.com:8443/a/c", None),
        ("http://u:p@example.com/%7euser/%2f?b=%41&utm_source=x&a=1&&fbclid=2#top", "http://example.com/~user/%2F?b=A&a=1", None),
        ("http://example.com/x;jsessionid=AB12/y?sid=abcdef0123456789abcd&sid=short", "http://example.com/x/y?sid=short", None),
        ("http://example.com/100%", "http://example.com/100%25", None),
        ("http://example.com/../..", "http://example.com/", None),
        ("ftp://example.com/", None, "scheme"),
        ("http:///x", None, "host"),
        ("  ", None, "empty"),
        (None, None, "empty"),
    ],
)
def test_canonical(spark, url, want, error):
    assert values(spark, [(url,)], "u string", urls.canonical(F.col("u"))) == [(want, error)]


def test_domains(spark):
    rows = [("www.a.co.uk",), ("a.b.example.com",), ("localhost",), ("10.0.0.1",)]
    assert values(spark, rows, "h string", urls.pay_level_domain(F.col("h"))) == ["a.co.uk", "example.com", "localhost", "10.0.0.1"]
    assert values(spark, rows[1:2], "h string", urls.parent_domains(F.col("h"))) == [["a.b.example.com", "b.example.com", "example.com", "com"]]


ROBOTS = """User-agent: other
Disallow: /

user-agent: me   # a note
User-agent: you
Disallow: /a
Allow: /a/b$
Disallow: /*.pdf
Crawl-delay: 2.5

User-agent: me
Allow: /a/c
Sitemap: http://x/s.xml

User-agent: *
Disallow: /star
"""


@pytest.mark.parametrize("agent, path, want", [
    ("me", "/a", False), ("me", "/a/b", True), ("me", "/a/bc", False), ("me", "/a/c", True), ("me", "/x.pdf", False), ("me", "/star", True),
    ("YOU", "/a/c", False), ("other", "/", False), ("new", "/star/x", False), ("new", "/a", True),
])
def test_robots(spark, agent, path, want):
    assert values(spark, [(ROBOTS, path)], "t string, p string", robots.allows(robots.rules(F.col("t"), agent), F.col("p"))) == [want]


def test_robots_parts(spark):
    t = F.col("t")
    assert values(spark, [(ROBOTS,), ("",), (None,)], "t string", robots.crawl_delay_ms(t)) == [2500, None, None]
    assert values(spark, [(ROBOTS,)], "t string", robots.sitemaps(t)) == [["http://x/s.xml"]]
    assert values(spark, [(None,), ("Disallow: /",)], "t string", robots.allows(robots.rules(t, "me"), F.lit("/"))) == [True, True]
    assert values(spark, [(200,), (404,), (429,), (503,), (301,)], "s int", robots.policy(F.col("s"))) == ["parse", "allow", "disallow", "disallow", "disallow"]


def test_classify(spark):
    rows = [("text/plain", "  <!DOCTYPE html>"), ("text/html; x", "hello"), ("application/json", "%PDF-1.4"), ("application/atom+xml", "x"), (None, "?"), ("Application/JSON", "{}")]
    assert values(spark, rows, "d string, b string", classify.media(F.col("d"), F.col("b"))) == ["html", "html", "pdf", "xml", "unknown", "json"]
    assert values(spark, [(200,), (304,), (410,), (429,), (503,), (302,)], "s int", classify.status_class(F.col("s"))) == ["ok", "not_modified", "gone", "rate_limited", "server_error", "malformed"]
    assert values(spark, [("90s",), ("2h",), ("x",), ("5",)], "t string", classify.duration_ms(F.col("t"))) == [90_000, 7_200_000, None, None]
    assert values(spark, [("en-GB",), ("EN_us",), ("english",), (None,)], "t string", classify.language_code(F.col("t"))) == ["en", "en", None, None]
    assert values(spark, [("Just a moment...", 5), ("Just a moment...", 500)], "b string, n int", classify.challenge(F.col("b"), F.col("n"))) == ["cloudflare", None]
    assert values(spark, [("120",), ("99999999",), ("soon",)], "v string", classify.retry_after_ms(F.col("v"))) == [120_000, 86_400_000, None]


def test_schedule(spark):
    rows = [(1, 0, 0), (100, 1, 10**9), (100, 90, 10**8), (2, 2, 10**12)]
    got = values(spark, rows, "n long, x long, o long", schedule.refresh_interval_ms(F.col("n"), F.col("x"), F.col("o")))
    assert got[0] == schedule.FIRST and got[1] == 2 * 10**9 and schedule.LEAST <= got[2] < 10**6 and got[3] <= schedule.MOST
    assert values(spark, [(1,), (3,), (99,), (0,)], "s int", schedule.retry_ms(F.col("s"))) == [60_000, 1_500_000, 86_400_000, 60_000]
    assert values(spark, [(10,), (10**10,), (None,)], "i long", schedule.refresh_class(F.col("i"))) == ["realtime", "dormant", "discovery"]
    assert values(spark, [(5,), (0,), (1,)], "p int", schedule.quota(50, F.col("p"))) == [2, 0, 1]


PAGE = """<!doctype html><html lang=en-GB><head><title> A  page
</title><base href="/dir/"><meta name=description content="What it says"><link rel=canonical href="/c"><link rel=alternate type=application/rss+xml href=feed.xml>
<script>var x = "</p><a href='/no'>";</script></head><body><nav><a href=/home>Home</a></nav><article><h1>Top &amp; more</h1><p>First <b>bold</b> and <a href="x?y=1#z" rel="nofollow">a link</a>
<p>Second<ul><li>one<li>two <ol><li>deep</ol></ul><pre class="language-py">a  b
  c</pre><table><tr><td>1<td>2</table></article><footer>foot <a href="mailto:x">m</a></footer></body>"""


def test_html():
    title, description, lang, canonical, markdown, text, noindex, nofollow, density, headings, links, feeds = html.extract_page(PAGE, "http://h.org/q")
    assert (title, description, lang, canonical, feeds) == ("A page", "What it says", "en-GB", "http://h.org/c", ["http://h.org/dir/feed.xml"])
    assert headings == [(1, "Top & more")] and not noindex and not nofollow and 0 < density < 50
    assert links == [("http://h.org/home", "Home", "nav", ""), ("http://h.org/dir/x?y=1", "a link", "body", "nofollow")]
    assert "# Top & more" in markdown and "First **bold** and [a link](http://h.org/dir/x?y=1)" in markdown
    assert "- one" in markdown and "1. deep" in markdown and "```py\na  b\n  c\n```" in markdown
    assert "foot" not in markdown and "var x" not in markdown and "Home" not in markdown
    assert text.startswith("Top & more First bold and a link Second") and "*" not in text


def test_html_limits():
    assert html.extract_page(None, None)[4] == ""
    hidden = html.extract_page("<meta name=robots content='noindex, nofollow'><title>t</title><p>x <a href='http://a.org/'>l</a>", "http://h.org/")
    assert hidden[0] is None and hidden[4] is None and hidden[6] and hidden[7] and len(hidden[10]) == 1
    deep = html.extract_page("<div>" * 5000 + "x" + "</div>" * 5000, "http://h.org/")
    assert deep[4] == "x"
    assert html.cut("aé", 2) == "a"


def test_html_in_spark(spark):
    df = spark.createDataFrame([(PAGE, "http://h.org/q"), (None, None)], "h string, u string").repartition(1)
    got = df.select(html.extract(F.col("h"), F.col("u")).alias("x")).select("x.title", F.size("x.links")).collect()
    assert sorted(map(tuple, got), key=str) == [("A page", 2), (None, 0)]


def test_usage_preferences(spark):
    cases = {"train-ai=n": ("n", None, []), "search=Y , train-ai=y,train-ai=n": ("n", "y", []), "a=b=c, a=b=c,search": (None, None, ["a=b=c", "search"]), "": (None, None, []), ",".join(f"k{i}" for i in range(10)): (None, None, [f"k{i}" for i in range(8)])}
    got = spark.createDataFrame([(c,) for c in cases], "c string").select("c", robots.usage(F.col("c")).alias("u")).collect()
    assert {r["c"]: (r["u"]["train_ai"], r["u"]["search"], r["u"]["unreadable"]) for r in got} == cases


def test_names(spark):
    rows = [(0, "0" * 20), (1_700_000_000_123, "0123456789abcdef0123"), ((1 << 48) - 1, "f" * 20)]
    got = spark.createDataFrame(rows, "ms long, h string").select("ms", "h", names.ulid(F.col("ms"), F.col("h")).alias("t")).withColumn("back", names.ulid_millis(F.lower("t"))).collect()
    for r in got:
        number, text = r["ms"] << 80 | int(r["h"], 16), ""
        for _ in range(26):
            number, digit = divmod(number, 32)
            text = names.ALPHABET[digit] + text
        assert (r["t"], r["back"]) == (text, r["ms"])
    bad = spark.createDataFrame([("8" + "0" * 25,), ("0" * 25,), ("0" * 25 + "I",), (None,)], "t string")
    assert [r[0] for r in bad.select(names.ulid_millis(F.col("t"))).collect()] == [None] * 4
