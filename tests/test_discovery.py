"""Sitemap discovery against a queue walked one document at a time."""

import random

import pytest
from gristmill.operators import discovery
from pyspark.sql import functions as F

ORIGIN = "https://example.com"


def index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def walk(starts, files, nested, depth=3, max_files=10**6, max_urls=10**6, own=None):
    """The rule as a loop: one queue, a visited set, caps asked before each document."""
    queue, visited, cursor = [], set(), 0

    def push(url, d):
        if url not in visited:
            visited.add(url)
            queue.append((url, d))

    for _, url in sorted(starts):
        push(url, 0)
    n, urls, out = 0, 0, []
    report = dict(files=0, urls=0, off_origin=0, disallowed=0, missing=0, truncated=False)
    while cursor < len(queue):
        url, d = queue[cursor]
        if n >= max_files or urls >= max_urls:
            report["truncated"] = True
            break
        cursor += 1
        if not own(url):
            report["off_origin"] += 1
            continue
        if url in files and not files[url][1]:
            report["disallowed"] += 1
            continue
        if url not in files:
            report["missing"] += 1
            continue
        n += 1
        out.append(url)
        if d < depth:
            for target in nested.get(url, ()):
                push(target, d + 1)
        take = min(files[url][0], max_urls - urls)
        report["truncated"] |= take < files[url][0]
        urls += take
    return {**report, "files": n, "urls": urls}, out


def found(spark, bodies, starts=(f"{ORIGIN}/sitemap.xml",), allowed=None, **caps):
    files, nested = discovery.sitemap_files(spark.createDataFrame(list(bodies.items()), "url string, body string"))
    if allowed is not None:
        files = files.withColumn("allowed", ~F.col("file").isin(allowed))
    first = spark.createDataFrame([(ORIGIN, i, u) for i, u in enumerate(starts)], "origin string, place int, file string")
    rows = discovery.discover(first, files, nested, **caps)
    report = discovery.discovery_report(rows).drop("origin").collect()
    return (report[0].asDict() if report else {}), {r["file"]: (r["depth"], r["fate"]) for r in rows.collect()}


def test_an_index_is_followed_to_the_depth_and_no_further(spark):
    chain = {f"{ORIGIN}/sitemap.xml": index(f"{ORIGIN}/i1.xml")} | {f"{ORIGIN}/i{k}.xml": index(f"{ORIGIN}/i{k + 1}.xml") for k in range(1, 4)}
    report, files = found(spark, chain | {f"{ORIGIN}/i4.xml": urlset(f"{ORIGIN}/buried")})
    assert (report["files"], report["urls"], report["truncated"]) == (4, 0, False) and f"{ORIGIN}/i4.xml" not in files


def test_two_indexes_that_point_at_each_other(spark):
    report, files = found(spark, {f"{ORIGIN}/sitemap.xml": index(f"{ORIGIN}/other.xml"), f"{ORIGIN}/other.xml": index(f"{ORIGIN}/sitemap.xml", f"{ORIGIN}/other.xml")})
    assert report["files"] == 2 and {d for d, _ in files.values()} == {0, 1}


def test_other_origins_robots_feeds_and_missing_files(spark):
    feed = "<rss><channel><item><link>https://example.com/n1</link></item><item><link>https://example.com/n2</link></item></channel></rss>"
    bodies = {f"{ORIGIN}/sitemap.xml": index("https://cdn.example.net/s.xml", f"{ORIGIN}/no.xml", f"{ORIGIN}/feed.xml", f"{ORIGIN}/gone.xml"), "https://cdn.example.net/s.xml": urlset("x"), f"{ORIGIN}/no.xml": urlset("x"), f"{ORIGIN}/feed.xml": feed}
    report, _ = found(spark, bodies, allowed=[f"{ORIGIN}/no.xml"])
    assert report == dict(files=2, urls=2, off_origin=1, disallowed=1, missing=1, truncated=False)
    assert found(spark, {"https://x.org/": ""}, starts=())[0] == {}
    assert found(spark, {f"{ORIGIN}/sitemap.xml": "not a sitemap"})[0]["files"] == 1


def test_caps_stop_the_walk_and_say_so(spark):
    bodies = {f"{ORIGIN}/sitemap.xml": index(*[f"{ORIGIN}/s{k}.xml" for k in range(4)])} | {f"{ORIGIN}/s{k}.xml": urlset(*[f"{ORIGIN}/{k}/{i}" for i in range(3)]) for k in range(4)}
    assert found(spark, bodies)[0] == dict(files=5, urls=12, off_origin=0, disallowed=0, missing=0, truncated=False)
    report, files = found(spark, bodies, max_urls=5)
    assert (report["files"], report["urls"], report["truncated"]) == (3, 5, True) and files[f"{ORIGIN}/s2.xml"] == (1, "capped")
    report, _ = found(spark, bodies, max_files=2)
    assert (report["files"], report["urls"], report["truncated"]) == (2, 3, True)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    origins, files, edges, starts = ["a", "b", "c"], {}, {}, {}
    names = [f"{r.choice(origins)}{k}" for k in range(60)]
    for n in names:
        if r.random() < 0.85:
            files[n] = (r.randint(0, 9), r.random() < 0.9)
            edges[n] = [r.choice(names) for _ in range(r.choice([0, 0, 1, 2, 4]))]
    for o in origins:
        starts[o] = [(p, r.choice([n for n in names if n[0] == o])) for p in range(3)]
    tables = (
        spark.createDataFrame([(o, p, f) for o, x in starts.items() for p, f in x], "origin string, place int, file string"),
        spark.createDataFrame([(f, n, ok) for f, (n, ok) in files.items()], "file string, n_urls long, allowed boolean"),
        spark.createDataFrame([(f, p, t) for f, x in edges.items() for p, t in enumerate(x)], "file string, place int, target string"),
    )
    for depth, max_files, max_urls in ((3, 10**6, 10**6), (2, 5, 10**6), (3, 10**6, 20)):
        rows = discovery.discover(*tables, max_depth=depth, max_files=max_files, max_urls=max_urls, same_origin=F.substring("file", 1, 1) == F.col("origin"))
        got = {x["origin"]: x for x in discovery.discovery_report(rows).collect()}
        order = {o: [x["file"] for x in rows.where(f"origin = '{o}' AND fate = 'fetched'").orderBy("position").collect()] for o in origins}
        for o in origins:
            report, walked = walk(starts[o], files, edges, depth, max_files, max_urls, lambda u: u[0] == o)  # noqa: B023
            assert {k: got[o][k] for k in report} == report and order[o] == walked
