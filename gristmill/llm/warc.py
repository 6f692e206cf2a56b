"""WARC archives of pages: writing, reading back, and one merged index of all captures.

Writing. Payload digests are grouped to find, for equal payloads of a size worth
sparing, the smallest page_id; later ones become revisit records. The records
are built as strings by built-in functions and written by Spark's text writer,
whose line separator supplies a record's last line end. So archives go to
whatever file system the folder is on, under its commit protocol: a lost
executor leaves no half-written archive. A partition is one archive of about
``archive_bytes``, its records sorted by URL key, time and page id.

Reading. Each archive is inflated and parsed record by record by its own
headers; payloads are checked against their digests. Its captures are a sorted
run.

Index. Captures are dealt by ranges of (URL key, time, page id), so that a hot
URL is spread over tasks, and in each range the slices of the runs are merged by
a loser tree: the result is globally ordered, and its ``place`` counts within
the range ``part``.

Rules: a null html is an empty payload, a null url the empty target. Rows that
repeat a page_id are records of their own. A row with a null page_id is a
response, never referred to. Payloads under ``min_bytes`` are always responses.
Line ends in a URL are percent-encoded.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import durable, scratch_path
from gristmill.llm.loser_tree import merge

CAPTURE = "url_key string, captured string, page_id long, url string, record_id string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
#: The profile of a revisit to an equal payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """A sort key that keeps a host's pages together: host labels from the right, then the rest, lower-cased."""
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?(.*)$"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, parts, 1)), r"^www\.", "")
    surt = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.lower(F.regexp_extract(url, parts, 2)))
    return F.when(url.rlike(parts), surt).otherwise(F.lower(url))


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("-")), digest))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def records(pages: DataFrame, id_col: str, url_col: str, html_col: str, *, captured: str, min_bytes: int, archive_bytes: int) -> DataFrame:
    """``record``: the text of each page's WARC record, without its last line end; ordered within partitions, of which each is an archive."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), payload.alias("payload"))
    known = durable(rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes")), "payloads")
    total = known.agg(F.sum("bytes")).first()[0] or 0
    equal = known.where(f"bytes >= {min_bytes} and page_id is not null")
    firsts = equal.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    revisits = equal.join(firsts, "digest").where("page_id > first")
    # One row a page (a repeated page_id may have several payloads), so the pages are dealt by page_id once for both the join and the archives.
    of_page = revisits.groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("digest", "first"))).alias("firsts"))
    placed = rows.withColumn("digest", F.sha2("payload", 256)).repartition(int(1 + total // archive_bytes), "page_id")
    placed = placed.join(of_page, "page_id", "left").withColumn("first", F.try_element_at("firsts", F.col("digest")))
    again = F.col("first").isNotNull()
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload")))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        field("WARC-Date", F.lit(captured)),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(field("WARC-Profile", F.lit(SAME_PAYLOAD)), field("WARC-Refers-To", _record_id(F.col("first"), F.col("digest"))), field("X-Refers-To-Page", F.col("first").cast("string")))).otherwise(""),
        F.coalesce(field("X-Page", F.col("page_id").cast("string")), F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return placed.withColumn("block", block).sortWithinPartitions(url_key(F.col("url")), "page_id").select(F.concat(header, F.col("block"), F.lit("\r\n")).alias("record"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, captured: str = "2024-01-01T00:00:00Z", min_bytes: int = 100, archive_bytes: int = 32 << 20) -> None:
    """Writes gzipped WARC archives to a new folder."""
    rows = records(pages, id_col, url_col, html_col, captured=captured, min_bytes=min_bytes, archive_bytes=archive_bytes)
    rows.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers by lower-case name, block, offset, length) of every record; ValueError where the stream is no WARC archive."""
    offset = 0
    while line := stream.readline():
        start = offset
        offset += len(line)
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {start}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            offset += len(line)
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
        size = int(headers["content-length"])
        block, end = stream.read(size), stream.read(4)
        offset += len(line) + size + 4
        if len(block) != size or end != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {start} is cut short")
        yield headers, block, start, offset - start


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["captured", "page_id", "url", "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "archive", "offset", "length"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            rows = []
            for headers, block, offset, length in parse(gzip.open(io.BytesIO(content.as_buffer()))):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.decode().lower().partition("content-length: ")[2].split("\r\n")[0])
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"a payload differs from its digest: {path} at {offset}")
                rows.append((headers["warc-date"], number(headers.get("x-page")), headers["warc-target-uri"], headers["warc-record-id"], headers["warc-type"], number(headers.get("x-refers-to-page")), size, digest, path.as_py(), offset, length))
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives in a folder, as CAPTURE; payloads are verified, not returned."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(_captures, CAPTURE.partition(", ")[2])
    return found.select(url_key(F.col("url")).alias("url_key"), "*")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    part = rows.column("part")[0].as_py()
    runs: dict[str, list[int]] = {}
    for i, archive in enumerate(rows.column("archive").to_pylist()):
        runs.setdefault(archive, []).append(i)
    keys = list(zip(rows.column("url_key").to_pylist(), rows.column("captured").to_pylist(), [-1 if x is None else x for x in rows.column("page_id").to_pylist()], rows.column("offset").to_pylist()))
    lists = list(runs.values())
    order = [lists[r][i] for r, i in merge(lists, key=keys.__getitem__)]
    out = rows.take(pa.array(order, pa.int64()))
    out = out.append_column("place", pa.array(range(len(order)), pa.int64()))
    yield from out.to_batches(max_chunksize=10_000)


def merged_index(captures: DataFrame, *, rows_a_part: int = 200_000) -> DataFrame:
    """All captures, globally ordered by (URL key, time, page id): ``part`` numbers the ranges in order, ``place`` the captures in a range."""
    captures = durable(captures, "captures")
    parts = int(1 + captures.count() // rows_a_part)
    dealt = captures.repartitionByRange(parts, "url_key", "captured", "page_id", "offset").withColumn("part", F.spark_partition_id())
    runs = dealt.sortWithinPartitions("archive", "url_key", "captured", "page_id", "offset")
    return runs.mapInArrow(_merged, CAPTURE + ", part int, place long")


def archive_and_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, path: str | None = None, **options) -> DataFrame:
    """Writes the pages to archives at ``path`` (scratch space by default), reads them back and returns the merged index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, html_col, **options)
    return merged_index(read_archives(spark, path))
