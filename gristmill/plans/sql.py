"""The SQL surface: the engine's tables as views of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import urls
from gristmill.plans.registry import Tables, query
from gristmill.sources.crawl_tables import FETCHES_SQL, LEDGER_SQL, fetches, hosts, ledger


def register(spark: SparkSession, folder: str) -> None:
    """Temporary views ``pages``, ``links``, ``documents``, ``ledger``, ``hosts`` and ``fetches``. Views are plans: a query reads only the columns it names."""
    t = Tables(spark, folder)
    pages = t.pages.withColumns({"host": urls.host(F.col("url")), "url_key": urls.key(F.col("url"), 10)})
    links = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    for name, frame in {"pages": pages, "links": links, "documents": t.documents, "ledger": ledger(t.orders), "hosts": hosts(t.customer), "fetches": fetches(t.events)}.items():
        frame.createOrReplaceTempView(name)


def sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    register(spark, folder)
    return spark.sql(text)


@query(f"WITH fetches AS ({FETCHES_SQL}) SELECT outcome, count(*)::BIGINT AS n FROM fetches GROUP BY outcome")
def sql_outcome_histogram(t):
    return sql(t.spark, t.folder, "SELECT outcome, count(*) AS n FROM fetches GROUP BY outcome")


@query(f"WITH ledger AS ({LEDGER_SQL}) SELECT host_id, count(*)::BIGINT AS n FROM ledger GROUP BY host_id ORDER BY n DESC, host_id LIMIT 20")
def sql_host_top(t):
    return sql(t.spark, t.folder, "SELECT host_id, count(*) AS n FROM ledger GROUP BY host_id ORDER BY n DESC, host_id LIMIT 20")


@query(f"WITH fetches AS ({FETCHES_SQL}) SELECT host_id, fetch_id, outcome FROM fetches QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY at_ms DESC, fetch_id DESC) = 1")
def sql_latest_per_host(t):
    return sql(t.spark, t.folder, "SELECT host_id, fetch_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY at_ms DESC, fetch_id DESC) AS n FROM fetches) WHERE n = 1")
