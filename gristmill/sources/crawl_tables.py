"""The crawl's tables, derived from the star schema: what a ledger, hosts, fetches and segments look like to the operators.

Instants are epoch milliseconds. Timestamps without a zone are taken as UTC,
whatever the session's zone is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ledger states.
PENDING, FETCHED, FAILED = 0, 1, 2

LEDGER_SQL = """SELECT o_orderkey AS url_key, o_custkey AS host_id, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS state,
  CAST(floor(o_totalprice / 1000) AS BIGINT) AS priority, epoch_us(o_orderdate) // 1000 AS next_due_ms, CAST(left(o_orderpriority, 1) AS INTEGER) AS refresh_class FROM orders"""
HOSTS_SQL = """SELECT c_custkey AS host_id, c_nationkey AS pld_id, c_acctbal < 0 AS blocked, CAST(floor(1000 + abs(c_acctbal)) AS BIGINT) AS delay_ms, c_mktsegment AS tier FROM customer"""
FETCHES_SQL = """SELECT event_id AS fetch_id, user_id AS host_id, event_type AS outcome, epoch_us(ts) // 1000 AS at_ms, value AS latency, props FROM events"""


def millis(ts: Column) -> Column:
    local = ts.cast("timestamp_ntz")  # read by its parts, so the session's zone has no say
    days = F.datediff(local.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86_400_000 + F.hour(local) * 3_600_000 + F.minute(local) * 60_000 + F.floor(F.extract(F.lit("SECOND"), local) * 1000).cast("long")


def ledger(orders: DataFrame) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", PENDING).when(F.col("o_orderstatus") == "F", FETCHED).otherwise(FAILED)
    return orders.select(
        F.col("o_orderkey").alias("url_key"), F.col("o_custkey").alias("host_id"), state.alias("state"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("priority"), millis(F.col("o_orderdate")).alias("next_due_ms"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("refresh_class"),
    )


def hosts(customer: DataFrame) -> DataFrame:
    delay = F.floor(F.lit(1000) + F.abs("c_acctbal")).cast("long")
    return customer.select(F.col("c_custkey").alias("host_id"), F.col("c_nationkey").alias("pld_id"), (F.col("c_acctbal") < 0).alias("blocked"), delay.alias("delay_ms"), F.col("c_mktsegment").alias("tier"))


def fetches(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("fetch_id"), F.col("user_id").alias("host_id"), F.col("event_type").alias("outcome"), millis(F.col("ts")).alias("at_ms"), F.col("value").alias("latency"), "props")
