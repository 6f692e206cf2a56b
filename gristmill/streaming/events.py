"""Event streams: windows with watermarks, first sightings, idempotent sinks, pacing state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, width: str, *keys: str, late: str | None = None) -> DataFrame:
    """Counts and sums per window of ``ts``; on a stream, ``late`` is how long late rows are waited for."""
    rows = events.withWatermark("ts", late) if late else events
    return _named(rows.groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")), keys)


def sliding(events: DataFrame, width: str, slide: str, *keys: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return _named(rows.groupBy(F.window("ts", width, slide), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")), keys)


def sessions(events: DataFrame, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Runs of a key's events with no gap as long as ``gap``."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.session_window("ts", gap).alias("window"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return _named(out, (key,))


def _named(out: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    # In a stream the window's instants have the session's zone; batch sources without one stay without.
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total")


def first_sightings(events: DataFrame, key: str, late: str) -> DataFrame:
    """The first row of each key within the watermark; state is let go as it passes."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def pace(key: str, start_ms: float = 1000.0, most_ms: float = 60_000.0):
    """A stateful function for ``applyInPandasWithState``: a host's delay after each batch of its answers, errors doubling it and others easing it by a tenth."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        delay, last = state.get if state.exists else (start_ms, 0)
        # A key's rows of a micro-batch may come in several Arrow batches, in any order.
        rows = pd.concat([b[["at_ms", "event_id", "event_type"]] for b in batches]).sort_values(["at_ms", "event_id"])
        for at, kind in rows[["at_ms", "event_type"]].itertuples(index=False):
            if at >= last:  # an answer from before the last one counted changes nothing
                delay, last = min(max(delay * (2.0 if kind == "error" else 0.9), start_ms), most_ms), int(at)
        state.update((delay, last))
        yield pd.DataFrame({key: [keys[0]], "delay_ms": [delay], "last_ms": [last]})

    return step


def paced(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The running delay per host of a stream of answers."""
    rows = events.select(key, "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return rows.groupBy(key).applyInPandasWithState(pace(key), f"{key} long, delay_ms double, last_ms long", "delay double, last long", "update", "NoTimeout")


def write_new(stream: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Appends micro-batches as Parquet, one folder a batch, so that a batch that is run again overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
