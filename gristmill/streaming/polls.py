"""Changes of a stream of polls, by the rule of ``operators.polls.poll_changes`` for polls that arrive in order.

State is the last known date of each URL. Rows of a micro-batch are put in order; one that comes in a later
batch than its successors is judged by what is known then. The state store must be the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "url string, kind string, published_ms long, polled_ms long"


class PollProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "published_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen, held = self.known.exists(), None
        if seen:
            held = self.known.get()[0]
        for r in sorted(rows, key=lambda r: (r["polled_ms"], r["place"])):
            moved = r["published_ms"] is not None and r["published_ms"] != held
            if moved or not seen:
                yield Row(url=key[0], kind="updated" if seen else "item", published_ms=r["published_ms"], polled_ms=r["polled_ms"])
            seen, held = True, r["published_ms"] if moved else held
        self.known.update((held,))

    def close(self) -> None:
        pass


def changes(polls: DataFrame) -> DataFrame:
    """New and changed items of a stream of ``url, published_ms, polled_ms, place``."""
    return polls.where("url is not null").groupBy("url").transformWithState(PollProcessor(), CHANGES, "append", "None")
