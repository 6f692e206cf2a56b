"""Benchmark decontamination: documents searched for windows of benchmark words.

The benchmark is the stated query set. It is divided by a hash of its rows into
blocks of at most ``block_bytes`` of text on average; each block's search
tables are broadcast and all documents pass them once, as whole texts, with no
shuffle. Where there are several blocks, the rows carry their hits from one
pass to the next through a written table, so one block is held at a time.

Rules: null texts and texts without a word have no words and no hits; such
items match nothing. Items that share a window all count as hit. Items with a
null id are searched for and cover words but are not listed. Repeated item rows
count once. Every input row of documents, repeated or with a null id, gives a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import words as W
from gristmill.llm.common import carried, durable, restored, with_carried, worker_state
from gristmill.llm.wu_manber import Table, tables

SCHEMA = "n_words long, hits array<int>, items array<string>"


def _scan(built: Broadcast, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Table] = _tables(built)
        for batch in batches:
            for part in W.runs(batch, "text"):
                yield _scan_run(part, found, keep_text)

    return run


def _tables(built: Broadcast) -> list[Table]:
    """The block's tables, built once in each worker process."""
    name, items, window = built.value
    return worker_state(name, lambda: tables(items, window))


def _scan_run(part: pa.RecordBatch, found: list[Table], keep_text: bool) -> pa.RecordBatch:
    data, offsets = W.flat(part.column("text"))
    words = W.split(W.LOWER[data], offsets, W.ALNUM)
    hashed = W.hashes(words)
    ready = [t.prepared(hashed) for t in found]
    word = lambda i: W.text_of(words, i)
    earlier = (part.column("hits").to_pylist(), part.column("items").to_pylist()) if "hits" in part.schema.names else None
    hits, items = [], []
    for r, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
        covered = [np.array(earlier[0][r], np.int32)] if earlier else []
        owners = set(earlier[1][r]) if earlier else set()
        for t, prepared in zip(found, ready):
            for start, own in t.search(prepared, a, b, word):
                covered.append(np.arange(start - a, start - a + t.length, dtype=np.int32))
                owners.update(str(x) for x in own if x is not None)
        hits.append(np.unique(np.concatenate(covered)) if covered else [])
        items.append(sorted(owners))
    columns = {c: part.column(c) for c in part.schema.names if c.startswith("_gm_")}
    columns |= {"n_words": pa.array(np.diff(words.bounds), pa.int64()), "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}
    if keep_text:
        columns["text"] = part.column("text")
    return pa.RecordBatch.from_pydict(columns)


def _scanned(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_bytes: int) -> DataFrame:
    """``rows`` (a column ``text`` and carried ones) with SCHEMA in place of the text."""
    spark = rows.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n_blocks = max(1, -(-size // block_bytes))
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == k)
        built = spark.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in block.collect()], window))
        if k == n_blocks - 1:
            return rows.mapInArrow(_scan(built, False), with_carried(SCHEMA, rows))
        rows = durable(rows.mapInArrow(_scan(built, True), with_carried(SCHEMA + ", text string", rows)), "scanned")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per document row: ``doc_id, n_words, hits`` (positions of the words inside an occurrence) and ``items`` (ids, as sorted strings)."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("_gm_0"))
    return _scanned(rows, benchmark, item_col, item_text_col, window, block_bytes).withColumnRenamed("_gm_0", "doc_id")


def apply_decontamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents that hold no window of the benchmark; all columns stay. The columns ride along with the scan, so nothing is shuffled."""
    rows = docs.select(F.col(text_col).alias("text"), *carried(docs))
    out = _scanned(rows, benchmark, item_col, item_text_col, window, block_bytes)
    return restored(out.where(F.size("hits") == 0), docs)
