"""Substring deduplication by level-wise doubling over words.

A window of ``window`` words is two windows of half its length. So repeats are
sought at the half length first, and only windows that repeat there are built
at the full length; where nothing repeats nothing goes on. At the half length
one window stands for a run of them: each full window's *anchor* is the least
hash among the half windows it holds (winnowing). Equal full windows have equal
anchors, so a repeat of the full length is a repeat of its anchor in another
document, and only about 2 of 27 half windows are counted at all.

1. Exact copies: documents are grouped by a digest of their words. The smallest
   doc_id of a group goes on; all windows of the others start in it, so what
   they lose is known: everything, if they hold a window.
2. Half level: the anchors of all remaining documents, those found in two
   documents or more survive.
3. Full level: documents with a surviving anchor are read again, their windows
   around surviving anchors hashed, and the least doc_id of each hash found.
   The survivors are windows that a smaller doc_id holds too.
4. The covered words leave their documents.

Counts are taken first by key and document or with partial aggregation, so a
passage that a third of all documents share is summed before it is shuffled, and
its windows meet their owner where they lie (``operators.hot``).
Equality over the corpus rests on 128-bit hashes.

Rules: null and empty texts have no words. Rows that repeat a doc_id are one
document: nothing is removed because of another row with the same id. Rows with
a null doc_id lose nothing and cause no loss. A window that repeats only within
its own document stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import words as W
from gristmill.llm.common import durable
from gristmill.operators.hot import join_by_share


def _parse(part: pa.RecordBatch) -> tuple[W.Words, np.ndarray, np.ndarray]:
    data, offsets = W.flat(part.column("text"))
    words = W.split(data, offsets, W.NOT_SPACE)
    return words, W.hashes(words, 0), W.hashes(words, 1)


def anchors(half: np.ndarray, window: int) -> np.ndarray:
    """For each window of ``window`` words the position of the least hash among the half windows inside it (the first of equals)."""
    span = window - _half(window) + 1
    if len(half) < span:
        return np.zeros(0, np.int64)
    # Least by doubling: after step s, least[i] is the position of the minimum of half[i : i + s].
    least, size = np.arange(len(half)), 1
    while size < span:
        step = min(size, span - size)
        left, right = least[: len(least) - step], least[step:]
        least = np.where(half[right] < half[left], right, left)
        size += step
    return least


def _half(window: int) -> int:
    return (window + 1) // 2


def features_of(window: int):
    """Per row: word count, a 128-bit digest of the word sequence, and the 128-bit hashes of its distinct anchors."""
    half = _half(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.runs(batch, "text"):
                words, h0, h1 = _parse(part)
                g0, g1 = W.window_hashes(h0, half, 0), W.window_hashes(h1, half, 1)
                whole, found = [], []
                for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
                    whole.append([int(W.window_hashes(h[a:b], b - a, k)[0]) if b > a else 0 for k, h in enumerate((h0, h1))])
                    at = a + np.unique(anchors(g0[a : b - half + 1], window)) if b - a >= window else np.zeros(0, np.int64)
                    found.append(at[np.unique(g0[at], return_index=True)[1]])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
                at, whole = np.concatenate(found), np.array(whole, np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("version"),
                        pa.array(np.diff(words.bounds), pa.int64()),
                        pa.array(W.signed(whole[:, 0].copy())),
                        pa.array(W.signed(whole[:, 1].copy())),
                        pa.ListArray.from_arrays(offsets, pa.array(W.signed(g0[at]))),
                        pa.ListArray.from_arrays(offsets, pa.array(W.signed(g1[at]))),
                    ],
                    ["doc_id", "version", "n_words", "d1", "d2", "a", "b"],
                )

    return run


def windows_of(window: int):
    """Per document with its surviving anchors (``found``, their first hash halves): the full windows around them, as hash and position."""
    half = _half(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.runs(batch, "text"):
                words, h0, h1 = _parse(part)
                g0 = W.window_hashes(h0, half, 0)
                f0, f1 = W.window_hashes(h0, window, 0), W.window_hashes(h1, window, 1)
                found = part.column("found")
                rows, at, starts = [], [], []
                for r, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
                    if b - a >= window:
                        own = np.asarray(found[r].values).view(np.uint64)
                        hit = np.flatnonzero(np.isin(g0[a + anchors(g0[a : b - half + 1], window)], own))
                        rows.append(np.full(len(hit), r))
                        at.append(hit + a)
                        starts.append(hit)
                if rows:
                    row, where = np.concatenate(rows), np.concatenate(at)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(row)), part.column("version").take(pa.array(row)), pa.array(np.concatenate(starts), pa.int32()), pa.array(W.signed(f0[where])), pa.array(W.signed(f1[where]))],
                        ["doc_id", "version", "at", "a", "b"],
                    )

    return run


def _keep(window: int):
    """Removes the covered words: ``cover`` holds window starts, ``whole`` marks copies that lose every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.runs(batch, "text"):
                data, offsets = W.flat(part.column("text"))
                words = W.split(data, offsets, W.NOT_SPACE)
                cover, whole = part.column("cover"), part.column("whole").to_pylist()
                removed, kept = [], []
                for r, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())):
                    stay = np.ones(b - a, bool)
                    if whole[r]:
                        stay[:] = False
                    elif cover[r].is_valid and len(cover[r]):
                        edge = np.zeros(b - a + 1, np.int32)
                        at = np.asarray(cover[r].values)
                        edge[at] += 1  # starts are distinct
                        edge[at + window] -= 1
                        stay = np.cumsum(edge[:-1]) == 0
                    text = data[offsets[r] : offsets[r + 1]].tobytes().split()
                    removed.append(int((~stay).sum()))
                    kept.append(b" ".join(text if stay.all() else [text[i] for i in np.flatnonzero(stay)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(words.bounds), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 50) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_text`` (the kept words joined by one space)."""
    row = ["doc_id", "version"]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("version"), F.col(text_col).alias("text"))
    features = durable(texts.mapInArrow(features_of(window), "doc_id long, version long, n_words long, d1 long, d2 long, a array<long>, b array<long>"), "features")
    can_repeat = features.where(f"doc_id is not null and n_words >= {window}")
    first = can_repeat.groupBy("d1", "d2", "n_words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("d1", "d2", "n_words", "first")
    copies = durable(can_repeat.select(*row, "n_words", "d1", "d2").join(first, ["d1", "d2", "n_words"]).where("doc_id > first").select(*row).distinct(), "copies")
    half = can_repeat.join(copies, row, "left_anti").select(*row, F.explode(F.arrays_zip("a", "b")).alias("h")).select(*row, "h.a", "h.b")
    repeated = durable(half.groupBy("a", "b").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count("*").alias("n")).where("x < y").select("a", "b", "n"), "repeated")
    surviving = join_by_share(half, repeated, ["a", "b"]).groupBy(*row).agg(F.collect_set("a").alias("found"))
    marked = surviving.withColumn("whole", F.lit(False)).unionByName(copies.select(*row, F.lit(None).cast("array<long>").alias("found"), F.lit(True).alias("whole")))
    # The texts move once, to meet their marks; only those with surviving anchors are looked at further.
    placed = durable(texts.join(marked, row, "left").select(*row, "text", "found", F.coalesce("whole", F.lit(False)).alias("whole")), "placed")
    suspects = placed.where("found is not null")
    full = durable(suspects.select(*row, "text", "found").mapInArrow(windows_of(window), "doc_id long, version long, at int, a long, b long"), "windows")
    owners = durable(full.groupBy("a", "b").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("owner < last").select("a", "b", "owner", "n"), "owners")
    covers = join_by_share(full, owners, ["a", "b"]).where("doc_id > owner").groupBy(*row).agg(F.collect_set("at").alias("cover"))
    judged = suspects.select(*row, "text", "whole").join(covers, row, "left")
    settled = placed.where("found is null").select(*row, "text", "whole", F.lit(None).cast("array<int>").alias("cover"))
    return settled.unionByName(judged).select("doc_id", "text", "whole", "cover").mapInArrow(_keep(window), "doc_id long, n_words long, n_removed long, kept_text string")
