"""Exact substring deduplication over bytes by a distributed merge sort of suffixes.

Two strings of ``window`` bytes are equal if their suffixes stand side by side in a
sorted list of all suffixes. A sample of suffixes is enough: in each window the least hash
of its ``base``-byte strings marks an *anchor*, and equal windows have equal anchors at
equal offsets (about 2 of 36 positions).

1. A task sorts the anchors' suffixes of about 16 MB of texts, ``base`` bytes of each, into
   a run of distinct ones with their least doc_id. Runs are front-coded and written.
2. Key ranges are cut by a sample of the runs; the parts of the runs are exchanged, front-coded,
   and merged by a loser tree that never reads a known common prefix again
   (``suffix_runs``). Suffixes of two documents or more survive.
3. Texts that copy one of a smaller doc_id as a whole are known by a digest and lose all. Surviving
   anchors of the others are sorted and merged in the same way with all bytes around them that a
   window can hold: ``window`` bytes from the anchor on and, backwards, ``window - base``
   bytes before it. Anchors equal in all of these are a class, and its least doc_id owns it:
   every other document loses the windows round that anchor.
4. Classes that share the anchor's first ``base`` bytes may share some windows yet. They lie side by side
   in the merge, and a window is common to those that agree in its bytes after and before the
   anchor. Only a suffix at which two ranges meet is settled by grouping its windows.
5. What was found goes back to the run it came from, where the texts still lie: they
   are written once, bucketed by run, and never shuffled.

A passage that many documents share is one key a run, whatever their number, so no
range holds more of it than there are runs. Ranges are cut inside a suffix too. The
driver holds the sample, a few dozen keys a range.

Rules: a null text is empty. Rows that repeat a doc_id are one document: nothing
is removed because of another row with the same id. Rows with a null doc_id lose nothing and
cause no loss. What remains need not be valid UTF-8, so it is binary.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import suffix_runs as S
from gristmill.llm import words as W
from gristmill.llm.common import durable, scratch_path
from gristmill.operators.hot import join_by_share

#: Bytes of texts whose anchors are sorted into one run.
RUN_BYTES = 16 << 20
#: Windows whose hashes are held at once.
PIECE = 1 << 17
#: A key of a run in so many is in the sample that cuts ranges.
SAMPLED = 512
#: Keys of a range on average.
RANGE_KEYS = 200_000

_TIMES = [np.uint64(int(x) | 1) for x in np.random.Generator(np.random.PCG64(13)).integers(0, 2**64, 32, np.uint64)]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position on, of overlapping eight-byte words."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for step in (1, 2, 4):
        x = x[:-step] | x[step:] << np.uint64(8 * step)
    if size < 8:
        return W.mix(x[:n] & np.uint64((1 << 8 * size) - 1))
    out = np.zeros(n, np.uint64)
    for i, at in enumerate([*range(0, size - 8, 8), size - 8]):
        out += x[at : at + n] * _TIMES[i % len(_TIMES)] ** np.uint64(1 + i // len(_TIMES))
    return W.mix(out)


def _slide(x: np.ndarray, span: int, pick) -> np.ndarray:
    size = 1
    while size < span:
        step = min(size, span - size)
        x = pick(x[:-step], x[step:])
        size += step
    return x


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, base: int) -> np.ndarray:
    """Positions whose hash is the least of some window, never across rows."""
    span, edge = window - base + 1, np.zeros(len(data) + 1, np.int32)
    starts, ends = offsets[:-1], offsets[1:]
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.maximum(starts, ends - window + 1), -1)
    whole = np.cumsum(edge[:-1]) > 0  # a window that starts here ends in its row
    found = []
    for a in range(0, max(0, len(data) - window + 1), PIECE):
        b = min(a + PIECE, len(data) - window + 1)
        if whole[a:b].any():
            h = (gram_hashes(data[a : b + window - 1], base) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            least = np.where(whole[a:b], _slide(h, span, np.minimum), np.uint32(0))
            pad = np.zeros(span - 1, np.uint32)
            found.append(a + np.flatnonzero(h == _slide(np.concatenate([pad, least, pad]), span, np.maximum)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _run_columns(keys: np.ndarray, owner: np.ndarray, sampled: int) -> tuple[np.ndarray, bytes, list[bytes]]:
    """The run of ``keys`` with their documents: the number of each key in it, the packed run, sampled keys."""
    order, lcp = S.sort_keys(keys)
    new = lcp < keys.shape[1]
    new[:1] = True
    group, at = np.cumsum(new) - 1, np.flatnonzero(new)
    number = np.empty(len(keys), np.int32)
    number[order] = group
    owner = owner[order]
    low, high = np.minimum.reduceat(owner, at), np.maximum.reduceat(owner, at)
    rows = keys[order[at]]
    return number, S.pack(rows, lcp[at], low, low < high), [r.tobytes() for r in rows[sampled // 2 :: sampled]]


RUN_DDL = "kind int, run long, row int, doc_id long, text string, pos binary, num binary, n long, keys array<binary>, digest binary"
#: What a row of a table of runs is.
DOC, RUN = 0, 1


def _rows(kind: int, run: int, count: int, **columns) -> pa.RecordBatch:
    types = {"row": pa.int32(), "doc_id": pa.int64(), "text": pa.string(), "pos": pa.binary(), "num": pa.binary(), "n": pa.int64(), "keys": pa.list_(pa.binary()), "digest": pa.binary()}
    full = {"kind": pa.array([kind] * count, pa.int32()), "run": pa.array([run] * count, pa.int64())}
    for c, t in types.items():
        x = columns.get(c)
        full[c] = pa.nulls(count, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t)
    return pa.RecordBatch.from_pydict(full)


def _split(x: np.ndarray, row: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(x, np.searchsorted(row, np.arange(1, n)))


def _sorted_runs(window: int, base: int, sampled: int):
    def flush(run: int, slices: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(slices).combine_chunks().to_batches()[0]
        data, offsets = W.flat(part.column("text"))
        n, ids = part.num_rows, part.column("doc_id")
        at = anchors(data, offsets, window, base)
        row = np.searchsorted(offsets, at, "right") - 1
        named = np.asarray(pc.is_valid(ids))[row]
        at, row = at[named], row[named]
        number = np.zeros(0, np.int32)
        if len(at):
            keys = np.lib.stride_tricks.sliding_window_view(data, base)[at]
            number, packed, sample = _run_columns(keys, np.asarray(pc.fill_null(ids, 0))[row], sampled)
            yield _rows(RUN, run, 1, num=[packed], n=[int(number.max()) + 1], keys=[sample])
        local = (at - offsets[row]).astype(np.int32)
        digest = [hashlib.md5(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield _rows(DOC, run, n, row=pa.array(np.arange(n, dtype=np.int32)), doc_id=ids, text=part.column("text"), pos=[_bytes(x, "<i4") for x in _split(local, row, n)], num=[_bytes(x, "<i4") for x in _split(number, row, n)], digest=digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, slices, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in W.runs(batch, "text"):
                slices.append(part)
                size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if size >= RUN_BYTES:
                    yield from flush(name, slices)
                    name, slices, size = name + 1, [], 0
        if slices:
            yield from flush(name, slices)

    return run


PIECE_DDL = "range long, run long, first long, piece binary"


def _pieces(splitters: list[bytes], width: int):
    """Each run cut at the splitters: (range, run, number of the first key, front-coded keys)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column("run").to_pylist(), batch.column("num")):
                rows, lcp, owner, many = S.unpack(blob.as_py(), width)
                raw = rows.tobytes()
                at = [bisect_left(range(len(rows)), cut, key=lambda i: raw[i * width : (i + 1) * width]) for cut in splitters]
                bounds = [0, *at, len(rows)]
                out = [(k, name, a, S.pack(rows[a:b], lcp[a:b], owner[a:b], many[a:b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["range", "run", "first", "piece"])

    return run


def _merged(table: pa.Table, width: int):
    """The pieces of one range, merged: per piece its (run, first, keys), per key in order its piece, its place in it, owner, whether many documents hold it, and the shared prefix."""
    names, firsts = table.column("run").to_pylist(), table.column("first").to_pylist()
    got = [S.unpack(x, width) for x in table.column("piece").to_pylist()]
    piece, lcp = S.merge([(rows, shares) for rows, shares, _, _ in got])
    place = np.empty(len(piece), np.int64)
    place[np.argsort(piece, kind="stable")] = np.concatenate([np.arange(len(rows)) for rows, *_ in got])
    start = np.concatenate([[0], np.cumsum([len(rows) for rows, *_ in got])])[piece] + place
    gather = lambda k: np.concatenate([x[k] for x in got])[start]
    return names, firsts, [len(rows) for rows, *_ in got], piece, place, start, gather, lcp


def _surviving(base: int):
    """Per piece a bit for each key: whether two documents or more hold that suffix."""

    def run(table: pa.Table) -> pa.Table:
        names, firsts, sizes, piece, place, start, gather, lcp = _merged(table, base)
        new = lcp < base
        new[:1] = True
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        owner = gather(2)
        shared = (np.minimum.reduceat(owner, at) < np.maximum.reduceat(owner, at)) | np.logical_or.reduceat(gather(3), at)
        flat = np.empty(len(piece), bool)
        flat[start] = shared[group]
        bits = [_bytes(np.packbits(x), "u1") for x in np.split(flat, np.cumsum(sizes)[:-1])]
        return pa.table({"run": pa.array(names, pa.int64()), "first": pa.array(firsts, pa.int64()), "n": pa.array(sizes, pa.int64()), "bits": pa.array(bits, pa.binary())})

    return run


def _contexts(window: int, base: int, sampled: int):
    """A run's texts and the bits of its suffixes: the surviving anchors' classes as a new run."""
    before = window - base

    def run(docs: pa.Table, bits: pa.Table) -> pa.Table:
        empty = _rows(DOC, 0, 0)
        if not docs.num_rows or not bits.num_rows:
            return pa.Table.from_batches([empty])
        docs = docs.sort_by("row").combine_chunks()
        data, offsets = W.flat(docs.column("text"))
        copies, bits = bits.column("row").drop_null().to_pylist(), bits.filter(pc.is_valid(bits.column("bits")))
        if not bits.num_rows:
            return pa.Table.from_batches([empty])
        alive = np.zeros(max(f + n for f, n in zip(bits.column("first").to_pylist(), bits.column("n").to_pylist())), bool)
        for f, n, b in zip(*(bits.column(c).to_pylist() for c in ("first", "n", "bits"))):
            alive[f : f + n] = np.unpackbits(np.frombuffer(b, np.uint8), count=n)
        local, number = ([np.frombuffer(x, "<i4") for x in docs.column(c).to_pylist()] for c in ("pos", "num"))
        row = np.repeat(np.arange(docs.num_rows), [len(x) for x in local])
        keep = alive[np.concatenate(number)] if len(row) else np.zeros(0, bool)
        keep &= ~np.isin(row, copies)
        row, local = row[keep], np.concatenate(local)[keep].astype(np.int64)
        if not len(row):
            return pa.Table.from_batches([empty])
        at, name = local + offsets[row], docs.column("run")[0].as_py()
        keys, padded = np.zeros((len(at), window + before + 2), np.uint8), np.concatenate([np.zeros(before, np.uint8), data, np.zeros(window, np.uint8)])
        after, ahead = np.minimum(offsets[row + 1] - at, window), np.minimum(local, before)
        for a in range(0, len(at), PIECE):
            p = slice(a, a + PIECE)
            right = padded[at[p, None] + before + np.arange(window)]
            left = padded[at[p, None] + before - 1 - np.arange(before)]
            keys[p, :window] = np.where(np.arange(window) < after[p, None], right, 0)
            keys[p, window:-2] = np.where(np.arange(before) < ahead[p, None], left, 0)
        keys[:, -2], keys[:, -1] = after, ahead
        ids = np.asarray(pc.fill_null(docs.column("doc_id").combine_chunks(), 0))
        number, packed, sample = _run_columns(keys, ids[row], sampled)
        some, n = np.unique(row), docs.num_rows
        pos, num = _split(local, row, n), _split(number, row, n)
        marks = _rows(DOC, name, len(some), row=pa.array(some.astype(np.int32)), pos=[_bytes(pos[r], "<i4") for r in some], num=[_bytes(num[r], "<i4") for r in some])
        return pa.Table.from_batches([_rows(RUN, name, 1, num=[packed], n=[int(number.max()) + 1], keys=[sample]), marks])

    return run


def common_windows(rows: np.ndarray, lcp: np.ndarray, owner: np.ndarray, window: int, base: int) -> np.ndarray:
    """For sorted classes (rows) and window offsets (columns): whether a class with a smaller owner has that window too."""
    n, before = len(rows), window - base
    out = np.zeros((n, before + 1), bool)
    close = np.zeros(n + 1, bool)
    close[1:n] = lcp[1:] >= base
    some = np.flatnonzero(close[:-1] | close[1:])
    if not len(some):
        return out
    # Classes in between share less than ``base`` bytes with both neighbours, so what neighbours of ``some`` share is at hand.
    lcp, owner, rows = np.where(close[some], lcp[some], 0), owner[some], rows[some]
    back, shares = S.sort_keys(rows[:, window:-2])
    for o in range(before + 1):
        good = np.flatnonzero((rows[:, -1] >= o) & (rows[:, -2] >= window - o))
        right = np.cumsum(lcp < window - o)
        left = np.empty(len(some), np.int64)
        left[back] = np.cumsum(shares < o)
        key, inverse = np.unique(right[good] * (len(some) + 1) + left[good], return_inverse=True)
        least = np.full(len(key), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, owner[good])
        out[some[good], o] = least[inverse] < owner[good]
    return out


FOUND_DDL = "run long, first long, n long, owners binary, masks binary, window binary, owner long, class long, off int"


def _classes(splitters: list[bytes], window: int, base: int):
    """Per piece the owner and the common windows of its keys; for suffixes at a splitter their windows and members."""
    width, before = 2 * window - base + 2, window - base

    def run(table: pa.Table) -> pa.Table:
        names, firsts, sizes, piece, place, start, gather, lcp = _merged(table, width)
        number = table.column("range")[0].as_py()
        new = lcp < width
        new[:1] = True
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        rows, owner = gather(0)[at], np.minimum.reduceat(gather(2), at)
        mask = common_windows(rows, lcp[at], owner, window, base)
        flat = np.empty(len(piece), np.int64)
        flat[start] = group
        out = []
        for name, first, part in zip(names, firsts, np.split(flat, np.cumsum(sizes)[:-1])):
            out.append((name, first, len(part), _bytes(owner[part], "<i8"), _bytes(np.packbits(mask[part], axis=1), "u1"), None, None, None, None))
        edges = {s[:base] for s in splitters[max(0, number - 1) : number + 1]}
        for c in np.flatnonzero([r[:base].tobytes() in edges for r in rows]) if edges else ():
            key, uid = rows[c].tobytes(), number << 32 | int(c)
            for o in range(max(0, window - key[-2]), min(before, key[-1]) + 1):
                out.append((None, None, None, None, None, key[window : window + o][::-1] + key[: window - o], int(owner[c]), uid, o))
            for t in np.flatnonzero(group == c).tolist():
                out.append((names[piece[t]], firsts[piece[t]] + int(place[t]), None, None, None, None, None, uid, None))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), types)], ["run", "first", "n", "owners", "masks", "window", "owner", "class", "off"])

    return run


def _removed(window: int, base: int):
    """A run's texts without the covered bytes."""
    before = window - base

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        docs = docs.sort_by("row").combine_chunks()  # every run has texts
        data, offsets = W.flat(docs.column("text"))
        edge, n = np.zeros(len(data) + 1, np.int32), docs.num_rows
        found, patches, copies, own = (marks.filter(pc.equal(marks.column("kind"), k)) for k in (2, 3, 4, DOC))
        copied = np.array(copies.column("row").to_pylist(), np.int64)
        np.add.at(edge, offsets[copied], 1)
        np.add.at(edge, offsets[copied + 1], -1)
        if own.num_rows and found.num_rows:
            size = max(f + m for f, m in zip(found.column("first").to_pylist(), found.column("n").to_pylist()))
            owner, mask = np.zeros(size, np.int64), np.zeros((size, before + 1), bool)
            for f, m, o, b in zip(*(found.column(c).to_pylist() for c in ("first", "n", "owners", "masks"))):
                owner[f : f + m] = np.frombuffer(o, "<i8")
                mask[f : f + m] = np.unpackbits(np.frombuffer(b, np.uint8).reshape(m, -1), axis=1, count=before + 1)
            for f, offs in zip(patches.column("first").to_pylist(), patches.column("offs").to_pylist()):
                mask[f, offs] = True
            ids = np.asarray(pc.fill_null(docs.column("doc_id").combine_chunks(), 0))
            local, number = ([np.frombuffer(x, "<i4") for x in own.column(c).to_pylist()] for c in ("pos", "num"))
            row = np.repeat(np.array(own.column("row").to_pylist()), [len(x) for x in local])
            local, number = np.concatenate(local).astype(np.int64), np.concatenate(number)
            at = local + offsets[row]
            other = ids[row] > owner[number]  # a class of another document: all its windows are covered
            least, most = np.maximum(0, window - (offsets[row + 1] - at)), np.minimum(before, local)
            here = other & (least <= most)
            np.add.at(edge, (at - most)[here], 1)
            np.add.at(edge, (at - least + window)[here], -1)
            for o in range(before + 1):
                start = at[~other & mask[number, o]] - o
                np.add.at(edge, start, 1)
                np.add.at(edge, start + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[heads] = gone[heads]
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        removed = sums(gone)
        kept = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets - np.concatenate([[0], np.cumsum(removed)])).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
        return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed), "n_spans": pa.array(sums(begins)), "kept": kept})

    return run


def _bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Written once in the shared folder, bucketed by ``key``: later groupings by it read the rows where they lie."""
    spark = df.sparkSession
    table = f"gristmill_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def _splitters(runs: DataFrame, range_keys: int) -> tuple[list[bytes], int]:
    total, sampled = runs.agg(F.sum("n"), F.sum(F.size("keys"))).first()
    ranges = 1 + (total or 0) // range_keys
    step = max(1, (sampled or 0) // (64 * ranges))
    found = runs.select(F.explode("keys").alias("key")).where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0) if step > 1 else runs.select(F.explode("keys").alias("key"))
    keys = sorted(bytes(r["key"]) for r in found.collect()) if ranges > 1 else []  # about 64 a range
    return sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)} if keys else ()), total or 0


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 50, base: int | None = None, range_keys: int = RANGE_KEYS, sampled: int = SAMPLED) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes)."""
    base = base or max(1, window // 3)
    if not 1 <= base <= window < 128:
        raise ValueError("a window has 1 to 127 bytes and an anchor no more than that")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = _bucketed(texts.mapInArrow(_sorted_runs(window, base, sampled), RUN_DDL), "run", "suffixes")
    lying, runs = first.where(f"kind = {DOC}").select("run", "row", "doc_id", "text", "pos", "num"), first.where(f"kind = {RUN}").select("run", "num", "n", "keys")
    cuts, _ = _splitters(runs, range_keys)
    pieces = runs.select("run", "num").mapInArrow(_pieces(cuts, base), PIECE_DDL)
    bits = durable(pieces.groupBy("range").applyInArrow(_surviving(base), "run long, first long, n long, bits binary"), "surviving")
    # Copies of a whole text of a smaller doc_id lose all of it, and have nothing to add to step 3.
    digests = first.where(f"kind = {DOC} AND doc_id IS NOT NULL AND octet_length(text) >= {window}").select("run", "row", "doc_id", "digest")
    least = durable(digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("least < last").select("digest", "least", "n"), "least")
    copies = durable(join_by_share(digests, least, ["digest"]).where("doc_id > least").select("run", "row"), "copies")
    around = durable(lying.groupBy("run").cogroup(bits.unionByName(copies, allowMissingColumns=True).groupBy("run")).applyInArrow(_contexts(window, base, sampled), RUN_DDL), "contexts")
    runs = around.where(f"kind = {RUN}").select("run", "num", "n", "keys")
    cuts, _ = _splitters(runs, range_keys)
    pieces = runs.select("run", "num").mapInArrow(_pieces(cuts, 2 * window - base + 2), PIECE_DDL)
    found = durable(pieces.groupBy("range").applyInArrow(_classes(cuts, window, base), FOUND_DDL), "classes")
    marks = around.where(f"kind = {DOC}").selectExpr("kind", "run", "row", "pos", "num").unionByName(copies.selectExpr("4 AS kind", "run", "row"), allowMissingColumns=True)
    marks = marks.unionByName(found.where("owners is not null").selectExpr("2 AS kind", "run", "first", "n", "owners", "masks"), allowMissingColumns=True)
    if cuts:
        windows = durable(found.where("window is not null").select("window", "owner", "class", "off"), "windows")
        least = durable(windows.groupBy("window").agg(F.min("owner").alias("least"), F.max("owner").alias("last"), F.count("*").alias("n")).where("least < last").select("window", "least", "n"), "least")
        common = join_by_share(windows, least, ["window"]).where("owner > least").groupBy("class").agg(F.collect_set("off").alias("offs"))
        patches = found.where("class is not null and run is not null").select("class", "run", "first").join(common, "class").selectExpr("3 AS kind", "run", "first", "offs")
        marks = marks.unionByName(patches, allowMissingColumns=True)
    else:
        marks = marks.withColumn("offs", F.lit(None).cast("array<int>"))
    return lying.select("run", "row", "doc_id", "text").groupBy("run").cogroup(marks.groupBy("run")).applyInArrow(_removed(window, base), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
