"""Digests, MinHash sketches and simhashes of texts, as functions of a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.batches import pieces
from gristmill.functions.urls import collapse

try:  # CPython's own, which a short run of tokens costs half as much as OpenSSL's
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: The modulus of the permutations, the largest 31-bit prime, so that products stay in 64 bits.
PRIME = 2**31 - 1
SLOTS, BANDS, TOKENS = 64, 8, 5
#: Hashes that are permuted at a time, which bounds the memory that a long text takes.
_CHUNK = 512


@cache
def permutations(n: int = SLOTS) -> list[tuple[int, int]]:
    """Multiplier and offset of each permutation, from a mixer seeded with its number."""
    out = []
    for i in range(n):
        x = (i + 1) * 0x9E3779B97F4A7C15 % 2**64
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * by % 2**64
        out.append((1 + (x >> 33) % (PRIME - 1), (x & 0xFFFFFFFF) % PRIME))
    return out


def text_digest(text: Column) -> Column:
    return F.sha2(collapse(text), 256)


def content_hash(text: Column) -> Column:
    return F.substring(text_digest(text), 1, 16)


def length_bucket(n_bytes: Column) -> Column:
    """floor(log2) + 1, and 0 for 0."""
    return F.when(n_bytes == 0, 0).otherwise(F.char_length(F.bin(n_bytes)))


def run_hashes(text: str | None, least: int = 1) -> np.ndarray:
    """The first 64 bits of md5 of each run of TOKENS tokens, in order, repeats included. A text of fewer tokens, but ``least``, is one run."""
    raw = (text or "").encode()
    spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    if not raw or len(spaces) + 1 < least:
        return np.zeros(0, np.uint64)
    starts, ends = [0, *(spaces[: max(len(spaces) - TOKENS + 1, 0)] + 1).tolist()], [*spaces[TOKENS - 1 :].tolist(), len(raw)]
    return np.frombuffer(b"".join([md5(raw[a:b]).digest() for a, b in zip(starts, ends)]), ">u8")[::2].astype(np.uint64)


def _sketch(text: str) -> np.ndarray:
    values, prime = run_hashes(text) % np.uint64(PRIME), np.uint64(PRIME)
    a, b = (np.array(x, np.uint64)[:, None] for x in zip(*permutations()))
    out = np.full(SLOTS, PRIME, np.uint64)
    for at in range(0, len(values), _CHUNK):
        # 2**31 is 1 by the modulus, so the high bits are added to the low ones; what is then PRIME or more loses PRIME, and less would wrap round.
        x = a * values[at : at + _CHUNK] + b
        x = (x & prime) + (x >> np.uint64(31))
        np.minimum(out, np.minimum(x, x - prime).min(axis=1), out=out)
    return out.astype(np.int64)


def _simhash(text: str | None) -> int:
    hashes = run_hashes(text, least=TOKENS)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8 * _CHUNK):
        votes += np.unpackbits(hashes[at : at + 8 * _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 64 // 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">i8")[0])


def _pieced(f: Callable, made: pa.DataType) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def batches(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            for (piece,) in pieces(texts):
                yield pa.array([f(t) for t in piece], made)

    return batches


def _each(f: Callable, kind: str, made: pa.DataType) -> Callable[[Column], Column]:
    return lambda text: F.arrow_udf(_pieced(f, made), kind)(text)


# A text's prints are its own function, so they take one Arrow pass and no shuffle. Each takes a collapsed text.
run_set = _each(lambda text: np.unique(run_hashes(text)).view(np.int64), "array<long>", pa.list_(pa.int64()))
sketch = _each(_sketch, "array<long>", pa.list_(pa.int64()))
simhash = _each(_simhash, "long", pa.int64())


def shingles(docs: DataFrame) -> DataFrame:
    """``doc_id, h``: a 64-bit hash of each distinct run of TOKENS tokens of each row. A shorter text is one run; null and empty ones give no row."""
    return docs.select("doc_id", F.explode(run_set(collapse(F.col("text")))).alias("h"))


def sketches(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id``, the columns ``more``, ``m0 ... m63`` of each row: the least value of each permutation over the text's shingles. Null and empty texts give no row."""
    full = docs.where(F.col("text").rlike("[^ \t\n\f\r]")).select("doc_id", *more, sketch(collapse(F.col("text"))).alias("s"))
    kept = full.drop("s").columns
    return full.select(*kept, *[F.col("s")[i].alias(f"m{i}") for i in range(SLOTS)])


def band_keys(slots: list[Column]) -> list[Column]:
    rows = len(slots) // BANDS
    return [F.md5(F.concat_ws(",", F.lit(b).cast("string"), *[s.cast("string") for s in slots[b * rows : (b + 1) * rows]])) for b in range(BANDS)]


def agreement(a: list[Column], b: list[Column]) -> Column:
    """How many slots two sketches share."""
    return reduce(Column.__add__, [F.when(x == y, 1).otherwise(0) for x, y in zip(a, b)])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhashes(docs: DataFrame) -> DataFrame:
    """``doc_id, simhash`` of each row: a bit is set where more 64-bit hashes of runs of TOKENS tokens, repeats included, have it than not.

    0 for texts of fewer tokens and null ones.
    """
    return docs.select("doc_id", simhash(collapse(F.col("text"))).alias("simhash"))
