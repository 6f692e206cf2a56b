"""A hash tree over the chunks of a body, with inclusion proofs."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 16 << 10


def _leaf(chunk: bytes) -> bytes:
    return hashlib.sha256(b"\0" + chunk).digest()


def _node(a: bytes, b: bytes) -> bytes:
    return hashlib.sha256(b"\1" + a + b).digest()


def levels(body: bytes) -> list[list[bytes]]:
    """The digests of each level, leaves first; an odd last node goes up as it is. An empty body has one empty leaf."""
    row = [_leaf(body[i : i + CHUNK]) for i in range(0, max(len(body), 1), CHUNK)]
    out = [row]
    while len(row) > 1:
        row = [_node(*row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        out.append(row)
    return out


def proof(body: bytes, index: int) -> list[bytes | None]:
    """The neighbour at each level up to the root, None where there is none."""
    out = []
    for row in levels(body)[:-1]:
        other = index ^ 1
        out.append(row[other] if other < len(row) else None)
        index //= 2
    return out


def verify(root: bytes, index: int, chunk: bytes, path: list[bytes | None]) -> bool:
    at = _leaf(chunk)
    for other in path:
        if other is not None:
            at = _node(other, at) if index & 1 else _node(at, other)
        index //= 2
    return at == root


def _roots(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: None if b is None else levels(b.encode())[-1][0].hex())


def chunk_root(body: Column) -> Column:
    """The root of a text body's tree, as lower-case hex."""
    return F.pandas_udf(_roots, "string")(body)
