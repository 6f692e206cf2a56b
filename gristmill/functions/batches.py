"""Arrow columns in small pieces, so that what a Python worker holds does not grow with the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into Python values at a time; a longer text is a piece of its own.
PIECE = 1 << 20


def pieces(*columns: pa.Array, most: int = PIECE) -> Iterator[tuple[list, ...]]:
    """The values of the columns in order, in pieces by the bytes of the first one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(ends)]
    for start, end in zip(cuts, cuts[1:]):
        yield tuple(c.slice(start, end - start).to_pylist() for c in columns)
