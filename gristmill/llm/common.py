"""What the operators share: durable tables, reproducible splits, carried columns.

Row rules that hold for every operator unless its docstring says otherwise:

* a null text is an empty text;
* rows that repeat a document id are each returned, and count as one document
  wherever documents are counted;
* rows whose id is null are returned with an empty-document result or passed
  through, and never influence other rows;
* extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gristmill.storage import durable, scratch_path

__all__ = ["ascii_lower", "carried", "durable", "fold", "fresh_worker", "restored", "scratch_path", "set_worker_threads", "table", "with_carried", "worker_state"]

T = TypeVar("T")


def fold(id_col: Column, folds: int = 4) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. For pure ASCII texts that is what ``lower`` does, at less cost than ``translate``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(docs: DataFrame) -> list[Column]:
    """All columns under names of their places, which clash with nothing, to ride along through ``mapInArrow``."""
    return [F.col(f"`{c}`").alias(f"_gm_{i}") for i, c in enumerate(docs.columns)]


def with_carried(ddl: str, rows: DataFrame) -> StructType:
    """The schema of ``rows``' carried columns and then those of ``ddl``."""
    return StructType([*(f for f in rows.schema if f.name.startswith("_gm_")), *StructType.fromDDL(ddl)])


def restored(out: DataFrame, docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """The carried columns under their own names again; those in ``changed`` get a new value."""
    changed = changed or {}
    return out.select(*[changed.get(c, F.col(f"_gm_{i}")).alias(c) for i, c in enumerate(docs.columns)])


_held: dict[object, object] = {}


def _give_back() -> None:
    """Gives unused memory of this process back to the system, which it else keeps for as long as it is reused."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def worker_state(key: object, build: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task: one object at a time, so that the operators of a pipeline do not add up in a reused worker."""
    if key not in _held:
        _held.clear()
        _give_back()
        _held[key] = build()
    return _held[key]


def fresh_worker() -> None:
    """Drops what an earlier operator left in a reused worker."""
    worker_state(None, lambda: None)


def set_worker_threads() -> None:
    """One native thread a task: Spark already runs a task per core."""
    for name in ("RAYON_NUM_THREADS", "OMP_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
