"""Document statistics: exact counts by numpy over the UTF-8 bytes, ratios as Spark expressions.

A null text has the statistics of the empty text, all 0; a ratio with an empty
base is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm import words as W

COUNTS = (
    "n_chars", "n_words", "word_chars", "n_symbols", "n_upper", "n_digits", "n_punctuation", "n_exclamations", "n_non_ascii",
    "n_lines", "n_dup_lines", "n_one_word_lines", "n_repeat_words", "n_distinct_words", "longest_word", "n_top_word", "n_symbol_words",
)
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def _marks(which: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(which)] = True
    return out


_SYMBOL = _marks(b"#*$%&|<>")
_UPPER = _marks(bytes(range(0x41, 0x5B)))
_DIGIT = _marks(bytes(range(0x30, 0x3A)))
_PUNCTUATION = _marks(b".,;:!?'\"()-")
_EXCLAMATION = _marks(b"!")
_NEW_LINE = _marks(b"\n")
#: First bytes of characters outside ASCII, and first bytes of any character.
_WIDE = _marks(bytes(range(0xC0, 0x100)))
_FIRST = ~_marks(bytes(range(0x80, 0xC0)))


def repeated_words(windows: np.ndarray, n_words: int, size: int) -> int:
    """How many of n_words words lie in a window that occurs twice or more."""
    if len(windows) < 2:
        return 0
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[inverse] > 1)
    if not len(again):
        return 0
    edge = np.zeros(n_words + 1, np.int64)
    edge[again] += 1
    edge[again + size] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(part: pa.RecordBatch) -> list[np.ndarray]:
    """The COUNTS of each row."""
    data, offsets = W.flat(part.column("text"))
    a, b = offsets[:-1], offsets[1:]

    def of(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[b] - sums[a]

    words = W.split(data, offsets, W.NOT_SPACE)
    hashed, bounds = W.hashes(words), words.bounds
    windows = W.window_hashes(hashed, 5)
    lines = W.split(data, offsets, ~_NEW_LINE)
    line_hash = W.hashes(lines)
    first_word, past_word = np.searchsorted(words.starts, lines.starts), np.searchsorted(words.starts, lines.ends)
    in_line = past_word - first_word
    longest, sizes = np.zeros(len(a), np.int64), words.ends - words.starts
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    with_symbol = np.concatenate([[0], np.cumsum(symbols[words.ends] > symbols[words.starts])])
    ones = np.concatenate([[0], np.cumsum(in_line == 1)])
    dup, repeat, distinct, top = (np.zeros(len(a), np.int64) for _ in range(4))
    for r in range(len(a)):
        x, y = bounds[r], bounds[r + 1]
        if x == y:
            continue
        longest[r] = sizes[x:y].max()
        _, counts = np.unique(hashed[x:y], return_counts=True)
        distinct[r], top[r] = len(counts), counts.max()
        repeat[r] = repeated_words(windows[x : max(x, y - 4)], y - x, 5)
        own = line_hash[lines.bounds[r] : lines.bounds[r + 1]][in_line[lines.bounds[r] : lines.bounds[r + 1]] > 0]
        dup[r] = len(own) - len(np.unique(own))
    return [
        of(_FIRST[data]), np.diff(bounds), of(_FIRST[data] & W.NOT_SPACE[data]), of(_SYMBOL[data]), of(_UPPER[data]), of(_DIGIT[data]), of(_PUNCTUATION[data]), of(_EXCLAMATION[data]), of(_WIDE[data]),
        of(_NEW_LINE[data]) + 1, dup, ones[lines.bounds[1:]] - ones[lines.bounds[:-1]], repeat, distinct, longest, top, with_symbol[bounds[1:]] - with_symbol[bounds[:-1]],
    ]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.runs(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in measure(part))], ["doc_id", *COUNTS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and COUNTS, over whole texts, in one pass without a shuffle."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_run, SCHEMA)


def _share(x: str, of: str) -> Column:
    return F.when(F.col(of) > 0, F.col(x) / F.col(of)).otherwise(0.0)


def features() -> dict[str, Column]:
    """What the learners see of a document, as expressions over COUNTS."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "longest_word": F.col("longest_word").cast("double"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "symbol_words": _share("n_symbol_words", "n_words"),
        "upper_share": _share("n_upper", "n_chars"),
        "digit_share": _share("n_digits", "n_chars"),
        "punctuation_per_word": _share("n_punctuation", "n_words"),
        "exclamations_per_word": _share("n_exclamations", "n_words"),
        "non_ascii_share": _share("n_non_ascii", "n_chars"),
        "words_per_line": _share("n_words", "n_lines"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "one_word_line_share": _share("n_one_word_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "distinct_share": _share("n_distinct_words", "n_words"),
        "top_word_share": _share("n_top_word", "n_words"),
    }


def labelled(stats: DataFrame, labels: DataFrame, label_col: str, max_rows: int, held_out: Column):
    """Features and label of about ``max_rows`` rows that are not held out, as a pandas frame ordered by a hash of the id.

    The bound is the learners' documented sample size: a row is drawn by a hash
    of its id, at the rate that makes so many, and only drawn rows reach the
    driver. All rows are taken where there are no more. A label given more than
    once counts as its least value.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_gm_id")).agg(F.min(label_col).alias("label"))
    rows = stats.where(F.col("doc_id").isNotNull() & ~held_out).join(known, F.col("doc_id") == F.col("_gm_id"))
    draw = F.xxhash64("doc_id")
    rate = max_rows / max(1, rows.count())
    drawn = rows.where(F.pmod(draw, F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))) if rate < 1 else rows
    chosen = drawn.select(draw.alias("_order"), *[e.alias(n) for n, e in features().items()], F.col("label").cast("int").alias("label")).toPandas()
    return chosen.sort_values(list(chosen.columns)).drop(columns="_order").reset_index(drop=True)
