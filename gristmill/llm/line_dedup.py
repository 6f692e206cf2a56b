"""Line deduplication across documents, in DataFrame functions only.

Documents are split into lines; each line's key is the line stripped of ASCII
white space and with A-Z lower-cased. Distinct keys of a document are exploded
as 128-bit hashes, counted over documents (first by key and document, then by
key, each with map-side partial aggregation, so a line that a third of all
documents hold never gathers in one task), and the keys found in too many
documents are joined back to the documents that hold them, where the hottest
keys meet their rows without a shuffle (``operators.hot``). What travels is
hashes; the rows move once, to meet their documents' drop lists, and the kept
lines are picked by position inside the row.

Rules: null and empty texts are one empty line, which is kept. Rows that repeat
a doc_id count as one document, and each loses the same keys of its own text. Rows with a null
doc_id are returned unchanged and not counted. Ties cannot occur: the largest
doc_id that holds a key keeps all its lines with that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ascii_lower, carried, durable, restored
from gristmill.operators.hot import join_by_share

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _hashed(key: Column) -> list[Column]:
    """128 bits as two longs: equal keys agree, and different ones meet in no corpus."""
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")]


def _kept(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """The carried columns but the text, ``doc_id, absent, n_lines, n_dropped, kept_text``; the rows move once, to meet the lists of lines to drop."""
    rows = docs.select(
        *[c for c, name in zip(carried(docs), docs.columns) if name != text_col],
        F.col(id_col).alias("doc_id"),
        F.col(text_col).isNull().alias("absent"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("version", F.xxhash64("text")).withColumn("lines", F.split("text", "\n"))
    keys = durable(
        rows.where("doc_id is not null")
        .select("doc_id", "version", F.posexplode("lines").alias("at", "line"))
        .select("doc_id", "version", "at", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "version", "at", *_hashed(F.col("key"))),
        "line-keys",
    )
    common = durable(
        keys.select("a", "b", "doc_id")
        .distinct()
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs),
        "common-lines",
    )
    drops = (
        join_by_share(keys, common, ["a", "b"])
        .where(F.col("doc_id") < F.col("keeper"))
        .groupBy("doc_id", "version")
        .agg(F.collect_set("at").alias("drop"))
    )
    # The lines are split below the join, so the picking lambda reads an array instead of splitting again for each line.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    return rows.drop("text").join(drops, ["doc_id", "version"], "left").select(
        *[c for c in rows.columns if c.startswith("_gm_")],
        "doc_id",
        "absent",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")).alias("kept_text"),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_dropped, kept_text``.

    Keys of at least ``min_chars`` code points found in at least ``min_docs``
    documents lose all their lines except in the largest doc_id that holds them.
    """
    return _kept(docs.select(id_col, text_col), id_col, text_col, min_docs, min_chars).select("doc_id", "n_lines", "n_dropped", "kept_text")


def apply_line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """The documents with their common lines removed; all columns stay, and ``n_chars``, where there is one, is counted anew for texts that lost a line."""
    out = _kept(docs, id_col, text_col, min_docs, min_chars)
    lost, place = F.col("n_dropped") > 0, {c: f"_gm_{i}" for i, c in enumerate(docs.columns)}
    changed = {text_col: F.when(~F.col("absent"), F.col("kept_text"))}
    if "n_chars" in place:
        changed["n_chars"] = F.when(lost, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(place["n_chars"]))
    return restored(out, docs, changed)
