"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's documents. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.bpe import encode
from gristmill.llm.common import durable, table
from gristmill.llm.decontaminate import apply_decontamination
from gristmill.llm.language_id import apply_language_id
from gristmill.llm.line_dedup import apply_line_dedup
from gristmill.llm.near_dedup import apply_near_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no letter, or of no language told from the others, go; ``lang`` becomes the language found."""
    return apply_language_id(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more found in three documents or more stay in one; ``n_chars`` is counted anew."""
    return apply_line_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates stays."""
    return apply_near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return apply_decontamination(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, the decoded text, and the document's other columns but its text."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=[c for c in docs.columns if c not in ("doc_id", "text")])


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: Language identification cannot be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: doc_id, lang, source, n_chars, n_tokens and digests of the ids and the decoded text."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name)
    digest = lambda c: F.sha2(c, 256)
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return docs.select("doc_id", "lang", "source", "n_chars", "n_tokens", digest(ids).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
