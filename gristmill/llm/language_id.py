"""Language identification by cross-parsing entropy.

Learning: a bounded sample of whole labelled documents per language is written
as letters with single borders between words, and gives a suffix automaton.
Prediction: every text is written likewise and parsed against each language's
automaton into longest matches, which run across words; the language that needs
fewest phrases wins, and phrases per symbol are its cross-parsing entropy. Whole
texts are parsed, in segments of SEGMENT symbols side by side.

The sample of a language is drawn by a hash among its documents of any length: about
``sample_docs`` of them, whole, as long as ``sample_chars`` code points in all are not
exceeded. Where no drawn document fits, the shortest of them is taken, so each
language is learned. At most MOST_LANGUAGES labels are learned, the commonest ones
(of equals the first in order); texts of others get the nearest of these.

Rules: null texts and texts without a letter are ``und`` with score 0. Of equal
languages the first in order wins. Where nothing can be learned every text is
``und``. Rows that repeat an id or have a null id are predicted like any other;
those with a null id are never learned from.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import words as W
from gristmill.llm.common import carried, durable, fold, restored, with_carried, worker_state
from gristmill.llm.suffix_automaton import Parser, SuffixAutomaton

HELD_OUT_FOLD = 2
#: Symbols parsed in one go.
SEGMENT = 256
MOST_LANGUAGES = 500
#: Symbols: a border, the end of a learned document, a letter that no language has; the known letters follow.
BORDER, END, UNKNOWN, KNOWN = range(4)


def chosen(drawn: list[tuple[int, int]], sample_chars: int) -> list[int]:
    """Of one language's (hash, code points), in order, the hashes that fit into the total; the shortest if none does."""
    out, left = [], sample_chars
    for h, size in sorted(drawn):
        if size <= left:
            out.append(h)
            left -= size
    return out or [h for _, h in sorted((size, h) for h, size in drawn)[:1]]


def learning_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, sample_chars: int) -> dict[str, list[str]]:
    """Whole texts per language, drawn by a hash of id and text at the rate that makes about ``sample_docs`` of each language."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT_FOLD))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return {}
    scale = 1 << 30
    limit = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(scale, math.ceil(scale * sample_docs / n)))])
    h = F.xxhash64("doc_id", "text")
    drawn = durable(rows.where(F.pmod(h, F.lit(scale)) < limit[F.col("lang")]).select("lang", h.alias("h"), "text"), "drawn")
    sizes: dict[str, set[tuple[int, int]]] = {}
    for r in drawn.select("lang", "h", F.char_length("text").alias("size")).collect():  # about sample_docs rows a language
        sizes.setdefault(r["lang"], set()).add((r["h"], r["size"]))
    taken = {(lang, h) for lang, found in sizes.items() for h in chosen(list(found), sample_chars)}
    texts: dict[str, set[str]] = {lang: set() for lang in sorted(sizes)}
    for r in drawn.where(F.col("h").isin([h for _, h in taken])).collect():
        if (r["lang"], r["h"]) in taken:
            texts[r["lang"]].add(r["text"])
    return {lang: sorted(own) for lang, own in texts.items()}


class Languages:
    """The automata of all languages over one alphabet."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = list(texts)
        points = range(sys.maxunicode + 1)
        #: The symbol of each code point.
        self.symbol = np.fromiter((UNKNOWN if chr(p).isalpha() else BORDER for p in points), np.int32, len(points))
        seen = sorted({c for own in texts.values() for t in own for c in t.lower() if c.isalpha()})
        self.symbol[[ord(c) for c in seen]] = np.arange(KNOWN, KNOWN + len(seen))
        self.parsers = []
        for own in texts.values():
            symbols, bounds = self.written(own)
            learned = [s for a, b in zip(bounds, bounds[1:]) for s in (*symbols[a:b].tolist(), END)]
            self.parsers.append(Parser(SuffixAutomaton(learned), KNOWN + len(seen)))

    def written(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts, letters with one border before, between and after words, and the bounds of each text in them."""
        points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        lengths = np.array([len(p) for p in points], np.int64)
        symbols = self.symbol[np.concatenate(points)] if texts else np.zeros(0, np.int32)
        keep = symbols != BORDER
        keep[1:] |= symbols[:-1] != BORDER
        keep[np.cumsum(lengths) - lengths] = True
        counts = np.concatenate([[0], np.cumsum(keep)])
        return symbols[keep], counts[np.concatenate([[0], np.cumsum(lengths)])]

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the phrases that each language needs, and its symbols; 0 for a text without a letter."""
        symbols, bounds = self.written(texts)
        size = np.diff(bounds)
        pieces = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(size[owner] - within * SEGMENT, SEGMENT)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], (bounds[owner] + within * SEGMENT)[order], length[order]
        longest = int(length.max(initial=0))
        active = np.searchsorted(-length, -np.arange(longest), "left").tolist()
        place = np.minimum(start + np.arange(longest)[:, None], max(len(symbols) - 1, 0))
        steps = symbols[place] if longest else np.zeros((0, len(owner)), np.int32)
        found = [np.bincount(owner, p.phrases(steps, active), len(texts)) for p in self.parsers]
        # A text of borders alone is a single one.
        return np.array(found, np.float64).reshape(len(found), len(texts)).T, np.where(size > 1, size, 0)


def _languages(model: Broadcast) -> Languages:
    name, texts = model.value
    return worker_state(name, lambda: Languages(texts))


def _predict(model: Broadcast, keep_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _languages(model)
        languages = parser.languages
        for batch in batches:
            for part in W.runs(batch, "text"):
                phrases, size = parser.parse([t or "" for t in part.column("text").to_pylist()])
                lang, score, entropy = [], [], []
                for p, n in zip(phrases, size):
                    if not n or not languages:
                        lang.append("und")
                        score.append(0.0)
                        entropy.append(None)
                        continue
                    best = int(np.argmin(p))
                    # How far the others fall behind, in phrases, against the noise of a text of this size.
                    lead = np.exp(-(p - p[best]) / math.sqrt(1 + p[best]))
                    lang.append(languages[best])
                    score.append(float(1 / lead.sum()))
                    entropy.append(float(p[best] / n))
                kept = [c for c in part.schema.names if c != "text"]
                found = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "entropy": pa.array(entropy, pa.float64())}
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in kept} | found | ({"text": part.column("text")} if keep_text else {}))

    return run


PREDICTED = "lang_pred string, score double, entropy double"


def _model(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, sample_chars: int) -> Broadcast:
    """The learning texts: at most sample_chars code points a language, or one document."""
    texts = learning_texts(docs, id_col, text_col, lang_col, sample_docs, sample_chars)
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, texts))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, sample_docs: int = 24, sample_chars: int = 200_000) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score, entropy``. Learned from rows outside the held-out fold."""
    model = _model(docs, id_col, text_col, lang_col, sample_docs, sample_chars)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = texts.mapInArrow(_predict(model), "doc_id long, " + PREDICTED)
    return out.withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False)))


def apply_language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, min_score: float = 0.3, sample_docs: int = 24, sample_chars: int = 200_000) -> DataFrame:
    """The documents whose language is told with at least ``min_score``, with ``lang`` set to it; all columns stay. Those with no letter go.

    The columns ride along with the prediction, so nothing is shuffled.
    """
    model = _model(docs, id_col, text_col, lang_col, sample_docs, sample_chars)
    rows = docs.select(F.col(text_col).alias("text"), *[c for c, name in zip(carried(docs), docs.columns) if name != text_col])
    out = rows.mapInArrow(_predict(model, True), with_carried(PREDICTED + ", text string", rows))
    told = out.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return restored(told, docs, {lang_col: F.col("lang_pred"), text_col: F.col("text")})
