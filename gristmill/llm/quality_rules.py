"""Quality rules: a fixed base check, then a learned decision list over document statistics.

The list is learned by sequential covering on a bounded sample of labelled
rows. A rule for poor documents is grown on two thirds of the sample by adding
the threshold condition of most information gain until it holds for no good
document or gains nothing, then pruned on the other third by cutting its last
conditions while that raises (poor - good) / (poor + good) there. It is kept if
it is precise enough on both parts; the rows that it covers leave the sample,
and the next is grown. The list becomes an ordered Spark ``CASE WHEN``: the
first rule that holds names why a document goes, and one that meets none stays.

Rules for odd input: null and empty texts have no words and fail the base
check. Without labels, or with labels of one kind, the list is empty and the
base check alone decides. Rows with a null doc_id are judged, never learned from.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import durable, fold
from gristmill.llm.rules import Condition, Rule, compiled, cuts, holds, simplified
from gristmill.llm.statistics import features, labelled, statistics

MAX_ROWS = 20_000
HELD_OUT_FOLD = 2


def _entropy_gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Information gain of a condition that keeps p of p0 positive and n of n0 negative rows, weighted by the positives kept."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, gain, -np.inf)


def grow(x: dict[str, np.ndarray], poor: np.ndarray, most: int, n_cuts: int = 48) -> Rule:
    rule: list[Condition] = []
    live = np.ones(len(poor), bool)
    while len(rule) < most and (live & ~poor).any():
        p0, n0, best = float((live & poor).sum()), float((live & ~poor).sum()), None
        for f, values in x.items():
            own, is_poor = values[live], poor[live]
            t = cuts(own, n_cuts)
            if not len(t):
                continue
            b = np.searchsorted(t, own, "left")
            under_p, under_n = (np.cumsum(np.bincount(b[m], minlength=len(t) + 1))[: len(t)].astype(float) for m in (is_poor, ~is_poor))
            for over, p, n in ((False, under_p, under_n), (True, p0 - under_p, n0 - under_n)):
                gain = _entropy_gain(p0, n0, p, n)
                i = int(np.argmax(gain))
                if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                    best = (gain[i], Condition(f, over, float(t[i])))
        if best is None:
            break
        rule.append(best[1])
        live &= holds((best[1],), x, len(poor))
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], poor: np.ndarray) -> Rule:
    def value(r: Rule) -> float:
        on = holds(r, x, len(poor))
        p, n = int((on & poor).sum()), int((on & ~poor).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if value(rule[:k]) >= value(best):
            best = rule[:k]
    return best


def decision_list(x: dict[str, np.ndarray], poor: np.ndarray, *, max_rules: int = 16, max_conditions: int = 4, precision: float = 0.95, least: int = 5) -> list[Rule]:
    """Ordered rules for poor rows. Rows are dealt to growing and pruning by position, so the sample's order should be by a hash."""
    rules: list[Rule] = []
    left = np.ones(len(poor), bool)
    part = np.arange(len(poor)) % 3 == 2
    while len(rules) < max_rules:
        g, p = left & ~part, left & part
        if (poor & g).sum() < least:
            break
        rule = grow({f: v[g] for f, v in x.items()}, poor[g], max_conditions)
        if not rule:
            break
        rule = prune(rule, {f: v[p] for f, v in x.items()}, poor[p])
        on = holds(rule, x, len(poor)) & left
        ok = [(on & m & poor).sum() >= precision * max(1, (on & m).sum()) for m in (g, p)]
        if not all(ok) or (on & poor).sum() < least:
            break
        rules.append(simplified(rule))
        left &= ~on
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label_col: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reason, kept``.

    ``reason`` is the text of the first rule met, null where the list keeps the document.
    """
    stats = durable(statistics(docs, id_col, text_col), "statistics")
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False))
    sample = labelled(stats.where(~base_failed()), labels, label_col, max_rows, held_out)
    rules = decision_list({f: sample[f].to_numpy(float) for f in features()}, sample["label"].to_numpy() < 1)
    named = features()
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(compiled(rule, named), F.lit(" and ".join(map(str, rule)))).otherwise(verdict)
    out = stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict.alias("reason"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("reason").isNull())
