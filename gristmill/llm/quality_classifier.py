"""Quality classifier: a sparse rule ensemble over document statistics.

1. Statistics of every whole text, in one pass.
2. Shallow regression trees are boosted on a bounded sample of labelled rows;
   every node's path from the root is a conjunctive rule.
3. A logistic model over the rules is fitted with a lasso penalty (accelerated
   proximal gradient), which sets most weights to exactly 0.
4. The rules with a weight become a Spark expression: the score of a document
   is computed by generated JVM code, from its statistics.

Rules for odd input: null and empty texts are scored like any other, from
statistics of 0. Where no label may be learned from, the score is 0.5; where
all labels are alike, their smoothed share. Rows with a null doc_id are never
learned from, have ``held_out`` false and are scored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import durable, fold
from gristmill.llm.rules import Condition, Rule, compiled, cuts, holds, simplified
from gristmill.llm.statistics import features, labelled, statistics

#: Rows to learn from, about.
MAX_ROWS = 20_000
HELD_OUT_FOLD = 2


def grow_trees(x: dict[str, np.ndarray], y: np.ndarray, *, trees: int = 40, depth: int = 3, least: int = 10, rate: float = 0.3, n_cuts: int = 40) -> list[Rule]:
    """The distinct rules of boosted trees' nodes, in order of discovery."""
    names = list(x)
    thresholds = [cuts(x[f], n_cuts) for f in names]
    binned = [np.searchsorted(t, x[f], "left") for f, t in zip(names, thresholds)]
    n, logit = len(y), np.zeros(len(y))
    found: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        residual, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        stack: list[tuple[Rule, np.ndarray]] = [((), np.arange(n))]
        while stack:
            rule, rows = stack.pop()
            g, h = residual[rows], weight[rows]
            if rule:
                found.setdefault(simplified(rule))
            best = None
            if len(rule) < depth and len(rows) >= 2 * least:
                total_g, total_h = g.sum(), h.sum()
                for k, f in enumerate(names):
                    m = len(thresholds[k])
                    if not m:
                        continue
                    b = binned[k][rows]
                    cg, ch, cn = (np.cumsum(np.bincount(b, w, m + 1))[:m] for w in (g, h, None))
                    gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
                    gain[(cn < least) | (len(rows) - cn < least)] = -1
                    i = int(np.argmax(gain))
                    if gain[i] > 1e-3 and (best is None or gain[i] > best[0]):
                        best = (gain[i], k, i)
            if best is None:
                logit[rows] += rate * g.sum() / (h.sum() + 1)
                continue
            _, k, i = best
            low = binned[k][rows] <= i
            for over, own in ((False, rows[low]), (True, rows[~low])):
                stack.append(((*rule, Condition(names[k], over, float(thresholds[k][i]))), own))
    return list(found)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean logistic loss plus penalty * |weights|; the intercept is free."""
    n, m = r.shape
    step = 4 / (np.linalg.norm(r, 2) ** 2 / n + 1)
    w, b = np.zeros(m), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-(r @ vw + vb))) - y) / n
        nw = vw - step * (r.T @ error)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * error.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        done = np.abs(nw - w).max(initial=0) + abs(nb - b) < 1e-6
        w, b, t = nw, nb, nt
        if done:
            break
    return w, b


class RuleEnsemble:
    """Weighted rules and an intercept."""

    def __init__(self, terms: list[tuple[Rule, float]], intercept: float):
        self.terms, self.intercept = terms, intercept

    def score(self, expressions: dict[str, Column]) -> Column:
        """The model as one expression: the logistic function of the intercept and the weights of the rules that hold."""
        logit = F.lit(self.intercept)
        for rule, weight in self.terms:
            logit = logit + F.when(compiled(rule, expressions), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))

    def predict(self, x: dict[str, np.ndarray], n: int) -> np.ndarray:
        logit = np.full(n, self.intercept)
        for rule, weight in self.terms:
            logit += weight * holds(rule, x, n)
        return 1 / (1 + np.exp(-logit))


def fit(x: dict[str, np.ndarray], y: np.ndarray, *, penalty: float = 1e-3, **tree_options) -> RuleEnsemble:
    n = len(y)
    if n == 0:
        return RuleEnsemble([], 0.0)
    prior = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    if y.min() == y.max():
        return RuleEnsemble([], prior)
    rules = grow_trees(x, y, **tree_options)
    if not rules:
        return RuleEnsemble([], prior)
    r = np.stack([holds(rule, x, n) for rule in rules], 1).astype(np.float64)
    centre = r.mean(0)
    w, b = lasso_logistic(r - centre, y, penalty)
    return RuleEnsemble([(rule, float(v)) for rule, v in zip(rules, w) if v], float(b - centre @ w))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, label_col: str = "quality", max_rows: int = MAX_ROWS, threshold: float = 0.7) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``. Learned from rows outside the held-out fold, about ``max_rows`` of them."""
    stats = durable(statistics(docs, id_col, text_col), "statistics")
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT_FOLD, F.lit(False))
    sample = labelled(stats, labels, label_col, max_rows, held_out)
    x = {f: sample[f].to_numpy(float) for f in features()}
    model = fit(x, (sample["label"].to_numpy() >= 1).astype(float))
    scored = stats.select("doc_id", held_out.alias("held_out"), *[e.alias(n) for n, e in features().items()])
    return scored.select("doc_id", "held_out", model.score({f: F.col(f) for f in x}).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
