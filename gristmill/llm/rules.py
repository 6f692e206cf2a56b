"""Conjunctions of thresholds over named features: their form, their evaluation by numpy and as Spark expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Condition(NamedTuple):
    feature: str
    #: True: the feature is over the threshold; False: at or under it.
    over: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.over else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def simplified(rule: Iterable[Condition]) -> Rule:
    """The rule with one bound per feature and side, in a fixed order."""
    bounds: dict[tuple[str, bool], float] = {}
    for c in rule:
        held = bounds.get((c.feature, c.over))
        bounds[c.feature, c.over] = c.threshold if held is None else (max if c.over else min)(held, c.threshold)
    return tuple(sorted(Condition(f, o, t) for (f, o), t in bounds.items()))


def holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= x[c.feature] > c.threshold if c.over else x[c.feature] <= c.threshold
    return out


def compiled(rule: Rule, features: dict[str, Column]) -> Column:
    parts = [features[c.feature] > F.lit(c.threshold) if c.over else features[c.feature] <= F.lit(c.threshold) for c in rule]
    return reduce(Column.__and__, parts, F.lit(True))


def cuts(values: np.ndarray, n: int) -> np.ndarray:
    """At most n thresholds between distinct neighbouring quantiles."""
    q = np.unique(np.quantile(values, np.linspace(0, 1, n + 2)))
    return (q[1:] + q[:-1]) / 2 if len(q) > 1 else q[:0]
