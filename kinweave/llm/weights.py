"""Weights of the rules about a pair of records, learned from the table itself.

Pairs whose records both have an identifier are labelled by it. A logistic model over the named pieces of evidence (columns of text) is fitted
to them by Newton's method, drawn towards given weights: where a table has few labelled pairs the given weights stand, where it has many the
data decide, so how many namesakes a table of this size has is learned from it. The identifier itself is no evidence here, and pairs that only
met by it are no examples, as unlabelled pairs have no counterpart of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rules = dict[str, dict[str, float]]

#: Labelled pairs that are used at most, a sample by hash; and how far (standard deviation) a weight is expected to lie from the given one.
LABELLED, DRAW = 200_000, 1.0


def labelled_patterns(evidence: DataFrame, columns: list[str], most: int = LABELLED) -> pd.DataFrame:
    """Distinct combinations of ``columns`` among at most about ``most`` labelled pairs, with the numbers of equal (s) and unequal (o) identifiers."""
    known = evidence.where(F.col("same_uid").isin("same", "other") & F.col("met"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("id_1", "id_2"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    counted = known.groupBy(*[F.coalesce(c, F.lit("none")).alias(c) for c in columns]).agg(F.count_if(F.col("same_uid") == "same").alias("s"), F.count_if(F.col("same_uid") == "other").alias("o"))
    return counted.toPandas()


def fit(patterns: pd.DataFrame, base: float, rules: Rules, draw: float = DRAW, rounds: int = 50) -> tuple[float, Rules]:
    """(base, rules) of greatest posterior: a logistic model of s against o, with a Gaussian of width ``draw`` around the given weights.

    Evidence that no pattern shows keeps its given weight, evidence without a given weight starts from 0; no patterns change nothing.
    """
    names = sorted({(c, v) for c, vs in rules.items() for v in vs} | {(c, v) for c in rules if c in patterns for v in patterns[c]})
    at = {name: i for i, name in enumerate(names, 1)}
    x = np.zeros((len(patterns), len(names) + 1))
    x[:, 0] = 1.0
    for c in rules:
        if c in patterns:
            x[np.arange(len(patterns)), [at[c, v] for v in patterns[c]]] = 1.0
    given = np.array([base, *[rules[c].get(v, 0.0) for c, v in names]])
    same, n = patterns["s"].to_numpy(float), (patterns["s"] + patterns["o"]).to_numpy(float)
    w = given.copy()
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (same - n * p) - (w - given) / draw**2
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / draw**2, slope)
        w = w + step * min(1.0, 3.0 / np.abs(step).max()) if np.abs(step).max() > 0 else w
        if np.abs(step).max() < 1e-6:
            break
    out: Rules = {c: {} for c in rules}
    for (c, v), i in at.items():
        out[c][v] = float(w[i])
    return float(w[0]), out


def learn(evidence: DataFrame, base: float, rules: Rules, fixed: tuple[str, ...] = ("same_uid",)) -> tuple[float, Rules]:
    """``fit`` on the labelled pairs of ``evidence``; columns in ``fixed`` keep their given weights."""
    free = {c: vs for c, vs in rules.items() if c not in fixed}
    base, got = fit(labelled_patterns(evidence, list(free)), base, free)
    return base, got | {c: rules[c] for c in fixed if c in rules}
