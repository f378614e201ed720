"""Class probabilities of linear-in-parameters models as pure column
expressions (stable softmax), so scoring is codegen'd JVM work on any
DataFrame, batch or stream.

Coefficient layout: ``beta[k]`` for each non-base class is
``[intercept, b_1, ..., b_p]`` in the order of ``features``; the base class
has utility 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.clean import argmax_label


def utility(features: Sequence[str], coefs: Sequence[float], intercept: bool = True) -> Column:
    """Σ b_j x_j (+ b_0), summed left to right."""
    coefs = [float(c) for c in coefs]
    if intercept:
        expr = F.lit(coefs[0])
        rest = coefs[1:]
    else:
        expr, rest = None, coefs
    for f, b in zip(features, rest):
        term = F.lit(b) * F.col(f)
        expr = term if expr is None else expr + term
    return expr if expr is not None else F.lit(0.0)


def softmax(utilities: Sequence[Column]) -> list[Column]:
    """exp(V_k − max V) / Σ exp(V_j − max V)."""
    m = F.greatest(*utilities) if len(utilities) > 1 else utilities[0]
    exps = [F.exp(u - m) for u in utilities]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return [e / total for e in exps]


def class_utilities(features: Sequence[str], beta: dict[int, Sequence[float]] | np.ndarray,
                    classes: Sequence[int] = (1, 2, 3), base: int = 1,
                    intercept: bool = True) -> list[Column]:
    """Utilities of all classes; the base class gets 0."""
    if isinstance(beta, np.ndarray):
        others = [k for k in classes if k != base]
        beta = {k: beta[i] for i, k in enumerate(others)}
    return [F.lit(0.0) if k == base else utility(features, beta[k], intercept) for k in classes]


def score_linear(df: DataFrame, features: Sequence[str], beta, keep: Sequence[str],
                 classes: Sequence[int] = (1, 2, 3), base: int = 1, intercept: bool = True,
                 prefix: str = "prob_c", offsets: Sequence[Column] | None = None) -> DataFrame:
    """Probabilities ``prob_c1..K`` and ``pred`` (argmax, first maximum wins).

    ``offsets`` adds a per-class term to each utility (e.g. a network output).
    """
    u = class_utilities(features, beta, classes, base, intercept)
    if offsets is not None:
        u = [a + b for a, b in zip(u, offsets)]
    # staged projections: each utility is computed once (no re-inlining into
    # every probability, which would blow up the generated code)
    un = [f"__u{k}" for k in classes]
    d = df.select(*[F.col(c) for c in keep], *[x.alias(n) for x, n in zip(u, un)])
    d = d.withColumn("__m", F.greatest(*[F.col(n) for n in un]) if len(un) > 1 else F.col(un[0]))
    en = [f"__e{k}" for k in classes]
    d = d.select(*[F.col(c) for c in keep], *[F.exp(F.col(n) - F.col("__m")).alias(e) for n, e in zip(un, en)])
    total = F.col(en[0])
    for e in en[1:]:
        total = total + F.col(e)
    d = d.withColumn("__t", total)
    names = [f"{prefix}{k}" for k in classes]
    out = d.select(*[F.col(c) for c in keep], *[(F.col(e) / F.col("__t")).alias(n) for e, n in zip(en, names)])
    return out.withColumn("pred", argmax_label(F.array(*[F.col(n) for n in names]), base=min(classes)))


def ordered_probabilities(features: Sequence[str], beta: Sequence[float], thresholds: Sequence[float]
                          ) -> list[Column]:
    """Cumulative logit: P(y ≤ k) = σ(θ_k − xβ); class probabilities are differences."""
    eta = utility(features, beta, intercept=False)
    cum = [F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(float(t)) - eta))) for t in thresholds]
    probs = [cum[0]]
    for a, b in zip(cum[:-1], cum[1:]):
        probs.append(b - a)
    probs.append(F.lit(1.0) - cum[-1])
    return probs


def score_ordered(df: DataFrame, features: Sequence[str], beta, thresholds, keep: Sequence[str],
                  prefix: str = "prob_c") -> DataFrame:
    probs = ordered_probabilities(features, beta, thresholds)
    names = [f"{prefix}{k}" for k in range(1, len(probs) + 1)]
    out = df.select(*[F.col(c) for c in keep], *[p.alias(n) for p, n in zip(probs, names)])
    return out.withColumn("pred", argmax_label(F.array(*[F.col(n) for n in names])))
