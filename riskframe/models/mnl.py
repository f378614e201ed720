"""Multinomial logit by Newton's method on distributed sums.

Each iteration is one Spark job (:func:`sums.partition_sums`) returning the
log-likelihood, gradient and information matrix Σ Xᵀ(diag p − ppᵀ)X; the
driver solves the (d × d) system, d = (p+1)(K−1). Base class = first class
(utility 0), as in the reference's statsmodels/Keras models.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.tails import normal_sf
from .sums import cached_design, design_matrix, label_index, partition_sums

COND_LIMIT = 1e12


def softmax_rows(u: np.ndarray) -> np.ndarray:
    u = u - u.max(axis=1, keepdims=True)
    e = np.exp(u)
    return e / e.sum(axis=1, keepdims=True)


def softmax_into(u: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``softmax_rows`` into ``out``; ``u`` is overwritten."""
    u -= np.maximum.reduce(u, axis=1, keepdims=True)
    np.exp(u, out=u)
    return np.divide(u, np.add.reduce(u, axis=1, keepdims=True), out=out)


def mnl_batch_stats(x: np.ndarray, yi: np.ndarray, beta: np.ndarray, offset: np.ndarray | None = None,
                    with_info: bool = True) -> np.ndarray:
    """[ll, grad (d), info (d·d), n] for one batch. beta: (K−1, p+1)."""
    n, k1 = x.shape[0], beta.shape[0]
    u = np.zeros((n, k1 + 1))
    u[:, 1:] = x @ beta.T
    if offset is not None:
        u = u + offset
    p = softmax_rows(u)
    ll = np.log(np.clip(p[np.arange(n), yi], 1e-300, None)).sum()
    y = np.zeros_like(p)
    y[np.arange(n), yi] = 1.0
    r = y[:, 1:] - p[:, 1:]
    grad = (r.T @ x).ravel()
    d = grad.size
    parts = [np.array([ll]), grad]
    if with_info:
        pp = x.shape[1]
        info = np.zeros((d, d))
        for a in range(k1):
            for b in range(k1):
                w = p[:, a + 1] * ((1.0 if a == b else 0.0) - p[:, b + 1])
                info[a * pp:(a + 1) * pp, b * pp:(b + 1) * pp] = x.T @ (x * w[:, None])
        parts.append(info.ravel())
    parts.append(np.array([float(n)]))
    return np.concatenate(parts)


@dataclass
class MNLResult:
    features: list[str]
    classes: list
    beta: np.ndarray                 # (K−1, p+1): intercept first
    cov: np.ndarray                  # inverse information
    loglik: float
    n: int
    iterations: int
    converged: bool
    history: list = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return ["const"] + list(self.features)

    @property
    def std_err(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None)).reshape(self.beta.shape)

    def n_params(self) -> int:
        return int(np.count_nonzero(self.beta))

    def bic(self) -> float:
        return -2.0 * self.loglik + math.log(self.n) * self.n_params()

    def coef_rows(self, model: str = "MNL") -> list[tuple]:
        rows = []
        se = self.std_err
        for a, k in enumerate(self.classes[1:]):
            for j, t in enumerate(self.terms):
                b, s = float(self.beta[a, j]), float(se[a, j])
                z = b / s if s > 0 else math.nan
                p = 2 * normal_sf(abs(z)) if s > 0 else math.nan
                rows.append((model, f"y={k}", t, b, s, z, p, b - 1.959963984540054 * s, b + 1.959963984540054 * s))
        return rows

    def coef_table(self, spark: SparkSession, model: str = "MNL") -> DataFrame:
        return spark.createDataFrame(self.coef_rows(model), COEF_SCHEMA)

    def beta_dict(self) -> dict:
        return {k: list(self.beta[a]) for a, k in enumerate(self.classes[1:])}


COEF_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("equation", T.StringType()),
    T.StructField("term", T.StringType()), T.StructField("estimate", T.DoubleType()),
    T.StructField("std_err", T.DoubleType()), T.StructField("z", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()), T.StructField("ci_low", T.DoubleType()),
    T.StructField("ci_high", T.DoubleType()),
])


def check_information(info: np.ndarray, terms: list[str]) -> None:
    """Fail with the offending terms when the information matrix is singular."""
    w, v = np.linalg.eigh(info)
    if w[0] <= 0 or w[-1] / max(w[0], 1e-300) > COND_LIMIT:
        vec = np.abs(v[:, 0])
        top = np.argsort(-vec)[:4]
        names = [terms[i % len(terms)] for i in top if vec[i] > 0.1]
        raise ValueError(f"singular design: near-collinear terms {sorted(set(names))}")


def fit_mnl(df: DataFrame, features: list[str], label: str = "y", classes=(1, 2, 3),
            maxiter: int = 35, tol: float = 1e-8, init: np.ndarray | None = None,
            cache: bool = True) -> MNLResult:
    """Maximum-likelihood multinomial logit (Newton with step halving)."""
    classes = list(classes)
    data = cached_design(df, features, label, cache)
    k1, pp = len(classes) - 1, len(features) + 1
    d = k1 * pp
    beta = np.zeros((k1, pp)) if init is None else np.asarray(init, dtype="float64").reshape(k1, pp)
    terms = ["const"] + list(features)

    def stats(b):
        def fn(pdf):
            return mnl_batch_stats(design_matrix(pdf, features), label_index(pdf, label, classes), b)
        v = partition_sums(data, fn, 1 + d + d * d + 1)
        return v[0], v[1:1 + d], v[1 + d:1 + d + d * d].reshape(d, d), int(v[-1])

    ll, g, info, n = stats(beta)
    history = [ll]
    converged = False
    it = 0
    for it in range(1, maxiter + 1):
        check_information(info, terms)
        step = np.linalg.solve(info, g).reshape(k1, pp)
        t = 1.0
        while True:
            cand = beta + t * step
            ll2, g2, info2, _ = stats(cand)
            if ll2 >= ll - 1e-10 * abs(ll) or t < 1e-4:
                break
            t /= 2
        done = np.max(np.abs(t * step)) < tol or abs(ll2 - ll) < 1e-12 * max(1.0, abs(ll))
        beta, ll, g, info = cand, ll2, g2, info2
        history.append(ll)
        if done:
            converged = True
            break
    check_information(info, terms)
    cov = np.linalg.inv(info)
    if cache:
        data.unpersist()
    return MNLResult(list(features), classes, beta, cov, float(ll), n, it, converged, history)


def information_at(df: DataFrame, features: list[str], beta: np.ndarray, label: str = "y",
                   classes=(1, 2, 3)) -> tuple[float, np.ndarray, np.ndarray, int]:
    """J2 for fixed β: (loglik, gradient, information Σ Xᵀ(diag p − ppᵀ)X, n) in one job."""
    classes = list(classes)
    k1, pp = len(classes) - 1, len(features) + 1
    d = k1 * pp
    b = np.asarray(beta, dtype="float64").reshape(k1, pp)
    data = df.select(label, *features)

    def fn(pdf):
        return mnl_batch_stats(design_matrix(pdf, features), label_index(pdf, label, classes), b)
    v = partition_sums(data, fn, 1 + d + d * d + 1)
    return float(v[0]), v[1:1 + d], v[1 + d:1 + d + d * d].reshape(d, d), int(v[-1])
