"""Feature selection statistics.

* Spearman: average ranks of every column (one distributed rank pass over
  the long table), pivoted back to one row per key, then all pair sums of
  the ranks in one aggregation; ρ is Pearson of the ranks. t and p follow.
* Kendall τ-b against a label with few levels: counts per (x, class), exact
  prefix sums over the ordered distinct x (no pair join), concordant and
  discordant pairs and tie terms by aggregation; tie-corrected z.
* Mutual information with the label on equal-frequency bins (exact ranks).
"""

from __future__ import annotations


import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from .kendall import kendall_pairs, merge_counts as _merge_counts  # noqa: F401  (E4)
from .rank import attach_ranks, distinct_counts, to_long, value_prefix

MAX_FEATURES = 2_000
#: long rows of the rank table put together by one task.
CELLS_A_PART = 500_000


# ------------------------------------------------------------------ E1/E2
def rank_table(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """One row per key with the average rank of each column (NULL stays NULL).

    The long rows are dealt by key into parts of about ``CELLS_A_PART`` before they are
    put together, so the hash tables of both aggregation steps stay as small at any row count
    (left to itself, the first step builds them over whatever the join's tasks hold)."""
    long_df = to_long(df, cols, [key], "feature", "value")
    ranks = attach_ranks(long_df, ["feature"], "value", "r")
    parts = max(1, -(-df.count() * len(cols) // CELLS_A_PART))
    return ranks.select(key, "feature", "r").repartition(parts, key).groupBy(key).pivot("feature", cols).agg(F.first("r"))


def spearman_pairs(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """Long (col_i, col_j, rho, n) for i > j in ``cols`` order, over the rows
    without a NULL in any of ``cols`` (n of them).

    Ranks are taken on these rows; their sums, squares and products come from one
    pass over the rank table as a Gram matrix per partition, added by the
    sum-of-partials job (p(p+1)/2 + p + 1 numbers, for any number of columns)."""
    if len(cols) > MAX_FEATURES:
        raise ValueError("spearman_pairs: too many columns")
    rt = rank_table(df.dropna(subset=list(cols)), cols, key)
    idx = {c: i for i, c in enumerate(cols)}
    pairs = [(a, b) for a in cols for b in cols if idx[a] > idx[b]]
    return _spearman_from_gram(df.sparkSession, rt, cols, pairs)


def _spearman_from_gram(spark, rt: DataFrame, cols: list[str], pairs: list) -> DataFrame:
    from ..models.sums import partition_sums
    p = len(cols)
    iu = np.triu_indices(p)

    def fn(pdf: pd.DataFrame) -> np.ndarray:
        r = pdf[cols].to_numpy(dtype="float64")
        return np.concatenate([[float(len(r))], r.sum(0), (r.T @ r)[iu]])
    v = partition_sums(rt.select(*cols), fn, 1 + p + len(iu[0]))
    n, s = v[0], v[1:1 + p]
    g = np.zeros((p, p))
    g[iu] = v[1 + p:]
    g = g + np.triu(g, 1).T
    idx = {c: i for i, c in enumerate(cols)}
    rows = []
    for a, b in pairs:
        i, j = idx[a], idx[b]
        num = n * g[i, j] - s[i] * s[j]
        den = math.sqrt((n * g[i, i] - s[i] * s[i]) * (n * g[j, j] - s[j] * s[j]))
        rows.append((a, b, float(num / den) if den > 0 else None, int(n)))
    # one row per column pair: p(p−1)/2 rows, independent of the row count
    return spark.createDataFrame(rows, "col_i string, col_j string, rho double, n long")


def spearman_t(pairs: DataFrame) -> DataFrame:
    """t = ρ √((n−2)/(1−ρ²)) (|ρ| = 1 gives ±inf -> NULL here)."""
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, F.lit(1.0) - F.col("rho") ** 2))
    return pairs.withColumn("t", t)


def with_t_pvalue(pt: DataFrame) -> DataFrame:
    """Two-sided p of t with n−2 degrees of freedom (0 when |ρ| = 1)."""
    p = tails.t_two_sided_p_udf(F.col("t"), (F.col("n") - 2).cast("double"))
    return pt.withColumn("p_value", F.when(F.abs(F.col("rho")) == 1.0, F.lit(0.0)).otherwise(p))


def pairs_above(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """E1 report: pairs with |ρ| > threshold."""
    return pairs.where(F.abs(F.col("rho")) > F.lit(threshold))


def corr_degree(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """E5: per column, number of partners with |ρ| > threshold (both directions)."""
    strong = pairs_above(pairs, threshold)
    both = strong.select(F.col("col_i").alias("column")).unionByName(strong.select(F.col("col_j").alias("column")))
    return both.groupBy("column").agg(F.count(F.lit(1)).alias("degree"))


# ------------------------------------------------------------------ E3
def kendall_with_label(df: DataFrame, cols: list[str], label: str, classes: list) -> DataFrame:
    """τ-b and tie-corrected z of each column against a label with few levels.

    For each distinct x: counts per class c_k(x); prefix sums over smaller x
    give cum_k(x). Concordant = Σ c_k(x)·Σ_{j<k} cum_j(x), discordant =
    Σ c_k(x)·Σ_{j>k} cum_j(x).
    """
    long_df = to_long(df.select(label, *cols), cols, [label], "feature", "x").where(F.col("x").isNotNull())
    extra = {f"c{i}": F.sum((F.col(label) == F.lit(k)).cast("long")) for i, k in enumerate(classes)}
    dist = distinct_counts(long_df, ["feature"], "x", extra)
    cn = [f"c{i}" for i in range(len(classes))]
    pref = value_prefix(dist, ["feature"], "x", also=cn)
    # counts as doubles before they are multiplied: products of counts leave the long range
    c_ = [F.col(c).cast("double") for c in cn]
    below = [F.col(f"below_{c}").cast("double") for c in cn]
    conc = sum((c_[k] * sum((below[j] for j in range(k)), F.lit(0.0)) for k in range(len(cn))), F.lit(0.0))
    disc = sum((c_[k] * sum((below[j] for j in range(k + 1, len(cn))), F.lit(0.0)) for k in range(len(cn))),
               F.lit(0.0))
    t = F.col("cnt").cast("double")
    per = pref.groupBy("feature").agg(
        F.sum(conc).alias("C"), F.sum(disc).alias("D"),
        F.first("n").alias("n"),
        F.sum(t * (t - 1) / 2).alias("ties_x"),
        F.sum(t * (t - 1) * (2 * t + 5)).alias("vt"),
        F.sum(t * (t - 1)).alias("t1"),
        F.sum(t * (t - 1) * (t - 2)).alias("t2"),
        *[F.sum(F.col(c)).alias(f"u_{c}") for c in cn])
    u = [F.col(f"u_{c}").cast("double") for c in cn]
    n = F.col("n").cast("double")
    ties_y = sum((x * (x - 1) / 2 for x in u), F.lit(0.0))
    vu = sum((x * (x - 1) * (2 * x + 5) for x in u), F.lit(0.0))
    u1 = sum((x * (x - 1) for x in u), F.lit(0.0))
    u2 = sum((x * (x - 1) * (x - 2) for x in u), F.lit(0.0))
    n0 = n * (n - 1) / 2
    tau = F.try_divide(F.col("C") - F.col("D"), F.sqrt((n0 - F.col("ties_x")) * (n0 - ties_y)))
    var = ((n * (n - 1) * (2 * n + 5) - F.col("vt") - vu) / 18
           + F.col("t1") * u1 / (2 * n * (n - 1))
           + F.col("t2") * u2 / (9 * n * (n - 1) * (n - 2)))
    z = F.try_divide(F.col("C") - F.col("D"), F.sqrt(var))
    return per.select("feature", F.col("n").cast("long").alias("n"), tau.alias("tau_b"), z.alias("z"))


def with_normal_p(df: DataFrame, z: str = "z") -> DataFrame:
    return df.withColumn("p_value", tails.normal_two_sided_p_udf(F.col(z)))


# ------------------------------------------------------------------ E6/E7
def correlated_to_drop(pairs: DataFrame, label_assoc: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy choice. Columns are taken by |τ with the label|, largest first
    (ties: the smaller name); a column is dropped if |ρ| with a column kept before
    exceeds ``threshold``. Returns (column) rows to drop. The choice runs over the
    tables of columns and strong pairs, at most MAX_FEATURES columns."""
    tau = {r["feature"]: abs(r["tau_b"] or 0.0) for r in label_assoc.select("feature", "tau_b").collect()}
    near: dict[str, set[str]] = {}
    for r in pairs_above(pairs, threshold).select("col_i", "col_j").collect():
        near.setdefault(r["col_i"], set()).add(r["col_j"])
        near.setdefault(r["col_j"], set()).add(r["col_i"])
    kept: set[str] = set()
    dropped = []
    for c in sorted(tau, key=lambda c: (-tau[c], c)):
        if near.get(c, set()) & kept:
            dropped.append((c,))
        else:
            kept.add(c)
    return pairs.sparkSession.createDataFrame(dropped, "column string")


def unrelated_to_label(label_assoc_p: DataFrame, alpha: float = 0.05) -> DataFrame:
    """E7 rule: columns whose Kendall p with the label is ≥ alpha."""
    return label_assoc_p.where(F.col("p_value") >= F.lit(alpha)).select(F.col("feature").alias("column"))


# ------------------------------------------------------------------ E8
def mutual_info_binned(df: DataFrame, cols: list[str], label: str, bins: int = 10,
                       classes: list | None = None) -> DataFrame:
    """E8 (re-aimed): plug-in mutual information (nats) between each column cut
    into ``bins`` equal-frequency bins (exact ranks; tied values share a bin)
    and the label. Another estimator than the reference's k-NN one.

    Counts per class ride along the distinct (feature, value) table, so no
    row-level join back is needed (a hot value is one row throughout)."""
    long_df = to_long(df.select(label, *cols), cols, [label], "feature", "x").where(F.col("x").isNotNull())
    if classes is None:
        classes = sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect())
    extra = {f"c{i}": F.sum((F.col(label) == F.lit(k)).cast("long")) for i, k in enumerate(classes)}
    dist = distinct_counts(long_df, ["feature"], "x", extra)
    pref = value_prefix(dist, ["feature"], "x").withColumn(
        "bin", F.floor(F.col("below") * F.lit(bins) / F.col("n")).cast("int"))
    per_bin = pref.groupBy("feature", "bin").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(classes))])
    cont = per_bin.select("feature", "bin", F.explode(F.array(*[
        F.struct(F.lit(k).alias(label), F.col(f"c{i}").alias("nby")) for i, k in enumerate(classes)])).alias("s")
    ).select("feature", "bin", f"s.{label}", "s.nby").where(F.col("nby") > 0)
    wf = Window.partitionBy("feature")
    wb = Window.partitionBy("feature", "bin")
    wy = Window.partitionBy("feature", label)
    c = (cont.withColumn("n", F.sum("nby").over(wf)).withColumn("nb", F.sum("nby").over(wb))
         .withColumn("ny", F.sum("nby").over(wy)))
    term = (F.col("nby") / F.col("n")) * F.log(F.col("nby") * F.col("n") / (F.col("nb") * F.col("ny")))
    return c.groupBy("feature").agg(F.sum(term).alias("mutual_info"))
