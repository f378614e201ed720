"""Model comparison tests (H13, I1-I3) on long (model, block, value) tables.

* Friedman: average ranks of the models inside each block (a window per
  block), rank sums per model, tie-corrected χ² (stats::friedman.test form).
* Pairwise rank-sum (Wilcoxon / Mann-Whitney) for every model pair: rows
  are routed to their pairs by an equi-join on a small (pair, model) table,
  ranked per pair with the distributed prefix sums of :mod:`rank`; normal
  approximation with continuity and tie correction, exact distribution for
  small samples without ties.
* Benjamini-Hochberg adjustment over a window.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from .pairs import all_pairs
from .rank import null_safe_join, value_prefix



def block_ranks(df: DataFrame, group: str, block: str, value: str, out: str = "rank") -> DataFrame:
    """Average rank (1 = smallest) of each row's value inside its block."""
    w = Window.partitionBy(block).orderBy(value)
    ties = Window.partitionBy(block, value)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


def complete_blocks(df: DataFrame, group: str, block: str) -> DataFrame:
    """Keep blocks that contain every group exactly once (complete design)."""
    k = df.select(group).distinct().count()
    w = Window.partitionBy(block)
    return (df.withColumn("__k", F.count(F.lit(1)).over(w))
            .withColumn("__kd", F.size(F.collect_set(group).over(w)))
            .where((F.col("__k") == k) & (F.col("__kd") == k)).drop("__k", "__kd"))


def friedman(df: DataFrame, group: str, block: str, value: str) -> DataFrame:
    """One row: k, n, tie-corrected χ², df. p via :func:`with_p`.

    χ² = 12 Σ_j (R_j − n(k+1)/2)² / (n k (k+1) − Σ(t³ − t)/(k − 1)),
    R_j = rank sum of group j over the n blocks, t = tie sizes in a block.
    """
    r = block_ranks(df, group, block, value)
    sums = r.groupBy(group).agg(F.sum("rank").alias("rank_sum"), F.count(F.lit(1)).alias("n_g"))
    everything = Window.partitionBy()  # over the per-model table: ≤ number of models rows
    sums = (sums.withColumn("k", F.count(F.lit(1)).over(everything))
            .withColumn("n", F.max("n_g").over(everything)))
    dev = sums.agg(F.sum(F.pow(F.col("rank_sum") - F.col("n") * (F.col("k") + 1) / F.lit(2.0), 2)).alias("dev"),
                   F.first("k").alias("k"), F.first("n").alias("n")).withColumn("__one", F.lit(1))
    ties = (r.groupBy(block, "rank").agg(F.count(F.lit(1)).alias("t"))
            .agg(F.sum(F.pow(F.col("t"), 3) - F.col("t")).alias("tie_sum")).withColumn("__one", F.lit(1)))
    return dev.join(ties, "__one").select(
        F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"),
        (F.lit(12.0) * F.col("dev") / (F.col("n") * F.col("k") * (F.col("k") + 1) -
                                       F.col("tie_sum") / (F.col("k") - 1))).alias("statistic"),
        (F.col("k") - 1).cast("long").alias("df"))


def friedman_rank_sums(df: DataFrame, group: str, block: str, value: str) -> DataFrame:
    r = block_ranks(df, group, block, value)
    return r.groupBy(group).agg(F.sum("rank").alias("rank_sum"), F.avg("rank").alias("mean_rank"))


def with_p(fr: DataFrame) -> DataFrame:
    """Add the χ² upper-tail p-value to a :func:`friedman` row."""
    return fr.withColumn("p_value", tails.chi2_sf_udf(F.col("statistic"), F.col("df").cast("double")))


@lru_cache(maxsize=None)
def _wilcox_counts(m: int, n: int) -> tuple:
    """Number of (m, n) arrangements per value of the Mann-Whitney U (DP)."""
    # f[i][j][u] built iteratively over rows: counts for i of x and j of y.
    prev = [[1] for _ in range(n + 1)]  # i = 0: U = 0 for any j
    for i in range(1, m + 1):
        cur = [[1]]  # j = 0: U = 0
        for j in range(1, n + 1):
            a = cur[j - 1]         # last element is from y: U unchanged
            b = prev[j]            # last element is from x: U += j
            size = max(len(a), len(b) + j)
            row = [0] * size
            for u, c in enumerate(a):
                row[u] += c
            for u, c in enumerate(b):
                row[u + j] += c
            cur.append(row)
        prev = cur
    return tuple(prev[n])


def wilcox_exact_p(w: float, m: int, n: int) -> float:
    """Two-sided exact p of the rank-sum statistic W (= U of the first sample)."""
    counts = _wilcox_counts(m, n)
    total = float(sum(counts))
    q = int(round(w))
    if q > m * n / 2:
        p = sum(counts[q:]) / total
    else:
        p = sum(counts[: q + 1]) / total
    return min(1.0, 2.0 * p)


def pairwise_ranksum(df: DataFrame, group: str, value: str) -> DataFrame:
    """For each pair a < b: W of a, n_a, n_b, tie sum, z (unadjusted). All pairs come from one
    pass over the values (:mod:`pairs`); a pair's row carries counts as doubles, as products
    of counts leave the long range. An all-tied pair has a NULL z."""
    st = all_pairs(df, group, value).where((F.col("n_a") > 0) & (F.col("n_b") > 0))
    n = F.col("n_a") + F.col("n_b")
    mu = F.col("n_a") * F.col("n_b") / F.lit(2.0)
    sigma = F.sqrt(F.col("n_a") * F.col("n_b") / F.lit(12.0) * ((n + 1) - F.col("tie_sum") / (n * (n - 1))))
    d = F.col("w") - mu
    return st.select("model_a", "model_b", "w", F.col("n_a").cast("long").alias("n_a"),
                     F.col("n_b").cast("long").alias("n_b"), "tie_sum",
                     F.try_divide(d - F.signum(d) * F.lit(0.5), sigma).alias("z"))


def ranksum_p(st: DataFrame, exact_below: int = 50) -> DataFrame:
    """p-values for :func:`pairwise_ranksum` rows: exact without ties when both
    samples are below ``exact_below``, else the corrected normal approximation."""
    exact = F.pandas_udf(_exact_p_series(exact_below), "double")
    normal = tails.normal_two_sided_p_udf(F.col("z"))
    use_exact = (F.col("tie_sum") == 0) & (F.col("n_a") < exact_below) & (F.col("n_b") < exact_below)
    return st.withColumn("p_value", F.when(use_exact, exact(F.col("w"), F.col("n_a"), F.col("n_b")))
                         .otherwise(normal))


def _exact_p_series(exact_below: int):
    def run(w: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        # the branch is chosen per row, the function sees all rows of a batch
        return pd.Series([wilcox_exact_p(a, int(b), int(c)) if b < exact_below and c < exact_below else math.nan
                          for a, b, c in zip(w, m, n)])
    return run


BH_RUN = 1 << 20


def bh_adjust(df: DataFrame, p: str = "p_value", out: str = "p_adj", partition: list[str] | None = None,
              run: int = BH_RUN) -> DataFrame:
    """Benjamini-Hochberg: min over p' ≥ p of p'·m/rank(p'), capped at 1
    (ties share the largest rank, as R's p.adjust). A NULL p stays NULL and is not counted.

    Ranks are distributed (distinct p values with counts); the minimum from above is taken
    within runs of the order and over the later runs' minima, one row per run."""
    part = partition or ["__all"]
    rows = df if partition else df.withColumn("__all", F.lit(0))
    dist = rows.where(F.col(p).isNotNull()).groupBy(*part, p).agg(F.count(F.lit(1)).alias("cnt"))
    ranked = (value_prefix(dist, part, p)
              .withColumn("__v", F.col(p) * F.col("n") / (F.col("below") + F.col("cnt")))
              .withColumn("__run", F.floor(F.col("below") / F.lit(run))))
    own = Window.partitionBy(*part, "__run").orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*part).orderBy(F.col("__run").desc()).rowsBetween(Window.unboundedPreceding, -1)
    runs = ranked.groupBy(*part, "__run").agg(F.min("__v").alias("__low")).withColumn("__later", F.min("__low").over(later))
    adjusted = null_safe_join(ranked.withColumn("__own", F.min("__v").over(own)), runs.drop("__low"), [*part, "__run"])
    table = adjusted.select(*part, F.col(p), F.least(F.lit(1.0), F.col("__own"), F.col("__later")).alias(out))
    return null_safe_join(rows, table, [*part, p], "left").drop("__all").select(*df.columns, out)


def metric_mean_rank(df: DataFrame, model: str, metric: str, fold: str, value: str,
                     higher_is_better: dict[str, bool] | None = None) -> DataFrame:
    """Rank the models per (metric, fold) (1 = best), then average over folds."""
    hib = higher_is_better or {}
    better = F.lit(False)
    for m, flag in hib.items():
        better = F.when(F.col(metric) == m, F.lit(flag)).otherwise(better)
    key = F.when(better, -F.col(value)).otherwise(F.col(value))
    d = df.withColumn("__key", key)
    r = block_ranks(d.withColumn("__blk", F.concat_ws("\u001f", F.col(metric), F.col(fold).cast("string"))),
                    model, "__blk", "__key")
    return r.groupBy(model, metric).agg(F.avg("rank").alias("mean_rank"))
