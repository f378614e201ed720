"""Classification metrics (H1-H8, H12): accuracy, MAE, F1, log loss,
normalised confusion matrix and one-vs-rest AUC, per group (model, fold...).

Everything but AUC is one ``groupBy`` with partial aggregation. AUC uses the
exact distributed ranks of :mod:`rank` on distinct (group, class, score)
rows; no row-level join back is needed because the positives of each
distinct score are counted alongside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import value_prefix

#: probability floor of the log loss (float64 machine epsilon).
LOG_LOSS_EPS = 2.220446049250313e-16


def prob_cols(k: int = 3, prefix: str = "prob_c") -> list[str]:
    return [f"{prefix}{i}" for i in range(1, k + 1)]


def _key(group_cols: list[str]) -> list[str]:
    return group_cols if group_cols else ["__all"]


def _with_key(df: DataFrame, group_cols: list[str]) -> DataFrame:
    return df if group_cols else df.withColumn("__all", F.lit(1))


def clipped_true_prob(y: str, probs: list[str], classes: list[int], eps: float = LOG_LOSS_EPS) -> Column:
    """Probability of the true class after clipping to [eps, 1-eps] and renormalising."""
    clip = [F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps)) for p in probs]
    total = clip[0]
    for c in clip[1:]:
        total = total + c
    pt = F.lit(None).cast("double")
    for k, c in zip(classes, clip):
        pt = F.when(F.col(y) == F.lit(k), c).otherwise(pt)
    return pt / total


def basic_scores(pred: DataFrame, group_cols: list[str], y: str = "y", pred_col: str = "pred",
                 probs: list[str] | None = None, classes=(1, 2, 3)) -> DataFrame:
    """H2-H5: n, accuracy, MAE on class numbers, macro F1 (+ per class), log loss."""
    classes = list(classes)
    probs = probs or prob_cols(len(classes))
    d = _with_key(pred, group_cols)
    g = _key(group_cols)
    aggs = [F.count(F.lit(1)).alias("n"),
            F.avg((F.col(y) == F.col(pred_col)).cast("double")).alias("accuracy"),
            F.avg(F.abs(F.col(y) - F.col(pred_col)).cast("double")).alias("mae")]
    if probs:
        aggs.append((-F.avg(F.log(clipped_true_prob(y, probs, classes)))).alias("log_loss"))
    for k in classes:
        aggs += [F.sum(((F.col(y) == k) & (F.col(pred_col) == k)).cast("long")).alias(f"__tp{k}"),
                 F.sum((F.col(pred_col) == k).cast("long")).alias(f"__np{k}"),
                 F.sum((F.col(y) == k).cast("long")).alias(f"__nt{k}")]
    s = d.groupBy(*g).agg(*aggs)
    f1 = {}
    for k in classes:
        den = F.col(f"__np{k}") + F.col(f"__nt{k}")
        f1[f"f1_c{k}"] = F.when(den > 0, F.lit(2.0) * F.col(f"__tp{k}") / den).otherwise(F.lit(0.0))
    s = s.withColumns(f1)
    present = [F.when(F.col(f"__np{k}") + F.col(f"__nt{k}") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
               for k in classes]
    num = sum((F.col(f"f1_c{k}") for k in classes), F.lit(0.0))
    s = s.withColumn("f1_macro", num / sum(present, F.lit(0.0)))
    s = s.drop(*[c for c in s.columns if c.startswith("__tp") or c.startswith("__np")
                 or c.startswith("__nt")])
    return s.drop("__all") if not group_cols else s


def auc_ovr(pred: DataFrame, group_cols: list[str], y: str = "y", probs: list[str] | None = None,
            classes=(1, 2, 3), per_class: bool = False, **kw) -> DataFrame:
    """H1: one-vs-rest AUC per class = (R₁ − n₁(n₁+1)/2)/(n₁n₀) with average ranks
    of the class score; macro = plain mean over classes with positives."""
    classes = list(classes)
    probs = probs or prob_cols(len(classes))
    d = _with_key(pred, group_cols)
    g = _key(group_cols)
    stacked = d.select(*g, F.col(y).alias("__y"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("cls"), F.col(p).cast("double").alias("score"))
        for k, p in zip(classes, probs)])).alias("__s")).select(*g, "__y", "__s.cls", "__s.score")
    dist = stacked.groupBy(*g, "cls", "score").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum((F.col("__y") == F.col("cls")).cast("long")).alias("pos"))
    pref = value_prefix(dist, [*g, "cls"], "score", **kw)
    per = pref.groupBy(*g, "cls").agg(
        F.sum(F.col("pos") * (F.col("below") + (F.col("cnt") + 1) / F.lit(2.0))).alias("r1"),
        F.sum("pos").alias("n1"), F.first("n").alias("n"))
    # counts as doubles before they are multiplied: n1 * (n1 + 1) leaves the long range from 3e9 rows on
    per = per.withColumns({c: F.col(c).cast("double") for c in ("n1", "n")})
    per = per.withColumn("auc", F.when((F.col("n1") > 0) & (F.col("n") > F.col("n1")),
                                       (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / F.lit(2.0)) /
                                       (F.col("n1") * (F.col("n") - F.col("n1")))))
    if per_class:
        out = per.select(*g, "cls", "auc")
        return out.drop("__all") if not group_cols else out
    out = per.groupBy(*g).agg(F.avg("auc").alias("auc_ovr"))
    return out.drop("__all") if not group_cols else out


def classification_scores(pred: DataFrame, group_cols: list[str], y: str = "y", pred_col: str = "pred",
                          probs: list[str] | None = None, classes=(1, 2, 3), **kw) -> DataFrame:
    """H1-H5 in one table, one row per group."""
    classes = list(classes)
    probs = probs or prob_cols(len(classes))
    d = _with_key(pred, group_cols)
    g = _key(group_cols)
    basic = basic_scores(d, g, y, pred_col, probs, classes)
    auc = auc_ovr(d, g, y, probs, classes, **kw)
    out = basic.join(auc, on=g)
    return out.drop("__all") if not group_cols else out


def confusion_normalized(pred: DataFrame, group_cols: list[str], y: str = "y", pred_col: str = "pred",
                         classes=(1, 2, 3), normalize: str = "pred") -> DataFrame:
    """H6: confusion matrix on the full label grid; ``normalize='pred'`` divides
    by the column (prediction) total, an empty column gives 0."""
    classes = list(classes)
    d = _with_key(pred, group_cols)
    g = _key(group_cols)
    counts = d.groupBy(*g, F.col(y).alias("y_true"), F.col(pred_col).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("cnt"))
    lits = F.array(*[F.lit(k) for k in classes])
    grid = (d.select(*g).distinct()
            .withColumn("y_true", F.explode(lits)).withColumn("y_pred", F.explode(lits)))
    full = grid.join(counts, on=[*g, "y_true", "y_pred"], how="left").fillna(0, ["cnt"])
    by = {"pred": "y_pred", "true": "y_true"}.get(normalize)
    w = Window.partitionBy(*g, by) if by else Window.partitionBy(*g)
    tot = F.sum("cnt").over(w)
    out = full.withColumn("share", F.when(tot > 0, F.col("cnt") / tot).otherwise(F.lit(0.0)))
    return out.drop("__all") if not group_cols else out


def log_likelihood(pred: DataFrame, group_cols: list[str], y: str = "y", probs: list[str] | None = None,
                   classes=(1, 2, 3)) -> DataFrame:
    """H7: summed log-likelihood, mean loss · n and accuracy in percent."""
    classes = list(classes)
    probs = probs or prob_cols(len(classes))
    d = _with_key(pred, group_cols)
    g = _key(group_cols)
    pt = clipped_true_prob(y, probs, classes)
    out = d.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.sum(F.log(pt)).alias("loglik"),
                            (F.avg((F.col(y) == F.col("pred")).cast("double")) * 100).alias("accuracy_pct"))
    return out.drop("__all") if not group_cols else out


def bic(loglik: float, n: int, n_params: int) -> float:
    """H8: −2·LL + ln(n)·k."""
    return -2.0 * loglik + math.log(n) * n_params


def per_class_scores(pred: DataFrame, group_cols: list[str], y: str = "y", pred_col: str = "pred",
                     classes=(1, 2, 3)) -> DataFrame:
    """H4: per class tp, predicted and true counts, precision, recall, F1 (0 when undefined)."""
    classes = list(classes)
    d = _with_key(pred, group_cols)
    g = _key(group_cols)
    st = d.select(*g, F.col(y).alias("__y"), F.col(pred_col).alias("__p"),
                  F.explode(F.array(*[F.lit(k) for k in classes])).alias("cls"))
    agg = st.groupBy(*g, "cls").agg(
        F.sum(((F.col("__y") == F.col("cls")) & (F.col("__p") == F.col("cls"))).cast("long")).alias("tp"),
        F.sum((F.col("__p") == F.col("cls")).cast("long")).alias("n_pred"),
        F.sum((F.col("__y") == F.col("cls")).cast("long")).alias("n_true"))
    out = agg.select(
        *g, "cls", "tp", "n_pred", "n_true",
        F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0)).alias("precision"),
        F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(F.lit(0.0)).alias("recall"),
        F.when(F.col("n_pred") + F.col("n_true") > 0,
               F.lit(2.0) * F.col("tp") / (F.col("n_pred") + F.col("n_true"))).otherwise(F.lit(0.0)).alias("f1"))
    return out.drop("__all") if not group_cols else out
