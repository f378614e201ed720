"""Sampling and splitting (C1-C4) by a reproducible hash order inside each class.

Down-sample and splits cut the hash order at the n-th smallest hash of a class
(:mod:`nth`: counting passes, then a filter; no row is shuffled), and the folds rank
rows with :func:`rank.rank_by_hash`. No class is sorted in one task, and the same
seed gives the same rows on any cluster size (and in DuckDB, which computes the same md5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nth import first_in_hash_order
from .rank import rank_by_hash


def _round_half_up(x):
    return F.floor(x + F.lit(0.5)).cast("long")


def down_sample(df: DataFrame, label: str, key: str, remove: dict | None = None,
                remove_share: dict | None = None, keep: dict | None = None,
                seed: int = 10) -> DataFrame:
    """Drop rows of chosen classes, without replacement, reproducibly.

    ``remove={1: 1_000_000}`` removes exactly that many class-1 rows (the
    reference's rule; fails if the class is smaller), ``remove_share={1: 0.2}``
    removes ``round(0.2·n)`` rows, ``keep={1: n}`` keeps n rows. Other classes
    are kept whole. The kept rows of a class are those first in hash order.
    """
    remove, remove_share, keep = remove or {}, remove_share or {}, keep or {}
    classes = list(set(remove) | set(remove_share) | set(keep))
    keep_n = F.lit(None).cast("long")
    for c, n in remove.items():
        left = F.col("_n") - F.lit(n)
        left = F.when(left < 0, F.raise_error(F.lit("down_sample: class smaller than the rows to remove"))).otherwise(left)
        keep_n = F.when(F.col(label) == c, left).otherwise(keep_n)
    for c, s in remove_share.items():
        keep_n = F.when(F.col(label) == c, F.col("_n") - _round_half_up(F.col("_n") * F.lit(float(s)))
                        ).otherwise(keep_n)
    for c, n in keep.items():
        keep_n = F.when(F.col(label) == c, F.lit(n)).otherwise(keep_n)
    cut = F.col(label).isin(classes)
    chosen = first_in_hash_order(df.where(cut), label, key, seed, keep_n)
    return df.where(F.coalesce(~cut, F.lit(True)) | chosen)


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.3,
                     seed: int = 10, out: str = "split") -> DataFrame:
    """Per class, the first ``round(test_fraction·n_c)`` rows in hash order are
    'test', the rest 'train'."""
    n_test = _round_half_up(F.col("_n") * F.lit(float(test_fraction)))
    chosen = first_in_hash_order(df, label, key, seed, n_test)
    return df.withColumn(out, F.when(chosen, F.lit("test")).otherwise(F.lit("train")))


def stratified_kfold(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 10,
                     out: str = "fold") -> DataFrame:
    """Fold number 1..k = ((rank-1) mod k) + 1 inside each class, so fold
    sizes per class differ by at most one. Training part of fold i: ``fold != i``."""
    ranked = rank_by_hash(df, [label], key, seed)
    return ranked.withColumn(out, ((F.col("_rank") - 1) % F.lit(k) + 1).cast("int")).drop("_rank", "_n")


def tail_validation(df: DataFrame, label: str, key: str, fraction: float = 0.33, seed: int = 11,
                    out: str = "is_validation") -> DataFrame:
    """C4: hold out a validation share of the training rows (stratified, by hash)."""
    s = stratified_split(df, label, key, fraction, seed, out="__s")
    return s.withColumn(out, F.col("__s") == "test").drop("__s")
