"""H0: exact ranks and prefix sums without a global sort in one task.

Two building blocks:

* :func:`rank_by_hash` — a reproducible random order inside each group
  (``md5(seed|key)``), used by the down-sample, split and folds. The first
  60 bits of the hash are uniform, so ``bits`` leading bits cut each group
  into ``2**bits`` equal buckets without sampling. Counts per (group, bucket)
  are a small table (groups × 2**bits rows); its running sums give each
  bucket's offset, and a ``row_number`` inside (group, bucket) finishes the
  rank. Work per task is ``n / 2**bits`` rows, however skewed the groups are.

* :func:`value_prefix` — for any numeric value: rows are first collapsed to
  distinct ``(group, value, count)`` (a hot value becomes one row), then cut
  into value ranges at approximate quantiles of the distinct values. The cut
  points only balance the work; the counts, offsets and running sums are
  exact, so every rank is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: distinct values handled by one window task before the value range is cut.
ROWS_PER_BUCKET = 1 << 18
MAX_BUCKETS = 1 << 14
#: hash buckets per group for the hash order (n / 2**bits rows per window
#: group: 1e12 rows in 3 classes -> ~5e6 rows per group at 16 bits).
HASH_BITS = 16


def hash_order(seed: int | str, key: str | Column) -> Column:
    """md5 hex of ``'<seed>|<key>'``: reproducible, same value in DuckDB."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")))


def hash_prefix(h: Column) -> Column:
    """First 15 hex digits of an md5 hex as a non-negative long (60 bits)."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def null_safe_join(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` in which NULL equals NULL; the columns appear once."""
    r = right.withColumnsRenamed({c: f"__r_{c}" for c in cols})
    on = [left[c].eqNullSafe(r[f"__r_{c}"]) for c in cols]
    return left.join(r, on, how).drop(*[f"__r_{c}" for c in cols])


def rank_by_hash(df: DataFrame, group_cols: list[str], key_col: str, seed: int | str,
                 rank_col: str = "_rank", size_col: str = "_n", bits: int = HASH_BITS) -> DataFrame:
    """Add the 1-based rank of each row inside its group in ``md5(seed|key)`` order
    (ties, practically absent, broken by the key), plus the group size.

    The bucket-count table (≤ groups × 2**bits rows) gets its running sums on
    the cluster; the join of the offsets back to the rows is sized by AQE at
    runtime (broadcast when the materialised table is small, else a shuffle
    join), so no counting job and no driver round trip are needed."""
    h = hash_order(seed, key_col)
    d = df.withColumn("__h", h).withColumn("__b", F.shiftright(hash_prefix(F.col("__h")), 60 - bits))
    counts = d.groupBy(*group_cols, "__b").agg(F.count(F.lit(1)).alias("__bn"))
    before = Window.partitionBy(*group_cols).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group_cols, "__b",
        F.coalesce(F.sum("__bn").over(before), F.lit(0)).alias("__off"),
        F.sum("__bn").over(Window.partitionBy(*group_cols)).alias(size_col),
    )
    within = Window.partitionBy(*group_cols, "__b").orderBy("__h", key_col)
    return (null_safe_join(d, offsets, [*group_cols, "__b"])
            .withColumn(rank_col, (F.col("__off") + F.row_number().over(within)).cast("long"))
            .drop("__h", "__b", "__off"))


def to_long(df: DataFrame, cols: list[str], id_cols: list[str], var: str = "feature",
            value: str = "value") -> DataFrame:
    """Wide numeric columns -> (ids..., feature, value double)."""
    return df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        id_cols, cols, var, value)


def distinct_counts(long_df: DataFrame, group_cols: list[str], value_col: str,
                    extra: dict[str, Column] | None = None) -> DataFrame:
    """Collapse rows to (group, value, cnt, extra sums...); NULL values are skipped."""
    aggs = [F.count(F.lit(1)).alias("cnt")] + [c.alias(n) for n, c in (extra or {}).items()]
    return long_df.where(F.col(value_col).isNotNull()).groupBy(*group_cols, value_col).agg(*aggs)


def _group_key(group_cols: list[str]) -> Column:
    return F.concat_ws("\u001f", *[F.col(g).cast("string") for g in group_cols])


def value_prefix(dist: DataFrame, group_cols: list[str], value_col: str, cnt_col: str = "cnt",
                 rows_per_bucket: int = ROWS_PER_BUCKET, max_buckets: int = MAX_BUCKETS,
                 also: list[str] | None = None) -> DataFrame:
    """For distinct (group, value, cnt) rows add ``below`` (rows of the group with a
    smaller value) and ``n`` (rows of the group). Average rank = below + (cnt+1)/2.

    ``also`` names further count columns whose prefix sums come out as
    ``below_<name>`` (e.g. counts per class for Kendall's τ)."""
    also = also or []
    dist = dist.persist()
    stats = dist.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("__nd"),
                                                  F.sum(cnt_col).alias("n")).persist()
    max_nd = int(stats.agg(F.max("__nd").alias("m")).first()["m"] or 0)
    stats_b = stats.drop("__nd")     # a row per group; AQE sizes the join
    buckets = 1
    while buckets < max_nd / rows_per_bucket and buckets < max_buckets:
        buckets *= 2
    if buckets == 1:
        before = Window.partitionBy(*group_cols).orderBy(value_col).rowsBetween(
            Window.unboundedPreceding, -1)
        out = dist.withColumns({("below" if c == cnt_col else f"below_{c}"):
                                F.coalesce(F.sum(c).over(before), F.lit(0)) for c in [cnt_col, *also]})
        return null_safe_join(out, stats_b, group_cols)
    # quantile cut points of the distinct values, per group (groups × buckets numbers)
    fracs = [i / buckets for i in range(1, buckets)]
    acc = max(10_000, 50 * buckets)
    cut_rows = dist.groupBy(*group_cols).agg(
        _group_key(group_cols).alias("__k"),
        F.percentile_approx(value_col, fracs, acc).alias("__cuts")).select("__k", "__cuts").collect()
    # groups × (buckets − 1) cut points: shipped once per executor as a
    # broadcast variable, not pickled into every task's closure
    cuts_b = dist.sparkSession.sparkContext.broadcast(
        {r["__k"]: np.asarray(r["__cuts"], dtype="float64") for r in cut_rows})

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series, v: pd.Series) -> pd.Series:
        cuts = cuts_b.value
        out = np.zeros(len(v), dtype=np.int32)
        vals = v.to_numpy(dtype="float64")
        for k, idx in key.groupby(key).indices.items():
            out[idx] = np.searchsorted(cuts[k], vals[idx], side="right")
        return pd.Series(out)

    d = dist.withColumn("__b", bucket_of(_group_key(group_cols), F.col(value_col).cast("double")))
    cols = [cnt_col, *also]
    names = ["below" if c == cnt_col else f"below_{c}" for c in cols]
    btot = d.groupBy(*group_cols, "__b").agg(*[F.sum(c).alias(f"__bt{i}") for i, c in enumerate(cols)])
    ob = Window.partitionBy(*group_cols).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = btot.select(*group_cols, "__b", *[F.coalesce(F.sum(f"__bt{i}").over(ob), F.lit(0)).alias(f"__off{i}")
                                               for i in range(len(cols))])
    before = Window.partitionBy(*group_cols, "__b").orderBy(value_col).rowsBetween(
        Window.unboundedPreceding, -1)
    out = null_safe_join(d, offsets, [*group_cols, "__b"]).withColumns({
        n: F.col(f"__off{i}") + F.coalesce(F.sum(c).over(before), F.lit(0))
        for i, (c, n) in enumerate(zip(cols, names))})
    out = out.drop("__b", *[f"__off{i}" for i in range(len(cols))])
    return null_safe_join(out, stats_b, group_cols)


def average_ranks(long_df: DataFrame, group_cols: list[str], value_col: str,
                  rank_col: str = "avg_rank", **kw) -> DataFrame:
    """Per distinct (group, value): average rank of the value among the group's
    rows (ties share the mean of their positions), 1-based."""
    pref = value_prefix(distinct_counts(long_df, group_cols, value_col), group_cols, value_col, **kw)
    return pref.withColumn(rank_col, F.col("below") + (F.col("cnt") + F.lit(1)) / F.lit(2.0))


def attach_ranks(long_df: DataFrame, group_cols: list[str], value_col: str,
                  rank_col: str = "avg_rank", salt: int = 64, hot_share: float = 0.01, **kw) -> DataFrame:
    """Average rank joined back onto every row (equi-join on (group, value)).

    A value holding at least ``hot_share`` of its group's rows is salted: its
    rows spread over ``salt`` join keys (a hash of the row) and its single
    rank row is repeated for each key, so no join task receives a hot value
    whole. The hot list is at most 1/hot_share values per group. Rows with a NULL
    value have no rank and take no part in the joins."""
    nulls = long_df.where(F.col(value_col).isNull()).withColumn(rank_col, F.lit(None).cast("double"))
    long_df = long_df.where(F.col(value_col).isNotNull())
    ranks = average_ranks(long_df, group_cols, value_col, rank_col, **kw).select(
        *group_cols, value_col, rank_col, "cnt", "n")
    is_hot = F.col("cnt") >= F.col("n") * F.lit(hot_share)
    hot = ranks.where(is_hot).select(*group_cols, value_col, F.lit(True).alias("__hot"))
    row_hash = F.xxhash64(*[F.col(c) for c in long_df.columns])
    salted = (null_safe_join(long_df, hot, [*group_cols, value_col], "left")
              .withColumn("__salt", F.when(F.col("__hot"), F.pmod(row_hash, F.lit(salt))).otherwise(F.lit(0)))
              .drop("__hot"))
    rk = ranks.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salt - 1)))
                                               .otherwise(F.array(F.lit(0))))).select(
        *group_cols, value_col, "__salt", rank_col)
    ranked = null_safe_join(salted, rk, [*group_cols, value_col, "__salt"], "left").drop("__salt")
    return ranked.unionByName(nulls)


def exact_median(long_df: DataFrame, group_cols: list[str], value_col: str,
                 out: str = "median", **kw) -> DataFrame:
    """Exact median per group (mean of the two middle values for even n), NULLs skipped.

    Unlike a single-task percentile aggregate, the work is spread by value range.
    """
    pref = value_prefix(distinct_counts(long_df, group_cols, value_col), group_cols, value_col, **kw)
    r_lo = F.floor((F.col("n") + 1) / 2)
    r_hi = F.ceil((F.col("n") + 1) / 2)
    covers = lambda r: (F.col("below") < r) & (F.col("below") + F.col("cnt") >= r)
    return (pref.where(covers(r_lo) | covers(r_hi))
            .groupBy(*group_cols)
            .agg(((F.max(F.when(covers(r_lo), F.col(value_col))) +
                   F.max(F.when(covers(r_hi), F.col(value_col)))) / F.lit(2.0)).alias(out)))
