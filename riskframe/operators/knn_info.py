"""Mutual information of numeric columns with the label by nearest neighbours
(Ross, 2014: the estimator for a discrete label and a continuous column).

Each column is one-dimensional, so the k nearest rows of a row within its class
lie within k distinct values on either side in the class's order. Distinct values with
counts are numbered by the distributed ranks of ``rank.value_prefix``, cut into runs of
``RUN`` values that also carry the k values next to them (the halo), and each run is
a few numpy passes. How many rows of any class lie inside the radius is read from prefix
counts of the whole column at the two ends of the interval: no pairs, no sort in one task.

Ties: no noise is added. A row whose k-th neighbour is as near as itself has radius 0 and
counts the rows of equal value; other radii count the rows strictly inside. Classes with one
row are left out of a column, smaller classes than k + 1 use all their other rows; NULL values take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import distinct_counts, null_safe_join, to_long, value_prefix

RUN = 1 << 16


def digamma(n: Column) -> Column:
    """ψ of positive whole numbers: shifted up by 10, then its asymptotic series."""
    x = n.cast("double")
    y = x + F.lit(10.0)
    z = F.lit(1.0) / (y * y)
    series = z * (F.lit(1 / 12) - z * (F.lit(1 / 120) - z * (F.lit(1 / 252) - z * (F.lit(1 / 240) - z * F.lit(1 / 132)))))
    out = F.log(y) - F.lit(0.5) / y - series
    for i in range(10):
        out = out - F.lit(1.0) / (x + F.lit(float(i)))
    return out


def radii(values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Distance of the k-th nearest other row for a row of each of the sorted distinct
    values; infinite where fewer rows are there."""
    upto = np.cumsum(counts)
    before = upto - counts
    out = np.full(len(values), np.inf)
    place = np.arange(len(values))
    for a in range(min(k, len(values) - 1) + 1):
        first = place - a
        ok = first >= 0
        # the first value at which the run from ``first`` on holds k + 1 rows, the row itself among them
        last = np.searchsorted(upto, before[np.maximum(first, 0)] + k + 1)
        ok &= last < len(values)
        last = np.maximum(last, place)
        last, first = np.minimum(last, len(values) - 1), np.maximum(first, 0)
        far = np.maximum(values - values[first], values[last] - values)
        out = np.where(ok, np.minimum(out, far), out)
    return out


def mutual_info_knn(df: DataFrame, cols: list[str], label: str, k: int = 10, run: int = RUN) -> DataFrame:
    """(feature, estimate, mutual_info) in nats: the estimate itself, and not below 0."""
    run = max(run, k)       # so that the halo lies within the next run
    rows = to_long(df.where(F.col(label).isNotNull()).select(F.col(label).alias("cls"), *cols), cols, ["cls"],
                   "feature", "x").where(F.col("x").isNotNull())
    each = distinct_counts(rows, ["feature", "cls"], "x")
    size = each.groupBy("feature", "cls").agg(F.sum("cnt").alias("nc")).where(F.col("nc") > 1)
    each = null_safe_join(each, size, ["feature", "cls"])
    # numbers of the distinct values within (feature, class)
    order = value_prefix(each.withColumn("one", F.lit(1)), ["feature", "cls"], "x", "one")
    at = F.floor(F.col("below") / F.lit(run))
    inside = F.pmod(F.col("below"), F.lit(run))
    runs = F.array_compact(F.array(at, F.when(inside < k, at - 1), F.when(inside >= run - k, at + 1)))
    dealt = order.select("feature", "cls", "x", "cnt", "nc", at.alias("home"), F.explode(runs).alias("run"))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        own = min(k, int(pdf["nc"].iloc[0]) - 1)
        pdf["r"] = radii(pdf["x"].to_numpy(), pdf["cnt"].to_numpy(), own)
        pdf["k"] = own
        return pdf.loc[pdf["home"] == pdf["run"], ["feature", "cls", "x", "cnt", "nc", "k", "r"]]

    kind = rows.schema["cls"].dataType.simpleString()
    found = dealt.groupBy("feature", "cls", "run").applyInPandas(
        near, f"feature string, cls {kind}, x double, cnt long, nc long, k long, r double")
    zero = F.col("r") == 0
    found = found.select("feature", "cls", "x", "cnt", "nc", "k", zero.alias("zero"),
                         F.when(zero, F.col("x")).otherwise(F.col("x") - F.col("r")).alias("lo"),
                         F.when(zero, F.col("x")).otherwise(F.col("x") + F.col("r")).alias("hi")).persist()
    # counts of the column at every value and every interval end
    points = (found.select("feature", "x", "cnt")
              .unionByName(found.select("feature", F.col("lo").alias("x"), F.lit(0).cast("long").alias("cnt")))
              .unionByName(found.select("feature", F.col("hi").alias("x"), F.lit(0).cast("long").alias("cnt")))
              .groupBy("feature", "x").agg(F.sum("cnt").alias("cnt")))
    places = value_prefix(points, ["feature"], "x").select("feature", "x", "below", (F.col("below") + F.col("cnt")).alias("upto"))
    lower = places.select("feature", F.col("x").alias("lo"), F.col("below").alias("lo_below"), F.col("upto").alias("lo_upto"))
    upper = places.select("feature", F.col("x").alias("hi"), F.col("below").alias("hi_below"), F.col("upto").alias("hi_upto"))
    m = F.when(F.col("zero"), F.col("hi_upto") - F.col("lo_below")).otherwise(F.col("hi_below") - F.col("lo_upto"))
    told = found.join(lower, ["feature", "lo"]).join(upper, ["feature", "hi"]).withColumn("m", m)
    sums = told.groupBy("feature").agg(
        F.sum("cnt").alias("n"),
        F.sum(F.col("cnt") * (digamma(F.col("k")) - digamma(F.col("nc")) - digamma(F.col("m")))).alias("s"))
    estimate = digamma(F.col("n")) + F.col("s") / F.col("n")
    return sums.select("feature", estimate.alias("estimate")).withColumn("mutual_info", F.greatest(F.lit(0.0), "estimate"))
