"""k-nearest-neighbour mutual information against all pairs."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import knn_info as KI


def psi(n):
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, n))


def plain(x, y, k):
    keep = [i for i in range(len(x)) if not math.isnan(x[i]) and sum(1 for j in range(len(x)) if y[j] == y[i] and not math.isnan(x[j])) > 1]
    x, y = [x[i] for i in keep], [y[i] for i in keep]
    total = 0.0
    for i in range(len(x)):
        same = sorted(abs(x[i] - x[j]) for j in range(len(x)) if j != i and y[j] == y[i])
        own = min(k, len(same))
        r = same[own - 1]
        m = sum(1 for v in x if (v == x[i] if r == 0 else x[i] - r < v < x[i] + r))
        total += psi(own) - psi(len(same) + 1) - psi(m)
    return psi(len(x)) + total / len(x)


@pytest.mark.parametrize("run", [4, 1 << 16])
def test_equals_all_pairs(spark, run):
    rng = np.random.default_rng(1)
    n = 240
    y = rng.choice([1, 2, 3], n, p=[.5, .3, .2])
    y[0] = 9                                         # a class of one row
    y[1:5] = 8                                       # a class smaller than k + 1
    pdf = pd.DataFrame({"y": y, "a": rng.normal(size=n) + y, "ties": np.round(rng.normal(size=n) + (y == 2), 1),
                        "few": rng.integers(0, 3, n).astype(float), "flat": np.ones(n), "hole": rng.random(n)})
    pdf.loc[::7, "hole"] = np.nan
    df = spark.createDataFrame(pdf)
    df = df.withColumn("hole", F.when(~F.isnan("hole"), F.col("hole")))
    cols = ["a", "ties", "few", "flat", "hole"]
    rows = KI.mutual_info_knn(df, cols, "y", 5, run).collect()
    assert all(r["mutual_info"] == max(0.0, r["estimate"]) for r in rows)
    got = {r["feature"]: r["estimate"] for r in rows}
    for c in cols:
        assert got[c] == pytest.approx(plain(pdf[c].tolist(), y.tolist(), 5), abs=1e-9), c
    assert KI.mutual_info_knn(df.limit(0), cols, "y").count() == 0


def test_digamma(spark):
    rows = spark.range(1, 2000).select("id", KI.digamma(F.col("id")).alias("v")).collect()
    assert all(r["v"] == pytest.approx(psi(r["id"]), abs=1e-12) for r in rows)
