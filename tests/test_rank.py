import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import rank as R


def _ties(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "g": rng.integers(0, 3, n), "v": rng.integers(0, 5, n).astype(float)})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("rows_per_bucket", [1 << 21, 2])
def test_average_ranks_match_pandas(spark, rows_per_bucket):
    df, pdf = _ties(spark)
    got = R.attach_ranks(df, ["g"], "v", rows_per_bucket=rows_per_bucket).toPandas().sort_values("id")
    exp = pdf.groupby("g")["v"].rank(method="average")
    assert np.allclose(got["avg_rank"].to_numpy(), exp.sort_index().to_numpy())
    # rank sum = n(n+1)/2 per group
    for g, part in got.groupby("g"):
        n = len(part)
        assert part["avg_rank"].sum() == pytest.approx(n * (n + 1) / 2)


@pytest.mark.parametrize("rows_per_bucket", [1 << 21, 3])
def test_exact_median(spark, rows_per_bucket):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=101), np.full(40, 0.25)])
    pdf = pd.DataFrame({"g": ["a"] * len(vals), "v": vals})
    pdf.loc[5, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    med = R.exact_median(df, ["g"], "v", rows_per_bucket=rows_per_bucket).first()["median"]
    assert med == pytest.approx(np.nanmedian(pdf["v"]))


def test_rank_by_hash_is_md5_order(spark):
    df, pdf = _ties(spark, 300)
    got = R.rank_by_hash(df, ["g"], "id", 10, bits=4).toPandas()
    pdf["h"] = [hashlib.md5(f"10|{i}".encode()).hexdigest() for i in pdf["id"]]
    pdf["r"] = pdf.sort_values(["h", "id"]).groupby("g").cumcount() + 1
    m = got.merge(pdf[["id", "r"]], on="id")
    assert (m["_rank"] == m["r"]).all()
    assert (m.groupby("g")["_n"].first() == pdf.groupby("g").size()).all()


def test_value_prefix_independent_of_partitioning(spark):
    df, _ = _ties(spark)
    a = R.attach_ranks(df, ["g"], "v").orderBy("id").collect()
    b = R.attach_ranks(df.repartition(7), ["g"], "v", rows_per_bucket=2).orderBy("id").collect()
    assert [r["avg_rank"] for r in a] == [r["avg_rank"] for r in b]


@pytest.mark.parametrize("rows_per_bucket", [1 << 20, 40, 7])
def test_kendall_pairs_brute_force(spark, rows_per_bucket):
    from riskframe.operators.select import kendall_pairs
    rng = np.random.default_rng(9)
    n = 120
    a = rng.integers(0, 5, n).astype(float)
    b = a + rng.integers(0, 3, n)
    c = rng.normal(size=n).round(1)
    c[:40] = 0.0                       # a hot value
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": c})
    got = {(r["col_i"], r["col_j"]): r for r in
           kendall_pairs(spark.createDataFrame(pdf), ["a", "b", "c"], "id", rows_per_task=rows_per_bucket).collect()}

    def brute(x, y):
        cc = cd = tx = ty = 0
        for i in range(n):
            for j in range(i):
                sx, sy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
                if sx * sy > 0:
                    cc += 1
                elif sx * sy < 0:
                    cd += 1
                tx += sx == 0
                ty += sy == 0
        n0 = n * (n - 1) / 2
        return (cc - cd) / np.sqrt((n0 - tx) * (n0 - ty))
    for (i, j), r in got.items():
        assert r["tau_b"] == pytest.approx(brute(pdf[i].to_numpy(), pdf[j].to_numpy()), abs=1e-12)
    assert len(got) == 3


def test_attach_ranks_with_hot_value_is_salted_and_exact(spark):
    rng = np.random.default_rng(12)
    n = 600
    v = rng.normal(size=n).round(2)
    v[: n // 3] = 7.0                                  # a third of the rows share one value
    pdf = pd.DataFrame({"id": np.arange(n), "g": "a", "v": v})
    got = R.attach_ranks(spark.createDataFrame(pdf), ["g"], "v", salt=8, hot_share=0.05).toPandas()
    got = got.sort_values("id")
    assert len(got) == n
    exp = pdf["v"].rank(method="average").to_numpy()
    assert np.allclose(got["avg_rank"].to_numpy(), exp)


def test_split_with_dominant_class(spark):
    from riskframe.operators import split as SP
    n = 2000
    y = np.where(np.arange(n) < 1800, 1, 2)          # 90 % in one class
    df = spark.createDataFrame(pd.DataFrame({"loan_id": np.arange(n), "y": y}))
    out = SP.stratified_split(df, "y", "loan_id", 0.3, 5).groupBy("y", "split").count().toPandas()
    got = {(r.y, r.split): r["count"] for _, r in out.iterrows()}
    assert got[(1, "test")] == 540 and got[(1, "train")] == 1260
    assert got[(2, "test")] == 60 and got[(2, "train")] == 140


def test_spearman_equals_pandas_with_and_without_nulls(spark):
    from riskframe.operators.select import spearman_pairs
    rng = np.random.default_rng(21)
    n = 300
    pdf = pd.DataFrame({"id": np.arange(n)})
    for i in range(5):
        pdf[f"f{i}"] = rng.integers(0, 6, n).astype(float) + i * rng.normal(size=n).round(1)
    pdf["f5"] = pdf["f0"]                                # ρ(x, x) = 1
    df = spark.createDataFrame(pdf)
    cols = [f"f{i}" for i in range(6)]
    a = {(r.col_i, r.col_j): r.rho for r in spearman_pairs(df, cols, "id").collect()}
    assert len(a) == 15
    assert a[("f5", "f0")] == pytest.approx(1.0)
    exp = pdf[cols].rank().corr().loc["f3", "f1"]
    assert a[("f3", "f1")] == pytest.approx(exp, abs=1e-12)
    holes = pdf.copy()
    for i, c in enumerate(cols):
        holes.loc[holes.index % (7 + i) == 0, c] = None
    for use in (cols, cols[:3]):             # few and many columns: one definition
        whole = holes.dropna(subset=use)
        exp = whole[use].rank().corr()
        sdf = spark.createDataFrame(holes.astype(object).where(holes.notna(), None), df.schema)
        for r in spearman_pairs(sdf, use, "id").collect():
            assert r.n == len(whole) and r.rho == pytest.approx(exp.loc[r.col_i, r.col_j], abs=1e-10)


def test_kendall_antisymmetric(spark):
    from riskframe.operators.select import kendall_pairs
    pdf = pd.DataFrame({"id": np.arange(50), "x": np.arange(50, dtype=float)})
    pdf["neg"] = -pdf["x"]
    r = kendall_pairs(spark.createDataFrame(pdf), ["x", "neg"], "id").first()
    assert r["tau_b"] == pytest.approx(-1.0)


def test_split_and_ranks_keep_null_groups(spark):
    from riskframe.operators import rank as RK, split as SP
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 3) for i in range(100)], "loan_id long, y int")
    out = SP.stratified_split(df, "y", "loan_id", 0.3, 5)
    assert out.count() == 100 and out.where("y is null and split = 'test'").count() == 6
    long_df = spark.createDataFrame([(None, 1.0), (None, 1.0), (None, 2.0), ("a", None), ("a", 3.0)], "g string, v double")
    got = sorted((str(r.g), str(r.v), str(r.avg_rank)) for r in RK.attach_ranks(long_df, ["g"], "v").collect())
    assert got == sorted([("None", "1.0", "1.5"), ("None", "1.0", "1.5"), ("None", "2.0", "3.0"), ("a", "None", "None"),
                          ("a", "3.0", "1.0")])


def test_merge_counts_equal_all_pairs():
    from riskframe.operators.select import _merge_counts
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 17, 64, 200):
        x, y, w = rng.integers(0, 12, n), rng.integers(0, 9, n), rng.random(n)
        lt = (x[None, :] < x[:, None])
        ww = w[:, None] * w[None, :]
        lower, upper = _merge_counts(x, y, w)
        assert lower == pytest.approx((ww * (lt & (y[None, :] < y[:, None]))).sum())
        assert upper == pytest.approx((ww * (lt & (y[None, :] > y[:, None]))).sum())


def test_kendall_pairs_many_buckets_nulls_and_hot_values(spark):
    """Rows in many buckets and stripes, with NULLs, NaN, a hot value, a constant and repeated rows."""
    from riskframe.operators.kendall import cell_pairs, kendall_pairs, merge_counts
    rng = np.random.default_rng(4)
    n = 3000
    a = rng.normal(size=n)
    b = np.round(a + rng.normal(size=n), 1)
    c = np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 900, n))
    data = {"a": a, "b": b, "c": c, "d": np.full(n, 2.0)}
    rows = [[float(v[i]) if rng.random() > 0.1 else None for v in data.values()] for i in range(n)]
    for k in range(40):
        rows[k][0] = float("nan")
    rows += rows[:200]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    names = list(data)
    got = {(r.col_i, r.col_j): r for r in kendall_pairs(df, names, rows_per_task=60).collect()}
    assert len(got) == 6
    for i, x in enumerate(names):
        for j in range(i):
            both = np.array([(np.inf if r[i] != r[i] else r[i], np.inf if r[j] != r[j] else r[j])
                             for r in rows if r[i] is not None and r[j] is not None])
            u, v = (np.unique(both[:, k], return_inverse=True)[1] for k in (0, 1))
            s = (np.sign(u[:, None] - u) * np.sign(v[:, None] - v)).sum() / 2
            m = len(u)
            tx, ty = (sum(t * (t - 1) // 2 for t in np.bincount(k).tolist()) for k in (u, v))
            r = got[(x, names[j])]
            assert r.n == m
            if "d" in (x, names[j]):
                assert r.tau_b is None
                continue
            n0 = m * (m - 1) / 2
            assert r.tau_b == pytest.approx(s / np.sqrt((n0 - tx) * (n0 - ty)), abs=1e-12)
    cells = [(1, 0, int(x), int(y), float(rng.integers(1, 5))) for x in range(30) for y in range(25) if rng.random() < 0.3]
    r = cell_pairs(spark.createDataFrame(cells, "i int, j int, bx int, by int, n double"), 30) \
        .groupBy().sum("a", "b").first()
    x, y, w = (np.array([q[k] for q in cells]) for k in (2, 3, 4))
    assert (r[0], r[1]) == pytest.approx(merge_counts(x, y, w))
    assert kendall_pairs(df.limit(0), names).count() == 0
    few = kendall_pairs(spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "x double, y double"), ["x", "y"]).first()
    assert few.n == 2 and few.tau_b == 1.0
