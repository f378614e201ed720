import numpy as np
import pandas as pd
import pytest

from riskframe.models import hybrid as HY
from riskframe.models.mnl import fit_mnl
from riskframe.models.ordered import fit_ordered, ordered_batch_stats

TRUE_B = np.array([[0.3, 1.0, -0.5, 0.0], [-0.4, 0.2, 0.8, -1.0]])


def sim_mnl(spark, n=3000, seed=11):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    u = np.zeros((n, 3))
    u[:, 1:] = np.hstack([np.ones((n, 1)), x]) @ TRUE_B.T
    p = np.exp(u) / np.exp(u).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=pi) for pi in p]) + 1
    pdf = pd.DataFrame({"loan_id": np.arange(n), "y": y, "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2]})
    return spark.createDataFrame(pdf)


def test_mnl_recovers_beta_and_matches_mllib(spark):
    df = sim_mnl(spark)
    r = fit_mnl(df, ["x1", "x2", "x3"])
    assert r.converged
    assert np.all(np.abs(r.beta - TRUE_B) < 4 * r.std_err)
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F
    tr = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="f").transform(df).withColumn(
        "label", (F.col("y") - 1).cast("double"))
    m = LogisticRegression(featuresCol="f", family="multinomial", regParam=0.0, tol=1e-12, maxIter=300,
                           standardization=False).fit(tr)
    cm, ic = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    assert np.allclose(cm[1:] - cm[0], r.beta[:, 1:], atol=1e-4)
    assert np.allclose(ic[1:] - ic[0], r.beta[:, 0], atol=1e-4)


def test_collinear_design_fails_with_names(spark):
    df = sim_mnl(spark, 500).selectExpr("*", "x1 AS x1_copy")
    with pytest.raises(ValueError, match="x1"):
        fit_mnl(df, ["x1", "x2", "x1_copy"])


def test_ordered_gradient_hessian_finite_differences():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    yi = rng.integers(0, 3, 200)
    beta, theta = np.array([0.3, -0.2]), np.array([-0.5, 0.7])
    v = ordered_batch_stats(x, yi, beta, theta)
    d = 4
    g, H = v[1:1 + d], v[1 + d:1 + d + d * d].reshape(d, d)
    par = np.concatenate([beta, theta])
    eps = 1e-6
    for i in range(d):
        e = np.zeros(d)
        e[i] = eps
        up = ordered_batch_stats(x, yi, (par + e)[:2], (par + e)[2:])
        dn = ordered_batch_stats(x, yi, (par - e)[:2], (par - e)[2:])
        assert (up[0] - dn[0]) / (2 * eps) == pytest.approx(g[i], rel=1e-5, abs=1e-6)
        assert np.allclose((up[1:1 + d] - dn[1:1 + d]) / (2 * eps), H[:, i], rtol=1e-4, atol=1e-5)
    assert np.allclose(H, H.T)
    assert np.all(np.linalg.eigvalsh(H) < 0)


def test_ordered_recovers(spark):
    rng = np.random.default_rng(4)
    n = 3000
    x = rng.normal(size=(n, 2))
    lat = x @ np.array([1.0, -0.5]) + rng.logistic(size=n)
    y = np.digitize(lat, [-0.5, 1.0]) + 1
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1]}))
    r = fit_ordered(df, ["a", "b"])
    se = np.sqrt(np.diag(r.cov))
    assert abs(r.beta[0] - 1.0) < 4 * se[0] and abs(r.beta[1] + 0.5) < 4 * se[1]
    assert abs(r.theta[0] + 0.5) < 4 * se[2] and abs(r.theta[1] - 1.0) < 4 * se[3]


def test_hybrid_loss_decreases_and_scores(spark):
    df = sim_mnl(spark, 2000)
    spec = HY.HybridSpec(["x1"], ["x2", "x3"], hidden=8)
    r = HY.fit_hybrid(df, spec, epochs=6, shards=4)
    losses = [h[1] for h in r.history]
    assert losses[-1] < losses[0]
    s = HY.score_hybrid(df, r, ["loan_id", "y"]).toPandas()
    assert np.allclose(s[["prob_c1", "prob_c2", "prob_c3"]].sum(1), 1.0)


def test_altnet_gradient_and_training(spark):
    spec = HY.AltNetSpec(["x1", "x2"], hidden=4, linear=True, dropout=0.0)
    rng = np.random.default_rng(0)
    params = HY.init_params(spec, 1) + rng.normal(scale=0.1, size=spec.size())
    x = np.hstack([np.ones((20, 1)), rng.normal(size=(20, 2))])
    yi = rng.integers(0, 3, 20)

    def loss(pv):
        u, _ = spec.forward(HY.unpack(spec, pv), x, np.zeros((20, 0)))
        u = u - u.max(1, keepdims=True)
        lp = u - np.log(np.exp(u).sum(1, keepdims=True))
        return -lp[np.arange(20), yi].sum()
    w = HY.unpack(spec, params)
    u, cache = spec.forward(w, x, np.zeros((20, 0)))
    p = np.exp(u - u.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    du = p.copy()
    du[np.arange(20), yi] -= 1
    g = HY.flat_grad(spec, spec.backward(w, cache, du))
    eps = 1e-6
    for i in rng.choice(spec.size(), 12, replace=False):
        e = np.zeros_like(params)
        e[i] = eps
        assert (loss(params + e) - loss(params - e)) / (2 * eps) == pytest.approx(g[i], rel=1e-4, abs=1e-6)
    df = sim_mnl(spark, 1000)
    r = HY.fit_hybrid(df, HY.AltNetSpec(["x1", "x2", "x3"], hidden=4, linear=True), epochs=4, shards=2)
    assert r.history[-1][1] < r.history[0][1]


def test_brant_uses_the_covariance_between_the_fits(spark):
    from riskframe.models.ordered import brant_test
    rng = np.random.default_rng(12)
    n = 3000
    x = rng.normal(size=(n, 2))
    lat = x @ np.array([0.8, -0.5]) + rng.logistic(size=n)
    y = 1 + (lat > -0.5).astype(int) + (lat + 0.15 * x[:, 0] > 1.0)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y.astype(int)}))
    got = {r[0]: r[1:] for r in brant_test(df, ["a", "b"])}
    # the same by plain numpy
    z = np.hstack([np.ones((n, 1)), x])
    bs, ps, vs = [], [], []
    for k in (1, 2):
        t, b = (y > k).astype(float), np.zeros(3)
        for _ in range(40):
            p = 1 / (1 + np.exp(-z @ b))
            v = np.linalg.inv(z.T @ (z * (p * (1 - p))[:, None]))
            b = b + v @ (z.T @ (t - p))
        bs.append(b), ps.append(p), vs.append(v)
    c12 = vs[0] @ (z.T @ (z * (ps[1] * (1 - ps[0]))[:, None])) @ vs[1]
    cov = (vs[0] + vs[1] - c12 - c12.T)[1:, 1:]
    d = (bs[1] - bs[0])[1:]
    assert got["Omnibus"][0] == pytest.approx(d @ np.linalg.solve(cov, d), rel=1e-5) and got["Omnibus"][1] == 2
    assert got["a"][0] == pytest.approx(d[0] ** 2 / cov[0, 0], rel=1e-5)


def test_ordered_logit_names_collinear_columns(spark):
    from riskframe.models.ordered import fit_ordered
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"a": x, "b": 2 * x, "y": rng.integers(1, 4, 300)}))
    with pytest.raises(ValueError, match="a"):
        fit_ordered(df, ["a", "b"])


def test_weights_do_not_depend_on_partitions_and_validation_history(spark):
    df = sim_mnl(spark, 600)
    spec = HY.HybridSpec(["x1"], ["x2", "x3"], 4, classes=[1, 2, 3])
    a = HY.fit_hybrid(df.repartition(3), spec, epochs=2)
    b = HY.fit_hybrid(df.repartition(7), spec, epochs=2, validation=df)
    assert np.allclose(a.params, b.params, atol=1e-12)
    assert len(a.history[0]) == 3 and len(b.history[0]) == 5 and 0 < b.history[-1][4] <= 1


def test_frozen_betas_stay(spark):
    df = sim_mnl(spark, 400)
    spec = HY.HybridSpec(["x1"], ["x2", "x3"], 4, classes=[1, 2, 3])
    start = np.array([[0.1, 0.7], [-0.2, 0.4]])
    r = HY.fit_hybrid(df, spec, epochs=2, init_beta=start, train_beta=False)
    assert np.allclose(r.weights()["beta"], start)
    moved = HY.fit_hybrid(df, spec, epochs=2, init_beta=start)
    assert not np.allclose(moved.weights()["beta"], start)


def test_partial_sums_add_up_over_any_partitions(spark):
    from riskframe.models.sums import partition_sums
    df = spark.range(1000).selectExpr("cast(id as double) as x")

    def fn(pdf):
        return np.concatenate([[len(pdf), pdf["x"].sum()], np.full(5000, 1.0) * len(pdf)])
    for n in (1, 3, 40):
        v = partition_sums(df.repartition(n), fn, 5002)
        assert v[0] == 1000 and v[1] == 499500 and (v[2:] == 1000).all()
    assert (partition_sums(df.where("false"), fn, 5002) == 0).all()


def test_networks_and_ordered_logit_come_back(spark, tmp_path):
    from riskframe.models.ordered import fit_ordered, load_ordered, save_ordered
    df = sim_mnl(spark, 300)
    for spec in (HY.HybridSpec(["x1"], ["x2", "x3"], 4, classes=[1, 2, 3]), HY.HybridSpec(None, ["x1", "x2"], 3, classes=[1, 2, 3]),
                 HY.AltNetSpec(["x1", "x2"], hidden=3, linear=True)):
        r = HY.fit_hybrid(df, spec, epochs=1)
        HY.save_network(spark, r, str(tmp_path / "net"))
        back = HY.load_network(spark, str(tmp_path / "net"))
        assert back.spec == r.spec and np.array_equal(back.params, r.params) and back.history == r.history
    r = fit_ordered(df, ["x1", "x2"])
    save_ordered(spark, r, str(tmp_path / "ordered"))
    back = load_ordered(spark, str(tmp_path / "ordered"))
    assert back.coef_rows() == r.coef_rows() and back.bic() == r.bic()
