"""The batch trainer, its polish and the penalised logit."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.models import hybrid as HY
from riskframe.models import many as M
from riskframe.models.ridge import fit_ridge
from riskframe.plans import crossval as CV
from tests.test_fit import sim_mnl


def sim_hybrid(spark, n=6000, seed=5):
    """V = Xβ + f(Q), f a ReLU net with known weights, X and Q disjoint."""
    rng = np.random.default_rng(seed)
    x, q = rng.normal(size=(n, 2)), rng.normal(size=(n, 2))
    beta = np.array([[0.8, -0.5], [-0.3, 0.9]])
    hid = np.maximum(q @ np.array([[1.0, -1.0], [0.5, 1.5]]), 0)
    u = np.zeros((n, 3))
    u[:, 1:] = x @ beta.T
    u += hid @ np.array([[0.0, 0.9, -0.6], [0.4, -0.5, 0.7]])
    y = (u + rng.gumbel(size=u.shape)).argmax(1) + 1
    pdf = pd.DataFrame({"loan_id": np.arange(n), "y": y, "x1": x[:, 0], "x2": x[:, 1], "q1": q[:, 0], "q2": q[:, 1],
                        "fold": np.arange(n) % 3 + 1})
    return spark.createDataFrame(pdf), beta


def test_batch_equals_single_fits_to_the_last_bit(spark):
    df, _ = sim_hybrid(spark, 900)
    d = M.design(df, ["x1", "x2", "q1", "q2"], fold="fold", shards=3)
    specs = [HY.HybridSpec(["x1", "x2"], ["q1", "q2"], 4), HY.HybridSpec(None, ["x1", "q1"], 6), HY.AltNetSpec(["x1", "x2"], 3)]
    models = [M.Model(s, f, str(i)) for i, s in enumerate(specs) for f in (1, 2, 3)]
    together = M.fit_many(d, models, epochs=2, polish_steps=2)
    for model, r in zip(models, together):
        alone = M.fit_many(d, [model], epochs=2, polish_steps=2)[0]
        assert np.array_equal(alone.params, r.params) and alone.history == r.history and alone.n == r.n == 600
    d.release()


def test_batch_model_of_a_fold_equals_the_fit_on_its_rows(spark):
    df, _ = sim_hybrid(spark, 600)
    spec = HY.HybridSpec(["x1"], ["q1", "q2"], 4)
    d = M.design(df, ["x1", "q1", "q2"], fold="fold", shards=2)
    got = M.fit_many(d, [M.Model(spec, 2)], epochs=2)[0]
    want = HY.fit_hybrid(df.where("fold <> 2"), spec, epochs=2, shards=2)
    assert np.array_equal(got.params, want.params)
    d.release()


def test_polish_reaches_the_bound_and_recovers_beta(spark):
    df, beta = sim_hybrid(spark)
    spec = HY.HybridSpec(["x1", "x2"], ["q1", "q2"], hidden=6)
    d = M.design(df, ["x1", "x2", "q1", "q2"], shards=4)
    rough = M.fit_many(d, [M.Model(spec)], epochs=6)[0]
    fine = M.polish(d, [M.Model(spec)], [rough.params], steps=80, tol=1e-3)[0]
    (n, before, _), (_, after, g) = M.losses(d, [(M.Model(spec), rough.params), (M.Model(spec), fine)])
    assert n == 6000 and after < before and np.linalg.norm(g) < 1e-3
    r = HY.HybridResult(spec, fine, [], int(n))
    se = np.sqrt(np.diag(np.linalg.inv(HY.hybrid_beta_information(df, r)))).reshape(2, 3)
    assert np.all(np.abs(HY.beta_of(r)[:, 1:] - beta) < 4 * se[:, 1:])
    d.release()


def test_shard_rule_and_dropped_rows(spark):
    assert M.shards_for(10) == 8 and M.shards_for(100 * M.ROWS_A_SHARD + 1) == 101
    df, _ = sim_hybrid(spark, 100)
    d = M.design(df.withColumn("x1", F.when(F.col("loan_id") >= 5, F.col("x1"))), ["x1"])
    assert (d.n, d.dropped, d.data.count()) == (95, 5, 95)
    d.release()


def test_rows_with_a_null_input_are_scored_null(spark):
    df, _ = sim_hybrid(spark, 200)
    holes = df.withColumn("x1", F.when(F.col("loan_id") >= 7, F.col("x1")))
    spec = HY.HybridSpec(["x1"], ["q1"], 3)
    m = M.Model(spec, name="net")
    r = HY.HybridResult(spec, HY.init_params(spec, 3), [], 1)
    for out in (M.score_many(holes, [m], [r], ["loan_id", "y"]),
                CV.MNLRidge(["x1", "x2"]).fit(holes).score(holes)):
        rows = {x["loan_id"]: x for x in out.collect()}
        assert len(rows) == 200
        assert all((rows[i]["prob_c2"] is None) == (i < 7) == (rows[i]["pred"] is None) for i in rows)


def test_ridge_equals_dense_newton_and_folds(spark):
    df = sim_mnl(spark, 1200).withColumn("fold", F.col("loan_id") % 3 + 1)
    cols = ["x1", "x2", "x3"]
    pdf = df.toPandas()

    def dense(part, C):
        x = np.hstack([np.ones((len(part), 1)), part[cols].to_numpy()])
        y = np.eye(3)[part["y"].to_numpy() - 1]
        free = np.tile([0.0, 1, 1, 1], 3) / C
        w = np.zeros(12)
        for _ in range(60):
            u = x @ w.reshape(3, 4).T
            p = np.exp(u - u.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = ((p - y).T @ x).ravel() + free * w
            h = np.block([[x.T @ (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]) for b in range(3)] for a in range(3)])
            w = w - np.linalg.pinv(h + np.diag(free)) @ g
        return w.reshape(3, 4)
    for C, results in ((0.05, fit_ridge(df, cols, C=0.05)), (1.0, fit_ridge(df, cols, folds=[1, 2, 3], fold_col="fold"))):
        for i, r in enumerate(results):
            part = pdf if len(results) == 1 else pdf[pdf["fold"] != i + 1]
            want = dense(part, C)
            assert r.converged and r.gradient < 1e-8 and r.n == len(part)
            assert np.allclose(r.beta[:, 1:], want[:, 1:], atol=1e-5)
            assert np.allclose(r.beta[:, 0] - r.beta[0, 0], want[:, 0] - want[0, 0], atol=1e-5)


def test_holdout_and_cross_validation_share_the_schema(spark):
    df, _ = sim_hybrid(spark, 600)
    ests = [CV.MNLNewton(["x1", "x2"]), CV.MNLRidge(["x1", "x2"]), CV.HybridNet(["x1"], ["q1", "q2"], 4, epochs=2, polish=2)]
    cv = CV.cross_validate(df, ests, 3)
    held = CV.holdout(df.withColumn("split", F.when(F.col("fold") == 1, "test").otherwise("train")), ests)
    assert cv.columns == held.columns
    got = {(r["model"], r["fold"]): r for r in cv.collect()}
    assert len(got) == 9 and all(r["n"] == 200 and r["n_train"] == 400 and r["train_loglik"] < 0 for r in got.values())
    one = {r["model"]: r for r in held.collect()}
    # the hold-out part is fold 1, so the linear fits are those of fold 1
    for m in ("MNL", "MNL_L2"):
        assert one[m]["log_loss"] == pytest.approx(got[m, 1]["log_loss"], rel=1e-6)
