"""Steps that have to grow no faster than the rows."""
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from riskframe.models import hybrid as HY
from riskframe.models import many as M
from riskframe.models import sums
from tests.test_many import sim_hybrid


def test_packed_batches_are_those_of_the_table(spark):
    df = spark.range(25_000, numPartitions=2).select("id", (F.col("id") % 7).cast("int").alias("k"), (F.col("id") / 3).alias("x"))
    seen = lambda pdf: np.array([len(pdf) ** 2, pdf["id"].sum(), pdf["x"].sum(), pdf["k"].dtype == np.int32], float)
    held = sums.Packed(df)
    assert held.data.count() == 4          # 12,500 rows a partition, 10,000 a batch
    assert np.array_equal(sums.partition_sums(held, seen, 4), sums.partition_sums(df, seen, 4))
    held.unpersist()


def test_later_passes_over_a_packed_table_take_few_tasks(spark):
    df = spark.range(3_000, numPartitions=60).select("id", (F.col("id") / 3).alias("x"))

    def seen(batch):
        at = np.zeros(60)
        at[TaskContext.get().partitionId()] = 1.0
        return np.concatenate([at, [len(batch), batch["id"].to_numpy().sum(), batch["x"].to_numpy().sum()]])
    held = sums.Packed(df)
    want = sums.partition_sums(df, seen, 63)
    most = sums.WAVES * spark.sparkContext.defaultParallelism
    assert most < 60
    # the first pass fills the cache, a task for each partition
    for arrow, tasks in ((False, 60), (False, most), (True, most)):
        got = sums.partition_sums(held, seen, 63, arrow)
        assert (got[:60] > 0).sum() == tasks and np.allclose(got[60:], want[60:], rtol=1e-14)
    held.unpersist()


def test_linear_passes_read_columns_as_they_are(spark):
    df = spark.range(40).select((F.col("id") % 3 + 1).cast("int").alias("y"), "id", (F.col("id") % 2 == 0).alias("b"),
                                (F.col("id") / 7).cast("decimal(9,3)").alias("d"), (F.col("id") / 3).cast("float").alias("x"))
    cols = ["id", "b", "d", "x"]
    pdf = df.toPandas()
    for batch in (pdf, df.toArrow(), df.where("false").toArrow()):
        x = sums.design_columns(batch, cols)
        assert x.dtype == np.float64 and np.array_equal(x.T, sums.design_matrix(pdf[:len(batch)], cols))
    seen = lambda t: np.array([isinstance(t, pa.Table), len(t)], float)
    assert sums.partition_sums(df.coalesce(1), seen, 2, True).tolist() == [1.0, 40.0]


def test_ridge_fits_are_those_of_the_held_table(spark):
    from riskframe.models.ridge import fit_ridge
    df, _ = sim_hybrid(spark, 600)
    cols = ["x1", "x2", "q1"]
    own = [fit_ridge(df, cols, folds=[1, 2], fold_col="fold", cache=cache) for cache in (True, False)]
    for held, r in zip(*own):
        assert r.n == held.n and np.isclose(r.loss, held.loss) and np.allclose(r.beta, held.beta, atol=1e-6)


def test_shards_of_one_task_train_as_apart(spark, monkeypatch):
    df, _ = sim_hybrid(spark, 900)
    d = M.design(df, ["x1", "x2", "q1", "q2"], fold="fold", shards=11)
    models = [M.Model(s, f) for s in (HY.HybridSpec(["x1", "x2"], ["q1", "q2"], 4), HY.HybridSpec(["x1"], []),
                                      HY.AltNetSpec(["x1", "x2"], 3)) for f in (1, 2, 3)]
    merged = M.fit_many(d, models, epochs=2)
    monkeypatch.setattr(M, "SHARDS_A_TASK", 1)
    for a, b in zip(merged, M.fit_many(d, models, epochs=2)):
        assert np.allclose(a.params, b.params, rtol=1e-12, atol=1e-14) and a.n == b.n == 600
        assert np.allclose(a.history, b.history)
    d.release()


def test_a_step_is_that_of_plain_adam():
    rng = np.random.default_rng(3)
    x, q, y = np.hstack([np.ones((70, 1)), rng.normal(size=(70, 2))]), rng.normal(size=(70, 3)), rng.integers(0, 3, 70)

    class Batch:
        def rows(self, model):
            return x, q, y, 5

    for spec in (HY.HybridSpec(["a", "b"], ["c", "d", "e"], 4), HY.HybridSpec(None, ["c", "d", "e"], 4), HY.HybridSpec(["a", "b"], [])):
        m = M.Model(spec)
        p = HY.init_params(spec, 1) + 0.1
        own = M._trainer([m, m], [np.concatenate([p, np.zeros(2 * len(p) + 1)])] * 2, 1, 1e-2, 32)
        own.see([Batch()], 0)
        gen = np.random.default_rng([m.seed, 0, 5])
        order, mo, v = gen.permutation(70), np.zeros(len(p)), np.zeros(len(p))
        for t, s in enumerate(range(0, 70, 32), 1):
            at = order[s:s + 32]
            u, cache = spec.forward(HY.unpack(spec, p), x[at], q[at], gen)
            pr = np.exp(u) / np.exp(u).sum(1, keepdims=True)
            pr[np.arange(len(at)), y[at]] -= 1
            g = HY.flat_grad(spec, spec.backward(HY.unpack(spec, p), cache, pr / len(at)))
            mo, v = 0.9 * mo + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - 1e-2 * (mo / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-7)
        for got in own.sums():
            assert np.allclose(got[:len(p)] / 70, p, rtol=1e-10, atol=1e-12) and got[-3] == 70 and got[-4] == 3 * 70


def test_every_pass_of_the_linear_fits_reads_packed_batches(spark, monkeypatch):
    from riskframe.models import ridge
    from riskframe.plans import crossval as CV
    df, _ = sim_hybrid(spark, 300)
    read = []
    monkeypatch.setattr(ridge, "partition_sums", lambda data, *rest: read.append(type(data)) or sums.partition_sums(data, *rest))
    CV.MNLRidge(["x1", "x2"]).fit(df)
    CV.MNLRidge(["x1", "x2"]).fit_folds(df, [1, 2, 3], "fold")
    assert set(read) == {sums.Packed}


def test_tasks_fill_every_wave_over_the_cores():
    for cores in (1, 8, 12):
        for shards in range(1, 400):
            lanes = M._lanes_for(shards, cores)
            tasks = -(-shards // lanes)
            waves = -(-tasks // cores)
            assert 1 <= lanes <= M.SHARDS_A_TASK and (lanes == 1 or shards > cores)
            # no other number of lanes takes fewer waves
            assert waves == -(-shards // (cores * M.SHARDS_A_TASK))
    assert -(-40 // M._lanes_for(40, 8)) == 8 and -(-54 // M._lanes_for(54, 12)) <= 12


def test_trial_steps_of_a_search_are_evaluated_together(monkeypatch):
    rng = np.random.default_rng(4)
    n = 2500
    x, q, y = np.hstack([np.ones((n, 1)), rng.normal(size=(n, 2))]), rng.normal(size=(n, 3)), rng.integers(0, 3, n)
    for spec in (HY.HybridSpec(["a", "b"], ["c", "d", "e"], 4), HY.HybridSpec(None, ["c", "d", "e"], 4), HY.HybridSpec(["a", "b"], [])):
        for train_beta in (True, False):
            m = M.Model(spec, train_beta=train_beta)
            points = [rng.normal(size=spec.size()) for _ in range(4)]
            want = [M._loss_and_gradient(m, p, x, q, y) for p in points]
            assert M._alike([(m, p) for p in points]) == [[0, 1, 2, 3]]
            with monkeypatch.context() as patch:
                patch.setattr(spec.__class__, "forward", None)      # not point after point
                got = M._sums_at([m] * 4, points)(x, q, y)
                again = [M._sums_at([m], [p])(x, q, y)[0] for p in points]
            assert np.allclose(got, want, rtol=1e-11, atol=1e-9) and np.array_equal(got, again)
    alt = M.Model(HY.AltNetSpec(["a", "b"], 3))
    p = HY.init_params(alt.spec, 1)
    assert np.array_equal(M._sums_at([alt], [p])(x, q, y)[0], M._loss_and_gradient(alt, p, x, q, y))
