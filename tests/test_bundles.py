"""Networks that see the same rows are trained as one."""
import numpy as np
from pyspark.sql import functions as F

from riskframe.models import hybrid as HY
from riskframe.models import many as M
from riskframe.models import sums

SPECS = [HY.HybridSpec(["a", "b"], ["c", "d", "e"], h) for h in (8, 5, 16)] + \
    [HY.HybridSpec(["a"], ["b", "c", "d", "e"], h) for h in (8, 16)] + [HY.HybridSpec(None, ["c", "d", "e"], 8), HY.HybridSpec(["a", "b"], []),
                                                                       HY.HybridSpec([], ["c", "d"], 3)]


class Rows:
    """A batch of made rows; every fold sees others."""

    def __init__(self, n, seed):
        rng = np.random.default_rng(seed)
        self.cells, self.y, self.folds = rng.normal(size=(n, 5)), rng.integers(0, 3, n), np.arange(n) % 3 + 1

    def rows(self, model):
        kept = self.folds != model.fold
        x, q = ([self.cells[kept][:, "abcde".index(c)] for c in cols or []] for cols in (model.spec.wide, model.spec.deep))
        n = int(kept.sum())
        return np.column_stack([np.ones(n), *x]), np.column_stack(q) if q else np.zeros((n, 0)), self.y[kept], 7


def trained(models, batches, shards):
    states = [np.concatenate([HY.init_params(m.spec, 4), np.zeros(2 * m.spec.size() + 1)]) for m in models]
    own = M._trainer(models, states, shards, 1e-2, 16)
    for at in range(0, len(batches), shards):
        own.see(batches[at:at + shards], at)
    return own.sums()


def test_models_of_a_fold_share_order_and_draws_and_are_those_fitted_alone(monkeypatch):
    models = [M.Model(s, f) for f in (1, 2) for s in SPECS]
    batches = [Rows(n, i) for i, n in enumerate((200, 90, 61, 0, 33, 47))]
    batches[3] = None
    gen, made = np.random.default_rng, []
    with monkeypatch.context() as patch:
        patch.setattr(M.np.random, "default_rng", lambda seed: isinstance(seed, list) and made.append(seed) or gen(seed))
        together = trained(models, batches, 2)
    # one for each fold and batch, whatever the number of models
    assert len(made) == 2 * 5
    for model, got in zip(models, together):
        assert np.array_equal(got, trained([model], batches, 2)[0])
        assert got[-3] == sum(len(b.rows(model)[2]) for b in batches if b)


def test_frozen_beta_and_other_dropout():
    spec = HY.HybridSpec(["a", "b"], ["c"], 4, dropout=0.0)
    models = [M.Model(spec, init_beta=np.arange(6.0), train_beta=t) for t in (False, True)]
    states = [np.concatenate([HY.init_params(m.spec, 4, m.init_beta), np.zeros(2 * m.spec.size() + 1)]) for m in models]
    own = M._trainer(models, states, 1, 1e-2, 16)
    own.see([Rows(50, 1)], 0)
    still, moved = (HY.unpack(spec, v[:spec.size()] / 50)["beta"] for v in own.sums())
    assert np.allclose(still, np.arange(6.0).reshape(2, 3)) and not np.allclose(moved, still)
    mixed = [M.Model(HY.HybridSpec(["a"], ["b"], 4, dropout=d), f) for d in (0.0, 0.2) for f in (1, 2)]
    assert sorted(map(sorted, M._kinds(mixed))) == [[0, 1], [2, 3]]


def test_groups_hold_every_model_once_and_fill_the_cores():
    models = [M.Model(s, f) for s in SPECS for f in range(1, 6)] + [M.Model(HY.AltNetSpec(["a"], 3), f) for f in (1, 2)]
    for shards, cores, n in ((8, 8, 2), (8, 6, 2), (54, 6, 1), (8, 400, 5)):
        groups = M._groups(models, shards, cores)
        assert sorted(i for g in groups for i in g) == list(range(len(models))) and len(groups) == n
        for bundle in M._bundles(models):
            assert any(set(bundle) <= set(g) for g in groups)


def test_short_vectors_need_no_second_stage(spark, monkeypatch):
    df = spark.range(1000, numPartitions=5).select((F.col("id") / 7).alias("x"))

    def total(it):
        parts = [np.array([len(b), b["x"].sum()]) for b in it if len(b)]
        return np.sum(parts, axis=0) if parts else None

    status = spark.sparkContext.statusTracker()
    found = []
    for most in (sums.DIRECT, 0):
        monkeypatch.setattr(sums, "DIRECT", most)
        spark.sparkContext.setJobGroup(f"sums-{most}", "sums")
        found.append(sums.partition_fold(df, total, 2, 5))
        assert np.allclose(sums.partition_fold(df.where("x < 0"), total, 2, 5), 0.0)
        jobs = [status.getJobInfo(j) for j in status.getJobIdsForGroup(f"sums-{most}")]
        assert all(len(j.stageIds) == 1 for j in jobs) == bool(most)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(*found) and found[0][0] == 1000
