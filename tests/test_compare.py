"""Golden values of FIXTURES.md §3 (Friedman, pairwise rank-sum, BH) on the
reference's two result tables."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.functions.tails import chi2_sf
from riskframe.operators import compare as CMP

# The reference's metric comparison table (Model, Metric, Value).
SMALLV3 = [
    ("MNL", "AUC_rank", 4.8), ("MNL", "Accuracy_rank", 4.4), ("MNL", "F1_score_rank", 4.8),
    ("MNL", "MAE", 4.4), ("MNL", "BIC", 2.8),
    ("LMNLH1_16N", "AUC_rank", 4.2), ("LMNLH1_16N", "Accuracy_rank", 3.2), ("LMNLH1_16N", "F1_score_rank", 3.8),
    ("LMNLH1_16N", "MAE", 3.2), ("LMNLH1_16N", "BIC", 3.8),
    ("LMNLH2_16N", "AUC_rank", 3.0), ("LMNLH2_16N", "Accuracy_rank", 3.6), ("LMNLH2_16N", "F1_score_rank", 3.4),
    ("LMNLH2_16N", "MAE", 3.4), ("LMNLH2_16N", "BIC", 5.0),
    ("LMNLH3_32N", "AUC_rank", 2.0), ("LMNLH3_32N", "Accuracy_rank", 2.8), ("LMNLH3_32N", "F1_score_rank", 1.8),
    ("LMNLH3_32N", "MAE", 3.0), ("LMNLH3_32N", "BIC", 2.4),
    ("DNN", "AUC_rank", 1.0), ("DNN", "Accuracy_rank", 1.0), ("DNN", "F1_score_rank", 1.2),
    ("DNN", "MAE", 1.0), ("DNN", "BIC", 1.0),
    ("CumOrdLogit", "AUC_rank", 6.0), ("CumOrdLogit", "Accuracy_rank", 6.0), ("CumOrdLogit", "F1_score_rank", 6.0),
    ("CumOrdLogit", "MAE", 6.0), ("CumOrdLogit", "BIC", 6.0),
]
WBIC = [r for r in SMALLV3 if r[1] != "BIC"]


def _df(spark, rows):
    return spark.createDataFrame(rows, "Model string, Metric string, Value double")


@pytest.mark.parametrize("rows,chi,p,sums", [
    (WBIC, 19.428571, 0.0015989, {"MNL": 20, "LMNLH1_16N": 14, "LMNLH2_16N": 14, "LMNLH3_32N": 8, "DNN": 4,
                                  "CumOrdLogit": 24}),
    (SMALLV3, 22.942857, 0.00034616, {"MNL": 23, "LMNLH1_16N": 18, "LMNLH2_16N": 19, "LMNLH3_32N": 10, "DNN": 5,
                                      "CumOrdLogit": 30}),
])
def test_friedman_golden(spark, rows, chi, p, sums):
    df = _df(spark, rows)
    fr = CMP.with_p(CMP.friedman(df, "Model", "Metric", "Value")).first()
    assert fr["k"] == 6 and fr["df"] == 5
    assert fr["statistic"] == pytest.approx(chi, abs=1e-6)
    assert fr["p_value"] == pytest.approx(p, rel=1e-4)
    got = {r["Model"]: r["rank_sum"] for r in CMP.friedman_rank_sums(df, "Model", "Metric", "Value").collect()}
    assert got == pytest.approx(sums)


# pair: (W, p, BH) for wBIC and smallv3
PAIRS = {
    ("CumOrdLogit", "DNN"): ((16, 0.017706, 0.033924), (25, 0.005584, 0.016168)),
    ("CumOrdLogit", "MNL"): ((16, 0.019359, 0.033924), (25, 0.007089, 0.016168)),
    ("DNN", "LMNLH3_32N"): ((0, 0.026519, 0.033924), (0, 0.009701, 0.016168)),
    ("LMNLH1_16N", "LMNLH2_16N"): ((10, 0.661197, 0.661197), (14, 0.833029, 0.833029)),
    ("LMNLH1_16N", "MNL"): ((0, 0.027469, 0.033924), (5, 0.138792, 0.160144)),
    ("LMNLH2_16N", "LMNLH3_32N"): ((15.5, 0.040833, 0.043750), (24.5, 0.015651, 0.021342)),
    ("LMNLH3_32N", "MNL"): ((0, 0.028430, 0.033924), (1.5, 0.026857, 0.033571)),
}


@pytest.mark.parametrize("which", [0, 1])
def test_pairwise_ranksum_bh_golden(spark, which):
    rows = WBIC if which == 0 else SMALLV3
    st = CMP.ranksum_p(CMP.pairwise_ranksum(_df(spark, rows), "Model", "Value"))
    adj = CMP.bh_adjust(st, "p_value", "p_adj")
    got = {(r["model_a"], r["model_b"]): r for r in adj.collect()}
    assert len(got) == 15
    for pair, vals in PAIRS.items():
        w, p, bh = vals[which]
        r = got[pair]
        assert r["w"] == pytest.approx(w)
        assert r["p_value"] == pytest.approx(p, abs=2e-6)
        assert r["p_adj"] == pytest.approx(bh, abs=2e-6)


def test_exact_wilcox_small():
    # no ties, m = n = 3: P(U <= 0) = 1/20 -> two-sided 0.1
    assert CMP.wilcox_exact_p(0, 3, 3) == pytest.approx(0.1)
    assert CMP.wilcox_exact_p(9, 3, 3) == pytest.approx(0.1)
    assert CMP.wilcox_exact_p(4.5, 3, 3) == pytest.approx(1.0)


def test_bh_monotone(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.2, 0.5, 0.04])],
                               "i int, p_value double")
    out = sorted(CMP.bh_adjust(df).collect(), key=lambda r: r["p_value"])
    adj = [r["p_adj"] for r in out]
    assert adj == sorted(adj)
    assert all(r["p_adj"] >= r["p_value"] for r in out)


def test_chi2_tail():
    assert chi2_sf(19.428571, 5) == pytest.approx(0.0015989, rel=1e-4)
    assert chi2_sf(2.0, 2) == pytest.approx(0.36787944117, rel=1e-9)


def test_rank_sums_of_200_models_by_brute_force(spark, monkeypatch):
    from riskframe.operators import pairs
    monkeypatch.setattr(pairs, "CHUNK", 3)
    rng = np.random.default_rng(3)
    rows = [(f"m{i:03d}", float(v)) for i in range(200) for v in rng.integers(0, 12, rng.integers(1, 6))]
    df = spark.createDataFrame([*rows, ("m000", None), (None, 1.0)], "model string, value double")
    own = {}
    for m, v in rows:
        own.setdefault(m, []).append(v)
    got = pairs.all_pairs(df, "model", "value").collect()
    assert len(got) == 200 * 199 // 2
    for r in got:
        a, b = own[r["model_a"]], own[r["model_b"]]
        assert r["w"] == sum((x > y) + (x == y) / 2 for x in a for y in b)
        both = a + b
        assert (r["n_a"], r["n_b"]) == (len(a), len(b))
        assert r["tie_sum"] == sum(both.count(v) ** 3 - both.count(v) for v in set(both))


def test_rank_sums_over_many_runs(spark):
    from riskframe.operators import pairs
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(m, float(v)) for m in "abc" for v in rng.integers(0, 60, 80)], "model string, value double")
    whole = pairs.pair_sums(df, "model", "value", ["a", "b", "c"])
    for x, y in zip(whole, pairs.pair_sums(df, "model", "value", ["a", "b", "c"], run=7)):
        assert np.array_equal(x, y)


def test_bh_runs_nulls_and_groups(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(60), 2).tolist()
    df = spark.createDataFrame([(g, x) for g in ("u", "v") for x in p] + [("u", None)], "g string, p_value double")
    order = sorted(range(60), key=lambda i: -p[i])
    want, low = {}, 1.0
    for i in order:
        rank = sum(1 for x in p if x <= p[i])
        low = min(low, p[i] * 60 / rank)
        want[p[i]] = low
    for run in (5, 1 << 20):
        out = CMP.bh_adjust(df, partition=["g"], run=run).collect()
        assert len(out) == 121
        assert all((r["p_adj"] is None) if r["p_value"] is None else r["p_adj"] == pytest.approx(want[r["p_value"]]) for r in out)
