import itertools

import numpy as np
import pandas as pd
import pytest

from riskframe.operators import metrics as M


def _pred(spark, n=300, seed=5):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([1, 1, 1], n).round(2)
    p = p / p.sum(1, keepdims=True)
    y = rng.integers(1, 4, n)
    pdf = pd.DataFrame({"y": y, "prob_c1": p[:, 0], "prob_c2": p[:, 1], "prob_c3": p[:, 2],
                        "pred": p.argmax(1) + 1, "g": rng.integers(0, 2, n)})
    return spark.createDataFrame(pdf), pdf


def _auc_brute(score, pos):
    s1, s0 = score[pos], score[~pos]
    tot = 0.0
    for a, b in itertools.product(s1, s0):
        tot += 1.0 if a > b else (0.5 if a == b else 0.0)
    return tot / (len(s1) * len(s0))


@pytest.mark.parametrize("rows_per_bucket", [1 << 21, 4])
def test_auc_matches_brute_force_pairs(spark, rows_per_bucket):
    df, pdf = _pred(spark)
    got = {(r["g"], r["cls"]): r["auc"] for r in
           M.auc_ovr(df, ["g"], per_class=True, rows_per_bucket=rows_per_bucket).collect()}
    for (g, k), v in got.items():
        part = pdf[pdf.g == g]
        assert v == pytest.approx(_auc_brute(part[f"prob_c{k}"].to_numpy(), (part.y == k).to_numpy()))


def test_basic_scores(spark):
    df, pdf = _pred(spark)
    r = M.basic_scores(df, []).first()
    assert r["accuracy"] == pytest.approx((pdf.y == pdf.pred).mean())
    assert r["mae"] == pytest.approx((pdf.y - pdf.pred).abs().mean())
    f1 = []
    for k in (1, 2, 3):
        tp = ((pdf.y == k) & (pdf.pred == k)).sum()
        f1.append(2 * tp / ((pdf.pred == k).sum() + (pdf.y == k).sum()))
    assert r["f1_macro"] == pytest.approx(np.mean(f1))
    pt = pdf[["prob_c1", "prob_c2", "prob_c3"]].to_numpy()[np.arange(len(pdf)), pdf.y - 1]
    assert r["log_loss"] == pytest.approx(-np.log(np.clip(pt, M.LOG_LOSS_EPS, 1)).mean(), rel=1e-9)


def test_confusion_columns_sum_to_one_or_zero(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "y int, pred int")
    out = M.confusion_normalized(df, []).toPandas()
    col = out.groupby("y_pred")["share"].sum()
    assert col[1] == pytest.approx(1.0) and col[2] == 0.0 and col[3] == pytest.approx(1.0)
    assert len(out) == 9
