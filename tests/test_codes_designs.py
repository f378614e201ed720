"""Joined codes and stored designs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.models import hybrid as HY
from riskframe.models import many as M
from riskframe.operators import codes as CD
from riskframe.operators import prep as D
from riskframe.sources import designs as DG
from tests.test_many import sim_hybrid


@pytest.mark.parametrize("partitions", [None, 1, 5])
def test_codes_are_places_in_sorted_order(spark, partitions):
    df = spark.createDataFrame([(i, f"é{i * 7919 % 331}" if i % 9 else None, "ab"[i % 2]) for i in range(900)],
                               "k long, a string, b string")
    codes = CD.sorted_codes(df, ["a", "b"], partitions)
    cats = D.fit_categories(df, ["a", "b"])
    assert {(r["feature"], r["value"]): r["code"] for r in codes.collect()} == {
        (c, v): i for c, own in cats.items() for i, v in enumerate(own)}
    got = {r["k"]: (r["a"], r["b"]) for r in CD.encode_ordinal(df, codes, ["a", "b"]).collect()}
    want = {r["k"]: (r["a"], r["b"]) for r in df.withColumns(D.ordinal_exprs(cats)).collect()}
    assert got == want
    hot = {r["k"]: r["one_hot"] for r in CD.one_hot_sparse(df, codes, ["a", "b"]).collect()}
    n = len(cats["a"])
    assert all(hot[k] == [x for x in (a, None if b is None else b + n) if x is not None] for k, (a, b) in got.items())


def test_unseen_values_raise_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k long, a string")
    codes = CD.sorted_codes(df.where("k = 1"), ["a"])
    with pytest.raises(Exception, match="unseen value in a"):
        CD.encode_ordinal(df, codes, ["a"]).collect()
    assert CD.sorted_codes(df.limit(0), ["a"]).count() == 0


def test_stored_design_gives_the_same_fits_without_a_shuffle(spark):
    df, _ = sim_hybrid(spark, 700)
    holes = df.withColumn("q1", F.when(F.col("loan_id") >= 3, F.col("q1")))
    DG.drop_design(spark, "t_design")
    n = DG.save_design(holes, "t_design", {"wide": ["x1", "x2"], "deep": ["q1", "q2"]}, fold="fold", scaler={"x1": [0, 1]}, shards=4)
    stored = DG.load_design(spark, "t_design")
    assert n == stored.design.n == 697 and stored.roles["deep"] == ["q1", "q2"] and stored.scaler == {"x1": [0, 1]}
    assert "Exchange" not in stored.design.data._jdf.queryExecution().executedPlan().toString()
    spec = HY.HybridSpec(["x1", "x2"], ["q1", "q2"], 4)
    own = M.design(holes, ["x1", "x2", "q1", "q2"], fold="fold", shards=4)
    a, b = (M.fit_many(d, [M.Model(spec, f) for f in (1, 2)], epochs=2) for d in (stored.design, own))
    assert all(np.array_equal(x.params, y.params) for x, y in zip(a, b))
    stored.design.release(), own.release()
    DG.drop_design(spark, "t_design")
