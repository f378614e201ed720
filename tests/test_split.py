import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import nth
from riskframe.operators import split as SP


def _data(spark, n=1000):
    rng = np.random.default_rng(7)
    return spark.createDataFrame(pd.DataFrame({"loan_id": np.arange(n), "y": rng.choice([1, 2, 3], n, p=[.6, .3, .1])}))


def test_kfold_sizes_differ_by_at_most_one(spark):
    f = SP.stratified_kfold(_data(spark), "y", "loan_id", 5, 10).groupBy("y", "fold").count().toPandas()
    for _, part in f.groupby("y"):
        assert part["count"].max() - part["count"].min() <= 1
        assert len(part) == 5


def test_split_is_a_partition_and_stable(spark):
    d = _data(spark)
    a = SP.stratified_split(d, "y", "loan_id", 0.3, 10)
    b = SP.stratified_split(d.repartition(5), "y", "loan_id", 0.3, 10)
    pa = a.toPandas().sort_values("loan_id")
    pb = b.toPandas().sort_values("loan_id")
    assert len(pa) == 1000 and pa["loan_id"].is_unique
    assert (pa["split"].to_numpy() == pb["split"].to_numpy()).all()
    for y, part in pa.groupby("y"):
        assert (part["split"] == "test").sum() == int(np.floor(len(part) * 0.3 + 0.5))


def test_down_sample_removes_exact_count(spark):
    d = _data(spark)
    n1 = d.where("y = 1").count()
    out = SP.down_sample(d, "y", "loan_id", remove={1: 100}, seed=3)
    assert out.where("y = 1").count() == n1 - 100
    assert out.where("y != 1").count() == d.where("y != 1").count()


def by_rank(d, seed, want):
    from riskframe.operators.rank import rank_by_hash
    r = rank_by_hash(d, ["y"], "loan_id", seed)
    return {x["loan_id"] for x in r.where(F.col("_rank") <= want(F.col("_n"))).collect()}


@pytest.mark.parametrize("step, few", [(16, 4096), (2, 1), (16, 1), (60, 1)])
def test_selection_equals_the_ranked_rows(spark, monkeypatch, step, few):
    monkeypatch.setattr(nth, "STEP", step)
    monkeypatch.setattr(nth, "FEW", few)
    d = _data(spark, 300).withColumn("y", F.when(F.col("loan_id") % 10 != 0, F.col("y")))     # a NULL class
    for share in (0.0, 0.3, 0.999, 1.0):
        want = F.floor(F.col("_n") * F.lit(share))
        got = {x["loan_id"] for x in d.where(nth.first_in_hash_order(d, "y", "loan_id", 4, want)).collect()}
        assert got == by_rank(d, 4, lambda n: F.floor(n * F.lit(share)))


def test_selection_moves_no_row(spark, tmp_path):
    _data(spark).write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    for out in (SP.stratified_split(d, "y", "loan_id"), SP.down_sample(d, "y", "loan_id", keep={1: 50}),
                SP.tail_validation(d, "y", "loan_id")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_repeated_keys_stay_together_and_empty_tables(spark):
    d = spark.createDataFrame([(1, 7)] * 500 + [(1, k) for k in range(100, 110)], "y int, loan_id long")
    kept = SP.down_sample(d, "y", "loan_id", keep={1: 5}).groupBy("loan_id").count().collect()
    assert all(r["count"] in (1, 500) for r in kept) and sum(r["count"] for r in kept) >= 5
    assert SP.stratified_split(d.limit(0), "y", "loan_id").count() == 0
    with pytest.raises(Exception, match="smaller than the rows"):
        SP.down_sample(d, "y", "loan_id", remove={1: 1000}).count()
