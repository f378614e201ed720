import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskframe.operators import select as SEL


def test_rank_table_is_put_together_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(SEL, "CELLS_A_PART", 50)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": np.arange(400), "a": rng.integers(0, 3, 400).astype(float), "b": rng.normal(size=400)})
    pdf.loc[:99, "b"] = 0.5
    pdf.loc[200:209, "b"] = None
    rt = SEL.rank_table(spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b"))), ["a", "b"], "id")
    assert rt.rdd.getNumPartitions() == 16
    got = rt.toPandas().sort_values("id").reset_index(drop=True)
    assert len(got) == 400
    for c in "ab":
        assert np.allclose(got[c].to_numpy(float), pdf[c].rank().to_numpy(), equal_nan=True)
