import pytest
from pyspark.sql import functions as F

from riskframe.operators import clean as C
from riskframe.operators import prep as D


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "id int, c double, x double")
    spec = D.fit_scaler(df, ["c", "x"], {})
    out = D.apply_scaler(df, spec).orderBy("id").collect()
    assert [r["c"] for r in out] == [0.0, 0.0]
    assert [r["x"] for r in out] == [0.0, 1.0]


def test_null_survives_clamp(spark):
    df = spark.createDataFrame([(1, -3.0), (2, None), (3, 4.0)], "id int, fee double")
    out = C.clamp_lower(df, "fee", 0.0).orderBy("id").collect()
    assert [r["fee"] for r in out] == [0.0, None, 4.0]


def test_unmapped_label_filtered(spark):
    df = spark.createDataFrame([("Current",), ("Charged Off",), ("Does not meet policy",)], "loan_status string")
    from riskframe.sources.loans import LOAN_STATUS_CLASSES
    out = C.recode_label(df, "loan_status", LOAN_STATUS_CLASSES).collect()
    assert sorted(r["y"] for r in out) == [1, 3]


def test_unseen_ordinal_raises(spark):
    tr = spark.createDataFrame([("A1",), ("B2",)], "g string")
    cats = D.fit_categories(tr, ["g"])
    te = spark.createDataFrame([("C3",)], "g string")
    with pytest.raises(Exception):
        te.select(*[e.alias(n) for n, e in D.ordinal_exprs(cats).items()]).collect()


def test_binary_onehot_gives_one_column(spark):
    tr = spark.createDataFrame([("f",), ("w",), (None,)], "s string")
    cats = D.fit_categories(tr, ["s"])
    ex = D.onehot_exprs(cats)
    assert list(ex) == ["s_w"]
    vals = [r[0] for r in tr.select(ex["s_w"]).collect()]
    assert vals == [0.0, 1.0, 0.0]


def test_recode_passthrough_and_sentinel(spark):
    df = spark.createDataFrame([("wedding", -1.0), ("car", 2.0)], "purpose string, dti double")
    from riskframe.sources.loans import LOAN_PURPOSE_RECODE
    out = C.replace_sentinel(C.recode(df, "purpose", LOAN_PURPOSE_RECODE), "dti", -1.0, 0.0).collect()
    assert [(r["purpose"], r["dti"]) for r in out] == [("house", 0.0), ("car", 2.0)]


def test_leading_int(spark):
    df = spark.createDataFrame([(" 36 months",), ("1-URGENT",), ("none",)], "t string")
    assert [r[0] for r in df.select(C.leading_int("t")).collect()] == [36, 1, None]


def test_drop_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, None), (3, 1.0, 2.0)], "id int, a double, b double")
    assert sorted(r["id"] for r in C.drop_rows_with_nulls(df, 1).collect()) == [2, 3]
