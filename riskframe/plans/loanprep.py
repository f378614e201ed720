"""Path 1 of the reference as Spark jobs: raw loans -> cleaned -> down-sampled
-> split -> imputed/encoded -> scaled model inputs (one DataFrame; the split
is a column, not four objects)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, prep, split
from ..session import cut_lineage
from ..sources import loans as L

#: seeds of the view's pipeline (down-sample, split, folds).
DOWNSAMPLE_SEED = 1
SPLIT_SEED = L.VIEW_SPLIT_SEED
FOLD_SEED = 20
PASSTHROUGH = ["installment", "revol_bal", "term"]

#: model inputs after the correlation / base-level drops (full-rank design).
#: ``term`` repeats ``sub_grade``; one dummy per one-hot group is the base level.
MODEL_DROP = ["term", "purpose_AUTOMOBILE", "addr_state_AFRICA"]


def max_nulls() -> int:
    return int(L.VIEW_MAX_NULL_SHARE * len(L.VIEW_COLUMNS))


def cleaned_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, B4, B3, B9, B5, B7, B8, B6 on the loan view."""
    v = L.loan_view(spark, sf_dir)
    d = clean.drop_rows_with_nulls(v, max_nulls())
    d = clean.recode_label(d, "loan_status", L.VIEW_STATUS_CLASSES, out="y")
    d = clean.recode(d, "purpose", L.VIEW_PURPOSE_RECODE)
    d = clean.drop_category(d, "purpose", L.VIEW_DROP_PURPOSE)
    d = clean.group_codes(d, "addr_state", L.region_lookup(spark, sf_dir))
    for c, (val, rep) in L.VIEW_SENTINELS.items():
        d = clean.replace_sentinel(d, c, val, rep)
    for c, lo in L.VIEW_LOWER_CLAMPS.items():
        d = clean.clamp_lower(d, c, lo)
    d = d.withColumn("term", clean.leading_int(F.col("sub_grade")))
    return d.drop("loan_status")


def split_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 then C2: remove a share of class 1, then the stratified 70/30 split."""
    # reused by four passes (two hash ranks); blocks lost with an executor are
    # recomputed from the deterministic lineage
    d = cleaned_loans(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    d = split.down_sample(d, "y", "loan_id", remove_share={1: L.VIEW_REMOVE_SHARE_CLASS1},
                          seed=DOWNSAMPLE_SEED)
    return split.stratified_split(d, "y", "loan_id", L.VIEW_TEST_FRACTION, SPLIT_SEED)


@dataclass
class Prepared:
    data: DataFrame          # loan_id, y, split, fold (train only), features...
    features: list[str]      # all encoded feature names, in output order
    transformer: dict = field(default_factory=dict)
    scaler: dict = field(default_factory=dict)

    @property
    def model_features(self) -> list[str]:
        return [f for f in self.features if f not in MODEL_DROP]

    def train(self) -> DataFrame:
        return self.data.where(F.col("split") == "train")

    def test(self) -> DataFrame:
        return self.data.where(F.col("split") == "test")


def prepared_loans(spark: SparkSession, sf_dir: str, scale: bool = True, folds: bool = False,
                   materialize: bool = False) -> Prepared:
    """D1-D7 fitted on the training part and applied to both parts.

    ``materialize`` writes the result to the checkpoint folder (lineage cut)
    for iterative consumers such as the fitters."""
    s = split_loans(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    train = s.where(F.col("split") == "train")
    tspec = prep.fit_transformer(train, L.VIEW_MEDIAN_COLUMNS, L.VIEW_ORDINAL_COLUMNS,
                                 L.VIEW_ONEHOT_COLUMNS, PASSTHROUGH)
    enc = prep.apply_transformer(s, tspec, keep=["loan_id", "y", "split"])
    feats = prep.output_columns(tspec)
    sspec = {}
    if scale:
        sspec = prep.fit_scaler(enc.where(F.col("split") == "train"), feats, L.VIEW_FIXED_SCALES)
        enc = prep.apply_scaler(enc, sspec)
    if folds:
        tr = split.stratified_kfold(enc.where(F.col("split") == "train"), "y", "loan_id",
                                    L.VIEW_FOLDS, FOLD_SEED)
        te = enc.where(F.col("split") == "test").withColumn("fold", F.lit(0))
        enc = tr.unionByName(te)
    if materialize:
        enc = cut_lineage(enc)
    return Prepared(enc, feats, tspec, sspec)
