"""The raw loan file as Spark jobs: CSV -> cleaned -> down-sampled -> split ->
imputed and encoded -> scaled -> the model inputs, with the column roles of the
hybrid models.

Columns are taken by name from the header; a cell that is no number where one is
expected becomes NULL, so no bad cell fails the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean, prep, split
from ..operators.design import ModelSpec
from ..session import cut_lineage
from ..sources import loans as L
from .loanprep import Prepared

#: numbers that the model inputs or the correlation drop list name.
NUMBERS = [c for c in dict.fromkeys([*L.LOAN_FEATURES, *L.LOAN_DROP_CORRELATED, *L.LOAN_MEDIAN_COLUMNS])
           if c not in L.LOAN_TEXT_COLUMNS and not any(c.startswith(f"{o}_") for o in L.LOAN_ONEHOT_COLUMNS)]
#: the columns in use, with their types in the raw file.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in L.LOAN_TEXT_COLUMNS]
                          + [T.StructField(c, T.DoubleType()) for c in NUMBERS])

PRESETS = {
    "MNL": ModelSpec("MNL", L.LOAN_FEATURES, []),
    "H1": ModelSpec("H1", [c for c in L.LOAN_FEATURES if c not in L.LOAN_H1_DEEP], L.LOAN_H1_DEEP),
    "H2": ModelSpec("H2", L.LOAN_H2_WIDE, [c for c in L.LOAN_FEATURES if c not in L.LOAN_H2_WIDE]),
    "H3": ModelSpec("H3", L.LOAN_H3_WIDE, [c for c in L.LOAN_FEATURES if c not in L.LOAN_H3_WIDE]),
}


def import_loans(spark: SparkSession, path: str, max_nulls: int = L.LOAN_MAX_NULLS) -> DataFrame:
    """A1: the CSV file or folder, typed: loan_id and the columns of ``RAW_SCHEMA``. Rows
    with more than ``max_nulls`` empty cells over all raw columns go (B1), then the
    columns that are not used (B2). ``loan_id`` is the file's id where that is a number, else a
    hash of the row."""
    raw = spark.read.option("header", True).option("escape", "\"").csv(path)
    raw = clean.drop_rows_with_nulls(raw, max_nulls)
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns])
    key = F.coalesce(F.col("id").try_cast("long"), row_hash) if "id" in raw.columns else row_hash
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in raw.columns
             else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA]
    return raw.select(key.alias("loan_id"), *typed)


def cleaned_loan_file(loans: DataFrame) -> DataFrame:
    """B3-B9 on imported loans; the class is ``y``."""
    d = clean.recode_label(loans, "loan_status", L.LOAN_STATUS_CLASSES, out="y").drop("loan_status")
    d = clean.recode_strict(d, "term", L.LOAN_TERM_MONTHS)
    d = clean.recode(d, "purpose", L.LOAN_PURPOSE_RECODE)
    d = clean.recode_strict(d, "emp_length", L.LOAN_EMP_LENGTH_YEARS)
    d = clean.recode(d, "verification_status", L.LOAN_VERIFICATION_RECODE)
    d = clean.group_codes(d, "addr_state", L.LOAN_STATE_REGIONS)
    for c, (value, instead) in L.LOAN_SENTINELS.items():
        d = clean.replace_sentinel(d, c, value, instead)
    d = clean.drop_category(d, "purpose", L.LOAN_DROP_PURPOSE)
    for c, bound in L.LOAN_LOWER_CLAMPS.items():
        d = clean.clamp_lower(d, c, bound)
    return d


def prepared_loan_file(loans: DataFrame, remove_class1: int = L.LOAN_REMOVE_CLASS1, test_fraction: float = 0.3,
                       seed: int = 10) -> Prepared:
    """C1, C2, D1-D7, E6 and E7 by the fixed lists: the model inputs of both parts.
    ``features`` are those of ``LOAN_FEATURES`` that the training part has."""
    d = cleaned_loan_file(loans)
    if remove_class1:
        d = split.down_sample(d, "y", "loan_id", remove={1: remove_class1}, seed=seed)
    d = cut_lineage(split.stratified_split(d, "y", "loan_id", test_fraction, seed))
    train = d.where(F.col("split") == "train")
    used = {*L.LOAN_MEDIAN_COLUMNS, *L.LOAN_ORDINAL_COLUMNS, *L.LOAN_ONEHOT_COLUMNS, "loan_id", "y", "split"}
    spec = prep.fit_transformer(train, L.LOAN_MEDIAN_COLUMNS, L.LOAN_ORDINAL_COLUMNS, L.LOAN_ONEHOT_COLUMNS,
                                [c for c in d.columns if c not in used])
    enc = prep.apply_transformer(d, spec, keep=["loan_id", "y", "split"])
    gone = {*L.LOAN_DROP_CORRELATED, *L.LOAN_DROP_UNRELATED}
    have = {c for c in prep.output_columns(spec) if c not in gone}
    features = [c for c in L.LOAN_FEATURES if c in have]
    scaler = prep.fit_scaler(enc.where(F.col("split") == "train").select(*[f"`{c}`" for c in features]), features,
                             L.LOAN_FIXED_SCALES)
    out = prep.apply_scaler(enc.select("loan_id", "y", "split", *[f"`{c}`" for c in features]), scaler)
    return Prepared(out, features, spec, scaler)
