"""Scans and sinks (A1-A7): Parquet/CSV readers with explicit schemas and the
writers for datasets, predictions, parameters and pair reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table (filters/projections push down)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Missing = SQL NULL everywhere: NaN in double columns becomes NULL at
    the scan (Spark's median would otherwise count NaN as a value)."""
    dbl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    cols = [c for c in (cols or list(dbl)) if c in dbl]
    if not cols:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols})


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             header: bool = True) -> DataFrame:
    """A1/A2: CSV scan with an explicit schema (no inference pass over the data).

    ``path`` may be a file, a folder or a glob. Bad numerics become NULL
    (PERMISSIVE mode) and NaN is turned into NULL.
    """
    df = (spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
          .option("nanValue", "NaN").csv(path))
    return nan_to_null(df)


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    """Write a dataset (features and label already in one frame)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_predictions(pred: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A4: one prediction dataset partitioned by model and fold."""
    parts = [c for c in ("model", "fold") if c in pred.columns]
    write_dataset(pred, path, partition_by=parts or None, mode=mode)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A2 counterpart of :func:`write_predictions` (partition columns come back)."""
    return spark.read.parquet(path)


PARAM_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("equation", T.StringType()),
    T.StructField("term", T.StringType()),
    T.StructField("estimate", T.DoubleType()),
    T.StructField("std_err", T.DoubleType()),
])


def save_params(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Model parameters as a small Parquet table."""
    spark.createDataFrame(rows, PARAM_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_fold_predictions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A2: outside prediction files (true, pred, prob_pred_c1..K), one folder ``fold=i`` per
    fold, as one dataset (fold, y, pred, prob_c1..K) in one scan."""
    with_fold = T.StructType([*schema.fields, T.StructField("fold", T.IntegerType())])
    df = read_csv(spark, path, with_fold)
    probs = [c for c in schema.fieldNames() if c.startswith("prob_pred_")]
    return df.select("fold", F.col("true").alias("y"), "pred", *[F.col(c).alias(c.replace("prob_pred_", "prob_")) for c in probs])


def finite_or_null(x: float | None) -> float | None:
    return None if x is None or not math.isfinite(x) else float(x)
