"""Scoring a stream with a fitted linear model.

The reference has no streaming. A fitted multinomial or ordered logit is a
set of column expressions (:mod:`riskframe.models.linear`), so the very same
scorer runs unchanged on a Structured Streaming DataFrame: new loan rows
arriving as Parquet files are scored per micro-batch and appended to a
prediction sink partitioned like the batch one (A4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..models.linear import score_linear


def score_stream(spark: SparkSession, source_dir: str, schema: T.StructType, features: list[str], beta: dict,
                 keep: list[str], classes=(1, 2, 3)) -> DataFrame:
    """Streaming DataFrame of predictions for Parquet files landing in ``source_dir``."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    return score_linear(stream, features, beta, keep, classes)


def write_stream(pred: DataFrame, sink_dir: str, checkpoint_dir: str, trigger_once: bool = True):
    """Append predictions to Parquet with an exactly-once file sink."""
    w = pred.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
    w = w.outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
