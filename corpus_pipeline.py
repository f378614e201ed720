"""The corpus pipeline: toxic documents go, one document of each near-duplicate
group stays, passages repeated across documents are cut, documents that hold test
items go, and the rest is packed into sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept; all but the last return the columns of documents. Nulls, empty and very long
texts, repeated rows, empty tables and other columns are treated as the operators'
docstrings say; no stage drops a row for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import decontaminate, ngram_join, packing, suffix_dedup, toxicity
from riskframe.llm.common import read_table, written
from riskframe.llm.queries import TOKENIZER, TOXIC_AT, held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored ``TOXIC_AT`` or more go; the model learns from the labels of
    documents that are not held out."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return toxicity.reject(docs, model, TOXIC_AT)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

# SQL has no counterpart of the trained scores, the hashes or the plan; tests compare
# every stage with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
