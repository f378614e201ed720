import pytest
from pyspark.sql import functions as F

from tests.llm import SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty, long and repeated rows, ties, and columns whose names clash with the
    operators' own."""
    words = "the quick brown fox jumps over the lazy dog while seven wizards brew potions beside a cold river".split()
    base = " ".join(words[(i * 7 + i // 3) % len(words)] + str(i % 11) for i in range(120))
    near = base.replace("fox", "cat", 1)
    rows = [(1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (6, "   \n "), (None, base), (None, "solo row"),
            (7, "two words"), (8, "two words"), (9, "a" * 300), (10, "a" * 200 + "b" * 80), (11, "ÜÄ é " * 60),
            (12, "zz " + "ÜÄ é " * 40 + "q"), (13, " ".join(f"w{i % 977}" for i in range(9000))),
            (14, "Say \"hi\" <|endoftext|> ² ½ don't we'll ΟΔΟΣ"), (15, base[100:400] + " other words follow here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return (df.withColumn("key", F.lit("x")).withColumn("start", F.lit(1)).withColumn("batch", F.lit(2))
            .withColumn("rank", F.lit(3)).withColumn("n", F.lit(4)).withColumn("shard", F.lit(5)).withColumn("size", F.lit(6)))
