"""Two-pass external shuffle into shards (DataFrame functions only).

Pass 1 scatters the records by seeded hashes: the shard comes from rendezvous
hashing of (id, shard) alone, the bucket inside the shard from a hash of the
id, the text and the input partition. The bucket count follows the bytes of
the table, so that one bucket fits in a task's memory whatever the size of the
table; the input partition in the hash spreads the rows of one repeated id over
all buckets of its shard. Pass 2 gathers one bucket at a time, orders it,
applies Spark's seeded Fisher-Yates ``shuffle`` and writes it.

The ``key`` law holds: id and shard count alone decide the shard, and one more
shard takes rows only into itself. The order inside a bucket is fixed by the
written files; a task that is run again writes its buckets anew.

Defined cases: a null text has size 1 and checksum 0; rows with a null id form
one key; repeated rows are kept, each with a slot of its own; an empty table
gives an empty table; other columns travel along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import parts_for, scratch_path, text_or_empty, total_bytes

BUCKET_BYTES = 8 << 20


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard whose seeded hash with the key is largest."""
    scores = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(s)).alias("score"), F.lit(s).alias("s"))
              for s in range(shards)]
    return F.array_max(F.array(*scores))["s"]


def shuffle_shards(df: DataFrame, path: str, shards: int = 8, seed: int = 17, id_col: str = "doc_id",
                   text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``df`` to ``path`` in shuffled order, one folder per shard, and return
    the table read back: the columns of ``df`` in a struct ``record``, with
    size, text_crc32, shard, grown_shard, bucket and place (in its bucket)."""
    each = parts_for(total_bytes(df, text_col), bucket_bytes * shards)
    text = text_or_empty(text_col)
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        rendezvous(F.col(id_col), shards, seed).alias("shard"),
        rendezvous(F.col(id_col), shards + 1, seed).alias("grown_shard"),
        F.xxhash64(F.lit(seed + 2), F.col(id_col), F.col(text_col)).alias("row_hash"),
        F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(text_col), F.spark_partition_id()),
               F.lit(each)).alias("bucket"))
    item = F.struct("row_hash", "size", "text_crc32", "grown_shard", "record")
    gathered = (rows.repartition(each * shards, "shard", "bucket").groupBy("shard", "bucket")
                .agg(F.collect_list(item).alias("items"))
                .sortWithinPartitions("shard", "bucket"))
    # an order that does not depend on how the rows arrived, before the seeded shuffle
    order = F.array_sort("items", lambda a, b: F.when(a["row_hash"] < b["row_hash"], -1)
                         .when(a["row_hash"] > b["row_hash"], 1).otherwise(0))
    (gathered.select("shard", "bucket", F.posexplode(F.shuffle(order, seed)).alias("place", "item"))
     .select("shard", "bucket", "place", "item.*").drop("row_hash").write.partitionBy("shard").parquet(path))
    schema = gathered.select("bucket", F.lit(0).alias("place"), F.explode("items").alias("item")).select(
        "bucket", "place", "item.*", F.lit(0).alias("shard")).drop("row_hash").schema
    return df.sparkSession.read.schema(schema).parquet(path)


def with_slots(written: DataFrame) -> DataFrame:
    """Number the rows of every shard without gaps: the rows of earlier buckets
    (one count per bucket, summed over a window of bucket counts) plus the
    place in the bucket."""
    counts = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return written.join(offsets, ["shard", "bucket"]).withColumn("slot", F.col("first") + F.col("place"))


def default_path(df: DataFrame) -> str:
    return scratch_path(df.sparkSession, "shards")
