"""Packing token sequences by cutting-stock column generation.

1. Tasks encode whole texts and cut each document into full pieces of
   ``capacity`` tokens and one remainder; a piece's size class is its length in
   granules, rounded up. The pieces, with their ids and a running rank per task
   and class, are written to the shared folder.
2. The histogram of classes (at most ``capacity / granule`` rows) goes to the
   driver, where ``cutting_stock.plan`` makes patterns and whole-number uses.
3. Every piece gets its rank among all pieces of its class (rank in its task
   plus the counts of earlier tasks) and the pattern slot of that rank from an
   interval table, whose size is bounded by classes and patterns.
4. Offsets are running sums of true lengths in each sequence.

Documents up to ``capacity`` tokens are not cut; padding is what the rounding
to granules and the last sequences leave.

Defined cases: a null or empty text is the end id alone; repeated rows and null
ids are packed like any other row; an empty table gives an empty table; very
long texts become many full pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm import cutting_stock
from riskframe.llm.common import byte_slices, text_or_empty, written
from riskframe.llm.tokens import encoder

#: text encoded at once: what the tokenizer's steps hold is about 15 times that, in each worker.
SLICE_BYTES = 2 << 20
_PIECES = ("doc_id long, start long, length long, doc_tokens long, ids binary, ids_crc32 long, "
           "size_class int, task int, task_rank long")


def cut_documents(df: DataFrame, tokenizer: str, capacity: int, granule: int, end_id: int, id_col: str,
                  text_col: str) -> DataFrame:
    """Pieces of all documents with their ids (little-endian, as wide as the
    vocabulary needs) and the checksum of the ids as unsigned 32-bit integers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()      # of the worker's tasks before this one
        enc = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity // granule + 2, np.int64)
        end = np.array([end_id], enc.dtype)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                            ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()),
                            ("size_class", pa.int32()), ("task", pa.int32()), ("task_rank", pa.int64())])
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE_BYTES):
                keys = part.column(0).to_pylist()
                rows = []
                for key, ids in zip(keys, enc.encode_many(part.column(1).to_pylist())):
                    ids = np.concatenate([ids, end])
                    for at in range(0, len(ids), capacity):
                        piece = ids[at:at + capacity]
                        cls = -(-len(piece) // granule)
                        rows.append((key, at, len(piece), len(ids), piece.tobytes(),
                                     zlib.crc32(piece.astype("<u4")), cls, task, int(seen[cls])))
                        seen[cls] += 1
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    # long, so that the ids are decoded alike whatever integer type the table has
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        cut, _PIECES)


def _intervals(plan: list) -> list[tuple]:
    """(size_class, lo, hi, per_sequence, first_sequence): pieces of the class
    ranked lo..hi-1 go, per_sequence at a time, to sequences from
    first_sequence on."""
    taken: dict[int, int] = {}
    out, base = [], 0
    for pattern, uses in plan:
        for size, per in pattern.tolist():
            lo = taken.get(size, 0)
            taken[size] = lo + per * uses
            out.append((size, lo, lo + per * uses, per, base))
        base += uses
    return out


def pack(df: DataFrame, tokenizer: str, capacity: int = 4096, granule: int = 8, end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, ids_crc32,
    sequence_id, offset."""
    spark = df.sparkSession
    pieces = written(cut_documents(df, tokenizer, capacity, granule, end_id, id_col, text_col), "pieces")
    counts = written(pieces.groupBy("task", "size_class").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["size_class"]: r["n"] for r in counts.groupBy("size_class").agg(F.sum("n").alias("n")).collect()}
    slots = _intervals(cutting_stock.plan(histogram, capacity // granule))
    table = spark.createDataFrame(slots, "size_class int, lo long, hi long, per long, first long")
    before = Window.partitionBy("size_class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("task", "size_class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = (pieces.join(earlier, ["task", "size_class"])
              .withColumn("rank", F.col("earlier") + F.col("task_rank")))
    # the slot table is bounded: a row per pattern and class, at most two patterns a class
    placed = ranked.join(F.broadcast(table), "size_class").where("rank >= lo and rank < hi")
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("per")))
    place = (Window.partitionBy("sequence_id").orderBy(F.desc("size_class"), "rank")
             .rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(
        "doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32", "sequence_id",
        F.coalesce(F.sum("length").over(place), F.lit(0)).alias("offset"))
