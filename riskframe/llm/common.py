"""Helpers shared by the operators: reading tables, tables written to the
shared folder, and connected components by large-star/small-star rounds."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read
    back: cuts lineage, survives the loss of executors, is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def total_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a text column over all rows (one aggregate row)."""
    row = df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("b")).first()
    return int(row["b"] or 0)


def parts_for(n_bytes: int, per_part: int, least: int = 1) -> int:
    return max(least, -(-n_bytes // per_part))


def _min_of_neighbours(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest label among u and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _min_of_neighbours(both)
    return (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _min_of_neighbours(down)
    to_low = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_low.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected edge table (u, v).

    Rounds of large-star and small-star (Kiveris et al., 2014), each a grouped
    minimum joined back to the edges, written to the shared folder; the driver
    sees one checksum row per round. Minima are combined before the shuffle,
    and the join back is a plain equi-join that AQE splits when a vertex is
    hot. Returns (u, root) for every vertex with an edge, root included; root is
    the smallest vertex of the component. Rows with a null end and self-loops
    are ignored.
    """
    cur = written(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), name)
    sign = _signature(cur)
    while sign[0]:
        cur = written(_small_star(_large_star(cur)), name)
        new = _signature(cur)
        if new == sign:
            break
        sign = new
    stars = cur.select("u", F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("u"), "root").distinct())


def key128(*cols: str | Column) -> Column:
    """A 16-byte key of the values: two 64-bit hashes under different seeds."""
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *cols)), 16, "0") for seed in (101, 202)]
    return F.unhex(F.concat(*halves))


def text_key(text: Column) -> Column:
    """A 16-byte key of a whole text."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def byte_slices(batch: pa.RecordBatch, column: int | str, n_bytes: int = 8 << 20, rows: int = 2000):
    """Slices of a batch with at most ``n_bytes`` of one text column and ``rows`` rows, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + n_bytes, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def runs_by(batches, names: list[str]):
    """Consecutive rows with equal values in ``names``, as (values, Arrow table);
    for batches whose rows are sorted by these columns. Holds one run at a time."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(n).to_pylist() for n in names]
        rows = list(zip(*cols))
        at = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i] == rows[at]:
                continue
            if held and rows[at] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = rows[at]
            held.append(batch.slice(at, i - at))
            at = i
    if held:
        yield key, pa.Table.from_batches(held)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links (i, j)."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new
