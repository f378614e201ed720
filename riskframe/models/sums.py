"""The sum-of-partials job shared by the iterative fitters.

Each partition turns its rows (Arrow batches -> numpy) into one fixed-size
vector of partial sums (log-likelihood, gradient, information matrix, ...). A
vector leaves its partition as one ``array<double>`` row. The rows are added in
two levels: dealt over ``FAN_IN`` keys (AQE merges the partitions of a small
table into one) and added there, then added once more in one task, so the
driver receives one vector whatever the number of partitions; up to ``DIRECT`` numbers
in all it receives those of the partitions.

Tables that many jobs read are held as :class:`Packed`: every Arrow batch is one
cached row, a compressed Arrow stream, so a pass does not turn each cell
from Spark's rows into Arrow again. Batches and their order are those of the table.
Once the cache is filled, sums read it in ``WAVES`` tasks a core: handing a task to its Python
worker costs some 0.1 s, more than the batches of a small partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame

MAX_VECTOR = 4_000_000
FAN_IN = 1024
#: numbers that the driver receives and adds itself: a second stage costs more.
DIRECT = 2_000_000
WAVES = 3
_VECTOR = "shard int, vec array<double>"


def _row(vec: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"shard": [TaskContext.get().partitionId() % FAN_IN], "vec": [np.asarray(vec, dtype="float64")]})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        vecs = batch.column("vec")
        for i in range(len(vecs)):
            v = vecs[i].values.to_numpy()
            total = v.copy() if total is None else total + v
    if total is not None:
        yield pa.record_batch([pa.array([0], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["shard", "vec"])


class Packed:
    """The batches of a table, each one cached row (MEMORY_AND_DISK; a lost block is
    recomputed from the lineage)."""

    def __init__(self, df: DataFrame):
        self.source = df
        self.data = df.mapInArrow(_packed, "shard int, part binary").persist(StorageLevel.MEMORY_AND_DISK)
        self.filled = False

    def merged(self, parts: int) -> Packed:
        """The same batches in fewer partitions, without a shuffle."""
        out = copy(self)
        out.data = self.data.coalesce(parts)
        return out

    def for_pass(self) -> tuple[Packed, int | None]:
        """The table as the next pass reads it, and the most tasks it has if that is known. The
        first pass fills the cache partition by partition."""
        if not self.filled:
            self.filled = True
            return self, None
        tasks = WAVES * self.source.sparkSession.sparkContext.defaultParallelism
        return self.merged(tasks), tasks

    def unpersist(self) -> None:
        self.data.unpersist()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    options = pa.ipc.IpcWriteOptions(compression="lz4")
    for batch in batches:
        if batch.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                out.write_batch(batch)
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                   pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["shard", "part"])


def _table(part: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(part.as_buffer()).read_all()


def _pandas(part: pa.Scalar) -> pd.DataFrame:
    return _table(part).to_pandas(date_as_object=True)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Scalar]]:
    for batch in batches:
        yield from zip(batch.column("shard").to_pylist(), batch.column("part"))


def _lanes(batches: Iterator[pa.RecordBatch], lanes: int) -> Iterator[list[Iterator[pd.DataFrame]]]:
    """The batches by shard, ``lanes`` shards at a time; one shard streams, of more the
    compressed batches are held."""
    by_shard = (part for _, part in groupby(_parts(batches), lambda p: p[0]))
    if lanes == 1:
        for parts in by_shard:
            yield [(_pandas(p) for _, p in parts)]
        return
    while held := [[p for _, p in parts] for parts in islice(by_shard, lanes)]:
        yield [map(_pandas, parts) for parts in held]


def _mapped(df: DataFrame | Packed, fn: Callable, lanes: int = 0, arrow: bool = False) -> DataFrame:
    """``fn`` (batches as pandas, with ``arrow`` as Arrow tables, or those of ``lanes`` shards at a time
    -> rows of shard and vec) over every partition."""
    packed = isinstance(df, Packed)
    if not packed and not arrow:
        return df.mapInPandas(fn, _VECTOR)
    read = _table if arrow else _pandas

    def rows(batches):
        if not packed:
            own = (pa.Table.from_batches([b]) for b in batches)
        else:
            own = _lanes(batches, lanes) if lanes else (read(p) for _, p in _parts(batches))
        for row in fn(own):
            yield pa.record_batch([pa.array(row["shard"], pa.int32()), pa.array(row["vec"], pa.list_(pa.float64()))], ["shard", "vec"])
    return (df.data if packed else df).mapInArrow(rows, _VECTOR)


def _reduce(parts: DataFrame, size: int, shards: int | None = None) -> np.ndarray:
    """Add the per-partition vectors; no partition had rows: zeros. Tables known to have
    at most ``FAN_IN`` partitions need no first level, and where all vectors together are short the driver adds them."""
    if shards is not None and shards * size <= DIRECT:
        vecs = [v.values.to_numpy() for v in parts.select("vec").toArrow().column("vec")]
        return np.sum(vecs, axis=0) if vecs else np.zeros(size)
    if shards is None or shards > FAN_IN:
        parts = parts.repartition("shard").mapInArrow(_add, _VECTOR)
    # collect, not first(): a limit breaks off the Python workers, which then start anew
    rows = parts.repartition(1).mapInArrow(_add, _VECTOR).collect()
    return np.array(rows[0]["vec"], dtype="float64") if rows else np.zeros(size)


def partition_sums(df: DataFrame | Packed, fn: Callable[[pd.DataFrame], np.ndarray], size: int,
                   arrow: bool = False) -> np.ndarray:
    """Σ over all rows of ``fn(batch)`` (each call returns a length-``size`` vector). With ``arrow``
    the batches are Arrow tables, whose columns need no copy into pandas."""
    if size > MAX_VECTOR:
        raise ValueError("partition_sums: vector too large for the driver")

    def mapper(it):
        acc = np.zeros(size, dtype="float64")
        seen = False
        for pdf in it:
            if len(pdf):
                acc += fn(pdf)
                seen = True
        if seen:
            yield _row(acc)

    df, tasks = df.for_pass() if isinstance(df, Packed) else (df, None)
    return _reduce(_mapped(df, mapper, arrow=arrow), size, tasks)


def partition_fold(df: DataFrame | Packed, fold: Callable, size: int, shards: int | None = None, lanes: int = 0) -> np.ndarray:
    """Like :func:`partition_sums`, but ``fold(batches)`` sees the partition's
    Arrow batches as an iterator (state may carry from batch to batch, memory
    stays one batch) and returns one length-``size`` vector per partition. With ``lanes`` (of a
    ``Packed`` table) it sees lists of that many iterators, one per shard."""
    if size > MAX_VECTOR:
        raise ValueError("partition_fold: vector too large for the driver")

    def mapper(it):
        vec = fold(it)
        if vec is not None:
            yield _row(vec)

    return _reduce(_mapped(df, mapper, lanes), size, shards)


def cached_design(df: DataFrame, cols: list[str], label: str | None = None, cache: bool = True) -> DataFrame | Packed:
    """Project the fit columns, drop rows with NULLs and hold the batches. Every call has
    a table of its own, so fits that run side by side do not release each other's.
    ``cache=False``: a table read once or twice, not held."""
    d = df.select(*([label] if label else []), *cols).dropna()
    return Packed(d) if cache else d


def design_matrix(pdf: pd.DataFrame, cols: list[str], intercept: bool = True) -> np.ndarray:
    x = pdf[cols].to_numpy(dtype="float64") if cols else np.zeros((len(pdf), 0))
    if intercept:
        x = np.hstack([np.ones((len(pdf), 1)), x])
    return x


def design_columns(batch: pd.DataFrame | pa.Table, cols: list[str]) -> np.ndarray:
    """``design_matrix`` turned over: a row for the intercept and one for each column."""
    x = np.empty((len(cols) + 1, len(batch)))
    x[0] = 1.0
    for i, c in enumerate(cols, 1):
        x[i] = batch[c].to_numpy()
    return x


def label_index(pdf: pd.DataFrame, label: str, classes: list) -> np.ndarray:
    return class_index(pdf[label].to_numpy(), label, classes)


def class_index(y: np.ndarray, label: str, classes: list) -> np.ndarray:
    idx = np.full(len(y), -1, dtype=np.int64)
    for i, k in enumerate(classes):
        idx[y == k] = i
    if (idx < 0).any():
        raise ValueError(f"label {label} has values outside {classes}")
    return idx
