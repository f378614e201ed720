"""Embedding whitening by QDWH spectral divide and conquer.

Entries become integers x = floor(64 c) + 1000000, so sums are exact at any
size. The fit list is every distinct x vector once (a grouping with map-side
combination: copies do not travel). Three passes over it add per-partition
partial sums, in Spark, for the sums per dimension, the centred covariance and
the check of the whitened covariance; the driver holds d x d numbers, d being
the dimension. ``spectral.top_components`` gives the components, which travel
with the task to whiten every row.

Defined cases: null vectors and vectors with null or non-finite entries are dropped, and so
are entries of 2^40 and more in size, for which x has no exact sums. Vectors of different
lengths are fitted apart, each length with its own n. Components without variance (eigenvalue
at most 1e-12 of the trace) cannot be whitened and give no rows: none at all for empty
vectors, a single vector or only equal vectors. Repeated rows and ids give their own rows and
count once in the fit; null ids are carried through; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import written
from riskframe.llm.spectral import top_components

SHIFT, SCALE = 1_000_000, 64
LARGEST = float(1 << 40)
COMPONENTS = 16
FLAT = 1e-12
_SUMS = "i int, v array<double>"
_OUT = ("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


@dataclass
class Model:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def base(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole and remaining part of the mean: sums = whole * n + rest."""
        return (np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.base()
        return (x - whole).astype("float64") - rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        whole, rest = self.base()
        a, n, d = x - whole, self.n, x.shape[1]
        far = int(np.abs(a).max(initial=0))
        if far * far * d >= 1 << 62 or far * n * d >= 1 << 62:
            a, rest = a.astype(object), rest.astype(object)
        squares, cross = (a * a).sum(axis=1), (a * rest).sum(axis=1)
        own = sum(int(r) ** 2 for r in rest.tolist())
        return [n * n * s - 2 * n * c + own for s, c in zip(squares.tolist(), cross.tolist())]


def _matrix(vectors: pa.Array, d: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _added(fit: DataFrame, d: int, per_batch: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the fit list of a matrix per batch: one partial matrix a partition,
    its rows added apart, so no task holds more than one matrix."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = per_batch(_matrix(batch.column(0), d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                  ["i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = v.values.to_numpy()
                held[i] = held[i] + row if i in held else row
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))],
                              ["i", "v"])

    rows = fit.mapInArrow(partial, _SUMS).repartition("i").mapInArrow(add, _SUMS).collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])


def _exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, sums per dimension) of the fit list, exact."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            for k in range(0, len(x), 8192):     # 2^13 entries below 2^47 add up within 64 bits
                total = [a + b for a, b in zip(total, x[k:k + 8192].sum(axis=0).tolist())]
        yield pa.record_batch([pa.array(range(d + 1), pa.int32()),
                               pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))], ["i", "s"])

    rows = fit.mapInArrow(partial, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    got = {r["i"]: int(r["s"]) for r in rows}
    return got[0], [got[i + 1] for i in range(d)]


def fit_model(fit: DataFrame, d: int, components: int = COMPONENTS) -> tuple[Model, float]:
    """(model, identity error) of a fit list: one column of distinct integer vectors of length d."""
    n, sums = _exact_sums(fit, d)
    model = Model(n, sums, np.empty(0), np.empty((d, 0)), 0.0)

    def products(x: np.ndarray) -> np.ndarray:
        c = model.centred(x)
        return c.T @ c

    cov = _added(fit, d, products) / n
    model.trace = float(np.trace(cov))
    if model.trace > 0:
        values, vectors = top_components(cov, min(components, d))
        keep = values > FLAT * model.trace
        model.values, model.vectors = values[keep], vectors[:, keep]
    k = len(model.values)
    if not k:
        return model, 0.0

    def check(x: np.ndarray) -> np.ndarray:
        y = model.whitened(x)
        return np.vstack([y.T @ y, y.sum(axis=0)])

    told = _added(fit, d, check) / n
    return model, float(np.abs(told[:k] - np.outer(told[k], told[k]) - np.eye(k)).max())


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row and component: vec_id, component (1 = largest), n, deviation, whitened, explained,
    identity_error."""
    as_double = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    good = F.forall("e", lambda c: F.coalesce(F.abs(c) < F.lit(LARGEST), F.lit(False)))
    # NaN counts as larger than any number, so the comparison drops it too
    rows = (df.select(F.col(id_col).alias("vec_id"), as_double.alias("e")).where(F.col("e").isNotNull() & good)
            .select("vec_id", F.transform("e", lambda c: F.floor(c * SCALE) + F.lit(SHIFT)).alias("x")))
    fit = written(rows.select("x").distinct().withColumn("d", F.size("x")), "whitening-fit")
    lengths = sorted(r["d"] for r in fit.select("d").distinct().collect() if r["d"])
    out = None
    for d in lengths:
        model, error = fit_model(fit.where(F.col("d") == d).select("x"), d, components)
        part = _apply(rows.where(F.size("x") == d), d, model, error)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else _apply(rows.limit(0), 1, Model(1, [0], np.empty(0), np.empty((1, 0)), 0.0), 0.0)


def _apply(rows: DataFrame, d: int, model: Model, error: float) -> DataFrame:
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, m = _matrix(part.column(1), d), part.num_rows
                spread = pa.array([Decimal(v) for v in model.deviation(x)], pa.decimal128(38, 0))
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.record_batch(
                    [part.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, model.n, np.int64)), spread.take(row), pa.array(model.whitened(x).ravel()),
                     pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {_OUT}")
