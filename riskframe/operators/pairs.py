"""I2 for all pairs of models in one pass: sums of outer products.

With c_m(v) the rows of model m at value v and B_m(v) its rows below v, the
rank-sum statistic of a pair is W_ab = Σ_v c_a(v) (B_b(v) + c_b(v) / 2), and the tie
term Σ_v t³ − t with t = c_a + c_b follows from Σ c³ and Σ c_a² c_b. So one table of
(value, model, count), cut into runs of values by distributed ranks, gives the
statistics of every pair: a run adds outer products over its own values, and the rows
below it enter as its offset, one number per run and model. Each row is shuffled to its
value and to its run; the number of models multiplies nothing but the M x M results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rank import value_prefix

MAX_MODELS = 500
#: distinct values of one run, and those held as dense rows at a time.
RUN, CHUNK = 1 << 20, 1 << 12


def _run_sums(value: np.ndarray, model: np.ndarray, count: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
    """(rows per model, W within the run, Σ c_a² c_b) of rows sorted by value."""
    total, within, tied = np.zeros(m), np.zeros((m, m)), np.zeros((m, m))
    starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.empty(0, np.int64)
    for k in range(0, len(starts), CHUNK):
        a, b = starts[k], starts[k + CHUNK] if k + CHUNK < len(starts) else len(value)
        row = np.searchsorted(starts[k:k + CHUNK], np.arange(a, b), side="right") - 1
        dense = np.zeros((min(CHUNK, len(starts) - k), m))
        dense[row, model[a:b]] = count[a:b]
        below = np.cumsum(dense, axis=0) - dense + total
        within += dense.T @ (below + dense / 2)
        tied += (dense * dense).T @ dense
        total += dense.sum(axis=0)
    return total, within, tied


def pair_sums(df: DataFrame, group: str, value: str, models: list[str], run: int = RUN) -> tuple[np.ndarray, ...]:
    """(rows per model, W, Σ c_a² c_b) over all rows; NULL values take no part.
    The driver receives M x M numbers."""
    m = len(models)
    number = F.create_map(*[x for i, name in enumerate(models) for x in (F.lit(name), F.lit(i))])
    rows = (df.select(number[F.col(group).cast("string")].alias("model"), F.col(value).cast("double").alias("v"))
            .where(F.col("v").isNotNull() & F.col("model").isNotNull()).groupBy("v", "model").agg(F.count(F.lit(1)).alias("c")))
    # a row per value: its models and their counts
    values = rows.groupBy("v").agg(F.collect_list(F.struct("model", "c")).alias("held")).withColumns(
        {"all": F.lit(0), "one": F.lit(1)})
    placed = value_prefix(values, ["all"], "v", "one").withColumn("run", F.floor(F.col("below") / F.lit(run)))
    flat = placed.select("run", "v", F.inline("held"))

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("v").to_numpy(), kind="stable")
        v, own, c = (table.column(n).to_numpy()[order] for n in ("v", "model", "c"))
        total, within, tied = _run_sums(v, own, c.astype("float64"), m)
        return pa.table({"run": pa.array([table.column("run")[0].as_py()], pa.int64()),
                         "total": pa.array([total], pa.list_(pa.float64())),
                         "within": pa.array([within.ravel()], pa.list_(pa.float64())),
                         "tied": pa.array([tied.ravel()], pa.list_(pa.float64()))})

    runs = flat.groupBy("run").applyInArrow(add, "run long, total array<double>, within array<double>, tied array<double>").persist()
    # rows per model below each run, then the runs' outer products added cell by cell
    before = Window.partitionBy("model").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.select("run", F.posexplode("total").alias("model", "c"))
    offsets = totals.withColumn("o", F.coalesce(F.sum("c").over(before), F.lit(0.0)))
    vectors = offsets.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("model", "o"))), lambda s: s["o"]).alias("o"))

    def fold(batches):
        out = [np.zeros(m), np.zeros((m, m)), np.zeros((m, m))]
        for batch in batches:
            for r in batch.to_pylist():
                own = np.array(r["total"])
                out[0] += own
                out[1] += np.array(r["within"]).reshape(m, m) + np.outer(own, r["o"])
                out[2] += np.array(r["tied"]).reshape(m, m)
        yield pa.record_batch([pa.array([np.concatenate([x.ravel() for x in out])], pa.list_(pa.float64()))], ["s"])

    joined = runs.join(vectors, "run").select("total", "within", "tied", "o")
    # partial sums a partition, then a row per cell: no task adds more than its cells
    cells = joined.mapInArrow(fold, "s array<double>").select(F.posexplode("s").alias("i", "x"))
    got = np.zeros(m + 2 * m * m)
    for r in cells.groupBy("i").agg(F.sum("x").alias("x")).collect():
        got[r["i"]] = r["x"]
    runs.unpersist()
    return got[:m], got[m:m + m * m].reshape(m, m), got[m + m * m:].reshape(m, m)


def all_pairs(df: DataFrame, group: str, value: str) -> DataFrame:
    """For each pair a < b: model_a, model_b, w (of a), n_a, n_b, tie_sum."""
    spark = df.sparkSession
    models = sorted(r[0] for r in df.select(F.col(group).cast("string")).where(F.col(group).isNotNull()).distinct()
                    .limit(MAX_MODELS + 1).collect())
    if len(models) > MAX_MODELS:
        raise ValueError(f"rank sums: more than {MAX_MODELS} groups")
    n, w, tied = pair_sums(df, group, value, models) if models else (np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)))
    rows = []
    for i, a in enumerate(models):
        for j in range(i + 1, len(models)):
            # Σ (c_a + c_b)³ − (c_a + c_b)
            cubes = tied[i, i] + tied[j, j] + 3 * (tied[i, j] + tied[j, i])
            rows.append((a, models[j], float(w[i, j]), float(n[i]), float(n[j]), float(cubes - n[i] - n[j])))
    return spark.createDataFrame(rows, "model_a string, model_b string, w double, n_a double, n_b double, tie_sum double")
