"""Kendall τ-b between all pairs of columns (E4), exact, without a pair join.

A row travels once per column, not once per pair of columns:

1. Equal rows are combined and carry their count. Quantiles of every column cut its
   values into ordered buckets: a cut value is a bucket of its own (odd number), the
   values between two cuts are one (even number).
2. Every row goes once per column to the task of (column, bucket), with all its
   values. For a column c the task counts, against every other column,

   * as x: the pairs of rows inside the bucket, and the bucket's cells (bucket of x,
     bucket of y);
   * as y: the pairs inside the bucket that differ in the bucket of x;
   * the tie terms of the values of c.

   A bucket of one value has no pairs to count, so its rows are dealt over as many
   tasks as its share of the rows asks for.
3. Pairs that differ in both buckets are counted on the cells: stripes of buckets of
   x meet the sums of all earlier stripes by bucket of y.

The cuts only balance the work. There are at most √n / 4 of them per column (driver and
tasks hold them), so a task of step 2 has some 4·√n rows or ``rows_per_task``,
whichever is larger, and a stripe of step 3 some (√n / 2)^1.5 cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_PAIRS, _TIES, _CELL, _HOT = range(4)
_FOUND = "kind int, i int, j int, bx int, by int, a double, b double, c double, d double, n double"


def merge_counts(order: np.ndarray, idx: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Σ w_r w_s over s with a smaller order and a smaller (larger) idx than r; ties
    count in neither. One sort and binary searches per block size, no loop over rows."""
    n = len(order)
    if n < 2:
        return 0.0, 0.0
    by = np.lexsort((idx, order))
    order, idx, w = order[by], idx[by].astype(np.int64), w[by].astype("float64")
    # equal orders must not meet: the left part of a row is the rows of smaller order
    first = np.searchsorted(order, order, side="left")
    top = int(idx.max()) + 1
    lower = upper = 0.0
    size = 1
    pos = np.arange(n)
    while size < n:
        # blocks of ``size`` rows sorted by idx; the prefix [0, first) of a row is made of
        # one block for every binary digit of ``first``
        block = pos // size
        key = block * top + idx
        srt = np.argsort(key, kind="stable")
        cum = np.concatenate([[0.0], np.cumsum(w[srt])])
        ks = key[srt]
        use = (first // size) % 2 == 1
        b = first[use] // size - 1
        lo = np.searchsorted(ks, b * top, side="left")
        lt = np.searchsorted(ks, b * top + idx[use], side="left")
        le = np.searchsorted(ks, b * top + idx[use], side="right")
        hi = np.searchsorted(ks, (b + 1) * top, side="left")
        lower += float((w[use] * (cum[lt] - cum[lo])).sum())
        upper += float((w[use] * (cum[hi] - cum[le])).sum())
        size *= 2
    return lower, upper


def _codes(v: np.ndarray) -> np.ndarray:
    return np.unique(v, return_inverse=True)[1]


def _bucket(v: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Ordered buckets: odd for a value that is a cut, even between cuts; NaN, which is
    larger than all numbers, has the last odd one."""
    b = np.searchsorted(cuts, v, "left") + np.searchsorted(cuts, v, "right")
    return np.where(np.isnan(v), 2 * len(cuts) + 1, b).astype(np.int32)


def _column(table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column and which of them are there."""
    col = table.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.fill_null(0.0).to_numpy(zero_copy_only=False), ~col.is_null().to_numpy(zero_copy_only=False)


def _deal(cuts: list[np.ndarray], shares: list[np.ndarray], buckets: int):
    """Every row once per column: (col, bucket, part) and the row. ``shares`` has the tasks of
    every cut value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().astype(np.uint64)
            for c, own in enumerate(cuts):
                v, there = _column(batch, f"v{c}")
                b = _bucket(v, own)
                tasks = np.concatenate([shares[c], [buckets]])[np.minimum(b // 2, len(own))]
                part = np.where(b % 2 == 1, h % tasks.astype(np.uint64), 0).astype(np.int32)
                out = pa.record_batch([pa.array(np.full(len(v), c, np.int32)), pa.array(b), pa.array(part),
                                       *batch.columns[1:]], ["col", "bucket", "part", *batch.schema.names[1:]])
                yield out.filter(pa.array(there))
    return run


def _count(cuts: list[np.ndarray]):
    def run(table: pa.Table) -> pa.Table:
        c, b = table.column("col")[0].as_py(), table.column("bucket")[0].as_py()
        single = b % 2 == 1
        w = table.column("w").to_numpy().astype(np.float64)
        own = _codes(_column(table, f"v{c}")[0])
        rows: list[tuple] = []
        for o, other_cuts in enumerate(cuts):
            if o == c:
                continue
            v, there = _column(table, f"v{o}")
            v, x, wt = v[there], own[there], w[there]
            if not len(v):
                continue
            at = _bucket(v, other_cuts)
            if single:
                rows.append((_HOT, c, o, b, 0, 0.0, 0.0, 0.0, 0.0, wt.sum()))
            else:
                t = np.bincount(x, wt)
                rows.append((_TIES, c, o, b, 0, (t * (t - 1) / 2).sum(), (t * (t - 1) * (2 * t + 5)).sum(),
                             (t * (t - 1)).sum(), (t * (t - 1) * (t - 2)).sum(), t.sum()))
            if o < c:
                cell = np.bincount(_codes(at), wt)
                rows += [(_CELL, c, o, b, int(y), 0.0, 0.0, 0.0, 0.0, n) for y, n in zip(np.unique(at), cell)]
            if not single:
                i, j = max(c, o), min(c, o)
                pairs = merge_counts(x, _codes(v), wt) if o < c else merge_counts(x, _codes(at), wt)
                rows.append((_PAIRS, i, j, b, 0, *pairs, 0.0, 0.0, 0.0))
        types = [pa.int32()] * 5 + [pa.float64()] * 5
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 10, types)],
                        ["kind", "i", "j", "bx", "by", "a", "b", "c", "d", "n"])
    return run


def _stripe(cells: pa.Table, earlier: pa.Table) -> pa.Table:
    names, types = ["i", "j", "a", "b"], [pa.int32(), pa.int32(), pa.float64(), pa.float64()]
    if not cells.num_rows:
        return pa.table([pa.array([], t) for t in types], names)
    bx, by, w = (cells.column(x).to_numpy() for x in ("bx", "by", "n"))
    lower, upper = merge_counts(bx, by, w)
    if earlier.num_rows:
        keys = earlier.column("ey").to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, cum = keys[order], np.concatenate([[0.0], np.cumsum(earlier.column("en").to_numpy()[order])])
        lower += float((w * cum[np.searchsorted(keys, by, "left")]).sum())
        upper += float((w * (cum[-1] - cum[np.searchsorted(keys, by, "right")])).sum())
    values = (cells.column("i")[0].as_py(), cells.column("j")[0].as_py(), lower, upper)
    return pa.table([pa.array([v], t) for v, t in zip(values, types)], names)


def cell_pairs(cells: DataFrame, top: int) -> DataFrame:
    """(i, j, a, b): concordant and discordant pairs of the rows of different bx and by;
    ``cells`` has one row (i, j, bx, by, n) per cell, bx is at most ``top``."""
    width = max(1, math.isqrt(top))
    cells = cells.withColumn("stripe", F.floor(F.col("bx") / F.lit(width)).cast("int"))
    sums = cells.groupBy("i", "j", "stripe", "by").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("i", "j", "by").orderBy("stripe")
    # a running sum holds up to the next stripe that has cells there
    upto = F.coalesce(F.lead("stripe").over(w), F.lit(top // width))
    earlier = (sums.select("i", "j", "by", "stripe", F.sum("n").over(w).alias("n"), upto.alias("upto"))
               .where("upto > stripe")
               .select(F.col("i").alias("ei"), F.col("j").alias("ej"), F.col("by").alias("ey"), F.col("n").alias("en"),
                       F.explode(F.sequence(F.col("stripe") + 1, F.col("upto"))).alias("es")))
    return (cells.groupBy("i", "j", "stripe").cogroup(earlier.groupBy("ei", "ej", "es"))
            .applyInArrow(_stripe, "i int, j int, a double, b double"))


def kendall_pairs(df: DataFrame, cols: list[str], key: str = "", rows_per_task: int = 50_000) -> DataFrame:
    """τ-b and z for every column pair (i > j) over the rows that have both values; z
    takes the ties into account. Pairs without a common row have no row; τ is NULL where a
    column is constant, z also below three rows. NaN counts as the largest value."""
    p = len(cols)
    rows = cut_lineage(df.select(*[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(cols)])
                       .groupBy(*[f"v{k}" for k in range(p)]).agg(F.count(F.lit(1)).alias("w")))
    m = rows.count()
    buckets = max(1, min(math.ceil(m / rows_per_task), math.isqrt(m) // 4))
    found = rows.approxQuantile([f"v{k}" for k in range(p)], [k / buckets for k in range(1, buckets)],
                                1 / (4 * buckets)) if buckets > 1 else [[]] * p
    cuts, shares = [], []
    for f in found:
        values, times = np.unique(np.array(f, "float64"), return_counts=True)
        cuts.append(values)
        shares.append(times + 1)
    hashed = rows.select(F.xxhash64(*[f"v{k}" for k in range(p)], "w").alias("h"), "w", *[f"v{k}" for k in range(p)])
    dealt = hashed.mapInArrow(_deal(cuts, shares, buckets), "col int, bucket int, part int, w long, "
                              + ", ".join(f"v{k} double" for k in range(p)))
    out = cut_lineage(dealt.groupBy("col", "bucket", "part").applyInArrow(_count(cuts), _FOUND))

    cells = out.where(F.col("kind") == _CELL).groupBy("i", "j", "bx", "by").agg(F.sum("n").alias("n"))
    counted = out.where(F.col("kind") == _PAIRS).select("i", "j", "a", "b")
    pairs = (counted.unionByName(cell_pairs(cells, 2 * buckets)).groupBy("i", "j")
             .agg(F.sum("a").alias("C"), F.sum("b").alias("D")))
    t = F.col("n")
    hot = (out.where(F.col("kind") == _HOT).groupBy("i", "j", "bx").agg(F.sum("n").alias("n"))
           .select("i", "j", (t * (t - 1) / 2).alias("a"), (t * (t - 1) * (2 * t + 5)).alias("b"),
                   (t * (t - 1)).alias("c"), (t * (t - 1) * (t - 2)).alias("d"), "n"))
    ties = (out.where(F.col("kind") == _TIES).select("i", "j", "a", "b", "c", "d", "n").unionByName(hot)
            .groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in "abcdn"]))
    x = ties.where("i > j").select("i", "j", *[F.col(k).alias(f"x{k}") for k in "abcd"], "n")
    y = ties.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), *[F.col(k).alias(f"y{k}") for k in "abcd"])
    every = x.join(y, ["i", "j"]).join(pairs, ["i", "j"], "left").na.fill(0.0, ["C", "D"])
    n, s = F.col("n"), F.col("C") - F.col("D")
    n0 = n * (n - 1) / 2
    tau = F.try_divide(s, F.sqrt((n0 - F.col("xa")) * (n0 - F.col("ya"))))
    var = ((n * (n - 1) * (2 * n + 5) - F.col("xb") - F.col("yb")) / 18
           + F.try_divide(F.col("xc") * F.col("yc"), 2 * n * (n - 1))
           + F.try_divide(F.col("xd") * F.col("yd"), 9 * n * (n - 1) * (n - 2)))
    name = F.array(*[F.lit(c) for c in cols])
    return every.select(name[F.col("i")].alias("col_i"), name[F.col("j")].alias("col_j"), n.cast("long").alias("n"),
                        tau.alias("tau_b"), F.when(var > 0, s / F.sqrt(var)).alias("z"))
