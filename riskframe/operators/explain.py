"""What-if analyses (J4-J8) as Spark jobs.

Linear models stay column expressions. Mean utilities are linear in the changed
feature, so averages over the rows give every grid step (J5, J7); predicted
classes are recomputed per row and step (J6).
Network models use ``mapInPandas`` forward/backward passes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..models.hybrid import HybridResult, forward, unpack
from ..models.linear import class_utilities
from ..models.mnl import softmax_rows
from ..models.sums import design_matrix, label_index, partition_sums


def grid_point(step: Column, lo: float, hi: float, n: int) -> Column:
    """lo + step·(hi − lo)/(n − 1)."""
    return F.lit(float(lo)) + step.cast("double") * F.lit((float(hi) - float(lo)) / (n - 1))


def _argmax(us: list[Column], classes: list[int]) -> Column:
    """First maximum of the utilities (same as argmax of the probabilities)."""
    out = F.lit(classes[-1])
    for i in range(len(us) - 2, -1, -1):
        cond = None
        for j in range(len(us)):
            if j == i:
                continue
            c = us[i] > us[j] if j < i else us[i] >= us[j]
            cond = c if cond is None else cond & c
        out = F.when(cond, F.lit(classes[i])).otherwise(out)
    return out


def _with_steps(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def share_elasticity(df: DataFrame, features: list[str], beta: dict, feature: str, lo: float = -0.3,
                     hi: float = 0.3, n: int = 100, classes=(1, 2, 3)) -> DataFrame:
    """Scale ``feature`` by (1 + point) for each grid point; change in the
    number of rows predicted in each class versus the unscaled prediction.
    Rows: (step, point, cls, change).

    Along the grid a row's utilities are straight lines, so a class is predicted on one run of
    steps whose ends follow from the pairwise crossings. A row gives an entry and an exit event
    per class with such a run; their counts per step, added along the grid, are the predictions."""
    classes = list(classes)
    slopes = _slopes(features, beta, feature, classes)
    zero = df.select(*[(F.lit(0.0) if f == feature else F.col(f)).alias(f"__x{i}") for i, f in enumerate(features)],
                     F.col(feature).alias("__x"), _argmax(class_utilities(features, beta, classes), classes).alias("__base"))
    us = class_utilities([f"__x{i}" for i in range(len(features))], beta, classes)
    lines = zero.where(F.col("__x").isNotNull()).select(
        "__base", *[u.alias(f"a{k}") for u, k in zip(us, classes)],
        *[(F.lit(slopes[k]) * F.col("__x")).alias(f"b{k}") for k in classes])
    delta = (hi - lo) / (n - 1) if n > 1 else 1.0
    first, stop = {}, {}
    for j, low in enumerate(classes):
        for k in classes[j + 1:]:
            # k beats the class before it where its line is strictly above: from or before a step
            rise = F.col(f"b{k}") - F.col(f"b{low}")
            at = (F.try_divide(F.col(f"a{low}") - F.col(f"a{k}"), rise) - F.lit(1.0 + lo)) / F.lit(delta)
            at = F.least(F.greatest(at, F.lit(-2.0)), F.lit(n + 1.0))
            up, down = F.floor(at) + 1, F.ceil(at)
            above = F.col(f"a{k}") > F.col(f"a{low}")
            first[k, low] = F.when(rise > 0, up).when(rise < 0, F.lit(0)).otherwise(F.when(above, F.lit(0)).otherwise(F.lit(n)))
            stop[k, low] = F.when(rise < 0, down).otherwise(F.lit(n))
            first[low, k] = F.when(rise < 0, down).when(rise > 0, F.lit(0)).otherwise(F.when(above, F.lit(n)).otherwise(F.lit(0)))
            stop[low, k] = F.when(rise > 0, up).otherwise(F.lit(n))
    others = {k: [j for j in classes if j != k] for k in classes}
    ends = lines.select("__base", *[F.greatest(F.lit(0), *[first[k, j] for j in others[k]]).alias(f"f{k}") for k in classes],
                        *[F.least(F.lit(n), *[stop[k, j] for j in others[k]]).alias(f"s{k}") for k in classes])
    events = F.array(
        F.struct(F.lit(-1).cast("long").alias("step"), F.col("__base").alias("cls"), F.lit(1).alias("d")),
        *[F.when(F.col(f"f{k}") < F.col(f"s{k}"), F.struct(F.col(x).cast("long").alias("step"), F.lit(k).alias("cls"), F.lit(d).alias("d")))
          for k in classes for x, d in ((f"f{k}", 1), (f"s{k}", -1))])
    counts = (ends.select(F.inline(F.array_compact(events))).groupBy("step", "cls").agg(F.sum("d").alias("d")))
    grid = df.sparkSession.range(n).select(F.col("id").alias("step"), F.explode(F.array(*map(F.lit, classes))).alias("cls"),
                                           F.lit(0).cast("long").alias("d"))
    along = Window.partitionBy("cls").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    base = F.coalesce(F.sum(F.when(F.col("step") < 0, F.col("d"))).over(Window.partitionBy("cls")), F.lit(0))
    inside = F.coalesce(F.sum(F.when(F.col("step") >= 0, F.col("d"))).over(along), F.lit(0))
    # (steps + 2) x classes cells from here on
    cells = counts.unionByName(grid).groupBy("step", "cls").agg(F.sum("d").alias("d"))
    told = cells.withColumn("change", inside - base).where(F.col("step").between(0, n - 1))
    return told.select(F.col("step").cast("int").alias("step"), grid_point(F.col("step"), lo, hi, n).alias("point"),
                       F.col("cls").cast("int").alias("cls"), "change")


def _steps_of(one_row: DataFrame, lo: float, hi: float, n: int, values: dict, out: str) -> DataFrame:
    """Grid steps on a one-row table; ``values`` maps a class to its value at a point."""
    d = _with_steps(one_row, n).withColumn("point", grid_point(F.col("step"), lo, hi, n))
    agg = d.select("step", "point", *[v(F.col("point")).alias(f"c{k}") for k, v in values.items()])
    return agg.unpivot(["step", "point"], list(agg.columns[2:]), "cls", out).withColumn(
        "cls", F.substring("cls", 2, 10).cast("int"))


def _slopes(features: list[str], beta, feature: str, classes: list[int]) -> dict[int, float]:
    """Coefficient of ``feature`` in the utility of every class (0 for the base)."""
    i = features.index(feature) + 1
    if isinstance(beta, np.ndarray):
        beta = dict(zip(classes[1:], beta))
    return {k: float(beta[k][i]) if k in beta else 0.0 for k in classes}


def utility_sensitivity(df: DataFrame, features: list[str], beta: dict, feature: str, lo: float = -0.3,
                        hi: float = 0.3, n: int = 100, classes=(1, 2, 3)) -> DataFrame:
    """Same grid; mean change of each class utility. Rows: (step, point, cls, mean_change).

    A linear utility changes by b·x·point, so one average gives every step."""
    slopes = _slopes(features, beta, feature, list(classes))
    mean = df.agg(F.avg(feature).alias("mean"))
    return _steps_of(mean, lo, hi, n, {k: lambda p, b=b: F.lit(b) * F.col("mean") * p for k, b in slopes.items()},
                     "mean_change")


def partial_dependence(df: DataFrame, features: list[str], beta: dict, feature: str, lo: float, hi: float,
                       n: int = 20, classes=(1, 2, 3)) -> DataFrame:
    """Set ``feature`` to each grid point; mean utility of each class.
    Rows: (step, point, cls, mean_utility). The utility is linear: the mean with the
    feature at zero plus b·point."""
    classes = list(classes)
    slopes = _slopes(features, beta, feature, classes)
    zero = df.select(*[(F.lit(0.0) if f == feature else F.col(f)).alias(f"__x{i}") for i, f in enumerate(features)])
    us = class_utilities([f"__x{i}" for i in range(len(features))], beta, classes)
    means = zero.agg(*[F.avg(u).alias(f"m{k}") for k, u in zip(classes, us)])
    return _steps_of(means, lo, hi, n, {k: lambda p, k=k, b=b: F.col(f"m{k}") + F.lit(b) * p for k, b in slopes.items()},
                     "mean_utility")


def network_what_if(df: DataFrame, result: HybridResult, feature: str, lo: float = -0.3, hi: float = 0.3,
                    n: int = 100) -> DataFrame:
    """J5-J7 on a fitted network (hybrid or dense), one job for all grid points.

    Rows: (step, point, cls, mean_change, mean_relative_change, share_change,
    mean_utility): ``feature`` times (1 + point) against the data as they are (mean change
    of the class's utility, mean of change / utility over rows whose utility is not
    zero, change in the number of rows predicted in the class), and the mean utility
    with the feature set to the point. Rows with a NULL input are left out."""
    spec, params = result.spec, result.params
    wide, deep, classes = spec.wide or [], list(spec.deep or []), list(spec.classes)
    k = len(classes)
    points = lo + np.arange(n) * (hi - lo) / (n - 1)
    cols = list(dict.fromkeys(wide + deep))

    def utilities(w: dict, pdf: pd.DataFrame, values: np.ndarray) -> np.ndarray:
        pdf = pdf.assign(**{feature: values})
        q = pdf[deep].to_numpy(dtype="float64") if deep else np.zeros((len(pdf), 0))
        return spec.forward(w, design_matrix(pdf, wide), q)[0]

    def fn(pdf: pd.DataFrame) -> np.ndarray:
        w, x = unpack(spec, params), pdf[feature].to_numpy(dtype="float64")
        old = utilities(w, pdf, x)
        picked = old.argmax(1)
        some = old != 0
        out = np.zeros((n, 5, k))
        for i, p in enumerate(points):
            new = utilities(w, pdf, x * (1 + p))
            change = new - old
            out[i, 0] = change.sum(0)
            out[i, 1] = np.divide(change, old, out=np.zeros_like(old), where=some).sum(0)
            out[i, 2] = some.sum(0)
            out[i, 3] = np.bincount(new.argmax(1), minlength=k) - np.bincount(picked, minlength=k)
            out[i, 4] = utilities(w, pdf, np.full(len(pdf), p)).sum(0)
        return np.concatenate([out.ravel(), [float(len(pdf))]])

    v = partition_sums(df.select(*cols).dropna(), fn, n * 5 * k + 1)
    rows, total = v[:-1].reshape(n, 5, k), v[-1]
    out = [(i, float(points[i]), int(c), float(rows[i, 0, j] / total),
            float(rows[i, 1, j] / rows[i, 2, j]) if rows[i, 2, j] else None, int(rows[i, 3, j]),
            float(rows[i, 4, j] / total)) for i in range(n) for j, c in enumerate(classes)] if total else []
    return df.sparkSession.createDataFrame(
        out, "step int, point double, cls int, mean_change double, mean_relative_change double, "
             "share_change long, mean_utility double")


def saliency(df: DataFrame, result: HybridResult, label: str = "y") -> DataFrame:
    """Gradient of the label class's utility w.r.t. every input, per row;
    aggregated as Σ|g| and mean g per (input, target class)."""
    spec = result.spec
    wide, deep, classes = spec.wide or [], spec.deep, spec.classes
    params = result.params
    inputs = wide + deep

    def fn(it):
        w = unpack(spec, params)
        for pdf in it:
            x = design_matrix(pdf, wide)
            q = pdf[deep].to_numpy(dtype="float64") if deep else np.zeros((len(pdf), 0))
            yi = label_index(pdf, label, classes)
            n = len(pdf)
            du = np.zeros((n, len(classes)))
            du[np.arange(n), yi] = 1.0
            gx = du[:, 1:] @ w["beta"][:, 1:] if ("beta" in w and wide) else np.zeros((n, len(wide)))
            if deep:
                u, cache = forward(spec, w, x, q)
                dh = du @ w["w2"].T
                layers = [("w1", "b1")] + [(f"wh{i}", f"bh{i}") for i in range(spec.layers - 1)]
                for li in range(len(layers) - 1, -1, -1):
                    wn, _ = layers[li]
                    _, pre = cache["acts"][li]
                    dpre = dh * (pre > 0)
                    dh = dpre @ w[wn].T
                gq = dh
            else:
                gq = np.zeros((n, 0))
            g = np.hstack([gx, gq])
            rows = pd.DataFrame({"target": np.repeat(np.asarray(classes)[yi], len(inputs)),
                                 "input": np.tile(np.asarray(inputs, dtype=object), n),
                                 "g": g.ravel()})
            yield rows
    cols = list(dict.fromkeys([label] + inputs))
    long = df.select(*cols).dropna().mapInPandas(fn, "target int, input string, g double")
    return long.groupBy("input", "target").agg(F.sum(F.abs("g")).alias("sum_abs"), F.avg("g").alias("mean"),
                                               F.count(F.lit(1)).alias("n"))


def counterfactual_inputs(df: DataFrame, result: HybridResult, target: int, steps: int = 10,
                          rate: float = 0.1, keep: list[str] | None = None) -> DataFrame:
    """J8 (re-aimed as a per-row batch job): for each row, ``steps`` gradient
    steps on the network inputs Q that raise log P(target); returns the moved
    inputs and the target probability before and after."""
    spec = result.spec
    wide, deep, classes = spec.wide or [], spec.deep, spec.classes
    params = result.params
    keep = keep or []
    ti = classes.index(target)
    out_cols = [f"{c}_new" for c in deep]

    def fn(it):
        w = unpack(spec, params)
        for pdf in it:
            x = design_matrix(pdf, wide)
            q = pdf[deep].to_numpy(dtype="float64").copy()
            u, _ = forward(spec, w, x, q)
            p0 = softmax_rows(u)[:, ti]
            for _ in range(steps):
                u, cache = forward(spec, w, x, q)
                pr = softmax_rows(u)
                du = -pr
                du[:, ti] += 1.0       # ∂ log p_target / ∂u
                dh = du @ w["w2"].T
                layers = [("w1", "b1")] + [(f"wh{i}", f"bh{i}") for i in range(spec.layers - 1)]
                for li in range(len(layers) - 1, -1, -1):
                    wn, _ = layers[li]
                    _, pre = cache["acts"][li]
                    dh = (dh * (pre > 0)) @ w[wn].T
                q = q + rate * dh
            u, _ = forward(spec, w, x, q)
            out = pdf[keep].copy()
            for i, c in enumerate(out_cols):
                out[c] = q[:, i]
            out["p_before"] = p0
            out["p_after"] = softmax_rows(u)[:, ti]
            yield out
    tmap = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {tmap[c]}" for c in keep] + [f"`{c}` double" for c in out_cols] +
                       ["p_before double", "p_after double"])
    cols = list(dict.fromkeys(keep + wide + deep))
    return df.select(*cols).dropna().mapInPandas(fn, schema)
