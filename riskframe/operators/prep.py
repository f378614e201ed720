"""Impute, encode, scale (D1-D10): fit on the training part, apply anywhere.

A fitted step is a small plain dict (medians, category lists, min/max); applying
it is one ``select`` of column expressions, so the same spec scores train,
test, folds or a stream without another pass over the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import exact_median, to_long

MAX_CATEGORIES = 10_000


# ---------------------------------------------------------------- D1 / D2
def fit_medians(train: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """D1 fit: exact median of the non-NULL training values of each column
    (one distributed rank pass for all columns)."""
    if not cols:
        return {}
    long_df = to_long(train, cols, [], "feature", "value")
    rows = exact_median(long_df, ["feature"], "value").collect()  # one row per column
    med = {r["feature"]: r["median"] for r in rows}
    return {c: med.get(c) for c in cols}


def impute(df: DataFrame, fills: dict[str, float | None]) -> DataFrame:
    """D1/D2 apply: NULL -> fitted value (median, or a constant such as 0)."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast("double"))
                           for c, v in fills.items() if v is not None})


# ---------------------------------------------------------------- D3 / D4
def fit_categories(train: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted distinct non-NULL values of each categorical column (one job;
    the driver receives at most ``MAX_CATEGORIES`` values per column)."""
    if not cols:
        return {}
    long_df = train.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "feature", "value").where(F.col("value").isNotNull()).distinct()
    rows = long_df.limit(MAX_CATEGORIES * len(cols) + 1).collect()
    if len(rows) > MAX_CATEGORIES * len(cols):
        raise ValueError("fit_categories: too many distinct values for a categorical encoding")
    cats: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        cats[r["feature"]].append(r["value"])
    return {c: sorted(v) for c, v in cats.items()}


def ordinal_exprs(categories: dict[str, list[str]]) -> dict[str, Column]:
    """D3 apply: category -> 0-based position in sorted order; an unseen value
    raises (as the reference's encoder does); NULL stays NULL."""
    out = {}
    for c, cats in categories.items():
        m = F.create_map(*[x for i, v in enumerate(cats) for x in (F.lit(v), F.lit(float(i)))])
        idx = m[F.col(c).cast("string")]
        out[c] = F.when(F.col(c).isNotNull() & idx.isNull(),
                        F.raise_error(F.concat(F.lit(f"unseen category in {c}: "), F.col(c).cast("string")))
                        .cast("double")).otherwise(idx)
    return out


def onehot_names(categories: dict[str, list[str]]) -> dict[str, list[tuple[str, str]]]:
    """Output columns ``col_value``; a two-valued column keeps only its second value."""
    out = {}
    for c, cats in categories.items():
        kept = cats[1:] if len(cats) == 2 else cats
        out[c] = [(f"{c}_{v}", v) for v in kept]
    return out


def onehot_exprs(categories: dict[str, list[str]]) -> dict[str, Column]:
    """D4 apply: 0/1 indicator columns; NULL gives all zeros; unseen values raise."""
    out = {}
    for c, pairs in onehot_names(categories).items():
        seen = F.col(c).cast("string").isin(categories[c])
        guard = F.when(F.col(c).isNotNull() & ~seen,
                       F.raise_error(F.concat(F.lit(f"unseen category in {c}: "), F.col(c).cast("string"))))
        for name, v in pairs:
            out[name] = F.coalesce(guard.cast("double"),
                                   F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("double"), F.lit(0.0)))
    return out


# ---------------------------------------------------------------- D5
def fit_transformer(train: DataFrame, median_cols: list[str], ordinal_cols: list[str],
                    onehot_cols: list[str], passthrough: list[str]) -> dict:
    """Fitted column-wise transformer. Output order as the reference's:
    imputed, ordinal, one-hot, pass-through."""
    return {
        "medians": fit_medians(train, median_cols),
        "ordinal": fit_categories(train, ordinal_cols),
        "onehot": fit_categories(train, onehot_cols),
        "passthrough": list(passthrough),
    }


def output_columns(spec: dict) -> list[str]:
    names = list(spec["medians"]) + list(spec["ordinal"])
    for pairs in onehot_names(spec["onehot"]).values():
        names += [n for n, _ in pairs]
    return names + spec["passthrough"]


def apply_transformer(df: DataFrame, spec: dict, keep: list[str]) -> DataFrame:
    """D5 apply: one ``select``; ``keep`` are carried columns (key, label, split...)."""
    exprs: list[Column] = []
    for c, v in spec["medians"].items():
        exprs.append(F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double")).alias(c))
    exprs += [e.alias(n) for n, e in ordinal_exprs(spec["ordinal"]).items()]
    exprs += [e.alias(n) for n, e in onehot_exprs(spec["onehot"]).items()]
    exprs += [F.col(c).cast("double").alias(c) for c in spec["passthrough"]]
    return df.select(*[F.col(k) for k in keep], *exprs)


# ---------------------------------------------------------------- D6 / D7
def fit_minmax(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """D6 fit: min and max of each column in one aggregation."""
    if not cols:
        return {}
    r = train.agg(*[F.min(c).alias(f"min{i}") for i, c in enumerate(cols)],
                  *[F.max(c).alias(f"max{i}") for i, c in enumerate(cols)]).first()
    return {c: (r[f"min{i}"], r[f"max{i}"]) for i, c in enumerate(cols)}


def minmax_exprs(ranges: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """D6 apply: (x - min) / (max - min); a constant column divides by 1 (so it
    scales to 0 on the training part). Test rows may leave [0, 1]."""
    out = {}
    for c, (lo, hi) in ranges.items():
        if lo is None or hi is None:
            out[c] = F.col(c)
            continue
        rng = float(hi) - float(lo)
        out[c] = (F.col(c) - F.lit(float(lo))) / F.lit(rng if rng != 0 else 1.0)
    return out


def fixed_scale_exprs(factors: dict[str, float]) -> dict[str, Column]:
    """Multiply named columns by fixed factors."""
    return {c: F.col(c) * F.lit(float(f)) for c, f in factors.items()}


def fit_scaler(train: DataFrame, feature_cols: list[str], fixed: dict[str, float]) -> dict:
    return {"minmax": fit_minmax(train, [c for c in feature_cols if c not in fixed]),
            "fixed": {c: f for c, f in fixed.items() if c in feature_cols}}


def apply_scaler(df: DataFrame, spec: dict) -> DataFrame:
    return df.withColumns({**minmax_exprs(spec["minmax"]), **fixed_scale_exprs(spec["fixed"])})


# ---------------------------------------------------------------- D8 / D9 / D10
def null_report(df: DataFrame, cols: list[str] | None = None, group_col: str | None = None) -> DataFrame:
    """NULL count per column (long: column, nulls), in one aggregation."""
    cols = cols or [c for c in df.columns if c != group_col]
    gb = [group_col] if group_col else []
    wide = df.groupBy(*gb).agg(*[(F.count(F.lit(1)) - F.count(F.col(c))).alias(c) for c in cols])
    return wide.unpivot(gb, cols, "column", "nulls")


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row count per value combination."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, stddev, min, quartiles, max (Spark's summary)."""
    return df.select(*(cols or df.columns)).summary()
