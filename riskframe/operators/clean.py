"""Filters, projections and recodes (B1-B13). All are column expressions:
they stay inside whole-stage codegen and need no shuffle, except B5 which is
a lookup join (broadcast behind a size check)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def null_count(cols: list[str]) -> Column:
    """Number of NULL cells among ``cols`` in a row."""
    return reduce(add, [F.col(c).isNull().cast("int") for c in cols])


def drop_rows_with_nulls(df: DataFrame, max_nulls: int, cols: list[str] | None = None) -> DataFrame:
    """B1: keep rows with at most ``max_nulls`` NULL cells (over all columns by default)."""
    cols = cols or df.columns
    return df.where(null_count(cols) <= F.lit(max_nulls))


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """B2: drop a column list (names absent from ``df`` are ignored)."""
    return df.drop(*[c for c in cols if c in df.columns])


def _map_literal(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def recode(df: DataFrame, col: str, mapping: dict, out: str | None = None) -> DataFrame:
    """Dictionary replace with pass-through of unmatched values (same type)."""
    return df.withColumn(out or col, F.coalesce(_map_literal(mapping)[F.col(col)], F.col(col)))


def recode_strict(df: DataFrame, col: str, mapping: dict, out: str | None = None) -> DataFrame:
    """Dictionary lookup that may change the type; unmapped values become NULL."""
    return df.withColumn(out or col, _map_literal(mapping)[F.col(col)])


def recode_label(df: DataFrame, col: str, mapping: dict, out: str = "y") -> DataFrame:
    """Text status -> integer class; rows with an unmapped status are filtered."""
    return recode_strict(df, col, mapping, out).where(F.col(out).isNotNull()).withColumn(
        out, F.col(out).cast("int"))


def group_codes(df: DataFrame, col: str, lookup: DataFrame | dict, out: str | None = None,
                code_col: str = "code", group_col: str = "group",
                max_broadcast_rows: int | None = None) -> DataFrame:
    """Many codes -> few groups by a lookup join.

    ``lookup`` is a ``{group: [codes]}`` dict (broadcast: its size is the
    dict's) or a (code, group) DataFrame (the planner broadcasts it when its
    size statistics allow; ``max_broadcast_rows`` forces a row-count check
    instead). Codes without a group keep their value (pass-through).
    """
    spark = df.sparkSession
    if isinstance(lookup, dict):
        rows = [(c, g) for g, codes in lookup.items() for c in codes]
        lk = F.broadcast(spark.createDataFrame(rows, "__code string, __group string"))
    else:
        lk = lookup.select(F.col(code_col).alias("__code"), F.col(group_col).alias("__group"))
        if max_broadcast_rows is not None:
            lk = broadcast_if_small(lk, max_broadcast_rows)
    out = out or col
    joined = df.join(lk, df[col] == lk["__code"], "left")
    return joined.withColumn(out, F.coalesce(F.col("__group"), F.col(col))).drop("__code", "__group")


def leading_int(col: str | Column) -> Column:
    """First run of digits in a text as int (``' 36 months'`` -> 36,
    ``'1-URGENT'`` -> 1); text without digits gives NULL (no ANSI cast error)."""
    c = F.col(col) if isinstance(col, str) else col
    digits = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(digits == "", F.lit(None)).otherwise(digits.try_cast("int"))


def replace_sentinel(df: DataFrame, col: str, value: float, replacement: float) -> DataFrame:
    """Exact sentinel value -> replacement."""
    c = F.col(col)
    return df.withColumn(col, F.when(c == F.lit(value), F.lit(replacement)).otherwise(c))


def clamp_lower(df: DataFrame, col: str, bound: float = 0.0) -> DataFrame:
    """Values below ``bound`` -> ``bound``; NULL stays NULL (unlike greatest)."""
    c = F.col(col)
    return df.withColumn(col, F.when(c < F.lit(bound), F.lit(bound)).otherwise(c))


def drop_category(df: DataFrame, col: str, value) -> DataFrame:
    """Drop rows whose ``col`` equals ``value``; NULL rows are kept."""
    return df.where(~F.col(col).eqNullSafe(F.lit(value)))


def label_onehot(df: DataFrame, y: str = "y", classes=(1, 2, 3), prefix: str = "Categ") -> DataFrame:
    """One 0/1 column per class."""
    return df.withColumns({f"{prefix}{k}": (F.col(y) == F.lit(k)).cast("int") for k in classes})


def argmax_label(prob: Column | str, base: int = 1) -> Column:
    """Row-wise argmax of a probability array; the first maximum wins."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return (F.array_position(p, F.array_max(p)) + F.lit(base - 1)).cast("int")
