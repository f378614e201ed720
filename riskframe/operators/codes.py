"""D3/D4 for dictionaries of any size: sorted codes as a table, joined to the rows.

The distinct values of all columns are range-partitioned by sampled split points, sorted
within their ranges and written once; a value's code is its place in its range plus the
lengths of the ranges before it. The driver holds one number per range and column.
Small dictionaries may stay literal maps (``prep.ordinal_exprs``); the codes are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_ROW = (1 << 33) - 1     # monotonically_increasing_id: the partition above, the row below 33 bits


def sorted_codes(train: DataFrame, cols: list[str], partitions: int | None = None) -> DataFrame:
    """(feature, value, code): the 0-based place of each non-NULL value in its column's sorted order."""
    long_df = train.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "feature", "value")
    distinct = long_df.where(F.col("value").isNotNull()).distinct()
    ranged = distinct.repartitionByRange(*([partitions] if partitions else []), "feature", "value")
    # written once: sampled split points may differ between two runs of the same plan
    placed = cut_lineage(ranged.sortWithinPartitions("feature", "value").withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.select("feature", "value", F.shiftright("__id", 33).alias("__range"),
                           F.col("__id").bitwiseAND(F.lit(_ROW)).alias("__row"))
    # rows of one column within a range follow each other; ranges are in order
    ranges = placed.groupBy("feature", "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = Window.partitionBy("feature").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("feature", "__range", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (placed.join(offsets, ["feature", "__range"])
            .select("feature", "value", (F.col("__row") - F.col("__first") + F.col("__before")).alias("code")))


def encode_ordinal(df: DataFrame, codes: DataFrame, cols: list[str]) -> DataFrame:
    """Each column replaced by its code (double); NULL stays NULL, a value without code raises.
    Joins are sized at run time: small dictionaries are broadcast, hot values split."""
    for c in cols:
        own = codes.where(F.col("feature") == c).select(F.col("value").alias("__value"), F.col("code").alias("__code"))
        df = df.withColumn("__key", F.col(c).cast("string")).join(own, F.col("__key") == F.col("__value"), "left")
        unseen = F.col("__key").isNotNull() & F.col("__code").isNull()
        df = df.withColumn(c, F.when(unseen, F.raise_error(F.concat(F.lit(f"unseen value in {c}: "), F.col("__key"))).cast("double"))
                           .otherwise(F.col("__code").cast("double"))).drop("__key", "__value", "__code")
    return df


def one_hot_sparse(df: DataFrame, codes: DataFrame, cols: list[str], out: str = "one_hot") -> DataFrame:
    """``out``: the ascending places of the ones in the joined one-hot vector of all columns (the
    columns after each other, each in its sorted order); a NULL gives none."""
    sizes = {r["feature"]: r["n"] for r in codes.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    named = {c: f"__c{i}" for i, c in enumerate(cols)}
    coded = encode_ordinal(df.withColumns({n: F.col(c) for c, n in named.items()}),
                           codes.replace(named, subset=["feature"]), list(named.values()))
    base, places = 0, []
    for c, n in named.items():
        places.append(F.col(n).cast("long") + F.lit(base))
        base += sizes.get(c, 0)
    return coded.withColumn(out, F.array_compact(F.array(*places))).drop(*named.values())
