"""Choice-design reshaping.

The reference stores, per loan, a (2(p+1)) × 3 block that is mostly zeros
(alternative 1 is the base; alternatives 2 and 3 carry an intercept and each
variable in their own rows). Here the design stays implicit (wide columns +
base class); :func:`choice_long` materialises the explicit long form only
for inspection or for fitters that take alternative-specific rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class ModelSpec:
    """column roles of a hybrid model (wide: linear β, deep: network input)."""
    name: str
    wide: list[str]
    deep: list[str]

    def n_beta(self, classes: int = 3) -> int:
        return (len(self.wide) + 1) * (classes - 1)


def design_terms(wide: list[str], classes=(1, 2, 3)) -> list[tuple[str, int, str | None]]:
    """β terms in the reference's order: ASC of each non-base alternative, then
    each variable interleaved over the non-base alternatives."""
    others = list(classes)[1:]
    terms = [(f"ASC_{k}", k, None) for k in others]
    for c in wide:
        terms += [(f"{c}_{k}", k, c) for k in others]
    return terms


def choice_long(df: DataFrame, key: str, label: str, wide: list[str], classes=(1, 2, 3)) -> DataFrame:
    """F1 explicit long form: one row per (key, alternative, nonzero design
    term) with the chosen flag: (key, alt, chosen, term, value). The base alternative,
    whose terms are all zero, has one row with term 'BASE' and value 0."""
    classes = list(classes)
    entries = [F.struct(F.lit(classes[0]).alias("alt"), F.lit("BASE").alias("term"), F.lit(0.0).alias("value"))]
    for term, alt, col in design_terms(wide, classes):
        entries.append(F.struct(F.lit(alt).alias("alt"), F.lit(term).alias("term"),
                                (F.lit(1.0) if col is None else F.col(col).cast("double")).alias("value")))
    d = df.select(key, label, F.explode(F.array(*entries)).alias("e"))
    return d.select(key, F.col("e.alt").alias("alt"), (F.col(label) == F.col("e.alt")).cast("int").alias("chosen"),
                    F.col("e.term").alias("term"), F.col("e.value").alias("value"))


def bind_by_key(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """column bind of two tables of the same rows by a key (never by position)."""
    return left.join(right, on=key, how=how)
