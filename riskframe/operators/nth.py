"""Selection of the first rows of every class in hash order, without ranking.

The cut is the n-th smallest hash of a class, found by histogram refinement:
a counting pass over the leading 16 bits names the bucket that holds it, passes
over the next bits of that bucket's rows narrow it, and its last few hashes are
read. Passes read only (class, hash, key), persisted for them, and shuffle only counts.
The selection itself is a plain filter: no row is moved or sorted.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import hash_order, hash_prefix

#: strata whose cuts pass through the driver; more of them need ``rank.rank_by_hash``.
MAX_CLASSES = 1000
#: (hash, key) pairs of one bucket read at the end of the refinement.
FEW = 4096
BITS, STEP = 60, 16


def _is(label: str, value) -> Column:
    return F.col(label).eqNullSafe(F.lit(value))


def _bucket(left: int) -> Column:
    """The hash without its last ``left`` bits."""
    return F.shiftright(F.col("__h"), left)


def first_in_hash_order(df: DataFrame, label: str, key: str, seed: int | str, wanted: Column) -> Column:
    """A predicate on the rows of ``df``: true for the first ``wanted`` rows of their class in
    ``md5(seed|key)`` order. ``wanted`` is an expression over the label and ``_n``, the
    class size; NULL keeps none. The key identifies a row; rows that share one stay together."""
    hashed = hash_order(seed, key)
    narrow = (df.select(F.col(label), F.col(key), hashed.alias("__hex")).withColumn("__h", hash_prefix(F.col("__hex")))
              .persist(StorageLevel.MEMORY_AND_DISK))
    sizes = narrow.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).withColumn("want", F.coalesce(wanted, F.lit(0)))
    rows = sizes.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        narrow.unpersist()
        raise ValueError(f"more than {MAX_CLASSES} classes in {label}")
    chosen = F.lit(False)
    open_cuts = {}
    for r in rows:
        if r["want"] >= r["_n"]:
            chosen = chosen | _is(label, r[label])
        elif r["want"] > 0:
            open_cuts[r[label]] = (0, BITS, int(r["want"]))
    for value, cut in _refined(narrow, label, key, open_cuts).items():
        chosen = chosen | (_is(label, value) & _up_to(hashed, F.col(key), *cut))
    narrow.unpersist()
    return chosen


def _up_to(hashed: Column, key: Column, hex_cut: str, key_cut) -> Column:
    # a hex text orders as its number does
    return (hashed < hex_cut) | ((hashed == hex_cut) & (key <= F.lit(key_cut)))


def _refined(narrow: DataFrame, label: str, key: str, cuts: dict) -> dict:
    """Class -> (hash, key) of its last wanted row. ``cuts``: class -> (bucket, bits not
    yet looked at, wanted rows within the bucket)."""
    done: dict = {}
    while cuts:
        inside = F.lit(False)
        for value, (bucket, left, _) in cuts.items():
            inside = inside | (_is(label, value) & (_bucket(left) == bucket))
        left = next(iter(cuts.values()))[1]
        if left == 0:
            return done | _last(narrow.where(inside), label, key, cuts)
        left -= min(STEP, left)
        counts = narrow.where(inside).groupBy(label, _bucket(left).alias("b")).agg(F.count(F.lit(1)).alias("c"))
        upto = Window.partitionBy(label).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        want = F.lit(None).cast("long")
        for value, (_, _, n) in cuts.items():
            want = F.when(_is(label, value), F.lit(n)).otherwise(want)
        hit = (counts.withColumn("upto", F.sum("c").over(upto))
               .where((F.col("upto") >= want) & (F.col("upto") - F.col("c") < want)))
        found = {r[label]: (r["b"], left, cuts[r[label]][2] - (r["upto"] - r["c"]), r["c"]) for r in hit.collect()}
        # every class takes the same passes, so one filter serves all
        cuts = {v: f[:3] for v, f in found.items()}
        if all(f[3] <= FEW for f in found.values()):
            inside = F.lit(False)
            for value, (bucket, bits, _) in cuts.items():
                inside = inside | (_is(label, value) & (_bucket(bits) == bucket))
            return done | _last(narrow.where(inside), label, key, cuts)
    return done


def _last(rows: DataFrame, label: str, key: str, cuts: dict) -> dict:
    """The cut among the last few hashes; a repeated key is one row with its count."""
    got = rows.groupBy(label, "__hex", key).agg(F.count(F.lit(1)).alias("c")).collect()
    out: dict = {}
    for value, (_, _, n) in cuts.items():
        passed = 0
        for r in sorted((r for r in got if r[label] == value), key=lambda r: (r["__hex"], r[key])):
            out[value] = (r["__hex"], r[key])
            passed += r["c"]
            if passed >= n:
                break
    return out
