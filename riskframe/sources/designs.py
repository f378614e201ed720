"""A5: prepared designs as named tables, bucketed and sorted by the key.

``save_design`` writes the scaled table with its fold column once, dealt by the hash of
the key into as many buckets as the trainer has shards, and a manifest row with the column roles,
the scaler, the shard count and a version. ``load_design`` gives the batch trainer the buckets as
they are: no row is shuffled or dealt again, whatever the number of fits.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.many import Design, shards_for

VERSION = 1
_MANIFEST = "name string, version int, label string, key string, fold string, shards int, n long, roles string, scaler string"
_AUTO = "spark.sql.sources.bucketing.autoBucketedScan.enabled"


@dataclass
class StoredDesign:
    design: Design
    roles: dict
    scaler: dict
    version: int


def save_design(df: DataFrame, name: str, roles: dict[str, list[str]], label: str = "y", key: str = "loan_id",
                fold: str | None = None, scaler: dict | None = None, shards: int | None = None) -> int:
    """Write the rows without a NULL input or label; returns their number. ``roles`` names the
    input columns (for example wide and deep)."""
    cols = list(dict.fromkeys(c for own in roles.values() for c in own))
    kept = df.select(*dict.fromkeys([key, label, *([fold] if fold else []), *cols])).dropna(subset=[label, *cols])
    n = kept.count()
    shards = shards or shards_for(n)
    (kept.repartition(shards, key).write.mode("overwrite").bucketBy(shards, key).sortBy(key).format("parquet")
     .saveAsTable(name))
    row = (name, VERSION, label, key, fold, shards, n, json.dumps(roles), json.dumps(scaler or {}))
    df.sparkSession.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("overwrite").saveAsTable(f"{name}_manifest")
    return n


def load_design(spark: SparkSession, name: str) -> StoredDesign:
    """The stored design, cached for the trainer; ``design.release()`` ends that."""
    m = spark.table(f"{name}_manifest").first()
    if m["version"] != VERSION:
        raise ValueError(f"design {name}: version {m['version']}, this library reads {VERSION}")
    # a scan by buckets, also where no join asks for it: the buckets are the shards
    auto = spark.conf.get(_AUTO, "true")
    spark.conf.set(_AUTO, "false")
    try:
        data = spark.table(name).sortWithinPartitions(m["key"]).persist(StorageLevel.MEMORY_AND_DISK)
        data.select(F.count(F.lit(1))).collect()
    finally:
        spark.conf.set(_AUTO, auto)
    return StoredDesign(Design(data, m["label"], m["key"], m["fold"], m["shards"], m["n"]), json.loads(m["roles"]),
                        json.loads(m["scaler"]), m["version"])


def drop_design(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"DROP TABLE IF EXISTS {name}_manifest")
