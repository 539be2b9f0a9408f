"""Tables under changes: rows put in, replaced or taken out by key, each by one shuffle on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """table's rows, replaced or joined by the newest change of their key.

    changes: table's columns and ``version``, of which the largest wins (unique within a key).
    Keys are unique in table; a null is a key like any other.
    """
    rest = F.struct(*(c for c in table.columns if c not in key)).alias("_r")
    old = table.select(*key, rest, F.lit(None).cast(dict(changes.dtypes)[version]).alias("_v"), F.lit(0).alias("_s"))
    new = changes.select(*key, rest, F.col(version).alias("_v"), F.lit(1).alias("_s"))
    last = old.unionByName(new).groupBy(*key).agg(F.max_by("_r", F.struct("_s", "_v")).alias("_r"))
    return last.select(*(c if c in key else F.col(f"_r.{c}").alias(c) for c in table.columns))


def erase(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """table's rows whose key isn't among ``keys``."""
    return table.join(keys.select(*key).distinct(), key, "left_anti")
