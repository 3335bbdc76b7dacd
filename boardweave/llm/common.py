"""Shared plumbing of the training-data operators: shared-folder tables and skew-safe joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardweave.operators.scratch import dropped, freed, scratch_dir, written  # noqa: F401

#: Rows of one key above which the key is salted, and the most keys that may count as hot.
HOT_ROWS, HOT_KEYS = 50_000, 1_000


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(rows: DataFrame, groups: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of many ``rows`` with one row per key of ``groups`` (a written table), safe for hot keys.

    ``n`` is the column of ``groups`` with the number of rows of that key. Keys with more than
    max(HOT_ROWS, all rows / HOT_KEYS) rows are hot, so there are at most HOT_KEYS of them: that list
    is broadcast, tells each row its number of salts, and each hot key is replicated once per salt.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    hot = max(HOT_ROWS, total // HOT_KEYS)
    if not groups.where(F.col(n) > hot).limit(1).count():
        return rows.join(groups.drop(n), key)
    salts = F.when(F.col(n) > hot, F.ceil(F.col(n) / hot)).otherwise(1).cast("int")
    few = groups.where(F.col(n) > hot).select(F.col(key), salts.alias("_salts"))
    r = rows.join(F.broadcast(few), key, "left")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.coalesce("_salts", F.lit(1)).cast("bigint"))
    g = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return r.withColumn("_salt", spread.cast("int")).drop("_salts").join(g.drop(n), [key, "_salt"]).drop("_salt")
