"""Paging, deduplication, facets and per-group selection over any DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def browse_page(df: DataFrame, conditions: list[Column | None], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows that meet all given conditions, ordered, one page of them. The limit is kept between 1 and 200."""
    held = [c for c in conditions if c is not None]
    found = df.where(reduce(lambda a, b: a & b, held)) if held else df
    return found.orderBy(*order).offset(max(0, offset)).limit(max(1, min(200, limit)))


def keyset_page(df: DataFrame, key: str, after: object, limit: int) -> DataFrame:
    """The next rows by key: a range filter that reaches the scan, and a top-k, instead of a growing offset."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(limit)


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group of keys in the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def interleaved(arms: list[DataFrame], key: str, rank: str, limit: int) -> DataFrame:
    """Ranked lists merged in turn (first of each, second of each, …), the first place of a key counting."""
    placed = reduce(
        DataFrame.unionByName, [a.select(key, (F.col(rank) * len(arms) + i).alias("place"), F.lit(i).alias("arm")) for i, a in enumerate(arms)]
    )
    best = placed.groupBy(key).agg(F.min(F.struct("place", "arm")).alias("best"))
    return best.select(key, F.col("best.arm").alias("arm"), F.col("best.place").alias("place")).orderBy("place").limit(limit)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over all of spark.sql.shuffle.partitions.

    Adaptive execution merges the partitions of a shuffle up to 64 MB of compressed bytes, which is gigabytes of hash tables and sort
    buffers where rows are narrow; partitions of a given number are left as they are.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
