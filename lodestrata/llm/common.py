"""What the training-data operators share: words, shared storage, size-checked joins, distributed prefix sums."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word is a run of anything but the six ASCII white-space characters.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast only if it has been counted and has no more rows than this.
BROADCAST_ROWS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null and blank texts."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def where_here(df: DataFrame, condition: Column) -> DataFrame:
    """df filtered by condition after its columns have been computed.

    The optimizer moves a plain filter below the projection that makes its columns, and so would put
    costly expressions, such as a text's words, into every place of the condition that needs them.
    """
    seq = F.monotonically_increasing_id().alias("__seq")
    return df.select("*", seq).where(condition & (F.col("__seq") >= 0)).drop("__seq")


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset on one machine (tests).

    On a cluster a folder of one machine would lose what executors write: without the setting this is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or None
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = table_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; otherwise as it is, for a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sampled_ids(labels: DataFrame, limit: int) -> DataFrame:
    """At most `limit` distinct doc_ids of labels, chosen by hash: the documented bound of a training sample."""
    ids = labels.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def chunk_bits(rows: int) -> int:
    """Bits of a chunk number such that chunks and rows per chunk both grow with the square root of the rows."""
    return max(1, min(24, math.ceil(math.log2(max(2, rows)) / 2)))


def running_total(df: DataFrame, group: str, chunk: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add `name`: the exclusive running sum of value within group, in the order of chunk, then `order`.

    A group may hold any share of the rows: the sum runs inside (group, chunk), and the totals of
    the chunks, a few per group, carry it on. df must give the same rows whenever it is read.
    """
    inner = W.partitionBy(group, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    base = (
        df.groupBy(group, chunk)
        .agg(F.sum(value).alias("__total"))
        .select(group, chunk, F.coalesce(F.sum("__total").over(outer), F.lit(0)).alias("__base"))
    )
    within = df.withColumn("__within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return (
        within.join(base, [group, chunk])
        .withColumn(name, F.col("__within") + F.col("__base"))
        .drop("__within", "__base")
    )
