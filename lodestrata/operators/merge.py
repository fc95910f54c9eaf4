"""Keyed merges as functions of (base, delta). Nothing is changed in place: the result is a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.relational import distinct_on


def last_write_wins(df: DataFrame, keys: list[str], arrival: Column) -> DataFrame:
    return distinct_on(df, keys, [arrival.desc()])


def once(delta: DataFrame, keys: list[str], arrival: Column | None = None) -> DataFrame:
    """One row per key: the last to arrive, or without an arrival the greatest of its columns, so that reruns agree."""
    others = [F.col(c) for c in delta.columns if c not in keys]
    order = [arrival.desc()] if arrival is not None else []
    return distinct_on(delta, keys, [*order, *[c.desc_nulls_last() for c in others]]) if others or order else delta.distinct()


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], arrival: Column | None = None) -> DataFrame:
    """All columns of delta's rows replace base's: an anti join and a union, no window over the base. A null key matches nothing."""
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(once(delta, keys, arrival))


def upsert_verdicts(base: DataFrame, delta: DataFrame, keys: list[str], hash_column: str) -> DataFrame:
    """delta's rows with verdict inserted, updated or unchanged, by whether base has the key and the same hash."""
    old = base.select(*keys, F.col(hash_column).alias("__old"), F.lit(True).alias("__held"))
    verdict = F.when(F.col("__held").isNull(), "inserted").when(F.col(hash_column).eqNullSafe(F.col("__old")), "unchanged").otherwise("updated")
    return once(delta, keys).join(old, keys, "left").withColumn("verdict", verdict).drop("__old", "__held")


def upsert_coalesce(base: DataFrame, delta: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """delta's values where they are not null, base's otherwise, for all keys of either."""
    new = once(delta.select(*keys, *columns), keys).withColumnsRenamed({c: f"__{c}" for c in columns})
    return base.join(new, keys, "full").select(*keys, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])


def upsert_monotone(base: DataFrame, delta: DataFrame, keys: list[str], stamp: str, columns: list[str]) -> DataFrame:
    """base's rows, taking delta's columns only where its stamp is not older; a null stamp is the oldest."""
    latest = once(delta, keys, F.coalesce(F.col(stamp).cast("string"), F.lit("")))
    new = latest.select(*keys, F.col(stamp).alias("__stamp"), F.lit(True).alias("__held"), *[F.col(c).alias(f"__{c}") for c in columns])
    oldest = F.lit("")
    takes = F.col("__held").isNotNull() & (F.coalesce(F.col("__stamp").cast("string"), oldest) >= F.coalesce(F.col(stamp).cast("string"), oldest))
    return base.join(new, keys, "left").select(
        *keys,
        F.when(takes, F.col("__stamp")).otherwise(F.col(stamp)).alias(stamp),
        *[F.when(takes, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns],
    )


def insert_ignore(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """delta's rows of new keys are added, one of each key; base's stay."""
    return base.unionByName(once(delta.join(base.select(*keys), keys, "left_anti"), keys))


def replace_children(base: DataFrame, delta: DataFrame, parent: list[str]) -> DataFrame:
    """All rows of the parents in delta replaced by delta's."""
    return base.join(delta.select(*parent).distinct(), parent, "left_anti").unionByName(delta)


def cascade_delete(gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each child table (name: table, its column of the parent's key) without the rows of the parents in gone."""
    ids = gone.select(F.col(key).alias("__gone")).distinct()
    return {name: df.join(ids, F.col(column) == F.col("__gone"), "left_anti") for name, (df, column) in children.items()}


def upsert_fuller(base: DataFrame, delta: DataFrame, keys: list[str], listed: list[str], payload: str, detailed: str) -> DataFrame:
    """A list pass over rows that a detail pass may have filled: listed columns are delta's, the payload only where `detailed` is null.

    So a thin record never replaces a full one. New keys come in with a null `detailed`.
    """
    new = once(delta.select(*keys, *listed, payload), keys).select(*keys, *[F.col(c).alias(f"__{c}") for c in (*listed, payload)], F.lit(True).alias("__new"))
    thin = F.col("__new") & F.col(detailed).isNull()
    return base.join(new, keys, "full").select(
        *keys,
        *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in listed],
        F.when(thin, F.col(f"__{payload}")).otherwise(F.col(payload)).alias(payload),
        detailed,
    )


def backfill(df: DataFrame, column: str, value: Column) -> DataFrame:
    """value where the column is null; what is there stays."""
    return df.withColumn(column, F.coalesce(F.col(column), value))


def sweep(df: DataFrame, stamp: str, since: object) -> DataFrame:
    """Without the rows whose stamp is older."""
    return df.where(F.col(stamp) >= F.lit(since))


def source_priority(df: DataFrame, keys: list[str], rank: Column, tie: Column) -> DataFrame:
    """The best source's row of each key."""
    return distinct_on(df, keys, [rank.asc(), tie.asc()])


def ledger_decisions(remote: DataFrame, ledger: DataFrame, keys: list[str], hash_column: str, size: str, ceiling: float) -> DataFrame:
    """remote's datasets with plan (new, seeded, unchanged or changed) and refused: whether what is to be fetched is more than a share of all rows.

    seeded: the ledger has the dataset without a hash, so it is taken as it is once. A null key matches a null key.
    """
    known = ledger.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(hash_column).alias("__old"), F.lit(True).alias("__held"))
    match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    plan = F.when(F.col("__held").isNull(), "new").when(F.col("__old").isNull(), "seeded").when(F.col("__old").eqNullSafe(F.col(hash_column)), "unchanged").otherwise("changed")
    planned = remote.join(known, match, "left").select(*remote.columns, plan.alias("plan"))
    fetched = F.sum(F.when(F.col("plan").isin("new", "changed"), F.col(size)).otherwise(0))
    whole = planned.agg((fetched > ceiling * F.sum(size)).alias("refused"))  # one row
    return planned.join(F.broadcast(whole))
