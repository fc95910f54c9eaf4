"""Nested documents into relations: one pass over each document's variant gives the rows of all of them."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Relation(NamedTuple):
    """A relation of a document: the path of lists or maps that its rows lie in (none: the document itself is the row), its columns and what a row must have.

    A step of the path is a field, or a field with a star behind it for a map, whose keys become the row's key.
    Columns are (name, path in the row, type).
    """

    name: str
    path: tuple[str, ...]
    columns: tuple[tuple[str, str, str], ...]
    needs: str | None = None


_ROW = "array<struct<at:array<int>,key:string,item:variant>>"


def _rows(document: Column, path: tuple[str, ...]) -> Column:
    """The rows at a path: at (the place in each list of the path, from 1), key (of the innermost map) and item."""
    start = F.array(F.struct(F.array().cast("array<int>").alias("at"), F.lit(None).cast("string").alias("key"), document.alias("item")))

    def below(rows: Column, step: str) -> Column:
        field = f"$.{step.removesuffix('*')}"

        def inner(row: Column) -> Column:
            if step.endswith("*"):
                entries = F.map_entries(F.try_variant_get(row["item"], field, "map<string,variant>"))
                found = F.transform(entries, lambda e, i: F.struct(F.array_append(row["at"], i + 1).alias("at"), e["key"].alias("key"), e["value"].alias("item")))
            else:
                items = F.try_variant_get(row["item"], field, "array<variant>")
                found = F.transform(items, lambda x, i: F.struct(F.array_append(row["at"], i + 1).alias("at"), row["key"].alias("key"), x.alias("item")))
            return F.coalesce(found, F.array().cast(_ROW))

        return F.flatten(F.transform(rows, inner))

    return reduce(below, path, start)


def shred(documents: DataFrame, id_column: str, variant: str, relations: list[Relation]) -> DataFrame:
    """relation, the document's id, at, key, run (the row's number within its relation and document, across all lists, from 1) and item, of all relations at once."""
    parts = [F.transform(_rows(F.col(variant), r.path), _tag(r.name)) for r in relations]
    return documents.select(id_column, F.explode(F.concat(*parts)).alias("r")).select("r.relation", id_column, "r.at", "r.key", "r.run", "r.item")


def _tag(name: str):
    return lambda row, i: F.struct(F.lit(name).alias("relation"), row["at"].alias("at"), row["key"].alias("key"), (i + 1).alias("run"), row["item"].alias("item"))


def relation(rows: DataFrame, id_column: str, r: Relation) -> DataFrame:
    """The rows of one relation with its columns. rows: of shred(), best written by relation, so that only this relation is read."""
    own = rows.where(F.col("relation") == r.name)
    held = own.where(F.try_variant_get("item", f"$.{r.needs}", "string").isNotNull()) if r.needs else own
    return held.select(id_column, "at", "key", "run", *[F.try_variant_get("item", f"$.{path}", kind).alias(name) for name, path, kind in r.columns])


def write_shredded(rows: DataFrame, path: str) -> None:
    """All relations in one write, a folder for each."""
    rows.hint("rebalance", "relation").write.partitionBy("relation").parquet(path)
