"""Tab-delimited dumps whose quoted fields hold line ends: a record is as many lines as it takes to have all its fields.

Where a record begins can't be seen inside a file. So each block of a file, in a task of its own, tells for every number of
fields that may be open at its beginning how many are open at its end, and how many records end in it. These few numbers are
followed along each file. Then every block knows its place: whole records stay where they are, and only the pieces
of records that go over a block's end are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where it begins) and value of each line; lines of a block lie in one partition, in order."""
    reader = spark.read.option("lineSep", "\n")
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _followed(tabs: np.ndarray, fields: int, state: int) -> tuple[int, int]:
    """The state after the lines, and how many records end in them. 0: no record is open; else one more than the tabs of the one that is."""
    ended = 0
    for t in tabs.tolist():
        held = max(0, state - 1) + t
        state, ended = (0, ended + 1) if held >= fields - 1 else (held + 1, ended)
    return state, ended


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str], np.ndarray]]:
    """The lines of each block in turn, with their numbers of tabs; a block that spans batches comes in parts."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        file = batch.column("file")
        change = np.flatnonzero((block[1:] != block[:-1]) | ~pc.equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(block) > 1 else []
        for part in np.split(np.arange(len(block)), change):
            values = batch.column("value").slice(int(part[0]), len(part))
            yield file[int(part[0])].as_py(), int(block[part[0]]), values.to_pylist(), pc.count_substring(values, "\t").to_numpy(zero_copy_only=False)


def read_dump(spark: SparkSession, path: str, fields: int) -> DataFrame:
    """file, record (its number in the file), line (of all its fields) and whole: whether it has as many fields as it should. The last record of a file may lack some."""
    lines = _lines(spark, path)

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        now: tuple[str, int] | None = None
        state = np.zeros((fields, 2), np.int64)

        def told() -> pa.RecordBatch:
            file, block = now
            return pa.RecordBatch.from_pydict(
                {"file": [file] * fields, "block": [block] * fields, "begin": list(range(fields)), "end": state[:, 0].tolist(), "ended": state[:, 1].tolist()}, schema=_WAYS
            )

        for file, block, _, tabs in _blocks(batches):
            if now != (file, block):
                if now is not None:
                    yield told()
                now, state = (file, block), np.stack([np.arange(fields), np.zeros(fields, np.int64)], 1)
            ends = {s: _followed(tabs, fields, s) for s in set(state[:, 0].tolist())}
            state = np.array([(ends[s][0], n + ends[s][1]) for s, n in state.tolist()], np.int64)
        if now is not None:
            yield told()

    def places(rows: pd.DataFrame) -> pd.DataFrame:
        out, state, record = [], 0, 0
        for block, here in rows.sort_values(["block", "begin"]).groupby("block"):
            out.append((here["file"].iloc[0], block, state, record))
            way = here.iloc[state]
            state, record = int(way["end"]), record + int(way["ended"])
        return pd.DataFrame(out, columns=["file", "block", "state", "record"])

    known = lines.mapInArrow(ways, "file string, block long, begin int, end int, ended long")
    begun = known.groupBy("file").applyInPandas(places, "file string, block long, state int, record long")
    # A row for each block of a file: with the usual 128 MB a block, less than a millionth of the dump.
    place = {(r.file, r.block): (r.state, r.record) for r in begun.toLocalIterator()}
    sent = spark.sparkContext.broadcast(place)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, record, held, began = None, 0, 0, [], True

        def row(done: bool) -> tuple:
            return now[0], now[1], record, "\n".join(held), began, done

        for file, block, values, tabs in _blocks(batches):
            out = []
            if now != (file, block):
                if held:
                    out.append(row(False))
                now, held = (file, block), []
                state, record = sent.value[file, block]
                began = state == 0
            for value, t in zip(values, tabs.tolist(), strict=True):
                held.append(value)
                state = max(0, state - 1) + t + 1
                if state >= fields:
                    out.append(row(True))
                    state, record, held, began = 0, record + 1, [], True
            yield _piece_batch(out)
        if held:
            yield _piece_batch([row(False)])

    found = lines.mapInArrow(pieces, "file string, block long, record long, line string, began boolean, done boolean")
    whole = found.where("began and done").select("file", "record", "line")
    cut = found.where("not (began and done)").groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line"))), lambda p: p["line"]), "\n").alias("line"))
    n = F.length("line") - F.length(F.replace("line", F.lit("\t"), F.lit(""))) + 1
    return whole.unionByName(cut).withColumn("whole", n == fields)


_WAYS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("ended", pa.int64())])


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "block": pa.int64(), "record": pa.int64(), "line": pa.string(), "began": pa.bool_(), "done": pa.bool_()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def field(line: Column, i: int) -> Column:
    """The i-th field (from 0): without its backticks, and null where it is the bare word NULL."""
    raw = F.get(F.split(line, "\t"), F.lit(i))
    quoted = (F.length(raw) >= 2) & F.startswith(raw, F.lit("`")) & F.endswith(raw, F.lit("`"))
    return F.when(raw != "NULL", F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))


def written(df: DataFrame, columns: list[str]) -> Column:
    """A row as a line of a dump: text between backticks, numbers bare, null as NULL. Text may hold line ends but no tabs."""
    kinds = dict(df.dtypes)
    one = [F.when(F.col(c).isNull(), "NULL").otherwise(F.concat(F.lit("`"), F.col(c), F.lit("`")) if kinds[c] == "string" else F.col(c).cast("string")) for c in columns]
    return F.concat_ws("\t", *one)
