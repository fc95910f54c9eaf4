"""Incremental forms of the operators: stateful deduplication, sliding counts, idempotent sinks and a per-key rate limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.operators.merge import last_write_wins, upsert

RATE_LIMIT_S = 30
#: Gaps in a block of a key's time.
BLOCK_GAPS = 1000


def _timed(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with a time zone; the session's is taken for those without."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def deduplicated(stream: DataFrame, key: str, ts: str, lateness: str = "1 day") -> DataFrame:
    """Each key once within the watermark; re-read overlaps drop out. State older than that is given up."""
    return _timed(stream, ts).withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def trending(stream: DataFrame, value: str, ts: str, lateness: str = "1 hour") -> DataFrame:
    """Counts by value in sliding windows of a day, hour by hour."""
    counted = _timed(stream, ts).withWatermark(ts, lateness) if stream.isStreaming else stream
    return counted.groupBy(F.window(ts, "24 hours", "1 hour").alias("w"), value).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), value, "n")


def upsert_sink(path_of: callable, keys: list[str], arrival: str):
    """A foreachBatch function that merges each batch into a snapshot: path_of(batch) is where snapshot n is.

    A batch that is run again writes the same snapshot again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        delta = last_write_wins(batch, keys, F.col(arrival))
        base = spark.read.schema(batch.schema).parquet(path_of(batch_id - 1)) if batch_id else spark.createDataFrame([], batch.schema)
        upsert(base, delta, keys).write.mode("overwrite").parquet(path_of(batch_id))

    return merge


def rate_limited(events: DataFrame, key: str, ts: str, seconds: int = RATE_LIMIT_S) -> DataFrame:
    """Events at least `seconds` after the last one of their key that was let through. The last time let through is the state."""
    schema = events.schema

    def admit(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(ts)
        keep = []
        for t in rows[ts]:
            now = t.value // 1000
            keep.append(last is None or now - last >= seconds * 1_000_000)
            last = now if keep[-1] else last
        if last is not None:
            state.update((last,))
        yield rows[keep]

    return events.groupBy(key).applyInPandasWithState(admit, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def _followers(at: np.ndarray, gap: int) -> np.ndarray:
    """Of each of the sorted times, the place of the next one that may be let through after it."""
    return np.searchsorted(at, at + gap)


def _ways_through(at: np.ndarray, start: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The times at which a block may let its first event through, and the last time that it lets through then.

    What came before let its last event through before `start`, so the first one here is less than a gap
    after the start, or the first that is not. Neighbouring times that end alike are one, the last of them.
    """
    after, last = _followers(at, gap), at.copy()
    for i in range(len(at) - 1, -1, -1):
        if after[i] < len(at):
            last[i] = last[after[i]]
    n = min(len(at), int(np.searchsorted(at, start + gap)) + 1)
    ends = np.append(last[1:n] != last[: n - 1], True)
    return at[:n][ends], last[:n][ends]


def rate_limited_batch(events: DataFrame, key: str, ts: str, seconds: int = RATE_LIMIT_S) -> DataFrame:
    """key and event_id of what the same lets through of a finished table; of equal times the least event_id. Rows without a time are left out.

    Each key's time is cut into blocks of BLOCK_GAPS times the gap. A block tells, in a task of its own, where it would end
    for each way to begin; these few rows are followed along each key, and then each block lets its events through.
    So one busy key is spread over many tasks, and nothing grows faster than the events.
    """
    gap = seconds * 1_000_000
    length = gap * BLOCK_GAPS
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    timed = events.select(F.col(key).alias("key"), "event_id", at.alias("at")).where("at is not null").withColumn("block", F.col("at") - F.pmod("at", F.lit(length)))
    kinds = {f.name: f.dataType.simpleString() for f in timed.schema}

    def ways(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first, last = _ways_through(np.sort(rows["at"].to_numpy(np.int64)), int(group[1]), gap)
        return pd.DataFrame({"key": [group[0]] * len(first), "block": int(group[1]), "first": first, "last": last})

    def follow(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        free, out = None, []
        for block, here in rows.sort_values(["block", "first"]).groupby("block"):
            out.append((group[0], block, free))
            i = 0 if free is None else int(np.searchsorted(here["first"].to_numpy(np.int64), free))
            if i < len(here):
                free = int(here["last"].iloc[i]) + gap
        return pd.DataFrame({"key": [k for k, _, _ in out], "block": [b for _, b, _ in out], "free": pd.array([f for _, _, f in out], "Int64")})

    def admit(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "event_id"])
        times, free = rows["at"].to_numpy(np.int64), rows["free"].iloc[0]
        after, kept = _followers(times, gap), []
        i = 0 if pd.isna(free) else int(np.searchsorted(times, int(free)))
        while i < len(times):
            kept.append(i)
            i = int(after[i])
        return rows.iloc[kept][["key", "event_id"]]

    found = timed.groupBy("key", "block").applyInPandas(ways, f"key {kinds['key']}, block long, first long, last long")
    begins = found.groupBy("key").applyInPandas(follow, f"key {kinds['key']}, block long, free long").withColumnsRenamed({"key": "k", "block": "b"})
    begun = timed.join(begins, F.col("key").eqNullSafe(F.col("k")) & (F.col("block") == F.col("b"))).drop("k", "b")
    kept = begun.groupBy("key", "block").applyInPandas(admit, f"key {kinds['key']}, event_id {kinds['event_id']}")
    return kept.withColumnRenamed("key", key)
