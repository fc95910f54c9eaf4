"""A buffer that writes rows in batches: by number, by bytes or by age, whichever comes first."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows, bytes and seconds after which a batch is given out.
ROWS, BYTES, SECONDS = 50, 8 * 1024 * 1024, 30
#: What a row costs besides its text.
ROW_BYTES = 200


class Buffer(StatefulProcessor):
    """Rows of a shard until a batch is due. A row that is a batch's bytes by itself goes alone, behind what came before it. Characters U+0000 are taken out of texts.

    Waiting rows, their bytes and the batch's number are the state, so a stream that starts again goes on where it was.
    """

    def __init__(self, rows: int, size: int, seconds: int):
        self.rows, self.size, self.seconds = rows, size, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id string, text string")
        self.facts = handle.getValueState("facts", "rows int, bytes long, batch long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, (size, batch, due) = self._held(), self._facts()
        out: list[tuple] = []
        for frame in rows:
            for row_id, text in zip(frame["id"].astype(str), frame["text"], strict=True):
                text = None if text is None or text != text else text.replace("\0", "")
                own = len((text or "").encode()) + ROW_BYTES
                if own >= self.size:
                    for reason, these in (("bytes", held), ("oversize", [(row_id, text)])):
                        if these:
                            out.append((key[0], batch, reason, these))
                            batch += 1
                    held, size = [], 0
                    continue
                held.append((row_id, text))
                size += own
                reason = "rows" if len(held) >= self.rows else "bytes" if size >= self.size else None
                if reason:
                    out.append((key[0], batch, reason, held))
                    held, size, batch = [], 0, batch + 1
        now = timerValues.getCurrentProcessingTimeInMs()
        if held and (out or not due):
            self._drop(due)
            due = now + 1_000 * self.seconds
            self.handle.registerTimer(due)
        elif not held:
            self._drop(due)
            due = 0
        self._keep(held, size, batch, due)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, (_, batch, due) = self._held(), self._facts()
        if not held or expiredTimerInfo.getExpiryTimeInMs() < due:
            yield _frame([])
            return
        self._keep([], 0, batch + 1, 0)
        yield _frame([(key[0], batch, "age", held)])

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def _facts(self) -> tuple[int, int, int]:
        if not self.facts.exists():
            return 0, 0, 0
        _, size, batch, due = self.facts.get()
        return size, batch, due

    def _drop(self, due: int) -> None:
        if due:
            self.handle.deleteTimer(due)

    def _keep(self, held: list[tuple], size: int, batch: int, due: int) -> None:
        self.waiting.clear()
        if held:
            self.waiting.put(held)
        self.facts.update((len(held), size, batch, due))

    def close(self) -> None:
        pass


def _frame(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "shard": pd.Series([k for k, *_ in out], dtype="int64"),
            "batch": pd.Series([b for _, b, *_ in out], dtype="int64"),
            "reason": pd.Series([r for _, _, r, _ in out], dtype="object"),
            "n": pd.Series([len(x) for *_, x in out], dtype="int64"),
            "rows": pd.Series([json.dumps([{"id": i, "text": t} for i, t in x]) for *_, x in out], dtype="object"),
        }
    )


def batches(stream: DataFrame, rows: int = ROWS, size: int = BYTES, seconds: int = SECONDS) -> DataFrame:
    """shard, batch, reason (rows, bytes, age or oversize), n and rows (JSON) of each batch. stream: shard long, id, text.

    The session's state store must be RocksDB's (spark.sql.streaming.stateStore.providerClass).
    """
    return stream.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=Buffer(rows, size, seconds), outputStructType="shard long, batch long, reason string, n long, rows string", outputMode="Append", timeMode="ProcessingTime"
    )
