"""Work that failed and is asked for again: state and timers over a log of attempts.

Each key (a mission and an aspect, say) counts its failures in a row. A failure sets a timer, `wait` after the first and twice as long after each
further one; when it runs out without another attempt, the key is due again. The `most`-th failure in a row makes the key dead, and its count begins anew should it
be tried all the same. A success forgets the failures.

Time is that of the attempts, so what comes out is the same however the log is cut into runs, as long as later files hold later attempts: an
attempt behind a timer's end fires that timer first. Without later attempts of the key, a timer fires when the watermark, the time of all keys' latest attempt less
`late`, has passed it; the end of a run counts. State is kept below the checkpoint, which all executors see, so a lost executor costs no state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST, WAIT = 3, 3600.0
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Attempts(StatefulProcessor):
    """State (failures, due): how many in a row, and when the timer runs out, in milliseconds; 0 for no timer."""

    def __init__(self, keys: list[str], most: int, wait: float):
        self.keys, self.most, self.wait = keys, most, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "failures int, due long")

    def _row(self, key: tuple, kind: str, at: int, failures: int) -> tuple:
        return (*key, kind, at, failures)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.keys, "kind", "at", "failures"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        failures, due = self.state.get() if self.state.exists() else (0, 0)
        before = due
        # columns come by place: keys, event time, milliseconds, whether it went well, order
        attempts = sorted((t, n, ok) for batch in rows for t, ok, n in zip(*(batch.iloc[:, i] for i in (-3, -2, -1))))
        out = []
        for at, _, ok in attempts:
            if due and at > due:
                out.append(self._row(key, "retry", due, failures))
            due = 0
            failures = 0 if ok else failures + 1
            if failures >= self.most:
                out.append(self._row(key, "dead", at, failures))
                failures = 0
            elif failures:
                due = at + int(self.wait * 1000 * 2 ** (failures - 1))
        if before and before != due:
            self.handle.deleteTimer(before)
        if due and before != due:
            self.handle.registerTimer(due)
        self._keep(failures, due)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, due = self.state.get() if self.state.exists() else (0, 0)
        if due and due == expiredTimerInfo.getExpiryTimeInMs():
            self._keep(failures, 0)
            yield self._frame([self._row(key, "retry", due, failures)])

    def _keep(self, failures: int, due: int) -> None:
        if failures or due:
            self.state.update((failures, due))
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def outcomes(attempts: DataFrame, keys: list[str], at: str = "at", ok: str = "ok", order: str | None = None, most: int = MOST, wait: float = WAIT, late: str = "0 seconds") -> DataFrame:
    """(keys, kind, at, failures) of a stream of attempts: `retry` when a key is due again, `dead` when it has failed `most` times in a row.

    Attempts of one key at one time count in the order of `order`. Those without a time or without a known end are left out, null keys are keys.
    """
    rows = attempts.where(F.col(at).isNotNull() & F.col(ok).isNotNull())
    rows = rows.select(*keys, F.col(at).cast("timestamp").alias("__at"), F.unix_millis(F.col(at).cast("timestamp")).alias("__ms"), F.col(ok).alias("__ok"), (F.col(order) if order else F.lit(0)).cast("long").alias("__order"))
    kinds = ", ".join(f"`{k}` {attempts.schema[k].dataType.simpleString()}" for k in keys)
    processor = Attempts(keys, most, wait)
    made = rows.withWatermark("__at", late).groupBy(*keys).transformWithStateInPandas(processor, f"{kinds}, kind string, at long, failures int", "Append", "EventTime")
    return made.withColumn("at", F.timestamp_millis("at"))


def follow(
    spark: SparkSession, source: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], keys: list[str], at: str = "at", ok: str = "ok", order: str | None = None, most: int = MOST, wait: float = WAIT
) -> None:
    """One incremental run over new files of the log: outcomes to handle(batch, number), which must give the same for the same number. Then it stops."""
    before = spark.conf.get(*_PROVIDER)
    spark.conf.set(*_PROVIDER)
    try:
        stream = outcomes(spark.readStream.schema(schema).parquet(source), keys, at, ok, order, most, wait)
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER[0], before)


def split_dead(outcome: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(due again, dead letters) of outcomes."""
    return outcome.where("kind = 'retry'"), outcome.where("kind = 'dead'")
