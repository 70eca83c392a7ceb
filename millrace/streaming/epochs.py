"""Early stopping of training runs while their epochs arrive (WIN6, UDF7)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "due int, before double, best double, at int, next int, decided boolean, epochs array<int>, losses array<double>"


@dataclass
class Fold:
    """What search.stopping_epoch() keeps of a run: the next check, the best loss at the last one, the best loss and its epoch; further the epoch waited for."""

    due: int
    before: float = float("inf")
    best: float = float("inf")
    at: int = 0
    next: int = 1
    decided: bool = False

    def add(self, epoch: int, loss: float | None, limit: int, patience: int, threshold: float) -> int | None:
        """Takes an epoch in and gives the epoch to use, if that is decided now. An epoch without a loss only passes."""
        self.next = epoch + 1
        if loss is None or loss != loss:
            return None
        if loss < self.best:
            self.best, self.at = loss, epoch
        if epoch != self.due:
            return None
        stop = limit if epoch == limit else self.at if self.before - self.best <= threshold else None
        self.due, self.before = max(min(self.at + patience, limit), epoch + 1), self.best
        self.decided = stop is not None
        return stop


class EarlyStop(StatefulProcessor):
    """Decides a run's stopping epoch as soon as the epochs for it are there.

    Epochs that come before their turn wait, limit of them at most. If the one waited for hasn't come
    after wait milliseconds, those that are there go on without it. An epoch that comes twice counts once, and
    nothing is kept of a decided run but that it is decided. All of a run's state is one value, so that a batch reads
    and writes it once for a run, however many epochs it brings: each access is a round trip to the store.
    """

    def __init__(self, limit: int, patience: int, threshold: float, wait: int | None = None):
        self.rule, self.wait = (limit, patience, threshold), wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE)

    def _known(self) -> tuple[Fold, dict[int, float | None]]:
        """The fold so far and the losses of the epochs that wait."""
        held = self.state.get()
        if held is None:
            return Fold(min(self.rule[1], self.rule[0])), {}
        *fold, epochs, losses = held
        return Fold(*fold), dict(zip(epochs, losses, strict=True))

    def _go_on(self, key, fold: Fold, early: dict[int, float | None], now: int | None, gaps: bool) -> Iterator[Row]:
        stop = None
        for epoch in sorted(early):
            if epoch > fold.next and not gaps:
                break
            loss = early.pop(epoch)
            if epoch >= fold.next:
                stop = fold.add(epoch, loss, *self.rule)
            if stop is not None:
                yield Row(run=key[0], stop_epoch=stop)
                early.clear()
                break
        self.state.update((*astuple(fold), list(early), list(early.values())))
        if self.wait is not None and now is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if early and not fold.decided:
                self.handle.registerTimer(now + self.wait)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fold, early = self._known()
        if fold.decided:
            return
        for row in rows:
            if fold.next <= row.epoch <= self.rule[0]:
                early.setdefault(row.epoch, row.loss)
        yield from self._go_on(key, fold, early, timerValues.getCurrentProcessingTimeInMs() if self.wait is not None else None, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        fold, early = self._known()
        if early:
            yield from self._go_on(key, fold, early, timerValues.getCurrentProcessingTimeInMs(), True)

    def close(self) -> None:
        pass


def stopping_stream(epochs: DataFrame, limit: int, patience: int, threshold: float, wait: int | None = None) -> DataFrame:
    """A row (run, stop_epoch) for each run of a stream (run, epoch, loss) once its early stop is decided.

    The rule is that of search.stopping_epoch(); epochs count from 1 and may arrive in any order. Rows
    without run or epoch are left out; a run that never gets to a decision gives nothing.
    """
    rows = epochs.select("run", F.col("epoch").cast("int").alias("epoch"), F.col("loss").cast("double").alias("loss")).where("run is not null and epoch is not null")
    schema = f"run {epochs.schema['run'].dataType.simpleString()}, stop_epoch int"
    return rows.groupBy("run").transformWithState(EarlyStop(limit, patience, threshold, wait), outputStructType=schema, outputMode="Append", timeMode="None" if wait is None else "ProcessingTime")


def write_stops(stops: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes decisions as they come, each once; a query begun again with the checkpoint goes on where it was."""
    conf, name = stops.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)  # the store that keeps states out of the JVM's heap, and that this operator asks for
    try:
        return stops.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
