"""Desaturations of a live stream: flagged samples become runs as they end, in order of arrival or of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from breathmark.config import Config
from breathmark.operators.intervals import rows_for
from breathmark.schema import EVENTS, REC


COLUMNS = [*REC, "type", "start_idx", "end_idx", "start_t", "end_t"]


class Runs:
    """The open run of one recording, and the runs that samples have ended, as events."""

    def __init__(self, key: tuple, opened: tuple | None, least: int, fs: int):
        self.key, self.least, self.fs, self.done = key, least, fs, []
        self.first, self.last = opened or (None, None)

    def end(self) -> None:
        if self.first is not None and self.last - self.first + 1 >= self.least:
            self.done.append((*self.key, "desaturation", self.first + 1, self.last + 1, self.first / self.fs, self.last / self.fs))
        self.first = self.last = None

    def take(self, k: int, flag: bool) -> None:
        if self.first is not None and (not flag or k != self.last + 1):
            self.end()
        if flag:
            self.first, self.last = (k, k) if self.first is None else (self.first, k)

    def events(self) -> pd.DataFrame:
        return pd.DataFrame(self.done, columns=COLUMNS).astype({"subject": "int32", "condition": "int32"})


class RunBuilder(StatefulProcessor):
    """Keeps the open run of each recording; emits it when a sample that isn't flagged, or a gap, ends it.

    Samples of a recording must arrive in order, as those of one sensor do; within a batch they are sorted.
    """

    def __init__(self, least: int, fs: int):
        self.least, self.fs = least, fs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open_run", "first long, last long")

    def opened(self, key: tuple) -> Runs:
        return Runs(key, self.open.get() if self.open.exists() else None, self.least, self.fs)

    def keep(self, runs: Runs) -> None:
        if runs.first is None:
            self.open.clear()
        else:
            self.open.update((int(runs.first), int(runs.last)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch, runs = pd.concat(list(rows)).sort_values("k"), self.opened(key)
        for k, flag in zip(batch["k"].tolist(), batch["flag"].tolist(), strict=True):
            runs.take(k, flag)
        self.keep(runs)
        yield runs.events()

    def close(self) -> None:
        pass


class LateRunBuilder(RunBuilder):
    """The same for samples that come in any order, up to the watermark's delay late.

    Samples wait until the watermark has passed their time, then they are taken in order. A timer at the earliest that waits brings them up. A sample that comes
    twice counts once. What is later than the watermark is dropped by the stream.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getListState("waiting", "k long, flag boolean, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        ms = batch["ts"].to_numpy("datetime64[ms]").astype("int64").tolist()
        self.waiting.appendList(list(zip(batch["k"].tolist(), map(bool, batch["flag"].tolist()), ms, strict=True)))
        self.handle.registerTimer(max(min(ms), timerValues.getCurrentWatermarkInMs() + 1))
        yield Runs(key, None, self.least, self.fs).events()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, runs = timerValues.getCurrentWatermarkInMs(), self.opened(key)
        waiting = sorted(map(tuple, self.waiting.get()))
        ready, left = [w for w in waiting if w[2] <= now], [w for w in waiting if w[2] > now]
        for i, (k, flag, _) in enumerate(ready):
            if not i or k != ready[i - 1][0]:
                runs.take(k, flag)
        self.keep(runs)
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(min(ms for *_, ms in left))
        else:
            self.waiting.clear()
        yield runs.events()


def flagged(stream: DataFrame, base: DataFrame, config: Config) -> DataFrame:
    """``k`` and ``flag`` of streamed samples against the recordings' known medians (a static table)."""
    x, p = F.col("spo2"), config.spo2
    low = (x < p.floor) | (F.col("spo2_median") - x >= p.drop)
    more = ["ts"] if "ts" in stream.columns else []
    return stream.join(base, REC).select(*REC, "k", F.coalesce(low, F.lit(False)).alias("flag"), *more)


def desaturation_stream(flags: DataFrame, config: Config) -> DataFrame:
    """Events of a streaming table of ``flagged`` samples; a run that is still open at the end is held back."""
    return flags.groupBy(*REC).transformWithStateInPandas(
        statefulProcessor=RunBuilder(rows_for(config.spo2.min_dur_sec, config), config.fs),
        outputStructType=EVENTS, outputMode="Append", timeMode="None",
    )


def late_desaturation_stream(flags: DataFrame, config: Config, delay: str) -> DataFrame:
    """Events of a streaming table of ``flagged`` samples with their time ``ts``, which may come in any order and up to ``delay`` late.

    A run is told once the watermark has passed the sample that ends it.
    """
    return flags.withWatermark("ts", delay).groupBy(*REC).transformWithStateInPandas(
        statefulProcessor=LateRunBuilder(rows_for(config.spo2.min_dur_sec, config), config.fs),
        outputStructType=EVENTS, outputMode="Append", timeMode="EventTime",
    )
