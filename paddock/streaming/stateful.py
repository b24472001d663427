"""Operators with state of their own: keyed state that timers end at a race's start."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.market import RUNNER, movement_columns
from .market import pre_race

# The state store that keyed state with timers needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
ZONE = "UTC"


def millis(at: pd.Timestamp) -> int:
    return int((at.tz_localize(ZONE) if at.tzinfo is None else at).value // 1_000_000)


def moment(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


def micros(at: pd.Timestamp) -> int:
    return int((at.tz_localize(ZONE) if at.tzinfo is None else at).value // 1000)


def chosen(key: tuple, starts: int, at: int, agf: float) -> pd.DataFrame:
    return pd.DataFrame({**{c: [v] for c, v in zip(RUNNER, key, strict=True)}, "captured_at": [moment(at)], "agf_percent": [agf], "starts_at": [moment(starts)]})


class UntilStart(StatefulProcessor):
    """State of a runner until the start of the race, which may be moved: `start` holds it, and one timer is set to it."""

    def follow(self, starts: int, now: int) -> bool:
        """Set the timer to a start; False once the watermark is past it, and then nothing may change."""
        if starts // 1000 <= now:
            return False
        known = self.start.get()
        if known is None or known[0] != starts:
            if known is not None:
                self.handle.deleteTimer(known[0] // 1000)
            self.handle.registerTimer(starts // 1000)
            self.start.update((starts,))
        return True

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", "starts_at long")

    def close(self) -> None:
        pass


class NewestAtStart(UntilStart):
    """The newest point of a runner, emitted once when the watermark reaches the start; then its state is gone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.newest = handle.getValueState("newest", "captured_at long, agf_percent double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        best = self.newest.get()
        for part in rows:
            for at, agf, starts in zip(part["captured_at"], part["agf_percent"], part["starts_at"], strict=True):
                if self.follow(micros(starts), now):
                    found = (micros(at), float(agf))
                    best = found if best is None or found > tuple(best) else best
        if best is not None:
            self.newest.update(tuple(best))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, agf = self.newest.get()
        starts = self.start.get()[0]
        self.newest.clear()
        self.start.clear()
        if at < starts:  # a start that was moved forward leaves out what came after it
            yield chosen(key, starts, at, agf)


class RunningScore(UntilStart):
    """The movement of a runner's share within the window before the start; repeated points count once; ends at the start."""

    def __init__(self, window_minutes: int = 90):
        self.window = window_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.points = handle.getMapState("points", "captured_at long", "agf_percent double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, changed, starts_at = timerValues.getCurrentWatermarkInMs(), False, None
        for part in rows:
            for at, agf, starts in zip(part["captured_at"], part["agf_percent"], part["starts_at"], strict=True):
                at, starts = micros(at), micros(starts)
                if self.follow(starts, now) and starts - self.window <= at < starts and not self.points.containsKey((at,)):
                    self.points.updateValue((at,), (float(agf),))
                    changed, starts_at = True, starts
        if changed:
            inside = sorted((k[0], v[0]) for k, v in self.points.iterator() if starts_at - self.window <= k[0] < starts_at)
            columns = {"sample_size": len(inside), "first_agf": inside[0][1], "latest_agf": inside[-1][1], "span": inside[-1][0] - inside[0][0]}
            yield pd.DataFrame({**{c: [v] for c, v in zip(RUNNER, key, strict=True)}, **{c: [v] for c, v in columns.items()}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.points.clear()
        self.start.clear()
        yield from ()


KEYS = "race_date date, city string, race_number long, horse_number long"


def keyed(stream: DataFrame, delay: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    rows = pre_race(stream.withWatermark("captured_at", delay)).select(*RUNNER, "captured_at", "agf_percent", "starts_at")  # points of after the start move the watermark too
    return rows.groupBy(*RUNNER).transformWithStateInPandas(processor, schema, mode, "EventTime")


def candidate_at_start(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The newest point before the start of every runner, one row each, in append mode.

    A row comes when the watermark (`delay` behind the newest point of all races) reaches `starts_at`; points that come
    later change nothing, and nothing of the race is held any more. Needs the state store in STORE.
    """
    return keyed(stream, delay, NewestAtStart(), f"{KEYS}, captured_at timestamp, agf_percent double, starts_at timestamp", "Append")


def bounded_movement(stream: DataFrame, window_minutes: int = 90, delay: str = "10 minutes") -> DataFrame:
    """Score and direction of every runner's movement, a row a batch in which a runner's points change, in update mode.

    Repeats of a point (runner, captured_at) count once, whenever they come; points before the window, at or after the
    start, or after the watermark has passed the start change nothing. A runner's state is the points of its window and
    goes at the start. Needs the state store in STORE.
    """
    made = keyed(stream, delay, RunningScore(window_minutes), f"{KEYS}, sample_size long, first_agf double, latest_agf double, span long", "Update")
    return made.select(*RUNNER, "sample_size", *movement_columns())


def ingest(races: Callable[[SparkSession], DataFrame], path: str):
    """A foreachBatch sink: points meet the races as they stand when the batch runs, and those before the start are stored.

    points(race_date, city, race_number, horse_number, captured_at, agf_percent); races(race_date, city, race_number,
    starts_at). A start that is postponed between two batches counts from the next one on. Every batch has a folder of
    its own, which a replay writes anew, so that it stores nothing twice; repeats within a batch are stored once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        known = races(batch.sparkSession).select("race_date", "city", "race_number", "starts_at")
        met = pre_race(batch.join(known, ["race_date", "city", "race_number"])).dropDuplicates([*RUNNER, "captured_at"])
        met.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


__all__ = ["STORE", "bounded_movement", "candidate_at_start", "ingest"]
