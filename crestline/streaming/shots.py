"""Live shot cutting: a keyed state holds each video's last value and shot."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_shots(frames: DataFrame, video: str, no: str, value: str, threshold: float, idle_ms: int | None = None) -> DataFrame:
    """A stream of (video, frame_no, value, shot_id): a new shot begins where the value changes by more than the threshold.

    Frames of a trigger are taken in their order; one that comes in a later trigger than its
    follower is dropped, as the shot it belonged to has been told. With `idle_ms` a video's state
    (three numbers) goes after so long without frames; such a query runs on without new data, to time out.
    """
    out = f"{video} string, frame_no long, value double, shot_id long"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_no, last, shot = state.get if state.exists else (-1, None, 0)
        rows = pd.concat(list(batches)).sort_values("frame_no", kind="stable")
        told = []
        for n, v in zip(rows.frame_no, rows.value, strict=True):
            if n <= last_no:
                continue
            if last is not None and abs(v - last) > threshold:
                shot += 1
            last_no, last = int(n), float(v)
            told.append((key[0], last_no, last, shot))
        state.update((last_no, last, shot))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(told, columns=[video, "frame_no", "value", "shot_id"])

    keyed = frames.selectExpr(f"CAST({video} AS STRING) AS {video}", f"CAST({no} AS LONG) AS frame_no", f"CAST({value} AS DOUBLE) AS value")
    return keyed.groupBy(video).applyInPandasWithState(run, out, "last_no long, last double, shot long", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


#: State of operators with timers lives in this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Shots(StatefulProcessor):
    """Of a video: frames that wait for the watermark, and the last one told with its shot."""

    def __init__(self, threshold: float, idle_ms: int | None):
        self.threshold, self.idle_ms = threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, frame_no long", "value double, copies int")
        self.last = handle.getValueState("last", "at long, value double, shot long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for batch in rows:
            for at, no, value in zip(batch["at"], batch["frame_no"], batch["value"], strict=True):
                place = (int(at), int(no))
                # of two frames of one number and time the smaller value stands, in whatever order they come
                known = self.waiting.getValue(place) if self.waiting.containsKey(place) else None
                self.waiting.updateValue(place, (float(value) if known is None else min(known[0], float(value)), 1))
                times.add(place[0])
        for at in times:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator() if k[0] <= now)
        at, before, shot = self.last.get() if self.last.exists() else (None, None, 0)
        told = []
        for at, no, value in ready:  # noqa: B020 - the last of them stays
            if before is not None and abs(value - before) > self.threshold:
                shot += 1
            before = value
            told.append((key[0], no, value, shot))
            self.waiting.removeKey((at, no))
        if ready:
            self.last.update((at, before, shot))
            if self.idle_ms is not None:
                self.handle.registerTimer(at + self.idle_ms)
        elif self.idle_ms is not None and at is not None and at + self.idle_ms <= now and next(iter(self.waiting.keys()), None) is None:
            self.last.clear()
        yield pd.DataFrame(told, columns=["video", "frame_no", "value", "shot_id"])

    def close(self) -> None:
        pass


def live_shots_by_time(frames: DataFrame, video: str, no: str, value: str, time: str, threshold: float, delay: str, idle_ms: int | None = None) -> DataFrame:
    """A stream of (video, frame_no, value, shot_id) by event time: frames may come up to `delay` late and in any order.

    A frame waits until the watermark has passed its time; then it is told after all that come before it, so the result
    does not depend on how frames fall into triggers. Only frames later than `delay` are dropped, by Spark's watermark. Frames are
    in order of time, then number; frames equal in both are one, of the least value; rows with a null in any of the four columns are left out.
    With `idle_ms` a video's last value and shot go once its watermark is so far past its last frame.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    named = frames.selectExpr(f"CAST(`{video}` AS STRING) AS video", f"CAST(`{no}` AS LONG) AS frame_no", f"CAST(`{value}` AS DOUBLE) AS value", f"CAST(`{time}` AS TIMESTAMP) AS time").dropna()
    timed = named.withWatermark("time", delay).selectExpr("video", "frame_no", "value", "unix_millis(time) AS at", "time")
    told = timed.groupBy("video").transformWithStateInPandas(_Shots(threshold, idle_ms), "video string, frame_no long, value double, shot_id long", "Append", "EventTime")
    return told.withColumnRenamed("video", video)
