"""Streams of poses: depth joined as it arrives, accelerations and filled gaps with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps several variables and timers for a key.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MOTION = "clip_key long, frame_index long, ts timestamp, value double, filled double, speed double, acceleration double"
#: Milliseconds of event time after which a clip that sends nothing more has ended, and how long rows wait for late ones before.
ENDED_MS = 3_600_000


def with_depth(poses: DataFrame, depth: DataFrame, late: str = "10 minutes", apart: str = "1 minute") -> DataFrame:
    """run, frame_number, ts, kp and depth: each pose with the depth of its frame, or with none once none can come any more.

    Both are streams with ts; frames of one number are at most ``apart`` from each other. The watermarks and that bound let Spark
    drop both sides' state.
    """
    left = poses.withWatermark("ts", late).alias("p")
    right = depth.select(F.col("run").alias("d_run"), F.col("frame_number").alias("d_frame"), F.col("ts").alias("d_ts"), "depth").withWatermark("d_ts", late)
    same = (F.col("run") == F.col("d_run")) & (F.col("frame_number") == F.col("d_frame"))
    near = F.expr(f"d_ts BETWEEN ts - INTERVAL {apart} AND ts + INTERVAL {apart}")
    return left.join(right, same & near, "left_outer").select("run", "frame_number", "ts", "kp", "depth")


class Motion(StatefulProcessor):
    """Of a clip: gaps filled between good samples, then speed and acceleration between adjacent samples.

    Samples (frame_index, ts, value, fps, flagged) wait in a list until the watermark has passed them, so late ones still take their
    place; then they are worked off in the order of frames. A flagged sample waits for the good one that ends its gap; when the clip ends by its
    timer, or no good one stands before it, it stays empty. State: waiting samples, the last good one, the last two results.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "frame_index long, ts_ms long, value double, fps double, flagged boolean")
        self.good = handle.getValueState("good", "frame_index long, value double")
        self.last = handle.getValueState("last", "value double, speed double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for pdf in rows:
            stamps = pdf["ts"].astype("datetime64[us]").astype("int64") // 1000
            fresh += [
                (int(i), int(t), None if pd.isna(v) else float(v), float(f), bool(g))
                for i, t, v, f, g in zip(pdf["frame_index"], stamps, pdf["value"], pdf["fps"], pdf["flagged"])
            ]
        out = self._work(key, fresh, timerValues.getCurrentWatermarkInMs(), False)
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        ended = not held or max(r[1] for r in held) + ENDED_MS <= now
        out = self._work(key, [], now, ended)
        if ended:
            self.waiting.clear()
            self.good.clear()
            self.last.clear()
        if len(out):
            yield out

    def _work(self, key, fresh: list[tuple], watermark: int, ended: bool) -> pd.DataFrame:
        held = sorted([*(tuple(r) for r in self.waiting.get()), *fresh])
        ready = len(held) if ended else next((k for k, r in enumerate(held) if r[1] > watermark), len(held))
        good = self.good.get() if self.good.exists() else None
        last = self.last.get() if self.last.exists() else (None, None)
        out, gap = [], []

        def give(row: tuple, filled: float | None) -> None:
            nonlocal last
            before, speed_before = last
            speed = None if before is None or filled is None else (filled - before) * row[3]
            change = None if speed is None or speed_before is None else (speed - speed_before) * row[3]
            out.append((key[0], row[0], row[1], row[2], filled, speed, change))
            last = (filled, speed)

        done = 0
        for k in range(ready):
            row = held[k]
            if row[4]:
                gap.append(row)
                continue
            if row[2] is not None:
                for g in gap:
                    give(g, None if good is None or not g[4] else good[1] + (row[2] - good[1]) * (g[0] - good[0]) / (row[0] - good[0]))
                gap, good = [], (row[0], row[2])
            elif gap:  # an empty sample inside a gap waits with it
                gap.append(row)
                continue
            give(row, row[2])
            done = k + 1
        if ended:
            for g in gap:
                give(g, None)
            done = ready
        rest = held[done:]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        if good is not None:
            self.good.update((good[0], good[1]))
        if out:
            self.last.update(last)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not ended:
            newest = max((r[1] for r in held), default=watermark)
            due = min((r[1] for r in rest if r[1] > watermark), default=newest + ENDED_MS)
            self.handle.registerTimer(max(due, watermark + 1))
        frame = pd.DataFrame(out, columns=["clip_key", "frame_index", "ts", "value", "filled", "speed", "acceleration"])
        frame["ts"] = pd.to_datetime(frame["ts"], unit="ms")
        return frame.astype({c: "float64" for c in ("value", "filled", "speed", "acceleration")})

    def close(self) -> None:
        pass


def motion(samples: DataFrame, late: str = "1 hour") -> DataFrame:
    """clip_key, frame_index, ts, value, filled, speed and acceleration of a stream of samples (clip_key, frame_index, ts, value, fps, flagged).

    The session must use a state store that keeps several variables (``STATE_STORE``). Samples later than ``late`` are left out.
    """
    marked = samples.select("clip_key", "frame_index", "ts", "value", "fps", "flagged").withWatermark("ts", late)
    return marked.groupBy("clip_key").transformWithStateInPandas(Motion(), MOTION, "Append", "EventTime")
