"""Keyed state: the session loop, first log entries and the placeholder registry.

The processors hold a few values per key in state and pass their input by in Arrow batches;
none keeps the rows of a key. The session loop and the first entries wait for the watermark,
so that what they give does not depend on the order in which rows arrive within the delay.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import MAX_STEPS, stage_status
from .common import keyed_state

STEPS = ("session_id", "record_id", "step", "stage", "status")
_STAGES = {"blocked": "privacy_firewall", "error": "planner", "completed": "loop_action",
           "idle": "loop_action"}


class SessionLoop(StatefulProcessor):
    """Step count and end flag of one session, and its earliest records that the watermark has
    not passed yet. Each record uses a step or ends the session, so eleven are enough to hold.
    They are decided in event order when the watermark has passed them. A session of which
    nothing is left to decide and nothing came for ``forget_ms`` leaves no state."""

    def __init__(self, forget_ms: int) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "loop", T.StructType([
                T.StructField("step", T.IntegerType()), T.StructField("ended", T.BooleanType()),
                T.StructField("latest", T.LongType()), T.StructField("timer", T.LongType()),
            ]),
        )
        self.waiting = handle.getListState(
            "waiting", T.StructType([
                T.StructField("at_us", T.LongType()), T.StructField("record_id", self.record),
                T.StructField("kind", T.StringType()),
            ]),
        )

    record = T.LongType()

    def _wait(self, step: int, ended: bool, latest: int, timer: int, rows: list[tuple]) -> None:
        """Keep what is left, and wake when the watermark has passed the next record, or else
        when the session has been quiet."""
        wake = rows[0][0] // 1000 if rows else latest + self.forget_ms
        if wake != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wake)
        if rows:
            self.waiting.put(rows)
        else:
            self.waiting.clear()
        self.state.update((step, ended, latest, wake))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):  # noqa: N802, N803
        step, ended, latest, timer = self.state.get() if self.state.exists() else (0, False, 0, -1)
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for batch in rows:
            latest = max(latest, int(batch["at_us"].max()) // 1000)
            if not ended:
                fields = zip(batch["at_us"].tolist(), batch["record_id"].tolist(), batch["kind"], strict=True)
                held = heapq.nsmallest(MAX_STEPS + 1, [*held, *fields])
        self._wait(step, ended, latest, timer, held)
        yield pd.DataFrame([], columns=list(STEPS))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        step, ended, latest, timer = self.state.get()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        passed = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        out = []
        while held and held[0][0] // 1000 <= passed:
            _, record, kind = held.pop(0)
            step += kind in ("step", "rejected", "failed")
            status = "success" if kind == "step" else kind
            if kind == "step" and step >= MAX_STEPS:
                status = "max_steps_reached"
            ended = status != "success"
            out.append((key[0], record, step, _STAGES.get(kind, "action_execution"), status))
            if ended:
                held = []
        if not held and passed >= latest + self.forget_ms:
            self.state.clear()
            self.waiting.clear()
        else:
            # a timer that fired is gone
            self._wait(step, ended, latest, -1 if fired == timer else timer, held)
        yield pd.DataFrame(out, columns=list(STEPS))

    def close(self) -> None:
        pass


def session_loop(records: DataFrame, delay: str = "10 minutes", forget_minutes: int = 31 * 24 * 60) -> DataFrame:
    """Streaming form of ``session_steps``: the records that were reached, decided in the order
    of ``ts`` and ``record_id`` once the watermark, ``delay`` behind the latest record, has
    passed them. Records behind the watermark are left out (``common.late_rows``). A session is
    forgotten when it has been quiet for ``forget_minutes``; records that come later begin anew.
    """
    keyed_state(records.sparkSession)
    timed = records.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    slim = timed.select(
        "session_id", "ts", F.col("record_id").cast("long").alias("record_id"),
        F.unix_micros("ts").alias("at_us"), F.expr(stage_status()).alias("kind"),
    )
    return slim.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=SessionLoop(forget_minutes * 60_000),
        outputStructType=T.StructType([
            slim.schema["session_id"], slim.schema["record_id"], T.StructField("step", T.IntegerType()),
            T.StructField("stage", T.StringType()), T.StructField("status", T.StringType()),
        ]),
        outputMode="Append", timeMode="EventTime",
    )


class FirstEntries(StatefulProcessor):
    """The least event time of each (target, category) of one scan; given out when the watermark
    has passed it, so that no earlier one can come. After that only the fact is kept, until the
    key has been quiet for ``forget_ms``.

    A scan's keys lie in one value, as JSON, with one timer: a scan has as many as its elements
    have categories, and asking the state store for each alone costs a few calls a key."""

    def __init__(self, forget_ms: int) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "entries", T.StructType([T.StructField("entries", T.StringType()), T.StructField("timer", T.LongType())])
        )

    def _load(self) -> tuple[dict[tuple, tuple], int]:
        held = self.state.get()
        if held is None:
            return {}, -1
        return {(target, category): tuple(entry) for target, category, *entry in json.loads(held[0])}, held[1]

    def _wait(self, entries: dict[tuple, tuple], timer: int) -> None:
        wake = min(latest + self.forget_ms if given else first // 1000 for first, given, latest in entries.values())
        if wake != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wake)
        self.state.update((json.dumps([(*key, *entry) for key, entry in entries.items()]), wake))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):  # noqa: N802, N803
        entries, timer = self._load()
        for batch in rows:
            for target, category, at in zip(batch["target"], batch["category"], batch["at_us"].tolist(), strict=True):
                at = int(at)
                first, given, latest = entries.get((target, category), (at, False, 0))
                entries[target, category] = (first if given else min(first, at), given, max(latest, at // 1000))
        self._wait(entries, timer)
        yield pd.DataFrame([], columns=["scan_id", "target", "category", "first_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        entries, timer = self._load()
        passed = timerValues.getCurrentWatermarkInMs()
        out, left = [], {}
        for name, (first, given, latest) in entries.items():
            if not given and first // 1000 <= passed:
                out.append((*key, *name, first))
                given = True
            if not (given and latest + self.forget_ms <= passed):
                left[name] = (first, given, latest)
        if left:
            # a timer that fired is gone
            self._wait(left, -1 if expiredTimerInfo.getExpiryTimeInMs() == timer else timer)
        else:
            self.state.clear()
        yield pd.DataFrame(out, columns=["scan_id", "target", "category", "first_us"])

    def close(self) -> None:
        pass


def first_entries(log: DataFrame, event_time: str = "ts", delay: str = "10 minutes", forget_minutes: int = 31 * 24 * 60) -> DataFrame:
    """(scan_id, target, category, ``event_time``): the earliest entry of each key by event time,
    whatever the order of arrival within ``delay``. A key is forgotten when it has been quiet
    for ``forget_minutes``."""
    keyed_state(log.sparkSession)
    keys = ["scan_id", "target", "category"]
    timed = log.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    slim = timed.select(*keys, event_time, F.unix_micros(event_time).alias("at_us"))
    found = slim.where(F.col("at_us").isNotNull()).groupBy("scan_id").transformWithStateInPandas(
        statefulProcessor=FirstEntries(forget_minutes * 60_000),
        outputStructType=T.StructType([*(slim.schema[k] for k in keys), T.StructField("first_us", T.LongType())]),
        outputMode="Append", timeMode="EventTime",
    )
    return found.select(*keys, F.timestamp_micros("first_us").alias(event_time))


REGISTRY = ("scan_id", "prefix", "token", "n")


class Registry(StatefulProcessor):
    """token -> number for one (scan, prefix). Numbers once given never change; a value
    that turns up later gets the next one. When event time has passed the scan's last
    event by ``quiet_ms``, its tokens are forgotten but the last number is kept: no number
    is ever given to two values, and a value that comes back gets a new one."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getMapState(
            "numbers", T.StructType([T.StructField("token", T.StringType())]),
            T.StructType([T.StructField("n", T.LongType())]),
        )
        self.count = handle.getValueState(
            "count", T.StructType([
                T.StructField("n", T.LongType()), T.StructField("ends", T.LongType()),
            ]),
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):  # noqa: N802, N803
        first: dict[str, tuple] = {}
        latest = 0
        for batch in rows:
            latest = max(latest, int(batch["at_ms"].max()))
            for token, position, seq in zip(
                batch["token"], batch["position"], batch["seq"], strict=True
            ):
                place = (position, seq)
                if token not in first or place < first[token]:
                    first[token] = place
        n, ends = self.count.get() if self.count.exists() else (0, 0)
        out = []
        for token in sorted(first, key=first.get):
            if self.numbers.containsKey((token,)):
                continue
            n += 1
            self.numbers.updateValue((token,), (n,))
            out.append((key[0], key[1], token, n))
        if latest + self.quiet_ms > ends:
            if ends:
                self.handle.deleteTimer(ends)
            ends = latest + self.quiet_ms
            self.handle.registerTimer(ends)
        self.count.update((n, ends))
        yield pd.DataFrame(out, columns=list(REGISTRY))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        n, _ = self.count.get()
        self.numbers.clear()
        self.count.update((n, 0))
        yield pd.DataFrame([], columns=list(REGISTRY))

    def close(self) -> None:
        pass


def token_registry(
    events: DataFrame, event_time: str = "ts", delay: str = "1 hour", quiet_minutes: int = 24 * 60
) -> DataFrame:
    """Streaming form of the numbering: new (scan, prefix, token, n) as they are given out.

    ``events``: scan_id, prefix, token, position, seq and the event time - digests, never
    raw values. State is bounded by the watermark: of a quiet scan a number is left. Rows
    behind the watermark get no number; ``common.late_rows`` counts them.
    """
    keyed_state(events.sparkSession)
    timed = events.withWatermark(event_time, delay).withColumn("at_ms", F.unix_millis(event_time))
    return timed.groupBy("scan_id", "prefix").transformWithStateInPandas(
        statefulProcessor=Registry(quiet_minutes * 60_000),
        outputStructType=T.StructType([
            timed.schema["scan_id"], timed.schema["prefix"], timed.schema["token"],
            T.StructField("n", T.LongType()),
        ]),
        outputMode="Append", timeMode="EventTime",
    )
