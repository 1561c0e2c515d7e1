"""Keyed state with timers: the polls of each feed in order of their times, whatever the order in which they come."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Where the state lives. Keyed state with timers needs this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "feed string, at timestamp, poll_id long, status string, failures int, escalate boolean"


@dataclass(frozen=True)
class Rules:
    """Milliseconds between two attempts at least; failures in a row that a person is told of; milliseconds without a success after which a feed counts as silent."""

    interval: int
    escalate: int = 8
    silent: int = 3 * 86_400_000


@dataclass
class Standing:
    """What is known of a feed: -1 for no time."""

    attempt: int = -1
    failures: int = 0
    success: int = -1
    told: bool = False

    def polled(self, at: int, poll_id: int, outcome: str, rules: Rules) -> Iterator[tuple]:
        """(at, poll_id, status, failures, escalate) of the next poll, after any silence before it."""
        yield from self.silence(at, rules)
        if 0 <= self.attempt and at - self.attempt < rules.interval:
            yield at, poll_id, "skipped_interval", self.failures, False
            return
        self.attempt = at
        if outcome == "failed":
            self.failures += 1
        else:
            self.failures, self.success, self.told = 0, at, False
        yield at, poll_id, outcome, self.failures, outcome == "failed" and self.failures >= rules.escalate

    def silence(self, now: int, rules: Rules) -> Iterator[tuple]:
        """One row when a feed has had no success for too long, at the time when that came true."""
        due = self.due(rules)
        if due is not None and due <= now:
            self.told = True
            yield due, None, "silent", self.failures, True

    def due(self, rules: Rules) -> int | None:
        return self.success + rules.silent if self.success >= 0 and not self.told else None


class Polls(StatefulProcessor):
    """Holds polls back until the watermark has passed them, then takes them in order of (time, id)."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standing = handle.getValueState("standing", "attempt long, failures int, success long, told boolean")
        self.waiting = handle.getMapState("waiting", "at long, poll_id long", "outcome string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in rows:
            self.waiting.updateValue((round(r["at"].timestamp() * 1e6), r["poll_id"]), (r["outcome"],))
        yield from self._passed(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._passed(key, timerValues)

    def _passed(self, key, times) -> Iterator[Row]:
        """What the watermark has passed; a timer is set for what comes next."""
        mark, standing = times.getCurrentWatermarkInMs(), Standing(*self.standing.get()) if self.standing.exists() else Standing()
        polls = sorted((at, poll_id, outcome[0]) for (at, poll_id), outcome in self.waiting.iterator())
        ready = [p for p in polls if p[0] // 1000 < mark]
        out = []
        for at, poll_id, outcome in ready:
            out += standing.polled(at // 1000, poll_id, outcome, self.rules)
            self.waiting.removeKey((at, poll_id))
        out += standing.silence(mark - 1, self.rules)
        self.standing.update((standing.attempt, standing.failures, standing.success, standing.told))
        later = [p[0] // 1000 for p in polls[len(ready) : len(ready) + 1]] + [d for d in [standing.due(self.rules)] if d is not None]
        for at in later:
            self.handle.registerTimer(max(at, mark) + 1)
        for at, poll_id, status, failures, escalate in out:
            yield Row(feed=key[0], at=_instant(at), poll_id=poll_id, status=status, failures=failures, escalate=escalate)

    def close(self) -> None:
        pass


def _instant(ms: int):
    from datetime import datetime

    return datetime.fromtimestamp(ms / 1000)


def outcomes(polls: DataFrame, rules: Rules, delay: str = "2 hours") -> DataFrame:
    """feed, at (whole milliseconds), poll_id, status, failures, escalate: a row for each poll of the stream, and one for each silence.

    polls: feed, at (timestamp), poll_id, outcome (failed, or any other word). A poll too soon after the feed's last
    attempt is skipped and changes nothing; failures count in a row over the others. Polls wait until the watermark,
    `delay` behind the latest, has passed them, so batches may hold them in any order; later ones than that are
    dropped. A feed's state is one row, its waiting polls, and a timer for the next of them or for its silence: it
    does not grow with the feed's history. Repeated poll_ids at one time count once.
    """
    schema = StructType.fromDDL(OUT)
    return polls.withWatermark("at", delay).groupBy("feed").transformWithState(Polls(rules), schema, "Append", "EventTime")


def replay(stream: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over what its source holds now and appends to the table in `folder`; run again it goes on from where it was."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
