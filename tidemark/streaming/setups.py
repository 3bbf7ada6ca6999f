"""Setup states as a stream: state keyed by buckets of setups, event-time timers for expiry and for forgetting ended setups.

The processor needs the RocksDB state store; `setup_stream` sets it for the session.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.decisions import ACTIVE, ADVANCING

DAY_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the stream reads: detections (status known) and evaluations (status null) of setups. `tie` orders those of one time.
EVENT = "setup_id long, at timestamp, tie long, status string, reward_risk double, entry_score double, gate_passed boolean, broken boolean, blocked boolean, invalidation_reason string"
OUT = "setup_id long, at timestamp, status string, reason string, evaluated long, entry_score double"


def detections(setups: DataFrame) -> DataFrame:
    """setups (setup_id, detected_at, status) as events."""
    return _as_events(setups.select("setup_id", F.col("detected_at").alias("at"), F.lit(-1).alias("tie"), "status"))


def evaluations(told: DataFrame) -> DataFrame:
    return _as_events(told)


def _as_events(df: DataFrame) -> DataFrame:
    columns = [x.split() for x in EVENT.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns])


class SetupProcessor(StatefulProcessor):
    """The lives of a bucket of setups. Events wait until the watermark has passed them and are applied in order of time, tie and score, so
    how they were dealt to micro-batches makes no difference; what waits is bounded by the watermark's delay. A setup's next due time is
    the earliest waiting event, the deadline, or the time to forget it once ended; a single timer stands for the earliest of the bucket.

    A bucket's setups are one value of the state: a call of the state store costs more than a setup's whole life does.
    """

    def __init__(self, max_age_days: int, min_reward_risk: float, forget_days: int):
        self.max_age, self.least, self.forget = max_age_days * DAY_MS, min_reward_risk, forget_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "setups binary, timer long")

    def _read(self) -> tuple[dict[int, list], int | None]:
        """Of each setup [detected, status, reason, evaluated, entry score, time to forget it, due, waiting events]; and the timer."""
        if not self.bucket.exists():
            return {}, None
        packed, timer = self.bucket.get()
        return pickle.loads(bytes(packed)), timer

    def _write(self, setups: dict[int, list], timer: int | None) -> None:
        """Keeps the setups, with the timer at the earliest time due."""
        at = min((s[6] for s in setups.values() if s[6] is not None), default=None)
        if timer is not None and timer != at:
            self.handle.deleteTimer(timer)
        if at is not None and timer != at:
            self.handle.registerTimer(at)
        if setups:
            self.bucket.update((pickle.dumps(setups, pickle.HIGHEST_PROTOCOL), at))
        else:
            self.bucket.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        setups, timer = self._read()
        for r in rows:
            if r.at is None:
                continue
            s = setups.get(r.setup_id)
            if s is None:
                s = setups[r.setup_id] = [None, None, None, 0, None, None, None, []]
            if s[5] is None:
                at = int(r.at.timestamp() * 1000)
                s[7].append((at, r.tie or 0, r.status, r.reward_risk, r.entry_score, r.gate_passed, r.broken, r.blocked, r.invalidation_reason))
                s[6] = at if s[6] is None else min(s[6], at)
        self._write(setups, timer)
        return iter(())

    def _apply(self, s: list, event: tuple) -> None:
        at, _, status, reward_risk, score, passed, broken, blocked, own = event
        if s[0] is None:
            if status is not None:
                s[0], s[1] = at, status
            return
        if status is not None or s[1] not in ACTIVE:
            return
        s[3], s[4] = s[3] + 1, score
        if broken or own:
            s[1], s[2] = "invalidated", own or "setup_context_broken"
        elif blocked or not (reward_risk is not None and reward_risk >= self.least):
            s[1], s[2] = "invalidated", "non_recoverable_or_reward_risk_failed"
        elif at >= s[0] + self.max_age:
            s[1], s[2] = "expired", "max_age_days_exceeded"
        elif passed and s[1] in ADVANCING:
            s[1], s[2] = "entry_ready", "entry_gate_passed"

    def _advance(self, s: list, now: int) -> int | None:
        """Applies what is due; the time of the last change, if the setup's state has changed."""
        before, last = s[1:5], None
        for event in sorted((x for x in s[7] if x[0] <= now), key=lambda x: (x[0], x[1], x[4] if x[4] is not None else 0.0)):
            deadline = None if s[0] is None else s[0] + self.max_age
            if s[1] in ACTIVE and deadline is not None and event[0] > deadline:
                break
            known = s[0] is not None
            self._apply(s, event)
            last = event[0] if s[0] is not None and (s[1] in ACTIVE or known) else last
        if s[0] is not None and s[1] in ACTIVE and s[0] + self.max_age <= now:
            s[1], s[2], last = "expired", "max_age_days_exceeded", s[0] + self.max_age
        s[7] = [x for x in s[7] if x[0] > now]
        if s[0] is not None and s[1] not in ACTIVE:
            # Ended: nothing counts any more; it is remembered for a while, so that late evaluations don't start it anew.
            s[5], s[7] = max(now, last or now) + self.forget, []
        ends = [] if s[0] is None else [s[5]] if s[5] is not None else [s[0] + self.max_age] if s[1] in ACTIVE else []
        s[6] = min((*(x[0] for x in s[7]), *ends), default=None)
        return (last if last is not None else s[0]) if s[0] is not None and s[1:5] != before else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        setups, timer = self._read()
        # A timer that has run out is gone; the bucket may have been worked on since it was set.
        timer = None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer
        out = []
        for i, s in [(i, s) for i, s in setups.items() if s[6] is not None and s[6] <= now]:
            if s[5] is not None:
                del setups[i]
                continue
            at = self._advance(s, now)
            if at is not None:
                out.append(Row(setup_id=i, at=_time(at), status=s[1], reason=s[2], evaluated=s[3], entry_score=s[4]))
            if s[0] is None and not s[7]:
                del setups[i]  # evaluations of a setup that was never detected
        self._write(setups, timer)
        return iter(out)

    def close(self) -> None:
        pass


def _time(ms: int):
    import datetime

    return datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc)


def setup_stream(events: DataFrame, late: str = "36 hours", max_age_days: int = 5, min_reward_risk: float = 3.0, forget_days: int = 30, buckets: int = 16_384) -> DataFrame:
    """A row (OUT) whenever a setup's state has changed: `setup_states` under a clock, as a stream.

    events: EVENT, of `detections` and `evaluations`. The clock is the watermark: a setup expires when it passes the deadline, with
    or without an evaluation. Events that come later than `late` are lost; evaluations before their setup's detection don't count.
    Times count in milliseconds. Ended setups are forgotten after forget_days. The state is keyed by buckets of setups, whose number a
    checkpoint fixes; a task holds one bucket.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    bucketed = events.withWatermark("at", late).withColumn("_bucket", F.pmod(F.xxhash64("setup_id"), F.lit(buckets)))
    return bucketed.groupBy("_bucket").transformWithState(SetupProcessor(max_age_days, min_reward_risk, forget_days), OUT, "Append", "EventTime")


def latest(changes: DataFrame) -> DataFrame:
    """Each setup's state after all its changes."""
    # Evaluations only add up, and a setup that ends does so last.
    order = F.struct("at", "evaluated", (~F.col("status").isin(ACTIVE)).alias("ended"))
    return changes.groupBy("setup_id").agg(*[F.max_by(c, order).alias(c) for c in ("status", "reason", "evaluated", "entry_score")])
