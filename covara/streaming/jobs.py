"""Jobs as state machines over a stream of events: which transitions count, which jobs were abandoned, and how far each one is.

The state of a job is the last *accepted* state, so an event after an illegal one is judged as if that had not been. A batch form
folds the same rules over stored events.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

ABANDONED = "abandoned"


@dataclass(frozen=True)
class JobRules:
    """Which states may follow each one ("" before the first), after how many seconds without an accepted event an unfinished job is abandoned, and how late events may be.

    A state that nothing may follow is final.
    """

    steps: dict[str, tuple[str, ...]]
    seconds: float
    delay_seconds: float = 0

    def final(self, state: str) -> bool:
        return not self.steps.get(state)

    def expired(self, state: str, since: int | None, now: int) -> bool:
        return since is not None and not self.final(state) and now > since + int(self.seconds * 1e6)

    def expiry_ms(self, since: int) -> int:
        return since // 1000 + int(self.seconds * 1000) + 1

    def judge(self, events: list[tuple], state: str = "", since: int | None = None) -> tuple[list[tuple], str, int | None]:
        """(rows (order, state, before, accepted), state, since) after events (micros, order, state) of one job in order; a row without order says that it was abandoned."""
        out = []
        for at, order, to in events:
            if self.expired(state, since, at):
                out.append((None, ABANDONED, state, True))
                state = ABANDONED
            accepted = to in self.steps.get(state, ())
            out.append((order, to, state, accepted))
            if accepted:
                state, since = to, at
        return out, state, since


def _frame(key: str, order: str, values, rows: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*rows)) or [(), (), (), ()]
    return pd.DataFrame({key: [values] * len(rows), order: pd.array(columns[0], "Int64"), "state": columns[1], "before": columns[2], "accepted": columns[3]})


def _schema(key: str, order: str) -> str:
    return f"{key} bigint, {order} bigint, state string, before string, accepted boolean"


def _events(events: DataFrame, key: str, order: str, time: str, state: str, *more) -> DataFrame:
    at = F.col(time).cast("timestamp")
    return events.select(F.col(key).cast("bigint").alias(key), F.col(order).cast("bigint").alias(order), F.unix_micros(at).alias("micros"), F.col(state).cast("string").alias("to_state"), *more)


def judged(events: DataFrame, key: str, order: str, time: str, state: str, rules: JobRules) -> DataFrame:
    """key, order, state, before (the last accepted state) and accepted of every stored event, and a row without order for each abandoned job.

    Jobs are sorted by time, then order, within their task and read in batches, so no job's events are held together. A job that is
    silent at the end is abandoned if its time was over when the last of all events came, less the delay.
    """
    rows = _events(events, key, order, time, state)
    last = rows.agg(F.max("micros")).first()[0]
    now_ms = None if last is None else last // 1000 - int(rules.delay_seconds * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, job, state, since = False, None, "", None

        def ended() -> list[tuple]:
            return [(job, None, ABANDONED, state, True)] if since is not None and not rules.final(state) and rules.expiry_ms(since) <= now_ms else []

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)], names=[key, order, "state", "before", "accepted"])

        for batch in batches:
            out: list[tuple] = []
            for k, n, at, to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not known or k != job:
                    out += ended()
                    known, job, state, since = True, k, "", None
                found, state, since = rules.judge([(at, n, to)], state, since)
                out += [(k, *x) for x in found]
            yield batch_of(out)
        yield batch_of(ended())

    return rows.repartition(key).sortWithinPartitions(key, "micros", order).mapInArrow(run, _schema(key, order))


class _Machine(StatefulProcessor):
    """The last accepted state of a job and when it was reached; a timer for the time at which it counts as abandoned."""

    def __init__(self, key: str, order: str, rules: JobRules):
        self.key, self.order, self.rules = key, order, rules

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", StructType([StructField("state", StringType()), StructField("since", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["micros", self.order])
        state, since = self.state.get() if self.state.exists() else ("", None)
        found, state, since = self.rules.judge(list(zip(events["micros"].tolist(), events[self.order].tolist(), events["to_state"].tolist())), state, since)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if since is not None:
            self.state.update((state, since))
            if not self.rules.final(state):
                self.handle.registerTimer(self.rules.expiry_ms(since))
        yield _frame(self.key, self.order, key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, since = self.state.get()
        if self.rules.final(state):
            return
        self.state.update((ABANDONED, since))
        yield _frame(self.key, self.order, key[0], [(None, ABANDONED, state, True)])

    def close(self) -> None:
        pass


def judged_stream(events: DataFrame, key: str, order: str, time: str, state: str, rules: JobRules) -> DataFrame:
    """judged() over a stream whose batches follow each other in time; the session must use the RocksDB state store.

    A job that falls silent is abandoned when the watermark passes its time.
    """
    rows = _events(events, key, order, time, state, F.col(time).cast("timestamp").alias("event_time")).withWatermark("event_time", f"{int(rules.delay_seconds * 1000)} milliseconds")
    return rows.groupBy(key).transformWithStateInPandas(_Machine(key, order, rules), _schema(key, order), "Append", "EventTime")


class _Progress(StatefulProcessor):
    """The latest event of a job until its first final one, which closes it; a closed job is forgotten when the watermark has passed it by `keep`."""

    def __init__(self, key: str, order: str, finals: tuple[str, ...], keep_seconds: float):
        self.key, self.order, self.finals, self.keep = key, order, finals, int(keep_seconds * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", StructType([StructField("at", LongType()), StructField("order", LongType()), StructField("state", StringType()), StructField("closed", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, order, state, closed = now = self.state.get() if self.state.exists() else (None, None, None, 0)
        best = (at, order, state, closed)
        for frame in rows:
            for event in zip(frame["micros"].tolist(), frame[self.order].tolist(), frame["to_state"].tolist()):
                final = event[2] in self.finals
                if final and (not best[3] or event[:2] < best[:2]) or not final and not best[3] and (best[0] is None or event[:2] > best[:2]):
                    best = (*event, int(final))
        if best == tuple(now):
            return
        self.state.update(best)
        if best[3]:
            self.handle.registerTimer(best[0] // 1000 + self.keep)
        yield pd.DataFrame({self.key: [key[0]], self.order: [best[1]], "state": [best[2]], "at": [best[0]], "terminal": [bool(best[3])]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, key: str, order: str, time: str, state: str, finals: tuple[str, ...], keep_seconds: float, delay_seconds: float = 0) -> DataFrame:
    """key, order, state, at (micros) and terminal: a row for each job that changed in a batch, for a sink that puts rows in by key.

    A job's row is its latest event, and from its first final event on that one. State is kept for open jobs, and for closed ones until the watermark is `keep_seconds`
    past their end; an event of a job that comes later still opens it anew.
    """
    rows = _events(events, key, order, time, state, F.col(time).cast("timestamp").alias("event_time")).withWatermark("event_time", f"{int(delay_seconds * 1000)} milliseconds")
    return rows.groupBy(key).transformWithStateInPandas(_Progress(key, order, finals, keep_seconds), f"{key} bigint, {order} bigint, state string, at bigint, terminal boolean", "Update", "EventTime")
