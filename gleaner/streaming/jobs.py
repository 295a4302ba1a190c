"""Jobs followed to their end: keyed state with timers over the stream of their progress events."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTCOME = "job_id BIGINT, outcome STRING, stage STRING, percent DOUBLE, events BIGINT, last_at TIMESTAMP"
#: Stages that end a job.
ENDS = ("done", "error")
#: Times are microseconds, which no time zone changes on the way to Python and back.
_TOLD = "job_id BIGINT, outcome STRING, stage STRING, percent DOUBLE, events BIGINT, last BIGINT"
_STATE = "stage STRING, percent DOUBLE, events BIGINT, last BIGINT, ended BOOLEAN"


class ToTheEnd(StatefulProcessor):
    """The latest event of each job, until one ends it: then a row says how. Repeated and older events count as seen but change nothing; those
    after the end are ignored. A job of which nothing is heard for ``idle`` milliseconds of event time is lost. The state of a job goes
    ``idle`` after its end."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def _again(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(at + self.idle)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.job.get() if self.job.exists() else None
        stage, percent, events, last, ended = held if held else (None, None, 0, None, False)
        if ended:
            return
        for row in sorted(rows, key=lambda r: (r["us"], r["stage"] in ENDS)):
            events += 1
            newer = last is None or (row["us"], row["percent"] or 0) >= (last, percent or 0)
            if newer or row["stage"] in ENDS:
                stage, percent, last = row["stage"], row["percent"], max(row["us"], last or row["us"])
            if row["stage"] in ENDS:
                ended = True
                break
        self.job.update((stage, percent, events, last, ended))
        self._again(last // 1000)
        if ended:
            yield Row(job_id=key[0], outcome=stage, stage=stage, percent=percent, events=events, last=last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.job.exists():
            stage, percent, events, last, ended = self.job.get()
            self.job.clear()
            if not ended:
                yield Row(job_id=key[0], outcome="lost", stage=stage, percent=percent, events=events, last=last)

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, late: str = "10 minutes", idle_minutes: int = 30) -> DataFrame:
    """``job_id, outcome, stage, percent, events, last_at``: a row for each job, once it is done, has failed or is lost. Events are those of
    :func:`progress.progress_source`; what is later than the watermark is dropped. Needs the RocksDB state store."""
    rows = events.where("at IS NOT NULL").withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    told = rows.groupBy("job_id").transformWithState(ToTheEnd(idle_minutes * 60_000), _TOLD, outputMode="Append", timeMode="EventTime")
    return told.withColumn("last", F.timestamp_micros("last")).withColumnRenamed("last", "last_at")
