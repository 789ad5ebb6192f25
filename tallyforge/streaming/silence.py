"""Missing products as a stream with timers: a product that nothing names for a while counts as missing.

Observations (key, run, evidence, guarded, at) are folded as by quality.missing_states, and a product of which
`silence` passes without an observation gets the evidence NOT_DISCOVERED by a timer, again and again until it is a
candidate. What happens depends on event time alone: silence that was due before an observation counts before it,
whether its timer has fired or the observation came first; after a key's last observation silence counts that
was due by the watermark.

State of a key: one value of the misses, when silence is due, the evidence since the last sighting, and the runs that
were counted, so that replayed rows count once; runs older than `keep` before the newest are dropped from it. It is
one value since every call to the state store is a trip from Python to the JVM and back: a key's rows of a batch take one
to read it and one to write it, however many they are; the timer is known from it (at `due`, unless the product is a
candidate), and all that is said of a key at once is one row, until the JVM has it. Time to live is of processing time
only in Spark, so entries go by run number instead. The state store must be RocksDB; a query that starts again from
its checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyforge.operators.quality import CONFIRMED_MISSING
from tallyforge.streaming.missing import _state_of

SAID = ("ms", "evidence", "misses", "state", "by_timer", "since")
#: What a call says of a key, as one row of lists.
OUTPUT = "key string, ms array<long>, evidence array<string>, misses array<long>, state array<string>, by_timer array<boolean>, since array<array<string>>"
SILENT = "NOT_DISCOVERED"
Said = Row("key", *SAID)
EPOCH, MS = datetime(1970, 1, 1, tzinfo=UTC), timedelta(milliseconds=1)


class MissingProducts(StatefulProcessor):
    """One key's fold; times are milliseconds. Rows have key, run, evidence, guarded and at."""

    def __init__(self, silence: timedelta, warning_at: int = 2, candidate_at: int = 3, keep: int = 100):
        self.silence, self.warning_at, self.candidate_at, self.keep = round(silence.total_seconds() * 1000), warning_at, candidate_at, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "misses long, due long, since array<string>, runs array<long>")

    def _one(self, at: int, evidence: str, misses: int, by_timer: bool, since: list[str]) -> tuple:
        return at, evidence, misses, _state_of(misses, self.warning_at, self.candidate_at), by_timer, since[:]

    def _silent(self, said: list[tuple], misses: int, due: int, since: list[str], until: int) -> tuple[int, int]:
        """Misses and the next due time after the silence that is due up to `until`, as long as the product isn't a candidate."""
        while due <= until and misses < self.candidate_at:
            misses += 1
            since.append(SILENT)
            said.append(self._one(due, SILENT, misses, True, since))
            due += self.silence
        return misses, due

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        misses, due, since, runs = self.now.get() or (0, None, [], [])
        since, counted, said = list(since), set(runs), []
        timer = due if misses < self.candidate_at else None
        for at, run, evidence, guarded in sorted((((at - EPOCH) // MS, run, evidence, guarded) for _, run, evidence, guarded, at in rows), key=itemgetter(0, 1)):
            if run in counted:
                continue
            counted.add(run)
            if due is not None:
                misses, due = self._silent(said, misses, due, since, at - 1)
            if evidence == "SEEN":
                misses = 0
                since.clear()
            elif evidence in CONFIRMED_MISSING and not guarded:
                misses += 1
                since.append(evidence)
            due = at + self.silence
            said.append(self._one(at, evidence, misses, False, since))
        last = max(counted) - self.keep
        self.now.update((misses, due, since, [run for run in counted if run > last]))
        silent_at = due if misses < self.candidate_at else None
        if timer != silent_at:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if silent_at is not None:
                self.handle.registerTimer(silent_at)
        if said:
            yield Said(key[0], *map(list, zip(*said, strict=True)))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        misses, due, since, runs = self.now.get()
        since, said = list(since), []
        misses, due = self._silent(said, misses, due, since, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        self.now.update((misses, due, since, list(runs)))
        if misses < self.candidate_at:  # the expired one goes by itself
            self.handle.registerTimer(due)
        if said:
            yield Said(key[0], *map(list, zip(*said, strict=True)))


def stream_silence(observations: DataFrame, silence: timedelta, late: str = "0 seconds", **limits: int) -> DataFrame:
    """(key, at, evidence, misses, state, by_timer, since) for every observation and every silence.

    observations: key, run, evidence, guarded, at; those of a key come in order of `at`.
    """
    rows = observations.select("key", "run", "evidence", "guarded", F.col("at").cast("timestamp").alias("at"))
    folded = rows.withWatermark("at", late).groupBy("key").transformWithState(MissingProducts(silence, **limits), OUTPUT, "append", "EventTime")
    told = folded.select("key", F.inline(F.arrays_zip(*SAID)))
    return told.select("key", F.timestamp_millis("ms").alias("at"), "evidence", "misses", "state", "by_timer", "since")
