"""The stream with timers equals a fold in plain Python, also when it is stopped and started again."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta
from unittest.mock import MagicMock

from tallyforge.streaming.silence import MissingProducts, stream_silence

START = datetime(2026, 1, 1)
HOURS = 5


def folded(rows, until):
    """(key, hour, evidence, misses, by_timer) by definition."""
    for key in sorted({r[0] for r in rows}):
        misses, due, said = 0, None, set()
        for _, run, evidence, guarded, hour in sorted((r for r in rows if r[0] == key), key=lambda r: (r[4], r[1])):
            if run in said:
                continue
            said.add(run)
            while due is not None and due < hour and misses < 3:
                misses += 1
                yield key, due, "NOT_DISCOVERED", misses, True
                due += HOURS
            misses = 0 if evidence == "SEEN" else misses + (evidence == "HTTP_404" and not guarded)
            yield key, hour, evidence, misses, False
            due = hour + HOURS
        while due < until and misses < 3:
            misses += 1
            yield key, due, "NOT_DISCOVERED", misses, True
            due += HOURS


def test_silence_with_a_restart(spark, tmp_path):
    rng = random.Random(6)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ddl = "key string, run long, evidence string, guarded boolean, at timestamp"
    rows = []
    for run in range(14):
        rows += [(f"k{k}", run, rng.choice(["SEEN", "SEEN", "HTTP_404", "TIMEOUT"]), rng.random() < 0.2, 2 * run) for k in range(5) if rng.random() < 0.5]
    rows += [("clock", run, "SEEN", False, 2 * run) for run in range(14)] + [("clock", 99, "SEEN", False, 60)]
    files = [sorted(r for r in rows if r[1] == run) for run in [*range(14), 99]]
    files[9] += files[3][:2]  # a replay

    def put(n):
        made = [(*r[:4], START + timedelta(hours=r[4])) for r in files[n]]
        spark.createDataFrame(made, ddl).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")

    def run():
        source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        query = stream_silence(source, timedelta(hours=HOURS)).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{tmp_path}/out")
        query.awaitTermination()

    for n in range(7):
        put(n)
    run()
    for n in range(7, len(files)):
        put(n)
    run()
    got = sorted((r.key, (r.at - START) / timedelta(hours=1), r.evidence, r.misses, r.by_timer) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    expected = sorted((k, float(h), e, m, t) for k, h, e, m, t in folded(rows, 60))
    assert got == [x for x in expected if x[0] != "clock" or not x[4] or x[1] < 60]
    assert any(x[4] for x in got) and {x[3] for x in got} == {0, 1, 2, 3}


def test_calls_of_the_state_store_do_not_grow_with_rows():
    """Each is a trip to the JVM and back: a key's rows of a batch take one to read, one to write and one for the timer."""
    handle, fold = MagicMock(), MissingProducts(timedelta(hours=HOURS))
    handle.getValueState.return_value.get.return_value = None
    fold.init(handle)
    handle.reset_mock()
    (said,) = fold.handleInputRows(("k",), iter([("k", run, "SEEN", False, START.replace(tzinfo=UTC) + timedelta(hours=6 * run)) for run in range(100)]), None)
    assert len(handle.mock_calls) + len(handle.getValueState.return_value.mock_calls) <= 6
    assert said.evidence == ["SEEN", *["NOT_DISCOVERED", "SEEN"] * 99] and said.misses == [0, *[1, 0] * 99] and len(said.since) == 199
