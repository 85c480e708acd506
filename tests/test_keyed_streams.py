"""Keyed streams over several micro-batches with rows out of order and too late: the rows of the batch twin, and no state left."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cliploom.streaming import streams

T0 = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SCHEMA = "key long, id long, ts timestamp, stage string, percent int, score double"
STAGES = ["queued", " Uploading", "scoring", "completed", "error", "what", "processing"]
#: Seconds by which rows may be late, and the watermark for it.
DELAY, WATERMARK = 120, "120 seconds"


def made(seed=5, n=400):
    make = random.Random(seed)
    return [(make.randint(1, 6), i, T0 + dt.timedelta(seconds=make.randint(0, 4_000), milliseconds=make.choice([0, 250, 999])), make.choice(STAGES), make.randint(-5, 110), make.choice([None, 1.5, make.random()])) for i in range(n)]


def batches(rows):
    """Four batches: each takes the rows of its quarter of the time, some of them one batch late but inside the delay."""
    make, out = random.Random(2), [[], [], [], [], []]
    for row in rows:
        at = (row[2] - T0).total_seconds()
        k = int(at // 1_000)
        late = at % 1_000 > 1_000 - DELAY + 20 and make.random() < 0.5
        out[min(k + late, 4)].append(row)
    for part in out:
        make.shuffle(part)
    return out


def run(spark, tmp_path, name, job, parts):
    """Feed one file for each micro-batch; the sink's rows and the last progress."""
    source, keys = tmp_path / f"{name}-in", []
    source.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = None
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        if query is None:
            query = job(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
        query.processAllAvailable()
        keys.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    last = query.lastProgress
    query.stop()
    return sorted(map(tuple, spark.table(name).collect())), last, keys


JOBS = {
    "limits": (lambda s: streams.rate_limit_stream(s, "key", 3, 200, WATERMARK), lambda b: streams.rate_limit(b, "key", 3, 200)),
    "jobs": (lambda s: streams.progress_stream(s, "key", 500, WATERMARK), lambda b: streams.progress(b, "key", 500).drop("no")),
    "seen": (lambda s: streams.first_seen_stream(s, "key", 90, WATERMARK), lambda b: streams.first_seen(b, "key", 90)),
    "scores": (lambda s: streams.calibrator_stream(s, "key", 5, 300, WATERMARK), lambda b: streams.calibrations(b, "key", 5, 300)),
}


@pytest.mark.parametrize("name", JOBS)
def test_micro_batches_equal_the_batch_twin(spark, tmp_path, name):
    stream, twin = JOBS[name]
    rows = made()
    far = [(99, 10_000 + i, T0 + dt.timedelta(days=1, hours=i), "queued", 0, 0.5) for i in range(2)]
    too_late = [(1, 20_000, T0, "error", 100, 0.5)]
    got, last, held = run(spark, tmp_path, name, stream, [*batches(rows), far[:1], far[1:], too_late])
    want = sorted(map(tuple, twin(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert [r for r in got if r[0] != 99] == want and len(want) > 20
    assert max(held[:4]) > 0
    # Only the key of the last row, which the watermark has not passed, is left.
    assert last["stateOperators"][0]["numRowsDroppedByWatermark"] >= 1 or 20_000 not in [r[1] for r in got]
    left = spark.read.format("statestore").option("path", str(tmp_path / f"{name}-cp")).option("stateVarName", "memory").load()
    assert {r.key.key for r in left.collect()} <= {99}
    waiting = spark.read.format("statestore").option("path", str(tmp_path / f"{name}-cp")).option("stateVarName", "waiting").load()
    assert {r.key.key for r in waiting.collect()} <= {99}


def test_calibrations_follow_the_last_scores(spark):
    rows = [(1, i, T0 + dt.timedelta(seconds=100 * i), "", 0, s) for i, s in enumerate([0.5, 0.1, 0.9, 2.0, 0.3])]
    got = streams.calibrations(spark.createDataFrame(rows, SCHEMA), "key", 3, 10_000).orderBy("id")
    assert [(r.n, r.p10, r.p90) for r in got.collect()] == [(1, 0.5, 0.5), (2, 0.1, 0.5), (3, 0.1, 0.9), (3, 0.1, 0.9)]
    short = streams.calibrations(spark.createDataFrame(rows, SCHEMA), "key", 3, 150).orderBy(F.desc("id")).first()
    assert (short.n, short.p10) == (1, 0.3)
