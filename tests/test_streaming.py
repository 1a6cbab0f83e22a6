"""Streams over files give what the batch operators give."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from strophe.operators import events, frames, sections
from strophe.streaming import folds, series

START = dt.datetime(2024, 1, 1)


def source(spark, tmp_path):
    rows = [(u, START + dt.timedelta(seconds=s), float(s % 7)) for u in (1, 2) for s in (0, 5, 10, 11, 40, 41, 100)]
    spark.createDataFrame(rows, "k int, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    # A late row far ahead closes all windows before it.
    spark.createDataFrame([(9, START + dt.timedelta(days=1), 0.0)], "k int, ts timestamp, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(df, tmp_path, mode="append"):
    name = f"q{uuid.uuid4().hex}"
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable(), query.stop()
    return df.sparkSession.table(name)


def test_levels(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    got = {(r.k, r.start): r.rms_db for r in drained(series.levels(stream, "k", "ts", "v", "20 seconds", "1 second"), tmp_path).collect()}
    t = batch.withColumn("t", (F.unix_micros("ts") - F.unix_micros(F.lit(START))) / 1e6)
    want = {(r.k, START + dt.timedelta(seconds=r.t)): r.rms_db for r in frames.tumbling(t, "k", "t", "v", 20.0).where("k < 9").collect()}
    assert got == want


def test_sessions(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    got = sorted((r.k, r.start, r.end, r.samples) for r in drained(series.sessions(stream, ["k"], "ts", "5 seconds", "1 second"), tmp_path).collect())
    t = batch.withColumn("t", (F.unix_micros("ts") - F.unix_micros(F.lit(START))) / 1e6)
    want = sorted((r.k, START + dt.timedelta(seconds=r.start_t), START + dt.timedelta(seconds=r.end_t), r.samples) for r in events.merge_by_gap(t, ["k"], "t", 5.0).where("k < 9").collect())
    assert got == want


def shuffled(spark, tmp_path, rows, schema, batches=6):
    """A stream of files in which rows are dealt at random, and at last one row far ahead, of a key of its own."""
    rng = random.Random(1)
    parts = [[] for _ in range(batches)]
    for r in rows:
        parts[rng.randrange(batches)].append(r)
    folder, end = tmp_path / "shuffled", list(rows[0])
    end[0], end[1] = 99, START + dt.timedelta(days=9)
    for i, part in enumerate([*parts, [tuple(end)], [(98, START + dt.timedelta(days=10), *end[2:])]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
    files = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(files).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_boundaries_of_shuffled_batches(spark, tmp_path):
    rows = [(k, START + dt.timedelta(seconds=s), float((s * (k + 3)) % 11)) for k in (1, 2) for s in range(60)]
    stream = shuffled(spark, tmp_path, rows, "k int, ts timestamp, v double")
    got = sorted((r.k, r.at) for r in drained(folds.folded(stream, ["k"], "ts", folds.Boundaries("v", 4.5, 4), "2 days"), tmp_path).where("k < 9").collect())
    frames_ = spark.createDataFrame([(k, i, v, 0.0) for k in (1, 2) for i, (_, _, v) in enumerate(r for r in rows if r[0] == k)], "k int, frame long, rms_db double, bright double")
    cut = {(r.k, c) for r in sections.boundaries(frames_, "k", 4.5, 9.0, 4).collect() for c in r.cuts[:-1]}
    assert set(got) == cut and len(got) == len(cut) > 8


def test_gap_merge_with_running_confidence(spark, tmp_path):
    rng = random.Random(2)
    seconds = sorted(rng.sample(range(400), 60))
    rows = [(k, START + dt.timedelta(seconds=s), rng.choice(["low", "medium", "high"]), rng.choice([0.95, 0.78, 0.7, 0.85, 0.6])) for k in (1, 2) for s in seconds]
    stream = shuffled(spark, tmp_path, rows, "k int, ts timestamp, severity string, confidence double")
    got = sorted(tuple(r) for r in drained(folds.folded(stream, ["k"], "ts", folds.Merge(5.0), "2 days"), tmp_path).where("k < 9").collect())
    batch = spark.createDataFrame(rows, "k int, ts timestamp, severity string, confidence double").withColumn("t", (F.unix_micros("ts") - F.unix_micros(F.lit(START))) / 1e6)
    at = lambda s: START + dt.timedelta(seconds=s)
    want = sorted((r.k, at(r.start_t), at(r.end_t), r.samples, r.severity, r.confidence) for r in events.merge_by_gap(batch, ["k"], "t", 5.0).collect())
    assert got == want and len(got) > 10


def test_compaction_of_shuffled_batches(spark, tmp_path):
    rng = random.Random(3)
    rows, frame = [], 0
    for i in range(30):
        n = rng.choice([2, 3, 8, 12])
        rows.append((1, START + dt.timedelta(seconds=frame + n), frame, frame + n, n, rng.choice(["verse", "drop", "chorus"]), rng.choice([0.6, 0.72, 0.78])))
        frame += n
    schema = "k int, ts timestamp, first_frame long, last_frame long, n long, label string, confidence double"
    got = sorted(tuple(r)[1:] for r in drained(folds.folded(shuffled(spark, tmp_path, rows, schema), ["k"], "ts", folds.Compaction(5, 60.0), "2 days"), tmp_path).where("k < 9").collect())
    batch = spark.createDataFrame([(1, i, *r[2:]) for i, r in enumerate(rows)], "k int, section int, first_frame long, last_frame long, n long, label string, confidence double")
    want = sorted((r.first_frame, r.last_frame, r.n, r.label, r.confidence) for r in sections.compact(batch, "k", 5).collect())
    assert got == want and 5 < len(got) < 30


def test_late_rows_are_left_out(spark, tmp_path):
    folder = tmp_path / "late"
    at = lambda s: START + dt.timedelta(seconds=s)
    for i, part in enumerate([[(1, at(0), 1.0), (1, at(100), 9.0)], [(1, at(200), 1.0)], [(1, at(5), 50.0)], [(2, at(90000), 0.0)], [(2, at(99999), 0.0)]]):
        spark.createDataFrame(part, "k int, ts timestamp, v double").coalesce(1).write.parquet(str(folder / f"b{i}"))
    stream = spark.readStream.schema("k int, ts timestamp, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    got = sorted((r.k, r.at, r.value) for r in drained(folds.folded(stream, ["k"], "ts", folds.Boundaries("v", 4.0, 1), "10 seconds"), tmp_path).where("k = 1").collect())
    assert got == [(1, 0, 1.0), (1, 1, 9.0), (1, 2, 1.0)]  # the 50.0 of second 5 came when the watermark was at 190


def test_a_restarted_stream_repeats_nothing(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("files", "out", "mark"))
    for rows in ([(1,), (2,)], [(3,)], []):
        if rows:
            spark.createDataFrame(rows, "n long").write.mode("append").parquet(folder)
        series.resumable(spark.readStream.schema("n long").parquet(folder), out, mark)
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 2, 3]
