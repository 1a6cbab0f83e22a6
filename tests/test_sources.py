import json
import math
import struct
import wave

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.sources import audio, cache, records, sinks


def write_wav(path, seconds, hz, rate=8000, channels=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        for i in range(int(seconds * rate)):
            w.writeframesraw(struct.pack("<h", int(0.5 * 32767 * math.sin(2 * math.pi * hz * i / rate))) * channels)


def test_wav_probe_and_frames(spark, tmp_path):
    write_wav(tmp_path / "a.wav", 2.2, 1000)
    (tmp_path / "b.WAV").write_bytes(b"no audio")
    (tmp_path / "c.txt").write_text("x")
    assert [r.name for r in audio.listing(spark, str(tmp_path)).orderBy("name").collect()] == ["a.wav", "b.WAV"]
    got = {r.path[-5:]: r for r in audio.probe(spark, str(tmp_path)).collect()}
    assert (got["a.wav"].duration, got["a.wav"].sample_rate, got["a.wav"].channels, got["a.wav"].bit_depth) == (2.2, 8000, 2, 16) and got["b.WAV"].error
    assert (got["a.wav"].codec, got["a.wav"].format, got["a.wav"].bitrate) == ("pcm_s16le", "wav", int((17600 * 4 + 44) * 8 / 2.2))
    rows = audio.frames(spark, str(tmp_path)).orderBy("frame").collect()
    assert [r.t for r in rows] == [0.0, 1.0, 2.0]
    assert abs(rows[0].rms_db + 9.03) < 0.05 and abs(rows[0].crest_db - 3.01) < 0.05
    assert rows[0].mid_db > max(rows[0].sub_db, rows[0].bass_db, rows[0].air_db)


def test_listings_merge_with_the_last_entry(spark):
    a = spark.createDataFrame([("/x/B.wav", "B.wav", 1), ("/x/a.wav", "a.wav", 1)], "path string, name string, length long")
    b = spark.createDataFrame([("/x/B.wav", "B.wav", 2)], "path string, name string, length long")
    assert [(r.name, r.length) for r in audio.merged_listing(a, b).collect()] == [("a.wav", 1), ("B.wav", 2)]


def test_corpus_keeps_records_and_reports_bad_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "1", "text": "one", "word_count": 1}\n\nnot json\n{"id": "2", "text": "  "}\n')
    good, bad = records.corpus(spark, str(tmp_path))
    assert [r.id for r in good.collect()] == ["1"] and [r.line for r in bad.collect()] == ["not json"]


def test_artifacts_history_and_renamed_keys(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "song.guard.json").write_text(json.dumps({"ok": True}))
    rows = records.artifacts(spark, str(tmp_path), "guard", T.StructType([T.StructField("ok", T.BooleanType())]))
    assert [(r.stem, r.ok) for r in rows.collect()] == [("song", True)]
    sinks.append_history(spark.range(2).toDF("n"), str(tmp_path / "h"))
    sinks.append_history(spark.range(1).toDF("n"), str(tmp_path / "h"))
    assert records.history(spark, str(tmp_path / "h"), T.StructType([T.StructField("n", T.LongType())])).count() == 3
    maps = spark.createDataFrame([({"old": 1, "x": 2},), ({"old": 1, "new": 3},)], "m map<string,int>")
    assert sorted(sorted(r.m.items()) for r in records.renamed_keys(maps, "m", {"old": "new"}).collect()) == [[("new", 1), ("x", 2)], [("new", 3), ("old", 1)]]


def test_cache_hits_and_misses(spark):
    bands = {f"b{i}": -20.0 for i in range(6)}
    held = spark.createDataFrame([("a", 2, bands), ("b", 1, bands), ("c", 2, {k: -70.0 for k in bands})], "content_key string, schema_version int, band_stats map<string,double>")
    hits, misses = records.cached(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "content_key string"), held)
    assert [r.content_key for r in hits.collect()] == ["a"] and sorted(r.content_key for r in misses.collect()) == ["b", "c", "d"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "hi"\\', -14.126)], "track string, note string, lufs double")
    text = df.select(sinks.toml({"before": {"note": F.col("note"), "lufs": F.col("lufs")}}, {"note"})).first()[0]
    assert text == '[before]\nnote = "say \\"hi\\"\\\\"\nlufs = -14.13'
    assert df.select(sinks.markdown(F.col("track"), {"LUFS": F.col("lufs"), "LRA": F.lit(None)})).first()[0] == "# a\n\n- **LUFS**: -14.126\n- **LRA**: n/a"
    sinks.json_reports(df, str(tmp_path / "j"), "track")
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_decoded_segments(spark, tmp_path):
    write_wav(tmp_path / "a.wav", 2.0, 100, rate=1000)
    whole = audio.decoded(spark, str(tmp_path), chunk=600).orderBy("first").collect()
    assert [(r.first, len(r.left)) for r in whole] == [(0, 600), (600, 600), (1200, 600), (1800, 200)] and whole[0].left == whole[0].right
    flat = [x for r in whole for x in r.mono]
    middle = audio.decoded(spark, str(tmp_path), seconds=0.5, center=True).first()
    assert list(middle.mono) == flat[750:1250]
    slow = audio.decoded(spark, str(tmp_path), rate=500).first()
    assert slow.sample_rate == 500 and len(slow.mono) == 1000 and max(abs(a - b) for a, b in zip(list(slow.mono)[100:-100], flat[200:-200:2], strict=True)) < 1e-3  # a tone below the cut


def test_cache_puts_invalidations_and_size(spark, tmp_path):
    path = str(tmp_path / "cache")
    entry = lambda k, v: spark.createDataFrame([(k, v)], "content_key string, rms double")
    assert cache.entries(spark, path) is None and cache.size(spark, path) == (0, 0)
    cache.put(entry("a", -1.0), path), cache.put(entry("b", -2.0), path), cache.put(entry("a", -3.0), path)
    assert sorted((r.content_key, r.rms, r.schema_version) for r in cache.entries(spark, path).collect()) == [("a", -3.0, 2), ("b", -2.0, 2)]
    cache.invalidate(spark.createDataFrame([("b",), ("never",)], "content_key string"), path)
    n, size = cache.size(spark, path)
    assert n == 1 and size > 0
    cache.put(entry("b", -4.0).unionAll(entry("b", -9.0)).unionAll(entry(None, 1.0)), path)
    assert sorted((r.content_key or "", r.rms) for r in cache.entries(spark, path).collect()) == [("", 1.0), ("a", -3.0), ("b", -4.0)]
    assert cache.clear(spark, path) == 3 and cache.entries(spark, path).count() == 0
    cache.put(entry("z", 0.0), path)
    assert cache.entries(spark, path).count() == 1


def folders(path):
    return {p.relative_to(path).as_posix() for p in path.glob("data/*/_bucket=*")}


def test_a_change_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = tmp_path / "cache"
    cache.put(spark.range(2000).selectExpr("md5(string(id)) AS content_key", "id * 1.0 AS rms"), str(path))
    first = folders(path)
    assert len(first) == cache.BUCKETS
    some = spark.range(3).selectExpr("md5(string(id)) AS content_key", "-1.0D AS rms")
    touched = some.select(cache.bucket_of(F.col("content_key")).alias("b")).distinct().count()
    cache.put(some, str(path))
    assert len(folders(path) - first) == touched <= 3 and cache.entries(spark, str(path)).where("rms = -1").count() == 3 and cache.entries(spark, str(path)).count() == 2000
    assert cache.vacuum(spark, str(path)) == touched and len(folders(path)) == cache.BUCKETS and cache.entries(spark, str(path)).count() == 2000
    assert max(sum(1 for _ in p.glob("*.parquet")) for p in path.glob("data/*/_bucket=*")) == 1


def test_a_reader_sees_a_cache_before_or_after_a_change(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache.put(spark.range(500).selectExpr("md5(string(id)) AS content_key", "1.0D AS rms"), path)
    before = cache.entries(spark, path)  # opened before, read after
    cache.put(spark.range(500).selectExpr("md5(string(id)) AS content_key", "2.0D AS rms"), path)
    assert [tuple(r) for r in before.groupBy("rms").count().collect()] == [(1.0, 500)] and [tuple(r) for r in cache.entries(spark, path).groupBy("rms").count().collect()] == [(2.0, 500)]
    number, told = cache.current(spark, path)
    with pytest.raises(cache.Conflict):  # another change came first
        cache._publish(spark, path, number, told)
    assert not list((tmp_path / "cache/_lists").glob(".[0-9]*-*[!c]")) and cache.current(spark, path) == (number, told)


def test_reports_are_published_all_or_none(spark, tmp_path):
    rows = spark.range(20, numPartitions=4).selectExpr("concat('t', id) AS track", "id * 1.5 AS lufs")
    sinks.report_pairs(rows, str(tmp_path / "ok"), "track", "guard", {"LUFS": F.col("lufs")})
    assert sorted(p.name for p in (tmp_path / "ok").iterdir()) == sorted(f"t{i}.guard.{k}" for i in range(20) for k in ("json", "md"))
    assert json.loads((tmp_path / "ok/t3.guard.json").read_text()) == {"track": "t3", "lufs": 4.5} and (tmp_path / "ok/t3.guard.md").read_text().endswith("- **LUFS**: 4.5")
    for bad in (rows.withColumn("lufs", F.when(F.col("track") == "t17", F.raise_error(F.lit("no"))).otherwise(F.col("lufs"))), rows.unionAll(rows.limit(1))):
        with pytest.raises(Exception, match="no|stem"):
            sinks.report_pairs(bad, str(tmp_path / "bad"), "track", "guard", {"LUFS": F.col("lufs")})
        assert not [p for p in (tmp_path / "bad").glob("*") if p.is_file()] and not list((tmp_path / "bad").glob("_pending*"))


def test_checkpoints_and_report_files(spark, tmp_path):
    done = str(tmp_path / "done")
    for p in (["/a", "/b"], ["/b", "/c"]):
        sinks.mark_completed(spark.createDataFrame([(x,) for x in p], "path string"), done)
    assert sorted(r.path for r in sinks.completed(spark, done).collect()) == ["/a", "/b", "/c"]
    df = spark.createDataFrame([("x", -14.0), ("y", -9.5)], "track string, lufs double")
    sinks.report_pairs(df, str(tmp_path / "log"), "track", "guard", {"LUFS": F.col("lufs")})
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == ["x.guard.json", "x.guard.md", "y.guard.json", "y.guard.md"]
    assert (tmp_path / "log/y.guard.md").read_text() == "# y\n\n- **LUFS**: -9.5"
    assert spark.read.json(sinks.rollout_report(df, str(tmp_path), "2026-01-01")).count() == 2


def test_log_figures(spark):
    log = "RMS level dB: -20.5\nOverall.RMS_level = -18.25\nOverall.RMS level dB: -inf\nmean_volume: -19.1 dB\nmax_volume: -0.5 dB\nOutput True Peak:   -1.2 dBTP\n{ \"input_i\" : \"-1\" }\n{\n\"input_i\" : \"-23.1\", \"input_tp\" : \"-inf\"\n}"
    c = F.col("log")
    row = spark.createDataFrame([(log,)], "log string").select(records.rms_level(c).alias("rms"), records.volume(c, "mean").alias("mean"), records.volume(c, "max").alias("max"), records.loudness_lines(c)["input_tp"].alias("tp"), records.loudness_lines(c)["input_i"].alias("i"), records.loudness_block(c).alias("block")).first()
    assert (row.rms, row["mean"], row["max"], row.tp, row.i, row.block) == (-18.25, -19.1, -0.5, -1.2, None, {"input_i": "-23.1", "input_tp": "-inf"})
