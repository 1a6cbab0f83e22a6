"""The data source of sound files: ranges against whole reads, resampling, frames, heads, filters."""

import struct

import numpy as np
import pytest

from strophe.sources import audio, wav


def put(path, x, rate=8000, kind=1, bits=16, extra=b"", rf64=False):
    """x: a column for each channel, as integers or floats of the format."""
    raw = np.ascontiguousarray(x).tobytes() if bits != 24 else b"".join(int(v).to_bytes(3, "little", signed=True) for v in np.asarray(x).reshape(-1))
    channels = x.shape[1]
    form = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + extra
    head = b"ds64" + struct.pack("<IQQQI", 28, 0, len(raw), 0, 0) if rf64 else b""
    data = b"data" + struct.pack("<I", 0xFFFFFFFF if rf64 else len(raw)) + raw
    path.write_bytes((b"RF64" if rf64 else b"RIFF") + struct.pack("<I", 4 + len(head) + len(chunks) + len(data)) + b"WAVE" + head + chunks + data)


def joined(rows, side="mono"):
    parts = sorted((r.first, r[side]) for r in rows)
    assert all(a + len(x) == b for (a, x), (b, _) in zip(parts, parts[1:], strict=False))
    return np.concatenate([np.array(x, np.float32) for _, x in parts])


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(1).integers(-30000, 30000, (50_001, 2)).astype("<i2")


def test_ranges_give_the_samples_of_a_whole_read(spark, tmp_path, noise):
    put(tmp_path / "a.wav", noise)
    df = wav.load(spark, str(tmp_path), rangeBytes=10_001, chunk=700)
    assert df.rdd.getNumPartitions() >= 20  # one file, many tasks
    rows = df.collect()
    for i, side in enumerate(("left", "right")):
        assert (joined(rows, side) == noise[:, i].astype(np.float32) / 32768).all()
    whole = wav.load(spark, f"file://{tmp_path}").collect()
    assert (joined(rows) == joined(whole)).all() and {r.path for r in whole} == {f"file://{tmp_path}/a.wav"} and {(r.sample_rate, r.channels, r.n_samples) for r in rows} == {(8000, 2, 50_001)}


@pytest.mark.parametrize("center", [False, True])
def test_seconds_from_the_start_or_the_middle(spark, tmp_path, noise, center):
    put(tmp_path / "a.wav", noise)
    got = joined(wav.load(spark, str(tmp_path), "first", "left", rangeBytes=9000, seconds=2.0, center=center).collect(), "left")
    start = (50_001 - 16_000) // 2 if center else 0
    assert (got == noise[start : start + 16_000, 0].astype(np.float32) / 32768).all()


def test_formats(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.uniform(-0.9, 0.9, (1000, 1))
    put(tmp_path / "u8.wav", np.round(x * 128 + 128).astype(np.uint8), bits=8)
    put(tmp_path / "s24.wav", np.round(x * 2**23).astype(np.int64), bits=24)
    put(tmp_path / "s32.wav", np.round(x * 2**31).astype("<i4"), bits=32, extra=b"LIST" + struct.pack("<I", 3) + b"abc\0")
    put(tmp_path / "f32.wav", x.astype("<f4"), kind=3, bits=32)
    put(tmp_path / "f64.WAV", x.astype("<f8"), kind=3, bits=64, rf64=True)
    rows = wav.load(spark, str(tmp_path), rangeBytes=500, chunk=64).collect()
    for name, off in (("u8.wav", 0.01), ("s24.wav", 1e-6), ("s32.wav", 1e-6), ("f32.wav", 1e-7), ("f64.WAV", 1e-7)):
        own = [r for r in rows if r.path.endswith(name)]
        assert np.abs(joined(own) - x[:, 0]).max() < off and all(r.left == r.right for r in own)


def test_heads_alone_errors_and_filters(spark, tmp_path, noise):
    put(tmp_path / "a.wav", noise)
    put(tmp_path / "none.wav", noise[:0])
    (tmp_path / "bad.wav").write_bytes(b"RIFF....WAVEfmt \x02\0\0\0\1\0")
    (tmp_path / "void.wav").write_bytes(b"")
    (tmp_path / "note.txt").write_text("x")
    names = ("path", "sample_rate", "bit_depth", "codec", "n_samples", "bytes", "error")
    heads = {r.path.split("/")[-1]: r for r in wav.load(spark, str(tmp_path), *names, rangeBytes=1000).collect()}
    assert sorted(heads) == ["a.wav", "bad.wav", "none.wav", "void.wav"] and heads["bad.wav"].error and heads["void.wav"].error and heads["a.wav"].error is None
    assert (heads["a.wav"].codec, heads["a.wav"].n_samples, heads["none.wav"].n_samples) == ("pcm_s16le", 50_001, 0)
    assert {r.path.split("/")[-1] for r in wav.load(spark, str(tmp_path), "path", "first").collect()} == {"a.wav"}
    one = wav.load(spark, str(tmp_path), "path", "n_samples").where(f"path = '{tmp_path}/none.wav'")
    assert [r.n_samples for r in one.collect()] == [0]
    with pytest.raises(Exception, match="no such columns"):
        wav.load(spark, str(tmp_path), "loudness").collect()


def tone(hz, rate, seconds, level=0.5):
    return (level * 32767 * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)).astype("<i2")[:, None]


def test_resampling_keeps_tones_and_lets_none_fold_back(spark, tmp_path):
    put(tmp_path / "low.wav", tone(1000, 48000, 1.0), 48000)
    put(tmp_path / "high.wav", tone(14000, 48000, 1.0), 48000)  # above half of 22050
    put(tmp_path / "up.wav", tone(1000, 8000, 1.0), 8000)
    rows = wav.load(spark, str(tmp_path), "path", "first", "mono", rate=22050, chunk=5000).collect()
    by = {n: joined([r for r in rows if r.path.endswith(n)]) for n in ("low.wav", "high.wav", "up.wav")}
    want = 0.5 * np.sin(2 * np.pi * 1000 * np.arange(22050) / 22050)
    inside = slice(200, -200)
    assert all(len(x) == 22050 for x in by.values())
    assert np.abs(by["low.wav"] - want)[inside].max() < 1e-3 and np.abs(by["up.wav"] - want)[inside].max() < 1e-3
    level = lambda x: 20 * np.log10(np.sqrt(np.mean(x[inside] ** 2)) / np.sqrt(0.125))
    assert level(by["high.wav"]) < -60 and abs(level(by["low.wav"])) < 0.01


def test_resampled_chunks_equal_the_whole(spark, tmp_path, noise):
    put(tmp_path / "a.wav", noise, 44100)
    whole = joined(wav.load(spark, str(tmp_path), "first", "left", rate=16000, chunk=1 << 20).collect(), "left")
    parts = joined(wav.load(spark, str(tmp_path), "first", "left", rate=16000, rangeBytes=7777, chunk=300).collect(), "left")
    assert len(whole) == 50_001 * 16000 // 44100 and (whole == parts).all()


def test_frames_overlap_across_ranges(spark, tmp_path, noise):
    put(tmp_path / "a.wav", noise)
    rows = sorted(wav.load(spark, str(tmp_path), "frame", "first", "left", rangeBytes=3001, frame=4096, hop=1024).collect())
    x = noise[:, 0].astype(np.float32) / 32768
    assert [r.frame for r in rows] == list(range((50_001 - 4096) // 1024 + 1))
    assert all((np.array(r.left, np.float32) == x[r.first : r.first + 4096]).all() and r.first == 1024 * r.frame for r in rows)


def test_decoded_goes_through_the_source(spark, tmp_path, noise):
    put(tmp_path / "a.wav", noise)
    rows = audio.decoded(spark, str(tmp_path), seconds=1.0, center=True, chunk=1000).collect()
    assert (joined(rows, "right") == noise[(50_001 - 8000) // 2 :][:8000, 1].astype(np.float32) / 32768).all()
