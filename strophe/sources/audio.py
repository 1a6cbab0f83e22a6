"""Audio files as rows: listing, probing, decoding in chunks, and a spectral kernel over frames."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wav

#: File endings that count as audio, and the bands' edges in Hz.
SUFFIXES = ("wav", "aiff", "aif", "flac")
BANDS = {"sub": (20, 60), "bass": (60, 250), "low_mid": (250, 500), "mid": (500, 2000), "high_mid": (2000, 6000), "air": (6000, 16000)}


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, length and modified of the audio files below a folder, by path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified")).orderBy("path")


def merged_listing(*listings: DataFrame) -> DataFrame:
    """Listings one after another; of a path that comes again the later entry stays. Sorted by name, case aside."""
    numbered = [one.withColumn("_seq", F.lit(i)) for i, one in enumerate(listings)]
    rows = numbered[0]
    for n in numbered[1:]:
        rows = rows.unionByName(n)
    last = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("_seq")))).where("_rn = 1")
    return last.drop("_seq", "_rn").orderBy(F.lower("name"), "path")


def _wavs(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower("path").endswith(".wav")).select("path", "content")


def _samples(raw: bytes, width: int, channels: int) -> np.ndarray:
    """PCM as floats from -1 to 1, a column for each channel."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) << 8).astype(np.float32) / 2**31
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    return x[: len(x) // channels * channels].reshape(-1, channels)


def probe(spark: SparkSession, folder: str) -> DataFrame:
    """duration, sample_rate, channels, bit_depth, codec, format and bitrate of each WAV file; nulls and an error for what can't be read."""
    heads = wav.load(spark, folder, "path", "sample_rate", "channels", "bit_depth", "codec", "n_samples", "bytes", "error")
    seconds = F.col("n_samples") / F.col("sample_rate")
    known = F.col("error").isNull()
    return heads.select(
        "path", seconds.alias("duration"), "sample_rate", "channels", "bit_depth", "codec", F.when(known, "wav").alias("format"), F.when(F.col("n_samples") > 0, F.floor(F.col("bytes") * 8 / seconds)).alias("bitrate"), "error"
    )


def decoded(spark: SparkSession, folder: str, seconds: float = 30.0, center: bool = False, rate: int | None = None, chunk: int = 1 << 16) -> DataFrame:
    """Samples of each WAV file in chunks: path, sample_rate, first (the place of a chunk's first sample), left, right and mono.

    The first ``seconds`` of a file, or the middle ones. rate: samples a second to which they are brought by a windowed
    sinc; None keeps the file's own. A file of one channel has it on both sides; one that can't be read has no rows.
    """
    options = {"seconds": seconds, "center": str(center).lower(), "chunk": chunk} | ({"rate": rate} if rate else {})
    return wav.load(spark, folder, "path", "sample_rate", "first", "left", "right", "mono", **options)


def samples(chunks: DataFrame, sides: tuple[str, ...] = ("mono",)) -> DataFrame:
    """A row for each sample of decoded chunks: path, i and the sides, as the signal operators take them."""
    zipped = F.arrays_zip(*sides) if len(sides) > 1 else F.transform(sides[0], lambda v: F.struct(v.alias(sides[0])))
    rows = chunks.select("path", "first", F.posexplode(zipped).alias("at", "_v"))
    return rows.select("path", (F.col("first") + F.col("at")).alias("i"), *(F.col(f"_v.{s}").cast("double").alias(s) for s in sides))


def frames(spark: SparkSession, folder: str, size: float = 1.0, hop: float = 1.0) -> DataFrame:
    """Level and band features of each frame of each WAV file: path, frame, t, rms_db, peak_db, crest_db and <band>_db.

    A band's level is that of the mean magnitude of the Hann-windowed frame's spectrum; the last frame is padded.
    Files are streamed frame by frame; one that can't be read yields no rows (``probe`` has its error).
    """
    names = [f"{b}_db" for b in BANDS]
    schema = pa.schema([("path", pa.string()), ("frame", pa.int64()), *((n, pa.float64()) for n in ("t", "rms_db", "peak_db", "crest_db", *names))])

    def db(x: float) -> float:
        return -120.0 if x <= 1e-12 else max(-120.0, 20 * float(np.log10(x)))

    def features(x: np.ndarray, rate: int) -> list[float]:
        rms, peak = float(np.sqrt(np.mean(x.astype(np.float64) ** 2) + 1e-9)), float(np.max(np.abs(x))) + 1e-9
        mag, hz = np.abs(np.fft.rfft(x * np.hanning(len(x)))), np.fft.rfftfreq(len(x), 1 / rate)
        inside = [mag[(hz >= lo) & (hz < hi)] for lo, hi in BANDS.values()]
        return [round(v, 2) for v in (db(rms), db(peak), 20 * float(np.log10(peak / rms)), *(db(float(m.mean())) if m.size else -120.0 for m in inside))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                try:
                    w = wave.open(io.BytesIO(content.as_py()))
                except (wave.Error, EOFError):
                    continue
                rate, channels = w.getframerate(), w.getnchannels()
                length, step = max(256, int(size * rate)), max(128, int(hop * rate))
                rows, held, i = [], np.zeros(0, np.float32), 0
                while True:
                    more = _samples(w.readframes(step), w.getsampwidth(), channels).mean(1)
                    held = np.concatenate((held, more))
                    while len(held) >= length or (not len(more) and len(held)):
                        x = np.pad(held[:length], (0, length - min(length, len(held))))
                        rows.append([path, i, round(i * step / rate, 3), *features(x, rate)])
                        held, i = held[step:], i + 1
                    if not len(more):
                        break
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(schema), schema.types, strict=True)], schema=schema)

    return _wavs(spark, folder).mapInArrow(work, ", ".join(f"{f.name} {'string' if f.name == 'path' else 'bigint' if f.name == 'frame' else 'double'}" for f in schema))
