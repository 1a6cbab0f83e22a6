"""Spectra of series held in arrays, and what is read from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples of frames that are transformed at a time in a task.
TOGETHER = 1 << 20


def dft(rows: DataFrame, key: str, samples: str, n: int, hann: bool = False) -> DataFrame:
    """key, bin, mag and db of arrays of n samples: each bin a sum over the array, inside the JVM."""
    x = F.transform(F.col(samples), lambda v, i: v.cast("double") * ((0.5 - 0.5 * F.cos(i * (2 * math.pi / (n - 1)))) if hann else F.lit(1.0)))
    held = rows.select(key, x.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("bin"))
    wave = lambda f: F.aggregate(F.transform("x", lambda v, i: v * f(i * F.col("bin") * (2 * math.pi / n))), F.lit(0.0), lambda a, v: a + v)
    re, im = wave(F.cos), wave(F.sin)
    mag = F.sqrt(re * re + im * im)
    return held.select(key, "bin", F.round(mag, 5).alias("mag")).withColumn("db", F.round(20 * F.log10(F.greatest("mag", F.lit(1e-5))), 4))


def fft(frames: DataFrame, keys: list[str], samples: str, n: int, hann: bool = True, floor: float = 1e-9, digits: int | None = None) -> DataFrame:
    """keys, bin, mag and db = 20 log10(mag + floor) of arrays of n samples: n log n a frame, many frames at once.

    Frames of another length than n, null ones and those with nulls have no rows. digits: places that mag is rounded to.
    """
    told = frames.where((F.size(samples) == n) & F.forall(samples, lambda v: v.isNotNull())).select(*keys, F.col(samples).alias("_x"))
    window = np.hanning(n) if hann else np.ones(n)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, TOGETHER // n)
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                x = b["_x"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                mag = np.abs(np.fft.rfft(x * window, axis=1))
                mag = mag if digits is None else np.round(mag, digits)
                bins = mag.shape[1]
                every = pa.array(np.repeat(np.arange(len(x)), bins))
                rest = [b[k].take(every) for k in keys]
                flat = mag.reshape(-1)
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.tile(np.arange(bins, dtype=np.int32), len(x))), pa.array(flat), pa.array(20 * np.log10(flat + floor))], names=[*keys, "bin", "mag", "db"])

    kinds = ", ".join(f"`{k}` {told.schema[k].dataType.simpleString()}" for k in keys)
    return told.mapInArrow(work, f"{kinds}, bin int, mag double, db double")


def framed(rows: DataFrame, key: str, idx: str, value: str, size: int, hop: int) -> DataFrame:
    """key, frame, x: whole frames of ``size`` values every ``hop``, as arrays in the order of idx (from 0 without gaps).

    A row goes to each of the size / hop frames that hold it; no group is larger than a frame.
    """
    last = F.floor(F.col(idx) / hop)
    first = F.greatest(F.floor((F.col(idx) - size) / hop) + 1, F.lit(0))
    spread = rows.select(key, F.col(idx).alias("_i"), F.col(value).alias("_v"), F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("frame"))
    listed = spread.groupBy(key, "frame").agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_x"))
    return listed.where(F.size("_x") == size).select(key, "frame", F.transform("_x", lambda e: e["_v"]).alias("x"))


def shape(spectrum: DataFrame, key: str, rolloff: float = 0.85) -> DataFrame:
    """Centroid, rolloff bin and flatness of each spectrum."""
    by = Window.partitionBy(key)
    power = F.col("mag") * F.col("mag")
    rows = spectrum.withColumn("_p", power).withColumn("_sum", F.sum("_p").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_p").over(by))
    return rows.groupBy(key).agg(
        F.round(F.sum(F.col("bin") * F.col("_p")) / F.sum("_p"), 4).alias("centroid"),
        F.min(F.when(F.col("_sum") >= rolloff * F.col("_all"), F.col("bin"))).alias("rolloff"),
        F.round(F.exp(F.avg(F.ln(F.col("mag") + 1e-10))) / (F.avg("mag") + 1e-10), 4).alias("flatness"),
    )


def peaks(spectrum: DataFrame, key: str, least_db: float, apart: int, most: int) -> DataFrame:
    """Local maxima above a level, each further than ``apart`` bins from the last one taken; the largest ``most``."""
    by = Window.partitionBy(key).orderBy("bin")
    m = F.col("mag")
    marked = spectrum.withColumns({"_a": F.lag("mag").over(by), "_b": F.lead("mag").over(by)}).where((m > F.col("_a")) & (m > F.col("_b")) & (F.col("db") > least_db))
    taken = lambda out, x: F.when((F.size(out) == 0) | (x["bin"] - F.element_at(out, -1)["bin"] > apart), F.concat(out, F.array(x))).otherwise(out)
    kind = "array<struct<bin:int,mag:double>>"
    folded = marked.groupBy(key).agg(F.aggregate(F.sort_array(F.collect_list(F.struct("bin", "mag"))), F.array().cast(kind), taken).alias("_taken"))  # one spectrum's bins
    rows = folded.select(key, F.explode("_taken").alias("_x")).select(key, "_x.bin", "_x.mag")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("mag"), "bin"))).where(F.col("rank") <= most)


def prominence(spectrum: DataFrame, key: str, inner: int, outer: int) -> DataFrame:
    """Each bin's level less the median of its surroundings, the nearest bins left out."""
    other = spectrum.select(F.col(key).alias("_k"), F.col("bin").alias("_bin"), F.col("db").alias("_db"))
    near = F.abs(F.col("bin") - F.col("_bin"))
    joined = spectrum.join(other, (F.col(key) == F.col("_k")) & (near > inner) & (near <= outer))
    return joined.groupBy(key, "bin").agg(F.round(F.first("db") - F.median("_db"), 5).alias("prominence"))


def suppressed(candidates: DataFrame, key: str, at: str, score: str, apart: float, most: int) -> DataFrame:
    """Greedy suppression: by falling score, each further than ``apart`` from all taken before."""
    item = F.struct((-F.col(score)).alias("s"), F.col(at).alias("at"))
    take = lambda out, x: F.when((F.size(out) < most) & ~F.exists(out, lambda y: F.abs(y["at"] - x["at"]) <= apart), F.concat(out, F.array(x))).otherwise(out)
    kind = "array<struct<s:double,at:int>>"
    folded = candidates.groupBy(key).agg(F.aggregate(F.sort_array(F.collect_list(item)), F.array().cast(kind), take).alias("_out"))  # one spectrum's candidates
    return folded.select(key, F.posexplode("_out").alias("rank", "x")).select(key, "rank", F.col("x.at").alias(at), (-F.col("x.s")).alias(score))


def autocorrelation(series: DataFrame, key: str, idx: str, value: str, lags: range, block: int = 8192) -> DataFrame:
    """key, lag, ac (the sum of products of a series with itself moved by the lag) and pairs (how many products).

    By the Wiener-Khinchin theorem, block by block: a block of a series and as much of what follows as the longest lag are
    transformed, padded, and their cross-spectrum is transformed back; sums over blocks are those over the series. So a
    series costs n log n, and one of any length is many small groups. A place of which there is no row counts as 0 and
    makes no pair. Lags without pairs have no row.
    """
    most, block = lags.stop - 1, max(block, lags.stop)
    told = series.select(key, F.col(idx).cast("long").alias("_i"), F.col(value).cast("double").alias("_v"))
    own, at = F.floor(F.col("_i") / block).cast("long"), F.pmod(F.col("_i"), F.lit(block)).cast("int")
    follows = F.array(F.struct(own.alias("b"), at.alias("at")), F.when(at < most, F.struct((own - 1).alias("b"), (at + block).alias("at"))))
    spread = told.select(key, "_v", F.explode(F.array_compact(follows)).alias("p")).select(key, "p.b", "p.at", "_v")
    groups = spread.groupBy(key, "b").agg(F.collect_list(F.struct("at", "_v")).alias("x"))  # a block and a lag at most
    size = 1 << (block + 2 * most - 1).bit_length()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "lag", "ac", "pairs"]
        for whole in batches:
            for b in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                column = b["x"]
                flat, group = column.flatten(), np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
                place, v = flat.field("at").to_numpy(), flat.field("_v").to_numpy(zero_copy_only=False)
                found = []
                for values in (v, np.ones(len(v))):
                    all_of = np.zeros((len(column), size))
                    all_of[group, place] = values
                    first = all_of.copy()
                    first[:, block:] = 0
                    found.append(np.fft.irfft(np.conj(np.fft.rfft(first, axis=1)) * np.fft.rfft(all_of, axis=1), size, axis=1)[:, lags.start : lags.stop])
                every = pa.array(np.repeat(np.arange(len(column)), len(lags)))
                lag = np.tile(np.arange(lags.start, lags.stop, dtype=np.int32), len(column))
                yield pa.RecordBatch.from_arrays([b[key].take(every), pa.array(lag), pa.array(found[0].reshape(-1)), pa.array(np.rint(found[1].reshape(-1)).astype(np.int64))], names=names)

    kind = series.schema[key].dataType.simpleString()
    parts = groups.select(key, "x").mapInArrow(work, f"`{key}` {kind}, lag int, ac double, pairs long")
    return parts.groupBy(key, "lag").agg(F.sum("ac").alias("ac"), F.sum("pairs").alias("pairs")).where("pairs > 0")


def best_lag(ac: DataFrame, key: str) -> DataFrame:
    """The lag with the largest autocorrelation (the shortest on a tie) and how far it stands out in standard deviations."""
    return ac.groupBy(key).agg(F.max_by("lag", F.struct("ac", -F.col("lag"))).alias("lag"), F.round((F.max("ac") - F.avg("ac")) / (F.stddev_pop("ac") + 1e-9), 4).alias("z"))


def within(points: DataFrame, hz: str, low: float = 20.0, high: float = 20000.0) -> DataFrame:
    """The points of spectra that a plot shows: those whose frequency lies in a closed range."""
    return points.where(F.col(hz).between(low, high))


def band_counts(hz: Column, bands: dict[str, tuple[float, float]]) -> list[Column]:
    """Peaks in closed, overlapping bands; one on a shared edge counts in both."""
    return [F.count_if(hz.between(*b)).alias(n) for n, b in bands.items()]
