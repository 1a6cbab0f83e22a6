"""Conservative roll-ups of many tracks, and ratings of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp

#: Noise categories from best to worst; a missing one counts as the worst of all when rows are merged.
NOISE = ["Excellent", "Good", "Moderate", "High", "VeryHigh", "Unknown"]


def noise_category(db: Column) -> Column:
    return F.when(db.isNull(), "Unknown").when(db <= -60, "Excellent").when(db <= -50, "Good").when(db <= -40, "Moderate").when(db <= -30, "High").otherwise("VeryHigh")


def merge(tracks: DataFrame, key: str) -> DataFrame:
    """tracks(band_db, voice, clipped, clips, noise_db, mono, width, peak, lufs, lra, crest, dc, bpm) of a batch as one.

    Levels are averaged with a missing one as -100, peaks and noise take the worst, loudness range and crest the
    least, loudness only counts rows above -70, dc is the value furthest from 0, tempo the median.
    """
    noise = noise_category(F.col("noise_db"))
    rank = sum((F.when(noise == c, i).otherwise(0) for i, c in enumerate(NOISE)), F.lit(0))
    loud = F.col("lufs") > -70
    return tracks.groupBy(key).agg(
        F.count("*").alias("tracks"),
        F.round(F.avg(F.coalesce("band_db", F.lit(-100.0))), 4).alias("band_avg"),
        F.max("voice").alias("voice_max"),
        F.bool_or("clipped").alias("any_clipped"),
        F.sum("clips").cast("long").alias("clips"),
        F.max("noise_db").alias("noise_max"),
        F.max_by(noise, rank).alias("noise_worst"),
        F.bool_or("mono").alias("any_mono"),
        F.round(F.avg("width"), 4).alias("width_avg"),
        F.max("peak").alias("peak_max"),
        F.max(F.when(loud, F.col("lufs"))).alias("lufs_max"),
        F.min(F.when(loud, F.col("lra"))).alias("lra_min"),
        F.min(F.when(loud, F.col("crest"))).alias("crest_min"),
        F.max_by("dc", F.abs("dc")).alias("dc_worst"),
        F.round(F.median("bpm"), 4).alias("bpm_median"),
    )


def balance(levels: DataFrame, key: str, level: str) -> DataFrame:
    """How even the levels of a track's bands are, from 0 to 100, and whether their range exceeds 10."""
    score = F.when(F.count(level) == 0, 50.0).otherwise(clamp(100 - 10 * F.stddev_pop(level), 0.0, 100.0))
    return levels.groupBy(key).agg(F.round(score, 4).alias("score"), (F.max(level) - F.min(level) > 10).alias("dynamic"))


def gain_reduction(level: Column, threshold: float, ratio: float) -> Column:
    return F.greatest(F.lit(0.0), (level - threshold) * (1 - 1 / ratio))


def reduction_label(total: Column) -> Column:
    return F.when(total <= 6, "ok").when(total <= 8, "high").otherwise("critical")


def issues(flags: dict[str, Column]) -> Column:
    """The names of the flags that are set, in order."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items()))), ",")


def repair_level(noise: Column, clip: Column, click: Column) -> Column:
    """Which automatic repairs are called for."""
    return issues({"denoise": noise > -20, "declip": clip > -0.1, "declick": click > -0.05})


def recalibrate(lufs: Column, peak: Column, target: float, ceiling: float) -> Column:
    """Whether a rendered track is too far from its target to be kept."""
    return (F.abs(lufs - target) > 0.30) | (peak - (ceiling - 0.5) > 0.20)
