"""Signals as rows of samples: segments, frames, envelopes, tempo, silence, noise, fades, width, clipping, automation.

samples: key, i (from 0 without gaps within a key) and x; stereo ones have left and right.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, from_db, half_even
from .selection import median
from .spectrum import autocorrelation

#: Levels at which silence is looked for, from the lowest, in dB.
SILENCES = [-60, -50, -40, -30]
#: Settings of the bands that can be automated, (Hz, Q, shape).
AUTOMATED = {"subbass_db": (45.0, 0.7, "lowshelf"), "bass_db": (120.0, 0.8, "bell"), "mid_db": (1000.0, 0.7, "bell"), "high_mid_db": (3800.0, 0.9, "bell"), "air_db": (9000.0, 0.7, "highshelf")}


def lengths(samples: DataFrame, key: str) -> DataFrame:
    return samples.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))


def center(samples: DataFrame, key: str, most: int) -> DataFrame:
    """The middle ``most`` samples of each key (all of a shorter one), numbered anew."""
    start = F.greatest(F.floor((F.col("_n") - most) / 2), F.lit(0))
    joined = samples.join(lengths(samples, key), F.col(key) == F.col("_k"))
    return joined.where((F.col("i") >= start) & (F.col("i") < start + most)).withColumn("i", (F.col("i") - start).cast("long")).drop("_k", "_n")


def full_frames(samples: DataFrame, key: str, size: int, hop: int) -> DataFrame:
    """Overlapping frames of ``size`` samples every ``hop``, whole ones only: a row for each sample of each frame."""
    last = F.floor(F.col("i") / hop)
    first = F.greatest(F.floor((F.col("i") - size) / hop) + 1, F.lit(0))
    spread = samples.join(lengths(samples, key), F.col(key) == F.col("_k")).select("*", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("frame"))
    return spread.where(F.col("frame") * hop + size <= F.col("_n")).withColumn("at", F.col("i") - F.col("frame") * hop).drop("_k", "_n")


def medians(spectra: DataFrame, key: str, bin: str, db: str, bands: dict[str, tuple[float, float]], width: float) -> DataFrame:
    """The median spectrum of each key's frames, and medians of its bands (low end included, high end not)."""
    each = median(spectra, [key, bin], db, "db")
    hz = F.col(bin) * width
    return each.groupBy(key).agg(*(half_even(F.median(F.when((hz >= lo) & (hz < hi), F.col("db"))), 4).alias(n) for n, (lo, hi) in bands.items()))  # one spectrum's bins


def mid_side(samples: DataFrame, key: str) -> DataFrame:
    """Evidence from two channels: the middle's share, their uncentred correlation and the crest in dB."""
    a, b = F.col("left"), F.col("right")
    mid, side = F.sqrt(F.avg(((a + b) / 2) * ((a + b) / 2)) + 1e-12), F.sqrt(F.avg(((a - b) / 2) * ((a - b) / 2)) + 1e-12)
    peak, rms = F.max(F.greatest(F.abs(a), F.abs(b))) + 1e-12, F.sqrt((F.avg(a * a) + F.avg(b * b)) / 2 + 1e-12)
    return samples.groupBy(key).agg(
        half_even(mid / F.greatest(mid + side, F.lit(1e-12)), 3).alias("mid_side_ratio"), half_even(F.sum(a * b) / (F.sqrt(F.sum(a * a) * F.sum(b * b)) + 1e-12), 4).alias("correlation"), half_even(20 * F.log10(peak / rms), 2).alias("crest_db")
    )


def moving_average(samples: DataFrame, key: str, width: int, out: str = "x") -> DataFrame:
    """x averaged over ``width`` samples around each; what lies beyond an end counts as 0."""
    by = Window.partitionBy(key).orderBy("i").rowsBetween(-(width // 2), width - width // 2 - 1)
    return samples.withColumn(out, F.sum("x").over(by) / width)


def block_means(samples: DataFrame, key: str, size: int) -> DataFrame:
    """Means of whole blocks of samples: key, i and x of the shorter series."""
    blocks = samples.groupBy(key, F.floor(F.col("i") / size).cast("long").alias("_b")).agg(F.count("*").alias("_n"), F.avg("x").alias("x"))
    return blocks.where(F.col("_n") == size).select(key, F.col("_b").alias("i"), "x")


def rises(samples: DataFrame, key: str) -> DataFrame:
    """How much each sample exceeds the one before, 0 if it doesn't, as a share of the largest of the key."""
    up = samples.withColumn("x", F.greatest(F.coalesce(F.col("x") - F.lag("x").over(Window.partitionBy(key).orderBy("i")), F.lit(0.0)), F.lit(0.0)))
    return up.withColumn("x", F.col("x") / (F.max("x").over(Window.partitionBy(key)) + 1e-9))


def onsets(samples: DataFrame, key: str, smooth: int, block: int) -> DataFrame:
    """Onsets of a signal: its magnitude around the mean, smoothed, thinned out and differenced.

    The mean adds samples in their order: where blocks are equal but for the last bit, any other order has other onsets.
    """
    summed = samples.withColumn("_to", F.sum("x").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    means = summed.groupBy(F.col(key).alias("_k")).agg((F.max_by("_to", "i") / F.count("x")).alias("_mean"))
    around = samples.join(means, F.col(key) == F.col("_k")).select(key, "i", F.abs(F.col("x") - F.col("_mean")).alias("x"))
    return rises(block_means(moving_average(around, key, smooth), key, block), key)


def tempo(onset: DataFrame, key: str, rate: float, bpm: tuple[float, float] = (72.0, 180.0)) -> DataFrame:
    """Beats a minute of onsets (rate a second), how sure that is, and how clear the pulse: by autocorrelation at the lags of a range.

    Only whole beats among the first eight tell the clearness; a key shorter than the longest lag has no row.
    """
    low, high = int(rate * 60 / bpm[1]), int(rate * 60 / bpm[0])
    ac = autocorrelation(onset.where("x > 0"), key, "i", "x", range(low, high))
    sizes = onset.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where(F.col("_n") > high)
    every = sizes.select(F.col("_k").alias(key), "_n", F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("lag")).join(ac, [key, "lag"], "left")
    value = half_even(F.coalesce("ac", F.lit(0.0)), 9)
    best = every.withColumn("ac", value).groupBy(key).agg(F.max_by("lag", F.struct("ac", -F.col("lag"))).alias("lag"), ((F.max("ac") - F.avg("ac") - 1e-9) / (F.stddev_pop("ac") + 1e-9)).alias("z"), F.first("_n").alias("_n"))
    window = F.least(F.col("_n"), F.col("lag") * 8)
    bins = F.greatest(F.lit(8), F.col("lag"))
    folded = onset.join(best.withColumnRenamed(key, "_k"), F.col(key) == F.col("_k")).where(F.col("i") < F.floor(window / bins) * bins)
    folded = folded.groupBy(key, (F.col("i") % bins).alias("_bin")).agg(F.avg("x").alias("_f")).groupBy(F.col(key).alias("_k")).agg(F.max("_f").alias("_top"), F.avg("_f").alias("_mean"))
    sure = clamp((F.col("z") - 0.6) / 3.2, 0.0, 1.0)
    clear = F.coalesce(clamp((F.col("_top") / (F.col("_mean") + 1e-9) - 1) / 2.5, 0.0, 1.0), sure * 0.8)
    return best.join(folded, F.col(key) == F.col("_k"), "left").select(key, "lag", half_even(60.0 * rate / F.col("lag"), 4).alias("bpm"), half_even(sure, 4).alias("confidence"), half_even(clear, 4).alias("pulse_clarity"))


def silences(samples: DataFrame, key: str, limit: Column | float, least: int) -> DataFrame:
    """Runs of at least ``least`` samples whose magnitude stays below a limit: key, first and last i."""
    by = Window.partitionBy(key).orderBy("i")
    marked = samples.where(F.abs("x") < limit).withColumn("_island", F.col("i") - F.row_number().over(by))
    return marked.groupBy(key, "_island").agg(F.min("i").alias("first"), F.max("i").alias("last")).where(F.col("last") - F.col("first") + 1 >= least).drop("_island")


def noise_floor(samples: DataFrame, key: str, least: int) -> DataFrame:
    """The lowest level below which a key falls silent for a while; without one, what its range says.

    One pass for all levels: a sample below a level lies in the island that the last sample at or above it has opened.
    """
    by = Window.partitionBy(key).orderBy("i")
    loud = {db: F.coalesce(F.last(F.when(F.abs("x") >= 10 ** (db / 20), F.col("i")), True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1)) for db in SILENCES}
    seen = samples.withColumns({f"_run{i}": F.col("i") - last for i, last in enumerate(loud.values())})
    found = F.coalesce(*(F.when(F.max(f"_run{i}") >= least, float(db)) for i, db in enumerate(SILENCES)))
    mean, top = 10 * F.log10(F.avg(F.col("x") * F.col("x")) + 1e-12), 20 * F.log10(F.max(F.abs("x")) + 1e-12)
    volume = seen.groupBy(key).agg(mean.alias("_mean"), top.alias("_max"), found.alias("_found"))
    guess = F.col("_mean") - F.greatest(F.lit(6.0), (F.col("_max") - F.col("_mean")) * 0.7)
    return volume.select(key, half_even(F.coalesce("_found", guess), 4).alias("noise_db"), F.col("_found").isNotNull().alias("has_silence"))


def fades(samples: DataFrame, key: str, rate: int, limit: float, least: float = 0.3, probe: float = 0.25) -> DataFrame:
    """Fades that silent edges call for: lead and tail in seconds, fade_in and fade_out.

    A tail is faded unless the level falls by more than 3 dB over the two seconds before it, a lead unless it rises by
    more than 5 after it; a peak above -6 dB next to the silence calls for a fade all the same. Levels are taken over
    ``probe`` seconds at three points, the peak over twice that.
    """
    edge, short = int(0.1 * rate), int(least * rate)
    sizes = lengths(samples, key)
    quiet = silences(samples, key, limit, 1).join(sizes, F.col(key) == F.col("_k"))
    spans = quiet.groupBy(F.col("_k")).agg(
        F.max(F.when((F.col("first") <= edge) & (F.col("last") < F.col("_n") - 1), F.col("last") - F.col("first") + 1)).alias("_lead"), F.max(F.when(F.col("last") + 1 >= F.col("_n") - edge, F.col("_n") - F.col("first"))).alias("_tail")
    )
    found = sizes.withColumnRenamed("_k", "_s").join(spans, F.col("_s") == F.col("_k"), "left").select(F.col("_s").alias("_k"), "_n", F.coalesce("_lead", F.lit(0)).alias("_lead"), F.coalesce("_tail", F.lit(0)).alias("_tail"))
    cut, low = F.col("_n") - F.col("_tail"), int(0.05 * rate)
    before = [F.greatest(F.lit(low), cut - int(s * rate)) for s in (2.0, 1.0, 0.3)]
    after = [F.least(F.col("_n") - int(0.3 * rate), F.col("_lead") + int(s * rate)) for s in (0.3, 0.8, 1.5)]
    n, m = int(probe * rate), int(2 * probe * rate)
    points = F.array(*(p.cast("long") for p in before + after))
    joined = samples.join(found, F.col(key) == F.col("_k"))
    inside = lambda p, size: (F.col("i") >= F.get(points, F.lit(p))) & (F.col("i") < F.get(points, F.lit(p)) + size)
    level = lambda p: (10 * F.log10(F.avg(F.when(inside(p, n), F.col("x") * F.col("x"))) + 1e-12)).alias(f"_p{p}")
    peak = lambda p: (20 * F.log10(F.max(F.when(inside(p, m), F.abs("x"))) + 1e-12)).alias(f"_x{p}")
    seen = joined.groupBy("_k", "_n", "_lead", "_tail").agg(*(level(p) for p in (0, 2, 3, 5)), peak(2), peak(3))
    hard_cut = ~F.coalesce(F.col("_p2") - F.col("_p0") < -3, F.lit(False)) | F.coalesce(F.col("_x2") > -6, F.lit(False))
    hard_start = ~F.coalesce(F.col("_p5") - F.col("_p3") > 5, F.lit(False)) | F.coalesce(F.col("_x3") > -6, F.lit(False))
    lead, tail = F.col("_lead") / rate, F.col("_tail") / rate
    return seen.select(
        F.col("_k").alias(key), half_even(lead, 4).alias("lead"), half_even(tail, 4).alias("tail"), half_even(F.when((F.col("_lead") >= short) & hard_start, clamp(lead * 0.6, 0.2, 2.0)).otherwise(0.0), 4).alias("fade_in"),
        half_even(F.when((F.col("_tail") >= short) & hard_cut, clamp(tail * 0.6, 0.2, 3.0)).otherwise(0.0), 4).alias("fade_out"),
    )


def trimmed(samples: DataFrame, key: str, start: float, start_least: int, end: float, end_least: int) -> DataFrame:
    """Samples without what lies before the first run of ``start_least`` samples at or above a limit, and after the last of ``end_least``."""
    by = Window.partitionBy(key).orderBy("i")

    def runs(limit: float, least: int) -> DataFrame:
        loud = samples.where(F.abs("x") >= limit).withColumn("_island", F.col("i") - F.row_number().over(by))
        return loud.groupBy(key, "_island").agg(F.min("i").alias("a"), F.max("i").alias("b")).where(F.col("b") - F.col("a") + 1 >= least)

    edges = runs(start, start_least).groupBy(F.col(key).alias("_k")).agg(F.min("a").alias("_a")).join(runs(end, end_least).groupBy(F.col(key).alias("_e")).agg(F.max("b").alias("_b")), F.col("_k") == F.col("_e"))
    return samples.join(edges, F.col(key) == F.col("_k")).where(F.col("i").between(F.col("_a"), F.col("_b"))).drop("_k", "_e", "_a", "_b")


def faded(x: Column, i: Column, n: Column, fade_in: int, fade_out: int) -> Column:
    """x with linear fades at either end, in samples."""
    up = F.least(F.lit(1.0), i / max(1, fade_in)) if fade_in else F.lit(1.0)
    down = F.least(F.lit(1.0), (n - i) / max(1, fade_out)) if fade_out else F.lit(1.0)
    return x * up * F.greatest(down, F.lit(0.0))


def widened(left: Column, right: Column, width: Column | float) -> tuple[Column, Column]:
    """Two channels with the side signal scaled."""
    mid, side = (left + right) / 2, (left - right) / 2
    return mid + side * width, mid - side * width


def gained(x: Column, db: Column | float) -> Column:
    return x * from_db(db if isinstance(db, Column) else F.lit(float(db)))


def hard_clip(x: Column, ceiling_db: float) -> Column:
    most = 10 ** (ceiling_db / 20)
    return clamp(x, -most, most)


def soft_clip(x: Column, drive_db: float, mix: float, kind: str = "Tape") -> Column:
    """Saturation by tanh (tape) or arctangent (tube), its level kept at full scale, mixed with what came in."""
    drive = 10 ** (drive_db / 20)
    wet = F.tanh(x * drive) / F.tanh(F.lit(drive)) if kind == "Tape" else F.atan(x * drive) / F.atan(F.lit(drive))
    return x * (1 - mix) + wet * mix


def banded_gain(levels: DataFrame, key: str, gains: dict[str, float]) -> DataFrame:
    """Band amplitudes levels(key, band, x) with a gain in dB for each band, summed up again."""
    table = F.create_map(*(F.lit(x) for b, g in gains.items() for x in (b, 10 ** (g / 20))))
    return levels.groupBy(key).agg(F.sum(F.col("x") * F.coalesce(table[F.col("band")], F.lit(1.0))).alias("x"))


def automation(sections: DataFrame, most: float = 0.8, least: float = 0.01) -> DataFrame:
    """Gain moves for sections(section, start_s, end_s, smoothing_ms, eq_db map): one for each known band with an effect.

    Gains are limited to ``most``; ramps last 150 to 500 ms, at most half the section.
    """
    spec = F.create_map(*(F.lit(x) for b, (hz, _, _) in AUTOMATED.items() for x in (b, hz)))
    rows = sections.select("*", F.explode("eq_db").alias("band", "requested_db")).where(F.col("band").isin(list(AUTOMATED)))
    gain = clamp(F.col("requested_db"), -most, most)
    smooth = clamp(F.coalesce("smoothing_ms", F.lit(180.0)), 150.0, 500.0)
    told = rows.withColumns({
        "applied_db": gain, "smoothing_ms": half_even(smooth, 1), "operation": F.when(gain > 0, "boost").otherwise("cut"), "frequency_hz": spec[F.col("band")],
        "ramp_s": F.least(smooth / 1000, F.greatest(F.lit(0.01), (F.col("end_s") - F.col("start_s")) / 2)),
    })
    return told.where((F.abs("applied_db") >= least) & (F.col("end_s") > F.col("start_s"))).drop("eq_db")


def envelope(t: Column, start: Column, end: Column, ramp: Column) -> Column:
    """0 outside an interval, 1 inside, linear over the ramp at either end."""
    return F.when((t < start) | (t >= end), 0.0).otherwise(F.least(F.lit(1.0), (t - start) / ramp, (end - t) / ramp))


def assembled(key: str, first: DataFrame, *parts: DataFrame) -> DataFrame:
    """All that is known of each track in one row: measured apart, joined on the key; what is missing is null."""
    return reduce(lambda a, b: a.join(b, key, "left"), parts, first)
