"""What a recording shows of itself: resonances that stand out, the middle's share, and levels of its bands.

From sound files to evidence in one query: frames of 8,192 samples every 4,096 are read by the data source where they lie,
transformed in their tasks, and the median over a recording's frames is selected exactly, bin by bin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..sources import wav
from . import selection, signal, spectrum

#: Rate, frame and hop of the analysis, in samples.
RATE, FRAME, HOP = 44100, 8192, 4096
#: Where resonances are looked for (Hz), what they must exceed their surroundings by (dB), how far apart they are (Hz), how many.
LOW, HIGH, LEAST, APART, MOST = 200.0, 16000.0, 3.0, 120.0, 8
#: Edges in Hz of the levels that are compared, and of the bands that a resonance may lie in.
LEVELS = {"low": (45.0, 220.0), "mids": (250.0, 2000.0), "harsh": (2500.0, 6000.0), "air": (7000.0, 14000.0)}
TARGETS = [(250.0, "bass"), (500.0, "low_mid"), (2000.0, "mid"), (6000.0, "high_mid")]


def median_spectrum(frames: DataFrame, key: str, samples: str, size: int = FRAME) -> DataFrame:
    """key, bin and db: the median over a key's frames (arrays of ``size`` samples) of the Hann-windowed level in dB."""
    return selection.median(spectrum.fft(frames, [key], samples, size), [key, "bin"], "db", "db")


def resonances(spectra: DataFrame, key: str, rate: float = RATE, size: int = FRAME) -> DataFrame:
    """key, rank, frequency_hz, target and excess_db: peaks of spectra(key, bin, db) that exceed the median of their surroundings.

    The surroundings are within 8 % (120 Hz at least) but for the nearest 1.2 % (30 Hz at least). By falling excess, then by
    frequency, each at least 120 Hz from all taken before; eight at most. A spectrum's bins (4,097) are one window.
    """
    width, by = rate / size, Window.partitionBy(key).orderBy("bin")
    hz = F.col("bin") * width
    peak = (F.col("db") > F.lag("db").over(by)) & (F.col("db") >= F.lead("db").over(by))
    last = F.max("bin").over(Window.partitionBy(key))
    tops = spectra.withColumns({"_peak": peak, "_last": last}).where(F.col("_peak") & (hz >= LOW) & (hz <= HIGH) & (F.col("bin") >= 2) & (F.col("bin") <= F.col("_last") - 2))
    outer, inner = F.greatest(F.lit(120.0), hz * 0.08), F.greatest(F.lit(30.0), hz * 0.012)
    tops = tops.select(F.col(key).alias("_k"), F.col("bin").alias("_bin"), F.col("db").alias("_db"), hz.alias("_hz"), outer.alias("_outer"), inner.alias("_inner"))
    near = tops.select("*", F.explode(F.sequence(F.ceil((F.col("_hz") - F.col("_outer")) / width).cast("int"), F.floor((F.col("_hz") + F.col("_outer")) / width).cast("int"))).alias("_b"))
    off = F.col("_b") * width - F.col("_hz")
    near = near.where((F.abs(off) > F.col("_inner")) & (F.abs(off) <= F.col("_outer")))
    around = near.join(spectra, (F.col("_k") == F.col(key)) & (F.col("_b") == F.col("bin"))).groupBy("_k", "_bin", "_hz", "_db").agg(F.median("db").alias("_floor"))  # bins of one peak
    excess = F.col("_db") - F.col("_floor")
    found = around.where(excess >= LEAST).select(F.col("_k").alias(key), half_even(F.col("_hz"), 1).alias("frequency_hz"), half_even(excess, 2).alias("excess_db"), F.col("_hz"))
    item = F.struct((-F.col("excess_db")).alias("s"), "frequency_hz", "_hz")
    take = lambda out, x: F.when((F.size(out) < MOST) & ~F.exists(out, lambda y: F.abs(y["frequency_hz"] - x["frequency_hz"]) < APART), F.concat(out, F.array(x))).otherwise(out)
    kind = "array<struct<s:double,frequency_hz:double,_hz:double>>"
    taken = found.groupBy(key).agg(F.aggregate(F.sort_array(F.collect_list(item)), F.array().cast(kind), take).alias("_x"))  # one spectrum's peaks
    target = F.lit("air")
    for edge, name in reversed(TARGETS):
        target = F.when(F.col("x._hz") < edge, name).otherwise(target)
    return taken.select(key, F.posexplode("_x").alias("rank", "x")).select(key, "rank", "x.frequency_hz", target.alias("target"), (-F.col("x.s")).alias("excess_db"))


def levels(spectra: DataFrame, key: str, rate: float = RATE, size: int = FRAME) -> DataFrame:
    """key, low_end_level_db, harshness_excess_db and dullness_deficit_db, from medians of a spectrum's bands."""
    hz = F.col("bin") * (rate / size)
    per = spectra.groupBy(key).agg(*(F.coalesce(F.median(F.when((hz >= lo) & (hz < hi), F.col("db"))), F.lit(-120.0)).alias(f"_{n}") for n, (lo, hi) in LEVELS.items()))  # one spectrum's bins
    ref = F.col("_mids")
    return per.select(
        key, half_even(F.col("_low") - ref, 2).alias("low_end_level_db"), half_even(F.greatest(F.lit(0.0), F.col("_harsh") - ref - 2), 2).alias("harshness_excess_db"), half_even(F.greatest(F.lit(0.0), ref - F.col("_air") - 10), 2).alias("dullness_deficit_db")
    )


def confidence(ratio, candidates):
    """How sure it is that a voice stands in the middle: by the middle's share, more with a resonance where voices have them."""
    voiced = F.exists(candidates, lambda x: x["frequency_hz"].between(1800.0, 8000.0))
    return half_even(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ratio - 0.45) / 0.45 + F.when(F.coalesce(voiced, F.lit(False)), 0.15).otherwise(0.0))), 3)


def measured(stereo: DataFrame, frames: DataFrame, key: str, samples: str, rate: float = RATE, size: int = FRAME) -> DataFrame:
    """All evidence of each key: from stereo(key, left, right), a row a sample, and from frames(key, samples) of the middle.

    Columns: mid_side_ratio, stereo_correlation, transient_crest_db, low_end_mid_ratio, those of ``levels``, resonances (an
    array of frequency_hz, target and excess_db) and vocal_center_confidence. A key without a whole frame has no row.
    """
    spectra = selection.held(median_spectrum(frames, key, samples, size))
    found = resonances(spectra, key, rate, size).groupBy(F.col(key).alias("_r")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "frequency_hz", "target", "excess_db"))), lambda x: F.struct(x["frequency_hz"].alias("frequency_hz"), x["target"].alias("target"), x["excess_db"].alias("excess_db"))).alias("resonances"))  # eight at most
    sides = signal.mid_side(stereo, key).withColumnRenamed("correlation", "stereo_correlation").withColumnRenamed("crest_db", "transient_crest_db").withColumnRenamed(key, "_s")
    joined = levels(spectra, key, rate, size).join(found, F.col(key) == F.col("_r"), "left").join(sides, F.col(key) == F.col("_s")).drop("_r", "_s")
    none = F.array().cast("array<struct<frequency_hz:double,target:string,excess_db:double>>")
    joined = joined.withColumns({"resonances": F.coalesce("resonances", none), "low_end_mid_ratio": F.col("mid_side_ratio")})
    return joined.withColumn("vocal_center_confidence", confidence(F.col("mid_side_ratio"), F.col("resonances")))


def of_files(spark: SparkSession, folder: str, seconds: float = 30.0, **options) -> DataFrame:
    """The evidence of the sound files below a folder: the middle ``seconds`` of each, at 44,100 samples a second."""
    common = {"rate": RATE, "seconds": seconds, "center": "true", **options}
    stereo = wav.load(spark, folder, "path", "left", "right", **common).select("path", F.explode(F.arrays_zip("left", "right")).alias("x")).select("path", F.col("x.left").cast("double").alias("left"), F.col("x.right").cast("double").alias("right"))
    frames = wav.load(spark, folder, "path", "mono", frame=FRAME, hop=HOP, **common)
    return measured(stereo, frames, "path", "mono")
