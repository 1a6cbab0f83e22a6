"""Comparisons of a series before and after a change, and stereo figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def integrity(rows: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Level change, the correlation about 0 (not about the mean), peak and clipped samples of paired samples."""
    b, p = F.col(before), F.col(after)
    rms = lambda x: F.sqrt(F.avg(x * x))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.round(20 * F.log10(F.greatest(rms(p), F.lit(1e-12)) / F.greatest(rms(b), F.lit(1e-12))), 4).alias("level_delta_db"),
        F.round(20 * F.log10(F.greatest(rms(p - b), F.lit(1e-12))), 4).alias("delta_rms_db"),
        F.round(F.sum(b * p) / F.sqrt(F.sum(b * b) * F.sum(p * p)), 6).alias("correlation"),
        F.max(F.abs(p)).alias("peak"),
        F.count_if(F.abs(p) >= 0.999999).alias("clipped"),
    )


def stereo(left: Column, right: Column) -> dict[str, Column]:
    """From two arrays of samples: the middle's share of the level, the correlation about 0 and the crest in dB."""
    both = F.arrays_zip(left.alias("l"), right.alias("r"))
    total = lambda f: F.aggregate(both, F.lit(0.0), lambda a, x: a + f(x["l"].cast("double"), x["r"].cast("double")))
    n = F.size(left)
    mid, side = F.sqrt(total(lambda a, b: (a + b) * (a + b) / 4) / n), F.sqrt(total(lambda a, b: (a - b) * (a - b) / 4) / n)
    peak = F.array_max(F.transform(both, lambda x: F.greatest(F.abs(x["l"]), F.abs(x["r"]))))
    rms = F.sqrt(total(lambda a, b: (a * a + b * b) / 2) / n)
    return {
        "mid_ratio": F.round(mid / (mid + side + 1e-12), 4),
        "correlation": F.round(total(lambda a, b: a * b) / F.sqrt(total(lambda a, b: a * a) * total(lambda a, b: b * b)), 4),
        "crest_db": F.round(20 * F.log10(peak.cast("double") / rms), 4),
    }


def before_after(rows: DataFrame, key: str, period: Column, value: str) -> DataFrame:
    """Averages of two periods side by side, with the signed change as text; a missing side is N/A."""
    per = rows.groupBy(key).agg(F.round(F.avg(F.when(period == 0, F.col(value))), 2).alias("before"), F.round(F.avg(F.when(period == 1, F.col(value))), 2).alias("after"))
    return per.withColumn("delta", F.when(F.col("before").isNull() | F.col("after").isNull(), "N/A").otherwise(F.format_string("%+.1f", F.floor((F.col("after") - F.col("before")) * 10 + 0.5) / 10)))
