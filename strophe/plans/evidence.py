"""What an action claims to have measured, held against what was measured of its recording.

actions: as in ``plans.actions``, with ``evidence`` (numbers by name), ``side`` (stereo, mid or side; null is stereo),
``local`` (numbers measured of the recording, by name) and ``resonances`` (its candidates: an array of frequency_hz,
target and excess_db, as ``operators.resonance.measured`` has them, in that order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import apart

#: Bands in Hz, and where voices have resonances.
RANGES = {"sub_bass": (20.0, 60.0), "bass": (60.0, 250.0), "low_mid": (250.0, 500.0), "mid": (500.0, 2000.0), "high_mid": (2000.0, 6000.0), "air": (6000.0, 20000.0)}
VOICE = (1800.0, 8000.0)
#: How far a claim may be off, in Hz (at least, and as a share), in dB, and of ratios; what is a middle, a side, a sure voice.
HZ_OFF, HZ_SHARE, DB_OFF, RATIO_OFF = 100.0, 0.10, 0.75, 0.05
MIDDLE, SIDE, SURE, IN_PHASE = 0.60, 0.40, 0.65, 0.70
#: What a function must have measured.
METRICS = {
    "audio.transient.dynamic_control": "transient_crest_db", "audio.stereo.correlation_guard": "stereo_correlation", "audio.low_end.dynamic_balance": "low_end_level_db",
    "audio.spectral.deharsh": "harshness_excess_db", "audio.spectral.dullness_recovery": "dullness_deficit_db",
}
RESONANCE, SUPPRESSOR, NATURALIZER = "audio.dynamic_eq.resonance", "audio.vocal.resonance_suppressor", "audio.vocal.center_naturalizer"


def proven(actions: DataFrame) -> DataFrame:
    """actions with ``unproven``: the first claim that what was measured does not bear out, null if there is none.

    A resonance is matched to the first candidate within 100 Hz or a tenth of its frequency (of its band, or where voices
    have them), so what has been measured decides which one is meant.
    """
    f, c = F.col("function_id"), F.col
    ranges = F.create_map(*(F.lit(x) for b, (lo, hi) in RANGES.items() for x in (b, F.array(F.lit(lo), F.lit(hi)))))
    metrics = F.create_map(*(F.lit(x) for kv in METRICS.items() for x in kv))
    claim = lambda n, default=None: F.coalesce(F.col("evidence")[n], F.lit(default).cast("double"))
    own = lambda n, default=None: F.coalesce(F.col("local")[n], F.lit(default).cast("double"))
    param = lambda n, default=0.0: F.coalesce(F.col("params")[n], F.lit(default))
    voiced = F.startswith(f, F.lit("audio.vocal."))
    told = actions.withColumns({
        "_hz": apart(param("frequency_hz")), "_range": ranges[c("target")], "_metric": metrics[f], "_claimed_hz": claim("resonance_frequency_hz"), "_excess": claim("measured_excess_db", 0.0),
        "_ratio": own("mid_side_ratio"), "_claimed_ratio": claim("mid_side_ratio"), "_sure": own("vocal_center_confidence", 0.0), "_claimed_sure": claim("vocal_center_confidence", -1.0),
    })
    told = told.withColumn("_off", F.greatest(F.lit(HZ_OFF), c("_hz") * HZ_SHARE))
    fits = lambda r: (F.abs(r["frequency_hz"] - c("_hz")) <= c("_off")) & F.when(voiced, r["frequency_hz"].between(*VOICE)).otherwise(r["target"] == c("target"))
    told = told.withColumns({"_match": F.get(F.filter(F.coalesce("resonances", F.array().cast("array<struct<frequency_hz:double,target:string,excess_db:double>>")), fits), F.lit(0)), "_own": F.col("local")[c("_metric")], "_told": F.col("evidence")[c("_metric")]})

    side = F.coalesce("side", F.lit("stereo"))
    sided = side.isin("mid", "side")
    no = lambda x: F.coalesce(~x, F.lit(True))  # noqa: E731  not so, or not known
    excess_off = F.abs(c("_match.excess_db") - c("_excess")) > DB_OFF
    resonance = (
        F.when(c("_claimed_hz").isNull(), "no resonance claimed").when(F.abs(c("_claimed_hz") - c("_hz")) > c("_off"), "another resonance claimed")
        .when(c("_match").isNull(), "no such resonance").when(excess_off, "another excess claimed")
    )
    middle = (
        F.when(c("_claimed_ratio").isNull(), "no ratio claimed").when(no(c("_claimed_ratio").between(0.0, 1.0)), "no ratio").when(c("_ratio").isNull(), "no ratio measured").when(F.abs(c("_ratio") - c("_claimed_ratio")) > RATIO_OFF, "another ratio claimed")
        .when((side == "mid") & (c("_claimed_ratio") < MIDDLE), "no middle").when((side == "side") & (c("_claimed_ratio") > SIDE), "no side")
    )
    dynamic = F.when(no(c("_hz").between(c("_range")[0], c("_range")[1])), "outside its band").otherwise(F.coalesce(F.when(f == RESONANCE, resonance), F.when(sided, middle)))
    parts = {"body_gain_db": "measured_body_deficit_db", "harshness_reduction_db": "measured_harshness_excess_db", "air_reduction_db": "measured_air_excess_db"}
    lacking = F.lit(None).cast("string")
    for p, e in reversed(parts.items()):
        lacking = F.when((param(p) > 0) & (claim(e, 0.0) <= 0), F.lit(f"no {e}")).otherwise(lacking)
    natural = F.when(param("body_gain_db") + param("harshness_reduction_db") + param("air_reduction_db") <= 0, "corrects nothing").otherwise(lacking)
    suppress = F.when(c("_match").isNull() | (F.abs(F.coalesce("_claimed_hz", F.lit(0.0)) - c("_hz")) > c("_off")), "no such resonance").when(excess_off, "another excess claimed")
    ratio = F.coalesce("_ratio", F.lit(0.0))
    voice = (
        F.when((ratio < MIDDLE) | (c("_sure") < SURE), "no sure voice").when((F.abs(F.coalesce("_claimed_ratio", F.lit(-1.0)) - ratio) > RATIO_OFF) | (F.abs(c("_claimed_sure") - c("_sure")) > RATIO_OFF), "another voice claimed")
        .otherwise(F.when(f == SUPPRESSOR, suppress).otherwise(natural))
    )
    metric, width = c("_metric"), param("width", 1.0)
    low = own("low_end_mid_ratio", -1.0)
    measured = (
        F.when(c("_own").isNull() | c("_told").isNull(), "not measured").when(F.abs(c("_own") - c("_told")) > F.when(metric == "stereo_correlation", RATIO_OFF).otherwise(DB_OFF), "another value claimed")
        .when((metric == "stereo_correlation") & (width > 1) & (c("_own") < IN_PHASE), "not in phase").when((metric == "stereo_correlation") & (width < 1) & (c("_own") >= 0), "not out of phase")
        .when((metric == "low_end_level_db") & (no(low.between(0.0, 1.0)) | (F.abs(low - claim("low_end_mid_ratio", -2.0)) > RATIO_OFF)), "another ratio claimed")
        .when(metric.isin("harshness_excess_db", "dullness_deficit_db") & (c("_own") <= 0), "nothing to mend")
    )
    found = F.when(F.startswith(f, F.lit("audio.dynamic_eq.")), dynamic).when(voiced, voice).when(metric.isNotNull(), measured)
    return told.withColumn("unproven", found).withColumn("side", apart(F.col("side"))).drop("_hz", "_range", "_metric", "_claimed_hz", "_excess", "_ratio", "_claimed_ratio", "_sure", "_claimed_sure", "_off", "_match", "_own", "_told")
