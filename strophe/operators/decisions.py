"""Section decisions, risk gates, guards, validation and rollout roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import bucket_percent, clamp, half_even

#: A section label's profile (sub, bass, mid, high_mid, air, deess, saturation, motion, tightness, margin).
PROFILES = [
    ("intro", 0.10, 0.05, 0.00, -0.5, -0.8, 0.00, 0.96, 0.92, 0.55, 0.00),
    ("drop", 0.25, 0.20, -0.05, -0.8, -1.0, 0.02, 1.03, 1.00, 0.68, -0.05),
    ("chorus", 0.25, 0.20, -0.05, -0.8, -1.0, 0.02, 1.03, 1.00, 0.68, -0.05),
    ("breakdown", 0.05, 0.05, 0.03, -0.6, -0.8, 0.01, 0.98, 0.96, 0.60, 0.00),
    ("verse", 0.05, 0.05, 0.03, -0.6, -0.8, 0.01, 0.98, 0.96, 0.60, 0.00),
    ("outro", 0.00, 0.02, 0.00, -0.4, -0.6, 0.00, 0.94, 0.90, 0.58, 0.00),
]
OTHERWISE = (0.12, 0.08, 0.00, -0.06, -0.04, 0.01, 1.00, 0.98, 0.62, 0.00)
FIELDS = ["sub", "bass", "mid", "high_mid", "air", "deess", "saturation", "motion", "tightness", "margin"]
#: The limits of each field, in the order of FIELDS.
LIMITS = [(-1.5, 1.5)] * 5 + [(-0.08, 0.12), (0.84, 1.08), (0.84, 1.08), (0.45, 0.90), (-0.25, 0.10)]


def decide(sections: DataFrame, counts: list[str]) -> DataFrame:
    """Sections (label and a count for each event type in columns) with their actions: profile, event deltas, limits.

    A delta applies once, whatever the count; ``dynamic_flat`` only where the low end isn't hot.
    """
    spark = sections.sparkSession
    table = spark.createDataFrame(PROFILES, "label string, " + ", ".join(f"{f} double" for f in FIELDS))
    out = sections.join(F.broadcast(table), "label", "left").withColumns({f: F.coalesce(f, F.lit(v)) for f, v in zip(FIELDS, OTHERWISE, strict=True)})
    has = {c: F.coalesce(F.col(c), F.lit(0)) > 0 for c in counts}
    no = F.lit(False)
    harsh, weak, hot, peak = (has.get(c, no) for c in ("harshness_risk", "low_end_weak", "low_end_hot", "peak_risk"))
    flat = has.get("dynamic_flat", no) & ~hot

    def step(cond: Column, f: str, how) -> None:
        nonlocal out
        out = out.withColumn(f, half_even(F.when(cond, how(F.col(f))).otherwise(F.col(f)), 3))

    for f, d in (("high_mid", -1.0), ("air", -1.5), ("deess", 0.08)):
        step(harsh, f, lambda x, d=d: x + d)
    step(harsh, "saturation", lambda x: F.greatest(F.lit(0.85), x - 0.06))
    for f, d in (("sub", 0.20), ("bass", 0.16)):
        step(weak, f, lambda x, d=d: x + d)
    step(weak, "tightness", lambda x: F.greatest(F.lit(0.52), x - 0.05))
    for f, d in (("sub", -0.18), ("bass", -0.14)):
        step(hot, f, lambda x, d=d: x + d)
    step(hot, "tightness", lambda x: F.least(F.lit(0.82), x + 0.08))
    step(hot, "saturation", lambda x: F.greatest(F.lit(0.86), x - 0.03))
    step(peak, "margin", lambda x: x - 0.08)
    step(peak, "saturation", lambda x: F.greatest(F.lit(0.86), x - 0.02))
    step(flat, "motion", lambda x: F.least(F.lit(1.06), x + 0.03))
    return out.withColumns({f: half_even(clamp(F.col(f), lo, hi), 3) for f, (lo, hi) in zip(FIELDS, LIMITS, strict=True)})


def shadow_risk(decisions: DataFrame, key: str) -> DataFrame:
    """A risk for each section summed up to one for each series, and whether it may be applied."""
    eq = F.greatest(*(F.abs(F.col(f)) for f in FIELDS[:5]))
    sat, motion = F.abs(F.col("saturation") - 1), F.abs(F.col("motion") - 1)
    points = [(eq > 0.45, 0.35), (sat > 0.12, 0.25), (motion > 0.12, 0.20), (F.col("margin") < -0.20, 0.25), (F.col("confidence") < 0.55, 0.15)]
    risk = clamp(sum((F.when(c, w).otherwise(0.0) for c, w in points), F.lit(0.0)), 0.0, 1.0)
    rows = decisions.select(key, risk.alias("risk"), eq.alias("eq"), sat.alias("sat"), motion.alias("motion"), F.col("margin"))
    per = rows.groupBy(key).agg(F.count("*").alias("sections"), F.count_if(F.col("risk") >= 0.55).alias("high"), F.max("eq").alias("eq_max"), F.max("sat").alias("sat_max"), F.max("motion").alias("motion_max"), F.least(F.lit(0.0), F.min("margin")).alias("margin_min"))
    unit = lambda x: clamp(x, 0.0, 1.0)
    whole = 0.30 * unit(F.col("eq_max") / 0.6) + 0.22 * unit(F.col("sat_max") / 0.16) + 0.20 * unit(F.col("motion_max") / 0.16) + 0.12 * unit(F.abs("margin_min") / 0.25) + 0.16 * unit(F.col("high") / F.col("sections"))
    per = per.withColumn("global_risk", F.round(whole, 4))
    return per.withColumn("ready", (F.col("global_risk") <= 0.60) & (F.col("high") <= F.greatest(F.lit(1), F.floor(F.col("sections") * 0.35))))


def guard(rows: DataFrame, strict: bool = True) -> DataFrame:
    """rows(lufs, target, peak, ceiling, peak_rate, high_units, drift, ready): what blocks a change and what only warns.

    A figure that wasn't measured warns.
    """
    lufs, slack, rate, units, drift = (0.30, 0.10, 12.0, 8.0, 0.08) if strict else (0.45, 0.20, 16.0, 10.0, 0.12)
    bad = {
        "lufs": F.abs(F.col("lufs") - F.col("target")) > lufs,
        "true_peak": F.col("peak") > F.col("ceiling") + slack,
        "peak_rate": F.col("peak_rate") > rate,
        "high_units": F.col("high_units") > units,
        "stereo": F.col("drift") > drift,
    }
    blockers = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in bad.items()), F.when(~F.col("ready"), F.lit("shadow"))))
    warnings = F.array_compact(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in bad.items())))
    return rows.withColumns({"blockers": F.array_join(blockers, ","), "warnings": F.array_join(warnings, ","), "ok": F.size(blockers) == 0})


def validate(rows: DataFrame) -> DataFrame:
    """rows(lufs, target, peak, ceiling, lra, peak_rate, high_units, worst_overlap) -> status PASS, WARN or FAIL."""
    hard = (F.abs(F.col("lufs") - F.col("target")) <= 0.30) & (F.col("peak") <= F.col("ceiling") + 0.20) & (F.col("lra") >= 2.0)
    soft = (F.col("peak_rate") <= 12) & (F.col("high_units") <= 8) & (F.col("worst_overlap") < 2.0)
    return rows.withColumn("status", F.when(~F.coalesce(hard, F.lit(False)), "FAIL").when(~F.coalesce(soft, F.lit(False)), "WARN").otherwise("PASS"))


def risk_units(intervals: DataFrame, key: str, seconds: float) -> DataFrame:
    """Weighted peak-risk units of intervals(severity, samples), all and high only, and their rate a minute."""
    weight = F.when(F.col("severity") == "high", 1.0).when(F.col("severity") == "medium", 0.5).otherwise(0.25)
    units = weight * clamp(F.col("samples") / 2048, 1.0, 8.0)
    out = intervals.groupBy(key).agg(F.round(F.sum(units), 4).alias("units"), F.round(F.coalesce(F.sum(F.when(F.col("severity") == "high", units)), F.lit(0.0)), 4).alias("high_units"))
    return out.withColumn("per_minute", F.round(F.col("units") / max(seconds / 60, 1 / 60), 4))


def rollout(items: DataFrame, path: str, percent: int) -> DataFrame:
    """items(path, enabled, guard_ok, ready, mode): canary membership and whether a change is applied."""
    chosen = bucket_percent(F.col(path)) < percent
    return items.withColumn("in_canary", chosen).withColumn("apply", chosen & F.col("enabled") & F.col("guard_ok") & F.col("ready") & (F.col("mode") == "adaptive"))


def rollout_report(items: DataFrame) -> DataFrame:
    """Counts and rates over rolled-out items; rates of nothing are 0."""
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c), F.count("*")), F.lit(0.0)), 4)
    return items.agg(F.count("*").alias("items"), F.count_if("in_canary").alias("canary"), F.count_if("apply").alias("applied"), rate(F.col("guard_ok")).alias("guard_rate"), rate(F.col("ready")).alias("ready_rate"), rate(F.col("apply")).alias("apply_rate"))
