"""From frames to rule events, and from events to intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_even

#: Severities in ascending order.
SEVERITIES = ["low", "medium", "high"]


@dataclass(frozen=True)
class Rules:
    """Thresholds in dB. The defaults are those for audio frames; other series bring their own."""

    peak_high: float = -1.0
    peak_medium: float = -2.0
    peak_rms: float = -15.0
    peak_crest: float = 14.0
    harsh_high: float = 4.0
    harsh_medium: float = 2.8
    weak: tuple[float, float] = (-28.0, -24.0)
    hot: tuple[float, float] = (-14.0, -12.0)
    flat_crest: float = 4.0
    flat_rms: float = -16.0


def rule_events(frames: DataFrame, key: str, bands: dict[str, str], rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """None to four events for each frame: key, frame, t, type, severity, confidence.

    bands: the columns that stand for sub, bass, mid, high_mid and air.
    """
    sub, bass, mid, high, air = (F.col(bands[b]) for b in ("sub", "bass", "mid", "high_mid", "air"))
    rms, peak, crest = F.col("rms_db"), F.col("peak_db"), F.col("crest_db")
    sharp = F.greatest(high - mid, air - mid)

    def event(kind: str, severity: str, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))

    found = F.array(
        F.when(peak > rules.peak_high, event("peak_risk", "high", 0.95)).when((peak > rules.peak_medium) & ((rms > rules.peak_rms) | (crest < rules.peak_crest)), event("peak_risk", "medium", 0.78)),
        F.when(sharp > rules.harsh_high, event("harshness_risk", "high", 0.85)).when(sharp > rules.harsh_medium, event("harshness_risk", "medium", 0.70)),
        F.when((sub < rules.weak[0]) & (bass < rules.weak[1]), event("low_end_weak", "medium", 0.72)).when((sub > rules.hot[0]) & (bass > rules.hot[1]), event("low_end_hot", "medium", 0.74)),
        F.when((crest < rules.flat_crest) & (rms > rules.flat_rms), event("dynamic_flat", "low", 0.60)),
    )
    return frames.select(key, "frame", "t", F.explode(F.array_compact(found)).alias("e")).select(key, "frame", "t", "e.type", "e.severity", "e.confidence")


def merge_by_gap(events: DataFrame, keys: list[str], t: str, gap: float, tie: str | None = None) -> DataFrame:
    """Events of a key that are no further apart than ``gap`` (inclusive) as one interval: keys, start_t, end_t, samples.

    With the columns severity and confidence also their merge: the worst severity and the running mean of the
    confidence, which is rounded to hundredths at each step and so depends on the order (t, then ``tie``).
    """
    by = Window.partitionBy(*keys).orderBy(t, *([tie] if tie else []))
    fresh = F.coalesce((F.col(t) - F.lag(t).over(by) > gap).cast("int"), F.lit(1))
    islands = events.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = {"start_t": F.min(t), "end_t": F.max(t), "samples": F.count("*")}
    if "confidence" in events.columns:
        rank = sum((F.when(F.col("severity") == s, i).otherwise(0) for i, s in enumerate(SEVERITIES)), F.lit(0))
        order = F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), *([F.col(tie).alias("k")] if tie else []), F.col("confidence").alias("c"))))  # one interval's events
        start = F.struct(F.lit(0.0).alias("mean"), F.lit(0).alias("n"))
        mean = F.aggregate(order, start, lambda a, x: F.struct(half_even((a["mean"] * a["n"] + x["c"]) / (a["n"] + 1), 2).alias("mean"), (a["n"] + 1).alias("n")), lambda a: a["mean"])
        out |= {"severity": F.element_at(F.array(*(F.lit(s) for s in SEVERITIES)), F.max(rank) + 1), "confidence": mean}
    return islands.groupBy(*keys, "_island").agg(*(c.alias(n) for n, c in out.items())).drop("_island")


def with_events(frames: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Each frame with the number and the kinds of its events; the join is on the frame's number, not on its time."""
    per_frame = events.groupBy(key, "frame").agg(F.count("*").alias("events"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("kinds"))
    return frames.join(per_frame, [key, "frame"], "left").withColumns({"events": F.coalesce("events", F.lit(0)).cast("long"), "kinds": F.coalesce("kinds", F.lit(""))})
