"""Segmentation of a series: greedy boundaries, section statistics, labels, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even


def boundaries(frames: DataFrame, key: str, level_jump: float, shape_jump: float, least: int) -> DataFrame:
    """key, series (its frames in order) and cuts: positions where level or brightness jump, at least ``least`` frames
    after the last cut; the first and the last position always are. A fold over each series, in the JVM."""
    series = frames.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("frame", F.col("rms_db").alias("e"), F.col("bright").alias("b")))).alias("series"))  # one series' frames

    def step(cuts: Column, i: Column) -> Column:
        now, was = F.get("series", i), F.get("series", i - 1)
        jump = (F.abs(now["e"] - was["e"]) > level_jump) | (F.abs(now["b"] - was["b"]) > shape_jump)
        return F.when(jump & (i - F.element_at(cuts, -1) >= least), F.concat(cuts, F.array(i))).otherwise(cuts)

    inner = F.when(F.size("series") > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("series") - 1, F.lit(1))), F.array(F.lit(0)), step)).otherwise(F.array(F.lit(0)))
    return series.withColumn("cuts", F.array_distinct(F.concat(inner, F.array(F.size("series") - 1))))


def sections(cut: DataFrame, key: str) -> DataFrame:
    """A row for each section with its label. Both ends belong to a section, so neighbours share a frame."""
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.size("cuts") - 1, F.lit(1))), lambda k: F.struct((k - 1).alias("idx"), F.get("cuts", k - 1).alias("a"), F.coalesce(F.get("cuts", k), F.get("cuts", k - 1)).alias("b")))
    rows = cut.select(key, "series", F.size("cuts").alias("n_cuts"), F.explode(at).alias("s"))
    part = F.slice("series", F.col("s.a") + 1, F.col("s.b") - F.col("s.a") + 1)
    total = lambda f: F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc + F.round(x[f] * 10000).cast("long"))
    mean = lambda f: F.floor(total(f) / F.size(part) + 0.5) / 10000.0
    levels = F.sort_array(F.transform("series", lambda x: x["e"]))
    rows = rows.select(key, F.col("s.idx").alias("section"), F.get("series", F.col("s.a"))["frame"].alias("first_frame"), F.get("series", F.col("s.b"))["frame"].alias("last_frame"), F.size(part).alias("n"), mean("e").alias("energy"), mean("b").alias("bright"), "n_cuts", F.element_at(levels, F.floor(F.size("series") / 2).cast("int") + 1).alias("middle"), (F.col("s.a") / F.greatest(F.size("series") - 1, F.lit(1))).alias("place"))
    e, m = F.col("energy"), F.col("middle")
    first, last = F.col("section") == 0, F.col("section") == F.col("n_cuts") - 2
    label = (
        F.when(F.col("n_cuts") < 2, "single").when(first & (e < m - 1.5), "intro").when(last & (e < m - 1.0), "outro").when((e > m + 1.8) & (F.col("bright") > 1.0), "drop").when(e > m + 1.8, "chorus")
        .when((e < m - 1.2) & (F.col("place") > 0.25) & (F.col("place") < 0.85), "breakdown").when(e < m - 1.2, "verse").when(F.col("bright") > 0.8, "build").otherwise("verse")
    )
    sure = F.when((F.col("label") == "intro") | (F.col("label") == "outro"), 0.78).when(F.col("label").isin("drop", "chorus"), 0.72).when(e < m - 1.2, 0.64).otherwise(0.60)
    return rows.withColumn("label", label).withColumn("confidence", sure).drop("n_cuts", "middle", "place")


def compact(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Sections shorter than ``least`` frames are merged into the one before, in order; a ``verse`` takes on the label."""
    item = F.struct("section", F.col("first_frame").alias("a"), F.col("last_frame").alias("b"), F.col("n").cast("long").alias("n"), "label", "confidence")
    empty = F.array().cast("array<struct<section:int,a:bigint,b:bigint,n:bigint,label:string,confidence:double>>")

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        merged = F.struct(last["section"].alias("section"), last["a"].alias("a"), x["b"].alias("b"), (last["n"] + x["n"]).alias("n"), F.when(last["label"] == "verse", x["label"]).otherwise(last["label"]).alias("label"), half_even((last["confidence"] + x["confidence"]) / 2, 2).alias("confidence"))
        short = (F.size(out) > 0) & (x["n"] < least)
        return F.when(short, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(out, F.array(x)))

    folded = rows.groupBy(key).agg(F.aggregate(F.sort_array(F.collect_list(item)), empty, step).alias("out"))  # one series' sections
    return folded.select(key, F.posexplode("out").alias("section", "s")).select(key, "section", F.col("s.a").alias("first_frame"), F.col("s.b").alias("last_frame"), F.col("s.n").alias("n"), F.col("s.label").alias("label"), F.col("s.confidence").alias("confidence"))
