"""Scalar expressions used by all operators."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_even(x: Column, digits: int) -> Column:
    """Rounded to so many digits by the exact value of the double; what lies halfway goes to the even neighbour.

    The product with the power of ten is taken in two parts, what a double holds and what it leaves out, so that a
    value just beside the middle is not taken for it. For magnitudes below 2**52 / 10**digits.
    """
    scale = float(10**digits)

    def rounded(v: Column) -> Column:
        whole = v * scale
        high = v * 134217729.0 - (v * 134217729.0 - v)
        rest = (high * scale - whole) + (v - high) * scale
        low = F.floor(whole).cast("double")
        over = (whole - low - 0.5) + rest
        up = (over > 0) | ((over == 0) & (F.pmod(low, F.lit(2.0)) == 1))
        return F.when(up, low + 1).otherwise(low) / scale

    return let(x.cast("double"), rounded)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once; the optimizer would inline it wherever it is named otherwise."""
    return F.transform(F.array(value), body)[0]


def apart(value: Column) -> Column:
    """value as it is, in a projection that is compiled by itself.

    Joins and projections in a row are one generated method otherwise, and the JVM does not compile methods beyond 8,000
    bytes: rows of wide ones then take some ten times as long.
    """
    return let(value, lambda v: v)


def total(x: Column, digits: int) -> Column:
    """The sum of values with so many digits, added as decimals: no order of rows changes it."""
    return F.sum(half_even(x, digits).cast(f"decimal(28,{digits})")).cast("double")


def units(v: Column, digits: int) -> Column:
    """v times that power of ten, rounded as ``half_even`` rounds it, as a long. Names v often: for columns, not for expressions.

    Away from the middle between two integers the double product tells the nearest one; only next to it the exact value is taken.
    """
    scale = float(10**digits)
    whole = v * scale
    near, low = F.rint(whole), F.floor(whole).cast("double")
    clear = (F.abs(F.abs(whole - near) - 0.5) > 2.0**-20) & (F.abs(whole) < 2.0**32)  # the product is off by less than 2**-21 then
    high = v * 134217729.0 - (v * 134217729.0 - v)
    over = (whole - low - 0.5) + ((high * scale - whole) + (v - high) * scale)
    up = (over > 0) | ((over == 0) & (F.pmod(low, F.lit(2.0)) == 1))
    return F.when(clear, near).when(up, low + 1).otherwise(low).cast("long")


def half_even_units(v: np.ndarray, digits: int) -> np.ndarray:
    """The same for an array."""
    scale = float(10**digits)
    whole = v * scale
    low, high = np.floor(whole), v * 134217729.0 - (v * 134217729.0 - v)
    over = (whole - low - 0.5) + ((high * scale - whole) + (v - high) * scale)
    return (low + ((over > 0) | ((over == 0) & (low % 2 == 1)))).astype(np.int64)


def unit_sum(u: Column, digits: int) -> Column:
    """The sum of longs that count units of 10**-digits, as a double; added in two parts, none of which runs over."""
    part = 1 << 20
    both = F.sum(F.shiftright(u, 20)).cast("decimal(19,0)") * F.lit(Decimal(part)) + F.sum(u.bitwiseAND(F.lit(part - 1))).cast("decimal(19,0)")
    return (both.cast("decimal(28,0)") * F.lit(Decimal(1).scaleb(-digits))).cast("double")


def totals(rows: DataFrame, by: list[str], values: dict[str, Column], digits: int, *more: Column) -> DataFrame:
    """``total`` of each of values for each group, beside further aggregates of columns in by or in values.

    Values are columns before they are rounded, and what is rounded is a column before it is added, so that it all is compiled code.
    """
    told = rows.select(*by, *(v.cast("double").alias(n) for n, v in values.items()))
    return told.groupBy(*by).agg(*more, *(unit_sum(units(F.col(n), digits), digits).alias(n) for n in values))


def sum_in_order(x: Column, *order: str) -> Column:
    """The sum of a group's doubles, added in an order of its rows. For groups that fit a row, such as a plan's actions."""
    listed = F.sort_array(F.collect_list(F.struct(*order, x.cast("double").alias("_x"))))
    return F.aggregate(listed, F.lit(0.0), lambda a, e: a + e["_x"])


def rounds_above(limit: float, digits: int) -> float:
    """The least double that is more than limit once rounded to so many digits: x >= this tests the rounded x."""
    x = limit + 0.5 / 10**digits
    while round(x, digits) > limit + 1e-9:
        x = math.nextafter(x, -math.inf)
    while round(x, digits) <= limit + 1e-9:
        x = math.nextafter(x, math.inf)
    return x


def fixed(x: Column, digits: int) -> Column:
    """A number as text with so many digits, rounded as above; a negative one keeps its sign where only zeros are left."""
    sign = F.when(F.startswith(x.cast("double").cast("string"), F.lit("-")), "-").otherwise("")
    return F.when(x.isNotNull(), F.concat(sign, F.format_string(f"%.{digits}f", half_even(F.abs(x), digits))))


def mean(x: Column, digits: int = 4) -> Column:
    """The mean of values with that many digits, rounded half up: summed as integers, so no order changes it."""
    scale = 10**digits
    return F.floor(F.sum(F.round(x * scale).cast("long")) / F.count(x) + 0.5) / float(scale)


def to_db(x: Column, floor: float = -120.0) -> Column:
    """Decibels of a linear amplitude; silence is the floor."""
    return F.when(x <= 1e-12, floor).otherwise(F.greatest(F.lit(floor), 20 * F.log10(F.greatest(x, F.lit(1e-12)))))


def from_db(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def number(text: Column, default: float) -> Column:
    """A text read as a finite number, else the default."""
    x = text.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(x)


def clean_loudness(x: Column, key: str, integrated: Column | None = None) -> Column:
    """Measured loudness figures without infinities: -inf is silence; +inf and NaN fall back by figure.

    A missing threshold lies 10 below integrated, the cleaned integrated loudness.
    """
    integrated = F.lit(-23.0) if integrated is None else integrated
    fallback = {"input_tp": 0.0, "input_i": -70.0}.get(key, 0.0)
    missing = {"input_i": -23.0, "input_tp": -1.0, "input_lra": 7.0, "target_offset": 0.0}.get(key)
    instead = F.lit(missing) if missing is not None else integrated - 10
    return F.when(x.isNull(), instead).when(x == float("-inf"), -70.0).when(F.isnan(x) | (x == float("inf")), fallback).otherwise(x)


def bucket_percent(key: Column, digest: str = "md5") -> Column:
    """A stable bucket from 0 to 99 by the first 32 bits of a digest."""
    hashed = F.md5(key) if digest == "md5" else F.sha2(key, 256)
    return (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") % 100).cast("int")


def signed_split(x: Column) -> tuple[Column, Column]:
    """The boost and the cut in a signed value; they are never netted."""
    return F.greatest(x, F.lit(0.0)), F.greatest(-x, F.lit(0.0))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def width_db(width: Column) -> Column:
    """What a stereo width above 1 may add to a peak, in decibels."""
    return F.when(width > 1, 20 * F.log10(width)).otherwise(0.0)


def confidence(raw: Column) -> Column:
    return half_even(clamp(raw, 0.2, 0.99), 2)


def calibration_step(lufs: Column, peak: Column, target: float, ceiling: float, response: Column, loudness_off: float = 0.20, peak_off: float = 0.15, least: float = 0.08) -> Column:
    """The gain that a measured render still needs, null if none: steps grow with the distance and leave room for peaks.

    response: decibels that one decibel of gain was found to give.
    """
    off, room = target - lufs, ceiling - peak
    quiet, hot = F.abs(off) > loudness_off, peak > ceiling + peak_off
    most = F.when(F.abs(off) > 8, 2.5).when(F.abs(off) > 5, 2.0).when((F.abs(off) > 3) | (peak > ceiling + 0.5), 1.5).otherwise(0.85)
    wanted = F.when(hot & ~quiet, room).when(hot | (off > 0), F.least(off, room)).otherwise(off)
    wanted = F.when(F.abs(response) > 0.05, wanted / response).otherwise(wanted)
    gain = F.greatest(F.least(wanted, most), -most)
    return F.when(quiet | hot, F.when(F.abs(gain) >= least, gain).when(hot, -least))


def damped_response(response: Column, before: Column, after: Column, gain: Column) -> Column:
    """The response after a render: half the old one, half of what was observed; null without a gain."""
    return F.when(gain.isNotNull(), 0.5 * response + 0.5 * clamp((after - before) / gain, 0.35, 1.65))
