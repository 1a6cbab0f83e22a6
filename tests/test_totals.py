"""Exact totals in compiled code, samples in bounded tasks, medians of small and of large groups."""

import numpy as np
from pyspark.sql import functions as F

from strophe.functions import numeric
from strophe.operators import chunks, crossover, selection
from strophe.queries import signals


def odd_values(digits):
    """Middles between two units, their neighbours, and values of all sizes."""
    middles = (np.arange(-300, 300) + 0.5) / 10**digits
    rng = np.random.default_rng(digits)
    return np.concatenate((middles, np.nextafter(middles, 1), np.nextafter(middles, -1), rng.normal(0, 1, 500), rng.normal(0, 1e-7, 200), (rng.integers(0, 10**6, 300) + 0.5) / 10**digits, [0.0, -0.0, 12345.6789125, -4e5]))


def test_totals_are_those_of_decimals(spark):
    for digits in (3, 6, 9):
        rows = [(i % 3, float(v)) for i, v in enumerate(odd_values(digits))] + [(7, None), (1, None)]
        df = spark.createDataFrame(rows, "k int, v double")
        want = {r.k: r.t for r in df.groupBy("k").agg(numeric.total(F.col("v"), digits).alias("t")).collect()}
        assert {r.k: r.t for r in numeric.totals(df, ["k"], {"t": F.col("v")}, digits).collect()} == want
        each = df.where("v IS NOT NULL").select("v", (numeric.half_even(F.col("v"), digits) * 10.0**digits).alias("w"), numeric.units(F.col("v"), digits).alias("u")).toPandas()
        assert (each.u == each.w.round()).all() and (numeric.half_even_units(each.v.to_numpy(), digits) == each.u).all()
    assert "transform(" not in numeric.totals(df, ["k"], {"t": F.col("v")}, 6)._jdf.queryExecution().optimizedPlan().toString()


def test_samples_lie_in_bounded_tasks(spark, small, monkeypatch):
    monkeypatch.setattr(chunks, "SPREAD", 500)
    rows = signals.samples(spark, small)
    sizes = [n for n in rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    of_track = max(r["count"] for r in rows.groupBy("track").count().collect())
    assert len(sizes) > 4 and max(sizes) < 500 + 3 * of_track
    assert rows.groupBy("track").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_magnitudes_are_the_sums_of_what_equalised_gives(spark):
    rng = np.random.default_rng(2)
    signals_of = {"a": rng.normal(0, 1, 700), "b": rng.normal(0, 1, 64), "c": np.array([1.0]), None: rng.normal(0, 1, 50)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in signals_of.items() for i, v in enumerate(x)], "k string, i long, x double")
    args = ("k", 8000.0, {"air": -6.0})
    out = crossover.equalised(df, *args, size=64)
    want = out.groupBy("k").agg(F.count("*").alias("n"), *(numeric.total(F.abs(c), 6).alias(c) for c in ("x", *crossover.BANDS)))
    assert sorted(map(str, crossover.magnitudes(df, *args, 6, size=64).collect())) == sorted(map(str, want.collect()))


def test_medians_of_small_and_large_groups_are_those_of_spark(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, j, float(v)) for k in (1, 2, None) for j, n in enumerate((1, 2, 3, 40, 41)) for v in rng.integers(-9, 9, n) / 7] + [(1, 0, None), (5, 1, None), (6, 0, float("nan")), (6, 0, 1.0)]
    df = spark.createDataFrame(rows, "k int, j int, v double")
    want = sorted(map(str, df.where("v IS NOT NULL").groupBy("k", "j").agg(F.median("v").alias("m")).collect()))
    for small in (4, 1, selection.SMALL):
        monkeypatch.setattr(selection, "SMALL", small)
        assert sorted(map(str, selection.median(df, ["k", "j"], "v", "m").collect())) == want


def test_tasks_of_medians_hold_so_many_counts(spark, monkeypatch):
    monkeypatch.setattr(selection, "TASK", 100)
    df = spark.range(4000).select((F.col("id") % 400).alias("k"), (F.col("id") * 37 % 1009 / 7).alias("v"))
    plan = selection.median(df, ["k"], "v", "m")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 40)" in plan
