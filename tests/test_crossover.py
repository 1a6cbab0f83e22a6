"""Bands by recursive filters in blocks against one pass over the whole signal."""

import numpy as np
import pytest

from strophe.operators import crossover


def one_pass(x, rate):
    low, a = [], crossover.poles(rate, crossover.EDGES)
    for p in a:
        one = two = 0.0
        out = []
        for v in x:
            one = p * one + (1 - p) * v
            two = p * two + (1 - p) * one
            out.append(two)
        low.append(out)
    return np.diff(np.stack([np.zeros(len(x)), *low, x], 1), axis=1)


@pytest.mark.parametrize("size", [16, 100, 8192])
def test_blocks_equal_one_pass(spark, size):
    rng = np.random.default_rng(1)
    signals = {"a": rng.normal(0, 1, 1000), "b": np.sin(np.arange(333) / 5), "c": np.array([1.0]), None: rng.normal(0, 1, 50)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in signals.items() for i, v in enumerate(x)], "k string, i long, x double").repartition(5, "i")
    got = {}
    for r in crossover.equalised(df, "k", 8000.0, {}, size=size).collect():
        got[r.k, r.i] = r
    assert len(got) == sum(map(len, signals.values()))
    for k, x in signals.items():
        want = one_pass(x, 8000.0)
        for i, v in enumerate(x):
            r = got[k, i]
            assert abs(r.x - v) < 1e-6 and all(abs(r[n] - want[i, j]) < 1e-9 for j, n in enumerate(crossover.BANDS))


def test_gains_move_their_band(spark):
    rate, n = 44100, 20000
    tone = lambda hz: np.sin(2 * np.pi * hz * np.arange(n) / rate)
    df = spark.createDataFrame([(k, i, float(v)) for k, hz in (("low", 30.0), ("high", 12000.0)) for i, v in enumerate(tone(hz))], "k string, i long, x double")
    level = lambda rows: 10 * np.log10(np.mean([r.x**2 for r in rows if r.i > 5000]) / 0.5)
    rows = crossover.equalised(df, "k", rate, {"air": -12.0}, size=2048).collect()
    low, high = (level([r for r in rows if r.k == k]) for k in ("low", "high"))
    assert abs(low) < 0.2 and -12.5 < high < -6
