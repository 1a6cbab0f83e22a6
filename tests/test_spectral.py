"""Transforms, block correlations, exact selection and the evidence of recordings against plain versions."""

import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.operators import resonance, selection, signal, spectrum
from strophe.plans import actions, evidence
from strophe.queries import spectra


def test_fft_equals_the_sum_for_each_bin(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(0, 1, 64).tolist()) for i in range(9)] + [(10, [1.0] * 63), (11, None), (12, [1.0] * 63 + [None])], "k int, x array<double>")
    for hann in (False, True):
        want = {(r.k, r.bin): r.mag for r in spectrum.dft(df.where("k < 9"), "k", "x", 64, hann).collect()}
        got = {(r.k, r.bin): r.mag for r in spectrum.fft(df, ["k"], "x", 64, hann, digits=5).collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1.01e-5 for x in want)


def test_whole_frames_in_order(spark):
    df = spark.range(100).select(F.lit("a").alias("k"), F.col("id").alias("i"), (F.col("id") * 2).alias("v")).orderBy(F.rand(1))
    got = {r.frame: list(r.x) for r in spectrum.framed(df, "k", "i", "v", 32, 16).collect()}
    assert got == {f: [2 * i for i in range(16 * f, 16 * f + 32)] for f in range(5)}


@pytest.mark.parametrize("block", [8, 64, 8192])
def test_block_correlation_equals_the_sum_of_products(spark, block):
    rng = np.random.default_rng(2)
    series = {"a": dict(enumerate(rng.integers(0, 50, 300).tolist())), "b": {i: 3 for i in range(0, 200, 7)}, "c": {0: 5}, "d": {i: int(i % 10 == 0) for i in range(90)}}
    df = spark.createDataFrame([(k, i, v) for k, s in series.items() for i, v in s.items()], "k string, i long, v int")
    got = {(r.k, r.lag): (round(r.ac, 6), r.pairs) for r in spectrum.autocorrelation(df, "k", "i", "v", range(3, 31), block).collect()}
    want = {}
    for k, s in series.items():
        for lag in range(3, 31):
            pairs = [(v, s[i + lag]) for i, v in s.items() if i + lag in s]
            if pairs:
                want[k, lag] = (float(sum(a * b for a, b in pairs)), len(pairs))
    assert got == want


def test_medians_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.normal(0, 1e6, 4000)] + [("ties", float(x)) for x in rng.integers(-2, 3, 501)] + [("even", x) for x in (-1.0, -0.0, 0.0, 1e-300)] + [("one", -7.25), ("none", None), ("far", 1e308), ("far", -1e308), ("far", float("inf")), (None, 2.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {r.k: r.m for r in df.where("v IS NOT NULL").groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {r.k: r.m for r in selection.median(df, ["k"], "v", "m").collect()} == want
    assert selection.median(df.where("v IS NULL AND v > 0"), ["k"], "v", "m").collect() == []
    whole = selection.median(df, [], "v", "m").first().m
    assert whole == df.agg(F.median("v")).first()[0]


def test_no_task_holds_a_hot_group(spark):
    """Of 200,000 rows of one key, rounds hand on digits and their counts, which no number of rows makes more."""
    df = spark.range(200_000, numPartitions=8).select(F.lit(1).alias("k"), (F.col("id") % 1000 / 7).alias("v"))
    seen = selection.patterns(df, ["k"], "v").groupBy("k", "d0", "d1", "d2", "d3").count()
    assert seen.count() == 1000 and selection.median(df, ["k"], "v", "m").first().m == df.agg(F.median("v")).first()[0]


def test_silence_in_one_pass_equals_level_by_level(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, float(x)) for k in range(12) for i, x in enumerate(rng.normal(0, 0.02, 200) * np.where(rng.random(200) < 0.3, 0.01, 1.0))]
    df = spark.createDataFrame(rows, "k int, i long, x double")
    got = {r.k: r.noise_db if r.has_silence else None for r in signal.noise_floor(df, "k", 3).collect()}
    want = {}
    for k in range(12):
        found = [db for db in signal.SILENCES if signal.silences(df.where(F.col("k") == k), "k", 10 ** (db / 20), 3).count()]
        want[k] = float(min(found)) if found else None
    assert got == want and len(set(got.values())) > 1


def plain_evidence(left, right):
    """The evidence of a recording at 44,100 samples a second, step by step."""
    mid, side = (left + right) / 2, (left - right) / 2
    frames = [mid[o : o + 8192] for o in range(0, len(mid) - 8191, 4096)]
    db = np.median([20 * np.log10(np.abs(np.fft.rfft(f * np.hanning(8192))) + 1e-9) for f in frames], axis=0)
    hz = np.fft.rfftfreq(8192, 1 / 44100)
    found = []
    for i in range(2, len(db) - 2):
        if 200 <= hz[i] <= 16000 and db[i] > db[i - 1] and db[i] >= db[i + 1]:
            off = np.abs(hz - hz[i])
            excess = db[i] - np.median(db[(off <= max(120, hz[i] * 0.08)) & (off > max(30, hz[i] * 0.012))])
            if excess >= 3:
                found.append((round(excess, 2), round(hz[i], 1)))
    taken = []
    for e, f in sorted(found, key=lambda x: (-x[0], x[1])):
        if len(taken) < 8 and all(abs(f - g) >= 120 for _, g in taken):
            taken.append((e, f))
    m, s = (np.sqrt(np.mean(x * x) + 1e-12) for x in (mid, side))
    level = lambda a, b: np.median(db[(hz >= a) & (hz < b)])
    return taken, float(round(m / (m + s), 3)), round(level(45, 220) - level(250, 2000), 2), round(max(0.0, level(2500, 6000) - level(250, 2000) - 2), 2)


def test_from_files_to_evidence_to_decisions(spark, tmp_path):
    """A recording with a resonance at 3,200 Hz in its middle: its evidence bears a cut there out, and no other."""
    rng = np.random.default_rng(5)
    t = np.arange(int(44100 * 1.6)) / 44100
    both = 0.12 * np.sin(2 * np.pi * 3200 * t) + 0.004 * rng.normal(0, 1, len(t))
    x = np.stack([both + 0.015 * np.sin(2 * np.pi * 800 * t), both + 0.015 * np.sin(2 * np.pi * 1200 * t)], 1)
    pcm = np.round(x * 32767).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(44100)
        w.writeframes(pcm.tobytes())
    (row,) = resonance.of_files(spark, str(tmp_path), rangeBytes=50_000).collect()
    heard = pcm.astype(np.float32).astype(np.float64) / 32768
    taken, ratio, low, harsh = plain_evidence(heard[:, 0], heard[:, 1])
    assert [(r.excess_db, r.frequency_hz) for r in row.resonances][0] == pytest.approx(taken[0], abs=0.02) and {round(r.frequency_hz) for r in row.resonances} == {round(f) for _, f in taken}
    assert abs(row.resonances[0].frequency_hz - 3200) < 120 and row.resonances[0].target == "high_mid" and row.mid_side_ratio == ratio > 0.8 and row.stereo_correlation > 0.9
    assert row.low_end_level_db == pytest.approx(low, abs=0.02) and row.harshness_excess_db == pytest.approx(harsh, abs=0.02) and row.vocal_center_confidence > 0.65

    hit, claims = row.resonances[0], lambda hz, db: {"measured_excess_db": db, "resonance_frequency_hz": hz, "mid_side_ratio": ratio, "vocal_center_confidence": row.vocal_center_confidence}
    cut = lambda hz: {"frequency_hz": hz, "max_reduction_db": 2.0}
    rows = [
        ("p", 1, evidence.RESONANCE, "high_mid", "cut", cut(hit.frequency_hz), claims(hit.frequency_hz, hit.excess_db), "mid"),
        ("p", 2, evidence.RESONANCE, "bass", "cut", cut(70.0), claims(70.0, 4.0), "mid"),
        ("p", 3, evidence.RESONANCE, "high_mid", "cut", cut(hit.frequency_hz), claims(hit.frequency_hz, hit.excess_db + 2), "stereo"),
        ("p", 4, evidence.RESONANCE, "high_mid", "cut", cut(hit.frequency_hz), claims(hit.frequency_hz, hit.excess_db), "side"),
    ]
    local = {n: float(row[n]) for n in ("mid_side_ratio", "vocal_center_confidence", "stereo_correlation", "transient_crest_db")}
    assert outcomes(spark, rows, local, [(r.frequency_hz, r.target, r.excess_db) for r in row.resonances]) == ["accepted", "no such resonance", "another excess claimed", "no side"]


def outcomes(spark, rows, local, candidates):
    fields = "plan string, pos long, function_id string, target string, operation string, params map<string,double>, evidence map<string,double>, side string"
    known = spark.createDataFrame([("p", local, candidates)], "plan string, local map<string,double>, resonances array<struct<frequency_hz:double,target:string,excess_db:double>>")
    df = evidence.proven(spark.createDataFrame(rows, fields).join(known, "plan"))
    got = actions.admit(df, F.lit(False), F.col("unproven")).orderBy("pos").collect()
    return [r.outcome if r.outcome != "rejected" else r.reason for r in got]


def one(function, params, operation, claims, target=None, side=None):
    return [("p", 1, function, target, operation, {k: float(v) for k, v in params.items()}, {k: float(v) for k, v in claims.items()}, side)]


VOICE = {"mid_side_ratio": 0.78, "vocal_center_confidence": 0.82}
CASES = [
    # A resonance needs its measurement and its band.
    (one("audio.dynamic_eq.resonance", {"frequency_hz": 3200, "max_reduction_db": 2}, "cut", {"measured_excess_db": 2.4, "resonance_frequency_hz": 3250, "mid_side_ratio": 0.78}, "high_mid", "mid"), {"mid_side_ratio": 0.78}, [(3250.0, "high_mid", 2.4)], "accepted"),
    (one("audio.dynamic_eq.motion", {"frequency_hz": 9000, "gain_db": 0.5}, "boost", {"measured_deficit_db": 1}, "mid"), {}, [], "outside its band"),
    (one("audio.dynamic_eq.resonance", {"frequency_hz": 3200, "max_reduction_db": 1.5}, "cut", {"measured_excess_db": 2, "resonance_frequency_hz": 3200, "mid_side_ratio": 0.45}, "high_mid", "mid"), {"mid_side_ratio": 0.45}, [(3200.0, "high_mid", 2.0)], "no middle"),
    (one("audio.dynamic_eq.resonance", {"frequency_hz": 3200, "max_reduction_db": 1.5}, "cut", {"measured_excess_db": 2}, "high_mid"), {}, [(3200.0, "high_mid", 2.0)], "no resonance claimed"),
    # Voices.
    (one("audio.vocal.resonance_suppressor", {"frequency_hz": 3400, "max_reduction_db": 1.5}, "cut", {"measured_excess_db": 2.1, "resonance_frequency_hz": 3420, **VOICE}), VOICE, [(3420.0, "high_mid", 2.1)], "accepted"),
    (one("audio.vocal.center_naturalizer", {"body_gain_db": 0.6, "harshness_reduction_db": 1.2, "air_reduction_db": 0.4, "mix": 0.25}, "protect", {"mid_side_ratio": 0.8, "vocal_center_confidence": 0.85, "measured_body_deficit_db": 1, "measured_harshness_excess_db": 1.8, "measured_air_excess_db": 0.8}), {"mid_side_ratio": 0.8, "vocal_center_confidence": 0.85}, [], "accepted"),
    (one("audio.vocal.resonance_suppressor", {"frequency_hz": 3400, "max_reduction_db": 1}, "cut", {"measured_excess_db": 2, "resonance_frequency_hz": 3400, "mid_side_ratio": 0.5, "vocal_center_confidence": 0.4}), {"mid_side_ratio": 0.5, "vocal_center_confidence": 0.4}, [], "no sure voice"),
    # Metrics of their own.
    (one("audio.transient.dynamic_control", {"amount_db": -1}, "cut", {"transient_crest_db": 13}), {"transient_crest_db": 13.0}, [], "accepted"),
    (one("audio.stereo.correlation_guard", {"width": 1.1}, "expand", {"stereo_correlation": 0.82}), {"stereo_correlation": 0.82}, [], "accepted"),
    (one("audio.low_end.dynamic_balance", {"gain_db": 0.5}, "boost", {"low_end_level_db": -4, "low_end_mid_ratio": 0.8, "measured_deficit_db": 1}), {"low_end_level_db": -4.0, "low_end_mid_ratio": 0.8}, [], "accepted"),
    (one("audio.spectral.deharsh", {"max_reduction_db": 1}, "cut", {"harshness_excess_db": 2, "measured_excess_db": 2}), {"harshness_excess_db": 2.0}, [], "accepted"),
    (one("audio.spectral.dullness_recovery", {"max_boost_db": 0.5}, "boost", {"dullness_deficit_db": 2, "measured_deficit_db": 2}), {"dullness_deficit_db": 2.0}, [], "accepted"),
    (one("audio.stereo.correlation_guard", {"width": 1.15}, "expand", {"stereo_correlation": 0.3}), {"stereo_correlation": 0.3}, [], "not in phase"),
    (one("audio.spectral.deharsh", {"max_reduction_db": 1}, "cut", {"harshness_excess_db": 2, "measured_excess_db": 2}), {}, [], "not measured"),
    # Evidence there must be, and signs that agree; neutral ones cost nothing.
    (one("audio.multiband.eq", {"gain_db": -1}, "cut", {}, "air"), {}, [], "no evidence"),
    (one("audio.tone_eq.band", {"gain_db": -1.5}, "boost", {"measured_deficit_db": 1}, "high_mid"), {}, [], "contradicted"),
    (one("audio.multiband.eq", {"gain_db": 0}, "neutral", {"x": 1}, "mid"), {}, [], "neutral"),
    (one("audio.multiband.eq", {"gain_db": 1.5}, "boost", {"measured_deficit_db": 0}, "mid"), {}, [], actions.TONAL),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_claims_against_what_was_measured(spark, case):
    rows, local, candidates, want = CASES[case]
    assert outcomes(spark, rows, local, candidates) == [want]


def test_actions_that_are_switched_off(spark):
    fields = "plan string, pos long, function_id string, target string, operation string, params map<string,double>, enabled boolean"
    rows = [("p", 1, "audio.multiband.eq", "mid", None, {"gain_db": 1.5}, True), ("p", 2, "audio.transient.dynamic_control", None, None, {"amount_db": 1.2}, False), ("q", 1, "audio.multiband.eq", "mid", None, {"gain_db": 1.5}, None), ("q", 2, "audio.transient.dynamic_control", None, None, {"amount_db": 1.2}, True)]
    df = spark.createDataFrame(rows, fields)
    assert {r.plan: (r.band, r.boost, r.exceeded) for r in actions.headroom(df).collect()} == {"p": ("mid", 1.5, False), "q": ("mid", 2.7, True)}
    got = {r.plan: (r.error, r.graph) for r in actions.compiled(df).collect()}
    assert got == {"p": (None, "[multiband_1:1]"), "q": ("audio.governor.chain_headroom: mid=2.70dB", None)}
    assert [(r.plan, r.outcome, r.reason) for r in actions.admit(df).orderBy("plan", "pos").collect()][:2] == [("p", "accepted", None), ("p", "rejected", "switched off")]


def test_neighbours_share_a_stage_and_others_part_it(spark):
    fields = "plan string, pos long, function_id string, target string, operation string, params map<string,double>, enabled boolean"
    eq = lambda p, pos, band, gain, on=True: (p, pos, "audio.multiband.eq", band, None, {"gain_db": gain}, on)
    rows = [eq("p", 1, "bass", -1.0), eq("p", 2, "mid", 0.5), ("p", 3, "audio.multiband.stereo_width", "air", None, {"width": 1.2}, True), eq("q", 1, "bass", -1.0), eq("q", 2, "mid", -1.0, False), eq("q", 3, "mid", -1.0)]
    rows += [("r", 1, "audio.saturation.softclip", None, None, {"drive_db": 1.0}, True), ("r", 2, "audio.saturation.exciter", None, None, {"amount": 1.0}, True), ("s", 1, "audio.nothing", None, None, {}, True)]
    got = {r.plan: (r.error, r.stages, r.graph) for r in actions.compiled(spark.createDataFrame(rows, fields)).collect()}
    assert got == {"p": (None, 1, "[multiband_1:3]"), "q": (None, 2, "[multiband_1:1];[multiband_2:1]"), "r": ("conflict: audio.saturation.exciter,audio.saturation.softclip", None, None), "s": ("unknown function", None, None)}


def test_budgets_add_up_in_order(spark):
    """Sums whose last digits depend on the order: of the actions', however rows come."""
    values = [0.1, 0.7, 0.2, 0.30000000000000004, 0.123456789]
    df = spark.createDataFrame([("p", i, "audio.tone_eq.tilt", None, {"gain_db": v}) for i, v in enumerate(values)], "plan string, pos long, function_id string, target string, params map<string,double>")
    want = round(sum(values), 3)
    for n in (1, 3, 5):
        assert {r.tonal_boost for r in actions.budgets(df.repartition(n, F.rand(n))).collect()} == {want}


def test_long_frames_of_the_events(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = {}
    for r in spectra.long_frame_spectra(spark, sf_dir).collect():
        got.setdefault(r.event_type, {})[r.bin] = r.db
    rows = spectra.stream(spark, sf_dir).where("event_type = 'view'").orderBy("t", "event_id").select("value").toPandas()["value"].to_numpy()
    frames = [rows[o : o + 8192] for o in range(0, len(rows) - 8191, 4096)]
    want = np.median([20 * np.log10(np.abs(np.fft.rfft(f * np.hanning(8192))) + 1e-9) for f in frames], axis=0)
    assert len(got) == 5 and len(got["view"]) == 4097 and max(abs(got["view"][i] - v) for i, v in enumerate(want)) < 1e-9
    found = [r for r in spectra.long_frame_resonances(spark, sf_dir).collect() if r.event_type == "view"]
    hz = np.fft.rfftfreq(8192, 1 / 44100)
    assert len(found) == 8 and sorted(r.rank for r in found) == list(range(8))
    for r in found:
        i = int(np.abs(hz - r.frequency_hz).argmin())
        off = np.abs(hz - hz[i])
        assert r.excess_db == pytest.approx(want[i] - np.median(want[(off <= max(120, hz[i] * 0.08)) & (off > max(30, hz[i] * 0.012))]), abs=0.0051) and math.isclose(r.frequency_hz, hz[i], abs_tol=0.051)
