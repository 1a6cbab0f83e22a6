"""Literal fixtures with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from strophe.functions import numeric, text
from strophe.operators import batch, decisions, diagnosis, events, frames, joins, quality, sections, spectrum
from strophe.plans import actions, catalog


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_gap_merge(spark):
    data = [(1, 0.0, "peak_risk", "high", 0.95), (1, 1.0, "peak_risk", "medium", 0.78), (1, 3.0, "peak_risk", "medium", 0.78), (1, 10.0, "peak_risk", "high", 0.95), (1, 1.0, "harshness_risk", "medium", 0.70), (1, 2.6, "harshness_risk", "high", 0.85)]
    df = spark.createDataFrame(data, "k int, t double, type string, severity string, confidence double")
    want = [("harshness_risk", 1.0, 2.6, 2, "high", round((0.70 + 0.85) / 2, 2)), ("peak_risk", 0.0, 1.0, 2, "high", round((0.95 + 0.78) / 2, 2)), ("peak_risk", 3.0, 3.0, 1, "medium", 0.78), ("peak_risk", 10.0, 10.0, 1, "high", 0.95)]
    for shuffled in (df, df.orderBy(F.rand(3)).repartition(3)):
        assert rows(events.merge_by_gap(shuffled, ["k", "type"], "t", 1.6), "type", "start_t", "end_t", "samples", "severity", "confidence") == want


def test_intervals_without_length_never_overlap(spark):
    a = spark.createDataFrame([(1, 0.0, 5.0, "x"), (1, 5.0, 12.0, "y")], "k int, a0 double, a1 double, s string")
    b = spark.createDataFrame([(1, 0.0, 1.0), (1, 3.0, 3.0), (1, 5.0, 5.0), (1, 4.0, 6.0), (2, 0.0, 9.0)], "k int, b0 double, b1 double")
    assert rows(joins.overlaps(a, b, "k", 2.0), "s", "b0") == [("x", 0.0), ("x", 4.0), ("y", 4.0)]


def test_sections_of_a_step(spark):
    data = [(1, i, -12.0 if 15 <= i < 30 else -24.0, 0.0) for i in range(40)]
    cut = sections.boundaries(spark.createDataFrame(data, "k int, frame int, rms_db double, bright double"), "k", 2.8, 3.2, 10)
    assert cut.select("cuts").first()[0] == [0, 15, 30, 39]
    got = rows(sections.sections(cut, "k"), "section", "first_frame", "last_frame", "n", "label", "energy")
    assert got == [(0, 0, 15, 16, "verse", -23.25), (1, 15, 30, 16, "chorus", -12.75), (2, 30, 39, 10, "verse", -24.0)]


def test_single_frame_and_compaction(spark):
    one = sections.boundaries(spark.createDataFrame([(1, 0, -20.0, 0.0)], "k int, frame int, rms_db double, bright double"), "k", 2.8, 3.2, 3)
    assert rows(sections.sections(one, "k"), "label", "n") == [("single", 1)]
    parts = spark.createDataFrame([(1, 0, 0, 9, 10, "verse", 0.6), (1, 1, 9, 11, 3, "drop", 0.72), (1, 2, 11, 30, 20, "outro", 0.78)], "k int, section int, first_frame long, last_frame long, n int, label string, confidence double")
    assert rows(sections.compact(parts, "k", 6), "section", "first_frame", "last_frame", "n", "label", "confidence") == [(0, 0, 11, 13, "drop", 0.66), (1, 11, 30, 20, "outro", 0.78)]


def test_frame_rules(spark):
    df = spark.createDataFrame([(1, 0, 0.0, -10.0, -0.5, 3.0, -30.0, -26.0, -20.0, -15.0, -30.0)], "k int, frame int, t double, rms_db double, peak_db double, crest_db double, s double, b double, m double, h double, a double")
    got = rows(events.rule_events(df, "k", {"sub": "s", "bass": "b", "mid": "m", "high_mid": "h", "air": "a"}), "type", "severity", "confidence")
    assert got == [("dynamic_flat", "low", 0.6), ("harshness_risk", "high", 0.85), ("low_end_weak", "medium", 0.72), ("peak_risk", "high", 0.95)]


def test_integrity_of_half_a_signal(spark):
    df = spark.createDataFrame([(1, x, x / 2) for x in (0.5, -0.5, 0.25, -0.25)], "k int, b double, p double")
    assert rows(quality.integrity(df, ["k"], "b", "p")) == [(1, 4, -6.0206, -14.0824, 1.0, 0.25, 0)]


ACTION = "plan int, pos long, function_id string, target string, operation string, params map<string,double>, evidence map<string,double>"


def eq(spark, *moves):
    """Gains of the multiband equaliser: (gain, band, evidence)."""
    return spark.createDataFrame([(1, i, "audio.multiband.eq", band, "boost" if g > 0 else "cut" if g < 0 else "neutral", {"gain_db": g}, e) for i, (g, band, e) in enumerate(moves, 1)], ACTION)


def test_budgets_never_net(spark):
    df = eq(spark, (-1.5, "high_mid", {"measured_excess_db": 2.1}), (0.75, "air", {"measured_deficit_db": 1.2}))
    assert rows(actions.budgets(df), "tonal_cut", "tonal_boost", "tonal_boost_left", "tonal_cut_left", "status") == [(1.5, 0.75, 2.25, 4.5, "passed")]


def test_ordered_admission(spark):
    more = {"measured_deficit_db": 2.0}
    df = eq(spark, (1.5, "mid", more), (1.5, "high_mid", more), (0.5, "air", more), (0.0, "air", more))
    assert rows(actions.admit(df.repartition(3)), "pos", "outcome", "reason") == [(1, "accepted", None), (2, "accepted", None), (3, "rejected", actions.TONAL), (4, "neutral", None)]


def test_single_limits_overlaps_and_evidence(spark):
    more = {"measured_deficit_db": 2.0}
    assert rows(actions.admit(eq(spark, (2.5, "air", more))), "outcome", "reason") == [("rejected", actions.TONAL)]
    assert rows(actions.admit(eq(spark, (1.25, "air", more), (1.0, "air", more))), "outcome", "reason") == [("accepted", None), ("rejected", actions.OVERLAP)]
    assert rows(actions.admit(eq(spark, (-1.0, "high_mid", {"band_rms_db": -15.0}))), "reason") == [(actions.TONAL,)]
    gain = spark.createDataFrame([(1, 1, "audio.autogain.output_gain", None, "boost", {"gain_db": 1.0}, more), (2, 1, "audio.autogain.output_gain", None, "boost", {"gain_db": 1.0}, {"compensation_required_db": 1.0})], ACTION)
    assert rows(actions.admit(gain), "plan", "outcome", "reason") == [(1, "rejected", actions.GAIN), (2, "accepted", None)]


def test_conflicts_and_dense_material(spark):
    params = {"drive_db": 2.0, "mix": 0.5, "amount": 1.0}
    df = spark.createDataFrame([(1, 1, "audio.saturation.softclip", None, None, params, None), (1, 2, "audio.saturation.exciter", None, None, params, None)], ACTION)
    assert rows(actions.admit(df.drop("evidence")), "outcome", "reason") == [("accepted", None), ("rejected", "conflict")]
    assert rows(actions.admit(df.drop("evidence"), F.lit(True)), "outcome", "reason") == [("accepted", None), ("rejected", "dense material")]


def test_plan_problems(spark):
    df = spark.createDataFrame([(1, 1, "audio.saturation.softclip", None, None, {}, None), (1, 2, "audio.saturation.exciter", "air", None, {}, None), (1, 3, "tone_eq", None, None, {}, None), (1, 4, "nothing", None, None, {}, None), (1, 5, "tone_eq", "mid", "cut", {"gain_db": 1.0}, None), (1, 6, "loudness", None, "boost", {}, None)], ACTION)
    assert rows(actions.problems(df), "pos", "operation", "problem") == [(1, "neutral", ""), (2, "boost", "takes no such band"), (3, "neutral", "needs a band"), (4, "protect", "unknown function"), (5, "cut", "contradicted"), (6, "boost", "unsupported")]
    assert rows(actions.plan_problems(df, ["spectrum", "lufs", "true_peak"])) == [(1, "audio.saturation.exciter,audio.saturation.softclip", "band_rms,crest_factor,loudness_stats")]


def test_parameters_have_types_choices_and_ranges(spark):
    given = [("audio.repair.denoise", "level", "Auto"), ("audio.repair.pink_noise_compensation", "level", "Auto"), ("audio.loudness.normalize", "dual_mono", "1"), ("audio.tone_eq.low_pass", "poles", "1.5"), ("audio.tone_eq.low_pass", "poles", "3"), ("audio.glue.bus_compressor", "ratio", "true"), ("audio.glue.bus_compressor", "ratio", "0.5"), ("audio.limiter.true_peak", "oversampling", "3"), ("audio.limiter.true_peak", "speed", "3")]
    got = actions.parameter_problems(spark.createDataFrame(given, "function_id string, parameter string, raw string")).collect()
    assert {(r.function_id, r.parameter, r.raw): r.problem for r in got} == dict(zip(given, ["", "no choice", "not bool", "not int", "too high", "not float", "too low", "no choice", "unknown parameter"], strict=True))


def test_guardrails_come_last(spark):
    df = spark.createDataFrame([(1, 1, "audio.limiter.true_peak", None, None, {"ceiling_db": -0.5}, None), (1, 2, "audio.multiband.eq", "air", None, {"gain_db": 0.5}, None)], ACTION)
    got = actions.guardrails(df, -15.5, -2.2).orderBy("step").collect()
    assert [(r.function_id, r.injected) for r in got] == [("audio.multiband.eq", False), ("audio.loudness.normalize", True), ("audio.limiter.true_peak", False)]
    assert got[1].params["target_lufs"] == -15.5 and got[2].params["ceiling_db"] == -2.2


def test_catalog_is_sound():
    names = [f[0] for f in catalog.FUNCTIONS]
    assert len(names) == len(set(names)) == 36 and set(catalog.ALIASES.values()) <= set(names)
    assert all(lo <= float(d) <= hi for _, _, kind, d, lo, hi, _ in catalog.parameter_rows() if kind == "float")
    assert all(d in choices for *_, d, _, _, choices in catalog.parameter_rows() if choices)


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_rounding_is_python_s(spark, digits):
    import random

    r = random.Random(digits)
    values = [0.865, 2.675, 0.125, -0.125, 1.005, 2.5, 3.5, -2.5, 0.0, 1e-9, *(r.uniform(-200, 200) for _ in range(300)), *(round(r.uniform(-50, 50), digits + 1) for _ in range(700))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", numeric.half_even(F.col("v"), digits).alias("w")).collect():
        assert row.w == round(row.v, digits), row


def test_profiles_and_ratings(spark):
    df = spark.createDataFrame([(1, False, 9.0, 12.0, -4.0, "Good", -14.0, 60.0), (2, False, 4.5, 12.0, -4.0, "High", -14.0, 60.0), (3, False, 6.2, 9.5, -6.0, "Good", -16.0, 69.9), (4, False, 7.0, 9.0, -2.0, "Good", -14.0, 60.0)], "k int, clip boolean, lra double, crest double, peak double, noise string, lufs double, balance double")
    p = diagnosis.profile(*(F.col(c) for c in ("clip", "lra", "crest", "peak", "noise", "lufs", "balance")))
    got = {r.k: (r.p.label, r.p.reasons) for r in df.select("k", p.alias("p")).collect()}
    assert got[1] == ("Agresivo", ["LRA amplio (9.0 LU)", "crest con headroom (12.0 dB)"])
    assert got[2] == ("Conservador", ["LRA bajo (4.5 LU)", "ruido high"])
    assert got[3] == ("Conservador", ["balance espectral justo (70/100)", "headroom moderado con LRA contenido (6.2 LU)"])
    assert got[4] == ("Normal", ["LRA saludable (7.0 LU)", "crest razonable (9.0 dB)"])
    r = df.select(diagnosis.rating(F.lit(-18.0), F.lit(-0.5), F.lit(3.0), F.lit(0.0), -14.0, -1.0).alias("r")).first().r
    assert (r.score, r.label, len(r.advice.split("\n"))) == (50, "Necesita trabajo", 3)


def test_canary_buckets(spark):
    df = spark.createDataFrame([("/a/b.wav",)], "p string")
    assert rows(df.select(numeric.bucket_percent(F.col("p")), numeric.bucket_percent(F.col("p"), "sha256"))) == [(35, 86)]


def test_keyword_score(spark):
    df = spark.createDataFrame([(1, "Prompt basics", "how_to", "dark"), (2, "Mixing", "other", "techno style"), (3, "Mixing", "other", "silence")], "d int, title string, intent string, text string")
    score = text.keyword_score(text.tokens(F.lit("dark techno")), F.col("title"), F.col("intent"), F.lower(F.concat_ws(" ", "title", "intent", "text")))
    assert rows(df.select("d", score)) == [(1, 7), (2, 2), (3, 0)]


def test_names(spark):
    cases = [("Mi canción", "O-M-A", "O-M-A - Mi canción"), ("O-M-A - Mi canción", "O-M-A", "O-M-A - Mi canción - Master"), ("Mi canción_processed", "O-M-A", "O-M-A - Mi canción"), ("Tema: versión/uno", "O/M/A", "O-M-A - Tema- versión-uno"), ("Tema", "", "O-M-A - Tema"), ("_mix", None, "O-M-A - Sin título")]
    df = spark.createDataFrame([c[:2] for c in cases], "s string, who string")
    assert {(r.s, r.who): r.out for r in df.select("*", text.output_stem(F.col("s"), F.col("who")).alias("out")).collect()} == {c[:2]: c[2] for c in cases}


def test_levels_of_silence_and_padding(spark):
    df = spark.createDataFrame([(1, float(i), 0.0) for i in range(3)], "k int, t double, v double")
    got = frames.tumbling(df, "k", "t", "v", 2.0).orderBy("frame").collect()
    assert [(r.frame, r.n) for r in got] == [(0, 2), (1, 1)] and got[0].rms_db == pytest.approx(-90.0, abs=0.1)


def test_spectrum_of_a_tone(spark):
    import math

    df = spark.createDataFrame([(1, [math.sin(2 * math.pi * 5 * i / 64) for i in range(64)])], "k int, x array<double>")
    s = spectrum.dft(df, "k", "x", 64)
    assert s.orderBy(F.desc("mag")).first().bin == 5
    assert rows(spectrum.peaks(s, "k", -20.0, 2, 10), "bin") == [(5,)]


def test_merge_takes_the_worst(spark):
    cols = "b int, band_db double, voice double, clipped boolean, clips int, noise_db double, mono boolean, width double, peak double, lufs double, lra double, crest double, dc double, bpm double"
    df = spark.createDataFrame([(1, -10.0, -5.0, False, 1, -65.0, False, 1.0, -3.0, -14.0, 6.0, 9.0, 0.1, 100.0), (1, None, -7.0, True, 2, None, True, 3.0, -1.0, -90.0, 2.0, 1.0, -0.3, 120.0)], cols)
    r = batch.merge(df, "b").first()
    assert (r.band_avg, r.any_clipped, r.clips, r.noise_worst, r.lufs_max, r.lra_min, r.dc_worst, r.bpm_median) == (-55.0, True, 3, "Unknown", -14.0, 6.0, -0.3, 110.0)


def test_missing_figures_warn_and_do_not_block(spark):
    df = spark.createDataFrame([(-15.0, -15.0, None, -1.0, 3.0, 2.0, 0.01, True)], "lufs double, target double, peak double, ceiling double, peak_rate double, high_units double, drift double, ready boolean")
    r = decisions.guard(df).first()
    assert (r.blockers, r.warnings, r.ok) == ("", "true_peak", True)


def test_tolerance_join_takes_the_first_match(spark):
    a = spark.createDataFrame([("mid", 3000.0), ("mid", 100.0)], "target string, f double")
    b = spark.createDataFrame([("mid", 3250.0, 2), ("mid", 2800.0, 1), ("air", 3000.0, 0)], "target string, g double, r int")
    assert rows(joins.nearest_within(a, b, ["target"], "f", "g", "r", F.greatest(F.lit(100.0), F.col("f") * 0.1), 2000.0), "f", "g") == [(3000.0, 2800.0)]


def test_tolerance_join_meets_one_of_equal_rows(spark):
    """Right rows that agree in key and value are one before the join: pairs do not grow with their product."""
    a = spark.createDataFrame([(i, "mid", 100.0 + i % 3) for i in range(300)], "o long, target string, f double")
    b = spark.createDataFrame([("mid", 100.0 + r % 4, r) for r in range(400, 0, -1)], "target string, g double, r int")
    got = joins.nearest_within(a, b, ["target"], "f", "g", "r", F.lit(0.5), 1.0)
    assert sorted((r.o, r.f, r.g, r.r) for r in got.collect()) == [(i, 100.0 + i % 3, 100.0 + i % 3, i % 3 or 4) for i in range(300)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [target" in plan[plan.index("Join") :]
