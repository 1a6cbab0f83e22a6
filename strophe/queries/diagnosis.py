"""Diagnosis, ratings and settings of tracks: one for each customer, with figures made from its key and balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import batch, diagnosis, spectrum

#: The figures of a track, in SQL that both engines read alike.
FIGURES = {
    "sub_bass": "-10e0 - (c_custkey * 7 % 170) / 10e0", "bass": "-7e0 - (c_custkey * 11 % 140) / 10e0", "low_mid": "-12e0 - (c_custkey * 13 % 90) / 10e0",
    "mid": "-11e0 - (c_custkey * 17 % 110) / 10e0", "high_mid": "-9e0 - (c_custkey * 19 % 130) / 10e0", "air": "CASE WHEN c_custkey % 23 > 0 THEN -9e0 - (c_custkey * 23 % 160) / 10e0 END",
    "high_peak": "-(c_custkey * 3 % 50) / 10e0", "air_peak": "-(c_custkey * 5 % 60) / 10e0", "bass_peak": "-(c_custkey * 9 % 40) / 10e0",
    "voice": "CASE WHEN c_custkey % 13 > 0 THEN -14e0 - (c_custkey * 29 % 150) / 10e0 END", "mono": "c_custkey % 17 = 0", "width": "(c_custkey * 31 % 100) / 100e0",
    "lufs": "c_acctbal / 1000e0 - 17e0", "peak": "-(c_custkey * 7 % 90) / 10e0", "lra": "(c_custkey * 3 % 130) / 10e0", "crest": "5e0 + (c_custkey * 37 % 90) / 10e0",
    "clipping": "c_custkey % 19 = 0", "noise_db": "-28e0 - c_custkey * 41 % 40", "balance": "(c_custkey * 43 % 1000) / 10e0", "off": "(c_custkey % 90) / 10e0 - 4.5e0",
    "drive": "(c_custkey * 47 % 140) / 10e0", "mix": "(c_custkey * 53 % 11) / 10e0", "mult": "1e0 + (c_custkey * 59 % 40) / 10e0",
}
FX = "fx AS (SELECT c_custkey, " + ", ".join(f"{e} AS {n}" for n, e in FIGURES.items()) + " FROM customer)"
BANDS = list(diagnosis.BANDS)


def figures(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", *(f"{e} AS {n}" for n, e in FIGURES.items()))


def levels():
    return {b: F.col(b) for b in BANDS}


def flags(found):
    return F.array_join(diagnosis.listed([F.when(c, F.lit(n)) for n, c in found.items()]), ",")


def track_traits(spark, sf_dir):
    return figures(spark, sf_dir).select("c_custkey", *(c.alias(n) for n, c in diagnosis.traits(levels(), F.col("voice")).items()))


def issue_flags(spark, sf_dir):
    f = figures(spark, sf_dir)
    vocals = diagnosis.traits(levels(), F.col("voice"))["has_vocals"]
    found = diagnosis.issues(levels(), F.col("bass_peak"), F.col("voice"), vocals, F.col("mono"), F.col("width"))
    return f.select("c_custkey", flags(found).alias("issues"), batch.repair_level(F.col("lufs"), F.col("peak"), F.col("peak") + 0.5).alias("repair"), batch.recalibrate(F.col("lufs"), F.col("peak"), -14.0, -1.0).alias("recalibrate"))


def processing_profile(spark, sf_dir):
    f = figures(spark, sf_dir)
    p = diagnosis.profile(*(F.col(c) for c in ("clipping", "lra", "crest", "peak")), batch.noise_category(F.col("noise_db")), F.col("lufs"), F.col("balance"))
    return f.select("c_custkey", p.alias("p")).select("c_custkey", F.col("p.label").alias("profile"), F.array_join("p.reasons", "; ").alias("reasons"))


def mix_rating(spark, sf_dir):
    r = diagnosis.rating(*(F.col(c) for c in ("lufs", "peak", "lra", "off")), -14.0, -1.0)
    return figures(spark, sf_dir).select("c_custkey", r.alias("r")).select("c_custkey", "r.score", "r.label", "r.advice")


def band_suggestions(spark, sf_dir):
    none = F.lit(-100.0)
    peaks = dict.fromkeys(BANDS, none) | {"high_mid": F.col("high_peak"), "air": F.col("air_peak")}
    return figures(spark, sf_dir).select("c_custkey", F.array_join(diagnosis.band_suggestions(levels(), peaks, 4.0), "\n").alias("advice"))


def stereo_category(spark, sf_dir):
    s = diagnosis.stereo(F.col("lufs"), F.col("lufs") + F.when(F.col("mono"), 25.0).when(F.col("c_custkey") % 3 == 0, 3.0).otherwise(0.1), F.col("lufs") - F.col("drive") * 4)
    return figures(spark, sf_dir).select("c_custkey", s.alias("s")).select("c_custkey", "s.*")


def spectrum_presets(spark, sf_dir):
    """Peaks of a spectrum: an order's lines, their prices as frequencies and discounts as levels."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    peaks = li.select("l_orderkey", (F.pow(F.col("l_extendedprice") / 10000, 3.0) * 20).alias("hz"), (-400 * F.col("l_discount")).alias("db"), (F.col("l_orderkey") % 30 * 100).alias("centroid"), (F.col("l_orderkey") % 10 / 10).alias("flatness"))
    return diagnosis.spectrum_traits(peaks, "l_orderkey", "centroid", "flatness")


def plot_points(spark, sf_dir):
    """The points of spectra between 20 and 20,000 Hz, and how many are left out."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    hz = F.pow(F.col("l_extendedprice") / 10000, 3.0) * 30
    return li.groupBy("l_returnflag").agg(F.count_if(hz.between(20, 20000)).alias("shown"), F.count_if(~hz.between(20, 20000)).alias("hidden"), F.max(F.when(hz.between(20, 20000), F.col("l_extendedprice"))).alias("last"))


def plotted_points(spark, sf_dir):
    """These points themselves, with their lines."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.pow(F.col("l_extendedprice") / 10000, 3.0) * 30).alias("_hz"))
    return spectrum.within(li, "_hz").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numeric.half_even(F.col("_hz"), 3).alias("hz"))


def saturation_warnings(spark, sf_dir):
    drive = {"high_mid": F.col("drive"), "air": F.col("drive") / 2}
    mix = {"high_mid": F.col("mix"), "air": F.when(F.col("c_custkey") % 2 == 0, F.col("mix"))}
    warned = diagnosis.saturation_warnings({"high_mid": F.col("high_mid") + 5, "air": F.col("air") + 5}, drive, mix)
    return figures(spark, sf_dir).select("c_custkey", F.array_join(warned, ",").alias("warnings"))


def saturation_budget(spark, sf_dir):
    f = figures(spark, sf_dir)
    highs = diagnosis.traits(levels(), F.col("voice"))["strong_highs"]
    s = diagnosis.saturation_budget(F.col("mult"), F.col("mix"), {"bass": (F.col("mult") - 0.5, F.col("mix")), "air": (F.lit(2.0), F.lit(None).cast("double"))}, F.col("mult") - 2, F.col("balance"), highs)
    return f.select("c_custkey", s.alias("s")).select("c_custkey", "s.thd", F.array_join("s.sources", "; ").alias("sources"), "s.risk")


def band_overlap(spark, sf_dir):
    k = F.col("c_custkey")
    maps = lambda value, some: F.map_from_entries(F.array(*(F.struct(F.lit(b).alias("key"), value(i).cast("double").alias("value")) for i, b in enumerate(BANDS) if i in some)))
    t = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", (k % 2 == 0).alias("dynamic_eq"), (k % 3 == 0).alias("deesser"), (k % 5 < 2).alias("stereo_dynamic"), ((k % 7) / 10).alias("stereo_mix"), (k % 3 > 0).alias("limiter"),
        F.when(k % 4 > 0, maps(lambda i: -1.0 * (k + i) % 4, (0, 2, 5))).alias("limiter_db"), (k % 4 > 0).alias("saturation"), (k % 8 > 3).alias("per_band"), (k % 90).cast("double").alias("sat_mix"), (k % 12 - 3).cast("double").alias("sat_drive"),
        F.when(k % 6 > 1, maps(lambda i: (k * (i + 2)) % 9 / 10, (0, 3))).alias("stereo_band_mix"), maps(lambda i: (k * (i + 3)) % 80, (1, 3, 4)).alias("band_mix"), maps(lambda i: (k * (i + 5)) % 9, (1, 4)).alias("band_drive"),
    )
    found = diagnosis.overlap_risk(t, "c_custkey")
    return found.select("c_custkey", "worst_band", "worst_overlap", "risky", "overlap_ok", F.array_join(F.transform("bands", lambda b: F.concat(b["band"], F.lit("="), F.array_join(b["sources"], "+"))), ";").alias("sources"))


def track_settings(spark, sf_dir):
    c = F.col
    more, less = diagnosis.target_compensation(c("lra"), c("peak"))
    switches = [c("c_custkey") % 29 == 0, c("c_custkey") % 31 == 0]
    return figures(spark, sf_dir).select(
        "c_custkey", diagnosis.eq_correction(c("mid"), F.lit(-14.0)).alias("eq"), more.alias("lufs_more"), half(less).alias("peak_less"), diagnosis.headroom(c("lufs") - 8, -9.0, -17.0).alias("headroom"),
        diagnosis.needs_two_passes(c("lra"), c("peak"), c("lufs"), -14.0, c("drive")).alias("two_passes"),
        diagnosis.needs_preprocess(c("mono"), [F.when(c("c_custkey") % 34 == 0, "Off").otherwise("Leve")], c("c_custkey") % 2 == 0, switches, [c("off")]).alias("preprocess"),
        diagnosis.invalid_reason(c("c_custkey") * 7 % 4096 * (c("c_custkey") % 5), F.when(c("c_custkey") % 11 > 0, c("lra")), c("lufs") * 3).alias("invalid"), diagnosis.price(c("lufs"), c("lra")).alias("price"), numeric.half_even(numeric.width_db(c("width") * 2), 4).alias("width_db"),
        diagnosis.resource_profile(c("c_custkey") % 16 + 1, F.when(c("c_custkey") % 9 > 0, (c("c_custkey") % 40).cast("double"))).alias("resources"), numeric.confidence(c("width") * 1.3 - 0.1).alias("confidence"),
    )


def half(x):
    return numeric.half_even(x, 4)


def render_evaluation(spark, sf_dir):
    """Each customer's track before and after, 2.1 to 6 dB louder."""
    c = F.col
    before = {"lufs": c("lufs"), "true_peak": c("peak"), "lra": c("lra"), "crest": c("crest"), "dc": F.lit(0.0), "correlation": c("width") + 0.2, "channels": F.when(c("mono"), 1).otherwise(2)}
    after = {"lufs": c("lufs") + c("mult"), "true_peak": c("peak") + c("mult"), "lra": c("lra") - c("off"), "crest": c("crest") - c("mix") * 5, "dc": c("width") / 50, "correlation": 1 - c("width"), "channels": F.lit(2), "second_peak": F.when(~c("mono"), c("peak") + c("mult") - 0.25)}
    bands = {b: (c(b) * 5, c(b) * 5 + c("drive") - 7) for b in ("bass", "air")}
    e = diagnosis.evaluation(before, after, bands, -14.0, -1.0)
    return figures(spark, sf_dir).select("c_custkey", e.alias("e"), diagnosis.difference(F.when(c("mono"), -70.0).otherwise(c("lra")), c("crest")).alias("delta")).select("c_custkey", "delta", *(F.array_join(f"e.{n}", ",").alias(n) for n in ("successes", "warnings", "errors")))


def clip_counts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_discount") * 100 - 10).alias("peak"))
    return diagnosis.clipping(e, "l_orderkey", "peak")


def rounding(spark, sf_dir):
    """Amounts and their halves, tenths and eighths rounded by the exact value of the double."""
    x = F.col("l_extendedprice")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").agg(
        *(F.sum(F.round(numeric.half_even(v, d) * 10**d).cast("long")).alias(n) for n, v, d in (("cents", x * (1 - F.col("l_discount")), 2), ("halves", x / 8, 1), ("eighths", x / 1000, 2), ("below", -x / 7, 3)))
    )


def calibration(spark, sf_dir):
    c = F.col
    gain = numeric.calibration_step(c("lufs"), c("peak"), -14.0, -1.0, c("mult") - 0.9)
    f = figures(spark, sf_dir).select("c_custkey", "lufs", "mult", gain.alias("gain"))
    return f.select("c_custkey", half(c("gain")).alias("gain"), half(numeric.damped_response(c("mult"), c("lufs"), c("lufs") + c("gain") * 0.6, c("gain"))).alias("response"), half(numeric.from_db(c("gain"))).alias("factor"))


k = lambda b: f"coalesce({b}, -100)"
_vocals = f"coalesce(voice > -22 OR (voice > -25 AND voice > {k('mid')} - 2), false)"
_highs = f"({k('high_mid')} + {k('air')}) / 2 > -18"
_join = lambda sep, parts: f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), '{sep}')"
_if = lambda cond, text: f"CASE WHEN {cond} THEN {text} END"
_p = lambda x, d: f"printf('%.{d}f', {x})"
_noise = "CASE WHEN noise_db <= -60 THEN 'Excellent' WHEN noise_db <= -50 THEN 'Good' WHEN noise_db <= -40 THEN 'Moderate' WHEN noise_db <= -30 THEN 'High' ELSE 'VeryHigh' END"
_guard = "(lufs <= -16 AND peak <= -6 AND lra <= 6.5e0 AND balance < 70)"
_careful = f"(clipping OR lra <= 4.5e0 OR crest <= 8.5e0 OR peak >= -1.5e0 OR {_guard})"
_roomy = "(lra >= 8.5e0 AND crest >= 11 AND NOT clipping AND peak <= -3 AND balance >= 40)"
_reasons = [
    _if("clipping", "'clipping detectado'"), _if("lra <= 4.5e0", f"'LRA bajo (' || {_p('lra', 1)} || ' LU)'"), _if("crest <= 8.5e0", f"'crest bajo (' || {_p('crest', 1)} || ' dB)'"), _if("peak >= -1.5e0", f"'true peak cercano al límite (' || {_p('peak', 1)} || ' dBTP)'"),
    _if("noise IN ('High', 'VeryHigh')", "'ruido ' || lower(noise)"), _if(_guard, f"'balance espectral justo (' || {_p('balance', 0)} || '/100)'"), _if(_guard, f"'headroom moderado con LRA contenido (' || {_p('lra', 1)} || ' LU)'"),
    _if(f"NOT {_careful}", f"CASE WHEN {_roomy} THEN 'LRA amplio' WHEN lra >= 6 THEN 'LRA saludable' ELSE 'LRA medio' END || ' (' || {_p('lra', 1)} || ' LU)'"), _if(f"NOT {_careful} AND {_roomy}", f"'crest con headroom (' || {_p('crest', 1)} || ' dB)'"),
    _if(f"NOT {_careful} AND NOT {_roomy} AND crest >= 9", f"'crest razonable (' || {_p('crest', 1)} || ' dB)'"),
]
_advice = [
    "CASE WHEN abs(lufs + 14) <= 1 THEN 'Nivel integrado cerca del objetivo: OK.' WHEN lufs + 14 < -3 THEN 'Muy bajo respecto al objetivo: considera aumentar ganancia o compresión.' WHEN lufs + 14 < -1 THEN 'Bajo: subir leve ganancia o aplicar make-up after compression.' ELSE 'Por encima del objetivo: reduce ganancia o aplica un normalizador previo.' END",
    "CASE WHEN peak >= -1 THEN 'True peak excede o iguala el límite: usar limitador/trimming para evitar clipping.' WHEN peak >= -2 THEN 'True peak cercano al límite: revisar transientes y aplicar limitador suave.' END",
    "CASE WHEN lra > 10 THEN 'LRA alto: la mezcla tiene dinámicas amplias; considera compresión multibanda o automatizaciones.' WHEN lra < 4 THEN 'LRA bajo: la mezcla está muy comprimida; verifica si falta dinámica.' END",
    "CASE WHEN abs(off) > 3 THEN 'Offset recomendado grande: puede necesitar procesamiento significativo; revisar ganancia/processing chain.' END",
]
_names = {b: f"'{n}'" for b, n in diagnosis.BANDS.items()}


def _suggest(band: str, peak: str | None) -> str:
    low = f"CASE WHEN {peak} > -3 THEN NULL ELSE {_names[band]} || ': posible falta; considera subir ~2-3 dB.' END" if peak else f"{_names[band]} || ': posible falta; considera subir ~2-3 dB.'"
    hot = f"WHEN {band} IS NOT NULL AND {peak} > -1 THEN {_names[band]} || ': ADVERTENCIA - pico cercano a 0dB (' || {_p(peak, 1)} || 'dB), riesgo de saturación!' " if peak else ""
    return f"CASE {hot}WHEN {band} > av + 4 THEN {_names[band]} || ': posible exceso; considera bajar ~2-3 dB.' WHEN {band} < av - 4 THEN {low} END"


_sums = "+".join(f"coalesce({b}, 0)" for b in BANDS)
_ns = "+".join(f"(CASE WHEN {b} IS NULL THEN 0 ELSE 1 END)" for b in BANDS)
_warns = [
    "CASE WHEN drive > 8 THEN 'high_mid:drive>8.0' END", "CASE WHEN mix > 0.7e0 AND drive > 8 * 0.7e0 THEN 'high_mid:drive+mix' END", "CASE WHEN mix > 0.3e0 THEN 'high_mid:headroom-3.5' END", "CASE WHEN high_mid + 5 > -6 AND drive > 6 THEN 'high_mid:rms+drive' END",
    "CASE WHEN drive / 2 > 4 THEN 'air:drive>4.0' END", "CASE WHEN c_custkey % 2 = 0 AND mix > 0.7e0 AND drive / 2 > 4 * 0.7e0 THEN 'air:drive+mix' END", "CASE WHEN c_custkey % 2 = 0 AND mix > 0.3e0 THEN 'air:headroom-5.0' END", "CASE WHEN air + 5 > -6 AND drive / 2 > 6 THEN 'air:rms+drive' END",
]
_thd = [("'Saturación global'", "(mult - 1) * 0.5e0 * mix"), (_names["bass"], "(mult - 0.5e0 - 1) * 0.3e0 * mix"), (_names["air"], "0.3e0"), ("'Glue compression'", "(mult - 3) * 0.2e0"), ("'Desbalance espectral'", "(50 - balance) * 0.02e0"), ("'Agudos fuertes'", f"CASE WHEN {_highs} THEN 0.5e0 ELSE 0e0 END")]
_total = " + ".join(f"greatest(0e0, {x})" for _, x in _thd)
QUERIES = {
    "track_traits": track_traits, "issue_flags": issue_flags, "processing_profile": processing_profile, "mix_rating": mix_rating, "band_suggestions": band_suggestions, "stereo_category": stereo_category, "spectrum_presets": spectrum_presets, "plot_points": plot_points, "plotted_points": plotted_points,
    "saturation_warnings": saturation_warnings, "saturation_budget": saturation_budget, "band_overlap": band_overlap, "track_settings": track_settings, "render_evaluation": render_evaluation, "clip_counts": clip_counts, "rounding": rounding, "calibration": calibration,
}
ORACLES = {
    "track_traits": f"WITH {FX} SELECT c_custkey, {_vocals} AS has_vocals, ({k('sub_bass')} + {k('bass')}) / 2 > -15 AS strong_bass, {_highs} AS strong_highs, greatest({', '.join(map(k, BANDS))}) - least({', '.join(map(k, BANDS))}) > 10 AS dynamic, {k('high_mid')} > -10 OR {k('air')} > -12 AS sibilance_risk FROM fx",
    "issue_flags": f"""WITH {FX}, g AS (SELECT *, {_vocals} AS vocals, high_mid > -12.5e0 OR {k('air')} > -13.5e0 AS metal, {k('voice')} AS v FROM fx)
 SELECT c_custkey, {_join(',', [_if('metal', "'hats_metallic'"), _if('NOT mono AND width < 0.32e0 AND metal', "'highs_narrow'"), _if('vocals AND v < -18.5e0', "'vocal_thin'"), _if('vocals AND high_mid - mid > 2.8e0', "'vocal_metallic'"), _if('vocals AND v - mid > 2.2e0', "'vocal_forward'"), _if('sub_bass < -22 OR sub_bass + 5 < bass', "'sub_weak'"),
  _if('bass > -10.8e0 OR (bass_peak > -1.2e0 AND bass > -13.5e0) OR (bass - low_mid > 6.8e0 AND bass > -12.8e0)', "'kick_edge'")])} AS issues,
 concat_ws(',', CASE WHEN lufs > -20 THEN 'denoise' END, CASE WHEN peak > -0.1e0 THEN 'declip' END, CASE WHEN peak + 0.5e0 > -0.05e0 THEN 'declick' END) AS repair, abs(lufs + 14) > 0.30e0 OR peak - -1.5e0 > 0.20e0 AS recalibrate FROM g""",
    "processing_profile": f"WITH {FX}, n AS (SELECT *, {_noise} AS noise FROM fx) SELECT c_custkey, CASE WHEN {_careful} THEN 'Conservador' WHEN {_roomy} THEN 'Agresivo' ELSE 'Normal' END AS profile, {_join('; ', _reasons)} AS reasons FROM n",
    "mix_rating": f"""WITH {FX}, s AS (SELECT c_custkey, CAST(100 - ((CASE WHEN abs(lufs + 14) <= 1 THEN 0 WHEN lufs + 14 < -3 THEN 20 WHEN lufs + 14 < -1 THEN 10 ELSE 15 END) + (CASE WHEN peak >= -1 THEN 25 WHEN peak >= -2 THEN 10 ELSE 0 END) + (CASE WHEN lra > 10 THEN 10 WHEN lra < 4 THEN 5 ELSE 0 END) + (CASE WHEN abs(off) > 3 THEN 10 ELSE 0 END)) AS INTEGER) AS score,
 array_to_string(list_filter([{', '.join(_advice)}], lambda x: x IS NOT NULL), chr(10)) AS advice FROM fx) SELECT c_custkey, score, CASE WHEN score >= 85 THEN 'Bueno' WHEN score >= 65 THEN 'Aceptable' ELSE 'Necesita trabajo' END AS label, advice FROM s""",
    "band_suggestions": f"WITH {FX}, a AS (SELECT *, ({_sums}) / ({_ns}) AS av FROM fx) SELECT c_custkey, array_to_string(list_filter([{', '.join(_suggest(b, {'high_mid': 'high_peak', 'air': 'air_peak'}.get(b)) for b in BANDS)}], lambda x: x IS NOT NULL), chr(10)) AS advice FROM a",
    "stereo_category": f"""WITH {FX}, s AS (SELECT c_custkey, lufs AS l, lufs + CASE WHEN mono THEN 25 WHEN c_custkey % 3 = 0 THEN 3 ELSE 0.1e0 END AS r, lufs - drive * 4 AS side FROM fx), g AS (SELECT *, abs(l - r) AS apart, (l + r) / 2 - side AS gap FROM s)
 SELECT c_custkey, apart > 20 OR (apart < 0.5e0 AND side < -50) AS is_mono, CASE WHEN apart > 20 OR (apart < 0.5e0 AND side < -50) THEN 0e0 WHEN apart >= 0.5e0 THEN 0.5e0 WHEN gap > 15 THEN 0.2e0 WHEN gap > 8 THEN 0.5e0 WHEN gap > 3 THEN 0.7e0 ELSE 0.9e0 END AS width,
 CASE WHEN apart > 20 OR (apart < 0.5e0 AND side < -50) THEN 'Mono' WHEN apart >= 0.5e0 THEN 'Normal' WHEN gap > 15 THEN 'Narrow' WHEN gap > 8 THEN 'Normal' WHEN gap > 3 THEN 'Wide' ELSE 'VeryWide' END AS category FROM g""",
    "spectrum_presets": """WITH p AS (SELECT l_orderkey, pow(l_extendedprice / 10000, 3) * 20 AS hz, -400 * l_discount AS db FROM lineitem), c AS (SELECT l_orderkey, count(*) FILTER (WHERE hz BETWEEN 20 AND 60) AS n_20_60, count(*) FILTER (WHERE hz BETWEEN 60 AND 250) AS n_60_250, count(*) FILTER (WHERE hz BETWEEN 250 AND 500) AS n_250_500, count(*) FILTER (WHERE hz BETWEEN 500 AND 2000) AS n_500_2000,
  count(*) FILTER (WHERE hz BETWEEN 2000 AND 6000) AS n_2000_6000, count(*) FILTER (WHERE hz BETWEEN 6000 AND 16000) AS n_6000_16000, count(*) FILTER (WHERE hz BETWEEN 60 AND 250 AND db > -15) > 0 AS has_bass_punch, count(*) FILTER (WHERE hz > 10000) > 0 AS has_air, count(*) FILTER (WHERE hz BETWEEN 5000 AND 8000 AND db > -10) > 0 AS needs_deess FROM p GROUP BY l_orderkey),
 t AS (SELECT *, n_20_60 > 0 AS has_sub_bass, n_250_500 > 1 AS has_muddy_mids, n_500_2000 > 0 AND n_2000_6000 > 0 AS has_vocal_clarity, l_orderkey % 30 * 100 > 2000 AS is_bright, l_orderkey % 30 * 100 < 1000 AS is_warm FROM c)
 SELECT *, CASE WHEN has_bass_punch AND has_air AND needs_deess THEN 'Fuego (Trap, Reguetón, Hip-Hop)' WHEN has_bass_punch AND has_air THEN 'Empuje (EDM, Dubstep, Bass Music)' WHEN has_vocal_clarity AND is_bright THEN 'Claridad (Clásica, R&B, Cantautor)' WHEN has_vocal_clarity AND is_warm THEN 'Cinta (Jazz, Alternativa, Indie)' WHEN has_vocal_clarity THEN 'Universal (Rock, Pop, Electrónica)'
  WHEN has_air AND l_orderkey % 10 > 3 THEN 'Espacial (Ambient, Experimental)' WHEN is_warm AND NOT has_bass_punch THEN 'Natural (Acústico, Jazz, Folk)' WHEN has_muddy_mids THEN 'Cinemático (Orquestal, Soundtrack)' ELSE 'Universal (Rock, Pop, Electrónica)' END AS preset FROM t""",
    "plotted_points": "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, pow(l_extendedprice / 10000, 3) * 30 AS f FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(printf('%.3f', f) AS DOUBLE) AS hz FROM p WHERE f >= 20 AND f <= 20000",
    "plot_points": "WITH p AS (SELECT l_returnflag, l_extendedprice AS x, pow(l_extendedprice / 10000, 3) * 30 AS hz FROM lineitem) SELECT l_returnflag, count(*) FILTER (WHERE hz >= 20 AND hz <= 20000) AS shown, count(*) FILTER (WHERE hz < 20 OR hz > 20000) AS hidden, max(x) FILTER (WHERE hz >= 20 AND hz <= 20000) AS last FROM p GROUP BY l_returnflag",
    "saturation_warnings": f"WITH {FX} SELECT c_custkey, {_join(',', _warns)} AS warnings FROM fx",
    "saturation_budget": f"""WITH {FX}, t AS (SELECT *, {_total} AS total FROM fx) SELECT c_custkey, CAST(printf('%.6f', total) AS DOUBLE) AS thd, {_join('; ', [_if(f'{x} > 0', f"{n} || ': +' || {_p(x, 1)} || '%'") for n, x in _thd])} AS sources, CASE WHEN total < 2 THEN 'low' WHEN total < 4 THEN 'medium' ELSE 'high' END AS risk FROM t""",
    "band_overlap": """WITH b(no, band) AS (VALUES (0, 'sub_bass'), (1, 'bass'), (2, 'low_mid'), (3, 'mid'), (4, 'high_mid'), (5, 'air')), p AS (SELECT c_custkey AS k, no, band, 'a' AS o, 'dynamic_eq' AS source, 0.8e0 AS x FROM customer, b WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, no, band, 'b', 'deesser', 0.8e0 FROM customer, b WHERE c_custkey % 3 = 0 AND no >= 4
  UNION ALL SELECT c_custkey, no, band, 'c', 'stereo_dynamic', greatest(0.2e0, CASE WHEN c_custkey % 6 > 1 AND no IN (0, 3) THEN c_custkey * (no + 2) % 9 / 10e0 WHEN c_custkey % 7 = 0 THEN 0.4e0 ELSE (c_custkey % 7) / 10e0 END) FROM customer, b WHERE c_custkey % 5 < 2
  UNION ALL SELECT c_custkey, no, band, 'd', 'multiband_limiter', CASE WHEN c_custkey % 4 > 0 AND -((c_custkey + no) % 4) > -2 THEN 0.9e0 ELSE 0.6e0 END FROM customer, b WHERE c_custkey % 3 > 0 AND (c_custkey % 4 = 0 OR no IN (0, 2, 5))
  UNION ALL SELECT c_custkey, no, band, 'e', 'saturation_band', c_custkey * (no + 3) % 80 / 100e0 * (1 + CASE WHEN no IN (1, 4) THEN c_custkey * (no + 5) % 9 ELSE 0 END / 6e0) FROM customer, b WHERE c_custkey % 4 > 0 AND c_custkey % 8 > 3 AND no IN (1, 3, 4) AND c_custkey * (no + 3) % 80 > 0
  UNION ALL SELECT c_custkey, no, band, 'f', 'saturation_global', c_custkey % 90 / 100e0 * (1 + abs(c_custkey % 12 - 3) / 6e0) FROM customer, b WHERE c_custkey % 4 > 0 AND c_custkey % 8 <= 3 AND c_custkey % 90 > 0),
 s AS (SELECT c_custkey, b.no, b.band, coalesce(sum(x ORDER BY o), 0) AS x, coalesce(string_agg(source, '+' ORDER BY o), '') AS sources FROM customer CROSS JOIN b LEFT JOIN p ON p.k = c_custkey AND p.no = b.no GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY x DESC, no) AS rn FROM s)
 SELECT c_custkey, max(band) FILTER (WHERE rn = 1) AS worst_band, max(CAST(printf('%.3f', x) AS DOUBLE)) FILTER (WHERE rn = 1) AS worst_overlap, count(*) FILTER (WHERE x >= 2) AS risky, count(*) FILTER (WHERE x >= 2) = 0 AS overlap_ok, string_agg(band || '=' || sources, ';' ORDER BY no) AS sources FROM r GROUP BY c_custkey""",
    "track_settings": f"""WITH {FX} SELECT c_custkey, CASE WHEN abs(mid + 14) < 0.5e0 THEN 0e0 ELSE CAST(printf('%.1f', greatest(-3e0, least(2e0, -(mid + 14) * 0.5e0))) AS DOUBLE) END AS eq, 0e0 AS lufs_more, CAST(printf('%.4f', least(0.9e0, (CASE WHEN lra <= 4.5e0 THEN 0.1e0 ELSE 0 END) + (CASE WHEN lra <= 3.5e0 THEN 0.05e0 ELSE 0 END) + (CASE WHEN peak >= -2 THEN 0.1e0 ELSE 0 END))) AS DOUBLE) AS peak_less,
 CASE WHEN lufs - 8 >= -25 THEN -17e0 WHEN -9 - (lufs - 8) > 20 THEN -8e0 WHEN -9 - (lufs - 8) > 12 THEN -12e0 WHEN -9 - (lufs - 8) > 8 THEN -15e0 ELSE -17e0 END AS headroom, lra <= 6 OR peak > -6 OR drive <= 3 OR -14 - lufs > 15 AS two_passes,
 (mono AND c_custkey % 34 > 0) OR (c_custkey % 2 = 0 AND (c_custkey % 29 = 0 OR c_custkey % 31 = 0 OR abs(off) > 1e-9)) AS preprocess,
 CASE WHEN c_custkey * 7 % 4096 * (c_custkey % 5) = 0 THEN 'empty' WHEN c_custkey * 7 % 4096 * (c_custkey % 5) < 1024 THEN 'too small' WHEN c_custkey % 11 = 0 OR lra <= 0 THEN 'no duration' WHEN lufs * 3 < -70 THEN 'silent' ELSE '' END AS invalid, CASE WHEN lufs > -12 THEN 1.5e0 WHEN lra > 8 THEN 2e0 ELSE 9e0 END AS price,
 CASE WHEN width * 2 > 1 THEN CAST(printf('%.4f', 20 * log10(width * 2)) AS DOUBLE) ELSE 0e0 END AS width_db, CASE WHEN c_custkey % 16 + 1 <= 4 OR c_custkey % 9 = 0 OR c_custkey % 40 < 8 THEN 'Baja' WHEN c_custkey % 16 + 1 <= 8 OR c_custkey % 40 < 16 THEN 'Media' WHEN c_custkey % 16 + 1 <= 12 OR c_custkey % 40 < 32 THEN 'Alta' ELSE 'Muy alta' END AS resources,
 CAST(printf('%.2f', greatest(0.2e0, least(0.99e0, width * 1.3e0 - 0.1e0))) AS DOUBLE) AS confidence FROM fx""",
    "render_evaluation": f"""WITH {FX}, r AS (SELECT *, abs(lufs + mult + 14) AS apart, peak + mult + 1 AS above, lra - off - lra AS dl, crest - mix * 5 - crest AS dcr, bass * 5 + drive - 7 AS bass_z, air * 5 + drive - 7 AS air_z FROM fx)
 SELECT c_custkey, CASE WHEN mono OR lra = -70 OR crest = -70 THEN 'N/A' WHEN crest > lra THEN '+' || printf('%.2f', crest - lra) ELSE printf('%.2f', crest - lra) END AS delta, {_join(',', [_if('apart <= 0.5e0', "'lufs'"), _if('above <= 0', "'true_peak'"), _if('NOT mono AND peak + mult - 0.25e0 + 1 <= 0', "'second_peak'"), _if('abs(dl) <= 2', "'lra'")])} AS successes,
 {_join(',', [_if('apart > 0.5e0 AND apart <= 1', "'lufs'"), _if('above > 0 AND above <= 0.3e0', "'true_peak'"), _if('NOT mono AND peak + mult - 0.25e0 + 1 > 0', "'second_peak'"), "CASE WHEN dl < -2 THEN 'lra_down' WHEN dl > 2 THEN 'lra_up' END", _if('bass * 5 >= -60 AND bass_z >= -60 AND bass_z - bass * 5 > 6', "'bass_up'"), _if('bass * 5 >= -60 AND bass_z >= -60 AND bass_z - bass * 5 < -6', "'bass_down'"),
  _if('air * 5 >= -60 AND air_z >= -60 AND air_z - air * 5 > 6', "'air_up'"), _if('air * 5 >= -60 AND air_z >= -60 AND air_z - air * 5 < -6', "'air_down'"), _if('dcr < -3', "'crest'"), _if('abs(width / 50) > 0.01e0', "'dc'"), _if('NOT mono AND 1 - width < 0.3e0 AND width + 0.2e0 > 0.5e0', "'stereo'")])} AS warnings,
 {_join(',', [_if('apart > 1', "'lufs'"), _if('above > 0.3e0', "'true_peak'")])} AS errors FROM r""",
    "clip_counts": "SELECT l_orderkey, max(l_discount * 100 - 10) AS max_peak, count(*) FILTER (WHERE l_discount * 100 - 10 >= -0.1e0) AS clips, max(l_discount * 100 - 10) >= -0.1e0 AS clipped FROM lineitem GROUP BY l_orderkey",
    "rounding": "WITH v AS (SELECT l_returnflag, printf('%.2f', l_extendedprice * (1 - l_discount)) AS a, printf('%.1f', l_extendedprice / 8) AS b, printf('%.2f', l_extendedprice / 1000) AS c, printf('%.3f', -l_extendedprice / 7) AS d FROM lineitem) SELECT l_returnflag, CAST(sum(CAST(replace(a, '.', '') AS BIGINT)) AS BIGINT) AS cents, CAST(sum(CAST(replace(b, '.', '') AS BIGINT)) AS BIGINT) AS halves, CAST(sum(CAST(replace(c, '.', '') AS BIGINT)) AS BIGINT) AS eighths, CAST(sum(CAST(replace(d, '.', '') AS BIGINT)) AS BIGINT) AS below FROM v GROUP BY l_returnflag",
    "calibration": f"""WITH {FX}, d AS (SELECT c_custkey, lufs, mult, -14 - lufs AS dist, -1 - peak AS room, abs(-14 - lufs) > 0.2e0 AS nl, peak > -1 + 0.15e0 AS np, peak > -0.5e0 AS hot, mult - 0.9e0 AS resp FROM fx),
 w AS (SELECT *, CASE WHEN abs(dist) > 8 THEN 2.5e0 WHEN abs(dist) > 5 THEN 2e0 WHEN abs(dist) > 3 OR hot THEN 1.5e0 ELSE 0.85e0 END AS most, CASE WHEN np AND NOT nl THEN room WHEN dist > 0 OR np THEN least(dist, room) ELSE dist END / CASE WHEN abs(resp) > 0.05e0 THEN resp ELSE 1 END AS raw FROM d),
 g AS (SELECT *, CASE WHEN NOT nl AND NOT np THEN NULL WHEN abs(greatest(-most, least(most, raw))) >= 0.08e0 THEN greatest(-most, least(most, raw)) WHEN np THEN -0.08e0 END AS gain FROM w)
 SELECT c_custkey, CAST(printf('%.4f', gain) AS DOUBLE) AS gain, CASE WHEN gain IS NOT NULL THEN CAST(printf('%.4f', 0.5e0 * mult + 0.5e0 * greatest(0.35e0, least(1.65e0, (lufs + gain * 0.6e0 - lufs) / gain))) AS DOUBLE) END AS response, CAST(printf('%.4f', pow(10, gain / 20)) AS DOUBLE) AS factor FROM g""",
}
