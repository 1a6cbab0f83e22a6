"""What measured figures of a track say: traits, issues, profiles, ratings, warnings and settings, as expressions.

``bands`` maps the names of ``BANDS`` to columns of levels in dB. A missing level counts as -100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, fixed, half_even, let

#: Bands from low to high, with the names that messages use.
BANDS = {
    "sub_bass": "Subbass (20-60 Hz)",
    "bass": "Bass (60-250 Hz)",
    "low_mid": "Low-Mid (250-500 Hz)",
    "mid": "Mid (500-2k Hz)",
    "high_mid": "High-Mid (2k-6k Hz)",
    "air": "Air (6k-16k Hz)",
}
#: Bands in which peaks are heard first, their largest drive and the headroom kept for them, in dB.
SENSITIVE = {"high_mid": (8.0, -3.5), "air": (4.0, -5.0)}
#: Presets by the traits of a spectrum.
PRESETS = {
    "fire": "Fuego (Trap, Reguetón, Hip-Hop)",
    "push": "Empuje (EDM, Dubstep, Bass Music)",
    "clarity": "Claridad (Clásica, R&B, Cantautor)",
    "tape": "Cinta (Jazz, Alternativa, Indie)",
    "universal": "Universal (Rock, Pop, Electrónica)",
    "space": "Espacial (Ambient, Experimental)",
    "natural": "Natural (Acústico, Jazz, Folk)",
    "cinematic": "Cinemático (Orquestal, Soundtrack)",
}


def known(level: Column) -> Column:
    return F.coalesce(level, F.lit(-100.0))


def listed(items: list[Column]) -> Column:
    """The items that are there, in order."""
    return F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")


def traits(bands: dict[str, Column], voice: Column) -> dict[str, Column]:
    """Booleans for voices, strong lows and highs, range between bands, and sibilance."""
    b = {n: known(c) for n, c in bands.items()}
    levels = [b[n] for n in BANDS]
    return {
        "has_vocals": F.coalesce((voice > -22) | ((voice > -25) & (voice > b["mid"] - 2)), F.lit(False)),
        "strong_bass": (b["sub_bass"] + b["bass"]) / 2 > -15,
        "strong_highs": (b["high_mid"] + b["air"]) / 2 > -18,
        "dynamic": F.greatest(*levels) - F.least(*levels) > 10,
        "sibilance_risk": (b["high_mid"] > -10) | (b["air"] > -12),
    }


def issues(bands: dict[str, Column], bass_peak: Column, voice: Column, has_vocals: Column, mono: Column, width: Column) -> dict[str, Column]:
    """The seven flags of a diagnosis before mastering."""
    b, v = {n: known(c) for n, c in bands.items()}, known(voice)
    metallic = (b["high_mid"] > -12.5) | (b["air"] > -13.5)
    return {
        "hats_metallic": metallic,
        "highs_narrow": ~mono & (width < 0.32) & metallic,
        "vocal_thin": has_vocals & (v < -18.5),
        "vocal_metallic": has_vocals & (b["high_mid"] - b["mid"] > 2.8),
        "vocal_forward": has_vocals & (v - b["mid"] > 2.2),
        "sub_weak": (b["sub_bass"] < -22) | (b["sub_bass"] + 5 < b["bass"]),
        "kick_edge": (b["bass"] > -10.8) | ((known(bass_peak) > -1.2) & (b["bass"] > -13.5)) | ((b["bass"] - b["low_mid"] > 6.8) & (b["bass"] > -12.8)),
    }


def profile(clipping: Column, lra: Column, crest: Column, peak: Column, noise: Column, lufs: Column, balance: Column, lra_limit: float = 4.5, crest_limit: float = 8.5) -> Column:
    """How hard a track may be worked on, and why: a struct of label and reasons."""
    dense = (clipping, lra <= lra_limit, crest <= crest_limit, peak >= -1.5)
    guarded = (lufs <= -16) & (peak <= -6) & (lra <= 6.5) & (balance < 70)
    careful = dense[0] | dense[1] | dense[2] | dense[3] | guarded
    roomy = (lra >= 8.5) & (crest >= 11) & ~clipping & (peak <= -3) & (balance >= 40)
    found = [
        F.when(clipping, F.lit("clipping detectado")),
        F.when(dense[1], F.concat(F.lit("LRA bajo ("), fixed(lra, 1), F.lit(" LU)"))),
        F.when(dense[2], F.concat(F.lit("crest bajo ("), fixed(crest, 1), F.lit(" dB)"))),
        F.when(dense[3], F.concat(F.lit("true peak cercano al límite ("), fixed(peak, 1), F.lit(" dBTP)"))),
        F.when(noise.isin("High", "VeryHigh"), F.concat(F.lit("ruido "), F.lower(noise))),
        F.when(guarded, F.concat(F.lit("balance espectral justo ("), fixed(balance, 0), F.lit("/100)"))),
        F.when(guarded, F.concat(F.lit("headroom moderado con LRA contenido ("), fixed(lra, 1), F.lit(" LU)"))),
        F.when(~careful, F.concat(F.when(roomy, "LRA amplio (").when(lra >= 6, "LRA saludable (").otherwise("LRA medio ("), fixed(lra, 1), F.lit(" LU)"))),
        F.when(~careful & roomy, F.concat(F.lit("crest con headroom ("), fixed(crest, 1), F.lit(" dB)"))),
        F.when(~careful & ~roomy & (crest >= 9), F.concat(F.lit("crest razonable ("), fixed(crest, 1), F.lit(" dB)"))),
    ]
    return F.struct(F.when(careful, "Conservador").when(roomy, "Agresivo").otherwise("Normal").alias("label"), listed(found).alias("reasons"))


def rating(lufs: Column, peak: Column, lra: Column, offset: Column, target: float, ceiling: float) -> Column:
    """A mix's score of 100 at most, its label and the advice that goes with what it lost."""
    d = lufs - target
    parts = [
        (F.when(F.abs(d) <= 1, 0).when(d < -3, 20).when(d < -1, 10).otherwise(15),
         F.when(F.abs(d) <= 1, "Nivel integrado cerca del objetivo: OK.").when(d < -3, "Muy bajo respecto al objetivo: considera aumentar ganancia o compresión.")
         .when(d < -1, "Bajo: subir leve ganancia o aplicar make-up after compression.").otherwise("Por encima del objetivo: reduce ganancia o aplica un normalizador previo.")),
        (F.when(peak >= ceiling, 25).when(peak >= ceiling - 1, 10).otherwise(0),
         F.when(peak >= ceiling, "True peak excede o iguala el límite: usar limitador/trimming para evitar clipping.").when(peak >= ceiling - 1, "True peak cercano al límite: revisar transientes y aplicar limitador suave.")),
        (F.when(lra > 10, 10).when(lra < 4, 5).otherwise(0),
         F.when(lra > 10, "LRA alto: la mezcla tiene dinámicas amplias; considera compresión multibanda o automatizaciones.").when(lra < 4, "LRA bajo: la mezcla está muy comprimida; verifica si falta dinámica.")),
        (F.when(F.abs(offset) > 3, 10).otherwise(0), F.when(F.abs(offset) > 3, "Offset recomendado grande: puede necesitar procesamiento significativo; revisar ganancia/processing chain.")),
    ]
    score = F.lit(100) - sum((p for p, _ in parts[1:]), parts[0][0])
    label = F.when(score >= 85, "Bueno").when(score >= 65, "Aceptable").otherwise("Necesita trabajo")
    return F.struct(score.alias("score"), label.alias("label"), F.array_join(listed([a for _, a in parts]), "\n").alias("advice"))


def band_suggestions(rms: dict[str, Column], peaks: dict[str, Column], reach: float) -> Column:
    """What to do about bands that stand out from the mean of those measured: one line for each, in order."""
    there = F.filter(F.array(*rms.values()), lambda x: x.isNotNull())
    mean = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)

    def lines(avg: Column) -> Column:
        out = []
        for n, level in rms.items():
            peak, name = known(peaks[n]), BANDS[n]
            low = F.when(F.lit(n in SENSITIVE) & (peak > -3), F.lit(None)).otherwise(f"{name}: posible falta; considera subir ~2-3 dB.")
            told = F.when(level > avg + reach, f"{name}: posible exceso; considera bajar ~2-3 dB.").when(level < avg - reach, low)
            if n in SENSITIVE:
                told = F.when((peak > -1) & level.isNotNull(), F.concat(F.lit(f"{name}: ADVERTENCIA - pico cercano a 0dB ("), fixed(peak, 1), F.lit("dB), riesgo de saturación!"))).otherwise(told)
            out.append(told)
        return listed(out)

    return let(mean, lines)


def stereo(left: Column, right: Column, side: Column) -> Column:
    """Whether two channels are one, their width and its category."""
    apart, gap = F.abs(left - right), (left + right) / 2 - side
    empty, close = apart > 20, apart < 0.5
    single = empty | (close & (side < -50))
    width = F.when(single, 0.0).when(~close, 0.5).when(gap > 15, 0.2).when(gap > 8, 0.5).when(gap > 3, 0.7).otherwise(0.9)
    category = F.when(single, "Mono").when(~close, "Normal").when(gap > 15, "Narrow").when(gap > 8, "Normal").when(gap > 3, "Wide").otherwise("VeryWide")
    return F.struct(single.alias("is_mono"), width.alias("width"), category.alias("category"))


def spectrum_traits(peaks: DataFrame, key: str, centroid: str, flatness: str) -> DataFrame:
    """Traits of spectra from peaks(key, hz, db, centroid, flatness): counts by closed bands that share their limits, booleans, a preset."""
    hz, db = F.col("hz"), F.col("db")
    inside = lambda a, b: F.count_if(hz.between(a, b)).alias(f"n_{a}_{b}")
    per = peaks.groupBy(key).agg(
        *(inside(a, b) for a, b in ((20, 60), (60, 250), (250, 500), (500, 2000), (2000, 6000), (6000, 16000))),
        F.coalesce(F.bool_or(hz.between(60, 250) & (db > -15)), F.lit(False)).alias("has_bass_punch"),
        F.coalesce(F.bool_or(hz > 10000), F.lit(False)).alias("has_air"),
        F.coalesce(F.bool_or(hz.between(5000, 8000) & (db > -10)), F.lit(False)).alias("needs_deess"),
        F.max(centroid).alias("_centroid"),
        F.max(flatness).alias("_flatness"),
    )
    per = per.withColumns({
        "has_sub_bass": F.col("n_20_60") > 0, "has_muddy_mids": F.col("n_250_500") > 1, "has_vocal_clarity": (F.col("n_500_2000") > 0) & (F.col("n_2000_6000") > 0),
        "is_bright": F.col("_centroid") > 2000, "is_warm": F.col("_centroid") < 1000,
    })
    c = F.col
    preset = (
        F.when(c("has_bass_punch") & c("has_air"), F.when(c("needs_deess"), PRESETS["fire"]).otherwise(PRESETS["push"]))
        .when(c("has_vocal_clarity"), F.when(c("is_bright"), PRESETS["clarity"]).when(c("is_warm"), PRESETS["tape"]).otherwise(PRESETS["universal"]))
        .when(c("has_air") & (c("_flatness") > 0.3), PRESETS["space"])
        .when(c("is_warm") & ~c("has_bass_punch"), PRESETS["natural"])
        .when(c("has_muddy_mids"), PRESETS["cinematic"])
        .otherwise(PRESETS["universal"])
    )
    return per.withColumn("preset", preset).drop("_centroid", "_flatness")


def saturation_warnings(rms: dict[str, Column], drive: dict[str, Column], mix: dict[str, Column]) -> Column:
    """What is wrong with the drive and mix of the bands in which it is heard first: codes of four rules a band, in order."""
    out = []
    for n, (most, headroom) in SENSITIVE.items():
        d, m = F.coalesce(drive[n], F.lit(0.0)), F.coalesce(mix[n], F.lit(0.0))
        out += [
            F.when(d > most, F.concat(F.lit(f"{n}:drive>"), fixed(F.lit(most), 1))),
            F.when((m > 0.7) & (d > most * 0.7), F.lit(f"{n}:drive+mix")),
            F.when(m > 0.3, F.concat(F.lit(f"{n}:headroom"), fixed(F.lit(headroom), 1))),
            F.when((rms[n] > -6) & (d > 6), F.lit(f"{n}:rms+drive")),
        ]
    return listed(out)


def saturation_budget(drive: Column, mix: Column, bands: dict[str, tuple[Column, Column]], glue: Column, balance: Column, strong_highs: Column) -> Column:
    """Estimated distortion in per cent from multipliers of drive, mix and glue, what it comes from, and the risk."""
    one = lambda c: F.coalesce(c, F.lit(1.0))
    parts = [("Saturación global", (one(drive) - 1) * 0.5 * one(mix))]
    parts += [(BANDS[n], (one(d) - 1) * 0.3 * one(m)) for n, (d, m) in bands.items()]
    parts += [("Glue compression", (one(glue) - 1) * 0.2), ("Desbalance espectral", (50 - balance) * 0.02), ("Agudos fuertes", F.when(strong_highs, 0.5).otherwise(0.0))]
    total = sum((F.greatest(x, F.lit(0.0)) for _, x in parts[1:]), F.greatest(parts[0][1], F.lit(0.0)))
    sources = listed([F.when(x > 0, F.concat(F.lit(f"{n}: +"), fixed(x, 1), F.lit("%"))) for n, x in parts])
    return F.struct(half_even(total, 6).alias("thd"), sources.alias("sources"), F.when(total < 2, "low").when(total < 4, "medium").otherwise("high").alias("risk"))


def eq_correction(level: Column, ideal: Column, most_cut: float = -3.0, most_boost: float = 2.0, ratio: float = 0.5) -> Column:
    """Half of what lies between a level and its ideal, within limits; nothing for less than 0.5."""
    gap = level - ideal
    return F.when(F.abs(gap) < 0.5, 0.0).otherwise(half_even(clamp(-gap * ratio, most_cut, most_boost), 1))


def target_compensation(lra: Column, peak: Column, lufs_more: float = 0.0, peak_more: float = 0.0) -> tuple[Column, Column]:
    """What to add to the loudness target and to take from the ceiling for dense and hot sources."""
    more = F.lit(peak_more) + F.when(lra <= 4.5, 0.10).otherwise(0.0) + F.when(lra <= 3.5, 0.05).otherwise(0.0) + F.when(peak >= -2, 0.10).otherwise(0.0)
    return F.lit(max(-0.60, min(0.60, lufs_more))), clamp(more, 0.0, 0.90)


def headroom(lufs: Column, target: float, usual: float) -> Column:
    """The gain taken off before processing: less for sources far below the target."""
    gap = target - lufs
    return F.when(lufs < -25, F.when(gap > 20, -8.0).when(gap > 12, -12.0).when(gap > 8, -15.0).otherwise(usual)).otherwise(usual)


def needs_two_passes(lra: Column, peak: Column, lufs: Column, target: float, most_gain: Column) -> Column:
    return F.coalesce(lra <= 6, F.lit(False)) | F.coalesce(peak > -6, F.lit(False)) | F.coalesce(most_gain <= 3, F.lit(False)) | F.coalesce(target - lufs > 15, F.lit(False))


def needs_preprocess(repair: Column, levels: list[Column], mix: Column, switches: list[Column], amounts: list[Column]) -> Column:
    """A repair that isn't off while repairs are on, or a switch or an amount of the mix while that is on."""
    some = lambda cs: F.greatest(*(F.coalesce(c, F.lit(False)) for c in cs)) if len(cs) > 1 else F.coalesce(cs[0], F.lit(False))
    return (repair & some([x != "Off" for x in levels])) | (mix & some([*switches, *(F.abs(a) > 1e-9 for a in amounts)]))


def invalid_reason(size: Column, seconds: Column, lufs: Column) -> Column:
    """Why a file can't be worked on; empty if it can."""
    return (
        F.when(size == 0, "empty").when(size < 1024, "too small").when(seconds.isNull() | (seconds <= 0), "no duration")
        .when(lufs.isNull() | (lufs < -70), "silent").otherwise("")
    )


def difference(before: Column, after: Column) -> Column:
    """A signed change with two digits; N/A where either is the figure that stands for silence."""
    d = half_even(after - before, 2)
    text = F.concat(F.when(after - before > 0, "+").otherwise(""), F.format_string("%.2f", d))
    return F.when((before == -70) | (after == -70), "N/A").otherwise(text)


def evaluation(before: dict[str, Column], after: dict[str, Column], bands: dict[str, tuple[Column, Column]], target: float, ceiling: float) -> Column:
    """A render against its source and its targets: arrays of successes, warnings and errors, as codes with their bands.

    before and after: lufs, true_peak, lra, crest, dc, correlation, channels; after may have second_peak, the true peak as
    another meter has it, which warns at most.
    """
    off, over = F.abs(after["lufs"] - target), after["true_peak"] - ceiling
    lra, crest = after["lra"] - before["lra"], after["crest"] - before["crest"]
    loud = {n: (a, z, (a >= -60) & (z >= -60)) for n, (a, z) in bands.items()}
    second = after.get("second_peak", F.lit(None).cast("double")) - ceiling
    good = [F.when(off <= 0.5, "lufs"), F.when(over <= 0, "true_peak"), F.when(second <= 0, "second_peak"), F.when(F.abs(lra) <= 2, "lra")]
    warn = [F.when((off > 0.5) & (off <= 1), "lufs"), F.when((over > 0) & (over <= 0.3), "true_peak"), F.when(second > 0, "second_peak"), F.when(lra < -2, "lra_down").when(lra > 2, "lra_up")]
    for n, (a, z, heard) in loud.items():
        warn += [F.when(heard & (z - a > 6), f"{n}_up"), F.when(heard & (z - a < -6), f"{n}_down")]
    warn += [
        F.when(crest < -3, "crest"), F.when(F.abs(after["dc"]) > 0.01, "dc"),
        F.when((before["channels"] == 2) & (after["channels"] == 2) & (after["correlation"] < 0.3) & (before["correlation"] > 0.5), "stereo"),
    ]
    bad = [F.when(off > 1, "lufs"), F.when(over > 0.3, "true_peak")]
    return F.struct(listed(good).alias("successes"), listed(warn).alias("warnings"), listed(bad).alias("errors"))


def price(lufs: Column, lra: Column) -> Column:
    return F.when(F.coalesce(lufs, F.lit(-14.0)) > -12, 1.50).when(F.coalesce(lra, F.lit(5.0)) > 8, 2.00).otherwise(9.00)


def resource_profile(cpus: Column, memory_gb: Column) -> Column:
    gb = F.coalesce(memory_gb, F.lit(0.0))
    return F.when((cpus <= 4) | (gb < 8), "Baja").when((cpus <= 8) | (gb < 16), "Media").when((cpus <= 12) | (gb < 32), "Alta").otherwise("Muy alta")


def clipping(frames: DataFrame, key: str, peak: str, threshold: float = -0.1) -> DataFrame:
    """For each track the highest peak of its frames, how many reach the threshold, and whether any does."""
    return frames.groupBy(key).agg(F.max(peak).alias("max_peak"), F.count_if(F.col(peak) >= threshold).alias("clips"), F.coalesce(F.max(peak) >= threshold, F.lit(False)).alias("clipped"))


def overlap_risk(tracks: DataFrame, key: str) -> DataFrame:
    """For each track and band how many processes meet in it, weighted, and which; and the worst band of the track.

    tracks(key, dynamic_eq, deesser, stereo_dynamic, stereo_mix, limiter, limiter_db map, saturation, per_band, sat_mix,
    sat_drive, band_mix map, band_drive map); mixes of saturation are per cent. A column stereo_band_mix, a map by band,
    goes before stereo_mix where it has the band.
    """
    c = F.col
    names = F.array(*(F.struct(F.lit(i).alias("no"), F.lit(b).alias("band")) for i, b in enumerate(BANDS)))
    rows = tracks.select("*", F.explode(names).alias("_b")).select("*", c("_b.no").alias("no"), c("_b.band").alias("band")).drop("_b")
    limit = c("limiter_db")[c("band")]
    some_limits = F.coalesce(F.size("limiter_db") > 0, F.lit(False))
    own = F.coalesce(c("band_mix")[c("band")], F.lit(0.0)) / 100 * (1 + F.abs(F.coalesce(c("band_drive")[c("band")], F.lit(0.0))) / 6)
    whole = c("sat_mix") / 100 * (1 + F.abs(c("sat_drive")) / 6)
    mix = F.coalesce(F.nullif("stereo_mix", F.lit(0.0)), F.lit(0.4))
    mix = F.coalesce(c("stereo_band_mix")[c("band")], mix) if "stereo_band_mix" in tracks.columns else mix
    parts = [
        ("dynamic_eq", F.when(c("dynamic_eq"), 0.8)),
        ("deesser", F.when(c("deesser") & c("band").isin(*SENSITIVE), 0.8)),
        ("stereo_dynamic", F.when(c("stereo_dynamic"), F.greatest(F.lit(0.2), mix))),
        ("multiband_limiter", F.when(c("limiter"), F.when(some_limits, F.when(limit > -2, 0.9).when(limit.isNotNull(), 0.6)).otherwise(0.6))),
        ("saturation_band", F.when(c("saturation") & c("per_band") & (own > 0), own)),
        ("saturation_global", F.when(c("saturation") & ~c("per_band") & (whole > 0), whole)),
    ]
    total = sum((F.coalesce(x, F.lit(0.0)) for _, x in parts[1:]), F.coalesce(parts[0][1], F.lit(0.0)))
    rows = rows.select(key, "no", "band", half_even(total, 3).alias("score"), listed([F.when(x.isNotNull(), n) for n, x in parts]).alias("sources"), total.alias("_total"))
    worst = F.max_by(F.struct("band", "score"), F.struct(c("_total"), -c("no")))
    per = rows.groupBy(key).agg(worst.alias("w"), F.sort_array(F.collect_list(F.struct("no", "band", "score", "sources"))).alias("bands"), F.count_if(c("_total") >= 2).alias("risky"))  # six rows a track
    return per.select(key, c("w.band").alias("worst_band"), c("w.score").alias("worst_overlap"), "risky", (c("risky") == 0).alias("overlap_ok"), "bands")
