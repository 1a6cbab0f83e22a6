"""Plans over the orders: an order is a plan, its lines are the actions in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import diagnosis
from ..operators.chunks import spread
from ..plans import actions as act
from ..plans import catalog, evidence
from .diagnosis import FX, figures

ANALYSIS = ["spectrum", "band_rms", "true_peak", "lufs", "sample_rate"]
#: The parameters of an action, from the value v and the share m of its line, in SQL that both engines read alike.
PARAMS = {
    "gain_db": "v", "makeup_db": "v", "amount_db": "v", "max_reduction_db": "abs(v)", "max_boost_db": "abs(v) / 2", "drive_db": "v * 4", "mix": "m", "width": "1 + v / 4",
    "amount": "abs(v) * 3", "body_gain_db": "abs(v) / 2", "harshness_reduction_db": "abs(v)", "air_reduction_db": "0.1e0", "target_lufs": "v - 14", "ceiling_db": "v - 1", "intensity": "m",
}
IDS = [f[0] for f in catalog.FUNCTIONS]


def lines(spark, sf_dir, gathered=False):
    """Every fifth function by its short name, some with an unknown one or a wrong band.

    gathered: a plan's lines come together while they are narrow; no later step by plan moves them again.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if gathered:
        li = spread(li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), "l_orderkey")
    listed, short = F.array(*(F.lit(f) for f in IDS)), F.array(*(F.lit(a) for a in catalog.ALIASES))
    no, part = F.col("l_suppkey") % 36, F.col("l_partkey")
    name = F.when(part % 41 == 0, F.lit("audio.nothing.known")).when(part % 5 == 0, F.get(short, (no % len(catalog.ALIASES)).cast("int"))).otherwise(F.get(listed, no.cast("int")))
    banded = F.array(*(F.lit(f[2]) for f in catalog.FUNCTIONS))
    target = F.when(F.get(banded, no.cast("int")) | (part % 7 == 0), F.get(F.array(*(F.lit(b) for b in catalog.BANDS)), (part % 6).cast("int")))
    value = (F.round(F.col("l_discount") * 100).cast("int") - F.round(F.col("l_tax") * 100).cast("int")) * 3 / 10
    asked = F.when(part % 11 == 0, "neutral").when(part % 13 == 0, "boost").when(part % 17 == 0, "narrow").when(part % 19 == 0, "attenuate")
    return li.select(
        F.col("l_orderkey").alias("plan"), (F.col("l_linenumber").cast("long") * 10**12 + part * 10**5 + F.col("l_suppkey")).alias("pos"), numeric.apart(name).alias("function_id"), target.alias("target"), asked.alias("operation"),
        value.alias("v"), (F.col("l_quantity").cast("int") % 11 / 10).alias("m"),
    )


def numbers(table):
    """Numbers by name, from SQL."""
    return F.map_from_arrays(F.array(*(F.lit(n) for n in table)), F.array(*(F.expr(e).cast("double") for e in table.values())))


def actions(spark, sf_dir, gathered=False):
    return lines(spark, sf_dir, gathered).withColumn("params", numbers(PARAMS)).drop("v", "m")


def resolved(spark, sf_dir, gathered=False):
    return act.resolve(actions(spark, sf_dir, gathered)).select("plan", "pos", "function_id", "target", "operation", "params")


def catalog_lookup(spark, sf_dir):
    return act.resolve(actions(spark, sf_dir)).groupBy("function_id", "plugin").agg(F.count("*").alias("n"))


def catalog_certification(spark, sf_dir):
    """Each plugin's functions and parameters, whether all their defaults are sound, and how many of the actions are its own."""
    p = catalog.parameters(spark)
    used = act.resolve(actions(spark, sf_dir)).groupBy(F.col("plugin").alias("_p")).agg(F.count("*").alias("used"))
    number = F.col("standard").try_cast("double")
    sound = F.when(F.col("type").isin("int", "float"), (number >= F.coalesce("least", number)) & (number <= F.coalesce("most", number))).otherwise(True) & ((F.size("choices") == 0) | F.array_contains("choices", F.col("standard")))
    per = p.groupBy("function_id").agg(F.count("*").alias("params"), F.count_if(F.col("type") == "float").alias("floats"), F.bool_and(sound).alias("sound"))
    told = catalog.functions(spark).join(per, "function_id").groupBy("plugin").agg(F.count("*").alias("functions"), F.sum("params").alias("params"), F.sum("floats").alias("floats"), F.bool_and("sound").alias("sound"))
    return told.join(used, F.col("plugin") == F.col("_p"), "left").drop("_p").withColumn("used", F.coalesce("used", F.lit(0)))


def parameter_validation(spark, sf_dir):
    """Each customer's value for one parameter of the catalog: a number, a word, a choice or nothing."""
    c, k = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    spec = catalog.parameter_rows()
    at = (k % (len(spec) + 3)).cast("int")
    raw = F.when(k % 7 == 0, "Leve").when(k % 7 == 1, "2").when(k % 7 == 2, "true").when(k % 7 == 3, "0.25").when(k % 7 == 4, F.concat((k % 400).cast("string"), F.lit(".5"))).when(k % 7 == 5, F.concat(F.lit("-"), (k % 90).cast("string")))
    given = c.select("c_custkey", F.coalesce(F.get(F.array(*(F.lit(r[0]) for r in spec)), at), F.lit("audio.repair.denoise")).alias("function_id"), F.coalesce(F.get(F.array(*(F.lit(r[1]) for r in spec)), at), F.lit("speed")).alias("parameter"), raw.alias("raw"))
    return act.parameter_problems(given).select("c_custkey", "function_id", "parameter", "problem")


def plan_validation(spark, sf_dir):
    return act.problems(actions(spark, sf_dir)).select("plan", "pos", "operation", "problem")


def plan_conflicts(spark, sf_dir):
    return act.plan_problems(actions(spark, sf_dir), ANALYSIS)


def budget_totals(spark, sf_dir):
    return act.budgets(resolved(spark, sf_dir, True))


def band_headroom(spark, sf_dir):
    return act.headroom(resolved(spark, sf_dir, True))


def admission_fold(spark, sf_dir):
    return act.admit(actions(spark, sf_dir, True), F.col("plan") % 4 == 0)


def guardrail_injection(spark, sf_dir):
    out = act.guardrails(resolved(spark, sf_dir), -14.0, -1.0)
    value = lambda n: F.when(F.col("function_id").isin(list(act.TAIL)), numeric.half_even(F.col("params")[n], 4)).alias(n)
    return out.select("plan", "step", "function_id", "injected", value("target_lufs"), value("ceiling_db"), value("true_peak_db"))


def effective_order(spark, sf_dir):
    return act.effective_order(resolved(spark, sf_dir)).select("plan", "pos", "function_id", "step")


def graph_compile(spark, sf_dir):
    return act.graph(actions(spark, sf_dir, True).where("function_id <> 'audio.nothing.known'"))


def compiled_graphs(spark, sf_dir):
    """Plans whose lines have a band where their function takes one; every seventh line is switched off."""
    known = act.resolve(actions(spark, sf_dir, True)).withColumns({"target": F.when(F.col("banded"), F.coalesce("target", F.lit("mid"))), "operation": F.lit(None).cast("string"), "enabled": F.col("pos") % 7 > 0})
    return act.compiled(known.drop("no", "plugin", "banded", "needs", "conflicts"))


#: What a line claims and what was measured of its plan, from the plan's number k, the line's part p and its value v, in SQL that both engines read alike.
HZ = "(p % 7 * 600 + 250)"
LOCAL = {
    "mid_side_ratio": "(0.3e0 + k % 15 / 20)", "vocal_center_confidence": "(0.4e0 + k % 12 / 20)", "transient_crest_db": "(10 + k % 9 / 2)", "stereo_correlation": "(k % 41 / 20 - 1)", "low_end_level_db": "(k % 13 / 2 - 3)",
    "low_end_mid_ratio": "(k % 23 / 20)", "harshness_excess_db": "(k % 5 / 2 - 0.5e0)", "dullness_deficit_db": "(k % 7 / 2 - 0.5e0)",
}
CLAIMS = {n: f"{e} + CASE WHEN p % 8 = 0 THEN 1 ELSE 0 END" for n, e in LOCAL.items()} | {
    "measured_excess_db": "1 + (k + p % 7) % 4 / 2 + CASE WHEN p % 10 = 0 THEN 1 ELSE 0 END", "measured_deficit_db": "p % 6 / 2", "compensation_required_db": "p % 5", "resonance_frequency_hz": f"{HZ} + p % 3 * 80",
    "measured_body_deficit_db": "p % 4", "measured_harshness_excess_db": "p % 4", "measured_air_excess_db": "p % 4",
}


def claims(spark, sf_dir):
    """Each line with its evidence (none for every 29th part) and what was measured: three resonances of a plan, 600 Hz apart."""
    found = lines(spark, sf_dir, True).withColumns({"k": F.col("plan"), "p": F.floor(F.col("pos") / 100000) % 10**7})
    bands = F.array(*(F.lit(b) for b in catalog.BANDS))
    one = lambda i: F.struct(F.expr(f"((k + {i}) % 7 * 600 + 250 + k % 3 * 30)").cast("double").alias("frequency_hz"), F.get(bands, F.expr(f"(k + {i}) % 6").cast("int")).alias("target"), F.expr(f"1 + k % 4 / 2 + {i} / 4").cast("double").alias("excess_db"))
    return found.withColumns({
        "params": numbers(PARAMS | {"frequency_hz": HZ}), "evidence": F.when(F.col("p") % 29 > 0, numbers(CLAIMS)), "local": numbers(LOCAL), "resonances": F.array(*(one(i) for i in range(3))),
        "side": numeric.apart(F.get(F.array(F.lit("stereo"), F.lit("mid"), F.lit("side")), (F.col("p") % 3).cast("int"))), "enabled": F.col("p") % 31 > 0,
    }).drop("v", "m", "k", "p")


def admission_by_evidence(spark, sf_dir):
    return act.admit(evidence.proven(act.resolve(claims(spark, sf_dir)).drop("no", "plugin", "banded", "needs", "conflicts")), F.col("plan") % 4 == 0, F.col("unproven"))


def plan_fingerprint(spark, sf_dir):
    return act.fingerprint(actions(spark, sf_dir, True))


def classic_strategy(spark, sf_dir):
    return act.classic(figures(spark, sf_dir).selectExpr("c_custkey", "CASE WHEN c_custkey % 9 > 0 THEN lufs - 6 END AS lufs", "voice - 8 AS voice", "high_mid", "air - 2 AS air"), "c_custkey")


def execution_audit(spark, sf_dir):
    k = F.col("o_orderkey")
    renders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("plan"), F.when(k % 13 > 0, (k % 40) / 50 - 14.4).alias("lufs"), ((k % 30) / 25 - 1.9).alias("peak"), F.lit(-14.0).alias("target"), F.lit(-1.0).alias("ceiling"))
    return act.audit(renders, act.problems(resolved(spark, sf_dir)).select("plan", "operation"))


def legacy_migration(spark, sf_dir):
    """Old settings of each supplier, one for each kind among its lines."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    names = ["noise_reduction_level", "declip_level", "declick_level", "deesser_intensity", "band_adjust_db", "tone_tilt_db", "band_widths", "saturation_drive_db", "glue_ratio", "never_known"]
    name = F.get(F.array(*(F.lit(n) for n in names)), (F.col("l_orderkey") % 10).cast("int"))
    banded = name.isin("band_adjust_db", "band_widths")
    labels = F.array(*(F.lit(x) for x in [*catalog.BANDS, *diagnosis.BANDS.values(), "Elsewhere"]))
    rows = li.groupBy("l_suppkey", name.alias("name"), F.when(banded, F.get(labels, (F.col("l_partkey") % 13).cast("int"))).alias("band")).agg(F.max(F.col("l_linenumber") - 2).cast("double").alias("value"))
    return act.migrated(rows.withColumnRenamed("l_suppkey", "track"))


def strategy_adjustments(spark, sf_dir):
    found = act.adjustments(resolved(spark, sf_dir))
    flat = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), ",").alias(m)
    return found.select("plan", flat("gains"), flat("widths"), "deesser")


def adjusted_settings(spark, sf_dir):
    c = F.col
    base = {"deesser_intensity": c("width"), "saturation_drive": c("drive"), "saturation_mix": c("mix"), "glue_threshold": -c("crest"), "glue_ratio": c("mult")}
    change = {"deesser_intensity_mult": c("mult"), "saturation_drive_mult": F.when(c("mono"), 0.5), "saturation_mix_mult": c("width"), "glue_threshold_offset": c("off"), "glue_ratio_mult": F.lit(1.5)}
    words = F.array(*(F.lit(x) for x in ["Off", " apagado", "LEVE", "Medio ", "alto", "?"]))
    word = lambda n: F.get(words, (c("c_custkey") % n % 6).cast("int"))
    out = act.adjusted(base, change) | {"less_deesser": act.deesser_intensity(word(7), word(11))}
    return figures(spark, sf_dir).select("c_custkey", *(numeric.half_even(v, 6).alias(n) for n, v in out.items()))


_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
AC = f"""ac AS (SELECT l_orderkey AS plan, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS pos, CASE WHEN l_partkey % 41 = 0 THEN 'audio.nothing.known' WHEN l_partkey % 5 = 0 THEN list_extract({_list(catalog.ALIASES)}, l_suppkey % 36 % {len(catalog.ALIASES)} + 1) ELSE list_extract({_list(IDS)}, l_suppkey % 36 + 1) END AS asked_id,
 CASE WHEN l_suppkey % 36 IN ({', '.join(str(i) for i, f in enumerate(catalog.FUNCTIONS) if f[2])}) OR l_partkey % 7 = 0 THEN list_extract({_list(catalog.BANDS)}, l_partkey % 6 + 1) END AS target, CASE WHEN l_partkey % 11 = 0 THEN 'neutral' WHEN l_partkey % 13 = 0 THEN 'boost' WHEN l_partkey % 17 = 0 THEN 'narrow' WHEN l_partkey % 19 = 0 THEN 'attenuate' END AS asked,
 (CAST(round(l_discount * 100) AS INTEGER) - CAST(round(l_tax * 100) AS INTEGER)) * 3 / 10 AS v, CAST(l_quantity AS INTEGER) % 11 / 10 AS m FROM lineitem)"""
FN = "fn(id, plugin, banded, needs, conflicts) AS (VALUES " + ", ".join(f"('{i}', '{p}', {str(b).lower()}, {_list(n)}, {_list(c)})" for i, p, b, n, c in catalog.FUNCTIONS) + ")"
AL = "al(short, full_id) AS (VALUES " + ", ".join(f"('{a}', '{f}')" for a, f in catalog.ALIASES.items()) + ")"
_num = lambda x: "NULL::DOUBLE" if x is None else f"{x}::DOUBLE"
PA = "pa(no, id, parameter, kind, standard, least, most, choices) AS (VALUES " + ", ".join(f"({n}, '{i}', '{p}', '{t}', '{s}', {_num(lo)}, {_num(hi)}, {_list(c)})" for n, (i, p, t, s, lo, hi, c) in enumerate(catalog.parameter_rows())) + ")"
RE = "re AS (SELECT plan, pos, coalesce(full_id, asked_id) AS function_id, target, asked, v, m, plugin, banded, needs, conflicts FROM ac LEFT JOIN al ON short = asked_id LEFT JOIN fn ON id = coalesce(full_id, asked_id))"
BASE = f"{AC}, {FN}, {AL}, {RE}"
_sign = f"CASE WHEN function_id IN {_in([f for f, p in act.SIGNED.items() if p != 'drive_db'])} THEN v WHEN function_id IN {_in([f for f, p in act.SIGNED.items() if p == 'drive_db'])} THEN v * 4 END"
OP = f"""op AS (SELECT *, {_sign} AS sv, 1 + v / 4 AS w, CASE WHEN asked IS NOT NULL THEN asked WHEN function_id IN {_in(act.WIDTHS)} THEN CASE WHEN 1 + v / 4 < 1 THEN 'narrow' WHEN 1 + v / 4 > 1 THEN 'expand' ELSE 'neutral' END WHEN function_id IN {_in(act.PASSES)} THEN 'cut' WHEN function_id IN {_in([*act.SUPPRESSORS, 'audio.spectral.deharsh'])} THEN 'attenuate'
  WHEN function_id IN ('audio.spectral.dullness_recovery', 'audio.saturation.exciter') THEN 'boost' WHEN function_id IN {_in(act.SIGNED)} THEN CASE WHEN v < 0 THEN 'cut' WHEN v > 0 THEN 'boost' ELSE 'neutral' END WHEN function_id LIKE 'audio.repair.%' OR function_id IN {_in(act.ATTENUATORS)} THEN 'attenuate' ELSE 'protect' END AS operation FROM re),
 pr AS (SELECT *, CASE WHEN plugin IS NULL THEN 'unknown function' WHEN banded AND target IS NULL THEN 'needs a band' WHEN NOT banded AND target IS NOT NULL THEN 'takes no such band'
  WHEN NOT list_contains(CASE WHEN function_id IN {_in(act.SIGNED)} THEN ['cut', 'boost', 'attenuate', 'neutral'] WHEN function_id IN {_in(act.WIDTHS)} THEN ['narrow', 'expand', 'neutral'] WHEN function_id IN {_in(act.PASSES)} THEN ['cut'] WHEN function_id IN {_in([*act.SUPPRESSORS, 'audio.spectral.deharsh'])} THEN ['cut', 'attenuate', 'protect']
   WHEN function_id = 'audio.vocal.center_naturalizer' THEN ['protect', 'attenuate'] WHEN function_id IN ('audio.spectral.dullness_recovery', 'audio.saturation.exciter') THEN ['boost', 'neutral'] WHEN function_id LIKE 'audio.repair.%' OR function_id IN {_in(act.ATTENUATORS)} THEN ['attenuate', 'protect'] ELSE ['protect'] END, operation) THEN 'unsupported'
  WHEN sv IS NOT NULL AND ((operation = 'cut' AND sv >= 0) OR (operation = 'boost' AND sv <= 0) OR (operation = 'neutral' AND abs(sv) > 1e-9) OR (operation = 'attenuate' AND sv > 0)) THEN 'contradicted'
  WHEN function_id IN {_in(act.WIDTHS)} AND ((operation = 'narrow' AND w >= 1) OR (operation = 'expand' AND w <= 1) OR (operation = 'neutral' AND abs(w - 1) > 1e-9)) THEN 'contradicted' ELSE '' END AS problem FROM op)"""
_vocal = "function_id = 'audio.vocal.center_naturalizer'"
_lev = f"""CASE WHEN function_id IN ('audio.tone_eq.band', 'audio.multiband.eq', 'audio.dynamic_eq.motion', 'audio.low_end.dynamic_balance', 'audio.autogain.output_gain', 'audio.transient.dynamic_control', 'audio.glue.bus_compressor', 'audio.multiband.compressor') THEN v WHEN function_id = 'audio.tone_eq.tilt' THEN abs(v) / 2 WHEN function_id = 'audio.spectral.dullness_recovery' THEN abs(v) / 2
  WHEN function_id IN ('audio.multiband.saturation', 'audio.saturation.softclip') THEN least(1.5e0, greatest(v * 4, 0) * least(1, m) * 0.10e0) WHEN function_id = 'audio.saturation.exciter' THEN least(1.5e0, abs(v) * 3 * least(1, m) * 0.15e0) WHEN {_vocal} THEN abs(v) / 2 * least(1, m) WHEN function_id IN {_in(act.WIDTHS)} AND 1 + v / 4 > 1 THEN 20 * log10(1 + v / 4) ELSE 0 END"""
_at = f"CASE WHEN function_id = 'audio.tone_eq.tilt' AND v > 0 OR function_id IN ('audio.spectral.dullness_recovery', 'audio.saturation.exciter') THEN ['high_mid', 'air'] WHEN function_id = 'audio.tone_eq.tilt' THEN ['sub_bass', 'bass'] WHEN {_vocal} THEN ['low_mid', 'mid'] WHEN function_id IN ('audio.autogain.output_gain', 'audio.glue.bus_compressor') OR target IS NULL THEN {_list(catalog.BANDS)} ELSE [target] END"
_tone = f"CASE WHEN function_id IN {_in(act.TONAL_GAINS)} THEN v WHEN function_id IN {_in([*act.SUPPRESSORS, 'audio.spectral.deharsh'])} THEN -abs(v) WHEN function_id = 'audio.spectral.dullness_recovery' THEN abs(v) / 2 END"
_gain = "CASE WHEN function_id IN ('audio.autogain.output_gain', 'audio.glue.bus_compressor', 'audio.multiband.compressor') THEN v ELSE 0 END"


def _contributions(source: str) -> str:
    """The oracle's own account of what an action adds."""
    return f"""t0 AS (SELECT *, {_tone} AS tone, {_gain} AS gain, {_lev} AS lev, {_at} AS places FROM {source}),
 ct AS (SELECT *, CASE WHEN {_vocal} THEN abs(v) / 2 * m ELSE greatest(coalesce(tone, 0), 0) END AS tb, CASE WHEN {_vocal} THEN (abs(v) + 0.1e0) * m ELSE greatest(-coalesce(tone, 0), 0) END AS tc, greatest(gain, 0) AS gb, greatest(-gain, 0) AS gc,
  CASE WHEN {_vocal} THEN 'vocal_center' WHEN tone IS NOT NULL THEN coalesce(target, 'global') END AS scope, CASE WHEN lev > 1e-9 THEN lev ELSE 0 END AS boost FROM t0),
 cx AS (SELECT *, CASE WHEN {_vocal} THEN NULL WHEN gb > 2 OR gc > 3 THEN '{act.GAIN}' WHEN tb > 2 OR tc > 3 THEN '{act.TONAL}' END AS alone FROM ct)"""


_r3 = lambda x: f"CAST(printf('%.3f', {x}) AS DOUBLE)"
_band_sum = lambda b: f"sum(CASE WHEN list_contains(places, '{b}') THEN boost ELSE 0 END ORDER BY pos)"
_scope_vec = "list_transform({list}, lambda x: CASE WHEN scope = x THEN {value}::DOUBLE ELSE 0e0 END)"
_vec = (
    "[tb, tc, gb, gc]::DOUBLE[] || " + " || ".join(_scope_vec.format(list=_list(act.SCOPES), value=x) for x in ("tb", "tc", "1")) + f" || list_transform({_list(catalog.BANDS)}, lambda x: CASE WHEN list_contains(places, x) THEN boost::DOUBLE ELSE 0e0 END)"
    " || [CASE WHEN function_id = 'audio.saturation.softclip' THEN 1 ELSE 0 END, CASE WHEN function_id = 'audio.saturation.exciter' THEN 1 ELSE 0 END]::DOUBLE[]"
)
_why = (
    f"CASE WHEN nxt[35] > 0 AND nxt[36] > 0 THEN 'conflict' WHEN len(list_filter(nxt[29:34], lambda x: CAST(printf('%.3f', x) AS DOUBLE) > 2.5e0 + 1e-9)) > 0 THEN '{act.HEADROOM}' WHEN nxt[3] > 3 + 1e-9 OR nxt[4] > 6 + 1e-9 THEN '{act.GAIN}' WHEN nxt[1] > 3 + 1e-9 OR nxt[2] > 6 + 1e-9 THEN '{act.TONAL}'"
    f" WHEN len(list_filter(range(1, 9), lambda i: nxt[20 + i] > 1 AND (nxt[4 + i] > 2 + 1e-9 OR nxt[12 + i] > 3 + 1e-9))) > 0 THEN '{act.OVERLAP}' ELSE alone END"
)
_map_text = "array_to_string([" + ", ".join(f"'{n}=' || printf('%.4f', CAST({e} AS DOUBLE))" for n, e in sorted(PARAMS.items())) + "], ',')"
_band_of = f"list_extract({_list(catalog.BANDS)}, CAST((k + {{i}}) % 6 AS INTEGER) + 1)"
_cands = "[" + ", ".join(f"{{{{'hz': CAST((k + {i}) % 7 * 600 + 250 + k % 3 * 30 AS DOUBLE), 'target': {_band_of.format(i=i)}, 'excess': CAST(1 + k % 4 / 2 + {i} / 4 AS DOUBLE)}}}}".replace("{{", "{").replace("}}", "}") for i in range(3)) + "]"
_own, _cl = {n: f"CAST({e} AS DOUBLE)" for n, e in LOCAL.items()}, {n: f"CAST({e} AS DOUBLE)" for n, e in CLAIMS.items()}
_ranges = " ".join(f"WHEN '{b}' THEN hz < {lo} OR hz > {hi}" for b, (lo, hi) in evidence.RANGES.items())
_metric = lambda f, n, off, more="": f"WHEN function_id = '{f}' THEN CASE WHEN abs({_own[n]} - {_cl[n]}) > {off} THEN 'another value claimed' {more} END"
#: The oracle's own account of what evidence bears out.
EVID = f"""e0 AS (SELECT *, plan AS k, pos // 100000 % 10000000 AS p FROM pr), e1 AS (SELECT *, CAST({HZ} AS DOUBLE) AS hz, greatest(100e0, CAST({HZ} AS DOUBLE) * 0.10e0) AS off, list_extract(['stereo', 'mid', 'side'], p % 3 + 1) AS side, {_cands} AS cands FROM e0),
 e2 AS (SELECT *, list_filter(cands, lambda c: abs(c.hz - hz) <= off AND CASE WHEN function_id LIKE 'audio.vocal.%' THEN c.hz BETWEEN 1800 AND 8000 ELSE c.target = target END)[1] AS hit FROM e1),
 ev AS (SELECT *, p % 29 = 0 AS bare, p % 31 > 0 AS switched_on, CASE WHEN function_id LIKE 'audio.dynamic_eq.%' THEN CASE WHEN CASE target {_ranges} ELSE true END THEN 'outside its band'
   WHEN function_id = 'audio.dynamic_eq.resonance' AND abs({_cl["resonance_frequency_hz"]} - hz) > off THEN 'another resonance claimed' WHEN function_id = 'audio.dynamic_eq.resonance' AND hit IS NULL THEN 'no such resonance'
   WHEN function_id = 'audio.dynamic_eq.resonance' AND abs(hit.excess - {_cl["measured_excess_db"]}) > 0.75e0 THEN 'another excess claimed'
   WHEN side = 'stereo' THEN NULL WHEN NOT {_cl["mid_side_ratio"]} BETWEEN 0 AND 1 THEN 'no ratio' WHEN abs({_own["mid_side_ratio"]} - {_cl["mid_side_ratio"]}) > 0.05e0 THEN 'another ratio claimed'
   WHEN side = 'mid' AND {_cl["mid_side_ratio"]} < 0.60e0 THEN 'no middle' WHEN side = 'side' AND {_cl["mid_side_ratio"]} > 0.40e0 THEN 'no side' END
  WHEN function_id LIKE 'audio.vocal.%' THEN CASE WHEN {_own["mid_side_ratio"]} < 0.60e0 OR {_own["vocal_center_confidence"]} < 0.65e0 THEN 'no sure voice'
   WHEN abs({_cl["mid_side_ratio"]} - {_own["mid_side_ratio"]}) > 0.05e0 OR abs({_cl["vocal_center_confidence"]} - {_own["vocal_center_confidence"]}) > 0.05e0 THEN 'another voice claimed'
   WHEN function_id = 'audio.vocal.resonance_suppressor' THEN CASE WHEN hit IS NULL OR abs({_cl["resonance_frequency_hz"]} - hz) > off THEN 'no such resonance' WHEN abs(hit.excess - {_cl["measured_excess_db"]}) > 0.75e0 THEN 'another excess claimed' END
   WHEN abs(v) / 2 > 0 AND {_cl["measured_body_deficit_db"]} <= 0 THEN 'no measured_body_deficit_db' WHEN abs(v) > 0 AND {_cl["measured_harshness_excess_db"]} <= 0 THEN 'no measured_harshness_excess_db' WHEN {_cl["measured_air_excess_db"]} <= 0 THEN 'no measured_air_excess_db' END
  {_metric("audio.transient.dynamic_control", "transient_crest_db", "0.75e0")}
  {_metric("audio.stereo.correlation_guard", "stereo_correlation", "0.05e0", f"WHEN w > 1 AND {_own['stereo_correlation']} < 0.70e0 THEN 'not in phase' WHEN w < 1 AND {_own['stereo_correlation']} >= 0 THEN 'not out of phase'")}
  {_metric("audio.low_end.dynamic_balance", "low_end_level_db", "0.75e0", f"WHEN NOT {_own['low_end_mid_ratio']} BETWEEN 0 AND 1 OR abs({_own['low_end_mid_ratio']} - {_cl['low_end_mid_ratio']}) > 0.05e0 THEN 'another ratio claimed'")}
  {_metric("audio.spectral.deharsh", "harshness_excess_db", "0.75e0", f"WHEN {_own['harshness_excess_db']} <= 0 THEN 'nothing to mend'")}
  {_metric("audio.spectral.dullness_recovery", "dullness_deficit_db", "0.75e0", f"WHEN {_own['dullness_deficit_db']} <= 0 THEN 'nothing to mend'")} END AS unproven FROM e2)"""
_lack = lambda n: f"NOT coalesce({_cl[n]} > 0, false)"
#: A single action's offence where there is evidence.
ALONE = f"CASE WHEN gb > 2 AND NOT {_vocal} OR gc > 3 AND NOT {_vocal} OR gb > 0 AND {_lack('compensation_required_db')} THEN '{act.GAIN}' WHEN NOT {_vocal} AND (tb > 2 OR tc > 3) OR scope IS NOT NULL AND NOT {_vocal} AND (operation = 'boost' AND {_lack('measured_deficit_db')} OR operation = 'cut' AND {_lack('measured_excess_db')}) THEN '{act.TONAL}' END"
_ROUND = "CAST(printf('%.3f', x) AS DOUBLE)"


def _admission(blocked: str, source: str, alone: str, boost: str = "boost") -> str:
    """The fold of the admission as a recursion over the actions of each plan."""
    return f"""o AS (SELECT plan, pos, function_id, {alone} AS alone, operation = 'neutral' AS neutral, {_vec.replace('boost::DOUBLE', f'({boost})::DOUBLE')} AS vec, {blocked} AS blocked, row_number() OVER (PARTITION BY plan ORDER BY pos) AS k FROM {source}),
 w AS (SELECT plan, 0::BIGINT AS k, list_transform(range(36), lambda i: 0e0) AS state, NULL::BIGINT AS pos, NULL::VARCHAR AS function_id, NULL::VARCHAR AS outcome, NULL::VARCHAR AS reason FROM o WHERE k = 1
  UNION ALL SELECT plan, k, CASE WHEN blocked IS NULL AND NOT neutral AND why IS NULL THEN nxt ELSE state END, pos, function_id, CASE WHEN blocked IS NOT NULL THEN 'rejected' WHEN neutral THEN 'neutral' WHEN why IS NULL THEN 'accepted' ELSE 'rejected' END, CASE WHEN blocked IS NOT NULL THEN blocked WHEN NOT neutral THEN why END
   FROM (SELECT *, {_why} AS why FROM (SELECT o.plan, o.k, w.state, o.pos, o.function_id, o.blocked, o.neutral, o.alone, list_transform(list_zip(w.state, o.vec), lambda p: p[1] + p[2]) AS nxt FROM w JOIN o ON o.plan = w.plan AND o.k = w.k + 1)))
 SELECT plan, pos, function_id, outcome, reason FROM w WHERE k > 0"""


_LATE = f"CASE WHEN plan % 4 = 0 AND function_id IN {_in(act.DENSITY)} THEN 'dense material' WHEN function_id = 'audio.multiband.stereo_width' AND target = 'sub_bass' AND w > 1 THEN 'wide sub bass' END"
QUERIES = {
    "catalog_lookup": catalog_lookup, "catalog_certification": catalog_certification, "parameter_validation": parameter_validation, "plan_validation": plan_validation, "plan_conflicts": plan_conflicts, "budget_totals": budget_totals, "band_headroom": band_headroom,
    "admission_fold": admission_fold, "guardrail_injection": guardrail_injection, "effective_order": effective_order, "graph_compile": graph_compile, "compiled_graphs": compiled_graphs, "admission_by_evidence": admission_by_evidence, "plan_fingerprint": plan_fingerprint, "classic_strategy": classic_strategy, "execution_audit": execution_audit,
    "legacy_migration": legacy_migration, "strategy_adjustments": strategy_adjustments, "adjusted_settings": adjusted_settings,
}
_words = _list(["off", "apagado", "leve", "medio", "alto", "?"])
ORACLES = {
    "catalog_lookup": f"WITH {BASE} SELECT function_id, plugin, count(*) AS n FROM re GROUP BY function_id, plugin",
    "catalog_certification": f"WITH {BASE}, {PA}, p AS (SELECT id, count(*) AS params, count(*) FILTER (WHERE kind = 'float') AS floats, bool_and((kind IN ('str', 'bool') OR (try_cast(standard AS DOUBLE) >= coalesce(least, -1e300) AND try_cast(standard AS DOUBLE) <= coalesce(most, 1e300))) AND (len(choices) = 0 OR list_contains(choices, standard))) AS sound FROM pa GROUP BY id), u AS (SELECT plugin, count(*) AS used FROM re GROUP BY plugin), c AS (SELECT plugin, count(*) AS functions, CAST(sum(params) AS BIGINT) AS params, CAST(sum(floats) AS BIGINT) AS floats, bool_and(sound) AS sound FROM fn JOIN p USING (id) GROUP BY plugin) SELECT c.*, coalesce(used, 0) AS used FROM c LEFT JOIN u USING (plugin)",
    "parameter_validation": f"""WITH {PA}, g AS (SELECT c_custkey, c_custkey % 129 AS spot, CASE c_custkey % 7 WHEN 0 THEN 'Leve' WHEN 1 THEN '2' WHEN 2 THEN 'true' WHEN 3 THEN '0.25' WHEN 4 THEN (c_custkey % 400) || '.5' WHEN 5 THEN '-' || (c_custkey % 90) END AS raw FROM customer)
 SELECT c_custkey, coalesce(id, 'audio.repair.denoise') AS function_id, coalesce(parameter, 'speed') AS parameter, CASE WHEN raw IS NULL THEN 'missing' WHEN id IS NULL THEN 'unknown parameter' WHEN kind = 'bool' AND raw NOT IN ('true', 'false') THEN 'not bool' WHEN kind = 'int' AND NOT regexp_full_match(raw, '[+-]?[0-9]+') THEN 'not int' WHEN kind = 'float' AND try_cast(raw AS DOUBLE) IS NULL THEN 'not float'
  WHEN len(choices) > 0 AND NOT list_contains(choices, raw) THEN 'no choice' WHEN try_cast(raw AS DOUBLE) < least THEN 'too low' WHEN try_cast(raw AS DOUBLE) > most THEN 'too high' ELSE '' END AS problem FROM g LEFT JOIN pa ON no = spot""",
    "plan_validation": f"WITH {BASE}, {OP} SELECT plan, pos, operation, problem FROM pr",
    "plan_conflicts": f"""WITH {BASE}, g AS (SELECT plan, list(DISTINCT function_id) AS ids, flatten(list(conflicts)) AS against, flatten(list(needs)) AS needs FROM re GROUP BY plan)
 SELECT plan, array_to_string(list_sort(list_filter(ids, lambda i: list_contains(against, i))), ',') AS conflicts, array_to_string(list_sort(list_distinct(list_filter(needs, lambda n: NOT list_contains({_list(ANALYSIS)}, n)))), ',') AS missing FROM g""",
    "budget_totals": f"""WITH {BASE}, {_contributions('re')}, sc AS (SELECT plan, scope FROM cx WHERE scope IS NOT NULL GROUP BY plan, scope HAVING count(*) > 1 AND (sum(tb ORDER BY pos) > 2 + 1e-9 OR sum(tc ORDER BY pos) > 3 + 1e-9)),
 b AS (SELECT plan, count(*) AS actions, sum(tb ORDER BY pos) AS tb, sum(tc ORDER BY pos) AS tc, sum(gb ORDER BY pos) AS gb, sum(gc ORDER BY pos) AS gc, bool_or(coalesce(alone = '{act.TONAL}', false)) AS ot, bool_or(coalesce(alone = '{act.GAIN}', false)) AS og, greatest({', '.join(_r3(_band_sum(b)) for b in catalog.BANDS)}) AS most FROM cx GROUP BY plan),
 o AS (SELECT *, concat_ws(',', CASE WHEN ot OR tb > 3 + 1e-9 OR tc > 6 + 1e-9 THEN '{act.TONAL}' END, CASE WHEN og OR gb > 3 + 1e-9 OR gc > 6 + 1e-9 THEN '{act.GAIN}' END, CASE WHEN plan IN (SELECT plan FROM sc) THEN '{act.OVERLAP}' END, CASE WHEN most > 2.5e0 + 1e-9 THEN '{act.HEADROOM}' END) AS offended FROM b)
 SELECT plan, actions, {_r3('tb')} AS tonal_boost, {_r3('tc')} AS tonal_cut, {_r3('gb')} AS gain_boost, {_r3('gc')} AS gain_cut, {_r3('greatest(0, 3 - tb)')} AS tonal_boost_left, {_r3('greatest(0, 6 - tc)')} AS tonal_cut_left, {_r3('greatest(0, 3 - gb)')} AS gain_boost_left, {_r3('greatest(0, 6 - gc)')} AS gain_cut_left, offended, CASE WHEN offended = '' THEN 'passed' ELSE 'rejected' END AS status FROM o""",
    "band_headroom": f"""WITH {BASE}, {_contributions('re')}, s AS ({' UNION ALL '.join(f"SELECT plan, {i} AS no, '{b}' AS band, {_r3(_band_sum(b))} AS boost FROM cx GROUP BY plan" for i, b in enumerate(catalog.BANDS))})
 SELECT plan, band, boost, boost > 2.5e0 + 1e-9 AS exceeded FROM s QUALIFY row_number() OVER (PARTITION BY plan ORDER BY boost DESC, no) = 1""",
    "admission_fold": f"WITH RECURSIVE {BASE}, {OP}, {_contributions('pr')}, " + _admission(f"CASE WHEN problem <> '' THEN problem WHEN operation = 'neutral' THEN NULL ELSE {_LATE} END", "cx", "alone"),
    "admission_by_evidence": f"WITH RECURSIVE {BASE}, {OP}, {EVID}, {_contributions('ev')}, " + _admission(f"CASE WHEN bare THEN 'no evidence' WHEN problem <> '' THEN problem WHEN NOT switched_on THEN 'switched off' WHEN operation = 'neutral' THEN NULL ELSE coalesce(unproven, {_LATE}) END", "cx", ALONE, "CASE WHEN switched_on THEN boost ELSE 0 END"),
    "compiled_graphs": f"""WITH {AC}, {FN}, {AL}, {RE.replace("re AS (", "re0 AS (", 1)}, re AS (SELECT * REPLACE (NULL::VARCHAR AS asked, CASE WHEN banded THEN coalesce(target, 'mid') END AS target) FROM re0), {OP}, {_contributions('pr')},
 bad AS (SELECT plan, arg_min(problem, pos) AS problem FROM pr WHERE problem <> '' GROUP BY plan), cf AS (SELECT plan, list(DISTINCT function_id) AS ids, flatten(list(conflicts)) AS against FROM re GROUP BY plan), cl AS (SELECT plan, array_to_string(list_sort(list_filter(ids, lambda i: list_contains(against, i))), ',') AS clash FROM cf),
 s AS ({' UNION ALL '.join(f"SELECT plan, {i} AS no, '{b}' AS band, {_r3(f"sum(CASE WHEN pos % 7 > 0 AND list_contains(places, '{b}') THEN boost ELSE 0 END ORDER BY pos)")} AS boost FROM cx GROUP BY plan" for i, b in enumerate(catalog.BANDS))}), hr AS (SELECT plan, band, boost FROM s QUALIFY row_number() OVER (PARTITION BY plan ORDER BY boost DESC, no) = 1),
 f AS (SELECT plan, pos, plugin, pos % 7 > 0 AS live, CASE WHEN plugin = 'audio.multiband' AND lag(plugin) OVER u = plugin AND lag(pos % 7 > 0) OVER u THEN 0 ELSE 1 END AS fresh FROM re WINDOW u AS (PARTITION BY plan ORDER BY pos)), st AS (SELECT *, sum(fresh) OVER (PARTITION BY plan ORDER BY pos ROWS UNBOUNDED PRECEDING) AS stage FROM f),
 g AS (SELECT plan, stage, any_value(plugin) AS plugin, count(*) AS n FROM st WHERE live GROUP BY plan, stage), l AS (SELECT *, '[' || substr(plugin, 7) || '_' || row_number() OVER (PARTITION BY plan, plugin ORDER BY stage) || ':' || n || ']' AS t FROM g), gr AS (SELECT plan, count(*) AS stages, string_agg(t, ';' ORDER BY stage) AS graph FROM l GROUP BY plan),
 x AS (SELECT hr.plan, CASE WHEN problem IS NOT NULL THEN problem WHEN clash <> '' THEN 'conflict: ' || clash WHEN boost > 2.5e0 + 1e-9 THEN '{act.HEADROOM}: ' || band || printf('=%.2fdB', boost) END AS error, stages, graph FROM hr LEFT JOIN bad USING (plan) LEFT JOIN cl USING (plan) LEFT JOIN gr USING (plan))
 SELECT plan, error, CASE WHEN error IS NULL THEN coalesce(stages, 0) END AS stages, CASE WHEN error IS NULL THEN coalesce(graph, '') END AS graph FROM x""",
    "guardrail_injection": f"""WITH {BASE}, own AS (SELECT plan, function_id, min(pos) AS pos, arg_min(v, pos) AS v FROM re WHERE function_id IN ('audio.loudness.normalize', 'audio.limiter.true_peak') GROUP BY plan, function_id),
 wanted AS (SELECT DISTINCT plan, f AS function_id FROM re, (VALUES ('audio.loudness.normalize'), ('audio.limiter.true_peak')) t(f)),
 u AS (SELECT plan, 0 AS stage, pos, function_id, false AS injected, NULL::DOUBLE AS target_lufs, NULL::DOUBLE AS ceiling_db, NULL::DOUBLE AS true_peak_db FROM re WHERE function_id NOT IN ('audio.loudness.normalize', 'audio.limiter.true_peak')
  UNION ALL SELECT plan, CASE WHEN function_id = 'audio.loudness.normalize' THEN 1 ELSE 2 END, own.pos, function_id, own.pos IS NULL, CASE WHEN function_id = 'audio.loudness.normalize' THEN -14e0 WHEN own.pos IS NOT NULL THEN own.v - 14 END,
   CASE WHEN function_id = 'audio.limiter.true_peak' THEN least(coalesce(own.v - 1, -1), -1)::DOUBLE WHEN own.pos IS NOT NULL THEN own.v - 1 END, CASE WHEN function_id = 'audio.loudness.normalize' THEN -1e0 END FROM wanted LEFT JOIN own USING (plan, function_id))
 SELECT plan, CAST(row_number() OVER (PARTITION BY plan ORDER BY stage, pos) AS INTEGER) AS step, function_id, injected, CAST(printf('%.4f', target_lufs) AS DOUBLE) AS target_lufs, CAST(printf('%.4f', ceiling_db) AS DOUBLE) AS ceiling_db, true_peak_db FROM u""",
    "effective_order": f"WITH {BASE} SELECT plan, pos, function_id, CAST(row_number() OVER (PARTITION BY plan ORDER BY CASE function_id WHEN 'audio.loudness.normalize' THEN 1 WHEN 'audio.limiter.true_peak' THEN 2 ELSE 0 END, pos) AS INTEGER) AS step FROM re",
    "graph_compile": f"""WITH {BASE}, f AS (SELECT plan, pos, plugin, CASE WHEN plugin = 'audio.multiband' AND lag(plugin) OVER (PARTITION BY plan ORDER BY pos) = plugin THEN 0 ELSE 1 END AS fresh FROM re WHERE function_id <> 'audio.nothing.known'), s AS (SELECT *, sum(fresh) OVER (PARTITION BY plan ORDER BY pos ROWS UNBOUNDED PRECEDING) AS stage FROM f),
 g AS (SELECT plan, stage, any_value(plugin) AS plugin, count(*) AS n FROM s GROUP BY plan, stage), l AS (SELECT *, '[' || substr(plugin, 7) || '_' || row_number() OVER (PARTITION BY plan, plugin ORDER BY stage) || ':' || n || ']' AS t FROM g) SELECT plan, count(*) AS stages, string_agg(t, ';' ORDER BY stage) AS graph FROM l GROUP BY plan""",
    "plan_fingerprint": f"WITH {AC} SELECT plan, 'sha256:' || sha256(string_agg(asked_id || '|' || coalesce(target, '-') || '|' || {_map_text}, ';' ORDER BY pos)) AS fingerprint FROM ac GROUP BY plan",
    "classic_strategy": f"""WITH {FX}, r AS (SELECT c_custkey, 0 AS no, 'audio.autogain.headroom' AS function_id, NULL AS target, 'protect' AS operation, 'gain_db' AS parameter, CASE WHEN c_custkey % 9 > 0 AND lufs - 6 < -25 THEN -12e0 ELSE -17e0 END AS value FROM fx
  UNION ALL SELECT c_custkey, 1, 'audio.deesser.sibilance_reduction', NULL, 'attenuate', 'intensity', 0.4e0 FROM fx WHERE voice - 8 > -30 UNION ALL SELECT c_custkey, 2, 'audio.multiband.eq', 'high_mid', 'cut', 'gain_db', -0.8e0 FROM fx WHERE high_mid > -22 UNION ALL SELECT c_custkey, 3, 'audio.multiband.eq', 'air', 'cut', 'gain_db', -1e0 FROM fx WHERE air - 2 > -24
  UNION ALL SELECT c_custkey, 4 + i, 'audio.multiband.stereo_width', b, CASE WHEN w < 1 THEN 'narrow' ELSE 'expand' END, 'width', w FROM fx, (VALUES (0, 'sub_bass', 0e0), (1, 'bass', 0.4e0), (2, 'low_mid', 0.7e0), (3, 'high_mid', 1.15e0), (4, 'air', 1.25e0)) t(i, b, w))
 SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY no) - 1 AS pos, function_id, target, operation, parameter, value FROM r""",
    "execution_audit": f"""WITH {BASE}, {OP}, n AS (SELECT plan, {', '.join(f"count(*) FILTER (WHERE operation = '{o}') AS \"{o}\"" for o in act.OPERATIONS)} FROM pr GROUP BY plan),
 r AS (SELECT o_orderkey AS plan, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 40 / 50 - 14.4e0 END AS lufs, o_orderkey % 30 / 25 - 1.9e0 AS peak, -14e0 AS target, -1e0 AS ceiling FROM orders), c AS (SELECT *, coalesce(abs(lufs - target) <= 0.3e0, false) AS loud_enough, peak - ceiling <= 0.2e0 AS below_ceiling FROM r)
 SELECT c.*, {_r3('lufs - target')} AS error_lu, {_r3('peak - ceiling')} AS overshoot_db, {', '.join(f'coalesce("{o}", 0) AS "{o}"' for o in act.OPERATIONS)}, CASE WHEN loud_enough AND below_ceiling THEN 'passed' ELSE 'warning' END AS status FROM c LEFT JOIN n USING (plan)""",
    "legacy_migration": f"""WITH s AS (SELECT l_suppkey AS track, l_orderkey % 10 AS n, CASE WHEN l_orderkey % 10 IN (4, 6) THEN list_extract({_list([*catalog.BANDS, *diagnosis.BANDS.values(), 'Elsewhere'])}, l_partkey % 13 + 1) END AS band, max(l_linenumber - 2)::DOUBLE AS value FROM lineitem GROUP BY ALL),
 t(n, function_id, parameter, neutral, stage) AS (VALUES (0, 'audio.repair.denoise', 'level', 0, 0), (1, 'audio.repair.declip', 'level', 0, 0), (2, 'audio.repair.declick', 'level', 0, 0), (3, 'audio.deesser.sibilance_reduction', 'intensity', 0, 1), (4, 'audio.tone_eq.band', 'gain_db', 0, 2), (5, 'audio.tone_eq.tilt', 'gain_db', 0, 2), (6, 'audio.multiband.stereo_width', 'width', 1, 3), (7, 'audio.saturation.softclip', 'drive_db', 0, 4), (8, 'audio.glue.bus_compressor', 'ratio', 1, 5)),
 b(i, target, band) AS (VALUES {', '.join(f"({i}, '{b}', '{x}')" for i, b in enumerate(catalog.BANDS) for x in (b, diagnosis.BANDS[b]))}),
 j AS (SELECT track, stage, s.n, s.band, coalesce(i, -1) AS i, function_id, target, parameter, value FROM s JOIN t USING (n) LEFT JOIN b ON b.band = s.band WHERE value <> neutral AND (s.band IS NULL OR target IS NOT NULL))
 SELECT track, row_number() OVER (PARTITION BY track ORDER BY stage, n, i, band) AS pos, function_id, target, parameter, value FROM j""",
    "strategy_adjustments": f"""WITH {BASE}, l AS (SELECT plan, function_id, target, arg_max(v, pos) AS v, arg_max(m, pos) AS m FROM re GROUP BY plan, function_id, target)
 SELECT plan, coalesce(string_agg(target || '=' || printf('%.4f', v), ',' ORDER BY target) FILTER (WHERE function_id = 'audio.multiband.eq' AND target IS NOT NULL), '') AS gains, coalesce(string_agg(target || '=' || printf('%.4f', 1 + v / 4), ',' ORDER BY target) FILTER (WHERE function_id = 'audio.multiband.stereo_width' AND target IS NOT NULL), '') AS widths, max(m) FILTER (WHERE function_id = 'audio.deesser.sibilance_reduction') AS deesser FROM l GROUP BY plan""",
    "adjusted_settings": f"""WITH {FX}, u AS (SELECT *, list_extract({_words}, c_custkey % 7 % 6 + 1) AS nw, list_extract({_words}, c_custkey % 11 % 6 + 1) AS cw FROM fx)
 SELECT c_custkey, CAST(printf('%.6f', greatest(0.2e0, least(1e0, width * mult))) AS DOUBLE) AS deesser_intensity, CAST(printf('%.6f', drive * CASE WHEN mono THEN 0.5e0 ELSE 1 END) AS DOUBLE) AS saturation_drive, CAST(printf('%.6f', mix * width) AS DOUBLE) AS saturation_mix, CAST(printf('%.6f', off - crest) AS DOUBLE) AS glue_threshold, CAST(printf('%.6f', mult * 1.5e0) AS DOUBLE) AS glue_ratio,
 CAST(printf('%.6f', greatest(0.2e0, least(1e0, greatest(0e0, 2.5e0 - CASE nw WHEN 'off' THEN 0 WHEN 'apagado' THEN 0 WHEN 'medio' THEN 1.2e0 WHEN 'alto' THEN 1.8e0 ELSE 0.6e0 END - CASE cw WHEN 'off' THEN 0 WHEN 'apagado' THEN 0 WHEN 'medio' THEN 1.5e0 WHEN 'alto' THEN 2.1e0 ELSE 0.9e0 END) / 2.5e0))) AS DOUBLE) AS less_deesser FROM u""",
}
