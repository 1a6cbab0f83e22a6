"""Plans of actions as rows: validation, operations, budgets, ordered admission, guardrails, execution order, graphs and audits.

An action: plan, pos, function_id, target (a band or null), params (numbers by name), and where asked for operation and
evidence (numbers by name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import apart, half_even, let, rounds_above, sum_in_order, width_db
from ..operators.diagnosis import BANDS as BAND_LABELS
from . import catalog

#: What one action and a whole plan may boost and cut, in tone and in gain, and a band at once, in dB.
LIMITS = {
    "tonal_boost_individual": 2.0, "tonal_cut_individual": 3.0, "tonal_boost_total": 3.0, "tonal_cut_total": 6.0,
    "gain_boost_individual": 2.0, "gain_cut_individual": 3.0, "gain_boost_total": 3.0, "gain_cut_total": 6.0, "band_boost": 2.5,
}
#: Names of the governors that reject.
TONAL, GAIN, OVERLAP, HEADROOM = "audio.governor.tonal_budget", "audio.governor.gain_budget", "audio.governor.spectral_overlap", "audio.governor.chain_headroom"
#: What an action may do.
OPERATIONS = ["cut", "boost", "attenuate", "expand", "narrow", "protect"]
#: The parameter whose sign tells cut from boost.
SIGNED = {
    "audio.tone_eq.band": "gain_db", "audio.tone_eq.tilt": "gain_db", "audio.multiband.eq": "gain_db", "audio.dynamic_eq.motion": "gain_db", "audio.transient.dynamic_control": "amount_db",
    "audio.low_end.dynamic_balance": "gain_db", "audio.autogain.output_gain": "gain_db", "audio.multiband.saturation": "drive_db", "audio.saturation.softclip": "drive_db",
}
#: Functions that set a width, that suppress, that fade, and those that only attenuate.
WIDTHS = ["audio.multiband.stereo_width", "audio.stereo.correlation_guard"]
SUPPRESSORS = ["audio.dynamic_eq.resonance", "audio.vocal.resonance_suppressor"]
PASSES = ["audio.tone_eq.high_pass", "audio.tone_eq.low_pass"]
ATTENUATORS = ["audio.deesser.sibilance_reduction", "audio.multiband.compressor", "audio.multiband.limiter", "audio.glue.bus_compressor", "audio.loudness.fade_in", "audio.loudness.fade_out"]
#: Functions whose signed gain is tonal, and those that make dense material denser.
TONAL_GAINS = ["audio.tone_eq.band", "audio.tone_eq.tilt", "audio.multiband.eq", "audio.dynamic_eq.motion", "audio.low_end.dynamic_balance"]
DENSITY = ["audio.glue.bus_compressor", "audio.multiband.compressor", "audio.multiband.saturation", "audio.saturation.softclip"]
#: The plugin whose neighbouring actions share one stage, and what always comes last.
SHARED_STAGE = "audio.multiband"
TAIL = {"audio.loudness.normalize": 1, "audio.limiter.true_peak": 2}
SCOPES = [*catalog.BANDS, "global", "vocal_center"]


#: The parameter that moves the tone (and its sign), the one that moves the gain.
TONES = {n: ("gain_db", 1.0) for n in TONAL_GAINS} | {n: ("max_reduction_db", -1.0) for n in [*SUPPRESSORS, "audio.spectral.deharsh"]} | {"audio.spectral.dullness_recovery": ("max_boost_db", 1.0)}
GAINS = {"audio.autogain.output_gain": "gain_db", "audio.glue.bus_compressor": "makeup_db", "audio.multiband.compressor": "makeup_db"}
#: What may boost a band, (parameter, factor, most, times the mix); widths follow a law of their own.
BOOSTS = (
    {n: ("gain_db", 1.0, None, False) for n in ("audio.tone_eq.band", "audio.multiband.eq", "audio.dynamic_eq.motion", "audio.low_end.dynamic_balance", "audio.autogain.output_gain")}
    | {"audio.tone_eq.tilt": ("gain_db", 0.5, None, False), "audio.spectral.dullness_recovery": ("max_boost_db", 1.0, None, False), "audio.transient.dynamic_control": ("amount_db", 1.0, None, False)}
    | {n: ("makeup_db", 1.0, None, False) for n in ("audio.glue.bus_compressor", "audio.multiband.compressor")}
    | {n: ("drive_db", 0.10, 1.5, True) for n in ("audio.multiband.saturation", "audio.saturation.softclip")}
    | {"audio.saturation.exciter": ("amount", 0.15, 1.5, True), "audio.vocal.center_naturalizer": ("body_gain_db", 1.0, None, True)}
    | {n: ("width", 1.0, None, False) for n in WIDTHS}
)
#: Bands that a function reaches whatever its target; the tilt reaches the first when it rises, else the second.
REACHES = {n: ["high_mid", "air"] for n in ("audio.tone_eq.tilt", "audio.spectral.dullness_recovery", "audio.saturation.exciter")} | {"audio.vocal.center_naturalizer": ["low_mid", "mid"]} | {n: catalog.BANDS for n in ("audio.autogain.output_gain", "audio.glue.bus_compressor")}
FALLS = {"audio.tone_eq.tilt": ["sub_bass", "bass"]}


def kind_of(function: str) -> tuple[str, list[str]]:
    """What tells the operation of a function (width, sign, or the operation itself), and the operations it may be asked for."""
    if function in WIDTHS:
        return "width", ["narrow", "expand", "neutral"]
    if function in PASSES:
        return "cut", ["cut"]
    if function in [*SUPPRESSORS, "audio.spectral.deharsh"]:
        return "attenuate", ["cut", "attenuate", "protect"]
    if function in ("audio.spectral.dullness_recovery", "audio.saturation.exciter"):
        return "boost", ["boost", "neutral"]
    if function in SIGNED:
        return "sign", ["cut", "boost", "attenuate", "neutral"]
    if function.startswith("audio.repair.") or function in ATTENUATORS:
        return "attenuate", ["attenuate", "protect"]
    return "protect", ["protect", "attenuate"] if function == "audio.vocal.center_naturalizer" else ["protect"]


def laws(spark: SparkSession) -> DataFrame:
    """A row for each function of the catalog: how its operation is told and what it adds to tone, gain and bands."""
    rows = []
    for f, *_ in catalog.FUNCTIONS:
        boost, factor, most, wet = BOOSTS.get(f, (None, 0.0, None, False))
        rows.append((f, *kind_of(f), SIGNED.get(f), *TONES.get(f, (None, 0.0)), GAINS.get(f), boost, factor, most, wet, REACHES.get(f), FALLS.get(f)))
    fields = "function_id string, _kind string, _supported array<string>, _signed string, _tone string, _tone_sign double, _gain string, _boost string, _factor double, _most double, _wet boolean, _reach array<string>, _fall array<string>"
    return spark.createDataFrame(rows, fields)


def with_laws(actions: DataFrame) -> DataFrame:
    """Actions with the law of their function, from a table of one row a function."""
    return actions.join(F.broadcast(laws(actions.sparkSession)), "function_id", "left")


def without_laws(actions: DataFrame) -> DataFrame:
    return actions.drop(*laws(actions.sparkSession).columns[1:])


def resolve(actions: DataFrame) -> DataFrame:
    """Old short names replaced by function ids, with the function's number, plugin and whether it takes a band."""
    spark = actions.sparkSession
    named = actions.join(F.broadcast(catalog.aliases(spark).withColumnRenamed("function_id", "_full")), actions["function_id"] == F.col("alias"), "left")
    named = named.withColumn("function_id", F.coalesce("_full", "function_id")).drop("_full", "alias")
    return named.join(F.broadcast(catalog.functions(spark)), "function_id", "left")


def parameter_problems(given: DataFrame) -> DataFrame:
    """given(function_id, parameter, raw text) with the first thing wrong with each (empty: nothing): type, choice, range."""
    spec = catalog.parameters(given.sparkSession).select(F.col("function_id").alias("_f"), F.col("parameter").alias("_p"), "type", "least", "most", "choices")
    raw, number = F.col("raw"), F.col("raw").try_cast("double")
    wrong = (
        F.when(F.col("_p").isNull(), "unknown parameter")
        .when((F.col("type") == "bool") & ~raw.isin("true", "false"), "not bool")
        .when((F.col("type") == "int") & ~raw.rlike("^[+-]?[0-9]+$"), "not int")
        .when((F.col("type") == "float") & (number.isNull() | F.isnan(number)), "not float")
        .when((F.size("choices") > 0) & ~F.array_contains("choices", raw), "no choice")
        .when(number < F.col("least"), "too low")
        .when(number > F.col("most"), "too high")
        .otherwise("")
    )
    joined = given.join(F.broadcast(spec), (F.col("function_id") == F.col("_f")) & (F.col("parameter") == F.col("_p")), "left")
    return joined.withColumn("problem", F.when(raw.isNull(), "missing").otherwise(wrong)).drop("_f", "_p", "type", "least", "most", "choices")


def of(name: str | Column, default: float | Column = 0.0) -> Column:
    return F.coalesce(F.col("params")[name], default if isinstance(default, Column) else F.lit(default))


def problems(actions: DataFrame) -> DataFrame:
    """Each action with its operation (inferred where none is given) and the first thing wrong with it (empty: nothing).

    Wrong are functions that nobody knows, a missing or an extra band, an operation that the function lacks, and one that
    its parameters contradict.
    """
    known = with_laws(resolve(actions)).withColumns({"_v": F.when(F.col("_signed").isNotNull(), of(F.col("_signed"))), "_w": apart(of("width", 1.0))})
    kind, v, w = F.coalesce("_kind", F.when(F.startswith("function_id", F.lit("audio.repair.")), "attenuate").otherwise("protect")), F.col("_v"), F.col("_w")
    inferred = F.when(kind == "width", F.when(w < 1, "narrow").when(w > 1, "expand").otherwise("neutral")).when(kind == "sign", F.when(v < 0, "cut").when(v > 0, "boost").otherwise("neutral")).otherwise(kind)
    known = known.withColumn("operation", F.coalesce("operation", inferred))
    asked = F.col("operation")
    against = ((asked == "cut") & (v >= 0)) | ((asked == "boost") & (v <= 0)) | ((asked == "neutral") & (F.abs(v) > 1e-9)) | ((asked == "attenuate") & (v > 0))
    stands = (kind == "width") & (((asked == "narrow") & (w >= 1)) | ((asked == "expand") & (w <= 1)) | ((asked == "neutral") & (F.abs(w - 1) > 1e-9)))
    wrong = (
        F.when(F.col("plugin").isNull(), "unknown function").when(F.col("banded") & F.col("target").isNull(), "needs a band")
        .when(F.col("target").isNotNull() & (~F.col("banded") | ~F.col("target").isin(catalog.BANDS)), "takes no such band")
        .when(~F.array_contains("_supported", asked), "unsupported").when(F.coalesce(against, F.lit(False)) | stands, "contradicted").otherwise("")
    )
    return without_laws(known.withColumn("problem", wrong)).drop("_v", "_w")


def plan_problems(actions: DataFrame, analysis: list[str]) -> DataFrame:
    """For each plan: functions that exclude each other, and analysis that a function needs and that is missing."""
    known = resolve(actions)
    per = known.groupBy("plan").agg(F.collect_set("function_id").alias("_ids"), F.array_distinct(F.flatten(F.collect_set("conflicts"))).alias("_against"), F.array_distinct(F.flatten(F.collect_set("needs"))).alias("_needs"))  # one plan's actions
    return per.select("plan", F.array_join(F.sort_array(F.array_intersect("_ids", "_against")), ",").alias("conflicts"), F.array_join(F.sort_array(F.array_except("_needs", F.array(*(F.lit(a) for a in analysis)))), ",").alias("missing"))


def enabled(actions: DataFrame) -> Column:
    """Whether an action is switched on: where there is such a column, unless it says no."""
    return F.coalesce("enabled", F.lit(True)) if "enabled" in actions.columns else F.lit(True)


def contributions(actions: DataFrame) -> DataFrame:
    """What each action adds: tonal_boost, tonal_cut, gain_boost, gain_cut, scope (where its tone counts), bands (an array of boosts).

    An action that is switched off boosts no band; tone and gain are counted of what is asked for.
    """
    pos, vocal = lambda x: F.greatest(x, F.lit(0.0)), F.col("function_id") == "audio.vocal.center_naturalizer"
    told = with_laws(actions).withColumns({
        "_t": F.when(F.col("_tone").isNotNull(), of(F.col("_tone")) * F.col("_tone_sign")), "_g": F.when(F.col("_gain").isNotNull(), of(F.col("_gain"))).otherwise(0.0), "_wide": apart(F.coalesce(F.col("_boost") == "width", F.lit(False))),
        "_mix": F.when(F.col("_wet"), F.least(F.lit(1.0), pos(of("mix")))).otherwise(1.0), "_b": of(F.col("_boost"), F.when(F.col("_boost") == "width", 1.0).otherwise(0.0)),
    })
    size = F.when(F.col("_fall").isNotNull(), F.abs("_b")).otherwise(pos(F.col("_b")))
    made = size * F.col("_mix") * F.col("_factor")
    level = F.when(F.col("_wide"), width_db(size)).when(made > F.col("_most"), F.col("_most")).otherwise(made)
    own = F.when(F.col("target").isin(catalog.BANDS), F.array("target")).otherwise(F.array(*(F.lit(b) for b in catalog.BANDS)))
    told = told.withColumns({"_level": F.coalesce(F.when((level > 1e-9) & enabled(actions), level), F.lit(0.0)), "_at": apart(F.when(F.col("_fall").isNotNull() & (F.col("_b") <= 0), F.col("_fall")).otherwise(F.coalesce("_reach", own)))})
    told = told.withColumns({
        "tonal_boost": F.when(vocal, of("body_gain_db") * of("mix")).otherwise(pos(F.coalesce("_t", F.lit(0.0)))),
        "tonal_cut": F.when(vocal, (of("harshness_reduction_db") + of("air_reduction_db")) * of("mix")).otherwise(pos(-F.coalesce("_t", F.lit(0.0)))),
        "gain_boost": pos(F.col("_g")), "gain_cut": pos(-F.col("_g")),
        "scope": F.when(vocal, "vocal_center").when(F.col("_t").isNotNull(), F.coalesce("target", F.lit("global"))),
        "bands": F.transform(F.array(*(F.lit(b) for b in catalog.BANDS)), lambda b: F.when(F.array_contains("_at", b), F.col("_level")).otherwise(0.0)),
    })
    return without_laws(told).drop("_t", "_g", "_wide", "_mix", "_b", "_level", "_at")


SIDES = ["tonal_boost", "tonal_cut", "gain_boost", "gain_cut"]


def alone_problem(columns: list[str]) -> Column:
    """The governor that a single action offends, the last one if several; the vocal naturalizer has no limit of its own.

    Where the actions have evidence, boosts, cuts and gains need a measured reason above 0.
    """
    free = F.col("function_id") == "audio.vocal.center_naturalizer"
    over = lambda n: (F.col(n) > LIMITS[f"{n}_individual"]) & ~free
    lacks = lambda name: ~F.coalesce(F.col("evidence")[name] > 0, F.lit(False)) if "evidence" in columns else F.lit(False)
    tonal, done = F.col("scope").isNotNull() & ~free, F.coalesce(F.col("operation"), F.lit("")) if "operation" in columns else F.lit("")
    gain = over("gain_cut") | over("gain_boost") | ((F.col("gain_boost") > 0) & lacks("compensation_required_db"))
    tone = over("tonal_cut") | over("tonal_boost") | (tonal & (((done == "boost") & lacks("measured_deficit_db")) | ((done == "cut") & lacks("measured_excess_db"))))
    return F.when(gain, GAIN).when(tone, TONAL)


def budgets(actions: DataFrame) -> DataFrame:
    """For each plan its totals (boosts and cuts are never netted), what is left of each, the governors that it offends, and the outcome.

    Totals add up in the order of the actions.
    """
    parts = contributions(actions)
    parts = parts.withColumn("_alone", alone_problem(parts.columns))
    scopes = parts.where("scope IS NOT NULL").groupBy("plan", "scope").agg(sum_in_order(F.col("tonal_boost"), "pos").alias("b"), sum_in_order(F.col("tonal_cut"), "pos").alias("c"), F.count("*").alias("n"))
    crowded = scopes.groupBy("plan").agg(F.coalesce(F.bool_or((F.col("n") > 1) & ((F.col("b") > LIMITS["tonal_boost_individual"] + 1e-9) | (F.col("c") > LIMITS["tonal_cut_individual"] + 1e-9))), F.lit(False)).alias("_crowded"))
    item = F.struct("pos", *SIDES, "bands")
    per = parts.groupBy("plan").agg(F.count("*").alias("actions"), F.sort_array(F.collect_list(item)).alias("_a"), F.coalesce(F.bool_or(F.col("_alone") == TONAL), F.lit(False)).alias("_tonal"), F.coalesce(F.bool_or(F.col("_alone") == GAIN), F.lit(False)).alias("_gain"))  # one plan's actions
    add = lambda n: F.aggregate("_a", F.lit(0.0), lambda t, x: t + x[n])
    bands = F.aggregate("_a", F.array_repeat(F.lit(0.0), len(catalog.BANDS)), lambda t, x: F.zip_with(t, x["bands"], lambda p, q: p + q))
    per = per.withColumns({f"_{n}_raw": add(n) for n in SIDES} | {"_band": F.array_max(bands)})
    over = lambda n: F.col(f"_{n}_raw") > LIMITS[f"{n}_total"] + 1e-9
    found = [
        F.when(F.col("_tonal") | over("tonal_boost") | over("tonal_cut"), TONAL), F.when(F.col("_gain") | over("gain_boost") | over("gain_cut"), GAIN),
        F.when(F.coalesce("_crowded", F.lit(False)), OVERLAP), F.when(F.col("_band") >= rounds_above(LIMITS["band_boost"], 3), HEADROOM),
    ]
    left = {f"{n}_left": half_even(F.greatest(LIMITS[f"{n}_total"] - F.col(f"_{n}_raw"), F.lit(0.0)), 3) for n in SIDES}
    joined = per.join(crowded, "plan", "left").withColumn("offended", F.array_join(F.array_compact(F.array(*found)), ","))
    return joined.select("plan", "actions", *(half_even(F.col(f"_{n}_raw"), 3).alias(n) for n in SIDES), *(c.alias(n) for n, c in left.items()), "offended", F.when(F.col("offended") == "", "passed").otherwise("rejected").alias("status"))


def headroom(actions: DataFrame) -> DataFrame:
    """The band in which a plan boosts most, counting boosts alone, in the order of the actions; the first band on a tie."""
    listed = contributions(actions).groupBy("plan").agg(F.sort_array(F.collect_list(F.struct("pos", "bands"))).alias("_a"))  # one plan's actions
    sums = F.aggregate("_a", F.array_repeat(F.lit(0.0), len(catalog.BANDS)), lambda t, x: F.zip_with(t, x["bands"], lambda p, q: p + q))
    sums = listed.select("plan", F.transform(sums, lambda x: half_even(x, 3)).alias("_s")).withColumn("boost", F.array_max("_s"))
    at = F.array_position("_s", F.col("boost")).cast("int") - 1
    return sums.select("plan", F.get(F.array(*(F.lit(b) for b in catalog.BANDS)), at).alias("band"), "boost", (F.col("boost") > LIMITS["band_boost"] + 1e-9).alias("exceeded"))


def admit(actions: DataFrame, dense: Column | None = None, unproven: Column | None = None) -> DataFrame:
    """Ordered admission: plan, pos, function_id, outcome and the reason of a rejection.

    An action with a problem of its own, one that is switched off, or one without evidence where there is such a column, is
    rejected, a neutral one is traced and costs
    nothing; any other is accepted if the plan so far and it offend no governor and exclude each other in nothing. A
    rejected one leaves the plan as it was; of several reasons the last one counts. dense: whether the plan's material is
    compressed already. unproven: what an action's evidence lacks (``evidence.proven``), null if nothing. A fold over each
    plan's actions in order; its state is what the accepted ones add up to. Only the scope of an action's own tone can
    become crowded by it.
    """
    known = contributions(problems(actions))
    known = known.withColumns({"_alone": alone_problem(known.columns), "_on": enabled(known)})
    count = len(catalog.BANDS)
    once = lambda f: F.col("function_id") == f
    exclusive = ("audio.saturation.softclip", "audio.saturation.exciter")
    heavy = F.coalesce(dense if dense is not None else F.lit(False), F.lit(False)) & F.col("function_id").isin(DENSITY)
    wide = (F.col("function_id") == "audio.multiband.stereo_width") & (F.col("target") == "sub_bass") & (of("width", 1.0) > 1)
    bare = F.coalesce(F.size("evidence"), F.lit(0)) <= 0 if "evidence" in known.columns else F.lit(False)
    blocked = F.when(bare, "no evidence").when(F.col("problem") != "", F.col("problem")).when(~F.col("_on"), "switched off")
    late = F.coalesce(unproven if unproven is not None else F.lit(None).cast("string"), F.when(heavy, "dense material"), F.when(F.coalesce(wide, F.lit(False)), "wide sub bass"))
    scopes = F.array(*(F.lit(x) for x in SCOPES))
    item = F.struct(
        "pos", "function_id", (F.col("operation") == "neutral").alias("neutral"), F.coalesce(blocked, F.when(F.col("operation") != "neutral", late)).alias("blocked"), F.col("_alone").alias("alone"),
        F.array(*(F.col(x) for x in SIDES)).alias("sides"), (F.array_position(scopes, F.col("scope")) - 1).cast("int").alias("scope"), "tonal_boost", "tonal_cut", "bands", *(once(f).alias(f"x{i}") for i, f in enumerate(exclusive)),
    )
    zeros, m = lambda n: F.array_repeat(F.lit(0.0), n), len(SCOPES)
    out = F.array().cast("array<struct<pos:bigint,function_id:string,outcome:string,reason:string>>")
    start = F.struct(zeros(len(SIDES)).alias("sides"), zeros(3 * m).alias("tone"), zeros(count).alias("bands"), F.lit(False).alias("x0"), F.lit(False).alias("x1"), out.alias("out"))
    over = lambda t, i: F.get(t, F.lit(i)) > LIMITS[f"{SIDES[i]}_total"] + 1e-9

    def step(a: Column, x: Column) -> Column:
        plus = lambda p, q: F.zip_with(p, q, lambda u, v: u + v)
        at = lambda k: F.get(a["tone"], x["scope"] + k * m)  # noqa: E731  boosts, cuts and actions of the scope so far

        def told(v: Column) -> Column:
            """v: sides and bands with this action."""
            crowded = (at(2) > 0) & ((at(0) + x["tonal_boost"] > LIMITS["tonal_boost_individual"] + 1e-9) | (at(1) + x["tonal_cut"] > LIMITS["tonal_cut_individual"] + 1e-9))
            why = (
                F.when((a["x0"] | x["x0"]) & (a["x1"] | x["x1"]), "conflict").when(F.array_max(v["bands"]) >= rounds_above(LIMITS["band_boost"], 3), HEADROOM).when(over(v["sides"], 2) | over(v["sides"], 3), GAIN)
                .when(over(v["sides"], 0) | over(v["sides"], 1), TONAL).when(crowded, OVERLAP).otherwise(x["alone"])
            )
            reason = F.when(x["blocked"].isNotNull(), x["blocked"]).when(~x["neutral"], why)
            outcome = lambda r: F.when(r.isNotNull(), "rejected").when(x["neutral"], "neutral").otherwise("accepted")
            return let(reason, lambda r: F.struct(v["sides"].alias("sides"), v["bands"].alias("bands"), outcome(r).alias("outcome"), r.alias("reason")))

        def taken(t: Column) -> Column:
            row = F.struct(x["pos"].cast("bigint").alias("pos"), x["function_id"].alias("function_id"), t["outcome"].alias("outcome"), t["reason"].alias("reason"))
            yes = t["outcome"] == "accepted"
            add = lambda v, i: v + F.when(i == x["scope"], x["tonal_boost"]).when(i == x["scope"] + m, x["tonal_cut"]).when(i == x["scope"] + 2 * m, 1.0).otherwise(0.0)
            tone = F.when(yes & x["scope"].isNotNull(), F.transform(a["tone"], add)).otherwise(a["tone"])
            return F.struct(
                F.when(yes, t["sides"]).otherwise(a["sides"]).alias("sides"), tone.alias("tone"), F.when(yes, t["bands"]).otherwise(a["bands"]).alias("bands"),
                (a["x0"] | (yes & x["x0"])).alias("x0"), (a["x1"] | (yes & x["x1"])).alias("x1"), F.concat(a["out"], F.array(row)).alias("out"),
            )

        added = F.struct(plus(a["sides"], x["sides"]).alias("sides"), plus(a["bands"], x["bands"]).alias("bands"))
        return let(let(added, told), taken)

    folded = known.groupBy("plan").agg(F.aggregate(F.sort_array(F.collect_list(item)), start, step).alias("s"))  # one plan's actions
    return folded.select("plan", F.explode("s.out").alias("o")).select("plan", "o.*")


def guardrails(actions: DataFrame, target: float, ceiling: float) -> DataFrame:
    """Plans that end in loudness and limiter whatever they asked for: targets overwritten, ceilings lowered, missing ones added.

    Adds ``injected`` and ``step``, the order of execution.
    """
    plans = actions.select("plan").distinct()
    needed = {"audio.loudness.normalize": {"target_lufs": target, "true_peak_db": ceiling, "lra": 11.0}, "audio.limiter.true_peak": {"ceiling_db": ceiling, "release_ms": 150.0, "lookahead_ms": 5.0}}
    literal = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))
    wanted = plans.select("plan", F.explode(F.array(*(F.struct(F.lit(f).alias("function_id"), literal(p).alias("params")) for f, p in needed.items()))).alias("x")).select("plan", "x.*")
    tail = actions.where(F.col("function_id").isin(list(needed)))
    first = tail.groupBy("plan", "function_id").agg(F.min_by(F.struct("pos", "params"), "pos").alias("own"))
    over = F.when(F.col("function_id") == "audio.loudness.normalize", F.map_concat(F.map_filter("own.params", lambda k, v: ~k.isin("target_lufs", "true_peak_db")), literal({"target_lufs": target, "true_peak_db": ceiling})))
    least = F.map_concat(F.map_filter("own.params", lambda k, v: k != "ceiling_db"), F.create_map(F.lit("ceiling_db"), F.least(F.coalesce(F.col("own.params")["ceiling_db"], F.lit(ceiling)), F.lit(ceiling))))
    last = wanted.join(first, ["plan", "function_id"], "left").select(
        "plan", F.col("own.pos").alias("pos"), "function_id", F.lit(None).cast("string").alias("target"), F.when(F.col("own").isNull(), F.col("params")).otherwise(F.coalesce(over, least)).alias("params"), F.col("own").isNull().alias("injected")
    )
    rest = actions.where(~F.col("function_id").isin(list(needed))).select("plan", "pos", "function_id", "target", "params", F.lit(False).alias("injected"))
    return effective_order(rest.unionByName(last))


def classic(tracks: DataFrame, key: str) -> DataFrame:
    """The plan that is made without any advice: actions by rules on tracks(key, lufs, voice, high_mid, air)."""
    c, action = F.col, lambda f, t, op, name, v: F.struct(F.lit(f).alias("function_id"), F.lit(t).cast("string").alias("target"), F.lit(op).alias("operation"), F.lit(name).alias("parameter"), v.cast("double").alias("value"))
    # Widths of the bands.
    widths = [("sub_bass", 0.0), ("bass", 0.4), ("low_mid", 0.7), ("high_mid", 1.15), ("air", 1.25)]
    rows = [
        action("audio.autogain.headroom", None, "protect", "gain_db", F.when(F.coalesce("lufs", F.lit(-24.0)) < -25, -12.0).otherwise(-17.0)),
        F.when(c("voice") > -30, action("audio.deesser.sibilance_reduction", None, "attenuate", "intensity", F.lit(0.4))),
        F.when(c("high_mid") > -22, action("audio.multiband.eq", "high_mid", "cut", "gain_db", F.lit(-0.8))),
        F.when(c("air") > -24, action("audio.multiband.eq", "air", "cut", "gain_db", F.lit(-1.0))),
        *(action("audio.multiband.stereo_width", b, "narrow" if w < 1 else "expand", "width", F.lit(w)) for b, w in widths),
    ]
    listed = tracks.select(key, F.posexplode(F.array_compact(F.array(*rows))).alias("pos", "x"))
    return listed.select(key, F.col("pos").cast("bigint").alias("pos"), "x.*")


def audit(renders: DataFrame, operations: DataFrame, loudness_off: float = 0.3, peak_off: float = 0.2) -> DataFrame:
    """Renders(plan, lufs, peak, target, ceiling) against their targets, with how many of operations(plan, operation) did what."""
    counts = operations.groupBy("plan").agg(*(F.count_if(F.col("operation") == o).alias(o) for o in OPERATIONS))
    error, over = F.col("lufs") - F.col("target"), F.col("peak") - F.col("ceiling")
    checked = renders.withColumns({
        "error_lu": half_even(error, 3), "overshoot_db": half_even(over, 3),
        "loud_enough": F.coalesce(F.abs(error) <= loudness_off, F.lit(False)), "below_ceiling": F.coalesce(over <= peak_off, F.lit(False)),
    })
    joined = checked.join(counts, "plan", "left").withColumns({o: F.coalesce(o, F.lit(0)) for o in OPERATIONS})
    return joined.withColumn("status", F.when(F.col("loud_enough") & F.col("below_ceiling"), "passed").otherwise("warning"))


def migrated(settings: DataFrame) -> DataFrame:
    """Old settings(track, name, band, value) as actions: known names and bands with an effect, in the order of the old groups."""
    # Fixed values: (old name, function, parameter, value that does nothing, group).
    rules = [
        ("noise_reduction_level", "audio.repair.denoise", "level", 0.0, 0), ("declip_level", "audio.repair.declip", "level", 0.0, 0), ("declick_level", "audio.repair.declick", "level", 0.0, 0),
        ("deesser_intensity", "audio.deesser.sibilance_reduction", "intensity", 0.0, 1), ("band_adjust_db", "audio.tone_eq.band", "gain_db", 0.0, 2), ("tone_tilt_db", "audio.tone_eq.tilt", "gain_db", 0.0, 2),
        ("band_widths", "audio.multiband.stereo_width", "width", 1.0, 3), ("saturation_drive_db", "audio.saturation.softclip", "drive_db", 0.0, 4), ("glue_ratio", "audio.glue.bus_compressor", "ratio", 1.0, 5),
    ]
    spark = settings.sparkSession
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "no int, name string, function_id string, parameter string, neutral double, stage int")
    bands = spark.createDataFrame([(i, b, x) for i, b in enumerate(catalog.BANDS) for x in (b, BAND_LABELS[b])], "band_no int, target string, band string")
    known = settings.join(F.broadcast(table), "name").join(F.broadcast(bands), "band", "left").where((F.abs(F.col("value") - F.col("neutral")) > 1e-9) & (F.col("band").isNull() | F.col("target").isNotNull()))
    by = Window.partitionBy("track").orderBy("stage", "no", F.coalesce("band_no", F.lit(-1)), "band")
    return known.select("track", F.row_number().over(by).cast("bigint").alias("pos"), "function_id", "target", "parameter", "value")


def adjustments(actions: DataFrame) -> DataFrame:
    """A plan's actions as settings: gains and widths by band, and the intensity of the de-esser, the last action of a kind counting."""
    pick = lambda f, p: F.map_from_entries(F.sort_array(F.collect_list(F.when((F.col("function_id") == f) & F.col("target").isNotNull(), F.struct("target", F.col("last")[p].alias("value"))))))
    last = actions.groupBy("plan", "function_id", "target").agg(F.max_by("params", "pos").alias("last"))  # one row a kind
    return last.groupBy("plan").agg(pick("audio.multiband.eq", "gain_db").alias("gains"), pick("audio.multiband.stereo_width", "width").alias("widths"), F.max(F.when(F.col("function_id") == "audio.deesser.sibilance_reduction", F.col("last")["intensity"])).alias("deesser"))


def adjusted(base: dict[str, Column], change: dict[str, Column]) -> dict[str, Column]:
    """Base settings with multipliers and offsets applied; the de-esser stays within its range."""
    one = lambda n: F.coalesce(change[n], F.lit(1.0))
    return {
        "deesser_intensity": F.greatest(F.lit(0.2), F.least(F.lit(1.0), base["deesser_intensity"] * one("deesser_intensity_mult"))), "saturation_drive": base["saturation_drive"] * one("saturation_drive_mult"),
        "saturation_mix": base["saturation_mix"] * one("saturation_mix_mult"), "glue_threshold": base["glue_threshold"] + F.coalesce(change["glue_threshold_offset"], F.lit(0.0)), "glue_ratio": base["glue_ratio"] * one("glue_ratio_mult"),
    }


def deesser_intensity(noise: Column, click: Column, base: float = 1.0, budget: float = 2.5) -> Column:
    """The de-esser's intensity, less what the other reductions use of a budget in dB."""
    # What the levels of noise reduction and of click removal use.
    uses = {"noise": {"off": 0.0, "apagado": 0.0, "leve": 0.6, "medio": 1.2, "alto": 1.8}, "click": {"off": 0.0, "apagado": 0.0, "leve": 0.9, "medio": 1.5, "alto": 2.1}}
    used = lambda level, of: F.coalesce(F.create_map(*(F.lit(x) for kv in uses[of].items() for x in kv))[F.lower(F.trim(level))], F.lit(uses[of]["leve"]))
    left = F.greatest(budget - used(noise, "noise") - used(click, "click"), F.lit(0.0))
    return F.greatest(F.lit(0.2), F.least(F.lit(1.0), left / budget * base))


def effective_order(actions: DataFrame) -> DataFrame:
    """The order of execution: as given, the loudness stage and then the limiter at the end."""
    stage = F.coalesce(F.create_map(*(F.lit(x) for kv in TAIL.items() for x in kv))[F.col("function_id")], F.lit(0))
    return actions.withColumn("step", F.row_number().over(Window.partitionBy("plan").orderBy(stage, "pos")))


def plugin_order(moves: DataFrame) -> DataFrame:
    """The order of plugins by plan after moves(plan, pos, plugin, place), each putting a plugin at a place, in turn; a place of -1 turns it off."""
    spark = moves.sparkSession
    start = F.array(*(F.lit(p) for p in catalog.PLUGINS))

    def step(order: Column, m: Column) -> Column:
        rest = F.array_remove(order, m["plugin"])
        at = F.least(m["place"], F.size(rest))
        return F.when(m["place"] < 0, rest).otherwise(F.concat(F.slice(rest, F.lit(1), at), F.array(m["plugin"]), F.slice(rest, at + 1, F.size(rest))))

    known = moves.join(F.broadcast(catalog.plugins(spark).select(F.col("plugin").alias("_p"))), F.col("plugin") == F.col("_p"))
    folded = known.groupBy("plan").agg(F.aggregate(F.sort_array(F.collect_list(F.struct("pos", "plugin", "place"))), start, step).alias("order"))  # one plan's moves
    return folded


def graph(actions: DataFrame) -> DataFrame:
    """A plan as one chain of stages: neighbouring actions of a plugin that shares its stage are one stage.

    Labels are the plugin and its ordinal among the plan's stages of that plugin. Actions that are switched off are left
    out; one of them between two others parts their stage.
    """
    known = resolve(actions).withColumn("_on", enabled(actions))
    by = Window.partitionBy("plan").orderBy("pos")
    fresh = ~F.coalesce((F.col("plugin") == SHARED_STAGE) & (F.lag("plugin").over(by) == F.col("plugin")) & F.lag("_on").over(by), F.lit(False))
    rows = known.withColumn("_fresh", fresh.cast("int")).withColumn("stage", F.sum("_fresh").over(by)).where("_on")
    stages = rows.groupBy("plan", "stage").agg(F.first("plugin").alias("plugin"), F.count("*").alias("n"))
    label = F.concat_ws("_", F.replace("plugin", F.lit("audio."), F.lit("")), F.row_number().over(Window.partitionBy("plan", "plugin").orderBy("stage")))
    node = F.struct("stage", F.concat(F.lit("["), label, F.lit(":"), F.col("n").cast("string"), F.lit("]")).alias("t"))
    listed = stages.withColumn("_node", node).groupBy("plan").agg(F.sort_array(F.collect_list("_node")).alias("_nodes"))  # one plan's stages
    return listed.select("plan", F.size("_nodes").cast("long").alias("stages"), F.array_join(F.transform("_nodes", lambda x: x["t"]), ";").alias("graph"))


def compiled(actions: DataFrame) -> DataFrame:
    """For each plan its graph, or why there is none: the first action that is not valid, functions that exclude each other, or a
    band that is boosted beyond its headroom (as ``headroom`` has it)."""
    checked = problems(actions)
    first = checked.where("problem <> ''").groupBy("plan").agg(F.min_by(F.struct("pos", "problem"), "pos").alias("_p")).select(F.col("plan").alias("_a"), F.col("_p.problem").alias("_problem"))
    against = plan_problems(actions, []).select(F.col("plan").alias("_b"), F.col("conflicts").alias("_conflicts"))
    room = headroom(resolve(actions).drop("no", "plugin", "banded", "needs", "conflicts")).select(F.col("plan").alias("_c"), "band", "boost", "exceeded")
    made = graph(actions).select(F.col("plan").alias("_d"), "stages", "graph")
    plans = room.join(first, F.col("_c") == F.col("_a"), "left").join(against, F.col("_c") == F.col("_b"), "left").join(made, F.col("_c") == F.col("_d"), "left")
    why = F.when(F.col("_problem").isNotNull(), F.col("_problem")).when(F.coalesce("_conflicts", F.lit("")) != "", F.concat(F.lit("conflict: "), F.col("_conflicts"))).when(F.col("exceeded"), F.concat(F.lit(f"{HEADROOM}: "), F.col("band"), F.format_string("=%.2fdB", half_even(F.col("boost"), 2))))
    return plans.select(F.col("_c").alias("plan"), why.alias("error"), F.when(why.isNull(), F.coalesce("stages", F.lit(0))).alias("stages"), F.when(why.isNull(), F.coalesce("graph", F.lit(""))).alias("graph"))


def fingerprint(actions: DataFrame) -> DataFrame:
    """SHA-256 of each plan's actions, written out in order in one form."""
    numbers = F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))), ",")
    text = F.concat_ws("|", "function_id", F.coalesce("target", F.lit("-")), numbers)
    listed = actions.groupBy("plan").agg(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))).alias("_a"))  # one plan's actions
    return listed.select("plan", F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform("_a", lambda x: x["t"]), ";"), 256)).alias("fingerprint"))
