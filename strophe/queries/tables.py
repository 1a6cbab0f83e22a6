"""Roll-ups, ratings, gates and joins over the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import batch, decisions, joins, quality
from ..plans import actions, catalog
from ..sources import records


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark, sf_dir):
    """One track for each supplier, with features taken from its lines."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.max("l_extendedprice").alias("hi"), F.min("l_discount").alias("d0"), F.max("l_discount").alias("d1"), F.max("l_tax").alias("t1"), F.count_if(F.col("l_quantity") >= 45).alias("clips"), F.min("l_quantity").alias("q0"), F.max("l_linenumber").alias("ln")
    )
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = F.col("n")
    return li.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_suppkey", "s_nationkey", (F.col("hi") / 1000 - 100).alias("band_db"), (-100 * F.col("d1")).alias("voice"), (F.col("clips") > 60).alias("clipped"), "clips", F.when(n % 11 > 0, -30 - F.col("q0") - n % 20).alias("noise_db"), (F.col("ln") < 7).alias("mono"),
        (n % 50).cast("double").alias("width"), (-10 * F.col("t1")).alias("peak"), (-10.0 - n % 80).alias("lufs"), (n % 17).cast("double").alias("lra"), (n % 13).cast("double").alias("crest"), (F.col("d0") - F.col("t1")).alias("dc"), (60.0 + n % 120).alias("bpm"),
    )


def batch_merge(spark, sf_dir):
    return batch.merge(tracks(spark, sf_dir), "s_nationkey")


def batch_summary(spark, sf_dir):
    t = tracks(spark, sf_dir).withColumn("noise", batch.noise_category(F.col("noise_db")))
    rank = sum((F.when(F.col("noise") == c, i).otherwise(0) for i, c in enumerate(batch.NOISE[:-1])), F.lit(0))
    known = F.when(F.col("noise") != "Unknown", rank)
    return t.groupBy("s_nationkey").agg(F.count("*").alias("tracks"), F.count_if("clipped").alias("clipped"), F.count_if("mono").alias("mono"), F.count_if(F.col("voice") > -10).alias("vocals"), F.round(F.avg(F.coalesce("lra", F.lit(0.0))), 4).alias("lra_avg"), F.round(F.avg(F.coalesce("lufs", F.lit(0.0))), 4).alias("lufs_avg"), F.round(F.avg(F.coalesce("peak", F.lit(0.0))), 4).alias("peak_avg"), F.round(F.avg("width"), 4).alias("width_avg"), F.max_by("noise", known).alias("noise_worst"))


def balance_score(spark, sf_dir):
    levels = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.max("l_quantity").alias("level"))
    return batch.balance(levels, "l_suppkey", "level")


def customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select("c_custkey", (F.col("c_acctbal") / 1000 - 20).alias("lufs"), (-(key % 40) / 10.0).alias("peak"), ((key % 130) / 10.0).alias("lra"), ((key % 97) / 7.0).alias("crest"), ((key % 90) / 10.0 - 4.5).alias("offset"), F.when(key % 19 > 0, (key % 23).cast("double")).alias("rate"), ((key % 31) / 3.0).alias("units"), ((key % 21) / 100.0).alias("drift"), (key % 5 > 0).alias("ready"), ((key % 29) / 10.0).alias("worst_overlap"))


def gated(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", "lufs", F.lit(-15.0).alias("target"), "peak", F.lit(-1.0).alias("ceiling"), "lra", F.col("rate").alias("peak_rate"), F.col("units").alias("high_units"), "drift", "ready", "worst_overlap")


def guard_report(spark, sf_dir):
    return decisions.guard(gated(spark, sf_dir)).select("c_custkey", "blockers", "warnings", "ok")


def guard_report_lax(spark, sf_dir):
    return decisions.guard(gated(spark, sf_dir), strict=False).select("c_custkey", "blockers", "warnings", "ok")


def validation_status(spark, sf_dir):
    return decisions.validate(gated(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


def canary_bucket(digest):
    def run(spark, sf_dir):
        return table(spark, sf_dir, "orders").select("o_orderkey", numeric.bucket_percent(F.col("o_orderkey").cast("string"), digest).alias("bucket"))

    return run


def rolled(spark, sf_dir):
    items = decisions.guard(gated(spark, sf_dir)).select(F.concat(F.lit("/in/"), F.col("c_custkey").cast("string"), F.lit(".wav")).alias("path"), F.lit(True).alias("enabled"), F.col("ok").alias("guard_ok"), "ready", F.when(F.col("c_custkey") % 3 > 0, "adaptive").otherwise("shadow").alias("mode"))
    return decisions.rollout(items, "path", 35)


def rollout_items(spark, sf_dir):
    return rolled(spark, sf_dir).select("path", "in_canary", "apply")


def rollout_report(spark, sf_dir):
    return decisions.rollout_report(rolled(spark, sf_dir))


def ab_integrity(spark, sf_dir):
    full = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") / 100000).alias("b"), (F.col("l_extendedprice") / 100000 * (1 - F.col("l_discount"))).alias("p"))
    return quality.integrity(full, ["l_returnflag", "l_linestatus"], "b", "p")


def before_after_delta(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return quality.before_after(o, "o_orderpriority", (F.col("o_orderkey") % 2).cast("int"), "o_totalprice")


def gain_reduction(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 100 - 20).alias("level"))
    total = batch.gain_reduction(F.col("level"), -18.0, 1.4) + batch.gain_reduction(F.col("level"), -8.0, 4.0)
    return p.select("p_partkey", F.round(total, 4).alias("total")).withColumn("label", batch.reduction_label(F.col("total")))


def stats_clean(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 7 == 0, F.lit("-inf")).when(k % 7 == 1, F.lit("inf")).when(k % 7 == 2, F.lit("nan")).when(k % 7 == 3, F.lit(None).cast("string")).when(k % 7 == 4, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    x = F.when(raw.isin("inf", "-inf"), F.when(raw == "inf", float("inf")).otherwise(float("-inf"))).when(raw == "nan", float("nan")).otherwise(raw.try_cast("double"))
    keys = ["input_i", "input_tp", "input_lra", "input_thresh", "target_offset"]
    return table(spark, sf_dir, "customer").select("c_custkey", *(numeric.clean_loudness(x, n, numeric.clean_loudness(F.col("c_acctbal") / 100, "input_i")).alias(n) for n in keys), numeric.number(raw, -100.0).alias("number"))


def resume_pending(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.pending(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), done, "o_orderkey")


def cache_misses(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").select(F.md5(F.concat_ws("|", F.col("p_size").cast("string"), "p_name")).alias("content_key"), "p_partkey")
    held = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.md5(F.concat_ws("|", F.col("p_size").cast("string"), "p_name")).alias("content_key"), (F.col("p_partkey") % 2 == 0).alias("valid"))
    return joins.pending(wanted, held.where("valid"), "content_key")


def file_dedup_last_wins(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    return joins.last_wins(c, ["conv_id", "role"], [F.desc("turn")])


def tolerance_join(spark, sf_dir):
    """Each order's first part (by key) of its class whose price lies within a ten-thousandth, or a cent, of a hundredth of its total."""
    want = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("cls"), (F.col("o_totalprice") / 100).alias("x"))
    have = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 5).alias("cls"), F.col("p_retailprice").alias("y"))
    return joins.nearest_within(want, have, ["cls"], "x", "y", "p_partkey", F.greatest(F.lit(0.01), F.col("x") * 0.0001), 1.0).select("o_orderkey", "p_partkey", "x", "y")


def artifact_join(spark, sf_dir):
    """Orders with their lines' totals and their customer's balance side by side; what is missing has a default."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 48").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    flags = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_tax").alias("worst"))
    out = joins.outer_by_key(["o_orderkey"], o, lines, flags)
    return out.select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("worst", F.lit(-1.0)).alias("worst"))


def stage_timings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return c.withColumn("avg_chars", F.round(F.col("chars") / F.col("turns"), 4))


def log_scrape(spark, sf_dir):
    """Figures from logs made from orders: levels, volumes, closing lines and the last measured block."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = F.floor(F.col("o_totalprice")).cast("long").cast("string")
    parts = [
        F.when(k % 3 > 0, F.concat(F.lit("Overall.RMS level dB: -"), price)), F.when(k % 5 > 0, F.concat(F.lit("RMS_level = -"), k.cast("string"), F.lit(".5"))), F.when(k % 7 > 0, F.lit("Overall.RMS level dB: -inf")), F.when(k % 2 == 0, F.concat(F.lit("mean_volume: -"), k.cast("string"), F.lit(" dB"))),
        F.concat(F.lit("Output integrated:  -"), price, F.lit(".25 LUFS")), F.when(k % 11 == 0, F.lit("Output LRA: nan LU")), F.when(k % 6 > 0, F.concat(F.lit("out_time_us=7\nout_time_us="), (k * 1500).cast("string"))), F.lit('{ "input_i": "x" }'), F.when(k % 4 == 0, F.concat(F.lit('{\n"input_i" : "-'), price, F.lit('", "input_tp": "1"}'))),
    ]
    log = F.concat_ws("\n", *parts)
    lines = records.loudness_lines(F.col("log"))
    return o.select("o_orderkey", log.alias("log")).select("o_orderkey", records.rms_level(F.col("log")).alias("rms"), records.volume(F.col("log"), "mean").alias("mean_volume"), lines["input_i"].alias("input_i"), F.isnan(lines["input_lra"]).alias("lra_nan"), records.loudness_block(F.col("log"))["input_i"].alias("block"), records.out_time(F.col("log")).alias("out_time"))


def audited_logs(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    logs = o.select("o_orderkey", (k % 3 > 0).alias("used_ai_strategy"), F.when(k % 4 > 0, "applied").otherwise("failed").alias("status"))
    audits = o.where("o_orderkey % 5 > 0").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, "passed").otherwise("warning").alias("status"))
    return joins.audited(logs, audits, "o_orderkey").select("o_orderkey")


def fade_overrides(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    own = c.where("c_custkey % 4 = 0").select("c_custkey", (k % 10 / 4).alias("fade_in"), F.when(k % 8 == 0, k % 7 / 2).alias("fade_out"))
    return joins.with_overrides(c.select("c_custkey"), own, "c_custkey", {"fade_in": 0.0, "fade_out": 1.5})


def united_keys(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    bands = F.array(*(F.lit(b) for b in ("sub_bass", "bass", "low_mid", "mid", "high_mid", "air")))
    some = lambda n: F.map_from_entries(F.filter(F.transform(bands, lambda b, i: F.struct(b.alias("key"), i.alias("value"))), lambda e: (k + e["value"]) % n == 0))
    return p.select("p_partkey", F.array_join(joins.united_keys(some(3), F.when(k % 5 > 0, some(4))), ",").alias("keys"))


def first_samples(spark, sf_dir):
    return joins.first_of_each(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], 5)


def render_caps(spark, sf_dir):
    """The first 20 lines of a supplier, in order, as a report shows them, and how many it leaves out."""
    li, order = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"]
    first = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order))
    shown = li.select("l_suppkey", *order).withColumn("no", first).where("no <= 20").groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("no", F.concat_ws("-", *(F.col(c).cast("string") for c in order)).alias("t")))).alias("s"))  # 20 at most
    counts = li.groupBy(F.col("l_suppkey").alias("_k")).agg(F.count("*").alias("n"))
    return shown.join(counts, F.col("l_suppkey") == F.col("_k")).select("l_suppkey", F.array_join(F.transform("s", lambda x: x["t"]), ",").alias("shown"), F.greatest(F.col("n") - 20, F.lit(0)).alias("more"))


def plugin_order(spark, sf_dir):
    """Moves of plugins: each order's lines, in turn, put one at a place."""
    li = table(spark, sf_dir, "lineitem")
    names = F.array(*(F.lit(p) for p in [*catalog.PLUGINS, "audio.unknown"]))
    pos = F.struct(F.col("l_linenumber").cast("long").alias("line"), "l_partkey", "l_suppkey")
    moves = li.select(F.col("l_orderkey").alias("plan"), pos.alias("pos"), F.get(names, (F.col("l_partkey") % 16).cast("int")).alias("plugin"), (F.col("l_suppkey") % 18 - 1).cast("int").alias("place"))
    return actions.plugin_order(moves).select("plan", F.array_join("order", ",").alias("order"))


TR = """tr AS (SELECT l_suppkey, s_nationkey, hi / 1000 - 100 AS band_db, -100 * d1 AS voice, clips > 60 AS clipped, clips, CASE WHEN n % 11 > 0 THEN -30 - q0 - n % 20 END AS noise_db, ln < 7 AS mono, CAST(n % 50 AS DOUBLE) AS width, -10 * t1 AS peak, -10.0::DOUBLE - n % 80 AS lufs, CAST(n % 17 AS DOUBLE) AS lra,
 CAST(n % 13 AS DOUBLE) AS crest, d0 - t1 AS dc, 60.0::DOUBLE + n % 120 AS bpm FROM (SELECT l_suppkey, count(*) AS n, max(l_extendedprice) AS hi, min(l_discount) AS d0, max(l_discount) AS d1, max(l_tax) AS t1, count(*) FILTER (WHERE l_quantity >= 45) AS clips, min(l_quantity) AS q0, max(l_linenumber) AS ln FROM lineitem GROUP BY l_suppkey) JOIN supplier ON l_suppkey = s_suppkey)"""
_cat = "CASE WHEN noise_db IS NULL THEN 'Unknown' WHEN noise_db <= -60 THEN 'Excellent' WHEN noise_db <= -50 THEN 'Good' WHEN noise_db <= -40 THEN 'Moderate' WHEN noise_db <= -30 THEN 'High' ELSE 'VeryHigh' END"
_rank = "list_position(['Excellent', 'Good', 'Moderate', 'High', 'VeryHigh', 'Unknown'], cat)"
CU = "cu AS (SELECT c_custkey, c_acctbal / 1000 - 20 AS lufs, -(c_custkey % 40) / 10.0::DOUBLE AS peak, (c_custkey % 130) / 10.0::DOUBLE AS lra, (c_custkey % 97) / 7.0::DOUBLE AS crest, (c_custkey % 90) / 10.0::DOUBLE - 4.5::DOUBLE AS off, CASE WHEN c_custkey % 19 > 0 THEN CAST(c_custkey % 23 AS DOUBLE) END AS rate, (c_custkey % 31) / 3.0::DOUBLE AS units, (c_custkey % 21) / 100.0::DOUBLE AS drift, c_custkey % 5 > 0 AS ready, (c_custkey % 29) / 10.0::DOUBLE AS worst FROM customer)"


def _guard(lufs, slack, rate, units, drift) -> str:
    bad = [(f"abs(lufs + 15.0::DOUBLE) > {lufs}::DOUBLE", "lufs"), (f"peak > -1.0::DOUBLE + {slack}::DOUBLE", "true_peak"), (f"rate > {rate}", "peak_rate"), (f"units > {units}", "high_units"), (f"drift > {drift}::DOUBLE", "stereo"), ("NOT ready", "shadow")]
    blockers = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in bad) + ")"
    warnings = "concat_ws(',', " + ", ".join(f"CASE WHEN ({c}) IS NULL THEN '{n}' END" for c, n in bad[:5]) + ")"
    return f"gd AS (SELECT c_custkey, ready, {blockers} AS blockers, {warnings} AS warnings, {blockers} = '' AS ok FROM cu)"


RO = "ro AS (SELECT '/in/' || c_custkey || '.wav' AS path, ok AS guard_ok, ready, ('0x' || substr(md5('/in/' || c_custkey || '.wav'), 1, 8))::BIGINT % 100 < 35 AS in_canary, c_custkey % 3 > 0 AS adaptive FROM gd), ap AS (SELECT *, in_canary AND guard_ok AND ready AND adaptive AS apply FROM ro)"
_clean = lambda key, missing, fallback: f"CASE WHEN x IS NULL THEN ({missing})::DOUBLE WHEN x = '-Infinity'::DOUBLE THEN -70.0::DOUBLE WHEN isnan(x) OR x = 'Infinity'::DOUBLE THEN {fallback}::DOUBLE ELSE x END AS {key}"
QUERIES = {
    "batch_merge": batch_merge, "batch_summary": batch_summary, "balance_score": balance_score, "guard_report": guard_report, "guard_report_lax": guard_report_lax,
    "validation_status": validation_status, "canary_bucket_md5": canary_bucket("md5"), "canary_bucket_sha256": canary_bucket("sha256"), "rollout_items": rollout_items, "rollout_report": rollout_report, "ab_integrity": ab_integrity, "before_after_delta": before_after_delta,
    "gain_reduction": gain_reduction, "stats_clean": stats_clean, "resume_pending": resume_pending, "cache_misses": cache_misses, "file_dedup_last_wins": file_dedup_last_wins, "tolerance_join": tolerance_join, "artifact_join": artifact_join, "stage_timings": stage_timings,
    "log_scrape": log_scrape, "audited_logs": audited_logs, "fade_overrides": fade_overrides, "united_keys": united_keys, "first_samples": first_samples, "render_caps": render_caps, "plugin_order": plugin_order,
}
ORACLES = {
    "batch_merge": f"""WITH {TR}, c AS (SELECT *, {_cat} AS cat FROM tr) SELECT s_nationkey, count(*) AS tracks, round(avg(coalesce(band_db, -100)), 4) AS band_avg, max(voice) AS voice_max, bool_or(clipped) AS any_clipped, CAST(sum(clips) AS BIGINT) AS clips, max(noise_db) AS noise_max, arg_max(cat, {_rank}) AS noise_worst,
 bool_or(mono) AS any_mono, round(avg(width), 4) AS width_avg, max(peak) AS peak_max, max(lufs) FILTER (WHERE lufs > -70) AS lufs_max, min(lra) FILTER (WHERE lufs > -70) AS lra_min, min(crest) FILTER (WHERE lufs > -70) AS crest_min, arg_max(dc, abs(dc)) AS dc_worst, round(median(bpm), 4) AS bpm_median FROM c GROUP BY s_nationkey""",
    "batch_summary": f"WITH {TR}, c AS (SELECT *, {_cat} AS cat FROM tr) SELECT s_nationkey, count(*) AS tracks, count(*) FILTER (WHERE clipped) AS clipped, count(*) FILTER (WHERE mono) AS mono, count(*) FILTER (WHERE voice > -10) AS vocals, round(avg(coalesce(lra, 0)), 4) AS lra_avg, round(avg(coalesce(lufs, 0)), 4) AS lufs_avg, round(avg(coalesce(peak, 0)), 4) AS peak_avg, round(avg(width), 4) AS width_avg, arg_max(cat, {_rank}) FILTER (WHERE cat <> 'Unknown') AS noise_worst FROM c GROUP BY s_nationkey",
    "balance_score": "WITH l AS (SELECT l_suppkey, l_linenumber, max(l_quantity) AS level FROM lineitem GROUP BY ALL) SELECT l_suppkey, round(least(greatest(100 - 10 * stddev_pop(level), 0), 100), 4) AS score, max(level) - min(level) > 10 AS dynamic FROM l GROUP BY l_suppkey",
    "guard_report": f"WITH {CU}, {_guard(0.30, 0.10, 12, 8, 0.08)} SELECT c_custkey, blockers, warnings, ok FROM gd",
    "guard_report_lax": f"WITH {CU}, {_guard(0.45, 0.20, 16, 10, 0.12)} SELECT c_custkey, blockers, warnings, ok FROM gd",
    "validation_status": f"WITH {CU} SELECT CASE WHEN NOT coalesce(abs(lufs + 15.0::DOUBLE) <= 0.30::DOUBLE AND peak <= -1.0::DOUBLE + 0.20::DOUBLE AND lra >= 2, false) THEN 'FAIL' WHEN NOT coalesce(rate <= 12 AND units <= 8 AND worst < 2, false) THEN 'WARN' ELSE 'PASS' END AS status, count(*) AS n FROM cu GROUP BY 1",
    "canary_bucket_md5": "SELECT o_orderkey, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 100 AS INTEGER) AS bucket FROM orders",
    "canary_bucket_sha256": "SELECT o_orderkey, CAST(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 100 AS INTEGER) AS bucket FROM orders",
    "rollout_items": f"WITH {CU}, {_guard(0.30, 0.10, 12, 8, 0.08)}, {RO} SELECT path, in_canary, apply FROM ap",
    "rollout_report": f"WITH {CU}, {_guard(0.30, 0.10, 12, 8, 0.08)}, {RO} SELECT count(*) AS items, count(*) FILTER (WHERE in_canary) AS canary, count(*) FILTER (WHERE apply) AS applied, round(count(*) FILTER (WHERE guard_ok) / count(*), 4) AS guard_rate, round(count(*) FILTER (WHERE ready) / count(*), 4) AS ready_rate, round(count(*) FILTER (WHERE apply) / count(*), 4) AS apply_rate FROM ap",
    "ab_integrity": """WITH x AS (SELECT l_returnflag, l_linestatus, l_extendedprice / 100000 AS b, l_extendedprice / 100000 * (1 - l_discount) AS p FROM lineitem)
 SELECT l_returnflag, l_linestatus, count(*) AS n, round(20 * log10(sqrt(avg(p * p)) / sqrt(avg(b * b))), 4) AS level_delta_db, round(sum(b * p) / sqrt(sum(b * b) * sum(p * p)), 6) AS correlation, round(20 * log10(greatest(1e-12, sqrt(avg((p - b) * (p - b))))), 4) AS delta_rms_db, max(abs(p)) AS peak, count(*) FILTER (WHERE abs(p) >= 0.999999) AS clipped FROM x GROUP BY l_returnflag, l_linestatus""",
    "before_after_delta": """WITH x AS (SELECT o_orderpriority, round(avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0), 2) AS before, round(avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1), 2) AS after FROM orders GROUP BY o_orderpriority)
 SELECT *, CASE WHEN before IS NULL OR after IS NULL THEN 'N/A' ELSE printf('%+.1f', floor((after - before) * 10 + 0.5) / 10) END AS delta FROM x""",
    "gain_reduction": "WITH x AS (SELECT p_partkey, p_retailprice / 100 - 20 AS l FROM part), y AS (SELECT p_partkey, round(greatest(0.0::DOUBLE, (l + 18) * (1 - 1 / 1.4::DOUBLE)) + greatest(0.0::DOUBLE, (l + 8) * (1 - 1 / 4.0::DOUBLE)), 4) AS total FROM x) SELECT *, CASE WHEN total <= 6 THEN 'ok' WHEN total <= 8 THEN 'high' ELSE 'critical' END AS label FROM y",
    "stats_clean": f"""WITH s AS (SELECT c_custkey, c_custkey % 7 AS k, CASE c_custkey % 7 WHEN 0 THEN '-Infinity'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN 'NaN'::DOUBLE WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE c_acctbal END AS x, c_acctbal AS y FROM customer)
 SELECT c_custkey, {_clean('input_i', -23.0, -70.0)}, {_clean('input_tp', -1.0, 0.0)}, {_clean('input_lra', 7.0, 0.0)}, {_clean('input_thresh', 'y / 100 - 10', 0.0)}, {_clean('target_offset', 0.0, 0.0)}, CASE WHEN k <= 4 THEN -100.0::DOUBLE ELSE x END AS number FROM s""",
    "resume_pending": "SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)",
    "cache_misses": "WITH k AS (SELECT md5(p_size || '|' || p_name) AS content_key, p_partkey FROM part) SELECT * FROM k WHERE content_key NOT IN (SELECT content_key FROM k WHERE p_partkey % 6 = 0)",
    "file_dedup_last_wins": "SELECT conv_id, role, turn, CAST(length(text) AS INTEGER) AS n FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1",
    "tolerance_join": "SELECT o_orderkey, p_partkey, o_totalprice / 100 AS x, p_retailprice AS y FROM orders JOIN part ON o_orderkey % 5 = p_partkey % 5 AND abs(o_totalprice / 100 - p_retailprice) <= greatest(0.01::DOUBLE, o_totalprice / 100 * 0.0001::DOUBLE) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY p_partkey) = 1",
    "artifact_join": "SELECT o_orderkey, coalesce(lines, 0) AS lines, coalesce(worst, -1.0::DOUBLE) AS worst FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS lines FROM lineitem WHERE l_quantity > 48 GROUP BY 1) a ON a.k = o_orderkey LEFT JOIN (SELECT l_orderkey AS k, max(l_tax) AS worst FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) b ON b.k = o_orderkey",
    "stage_timings": "SELECT role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(length(text)) / count(*), 4) AS avg_chars FROM conversations GROUP BY role",
    "log_scrape": """WITH l AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)
 SELECT k AS o_orderkey, CASE WHEN k % 3 > 0 THEN -p::DOUBLE WHEN k % 5 > 0 THEN -(k + 0.5e0) END AS rms, CASE WHEN k % 2 = 0 THEN -k::DOUBLE END AS mean_volume, -(p + 0.25e0) AS input_i, k % 11 = 0 AS lra_nan, CASE WHEN k % 4 = 0 THEN '-' || p ELSE 'x' END AS block, CASE WHEN k % 6 > 0 THEN k * 1500 / 1e6 END AS out_time FROM l""",
    "audited_logs": "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 4 > 0 AND (o_orderkey % 5 = 0 OR o_totalprice > 100000)",
    "fade_overrides": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 10 / 4 ELSE 0e0 END AS fade_in, CASE WHEN c_custkey % 8 = 0 THEN c_custkey % 7 / 2 ELSE 1.5e0 END AS fade_out FROM customer",
    "united_keys": "WITH b(i, band) AS (VALUES (0, 'sub_bass'), (1, 'bass'), (2, 'low_mid'), (3, 'mid'), (4, 'high_mid'), (5, 'air')) SELECT p_partkey, coalesce(string_agg(band, ',' ORDER BY band) FILTER (WHERE (p_partkey + i) % 3 = 0 OR (p_partkey % 5 > 0 AND (p_partkey + i) % 4 = 0)), '') AS keys FROM part, b GROUP BY p_partkey",
    "first_samples": "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5",
    "render_caps": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) SELECT l_suppkey, string_agg(l_orderkey || '-' || l_linenumber || '-' || l_partkey, ',' ORDER BY rn) FILTER (WHERE rn <= 20) AS shown, count(*) FILTER (WHERE rn > 20) AS more FROM r GROUP BY l_suppkey",
    "plugin_order": f"""WITH RECURSIVE m AS (SELECT l_orderkey AS plan, list_extract([{', '.join(f"'{p}'" for p in [*catalog.PLUGINS, 'audio.unknown'])}], l_partkey % 16 + 1) AS plugin, l_suppkey % 18 - 1 AS place, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS q FROM lineitem WHERE l_partkey % 16 < 15),
 n AS (SELECT plan, plugin, place, row_number() OVER (PARTITION BY plan ORDER BY q) AS k FROM m),
 w AS (SELECT DISTINCT plan, 0::BIGINT AS k, [{', '.join(f"'{p}'" for p in catalog.PLUGINS)}] AS o FROM n
  UNION ALL SELECT plan, k, CASE WHEN place < 0 THEN rest ELSE rest[1:least(place, len(rest))] || [plugin] || rest[least(place, len(rest)) + 1:] END FROM (SELECT w.plan, n.k, n.plugin, n.place, list_filter(w.o, lambda x: x <> n.plugin) AS rest FROM w JOIN n ON n.plan = w.plan AND n.k = w.k + 1))
 SELECT plan, array_to_string(arg_max(o, k), ',') AS "order" FROM w GROUP BY plan""",
}
