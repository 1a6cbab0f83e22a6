"""Series operators over the event stream: a user is a track, seconds since the start are its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, events, frames, joins, sections

DAY = 86400.0
TYPES = ["click", "view", "purchase", "signup", "error"]
BANDS = {"sub": "click_db", "bass": "view_db", "mid": "purchase_db", "high_mid": "signup_db", "air": "error_db"}
#: Levels of amounts up to 500 lie between 0 and 54 dB.
RULES = events.Rules(peak_high=53.0, peak_medium=50.0, peak_rms=48.0, peak_crest=3.0, harsh_high=40.0, harsh_medium=6.0, weak=(30.0, 36.0), hot=(48.0, 48.0), flat_crest=0.5, flat_rms=44.0)
KINDS = ["peak_risk", "harshness_risk", "low_end_weak", "low_end_hot", "dynamic_flat"]
GAP = 1.6 * DAY


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))") / 1e6
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", t.alias("t"))


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.band_levels(stream(spark, sf_dir), "user_id", "t", "value", "event_type", TYPES, DAY)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.rule_events(banded(spark, sf_dir), "user_id", BANDS, RULES)


def merged_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.merge_by_gap(flagged(spark, sf_dir), ["user_id", "type"], "t", GAP)


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = banded(spark, sf_dir).withColumn("bright", F.round(F.col("signup_db") - F.col("purchase_db"), 4))
    return sections.boundaries(rows, "user_id", 2.8, 128.0, 3)


def cut_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections(cuts(spark, sf_dir), "user_id")


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.compact(cut_sections(spark, sf_dir), "user_id", 5)


def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = compacted(spark, sf_dir).select("user_id", "section", (F.col("first_frame") * DAY).alias("a0"), (F.col("last_frame") * DAY).alias("a1"))
    found = merged_rules(spark, sf_dir).select("user_id", "type", F.col("start_t").alias("b0"), F.col("end_t").alias("b1"))
    return joins.overlaps(parts, found, "user_id", 5 * DAY).groupBy("user_id", "section", "type").agg(F.count("*").alias("n"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = compacted(spark, sf_dir).select("user_id", "section", "label", "confidence", (F.col("first_frame") * DAY).alias("a0"), (F.col("last_frame") * DAY).alias("a1"))
    found = merged_rules(spark, sf_dir).select("user_id", "type", F.col("start_t").alias("b0"), F.col("end_t").alias("b1"))
    rows = joins.overlap_counts(parts, found, "user_id", KINDS).drop("a0", "a1")
    return decisions.decide(rows, KINDS).select("user_id", "section", "label", "confidence", *decisions.FIELDS)


def frame_features(spark, sf_dir):
    return frames.tumbling(stream(spark, sf_dir), "user_id", "t", "value", DAY)


def frame_features_hopping(spark, sf_dir):
    return frames.hopping(stream(spark, sf_dir), "user_id", "t", "value", 2 * DAY, DAY)


def merged_events(spark, sf_dir):
    return events.merge_by_gap(stream(spark, sf_dir), ["user_id", "event_type"], "t", 3 * DAY, "event_id")


def event_type_counts(spark, sf_dir):
    return merged_rules(spark, sf_dir).groupBy("type", "severity").agg(F.count("*").alias("intervals"), F.sum("samples").alias("samples"))


def timeline_summary(spark, sf_dir):
    return frames.summary(frame_features(spark, sf_dir), "user_id")


def timeline_overview(spark, sf_dir):
    return frames.overview(frame_features(spark, sf_dir), merged_rules(spark, sf_dir), compacted(spark, sf_dir), "user_id")


def timeline_with_events(spark, sf_dir):
    return events.with_events(frame_features(spark, sf_dir), flagged(spark, sf_dir), "user_id")


def section_boundaries(spark, sf_dir):
    return cuts(spark, sf_dir).select("user_id", F.size("series").cast("long").alias("frames"), F.array_join(F.transform("cuts", lambda c: c.cast("string")), ",").alias("cuts"))


def shadow_risk(spark, sf_dir):
    return decisions.shadow_risk(decided(spark, sf_dir), "user_id")


def risk_units(spark, sf_dir):
    found = events.merge_by_gap(flagged(spark, sf_dir).where("type = 'peak_risk'").withColumn("confidence", F.col("confidence")), ["user_id", "type"], "t", GAP)
    return decisions.risk_units(found.withColumn("samples", F.col("samples") * 1000), "user_id", 30 * DAY)


def waveform_decimate(spark, sf_dir):
    return frames.decimate(stream(spark, sf_dir), "event_type", ["t", "event_id"], 100).select("event_type", "event_id", "value")


def silence_runs(spark, sf_dir):
    return frames.runs_below(stream(spark, sf_dir), "user_id", ["t", "event_id"], "t", "value", 40.0, 2)


EV = "ev AS (SELECT event_id, user_id, event_type, value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS t FROM events)"


def _level(of: str = "value") -> str:
    rms, peak = f"sqrt(avg({of} * {of}) + 1e-9)", f"(max(abs({of})) + 1e-9)"
    return f"count({of}) AS n, round(20 * log10({rms}), 4) AS rms_db, round(20 * log10({peak}), 4) AS peak_db, round(20 * log10({peak} / {rms}), 4) + 0.0 AS crest_db"


_mean = lambda x: f"floor(CAST(sum(CAST(round({x} * 10000) AS BIGINT)) AS DOUBLE) / count({x}) + 0.5) / 10000.0::DOUBLE"
FR = f"fr AS (SELECT user_id, CAST(floor(t / 86400) AS BIGINT) AS frame, {_level()}, floor(t / 86400) * 86400.0::DOUBLE AS t FROM ev GROUP BY user_id, floor(t / 86400))"
_band = lambda b: f"round(20 * log10(greatest(coalesce(sum(CASE WHEN event_type = '{b}' THEN abs(value) END), 0), 1e-6)), 4) AS {b}_db"
BD = f"bd AS (SELECT user_id, CAST(floor(t / 86400) AS BIGINT) AS frame, {_level()}, {', '.join(_band(b) for b in TYPES)}, floor(t / 86400) * 86400.0::DOUBLE AS t FROM ev GROUP BY user_id, floor(t / 86400))"
FL = """fl AS (
  SELECT user_id, frame, t, 'peak_risk' AS type, CASE WHEN peak_db > 53 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN peak_db > 53 THEN 0.95::DOUBLE ELSE 0.78::DOUBLE END AS confidence
  FROM bd WHERE peak_db > 53 OR (peak_db > 50 AND (rms_db > 48 OR crest_db < 3))
  UNION ALL SELECT user_id, frame, t, 'harshness_risk', CASE WHEN greatest(signup_db - purchase_db, error_db - purchase_db) > 40 THEN 'high' ELSE 'medium' END, CASE WHEN greatest(signup_db - purchase_db, error_db - purchase_db) > 40 THEN 0.85::DOUBLE ELSE 0.70::DOUBLE END
  FROM bd WHERE greatest(signup_db - purchase_db, error_db - purchase_db) > 6
  UNION ALL SELECT user_id, frame, t, CASE WHEN click_db < 30 AND view_db < 36 THEN 'low_end_weak' ELSE 'low_end_hot' END, 'medium', CASE WHEN click_db < 30 AND view_db < 36 THEN 0.72::DOUBLE ELSE 0.74::DOUBLE END
  FROM bd WHERE (click_db < 30 AND view_db < 36) OR (click_db > 48 AND view_db > 48)
  UNION ALL SELECT user_id, frame, t, 'dynamic_flat', 'low', 0.60::DOUBLE FROM bd WHERE crest_db < 0.5 AND rms_db > 44
)"""
MR = """isl AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, type ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id, type ORDER BY t) <= 138240.0 THEN 0 ELSE 1 END AS fresh FROM fl)),
ord AS (SELECT *, row_number() OVER (PARTITION BY user_id, type, island ORDER BY t) AS k FROM isl),
run AS (SELECT user_id, type, island, k, CAST(printf('%.2f', confidence) AS DOUBLE) AS mean FROM ord WHERE k = 1
  UNION ALL SELECT o.user_id, o.type, o.island, o.k, CAST(printf('%.2f', (r.mean * (o.k - 1) + o.confidence) / o.k) AS DOUBLE) FROM run r JOIN ord o ON o.user_id = r.user_id AND o.type = r.type AND o.island = r.island AND o.k = r.k + 1),
mr AS (SELECT i.user_id, i.type, min(t) AS start_t, max(t) AS end_t, count(*) AS samples, CASE max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
  (SELECT arg_max(mean, k) FROM run WHERE run.user_id = i.user_id AND run.type = i.type AND run.island = i.island) AS confidence
  FROM isl i GROUP BY i.user_id, i.type, i.island)"""
SER = """ser AS (SELECT user_id, frame, rms_db AS e, round(signup_db - purchase_db, 4) AS b, row_number() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM bd),
jmp AS (SELECT *, abs(e - lag(e) OVER w) > 2.8 OR abs(b - lag(b) OVER w) > 128 AS jump FROM ser WINDOW w AS (PARTITION BY user_id ORDER BY i)),
walk AS (SELECT user_id, i, 0::BIGINT AS last, true AS cut FROM jmp WHERE i = 0
  UNION ALL SELECT j.user_id, j.i, CASE WHEN j.jump AND j.i - w.last >= 3 THEN j.i ELSE w.last END, j.jump AND j.i - w.last >= 3 FROM walk w JOIN jmp j ON j.user_id = w.user_id AND j.i = w.i + 1),
cut AS (SELECT DISTINCT user_id, i FROM (SELECT user_id, i FROM walk WHERE cut UNION ALL SELECT user_id, n - 1 FROM ser)),
num AS (SELECT user_id, i, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS cuts FROM cut)"""
SEC = f"""mid AS (SELECT user_id, list_sort(list(e))[count(*) // 2 + 1] AS middle, count(*) AS n FROM ser GROUP BY user_id),
span AS (SELECT a.user_id, a.k AS section, a.i AS lo, coalesce(b.i, a.i) AS hi, a.cuts FROM num a LEFT JOIN num b ON b.user_id = a.user_id AND b.k = a.k + 1 WHERE b.i IS NOT NULL OR a.cuts = 1),
st AS (SELECT s.user_id, s.section, s.cuts, s.lo, min(x.frame) AS first_frame, max(x.frame) AS last_frame, count(*) AS n, {_mean('x.e')} AS energy, {_mean('x.b')} AS bright FROM span s JOIN ser x ON x.user_id = s.user_id AND x.i BETWEEN s.lo AND s.hi GROUP BY s.user_id, s.section, s.cuts, s.lo),
lab AS (SELECT st.*, middle, CASE WHEN cuts < 2 THEN 'single' WHEN section = 0 AND energy < middle - 1.5 THEN 'intro' WHEN section = cuts - 2 AND energy < middle - 1.0 THEN 'outro' WHEN energy > middle + 1.8 AND bright > 1.0 THEN 'drop' WHEN energy > middle + 1.8 THEN 'chorus'
  WHEN energy < middle - 1.2 AND lo / greatest(mid.n - 1, 1) > 0.25 AND lo / greatest(mid.n - 1, 1) < 0.85 THEN 'breakdown' WHEN energy < middle - 1.2 THEN 'verse' WHEN bright > 0.8 THEN 'build' ELSE 'verse' END AS label FROM st JOIN mid USING (user_id)),
sec AS (SELECT user_id, CAST(section AS INTEGER) AS section, first_frame, last_frame, CAST(n AS INTEGER) AS n, energy, bright, label, CASE WHEN label IN ('intro', 'outro') THEN 0.78::DOUBLE WHEN label IN ('drop', 'chorus') THEN 0.72::DOUBLE WHEN energy < middle - 1.2 THEN 0.64::DOUBLE ELSE 0.60::DOUBLE END AS confidence FROM lab)"""
CMP = """fold AS (SELECT user_id, section, 0 AS pos, first_frame, last_frame, n::BIGINT AS n, label, confidence FROM sec WHERE section = 0
  UNION ALL SELECT s.user_id, s.section, CASE WHEN s.n < 5 THEN f.pos ELSE f.pos + 1 END, CASE WHEN s.n < 5 THEN f.first_frame ELSE s.first_frame END, s.last_frame, CASE WHEN s.n < 5 THEN f.n + s.n ELSE s.n END,
    CASE WHEN s.n < 5 AND f.label <> 'verse' THEN f.label ELSE s.label END, CASE WHEN s.n < 5 THEN CAST(printf('%.2f', (f.confidence + s.confidence) / 2) AS DOUBLE) ELSE s.confidence END FROM fold f JOIN sec s ON s.user_id = f.user_id AND s.section = f.section + 1),
cmp AS (SELECT user_id, CAST(pos AS INTEGER) AS section, arg_max(first_frame, section) AS first_frame, arg_max(last_frame, section) AS last_frame, arg_max(n, section) AS n, arg_max(label, section) AS label, arg_max(confidence, section) AS confidence FROM fold GROUP BY user_id, pos)"""
CNT = """cnt AS (SELECT c.user_id, c.section, m.type, count(*) AS n FROM cmp c JOIN mr m ON m.user_id = c.user_id AND least(c.last_frame * 86400.0::DOUBLE, m.end_t) > greatest(c.first_frame * 86400.0::DOUBLE, m.start_t) GROUP BY c.user_id, c.section, m.type)"""
_h3 = lambda x: f"CAST(printf('%.3f', {x}) AS DOUBLE)"


def _decide_sql() -> str:
    fields, steps = decisions.FIELDS, []
    rows = ", ".join("('" + r[0] + "', " + ", ".join(f"{x}::DOUBLE" for x in r[1:]) + ")" for r in decisions.PROFILES)
    base = f"prof(pl, {', '.join('p_' + f for f in fields)}) AS (VALUES {rows}), " + "has AS (SELECT user_id, section, " + ", ".join(f"bool_or(type = '{k}') AS h_{k}" for k in KINDS) + " FROM cnt GROUP BY user_id, section), "
    base += "d0 AS (SELECT c.user_id, c.section, c.label, c.confidence, " + ", ".join(f"coalesce(h_{k}, false) AS h_{k}" for k in KINDS) + ", " + ", ".join(f"coalesce(p_{f}, {v}::DOUBLE) AS {f}" for f, v in zip(fields, decisions.OTHERWISE, strict=True)) + " FROM cmp c LEFT JOIN prof ON pl = label LEFT JOIN has h ON h.user_id = c.user_id AND h.section = c.section)"
    harsh, weak, hot, peak, flat = "h_harshness_risk", "h_low_end_weak", "h_low_end_hot", "h_peak_risk", "h_dynamic_flat AND NOT h_low_end_hot"
    steps += [(harsh, "high_mid", "{} + -1.0::DOUBLE"), (harsh, "air", "{} + -1.5::DOUBLE"), (harsh, "deess", "{} + 0.08::DOUBLE"), (harsh, "saturation", "greatest(0.85::DOUBLE, {} - 0.06::DOUBLE)")]
    steps += [(weak, "sub", "{} + 0.2::DOUBLE"), (weak, "bass", "{} + 0.16::DOUBLE"), (weak, "tightness", "greatest(0.52::DOUBLE, {} - 0.05::DOUBLE)")]
    steps += [(hot, "sub", "{} + -0.18::DOUBLE"), (hot, "bass", "{} + -0.14::DOUBLE"), (hot, "tightness", "least(0.82::DOUBLE, {} + 0.08::DOUBLE)"), (hot, "saturation", "greatest(0.86::DOUBLE, {} - 0.03::DOUBLE)")]
    steps += [(peak, "margin", "{} - 0.08::DOUBLE"), (peak, "saturation", "greatest(0.86::DOUBLE, {} - 0.02::DOUBLE)"), (flat, "motion", "least(1.06::DOUBLE, {} + 0.03::DOUBLE)")]
    for i, (cond, f, how) in enumerate(steps):
        base += f", d{i + 1} AS (SELECT * REPLACE ({_h3(f'CASE WHEN {cond} THEN {how.format(f)} ELSE {f} END')} AS {f}) FROM d{i})"
    last = ", ".join(_h3(f"least(greatest({f}, {lo}::DOUBLE), {hi}::DOUBLE)") + f" AS {f}" for f, (lo, hi) in zip(fields, decisions.LIMITS, strict=True))
    return base + f", dec AS (SELECT user_id, section, label, confidence, {last} FROM d{len(steps)})"


ALL = f"{EV}, {BD}, {FL}, {MR}, {SER}, {SEC}, {CMP}, {CNT}"
_eq = "greatest(" + ", ".join(f"abs({f})" for f in decisions.FIELDS[:5]) + ")"
QUERIES = {
    "frame_features": frame_features, "frame_features_hopping": frame_features_hopping, "frame_event_flags": flagged, "merged_events": merged_events, "merged_rule_events": merged_rules, "event_type_counts": event_type_counts, "timeline_summary": timeline_summary,
    "timeline_overview": timeline_overview, "timeline_with_events": timeline_with_events, "section_boundaries": section_boundaries, "section_labels": cut_sections, "sections_compact": compacted, "section_event_overlap": section_counts, "section_decisions": decided, "shadow_risk": shadow_risk, "risk_units": risk_units,
    "waveform_decimate": waveform_decimate, "silence_runs": silence_runs,
}
ORACLES = {
    "frame_features": f"WITH {EV}, {FR} SELECT * FROM fr",
    "frame_features_hopping": f"WITH {EV}, sp AS (SELECT user_id, value, unnest(generate_series(greatest(0, CAST(floor((t - 172800) / 86400) AS BIGINT) + 1), CAST(floor(t / 86400) AS BIGINT))) AS frame FROM ev) SELECT user_id, frame, {_level()}, frame * 86400.0::DOUBLE AS t FROM sp GROUP BY user_id, frame",
    "frame_event_flags": f"WITH {EV}, {BD}, {FL} SELECT * FROM fl",
    "merged_events": f"WITH {EV}, f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) <= 259200 THEN 0 ELSE 1 END AS fresh FROM ev), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT user_id, event_type, min(t) AS start_t, max(t) AS end_t, count(*) AS samples FROM i GROUP BY user_id, event_type, island",
    "merged_rule_events": f"WITH RECURSIVE {EV}, {BD}, {FL}, {MR} SELECT * FROM mr",
    "event_type_counts": f"WITH RECURSIVE {EV}, {BD}, {FL}, {MR} SELECT type, severity, count(*) AS intervals, CAST(sum(samples) AS BIGINT) AS samples FROM mr GROUP BY type, severity",
    "timeline_summary": f"WITH {EV}, {FR} SELECT user_id, count(*) AS frames, {_mean('rms_db')} AS rms_avg, min(rms_db) AS rms_min, max(rms_db) AS rms_max, max(peak_db) AS peak_max, {_mean('crest_db')} AS crest_avg, arg_max(t, frame) AS last_t FROM fr GROUP BY user_id",
    "timeline_overview": f"""WITH RECURSIVE {ALL}, {FR}, su AS (SELECT user_id, count(*) AS frames, {_mean('rms_db')} AS rms_avg, min(rms_db) AS rms_min, max(rms_db) AS rms_max, max(peak_db) AS peak_max, {_mean('crest_db')} AS crest_avg, arg_max(t, frame) AS last_t FROM fr GROUP BY user_id), te AS (SELECT user_id, type, count(*) AS n FROM mr GROUP BY user_id, type), ne AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS events, string_agg(type || '=' || n, ',' ORDER BY type) AS event_types FROM te GROUP BY user_id), ns AS (SELECT user_id, count(*) AS sections FROM cmp GROUP BY user_id)
 SELECT su.*, coalesce(events, 0) AS events, coalesce(event_types, '') AS event_types, coalesce(sections, 0) AS sections FROM su LEFT JOIN ne USING (user_id) LEFT JOIN ns USING (user_id)""",
    "timeline_with_events": f"WITH {EV}, {FR}, {BD}, {FL}, p AS (SELECT user_id, frame, count(*) AS events, array_to_string(list_sort(list(DISTINCT type)), ',') AS kinds FROM fl GROUP BY user_id, frame) SELECT fr.*, coalesce(events, 0) AS events, coalesce(kinds, '') AS kinds FROM fr LEFT JOIN p USING (user_id, frame)",
    "section_boundaries": f"WITH RECURSIVE {EV}, {BD}, {SER} SELECT user_id, (SELECT count(*) FROM ser WHERE ser.user_id = num.user_id) AS frames, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS cuts FROM num GROUP BY user_id",
    "section_labels": f"WITH RECURSIVE {EV}, {BD}, {SER}, {SEC} SELECT * FROM sec",
    "sections_compact": f"WITH RECURSIVE {EV}, {BD}, {SER}, {SEC}, {CMP} SELECT * FROM cmp",
    "section_event_overlap": f"WITH RECURSIVE {ALL} SELECT * FROM cnt",
    "section_decisions": f"WITH RECURSIVE {ALL}, {_decide_sql()} SELECT * FROM dec",
    "shadow_risk": f"""WITH RECURSIVE {ALL}, {_decide_sql()}, r AS (SELECT user_id, {_eq} AS eq, abs(saturation - 1) AS sat, abs(motion - 1) AS mot, margin,
 least(1.0::DOUBLE, 0.0::DOUBLE + (CASE WHEN {_eq} > 0.45 THEN 0.35::DOUBLE ELSE 0 END) + (CASE WHEN abs(saturation - 1) > 0.12 THEN 0.25::DOUBLE ELSE 0 END) + (CASE WHEN abs(motion - 1) > 0.12 THEN 0.20::DOUBLE ELSE 0 END) + (CASE WHEN margin < -0.20 THEN 0.25::DOUBLE ELSE 0 END) + (CASE WHEN confidence < 0.55 THEN 0.15::DOUBLE ELSE 0 END)) AS risk FROM dec),
 p AS (SELECT user_id, count(*) AS sections, count(*) FILTER (WHERE risk >= 0.55) AS high, max(eq) AS eq_max, max(sat) AS sat_max, max(mot) AS motion_max, least(0.0::DOUBLE, min(margin)) AS margin_min FROM r GROUP BY user_id),
 q AS (SELECT *, round(0.30::DOUBLE * least(1, eq_max / 0.6) + 0.22::DOUBLE * least(1, sat_max / 0.16) + 0.20::DOUBLE * least(1, motion_max / 0.16) + 0.12::DOUBLE * least(1, abs(margin_min) / 0.25) + 0.16::DOUBLE * least(1, high / sections), 4) AS global_risk FROM p)
 SELECT *, global_risk <= 0.60 AND high <= greatest(1, floor(sections * 0.35)) AS ready FROM q""",
    "risk_units": f"""WITH RECURSIVE {EV}, {BD}, {FL}, {MR}, u AS (SELECT user_id, severity, (CASE severity WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END) * least(8.0::DOUBLE, greatest(1.0::DOUBLE, samples * 1000 / 2048)) AS x FROM mr WHERE type = 'peak_risk'),
 g AS (SELECT user_id, round(sum(x), 4) AS units, round(coalesce(sum(x) FILTER (WHERE severity = 'high'), 0), 4) AS high_units FROM u GROUP BY user_id) SELECT *, round(units / 43200.0::DOUBLE, 4) AS per_minute FROM g""",
    "waveform_decimate": f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM ev) SELECT event_type, event_id, value FROM r WHERE rn % greatest(1, CAST(floor(n / 100) AS BIGINT)) = 0",
    "silence_runs": f"WITH {EV}, m AS (SELECT *, abs(value) < 40 AS q, row_number() OVER w - sum(CASE WHEN abs(value) < 40 THEN 1 ELSE 0 END) OVER w AS island FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT user_id, min(t) AS start_t, max(t) AS end_t, count(*) AS n FROM m WHERE q GROUP BY user_id, island HAVING count(*) >= 2",
}
