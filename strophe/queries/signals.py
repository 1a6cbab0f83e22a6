"""Signals over the order lines: a supplier is a track, its lines in order are the samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import half_even, total, totals
from ..operators import batch, chunks, crossover, diagnosis, signal

RATE = 20
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def samples(spark, sf_dir):
    """A supplier's lines are together from here on, in tasks of a bounded number of lines; steps by track shuffle them no more."""
    columns = [*ORDER, "l_suppkey"]
    li = chunks.spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*columns), "l_suppkey")
    i = (F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*ORDER)) - 1).cast("long")
    x = (F.round(F.col("l_discount") * 100).cast("int") - 5) * F.col("l_quantity").cast("int") / 300
    return li.select(F.col("l_suppkey").alias("track"), i.alias("i"), x.alias("x"), F.round(F.col("l_tax") * 100).cast("int").alias("t")).withColumns({"left": F.col("x"), "right": F.col("x") * (8 - F.col("t")) / 8})


def mono(spark, sf_dir):
    return samples(spark, sf_dir).select("track", "i", "x")


def center_segments(spark, sf_dir):
    return signal.center(mono(spark, sf_dir), "track", 41).groupBy("track").agg(F.count("*").alias("n"), F.max("i").alias("last"), F.min_by("x", "i").alias("first"), half_even(total(F.col("x"), 9), 6).alias("total"))


def overlapped_frames(spark, sf_dir):
    f = signal.full_frames(mono(spark, sf_dir), "track", 16, 8)
    return f.groupBy("track", "frame").agg(F.count("*").alias("n"), half_even(total(F.col("x") * (F.col("at") + 1), 9), 6).alias("weighted"))


def median_spectrum(spark, sf_dir):
    """Frames of 16 samples as spectra of levels: medians over the frames, then over bands of places."""
    levels = mono(spark, sf_dir).select("track", "i", half_even(20 * F.log10(F.abs("x") + 1e-3), 4).alias("db"))
    f = signal.full_frames(levels, "track", 16, 8)
    return signal.medians(f, "track", "at", "db", {"low": (0.0, 40.0), "high": (40.0, 200.0)}, 10.0)


def stereo_evidence_rows(spark, sf_dir):
    return signal.mid_side(samples(spark, sf_dir), "track")


def onset_envelope(spark, sf_dir):
    o = signal.onsets(mono(spark, sf_dir), "track", 5, 4)
    return o.groupBy("track").agg(F.count("*").alias("n"), F.count_if(F.col("x") > 0).alias("rising"), half_even(F.max("x"), 6).alias("top"), half_even(total(F.col("x"), 6), 4).alias("total"))


def tempo(spark, sf_dir):
    x = mono(spark, sf_dir).select("track", "i", F.greatest(half_even(F.col("x"), 4), F.lit(0.0)).alias("x"))
    return signal.tempo(x, "track", 20.0)


def noise_floor(spark, sf_dir):
    x = mono(spark, sf_dir).withColumn("x", F.when(F.col("track") % 3 > 0, F.col("x")).otherwise(F.col("x") + 0.2))
    found = signal.noise_floor(x, "track", 2)
    return found.withColumn("category", batch.noise_category(F.col("noise_db")))


def edge_fades(spark, sf_dir):
    """Tracks whose first and last part, longer for some than for others, is silent."""
    s = mono(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("track"))
    quiet = (F.col("i") < F.col("track") % 17) | (F.col("i") >= n - F.col("track") % 23)
    x = F.when(quiet, 0.0).otherwise(F.abs("x") + 0.01) * F.when(F.col("track") % 2 == 0, 1.0).otherwise((n - F.col("i")) / n)
    return signal.fades(s.select("track", "i", x.alias("x")), "track", RATE, 0.001)


def trimmed_signals(spark, sf_dir):
    return signal.trimmed(mono(spark, sf_dir), "track", 0.2, 2, 0.3, 3).groupBy("track").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.count("*").alias("n"))


def processed_signals(spark, sf_dir):
    """Width, gain, fades and clips, each summed up over a track."""
    s = samples(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("track")))
    wide, _ = signal.widened(F.col("left"), F.col("right"), 1.5)
    told = totals(s, ["track"], {
        "wide": wide, "gained": signal.gained(F.col("x"), -6.0), "faded": signal.faded(F.col("x"), F.col("i"), F.col("n"), 10, 20), "hard": signal.hard_clip(F.col("x"), -6.0),
        "tape": signal.soft_clip(F.col("x"), 6.0, 0.5), "tube": signal.soft_clip(F.col("x"), 6.0, 0.25, "Tube"),
    }, 6)
    return told.select("track", *(half_even(F.col(n), 4).alias(n) for n in told.columns[1:]))


def banded_gain(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("track"), F.get(F.array(*(F.lit(b) for b in diagnosis.BANDS)), (F.col("l_partkey") % 7).cast("int")).alias("band"), (F.col("l_quantity").cast("int") / 10).alias("x"))
    return signal.banded_gain(li, "track", {"bass": -3.0, "air": 2.0}).select("track", half_even(F.col("x"), 4).alias("x"))


SPLITS = [0.3, 1.0, 2.0, 4.0, 7.0]


def band_splits(spark, sf_dir):
    """Tracks of 20 samples a second split into six bands, the highest lowered by 6 dB: what each band and the sum amount to."""
    out = crossover.magnitudes(mono(spark, sf_dir), "track", float(RATE), {"air": -6.0}, 6, SPLITS, size=256)
    return out.select("track", "n", *(half_even(F.col(c), 3).alias(f"{c}_size") for c in ("x", *crossover.BANDS)))


def cuts_in_chunks(spark, sf_dir):
    """Where a track jumps, at least ten samples after the jump before: found in chunks of 64."""
    return chunks.boundaries(mono(spark, sf_dir).select("track", "i", F.col("x").alias("rms_db"), F.lit(0.0).alias("bright")), "track", "i", 0.3, 1.0, 10, 64)


def automation_plan(spark, sf_dir):
    o, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    bands = [*signal.AUTOMATED, "voice_db"]
    eq = F.map_from_entries(F.array(*(F.struct(F.lit(b).alias("key"), ((k * (3 + i) % 31 - 15) / 12).alias("value")) for i, b in enumerate(bands))))
    s = o.select(k.alias("section"), (k % 50).cast("double").alias("start_s"), (k % 50 + k % 9 / 4).alias("end_s"), F.when(k % 4 > 0, (k % 13 * 50).cast("double")).alias("smoothing_ms"), eq.alias("eq_db"))
    moves = signal.automation(s)
    return moves.select("section", "band", "operation", "frequency_hz", half_even(F.col("applied_db"), 4).alias("applied_db"), "smoothing_ms", half_even(F.col("ramp_s"), 4).alias("ramp_s"), half_even(signal.envelope(F.col("start_s") + 0.1, F.col("start_s"), F.col("end_s"), F.col("ramp_s")), 4).alias("at"))


def track_analysis(spark, sf_dir):
    """All that is measured of a track in one row, with what follows from it."""
    s = samples(spark, sf_dir)
    level = s.groupBy("track").agg(F.count("*").alias("n"), half_even(10 * F.log10(F.avg(F.col("x") * F.col("x")) + 1e-9), 4).alias("rms_db"), half_even(20 * F.log10(F.max(F.abs("x")) + 1e-9), 4).alias("peak_db"))
    clips = diagnosis.clipping(s.withColumn("p", 20 * F.log10(F.abs("x") + 1e-3)), "track", "p", -1.0).select("track", "clips", "clipped")
    row = signal.assembled("track", level, signal.mid_side(s, "track"), signal.noise_floor(s, "track", 2).drop("has_silence"), clips)
    noise = batch.noise_category(F.col("noise_db"))
    p = diagnosis.profile(F.col("clipped"), F.col("n") % 13, F.col("crest_db"), F.col("peak_db"), noise, F.col("rms_db"), F.lit(50.0))
    return row.withColumn("profile", p["label"])


S = f"sa AS (SELECT l_suppkey AS track, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(ORDER)}) - 1 AS i, (CAST(round(l_discount * 100) AS INTEGER) - 5) * CAST(l_quantity AS INTEGER) / 300 AS x, CAST(round(l_tax * 100) AS INTEGER) AS t FROM lineitem), ln AS (SELECT track, count(*) AS n FROM sa GROUP BY track)"
_r = lambda x, d: f"CAST(printf('%.{d}f', {x}) AS DOUBLE)"
_fr = "fr AS (SELECT track, i, x, f AS frame, i - f * 8 AS spot FROM sa JOIN ln USING (track), unnest(generate_series(greatest(0, CAST(floor((i - 16) / 8) AS BIGINT) + 1), CAST(floor(i / 8) AS BIGINT))) AS u(f) WHERE f * 8 + 16 <= n)"
_ev = "sqrt(avg(((x + r) / 2) * ((x + r) / 2)) + 1e-12)"
_es = "sqrt(avg(((x - r) / 2) * ((x - r) / 2)) + 1e-12)"
EVIDENCE = f"ev AS (SELECT track, {_r(f'{_ev} / greatest({_ev} + {_es}, 1e-12)', 3)} AS mid_side_ratio, {_r('sum(x * r) / (sqrt(sum(x * x) * sum(r * r)) + 1e-12)', 4)} AS correlation, {_r('20 * log10((max(greatest(abs(x), abs(r))) + 1e-12) / sqrt((avg(x * x) + avg(r * r)) / 2 + 1e-12))', 2)} AS crest_db FROM (SELECT *, x * (8 - t) / 8 AS r FROM sa) GROUP BY track)"


def _noise(x: str) -> str:
    quiet = " UNION ALL ".join(f"SELECT track, {db} AS db FROM (SELECT track, i - row_number() OVER (PARTITION BY track ORDER BY i) AS g FROM nx WHERE abs(y) < {10 ** (db / 20)!r}) GROUP BY track, g HAVING count(*) >= 2" for db in signal.SILENCES)
    return f"nx AS (SELECT track, i, {x} AS y FROM sa), qu AS ({quiet}), fo AS (SELECT track, min(db)::DOUBLE AS found FROM qu GROUP BY track), vo AS (SELECT track, 10 * log10(avg(y * y) + 1e-12) AS mean, 20 * log10(max(abs(y)) + 1e-12) AS top FROM nx GROUP BY track), nf AS (SELECT vo.track, {_r('coalesce(found, mean - greatest(6, (top - mean) * 0.7e0))', 4)} AS noise_db, found IS NOT NULL AS has_silence FROM vo LEFT JOIN fo USING (track))"


_cat = "CASE WHEN noise_db <= -60 THEN 'Excellent' WHEN noise_db <= -50 THEN 'Good' WHEN noise_db <= -40 THEN 'Moderate' WHEN noise_db <= -30 THEN 'High' ELSE 'VeryHigh' END"
_exact = lambda e, d: f"CAST(sum(CAST({_r(e, d)} AS DECIMAL(28, {d}))) AS DOUBLE)"
_total = lambda e, n: f"{_r(_exact(e, 6), 4)} AS {n}"
_loud = lambda limit, least, name: f"{name} AS (SELECT track, min(i) AS a, max(i) AS b FROM (SELECT track, i, i - row_number() OVER (PARTITION BY track ORDER BY i) AS g FROM sa WHERE abs(x) >= {limit}) GROUP BY track, g HAVING count(*) >= {least})"
_point = lambda p, size, agg: f"{agg} FILTER (WHERE i >= {p} AND i < {p} + {size})"
QUERIES = {
    "center_segments": center_segments, "overlapped_frames": overlapped_frames, "median_spectrum": median_spectrum, "stereo_evidence_rows": stereo_evidence_rows, "onset_envelope": onset_envelope, "tempo": tempo, "noise_floor": noise_floor, "edge_fades": edge_fades,
    "trimmed_signals": trimmed_signals, "processed_signals": processed_signals, "banded_gain": banded_gain, "band_splits": band_splits, "cuts_in_chunks": cuts_in_chunks, "automation_plan": automation_plan, "track_analysis": track_analysis,
}
ORACLES = {
    "center_segments": f"WITH {S}, c AS (SELECT track, i - greatest(CAST(floor((n - 41) / 2) AS BIGINT), 0) AS j, x FROM sa JOIN ln USING (track)) SELECT track, count(*) AS n, max(j) AS last, arg_min(x, j) AS first, {_r(_exact('x', 9), 6)} AS total FROM c WHERE j BETWEEN 0 AND 40 GROUP BY track",
    "overlapped_frames": f"WITH {S}, {_fr} SELECT track, frame, count(*) AS n, {_r(_exact('x * (spot + 1)', 9), 6)} AS weighted FROM fr GROUP BY track, frame",
    "median_spectrum": f"WITH {S}, {_fr}, e AS (SELECT track, spot, median({_r('20 * log10(abs(x) + 1e-3)', 4)}) AS db FROM fr GROUP BY track, spot) SELECT track, {_r('median(db) FILTER (WHERE spot * 10 < 40)', 4)} AS low, {_r('median(db) FILTER (WHERE spot * 10 >= 40 AND spot * 10 < 200)', 4)} AS high FROM e GROUP BY track",
    "stereo_evidence_rows": f"WITH {S}, {EVIDENCE} SELECT * FROM ev",
    "onset_envelope": f"""WITH {S}, m AS (SELECT track, avg(x) AS mean FROM sa GROUP BY track), a AS (SELECT track, i, abs(x - mean) AS x FROM sa JOIN m USING (track)), v AS (SELECT track, i, sum(x) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS x FROM a), b AS (SELECT track, i // 4 AS i, avg(x) AS x FROM v GROUP BY track, i // 4 HAVING count(*) = 4),
 u AS (SELECT track, greatest(coalesce(x - lag(x) OVER (PARTITION BY track ORDER BY i), 0), 0) AS x FROM b), o AS (SELECT track, x / (max(x) OVER (PARTITION BY track) + 1e-9) AS x FROM u) SELECT track, count(*) AS n, count(*) FILTER (WHERE x > 0) AS rising, {_r('max(x)', 6)} AS top, {_r(_exact('x', 6), 4)} AS total FROM o GROUP BY track""",
    "tempo": f"""WITH {S}, o AS (SELECT track, i, greatest({_r('x', 4)}, 0) AS x FROM sa), l AS (SELECT unnest(range(6, 16)) AS lag), t AS (SELECT track, n FROM ln WHERE n > 16), c AS (SELECT a.track, lag, sum(a.x * b.x) AS ac FROM o a, l, o b WHERE b.track = a.track AND b.i = a.i + lag GROUP BY a.track, lag),
 e AS (SELECT t.track, n, l.lag, {_r('coalesce(ac, 0)', 9)} AS ac FROM t CROSS JOIN l LEFT JOIN c ON c.track = t.track AND c.lag = l.lag), b AS (SELECT track, any_value(n) AS n, arg_min(lag, (-ac, lag)) AS lag, (max(ac) - avg(ac) - 1e-9) / (stddev_pop(ac) + 1e-9) AS z FROM e GROUP BY track),
 f AS (SELECT track, max(f) AS top, avg(f) AS mean FROM (SELECT o.track, o.i % greatest(8, lag) AS bin, avg(x) AS f FROM o JOIN b USING (track) WHERE o.i < least(n, lag * 8) // greatest(8, lag) * greatest(8, lag) GROUP BY o.track, o.i % greatest(8, lag)) GROUP BY track)
 SELECT track, CAST(lag AS INTEGER) AS lag, {_r('1200.0::DOUBLE / lag', 4)} AS bpm, {_r('greatest(0, least(1, (z - 0.6e0) / 3.2e0))', 4)} AS confidence, {_r('greatest(0, least(1, (top / (mean + 1e-9) - 1) / 2.5e0))', 4)} AS pulse_clarity FROM b JOIN f USING (track)""",
    "noise_floor": f"WITH {S}, {_noise('CASE WHEN track % 3 > 0 THEN x ELSE x + 0.2e0 END')} SELECT *, {_cat} AS category FROM nf",
    "edge_fades": f"""WITH {S}, e AS (SELECT track, i, n, CASE WHEN i < track % 17 OR i >= n - track % 23 THEN 0e0 ELSE abs(x) + 0.01e0 END * CASE WHEN track % 2 = 0 THEN 1e0 ELSE (n - i) / n END AS y FROM sa JOIN ln USING (track)),
 q AS (SELECT track, n, min(i) AS a, max(i) AS b FROM (SELECT track, n, i, i - row_number() OVER (PARTITION BY track ORDER BY i) AS g FROM e WHERE abs(y) < 0.001e0) GROUP BY track, n, g),
 sp AS (SELECT ln.track, ln.n, coalesce(max(b - a + 1) FILTER (WHERE a <= 2 AND b < ln.n - 1), 0) AS lead, coalesce(max(ln.n - a) FILTER (WHERE b + 1 >= ln.n - 2), 0) AS tail FROM ln LEFT JOIN q ON q.track = ln.track GROUP BY ln.track, ln.n),
 pt AS (SELECT *, greatest(1, n - tail - 40) AS p0, greatest(1, n - tail - 6) AS p2, least(n - 6, lead + 6) AS p3, least(n - 6, lead + 30) AS p5 FROM sp),
 lv AS (SELECT pt.track, lead, tail, {', '.join(f"10 * log10({_point(f'p{p}', 5, 'avg(y * y)')} + 1e-12) AS v{p}" for p in (0, 2, 3, 5))}, 20 * log10({_point('p2', 10, 'max(abs(y))')} + 1e-12) AS x2, 20 * log10({_point('p3', 10, 'max(abs(y))')} + 1e-12) AS x3 FROM e JOIN pt USING (track) GROUP BY pt.track, lead, tail)
 SELECT track, {_r('lead / 20', 4)} AS lead, {_r('tail / 20', 4)} AS tail, CASE WHEN lead >= 6 AND (NOT coalesce(v5 - v3 > 5, false) OR coalesce(x3 > -6, false)) THEN {_r('greatest(0.2e0, least(2e0, lead / 20 * 0.6e0))', 4)} ELSE 0e0 END AS fade_in,
 CASE WHEN tail >= 6 AND (NOT coalesce(v2 - v0 < -3, false) OR coalesce(x2 > -6, false)) THEN {_r('greatest(0.2e0, least(3e0, tail / 20 * 0.6e0))', 4)} ELSE 0e0 END AS fade_out FROM lv""",
    "trimmed_signals": f"WITH {S}, {_loud('0.2e0', 2, 'u')}, {_loud('0.3e0', 3, 'w')}, k AS (SELECT u.track, min(u.a) AS a, max(w.b) AS b FROM u JOIN w USING (track) GROUP BY u.track) SELECT sa.track, min(i) AS a, max(i) AS b, count(*) AS n FROM sa JOIN k USING (track) WHERE i BETWEEN a AND b GROUP BY sa.track",
    "processed_signals": f"""WITH {S}, p AS (SELECT *, x * (8 - t) / 8 AS r FROM sa JOIN ln USING (track)) SELECT track, {_total('(x + r) / 2 + (x - r) / 2 * 1.5e0', 'wide')}, {_total('x * pow(10, -0.3e0)', 'gained')}, {_total('x * least(1, i / 10) * least(1, (n - i) / 20)', 'faded')}, {_total('greatest(-pow(10, -0.3e0), least(pow(10, -0.3e0), x))', 'hard')},
 {_total('x * 0.5e0 + tanh(x * pow(10, 0.3e0)) / tanh(pow(10, 0.3e0)) * 0.5e0', 'tape')}, {_total('x * 0.75e0 + atan(x * pow(10, 0.3e0)) / atan(pow(10, 0.3e0)) * 0.25e0', 'tube')} FROM p GROUP BY track""",
    "banded_gain": f"SELECT l_suppkey AS track, {_r('sum(CAST(l_quantity AS INTEGER) / 10 * CASE l_partkey % 7 WHEN 1 THEN pow(10, -0.15e0) WHEN 5 THEN pow(10, 0.1e0) ELSE 1 END)', 4)} AS x FROM lineitem GROUP BY l_suppkey",
    "band_splits": f"""WITH RECURSIVE {S}, ar AS (SELECT track, list(x ORDER BY i) AS xs FROM sa GROUP BY track), w AS (SELECT track, 0::BIGINT AS k, xs, 0e0 AS x, {', '.join(f'0e0 AS p{j}, 0e0 AS q{j}' for j in range(5))} FROM ar
  UNION ALL SELECT track, k + 1, xs, xs[k + 1], {', '.join(f'{a!r} * p{j} + {1 - a!r} * xs[k + 1], {a!r} * q{j} + {1 - a!r} * ({a!r} * p{j} + {1 - a!r} * xs[k + 1])' for j, a in enumerate(map(float, crossover.poles(RATE, SPLITS))))} FROM w WHERE k < len(xs)),
 b AS (SELECT track, q0 AS sub_bass, q1 - q0 AS bass, q2 - q1 AS low_mid, q3 - q2 AS mid, q4 - q3 AS high_mid, x - q4 AS air FROM w WHERE k > 0), y AS (SELECT *, sub_bass + bass + low_mid + mid + high_mid + air * pow(10, -0.3e0) AS x FROM b)
 SELECT track, count(*) AS n, {', '.join(f"{_r(_exact(f'abs({c})', 6), 3)} AS {c}_size" for c in ('x', *crossover.BANDS))} FROM y GROUP BY track""",
    "cuts_in_chunks": f"""WITH RECURSIVE {S}, j AS (SELECT track, i FROM (SELECT track, i, abs(x - lag(x) OVER (PARTITION BY track ORDER BY i)) AS d FROM sa) WHERE d > 0.3e0), w AS (SELECT track, 0::BIGINT AS cut FROM ln UNION ALL SELECT w.track, min(j.i) FROM w JOIN j ON j.track = w.track AND j.i >= w.cut + 10 GROUP BY w.track, w.cut)
 SELECT DISTINCT track, cut FROM (SELECT track, cut FROM w UNION ALL SELECT track, n - 1 FROM ln)""",
    "automation_plan": f"""WITH b(i, band, hz) AS (VALUES (0, 'subbass_db', 45e0), (1, 'bass_db', 120e0), (2, 'mid_db', 1000e0), (3, 'high_mid_db', 3800e0), (4, 'air_db', 9000e0)), s AS (SELECT o_orderkey AS section, o_orderkey % 50 AS a, o_orderkey % 50 + o_orderkey % 9 / 4 AS z, CASE WHEN o_orderkey % 4 > 0 THEN greatest(150, least(500, o_orderkey % 13 * 50)) ELSE 180 END AS ms, band, hz, greatest(-0.8e0, least(0.8e0, (o_orderkey * (3 + i) % 31 - 15) / 12)) AS g FROM orders, b),
 m AS (SELECT *, least(ms / 1000, greatest(0.01e0, (z - a) / 2)) AS ramp FROM s WHERE abs(g) >= 0.01e0 AND z > a) SELECT section, band, CASE WHEN g > 0 THEN 'boost' ELSE 'cut' END AS operation, hz AS frequency_hz, {_r('g', 4)} AS applied_db, ms::DOUBLE AS smoothing_ms, {_r('ramp', 4)} AS ramp_s, CASE WHEN a + 0.1e0 >= z THEN 0e0 ELSE {_r('least(1, (a + 0.1e0 - a) / ramp, (z - (a + 0.1e0)) / ramp)', 4)} END AS at FROM m""",
    "track_analysis": f"""WITH {S}, {EVIDENCE}, {_noise('x')}, lv AS (SELECT track, count(*) AS n, {_r('10 * log10(avg(x * x) + 1e-9)', 4)} AS rms_db, {_r('20 * log10(max(abs(x)) + 1e-9)', 4)} AS peak_db, count(*) FILTER (WHERE 20 * log10(abs(x) + 1e-3) >= -1) AS clips FROM sa GROUP BY track),
 j AS (SELECT lv.track, n, rms_db, peak_db, mid_side_ratio, correlation, crest_db, noise_db, clips, clips > 0 AS clipped FROM lv JOIN ev USING (track) JOIN nf USING (track))
 SELECT *, CASE WHEN clipped OR n % 13 <= 4.5e0 OR crest_db <= 8.5e0 OR peak_db >= -1.5e0 OR (rms_db <= -16 AND peak_db <= -6 AND n % 13 <= 6.5e0) THEN 'Conservador' WHEN n % 13 >= 8.5e0 AND crest_db >= 11 AND peak_db <= -3 THEN 'Agresivo' ELSE 'Normal' END AS profile FROM j""",
}
