"""Spectral operators over the embeddings, taken as 64 samples each; tempo over hourly counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quality, resonance, selection, spectrum
from .series import EV, stream

N = 64


def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def spectrum_dft(spark, sf_dir):
    return spectrum.dft(vectors(spark, sf_dir), "vec_id", "embedding", N)


def spectrum_hann(spark, sf_dir):
    return spectrum.dft(vectors(spark, sf_dir), "vec_id", "embedding", N, hann=True)


def spectrum_shape(spark, sf_dir):
    return spectrum.shape(spectrum_dft(spark, sf_dir), "vec_id")


def spectrum_peaks(spark, sf_dir):
    return spectrum.peaks(spectrum_dft(spark, sf_dir), "vec_id", -20.0, 2, 10)


def spectrum_prominence(spark, sf_dir):
    return spectrum.prominence(spectrum_dft(spark, sf_dir), "vec_id", 1, 5)


def spectrum_nms(spark, sf_dir):
    return spectrum.suppressed(spectrum_prominence(spark, sf_dir).where("prominence > 0"), "vec_id", "bin", "prominence", 3, 8)


def spectrum_band_counts(spark, sf_dir):
    bands = {"low": (0, 4), "mid": (4, 16), "high": (16, 32)}
    return spectrum_peaks(spark, sf_dir).groupBy("vec_id").agg(*spectrum.band_counts(F.col("bin"), bands))


def tempo(spark, sf_dir):
    hours = stream(spark, sf_dir).groupBy("event_type", F.floor(F.col("t") / 3600).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    ac = spectrum.autocorrelation(hours, "event_type", "hour", "n", range(1, 49))
    return spectrum.best_lag(ac.withColumn("ac", F.round("ac").cast("long")), "event_type")  # counts are whole


def series_frames(spark, sf_dir, size, hop):
    """The values of each kind of event in order of time, in frames."""
    ordered = stream(spark, sf_dir).select("event_type", (F.row_number().over(Window.partitionBy("event_type").orderBy("t", "event_id")) - 1).alias("i"), "value")
    return spectrum.framed(ordered, "event_type", "i", "value", size, hop)


def frame_spectra(spark, sf_dir):
    """Hann-windowed spectra of frames of 64 values every 32."""
    found = spectrum.fft(series_frames(spark, sf_dir, 64, 32), ["event_type", "frame"], "x", 64)
    return found.select("event_type", "frame", "bin", F.round("mag", 3).alias("mag"))


def long_frame_spectra(spark, sf_dir):
    """The median over frames of 8,192 values every 4,096, bin by bin (no SQL: a sum over all values for each bin takes too long)."""
    return resonance.median_spectrum(series_frames(spark, sf_dir, resonance.FRAME, resonance.HOP), "event_type", "x")


def long_frame_resonances(spark, sf_dir):
    """What stands out of these spectra, taken as 44,100 values a second."""
    return resonance.resonances(selection.held(long_frame_spectra(spark, sf_dir)), "event_type")


def stereo_evidence(spark, sf_dir):
    half = lambda odd: F.filter("embedding", lambda x, i: i % 2 == odd)
    rows = vectors(spark, sf_dir).select("vec_id", half(0).alias("l"), half(1).alias("r"))
    return rows.select("vec_id", *(c.alias(n) for n, c in quality.stereo(F.col("l"), F.col("r")).items()))


def _dft(hann: str = "") -> str:
    x = f"CAST(embedding[i + 1] AS DOUBLE){hann}"
    return f"x AS (SELECT vec_id, i, {x} AS v FROM embeddings, range(64) r(i)), dft AS (SELECT vec_id, CAST(k AS INTEGER) AS bin, round(sqrt(pow(sum(v * cos(i * k * (2 * pi() / 64))), 2) + pow(sum(v * sin(i * k * (2 * pi() / 64))), 2)), 5) AS mag FROM x, range(33) s(k) GROUP BY vec_id, k), db AS (SELECT *, round(20 * log10(greatest(mag, 1e-5)), 4) AS db FROM dft)"


PK = """cand AS (SELECT vec_id, bin, mag, row_number() OVER (PARTITION BY vec_id ORDER BY bin) AS k FROM (SELECT *, lag(mag) OVER w AS a, lead(mag) OVER w AS b FROM db WINDOW w AS (PARTITION BY vec_id ORDER BY bin)) WHERE mag > a AND mag > b AND db > -20),
walk AS (SELECT vec_id, k, bin AS last, true AS took FROM cand WHERE k = 1 UNION ALL SELECT c.vec_id, c.k, CASE WHEN c.bin - w.last > 2 THEN c.bin ELSE w.last END, c.bin - w.last > 2 FROM walk w JOIN cand c ON c.vec_id = w.vec_id AND c.k = w.k + 1),
pk AS (SELECT * FROM (SELECT vec_id, bin, mag, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY mag DESC, bin) AS INTEGER) AS rank FROM cand JOIN walk USING (vec_id, k) WHERE took) WHERE rank <= 10)"""
PR = "pr AS (SELECT a.vec_id, a.bin, round(any_value(a.db) - median(b.db), 5) AS prominence FROM db a JOIN db b ON a.vec_id = b.vec_id AND abs(a.bin - b.bin) > 1 AND abs(a.bin - b.bin) <= 5 GROUP BY a.vec_id, a.bin)"

QUERIES = {
    "spectrum_dft": spectrum_dft, "spectrum_hann": spectrum_hann, "spectrum_shape": spectrum_shape, "spectrum_peaks": spectrum_peaks, "spectrum_prominence": spectrum_prominence, "spectrum_nms": spectrum_nms, "spectrum_band_counts": spectrum_band_counts,
    "tempo_autocorr": tempo, "frame_spectra": frame_spectra, "long_frame_spectra": long_frame_spectra, "long_frame_resonances": long_frame_resonances, "stereo_evidence": stereo_evidence,
}
ORACLES = {
    "spectrum_dft": f"WITH {_dft()} SELECT * FROM db",
    "spectrum_hann": f"WITH {_dft(' * (0.5 - 0.5 * cos(i * (2 * pi() / 63)))')} SELECT * FROM db",
    "spectrum_shape": f"WITH {_dft()}, c AS (SELECT *, mag * mag AS p, sum(mag * mag) OVER (PARTITION BY vec_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS s, sum(mag * mag) OVER (PARTITION BY vec_id) AS a FROM db) SELECT vec_id, round(sum(bin * p) / sum(p), 4) AS centroid, min(bin) FILTER (WHERE s >= 0.85 * a) AS rolloff, round(exp(avg(ln(mag + 1e-10))) / (avg(mag) + 1e-10), 4) AS flatness FROM c GROUP BY vec_id",
    "spectrum_peaks": f"WITH RECURSIVE {_dft()}, {PK} SELECT * FROM pk",
    "spectrum_prominence": f"WITH {_dft()}, {PR} SELECT * FROM pr",
    "spectrum_nms": f"""WITH RECURSIVE {_dft()}, {PR}, o AS (SELECT vec_id, bin, prominence, row_number() OVER (PARTITION BY vec_id ORDER BY prominence DESC, bin) AS k FROM pr WHERE prominence > 0),
 w AS (SELECT vec_id, k, [bin] AS taken, true AS took FROM o WHERE k = 1 UNION ALL SELECT o.vec_id, o.k, CASE WHEN len(w.taken) < 8 AND len(list_filter(w.taken, lambda y: abs(y - o.bin) <= 3)) = 0 THEN list_append(w.taken, o.bin) ELSE w.taken END, len(w.taken) < 8 AND len(list_filter(w.taken, lambda y: abs(y - o.bin) <= 3)) = 0 FROM w JOIN o ON o.vec_id = w.vec_id AND o.k = w.k + 1)
 SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY k) - 1 AS INTEGER) AS rank, bin, prominence FROM o JOIN w USING (vec_id, k) WHERE took""",
    "spectrum_band_counts": f"WITH RECURSIVE {_dft()}, {PK} SELECT vec_id, count(*) FILTER (WHERE bin BETWEEN 0 AND 4) AS low, count(*) FILTER (WHERE bin BETWEEN 4 AND 16) AS mid, count(*) FILTER (WHERE bin BETWEEN 16 AND 32) AS high FROM pk GROUP BY vec_id",
    "tempo_autocorr": f"""WITH {EV}, h AS (SELECT event_type, CAST(floor(t / 3600) AS BIGINT) AS hour, count(*) AS n FROM ev GROUP BY event_type, floor(t / 3600)), ac AS (SELECT a.event_type, CAST(b.hour - a.hour AS INTEGER) AS lag, CAST(sum(a.n * b.n) AS BIGINT) AS ac FROM h a JOIN h b ON a.event_type = b.event_type AND b.hour - a.hour BETWEEN 1 AND 48 GROUP BY a.event_type, b.hour - a.hour)
 SELECT event_type, arg_max(lag, ac * 1000 - lag) AS lag, round((max(ac) - avg(ac)) / (stddev_pop(ac) + 1e-9), 4) AS z FROM ac GROUP BY event_type""",
    "frame_spectra": f"""WITH {EV}, o AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1 AS i, value FROM ev), n AS (SELECT event_type, count(*) AS n FROM o GROUP BY event_type),
 f AS (SELECT o.event_type, CAST(u.f AS BIGINT) AS frame, i - u.f * 32 AS spot, value * (0.5 - 0.5 * cos((i - u.f * 32) * (2 * pi() / 63))) AS v FROM o JOIN n USING (event_type), unnest(generate_series(greatest(0, CAST(floor((i - 64) / 32) AS BIGINT) + 1), CAST(floor(i / 32) AS BIGINT))) AS u(f) WHERE u.f * 32 + 64 <= n)
 SELECT event_type, frame, CAST(k AS INTEGER) AS bin, round(sqrt(pow(sum(v * cos(spot * k * (2 * pi() / 64))), 2) + pow(sum(v * sin(spot * k * (2 * pi() / 64))), 2)), 3) AS mag FROM f, range(33) s(k) GROUP BY event_type, frame, k""",
    "stereo_evidence": """WITH p AS (SELECT vec_id, CAST(embedding[2 * i + 1] AS DOUBLE) AS l, CAST(embedding[2 * i + 2] AS DOUBLE) AS r FROM embeddings, range(32) t(i)),
 s AS (SELECT vec_id, sqrt(sum((l + r) * (l + r) / 4) / 32) AS m, sqrt(sum((l - r) * (l - r) / 4) / 32) AS d, sum(l * r) / sqrt(sum(l * l) * sum(r * r)) AS c, max(greatest(abs(l), abs(r))) AS pk, sqrt(sum((l * l + r * r) / 2) / 32) AS rms FROM p GROUP BY vec_id)
 SELECT vec_id, round(m / (m + d + 1e-12), 4) AS mid_ratio, round(c, 4) AS correlation, round(20 * log10(pk / rms), 4) AS crest_db FROM s""",
}
