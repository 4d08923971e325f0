"""Queries over samples, frames, spectra and chunks."""

from __future__ import annotations


from pyspark.sql import functions as F

from lumentide.functions import framing, signal, spectral
from lumentide.plans.registry import PCM, VECTORS, pcm, query, rounded, table, vectors

_VAD = signal.VadOptions(frame=4, scale=1.0, least=0.01, hangover=1)
_SMALL = framing.FrameOptions(16, 6, "none")


@query("SELECT event_id, CAST(CAST((event_id * 7919) % 65536 - 32768 AS FLOAT) / CAST(32768 AS FLOAT) AS DOUBLE) AS x FROM events")
def pcm_from_int16(spark, sf_dir):
    sample = ((F.col("event_id") * 7919) % 65536 - 32768).cast("smallint")
    return table(spark, sf_dir, "events").select("event_id", signal.int16_to_float(sample).cast("double").alias("x"))


def _spoilt(spark, sf_dir):
    """Clips some of which hold NaN or infinity."""
    odd = F.when((F.col("clip") % 9 == 0) & (F.col("i") == 2), float("nan")).when((F.col("clip") % 9 == 4) & (F.col("i") == 1), float("inf"))
    return pcm(spark, sf_dir).withColumn("x", F.coalesce(odd, F.col("x")))


_SPOILT = f"{PCM}, bad AS (SELECT clip, i, CASE WHEN clip % 9 = 0 AND i = 2 THEN CAST('nan' AS DOUBLE) WHEN clip % 9 = 4 AND i = 1 THEN CAST('inf' AS DOUBLE) ELSE x END AS x FROM pcm)"


@query(f"WITH {_SPOILT} SELECT clip, CASE WHEN bool_or(NOT isfinite(x)) THEN 'kInvalidPcmData' ELSE 'kOk' END AS status FROM bad GROUP BY clip")
def finite_check(spark, sf_dir):
    return signal.finite_status(_spoilt(spark, sf_dir))


@query(f"""WITH {_SPOILT}, f AS (SELECT *, first(x) OVER (PARTITION BY clip ORDER BY i) AS x0 FROM (SELECT clip, i, CASE WHEN clip % 9 = 7 AND i = 0 THEN CAST('nan' AS DOUBLE) ELSE x END AS x FROM bad)),
g AS (SELECT clip, count(*) AS n, any_value(x0) AS x0, min(x) FILTER (NOT isnan(x)) AS lo, max(x) FILTER (NOT isnan(x)) AS hi, avg(abs(x)) AS mean_abs, sqrt(avg(x * x)) AS rms, avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END) AS zero_ratio, bool_or(isnan(x)) AS has_nan, bool_or(isinf(x)) AS has_inf FROM f GROUP BY clip)
SELECT clip, n, CASE WHEN NOT isnan(x0) AND isfinite(lo) THEN round(lo, 6) + 0.0 END AS min, CASE WHEN NOT isnan(x0) AND isfinite(hi) THEN round(hi, 6) + 0.0 END AS max, CASE WHEN NOT isnan(x0) AND isfinite(lo) AND isfinite(hi) THEN round(greatest(abs(lo), abs(hi)), 6) END AS max_abs,
 CASE WHEN isfinite(mean_abs) THEN round(mean_abs, 6) END AS mean_abs, CASE WHEN isfinite(rms) THEN round(rms, 6) END AS rms, round(zero_ratio, 6) AS zero_ratio, has_nan, has_inf FROM g""")
def pcm_stats(spark, sf_dir):
    """All statistics of one aggregate; null where they aren't finite. Some clips begin with NaN, which minimum and maximum then are."""
    first = F.when((F.col("clip") % 9 == 7) & (F.col("i") == 0), float("nan")).otherwise(F.col("x"))
    out = signal.pcm_stats(_spoilt(spark, sf_dir).withColumn("x", first))
    some = ("min", "max", "max_abs", "mean_abs", "rms")
    return rounded(out.withColumns({c: F.when(signal.is_finite(F.col(c)), F.col(c)) for c in some}), 6, *some, "zero_ratio")


_NORMAL = f"{PCM}, top AS (SELECT *, max(abs(x)) OVER (PARTITION BY clip) AS m FROM pcm), gained AS (SELECT clip, i, x AS x0, m, CASE WHEN m < 1e-6 THEN 1.0 ELSE least(0.95 / m, 20.0) END AS gain FROM top), norm AS (SELECT clip, i, gain, CASE WHEN m < 1e-6 THEN x0 ELSE greatest(-1.0, least(1.0, x0 * gain)) END AS x FROM gained)"


@query(f"WITH {_NORMAL} SELECT clip, i, round(x, 6) + 0.0 AS x, round(gain, 6) + 0.0 AS gain FROM norm")
def peak_normalize(spark, sf_dir):
    return rounded(signal.peak_normalize(pcm(spark, sf_dir)), 6, "x", "gain")


@query(f"WITH {PCM} SELECT clip, i, round(CASE WHEN abs(x) < power(10, -30 / 20.0) THEN 0.0 ELSE x END, 6) + 0.0 AS x FROM pcm")
def noise_gate(spark, sf_dir):
    return rounded(pcm(spark, sf_dir).withColumn("x", signal.noise_gate(F.col("x"), -30.0)), 6, "x")


@query(f"WITH {PCM} SELECT clip, i, round(x - coalesce(0.97 * lag(x) OVER (PARTITION BY clip ORDER BY i), 0), 6) + 0.0 AS x FROM pcm")
def pre_emphasis(spark, sf_dir):
    return rounded(signal.pre_emphasis(pcm(spark, sf_dir), 0.97), 6, "x")


@query(f"WITH {_NORMAL}, gated AS (SELECT clip, i, CASE WHEN abs(x) < power(10, -30 / 20.0) THEN 0.0 ELSE x END AS x FROM norm) SELECT clip, i, round(x - coalesce(0.97 * lag(x) OVER (PARTITION BY clip ORDER BY i), 0), 6) + 0.0 AS x FROM gated")
def preprocess_chain(spark, sf_dir):
    return rounded(signal.preprocess(pcm(spark, sf_dir), signal.PreprocessOptions(gate=True, gate_db=-30.0)), 6, "x")


@query(f"""WITH {_SPOILT}, s AS (SELECT clip, bool_and(isfinite(x)) AS good FROM bad GROUP BY clip), {_NORMAL.removeprefix(PCM + ", ")}, gated AS (SELECT clip, i, gain, CASE WHEN abs(x) < power(10, -30 / 20.0) THEN 0.0 ELSE x END AS x FROM norm),
o AS (SELECT clip, i, gain, x - coalesce(0.97 * lag(x) OVER (PARTITION BY clip ORDER BY i), 0) AS x FROM gated), a AS (SELECT clip, count(*) AS n, max(abs(x)) AS m, sqrt(avg(x * x)) AS r FROM pcm GROUP BY clip), b AS (SELECT clip, max(gain) AS gain, max(abs(x)) AS m, sqrt(avg(x * x)) AS r FROM o GROUP BY clip)
SELECT clip, CASE WHEN good THEN 'kOk' ELSE 'kInvalidPcmData' END AS status, CASE WHEN good THEN n END AS processed_samples, CASE WHEN good THEN round(gain, 6) END AS gain, CASE WHEN good THEN round(a.m, 6) END AS input_max_abs, CASE WHEN good THEN round(a.r, 6) END AS input_rms,
 CASE WHEN good THEN round(b.m, 6) END AS output_max_abs, CASE WHEN good THEN round(b.r, 6) END AS output_rms FROM s JOIN a USING (clip) JOIN b USING (clip)""")
def preprocess_report(spark, sf_dir):
    out = signal.preprocess_report(_spoilt(spark, sf_dir), signal.PreprocessOptions(gate=True, gate_db=-30.0))
    told = out.select("clip", "status", "processed_samples", "gain", F.col("input.max_abs").alias("input_max_abs"), F.col("input.rms").alias("input_rms"), F.col("output.max_abs").alias("output_max_abs"), F.col("output.rms").alias("output_rms"))
    return rounded(told, 6, "gain", "input_max_abs", "input_rms", "output_max_abs", "output_rms")


@query(f"WITH {PCM} SELECT clip, i // 5 AS chunk, i, round(x - coalesce(0.5 * lag(x) OVER (PARTITION BY clip ORDER BY i), 0), 6) + 0.0 AS x FROM pcm")
def chunked_emphasis(spark, sf_dir):
    return rounded(signal.chunked_pre_emphasis(pcm(spark, sf_dir).withColumn("chunk", F.expr("i div 5")), 0.5), 6, "x")


_FRAMES = f"{PCM}, fr AS (SELECT clip, i // 4 AS frame, sqrt(avg(x * x)) AS rms FROM pcm GROUP BY ALL HAVING count(*) = 4), th AS (SELECT *, greatest(avg(rms) OVER (PARTITION BY clip) * 1.0, 0.01) AS threshold FROM fr), sp AS (SELECT *, rms > threshold AS speech FROM th), ac AS (SELECT *, bool_or(speech) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS active FROM sp)"


@query(f"WITH {_FRAMES} SELECT clip, frame, round(rms, 6) AS rms, round(threshold, 6) AS threshold, speech, active FROM ac")
def vad_frames(spark, sf_dir):
    return rounded(signal.vad_frames(pcm(spark, sf_dir), _VAD), 6, "rms", "threshold")


@query(f"WITH {_FRAMES}, il AS (SELECT clip, frame, frame - row_number() OVER (PARTITION BY clip ORDER BY frame) AS island FROM ac WHERE active) SELECT clip, min(frame) AS start_frame, max(frame) + 1 AS end_frame FROM il GROUP BY clip, island")
def vad_segments(spark, sf_dir):
    return signal.vad_segments(pcm(spark, sf_dir), _VAD)


@query("""SELECT o_orderkey, CAST(CASE WHEN l = 0 THEN 0 WHEN l < 400 THEN 1 ELSE 1 + (l - 400 + 159) // 160 END AS BIGINT) AS cover, CAST(CASE WHEN l = 0 THEN 0 WHEN l < 400 THEN 1 ELSE (l + 159) // 160 END AS BIGINT) AS every_hop,
 CAST(CASE WHEN l < 400 THEN 0 ELSE 1 + (l - 400) // 160 END AS BIGINT) AS dropped,
 CAST(CASE WHEN l = 0 THEN 0 WHEN l < 400 THEN 1 ELSE 1 + (l - 400) // 160 + CASE WHEN l - (1 + (l - 400) // 160) * 160 > 0 THEN 1 ELSE 0 END END AS BIGINT) AS streamed FROM (SELECT o_orderkey, o_orderkey % 5000 AS l FROM orders)""")
def num_frames(spark, sf_dir):
    n = F.col("o_orderkey") % 5000
    kinds = {"cover": framing.COVER, "every_hop": framing.EVERY_HOP, "dropped": framing.DROP}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[framing.num_frames(n, 400, 160, p).alias(c) for c, p in kinds.items()], framing.streamed_frame_count(n, 400, 160).alias("streamed"))


def _count(policy: str, length: str) -> str:
    """SQL of the number of frames of 16 samples every 6."""
    n = {framing.COVER: f"1 + ({length} - 16 + 5) // 6", framing.EVERY_HOP: f"({length} + 5) // 6", framing.DROP: f"1 + ({length} - 16) // 6"}[policy]
    return f"CASE WHEN {length} < 16 THEN {0 if policy == framing.DROP else 1} ELSE {n} END"


def _framed(policy: str) -> str:
    return f"""WITH {PCM}, n AS (SELECT clip, {_count(policy, "count(*)")} AS frames FROM pcm GROUP BY clip), f AS (SELECT clip, unnest(range(CAST(frames AS BIGINT))) AS frame FROM n)
SELECT f.clip, frame, i - frame * 6 AS k, round(x, 6) + 0.0 AS x FROM f JOIN pcm ON pcm.clip = f.clip AND i >= frame * 6 AND i < frame * 6 + 16"""


def _frames(spark, sf_dir, policy):
    return rounded(framing.frame_rows(pcm(spark, sf_dir), framing.FrameOptions(16, 6, "none", policy)), 6, "x")


@query(_framed(framing.COVER))
def frame_cover(spark, sf_dir):
    return _frames(spark, sf_dir, framing.COVER)


@query(_framed(framing.EVERY_HOP))
def frame_every_hop(spark, sf_dir):
    return _frames(spark, sf_dir, framing.EVERY_HOP)


@query(_framed(framing.DROP))
def frame_drop(spark, sf_dir):
    return _frames(spark, sf_dir, framing.DROP)


@query(f"""WITH {PCM}, n AS (SELECT clip, count(*) AS l, {_count(framing.COVER, "count(*)")} AS frames FROM pcm GROUP BY clip), f AS (SELECT clip, l, unnest(range(CAST(frames AS BIGINT))) AS frame FROM n)
SELECT clip, frame, frame * 6 AS start_sample, frame * 6 + 16 AS end_sample, frame * 6 + 16 > l AS contains_padding FROM f""")
def frame_info(spark, sf_dir):
    return framing.frame_summary(pcm(spark, sf_dir), _SMALL)


def _windowed(kind: str) -> str:
    value = {"hamming": "0.54 - 0.46 * cos(2 * pi() * k / 399)", "hann": "0.5 * (1 - cos(2 * pi() * k / 399))"}[kind]
    return f"SELECT k, round({value}, 6) + 0.0 AS w FROM (SELECT unnest(range(400)) AS k)"


@query(_windowed("hamming"))
def window_hamming(spark, sf_dir):
    return rounded(spark.range(400).select(F.col("id").alias("k"), framing.window_value(F.col("id"), 400, "hamming").alias("w")), 6, "w")


@query(_windowed("hann"))
def window_hann(spark, sf_dir):
    return rounded(spark.range(400).select(F.col("id").alias("k"), framing.window_value(F.col("id"), 400, "hann").alias("w")), 6, "w")


@query(f"""WITH {VECTORS}, p AS (SELECT clip, frame, unnest(range(16)) AS k, samples FROM vectors)
SELECT clip, frame, CAST(k AS INTEGER) AS k, round(coalesce(samples[frame * 9 + k + 1], 0), 6) + 0.0 AS x FROM p""")
def create_frame(spark, sf_dir):
    frames = vectors(spark, sf_dir).select("clip", "frame", F.posexplode(framing.create_frame(F.col("samples"), F.col("frame") * 9, 16)).alias("k", "x"))
    return rounded(frames, 6, "x")


@query(f"""WITH {VECTORS}, p AS (SELECT clip, frame, unnest(range(64)) AS k, samples FROM vectors)
SELECT clip, frame, CAST(k AS INTEGER) AS k, round(samples[k + 1] * 0.5 * (1 - cos(2 * pi() * k / 63)), 6) + 0.0 AS x FROM p""")
def apply_window(spark, sf_dir):
    frames = vectors(spark, sf_dir).select("clip", "frame", F.posexplode(framing.apply_window(F.col("samples"), 64, "hann")).alias("k", "x"))
    return rounded(frames, 6, "x")


@query(f"""WITH {PCM}, n AS (SELECT clip, {_count(framing.COVER, "count(*)")} AS frames FROM pcm GROUP BY clip), f AS (SELECT clip, unnest(range(CAST(frames AS BIGINT))) AS frame FROM n)
SELECT f.clip, frame, round(sum(x * (0.54 - 0.46 * cos(2 * pi() * (i - frame * 6) / 15))), 6) + 0.0 AS total, count(*) AS n FROM f JOIN pcm ON pcm.clip = f.clip AND i >= frame * 6 AND i < frame * 6 + 16 GROUP BY f.clip, frame""")
def framed_windowed(spark, sf_dir):
    rows = framing.frame_rows(pcm(spark, sf_dir), framing.FrameOptions(16, 6, "hamming"))
    return rounded(rows.groupBy("clip", "frame").agg(F.sum("x").alias("total"), F.count("*").alias("n")), 6, "total")


@query("SELECT event_id, round(2595 * log10(1 + hz / 700), 5) AS mel, round(700 * (power(10, 2595 * log10(1 + hz / 700) / 2595) - 1), 5) AS back FROM (SELECT event_id, (event_id * 13 % 8000) * 1.0::DOUBLE AS hz FROM events)")
def hz_mel_htk(spark, sf_dir):
    hz = (F.col("event_id") * 13 % 8000).cast("double")
    mel = spectral.hz_to_mel_htk(hz)
    return rounded(table(spark, sf_dir, "events").select("event_id", mel.alias("mel"), spectral.mel_to_hz_htk(mel).alias("back")), 5, "mel", "back")


@query("""WITH t AS (SELECT event_id, (event_id * 13 % 8000) * 1.0::DOUBLE AS hz FROM events), m AS (SELECT event_id, CASE WHEN hz < 1000 THEN hz / (200.0::DOUBLE / 3) ELSE 15 + ln(hz / 1000) / (ln(6.4::DOUBLE) / 27) END AS mel FROM t)
SELECT event_id, round(mel, 5) AS mel, round(CASE WHEN mel < 15 THEN mel * (200.0::DOUBLE / 3) ELSE 1000 * exp((mel - 15) * (ln(6.4::DOUBLE) / 27)) END, 5) AS back FROM m""")
def hz_mel_slaney(spark, sf_dir):
    hz = (F.col("event_id") * 13 % 8000).cast("double")
    mel = spectral.hz_to_mel_slaney(hz)
    return rounded(table(spark, sf_dir, "events").select("event_id", mel.alias("mel"), spectral.mel_to_hz_slaney(mel).alias("back")), 5, "mel", "back")


_FFT = spectral.MelOptions(n_fft=64, n_mels=10, fmin=55.0, fmax=7600.0)
_EDGES = f"""edges AS (SELECT k, CASE WHEN m < 15 THEN m * (200.0::DOUBLE / 3) ELSE 1000 * exp((m - 15) * (ln(6.4::DOUBLE) / 27)) END AS f FROM
 (SELECT k, 55 / (200.0::DOUBLE / 3) + k * ((15 + ln(7.6::DOUBLE) / (ln(6.4::DOUBLE) / 27)) - 55 / (200.0::DOUBLE / 3)) / 11 AS m FROM (SELECT unnest(range(12)) AS k))),
bank AS (SELECT l.k AS mel, bin, greatest(0, least((bin * 250.0::DOUBLE - l.f) / (c.f - l.f), (r.f - bin * 250.0::DOUBLE) / (r.f - c.f))) * 2 / (r.f - l.f) AS weight
 FROM edges l JOIN edges c ON c.k = l.k + 1 JOIN edges r ON r.k = l.k + 2, (SELECT unnest(range(33)) AS bin))"""
_DFT = f"""{VECTORS}, smp AS (SELECT clip, frame, unnest(samples) AS x, unnest(range(64)) AS n FROM vectors), bins AS (SELECT unnest(range(33)) AS bin),
spec AS (SELECT clip, frame, bin, sqrt(power(sum(x * cos(2 * pi() * ((bin * n) % 64) / 64)), 2) + power(sum(x * sin(2 * pi() * ((bin * n) % 64) / 64)), 2)) AS magnitude FROM smp, bins GROUP BY ALL)"""


@query(f"WITH {_EDGES} SELECT CAST(mel AS INTEGER) AS mel, CAST(bin AS INTEGER) AS bin, round(weight, 8) AS weight FROM bank WHERE weight > 0")
def mel_filterbank(spark, sf_dir):
    return rounded(spectral.filter_table(spark, _FFT), 8, "weight")


@query(f"WITH {_DFT} SELECT clip, frame, CAST(bin AS INTEGER) AS bin, round(magnitude, 4) + 0.0 AS magnitude FROM spec")
def spectrum(spark, sf_dir):
    out = spectral.spectrum(vectors(spark, sf_dir), 64)
    return rounded(out.select("clip", "frame", F.posexplode("magnitude").alias("bin", "magnitude")), 4, "magnitude")


@query(f"""WITH {_DFT}, {_EDGES}, e AS (SELECT clip, frame, CAST(mel AS INTEGER) AS mel, sum(weight * magnitude) AS energy FROM spec JOIN bank USING (bin) WHERE weight > 0 GROUP BY ALL)
SELECT clip, frame, mel, round(greatest(-4, least(4, 8 * ((greatest(20 * log10(greatest(energy, 1e-5)) - 20, -100) + 100) / 100) - 4)), 4) + 0.0 AS value FROM e""")
def mel_symmetric(spark, sf_dir):
    energies = spectral.mel_energies(spectral.spectrum(vectors(spark, sf_dir), 64), _FFT)
    return rounded(energies.select("clip", "frame", "mel", spectral.symmetric_db(F.col("energy"), _FFT).alias("value")), 4, "value")


@query(f"""WITH {VECTORS}, v AS (SELECT clip, unnest(samples) AS v FROM vectors) SELECT clip, CAST(count(*) // 64 AS BIGINT) AS rows, round(min(v), 6) + 0.0 AS least, round(max(v), 6) + 0.0 AS most FROM v GROUP BY clip""")
def mel_info(spark, sf_dir):
    values = _mel_rows(spark, sf_dir).groupBy("clip").agg(F.count("*").alias("rows"), F.min(F.array_min("mel")).alias("least"), F.max(F.array_max("mel")).alias("most"))
    return rounded(values, 6, "least", "most")


def _mel_rows(spark, sf_dir):
    """Frames of 64 values as mel rows of as many bands."""
    return vectors(spark, sf_dir).select("clip", "frame", F.col("samples").alias("mel"))


def _chunk_sql(position: str) -> str:
    return f"""WITH {VECTORS}, c AS (SELECT a.clip, a.frame AS chunk, b.frame - a.frame AS t, b.samples AS mel FROM vectors a JOIN vectors b ON a.clip = b.clip AND b.frame BETWEEN a.frame AND a.frame + 3 JOIN (SELECT clip, max(frame) AS top FROM vectors GROUP BY clip) m ON m.clip = a.clip WHERE a.frame + 3 <= top),
v AS (SELECT clip, chunk, t, unnest(mel) AS value, unnest(range(64)) AS f FROM c)
SELECT clip, chunk, CAST({position} AS INTEGER) AS p, round(value, 6) + 0.0 AS value FROM v"""


def _chunks(spark, sf_dir, freq_major):
    out = framing.mel_chunks(_mel_rows(spark, sf_dir), 4, 1, freq_major)
    return rounded(out.select("clip", "chunk", F.posexplode("values").alias("p", "value")), 6, "value")


@query(_chunk_sql("f * 4 + t"))
def chunk_freq_major(spark, sf_dir):
    return _chunks(spark, sf_dir, True)


@query(_chunk_sql("t * 64 + f"))
def chunk_time_major(spark, sf_dir):
    return _chunks(spark, sf_dir, False)


@query(f"""WITH {VECTORS}, m AS (SELECT clip, count(*) AS total FROM vectors GROUP BY clip), t AS (SELECT clip, total, unnest(range(CAST((total * 25 + 79) // 80 + 1 AS BIGINT))) AS tick FROM m), w AS (SELECT clip, tick, total, tick * 80 // 25 AS start FROM t),
r AS (SELECT clip, tick, unnest(range(6)) AS t, least(CASE WHEN total >= 6 THEN greatest(0, least(start, total - 6)) ELSE 0 END + unnest(range(6)), total - 1) AS frame FROM w),
v AS (SELECT r.clip, tick, t, unnest(samples) AS v, unnest(range(64)) AS f FROM r JOIN vectors USING (clip, frame))
SELECT clip, CAST(tick AS INTEGER) AS tick, CAST(t AS INTEGER) AS t, CAST(f AS INTEGER) AS f, round(v, 6) + 0.0 AS v FROM v""")
def chunk_clamped(spark, sf_dir):
    from lumentide.functions.timestamps import mel_start

    mel = _mel_rows(spark, sf_dir)
    # as many ticks as a clip's rows last, and one behind its end
    lengths = mel.groupBy("clip").agg(F.count("*").alias("rows"))
    ticks = lengths.select("clip", F.explode(F.sequence(F.lit(0), F.expr("cast((rows * 25 + 79) div 80 as int)"))).alias("tick")).withColumn("start", mel_start(F.col("tick").cast("long"), 25))
    return rounded(framing.clamped_chunk_rows(ticks, mel, 6), 6, "v")


