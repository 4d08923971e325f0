"""Queries over requests, batches and whole jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumentide.functions import framing, signal, spectral
from lumentide.functions import timestamps as ts
from lumentide.operators import inference
from lumentide.operators.faces import BrightBox, DetectOptions, detect_faces
from lumentide.plans import metrics
from lumentide.plans.pipeline import video_chunks
from lumentide.plans.registry import PCM, pcm, query, rounded, table
from lumentide.plans.signal_queries import _EDGES
from lumentide.sources import media, writer

_EXT = "CASE l_partkey % 9 WHEN 0 THEN '.WAV' WHEN 1 THEN '.mp3' WHEN 2 THEN '.txt' WHEN 3 THEN '.Flac' WHEN 4 THEN '' WHEN 5 THEN '.m4a' WHEN 6 THEN '.wav.bak' WHEN 7 THEN '.mp4' ELSE '.AAC' END"
_PATH = f"'clips/' || CAST(l_orderkey AS VARCHAR(20)) || {_EXT}"
_OK_EXT = "lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('wav', 'mp3', 'aac', 'm4a', 'mp4', 'flac')"


@query(f"WITH p AS (SELECT l_orderkey, l_linenumber, {_PATH} AS path FROM lineitem) SELECT l_orderkey, l_linenumber, path FROM p WHERE {_OK_EXT}")
def ext_filter(spark, sf_dir):
    paths = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_PATH.replace('VARCHAR(20)', 'STRING')} AS path")
    return paths.where(media.has_extension(F.col("path")))


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE {_PATH} END AS path, l_partkey % 11 <> 0 AS found, l_partkey % 13 = 0 AS dir, CASE WHEN l_orderkey % 17 = 0 THEN 0 ELSE 16000 END AS rate, CASE WHEN l_orderkey % 19 = 0 THEN 2 ELSE 1 END AS ch FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN path = '' THEN 'kEmptyPath' WHEN rate <= 0 THEN 'kInvalidTargetSampleRate' WHEN ch <> 1 THEN 'kInvalidTargetChannels' WHEN NOT found THEN 'kFileNotFound' WHEN dir THEN 'kPathIsDirectory' WHEN NOT ({_OK_EXT}) THEN 'kUnsupportedFormat' ELSE 'kOk' END AS status FROM p""")
def path_validation(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE {_PATH.replace('VARCHAR(20)', 'STRING')} END AS path", "l_partkey % 11 <> 0 AS found", "l_partkey % 13 = 0 AS dir",
        "CASE WHEN l_orderkey % 17 = 0 THEN 0 ELSE 16000 END AS rate", "CASE WHEN l_orderkey % 19 = 0 THEN 2 ELSE 1 END AS ch",
    )
    return p.select("l_orderkey", "l_linenumber", media.path_status(*map(F.col, ("path", "found", "dir", "rate", "ch"))).alias("status"))


_FIRST = "CASE l_partkey % 5 WHEN 0 THEN 'kExtractFailed' WHEN 1 THEN 'kOutputEmpty' WHEN 2 THEN 'kTaskException' ELSE 'kOk' END"
_SECOND = "CASE l_suppkey % 3 WHEN 0 THEN 'kExtractFailed' WHEN 1 THEN 'kOk' ELSE 'kTaskException' END"


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, {_FIRST} AS a, {_SECOND} AS b FROM lineitem), r AS (SELECT *, a IN ('kExtractFailed', 'kOutputEmpty') AS again FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN NOT again THEN a WHEN b IN ('kExtractFailed', 'kOutputEmpty') THEN 'kRetryExhausted' ELSE b END AS status, CASE WHEN again THEN 2 ELSE 1 END AS attempts, again AND b = 'kOk' AS recovered, CASE WHEN a <> 'kOk' THEN a END AS first_failure FROM r""")
def retry_outcome(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_FIRST} AS a", f"{_SECOND} AS b")
    return t.select("l_orderkey", "l_linenumber", inference.retry_outcome(F.col("a"), F.col("b")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


_STATUS = "CASE WHEN l_orderkey % 4 = 0 THEN 'kOk' WHEN l_orderkey % 4 = 1 THEN 'kTaskException' WHEN l_linenumber % 3 = 0 THEN 'kQueueWaitTimeout' WHEN l_linenumber % 5 = 0 THEN 'kEngineStopping' ELSE 'kOk' END"


@query(f"""WITH t AS (SELECT l_orderkey AS batch, {_STATUS} AS status, l_partkey % 7 = 0 AS recovered, CAST(l_linenumber * 10 AS BIGINT) AS a, CAST(l_linenumber * 10 + l_suppkey % 10 AS BIGINT) AS b FROM lineitem),
g AS (SELECT batch, count(*) AS total, count(*) FILTER (status NOT IN ('kQueueWaitTimeout', 'kEngineStopping', 'kEngineNotRunning')) AS accepted, count(*) FILTER (status = 'kOk') AS success, count(*) FILTER (status <> 'kOk') AS failure,
 count(*) FILTER (status = 'kQueueWaitTimeout') AS timeout, count(*) FILTER (status = 'kEngineStopping') AS rejected, count(*) FILTER (status = 'kTaskException') AS exception, count(*) FILTER (recovered) AS recovered, max(b) - min(a) AS makespan_ms FROM t GROUP BY batch)
SELECT *, round(CASE WHEN makespan_ms > 0 THEN total * 1000.0::DOUBLE / makespan_ms ELSE 0.0 END, 6) AS throughput, CASE WHEN success = total THEN 'kOk' WHEN success = 0 THEN 'kAllFailed' ELSE 'kPartialFailure' END AS status FROM g""")
def batch_summary(spark, sf_dir):
    results = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch"), F.expr(_STATUS).alias("status"), (F.col("l_partkey") % 7 == 0).alias("recovered"),
        (F.col("l_linenumber") * 10).cast("long").alias("start_ms"), (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).cast("long").alias("end_ms"),
    )
    return rounded(inference.batch_summary(results, "batch"), 6, "throughput")


@query(f"WITH b AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (({_STATUS}) = 'kOk') AS success FROM lineitem GROUP BY l_orderkey), s AS (SELECT CASE WHEN success = total THEN 'kOk' WHEN success = 0 THEN 'kAllFailed' ELSE 'kPartialFailure' END AS status FROM b) SELECT status, count(*) AS batches FROM s GROUP BY status")
def batch_status(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total"), F.sum((F.expr(_STATUS) == "kOk").cast("long")).alias("success"))
    return counts.select(inference.batch_status(F.col("total"), F.col("success")).alias("status")).groupBy("status").agg(F.count("*").alias("batches"))


@query("""WITH runs AS (SELECT o_orderpriority AS config, o_orderkey % 500 + 1 AS frames, o_totalprice AS wall_ms, o_totalprice / 3 AS infer_ms, o_orderstatus <> 'P' AS ok FROM orders)
SELECT config, count(*) AS runs, count(*) FILTER (ok) AS successful, round(avg(frames * 1000.0::DOUBLE / wall_ms) FILTER (ok), 6) AS avg_fps, round(min(frames * 1000.0::DOUBLE / wall_ms) FILTER (ok), 6) AS min_fps, round(max(frames * 1000.0::DOUBLE / wall_ms) FILTER (ok), 6) AS max_fps,
 round(avg(infer_ms / frames) FILTER (ok), 4) AS avg_inference_ms FROM runs GROUP BY config""")
def benchmark_summary(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("config"), (F.col("o_orderkey") % 500 + 1).alias("frames"), F.col("o_totalprice").alias("wall_ms"), (F.col("o_totalprice") / 3).alias("infer_ms"), (F.col("o_orderstatus") != "P").alias("ok"))
    return rounded(rounded(metrics.run_summary(runs, "config"), 6, "avg_fps", "min_fps", "max_fps"), 4, "avg_inference_ms")


@query("SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS h2d_ms, CAST(sum(l_partkey % 10) AS BIGINT) AS forward_ms, max(l_suppkey) AS peak_memory FROM lineitem GROUP BY l_orderkey")
def stage_counters(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("h2d_ms"), (F.col("l_partkey") % 10).alias("forward_ms"), F.col("l_suppkey").alias("peak_memory"))
    return metrics.stage_sums(steps, "l_orderkey")


@query("""WITH f AS (SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS n, CASE WHEN l_partkey % 31 = 0 THEN 0 WHEN l_partkey % 29 = 0 THEN 641 ELSE 640 END AS w FROM lineitem WHERE l_orderkey % 10 <> 9),
e AS (SELECT job_id, bool_or(w <= 0 OR w <> w0) OVER (PARTITION BY job_id ORDER BY n RANGE UNBOUNDED PRECEDING) AS wrong FROM (SELECT *, first(w) OVER (PARTITION BY job_id ORDER BY n) AS w0 FROM f)),
g AS (SELECT job_id, bool_or(wrong) AS wrong, count(*) FILTER (NOT wrong) AS written FROM e GROUP BY job_id), t AS (SELECT o_orderkey AS job_id, CASE o_orderkey % 7 WHEN 1 THEN 'kFailed' WHEN 2 THEN 'kCancelled' ELSE 'kSucceeded' END AS state FROM orders)
SELECT job_id, state, CASE WHEN wrong THEN 'kInvalidFrameDimensions' ELSE 'kOk' END AS error, coalesce(written, 0) AS written_frames, state = 'kSucceeded' AND NOT coalesce(wrong, false) AND coalesce(written, 0) > 0 AS committed FROM t LEFT JOIN g USING (job_id)""")
def finalised_jobs(spark, sf_dir):
    """Jobs of which some fail, some have a frame of no or another size, and some have none."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 10 <> 9")
    frames = lines.select(F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") * F.lit(1_000_000_000).cast("long") + F.col("l_partkey")).alias("n"), F.when(F.col("l_partkey") % 31 == 0, 0).when(F.col("l_partkey") % 29 == 0, 641).otherwise(640).alias("width"), F.lit(480).alias("height"))
    key = F.col("o_orderkey")
    terminals = table(spark, sf_dir, "orders").select(key.alias("job_id"), F.when(key % 7 == 1, "kFailed").when(key % 7 == 2, "kCancelled").otherwise("kSucceeded").alias("state"))
    return writer.finalised(frames, terminals)


@query("""WITH v AS (SELECT o_orderkey, o_orderkey % 3 > 0 AS p, CASE WHEN o_orderkey % 5 = 0 THEN 'kFlushFailed' ELSE 'kOk' END AS w, o_orderkey % 7 > 0 AS f, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 4 END AS size FROM orders), g AS (SELECT *, p AND w = 'kOk' AND f AND coalesce(size, 0) > 0 AS good FROM v)
SELECT o_orderkey, CASE WHEN good THEN 'success' ELSE 'error' END AS status, CASE WHEN good THEN 0 ELSE 1 END AS exit_code, CASE WHEN good THEN NULL WHEN p THEN 'WriterOutputInvalid' ELSE 'kInferenceFailed' END AS error_code,
 CASE WHEN good THEN NULL WHEN NOT p THEN 'pipeline' WHEN w <> 'kOk' THEN 'writer' WHEN NOT f THEN 'not finalized' WHEN size IS NULL THEN 'missing file' ELSE 'empty file' END AS cause FROM g""")
def run_outcome(spark, sf_dir):
    key = F.col("o_orderkey")
    told = writer.outcome(key % 3 > 0, F.lit("kInferenceFailed"), F.when(key % 5 == 0, "kFlushFailed").otherwise("kOk"), key % 7 > 0, F.when(key % 11 != 0, key % 4))
    return table(spark, sf_dir, "orders").select("o_orderkey", told.alias("r")).select("o_orderkey", "r.*")


@query("""SELECT o_orderkey AS job_id, '{"schema_version":1,"success":' || CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END || ',"frames":' || o_custkey || ',"note":"a\\"b"}' AS json FROM orders""")
def job_json(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderstatus") == "O").alias("success"), F.col("o_custkey").alias("frames"), F.lit('a"b').alias("note"))
    return media.job_json(jobs)


def _mel_inputs(spark, sf_dir):
    """Each vector told out to a mel chunk; some are too short or missing."""
    mel = F.flatten(F.array_repeat(F.col("embedding"), 20))
    vec = table(spark, sf_dir, "embeddings")
    return vec.select("vec_id", F.when(F.col("vec_id") % 10 == 3, F.slice(mel, 1, 7)).when(F.col("vec_id") % 10 != 7, mel).alias("mel"))


def _job():
    registry = inference.ModelRegistry()
    registry.publish(inference.StandIn())
    return registry, (np.arange(inference.FACE) % 251 / 250).astype(np.float32)


_MODEL = """face AS (SELECT unnest(range(27648)) AS p), level AS (SELECT p // 9216 AS c, p % 9216 // 96 AS y, p % 96 AS x, CAST((p + 27648) % 251 / 250.0::DOUBLE AS FLOAT) AS v FROM face),
inputs AS (SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN 'kInvalidMelShape' WHEN vec_id % 10 = 7 THEN 'kEmptyMelInput' ELSE 'kOk' END AS status, greatest(0, least(1, 0.5 + list_avg(CAST(embedding AS DOUBLE[])) / 8)) AS k FROM embeddings)"""


@query(f"""WITH {_MODEL}, sums AS (SELECT sum(v) FILTER (y < 48) AS top, sum(v) FILTER (y >= 48) AS low FROM level)
SELECT vec_id, status, CASE WHEN status = 'kOk' THEN 1 ELSE 0 END AS attempts, false AS recovered, 1::BIGINT AS model_generation, round(CASE WHEN status = 'kOk' THEN top + low * k ELSE 0 END, 1) + 0.0 AS total FROM inputs, sums""")
def infer_stand_in(spark, sf_dir):
    """Inputs good and bad through guards and the stand-in model, with one face for the job."""
    registry, face = _job()
    out = inference.infer(_mel_inputs(spark, sf_dir), registry, face=face)
    return out.select("vec_id", "status", "attempts", "recovered", "model_generation", F.round(F.aggregate(F.coalesce("pred", F.array().cast("array<float>")), F.lit(0.0), lambda s, v: s + v), 1).alias("total"))


@query(f"""WITH {_MODEL}, k AS (SELECT DISTINCT status, CAST(k AS FLOAT) AS k FROM inputs WHERE status = 'kOk'),
g AS (SELECT k, y, x, round_even(0.114 * b + 0.587 * g + 0.299 * r, 0) AS v FROM (SELECT k, y, x, max(l) FILTER (c = 0) AS b, max(l) FILTER (c = 1) AS g, max(l) FILTER (c = 2) AS r FROM (SELECT k, c, y, x, floor(CAST(CASE WHEN y < 48 THEN v ELSE v * k END AS DOUBLE) * 255 + 0.5) AS l FROM level, k) GROUP BY ALL)),
w AS (SELECT k, v, x, y, lag(v) OVER r AS le, lead(v) OVER r AS ri, lag(v) OVER c AS up, lead(v) OVER c AS dn FROM g WINDOW r AS (PARTITION BY k, y ORDER BY x), c AS (PARTITION BY k, x ORDER BY y)),
s AS (SELECT k, var_pop(coalesce(le, ri) + coalesce(ri, le) + coalesce(up, dn) + coalesce(dn, up) - 4 * v) AS s FROM w GROUP BY k)
SELECT vec_id, status, CASE WHEN status = 'kOk' THEN 0 END AS corrected, round(s, 1) AS sharpness, s >= 10 AS sharp, CASE WHEN status = 'kOk' THEN 27648 END AS bytes FROM inputs LEFT JOIN s ON s.k = CAST(inputs.k AS FLOAT) AND status = 'kOk'""")
def infer_images(spark, sf_dir):
    """The same, converted in the worker: levels, corrections and sharpness."""
    registry, face = _job()
    out = inference.infer(_mel_inputs(spark, sf_dir), registry, face=face, images=True, least_sharpness=10.0)
    return out.select("vec_id", "status", "corrected", F.round("sharpness", 1).alias("sharpness"), "sharp", F.length("image").alias("bytes"))


@query("""WITH v AS (SELECT vec_id, vec_id % 20 * 7 AS w FROM embeddings), s AS (SELECT vec_id, w, CASE WHEN vec_id % 8 = 5 THEN 'kDecodeFailed' WHEN w = 0 THEN 'kNoFace' WHEN w < 64 THEN 'kFaceTooSmall' ELSE 'kOk' END AS status FROM v)
SELECT 'v' || vec_id AS image, CASE WHEN status IN ('kOk', 'kFaceTooSmall') THEN 0 END AS face, status, CASE WHEN status IN ('kOk', 'kFaceTooSmall') THEN 20 END AS x, CASE WHEN status IN ('kOk', 'kFaceTooSmall') THEN 30 END AS y, CAST(CASE WHEN status IN ('kOk', 'kFaceTooSmall') THEN w END AS INTEGER) AS w, CASE WHEN status IN ('kOk', 'kFaceTooSmall') THEN 90 END AS h,
 CASE WHEN status = 'kOk' THEN 68 END AS points, CASE WHEN status = 'kOk' THEN 1.0::DOUBLE END AS score FROM s""")
def face_detection(spark, sf_dir):
    """Images of one bright box each through detection, landmarks and their guards."""
    side = 160
    wide = F.col("vec_id") % 20 * 7
    cells = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.when((k % side >= 20) & (k % side < 20 + wide) & (k / side >= 30) & (k / side < 120), "FF").otherwise("10"))
    images = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id")).alias("path"), F.when(F.col("vec_id") % 8 == 5, "kDecodeFailed").otherwise("kOk").alias("status"),
        F.lit(side).alias("width"), F.lit(side).alias("height"), F.lit(1).alias("channels"), F.unhex(F.array_join(cells, "")).alias("data"),
    )
    found = detect_faces(images, BrightBox(), DetectOptions(least_width=side))
    return found.select("image", "face", "status", "x", "y", "w", "h", F.when(F.col("points").isNotNull(), F.size("points")).alias("points"), F.round("score", 3).alias("score"))


@query(f"""WITH {PCM}, em AS (SELECT clip, i, x - coalesce(0.97 * lag(x) OVER (PARTITION BY clip ORDER BY i), 0) AS x FROM pcm), n AS (SELECT clip, count(*) AS l, CASE WHEN count(*) < 16 THEN 1 ELSE 1 + (count(*) - 16 + 3) // 4 END AS frames FROM pcm GROUP BY clip),
f AS (SELECT clip, unnest(range(CAST(frames AS BIGINT))) AS frame FROM n), smp AS (SELECT f.clip, frame, i - frame * 4 AS k, x * 0.5 * (1 - cos(2 * pi() * (i - frame * 4) / 15)) AS x FROM f JOIN em ON em.clip = f.clip AND i >= frame * 4 AND i < frame * 4 + 16),
spec AS (SELECT clip, frame, bin, sqrt(power(sum(x * cos(2 * pi() * ((bin * k) % 64) / 64)), 2) + power(sum(x * sin(2 * pi() * ((bin * k) % 64) / 64)), 2)) AS magnitude FROM smp, (SELECT unnest(range(33)) AS bin) GROUP BY ALL), {_EDGES},
e AS (SELECT clip, frame, mel, sum(weight * magnitude) AS energy FROM spec JOIN bank USING (bin) WHERE weight > 0 GROUP BY ALL), m AS (SELECT clip, frame, mel, greatest(-4, least(4, 8 * ((greatest(20 * log10(greatest(energy, 1e-5)) - 20, -100) + 100) / 100) - 4)) AS v FROM e),
t AS (SELECT clip, frames AS total, unnest(range(CAST((l * 25 + 99) // 100 AS BIGINT))) AS tick FROM n), w AS (SELECT clip, tick, total, CASE WHEN total >= 4 THEN greatest(0, least(tick * 80 // 25, total - 4)) ELSE 0 END AS start FROM t), c AS (SELECT clip, tick, total, start, unnest(range(4)) AS t FROM w),
v AS (SELECT c.clip, tick, mel * 4 + t AS p, v FROM c JOIN m ON m.clip = c.clip AND m.frame = least(start + t, total - 1))
SELECT clip, tick, tick * 40000 AS pts_us, CAST(p AS INTEGER) AS p, round(v, 4) + 0.0 AS value FROM v""")
def lip_sync_frames(spark, sf_dir):
    """A whole job for each clip: samples, emphasis, frames, spectra, mel, chunks on the video's ticks."""
    mel = spectral.MelOptions(n_fft=64, n_mels=10, fmax=7600.0)
    out = video_chunks(pcm(spark, sf_dir), framing.FrameOptions(16, 4, "hann"), mel, signal.PreprocessOptions(normalize=False), rate=100, numerator=25, rows=4)
    return rounded(out.select("clip", "tick", "pts_us", F.posexplode("values").alias("p", "value")), 4, "value")


@query("SELECT o_orderkey, CAST((o_orderkey * 40000) AS BIGINT) AS pts_us FROM orders")
def video_pts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", ts.video_index_to_us(F.col("o_orderkey"), F.lit(25), F.lit(1))["microseconds"].alias("pts_us"))
