"""Queries over timestamps, ordering and synchronisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentide.functions import sync
from lumentide.functions import timestamps as ts
from lumentide.operators.fold import fold
from lumentide.operators.scheduling import FrameScheduler, MelChunker, Playback, RingBuffer, StreamEmphasis, StreamFramer, TaskQueue
from lumentide.plans.registry import FRAMES, query, rounded, table, video_frames

_INDEX = "CASE WHEN event_id % 7 = 0 THEN -event_id - 1 WHEN event_id % 11 = 0 THEN 9223372036854775807 - event_id ELSE event_id * 92233720368 END"
_RATE = "CASE event_id % 5 WHEN 0 THEN 16000 WHEN 1 THEN 44100 WHEN 2 THEN 48000 WHEN 3 THEN 0 ELSE 22050 END"
_NUM = "CASE event_id % 4 WHEN 0 THEN 25 WHEN 1 THEN 30000 WHEN 2 THEN 24000 ELSE 0 END"
_DEN = "CASE event_id % 4 WHEN 0 THEN 1 ELSE 1001 END"


def _rational(twice: str, divisor: str, bad: str) -> str:
    """SQL of status and microseconds for twice / (2 * divisor), rounded half away from zero."""
    return f"""SELECT event_id, CASE WHEN i < 0 THEN 'kNegativeIndex' WHEN {divisor} <= 0 THEN '{bad}' WHEN ({twice} + {divisor}) // (2 * {divisor}) > 9223372036854775807 THEN 'kOverflow' ELSE 'kOk' END AS status,
      CASE WHEN i >= 0 AND {divisor} > 0 AND ({twice} + {divisor}) // (2 * {divisor}) <= 9223372036854775807 THEN CAST(({twice} + {divisor}) // (2 * {divisor}) AS BIGINT) ELSE -1 END AS microseconds FROM t"""


@query(f"WITH t AS (SELECT event_id, CAST({_INDEX} AS HUGEINT) AS i, CAST({_RATE} AS HUGEINT) AS d FROM events) " + _rational("i * 2000000", "d", "kInvalidSampleRate"))
def ts_audio_us(spark, sf_dir):
    t = table(spark, sf_dir, "events").selectExpr("event_id", f"{_INDEX} AS i", f"{_RATE} AS d")
    return t.select("event_id", ts.audio_index_to_us(F.col("i"), F.col("d")).alias("r")).select("event_id", "r.status", F.coalesce("r.microseconds", F.lit(-1)).alias("microseconds"))


@query(f"WITH t AS (SELECT event_id, CAST({_INDEX} AS HUGEINT) AS i, CAST({_NUM} AS HUGEINT) AS d, CAST({_DEN} AS HUGEINT) AS q FROM events) " + _rational("i * q * 2000000", "d", "kInvalidFrameRate"))
def ts_video_us(spark, sf_dir):
    t = table(spark, sf_dir, "events").selectExpr("event_id", f"{_INDEX} AS i", f"{_NUM} AS n", f"{_DEN} AS d")
    return t.select("event_id", ts.video_index_to_us(F.col("i"), F.col("n"), F.col("d")).alias("r")).select("event_id", "r.status", F.coalesce("r.microseconds", F.lit(-1)).alias("microseconds"))


@query(f"""WITH t AS (SELECT event_id, {_INDEX} AS i FROM events)
SELECT event_id, CASE WHEN i < 0 THEN 'kNegativeTimestamp' WHEN i > 9223372036854775 THEN 'kOverflow' ELSE 'kOk' END AS status, CASE WHEN i BETWEEN 0 AND 9223372036854775 THEN i * 1000 ELSE -1 END AS microseconds FROM t""")
def ts_ms_guard(spark, sf_dir):
    t = table(spark, sf_dir, "events").selectExpr("event_id", f"{_INDEX} AS i")
    return t.select("event_id", ts.milliseconds_to_us(F.col("i")).alias("r")).select("event_id", "r.status", F.coalesce("r.microseconds", F.lit(-1)).alias("microseconds"))


_TIMES = "(event_id * 7919) % 100000 - 500"
_ORIGIN = "(event_id * 104729) % 60000 - 200"


@query(f"""WITH t AS (SELECT event_id, {_TIMES} AS a, {_ORIGIN} AS o FROM events)
SELECT event_id, CASE WHEN a < 0 OR o < 0 THEN 'kNegativeTimestamp' WHEN o > a THEN 'kOriginAfterTimestamp' ELSE 'kOk' END AS status, CASE WHEN a >= 0 AND o >= 0 AND o <= a THEN a - o ELSE -1 END AS microseconds FROM t""")
def ts_normalize(spark, sf_dir):
    t = table(spark, sf_dir, "events").selectExpr("event_id", f"{_TIMES} AS a", f"{_ORIGIN} AS o")
    return t.select("event_id", ts.normalize_us(F.col("a"), F.col("o")).alias("r")).select("event_id", "r.status", F.coalesce("r.microseconds", F.lit(-1)).alias("microseconds"))


@query(f"WITH t AS (SELECT event_id, {_TIMES} - 40000 AS a FROM events) SELECT event_id, CAST(CASE WHEN a >= 0 THEN (a + 500) // 1000 ELSE -((-a + 500) // 1000) END AS BIGINT) AS ms FROM t")
def ts_to_ms(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_TIMES} - 40000 AS a").select("event_id", ts.us_to_milliseconds(F.col("a")).alias("ms"))


@query(f"SELECT event_id, ({_TIMES}) - ({_ORIGIN}) AS diff_us FROM events")
def ts_diff(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{_TIMES} AS a", f"{_ORIGIN} AS b").select("event_id", ts.difference_us(F.col("a"), F.col("b")).alias("diff_us"))


@query("SELECT event_id, round(event_id / 16000.0 * 1000.0, 6) AS start_ms, CAST(floor(event_id / 7.0 * 1e6 + 0.5) AS BIGINT) AS anchor_us FROM events")
def ts_sample_ms(spark, sf_dir):
    t = table(spark, sf_dir, "events")
    return t.select("event_id", F.round(ts.sample_to_ms(F.col("event_id"), F.lit(16000.0)), 6).alias("start_ms"), ts.seconds_to_us(F.col("event_id") / 7.0).alias("anchor_us"))


_WOBBLE = FRAMES.replace("AS pts, value", "+ (event_id * 7919) % 5000000000 AS pts, value")


@query(f"WITH {_WOBBLE}, t AS (SELECT *, lag(pts) OVER (PARTITION BY stream ORDER BY n) AS before FROM frames) SELECT stream, n, CASE WHEN pts < before THEN 'kNonMonotonic' ELSE 'kOk' END AS status FROM t")
def pts_monotonic_check(spark, sf_dir):
    from pyspark.sql import Window

    frames = video_frames(spark, sf_dir).withColumn("pts", F.col("pts") + (F.col("arrival") * 7919) % 5_000_000_000)
    before = F.lag("pts").over(Window.partitionBy("stream").orderBy("n"))
    return frames.select("stream", "n", ts.monotonic_status(before, F.col("pts")).alias("status"))


@query(f"WITH {FRAMES}, t AS (SELECT stream, n, CAST(floor(value) AS BIGINT) % 40 + n // 2 AS pts FROM frames) SELECT stream, n, n + greatest(0, max(pts - n) OVER (PARTITION BY stream ORDER BY n ROWS UNBOUNDED PRECEDING)) AS out_pts FROM t")
def pts_clamp(spark, sf_dir):
    frames = video_frames(spark, sf_dir).withColumn("pts", F.floor("value") % 40 + F.expr("n div 2"))
    return sync.clamped_pts(frames).select("stream", "n", "out_pts")


@query(f"WITH {FRAMES}, t AS (SELECT stream, arrival, CAST(floor(value) AS BIGINT) % 10 AS pts FROM frames) SELECT stream, pts, min(arrival) AS arrival FROM t GROUP BY stream, pts")
def pts_dedupe(spark, sf_dir):
    return sync.first_of_each_pts(video_frames(spark, sf_dir).select("stream", "arrival", (F.floor("value") % 10).alias("pts")))


@query(f"WITH {FRAMES}, t AS (SELECT stream, arrival, CAST(floor(value) AS BIGINT) AS pts FROM frames), m AS (SELECT *, max(pts) OVER (PARTITION BY stream ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM t) SELECT stream, arrival, pts FROM m WHERE top IS NULL OR pts > top")
def pts_strictly_newer(spark, sf_dir):
    return sync.strictly_newer(video_frames(spark, sf_dir).select("stream", "arrival", F.floor("value").alias("pts")))


@query("SELECT o_orderkey, CAST((o_orderkey * 37 * 30000 + 16000 * 1001 - 1) // (16000 * 1001) AS BIGINT) AS frames FROM orders")
def frame_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", ts.frame_count(F.col("o_orderkey") * 37, 16000, 30000, 1001).alias("frames"))


@query("SELECT o_orderkey, CAST(o_orderkey * 80 // 25 AS BIGINT) AS pal, CAST(o_orderkey * 80 * 1001 // 30000 AS BIGINT) AS ntsc FROM orders")
def mel_start(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key, ts.mel_start(key, 25).alias("pal"), ts.mel_start(key, 30000, 1001).alias("ntsc"))


_PLAYED = "event_id * 3 AS anchor, (event_id * 7919) % 900000 - 1000 AS a_us, (event_id * 104729) % 2000000 AS now, event_id % 9 * 8000 AS rate, event_id * 4 AS sub, event_id * 3 + 20000 AS total, event_id * 2 AS last"


@query(f"""WITH t AS (SELECT event_id, {_PLAYED} FROM events)
SELECT event_id, CASE WHEN rate > 0 AND a_us >= 0 AND now >= a_us THEN least(greatest(least(last, sub, total), anchor + (now - a_us) * rate // 1000000), least(sub, total)) ELSE least(last, sub, total) END AS frame FROM t""")
def played_frame(spark, sf_dir):
    t = table(spark, sf_dir, "events").selectExpr("event_id", *_PLAYED.split(", "))
    return t.select("event_id", sync.played_frame(*map(F.col, ("anchor", "a_us", "now", "rate", "sub", "total", "last"))).alias("frame"))


@query(f"""WITH {FRAMES}, f AS (SELECT stream, pts // 1000000 AS pts FROM frames), t AS (SELECT stream, CAST(unnest(range(0, 40)) * 60000 AS BIGINT) AS ref FROM (SELECT DISTINCT stream FROM frames)),
m AS (SELECT stream, ref, (SELECT max(pts) FROM f WHERE f.stream = t.stream AND f.pts - 20000 <= t.ref) AS pts FROM t)
SELECT stream, ref, pts, pts - ref AS diff_us, CASE WHEN pts IS NULL THEN 'kBufferingNoFrame' WHEN pts - ref < -20000 THEN 'kLate' ELSE 'kDeliver' END AS action FROM m""")
def sync_asof(spark, sf_dir):
    frames = video_frames(spark, sf_dir).select("stream", F.expr("pts div 1000000").alias("pts"))
    ticks = frames.select("stream").distinct().withColumn("ref", F.explode(F.expr("transform(sequence(0, 39), k -> k * 60000L)")))
    return sync.nearest_frames(ticks, frames, 20_000)


@query("""SELECT o_orderkey, greatest(0, least(512, o_custkey * 40 - o_orderkey)) AS copied, 512 - greatest(0, least(512, o_custkey * 40 - o_orderkey)) AS silent, o_orderkey + greatest(0, least(512, o_custkey * 40 - o_orderkey)) >= o_custkey * 40 AS complete FROM orders""")
def callback_copy(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", sync.callback_copy(F.col("o_orderkey"), F.lit(512).cast("long"), F.col("o_custkey") * 40).alias("r")).select("o_orderkey", "r.*")


@query("""WITH c AS (SELECT o_orderkey AS clip, o_orderkey % 3000 AS length FROM orders), b AS (SELECT clip, length, unnest(range((length + 1023) // 1024)) AS block FROM c)
SELECT clip, block, block * 1024 AS start, least(1024, length - block * 1024) AS length FROM b""")
def audio_blocks(spark, sf_dir):
    return sync.audio_blocks(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip"), (F.col("o_orderkey") % 3000).alias("length")), 1024)


@query("SELECT o_orderkey, o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 AND o_orderkey % 13 > 0 AND o_orderstatus <> 'P' AS valid FROM orders")
def writer_config(spark, sf_dir):
    k = F.col("o_orderkey")
    path = F.when(F.col("o_orderstatus") != "P", "out.mp4").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", sync.writer_valid(k % 3, k % 5, k % 7, k % 11, k % 13, path).alias("valid"))


def scheduler_log(spark, sf_dir):
    """Each user's events as pushes, every third also a tick of the reference clock."""
    frames = video_frames(spark, sf_dir).withColumn("us", F.col("n") * 40_000)
    pushes = frames.select("stream", (F.col("n") * 2).alias("seq"), F.lit("push").alias("op"), (F.col("us") + F.floor("value") % 5 * 40_000 - 40_000).alias("pts"), F.col("n").alias("frame_index"), F.lit(None).cast("long").alias("ref"))
    ticks = frames.where("n % 3 = 2").select("stream", (F.col("n") * 2 + 1).alias("seq"), F.lit("schedule").alias("op"), F.lit(None).cast("long").alias("pts"), F.lit(None).cast("long").alias("frame_index"), F.when(F.col("n") % 10 != 9, F.col("us") - 20_000).alias("ref"))
    return pushes.unionByName(ticks)


_LOG = f"""{FRAMES}, us AS (SELECT *, n * 40000 AS us FROM frames), log0 AS (
 SELECT stream, n * 2 AS seq, us + CAST(floor(value) AS BIGINT) % 5 * 40000 - 40000 AS pts, n AS idx, NULL::BIGINT AS ref, true AS push FROM us
 UNION ALL SELECT stream, n * 2 + 1, NULL, NULL, CASE WHEN n % 10 <> 9 THEN us - 20000 END, false FROM us WHERE n % 3 = 2),
log AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq) AS r FROM log0)"""


@query(f"""WITH RECURSIVE {_LOG}, run AS (
 SELECT DISTINCT stream, 0::BIGINT AS r, 0::BIGINT AS seq, []::STRUCT(p BIGINT, i BIGINT)[] AS q, NULL::STRUCT(p BIGINT, i BIGINT) AS last, NULL::BIGINT AS ref, false AS running, '' AS result, NULL::STRUCT(p BIGINT, i BIGINT) AS frame, NULL::BIGINT AS diff, 0::BIGINT AS dropped FROM log
 UNION ALL
 SELECT stream, r, seq, CASE WHEN taken THEN q2[2:] ELSE q2 END, CASE WHEN taken THEN q2[1] ELSE last END, ref2, CASE WHEN taken THEN true WHEN ticks AND len(q2) = 0 THEN false ELSE running END,
  CASE WHEN push THEN kind WHEN kind <> '' THEN kind WHEN taken THEN CASE WHEN dropped2 > 0 THEN 'kDropAndDeliver' ELSE 'kDeliver' END WHEN last IS NULL THEN 'kBufferingNoFrame' ELSE 'kRepeatLast' END,
  CASE WHEN push THEN CASE WHEN kind IN ('kAccepted', 'kDroppedOldest') THEN own END WHEN kind <> '' THEN NULL WHEN taken THEN q2[1] ELSE last END,
  CASE WHEN ticks AND len(q2) > 0 THEN q2[1].p - ref2 END, dropped2
 FROM (SELECT *, ticks AND len(q2) > 0 AND q2[1].p - ref2 <= 20000 AS taken, CASE WHEN push THEN CASE WHEN kind = 'kDroppedOldest' THEN 1 ELSE 0 END ELSE len(q) - len(q2) END AS dropped2 FROM (
  SELECT *, CASE WHEN kind = 'kAccepted' THEN list_sort(list_append(q, own)) WHEN kind = 'kDroppedOldest' THEN list_sort(list_append(q[2:], own)) WHEN ticks THEN list_filter(q, lambda x: x.p - ref2 >= -20000) ELSE q END AS q2 FROM (
   SELECT *, NOT push AND kind = '' AND (running OR len(q) >= 2) AS ticks, CASE WHEN NOT push AND kind = '' THEN now ELSE ref END AS ref2 FROM (
    SELECT l.stream, l.r, l.seq, q, last, run.ref, l.ref AS now, running, push, {{'p': l.pts, 'i': l.idx}}::STRUCT(p BIGINT, i BIGINT) AS own,
     CASE WHEN push THEN CASE WHEN l.pts < 0 THEN 'kRejectedInvalidFrame' WHEN last IS NOT NULL AND l.pts <= last.p THEN 'kRejectedStalePts' WHEN len(list_filter(q, lambda x: x.p = l.pts)) > 0 THEN 'kRejectedDuplicatePts' WHEN len(q) >= 6 THEN 'kDroppedOldest' ELSE 'kAccepted' END
      WHEN l.ref IS NULL THEN 'kClockUnavailable' WHEN l.ref < 0 OR l.ref < run.ref THEN 'kRejectedInvalidReferenceTime' ELSE '' END AS kind
    FROM run JOIN log l ON l.stream = run.stream AND l.r = run.r + 1)))))
SELECT stream, seq, result, frame.p AS pts, frame.i AS frame_index, diff AS diff_us, dropped, CAST(len(q) AS BIGINT) AS queued, CASE WHEN running THEN 'kRunning' ELSE 'kBuffering' END AS state FROM run WHERE r > 0""")
def scheduler_events(spark, sf_dir):
    return fold(scheduler_log(spark, sf_dir), lambda: FrameScheduler(6, 2, 20_000))


@query(f"""WITH RECURSIVE {FRAMES}, log AS (SELECT stream, n, n % 4 = 3 AS pull, CAST(floor(value) AS BIGINT) % 5 + 1 AS c, ['OverwriteOldest', 'DropNewest', 'Block'][n % 3 + 1] AS strategy FROM frames),
run AS (
 SELECT DISTINCT stream, -1::BIGINT AS seq, '' AS status, NULL::BIGINT AS start_index, 0::BIGINT AS size, 0::BIGINT AS pulled, 0::BIGINT AS total_overwritten, 0::BIGINT AS total_dropped FROM log
 UNION ALL
 SELECT l.stream, l.n, CASE WHEN pull THEN CASE WHEN size >= 3 THEN 'kOk' ELSE 'kInsufficientData' END WHEN size + c <= 8 OR strategy = 'OverwriteOldest' THEN 'kOk' WHEN strategy = 'DropNewest' THEN 'kInsufficientSpace' ELSE 'kWouldBlock' END,
  CASE WHEN pull AND size >= 3 THEN pulled END, CASE WHEN pull THEN CASE WHEN size >= 3 THEN size - 3 ELSE size END WHEN size + c <= 8 THEN size + c WHEN strategy = 'OverwriteOldest' THEN 8 ELSE size END,
  CASE WHEN pull AND size >= 3 THEN pulled + 3 ELSE pulled END, total_overwritten + CASE WHEN NOT pull AND strategy = 'OverwriteOldest' THEN greatest(0, size + c - 8) ELSE 0 END, total_dropped + CASE WHEN NOT pull AND strategy = 'DropNewest' AND size + c > 8 THEN c ELSE 0 END
 FROM run JOIN log l ON l.stream = run.stream AND l.n = run.seq + 1)
SELECT stream, seq, status, start_index, start_index * 1000.0::DOUBLE / 16000 AS pts_ms, size, total_overwritten, total_dropped FROM run WHERE seq >= 0""")
def ring_buffer(spark, sf_dir):
    frames = video_frames(spark, sf_dir)
    strategy = F.element_at(F.array(*map(F.lit, ("OverwriteOldest", "DropNewest", "Block"))), (F.col("n") % 3 + 1).cast("int"))
    values = F.transform(F.sequence(F.lit(1), (F.floor("value") % 5 + 1).cast("int")), lambda k: k.cast("double"))
    log = frames.select("stream", F.col("n").alias("seq"), F.when(F.col("n") % 4 == 3, "pull").otherwise("push").alias("op"), F.lit(3).alias("n"), values.alias("values"), strategy.alias("strategy"), F.lit(-1).alias("timeout"))
    return fold(log, lambda: RingBuffer(8)).drop("values")


@query(f"""WITH {FRAMES}, v AS (SELECT stream, n // 10 AS g, n % 10 AS m, unnest([value, value / 2, value / 3]) AS v, unnest(range(3)) AS k FROM frames WHERE n % 10 < 9), p AS (SELECT stream, g, m * 3 + k AS pos, v FROM v),
c AS (SELECT stream, g, count(*) AS total FROM p GROUP BY ALL), w AS (SELECT stream, g, total, CASE WHEN total >= 8 THEN (total - 8) // 4 + 1 ELSE 0 END AS whole FROM c), j AS (SELECT stream, g, total, whole, unnest(range(CAST(whole + 1 AS BIGINT))) AS j FROM w),
f AS (SELECT *, j = whole AS padded FROM j WHERE j < whole OR (total = 27 AND total > whole * 4 AND EXISTS (SELECT 1 FROM frames z WHERE z.stream = j.stream AND z.n = j.g * 10 + 9)))
SELECT f.stream, f.g * 10 + CASE WHEN padded THEN 9 ELSE (4 * j + 7) // 3 END AS seq, f.g * 6 + j AS frame, padded, round(sum(v), 6) AS total FROM f JOIN p ON p.stream = f.stream AND p.g = f.g AND pos >= 4 * j AND pos < 4 * j + 8 GROUP BY ALL""")
def stream_framer(spark, sf_dir):
    frames = video_frames(spark, sf_dir)
    log = frames.select("stream", F.col("n").alias("seq"), F.when(F.col("n") % 10 == 9, "flush").otherwise("push").alias("op"), F.array("value", F.col("value") / 2, F.col("value") / 3).alias("values"))
    out = fold(log, lambda: StreamFramer(8, 4))
    return out.select("stream", "seq", "frame", "padded", F.round(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query(f"""WITH {FRAMES}, v AS (SELECT stream, n, unnest([value, value / 2]) AS v, unnest(range(2)) AS k FROM frames), e AS (SELECT stream, n, k, v - coalesce(0.97 * lag(v) OVER (PARTITION BY stream ORDER BY n, k), 0) AS v FROM v)
SELECT stream, n AS seq, CAST(k AS INTEGER) AS k, round(v, 6) + 0.0 AS value FROM e""")
def stream_emphasis(spark, sf_dir):
    log = video_frames(spark, sf_dir).select("stream", F.col("n").alias("seq"), F.lit("push").alias("op"), F.array("value", F.col("value") / 2).alias("values"))
    out = fold(log, StreamEmphasis).select("stream", "seq", F.posexplode("values").alias("k", "value"))
    return rounded(out, 6, "value")


@query(f"""WITH {FRAMES}, p AS (SELECT stream, n, n // 12 AS g, value FROM frames WHERE n % 12 < 11), t AS (SELECT stream, g, n, n - g * 12 AS m FROM p), c AS (SELECT stream, g, m AS last, n AS seq FROM t WHERE m >= 3 AND (m - 3) % 2 = 0),
x AS (SELECT stream, seq, row_number() OVER (PARTITION BY stream ORDER BY seq) - 1 AS chunk, g, last FROM c), r AS (SELECT x.stream, seq, chunk, p.n - (x.g * 12 + last - 3) AS t, value FROM x JOIN p ON p.stream = x.stream AND p.n BETWEEN x.g * 12 + last - 3 AND x.g * 12 + last),
v AS (SELECT *, unnest(range(2)) AS f FROM r)
SELECT stream, seq, chunk, CAST(f * 4 + t AS INTEGER) AS p, round(CASE WHEN f = 0 THEN value ELSE -value END, 6) + 0.0 AS value FROM v""")
def mel_chunker(spark, sf_dir):
    """Rows of two bands in chunks of four, two rows on for each; every twelfth event throws away what is held."""
    frames = video_frames(spark, sf_dir)
    log = frames.select("stream", F.col("n").alias("seq"), F.when(F.col("n") % 12 == 11, "flush").otherwise("push").alias("op"), F.array("value", -F.col("value")).alias("values"))
    out = fold(log, lambda: MelChunker(4, 2)).select("stream", "seq", "chunk", F.posexplode("values").alias("p", "value"))
    return rounded(out, 6, "value")


@query(f"""WITH RECURSIVE {FRAMES}, log AS (SELECT stream, n, CASE WHEN n = 50 THEN CASE WHEN stream % 2 = 0 THEN 'close' ELSE 'cancel' END WHEN n < 56 AND CAST(floor(value) AS BIGINT) % 3 < 2 THEN 'push' ELSE 'pop' END AS op FROM frames),
run AS (
 SELECT DISTINCT stream, -1::BIGINT AS seq, '' AS status, NULL::VARCHAR AS task, []::VARCHAR[] AS q, 0::BIGINT AS high, 0::BIGINT AS lost, false AS closed, false AS cancelled FROM log
 UNION ALL
 SELECT stream, n, CASE WHEN op = 'push' AND (closed OR cancelled) THEN 'kClosed' WHEN op = 'push' AND len(q) >= 5 THEN 'kBlocked' WHEN op = 'pop' AND (cancelled OR closed AND len(q) = 0) THEN 'kEnd' WHEN op = 'pop' AND len(q) = 0 THEN 'kBlocked' ELSE 'kOk' END,
  CASE WHEN op = 'pop' AND NOT cancelled THEN q[1] END, q2, greatest(high, CASE WHEN op = 'push' THEN len(q2) ELSE 0 END), CASE WHEN op = 'cancel' AND NOT cancelled THEN len(q) ELSE lost END, closed OR op = 'close' AND NOT cancelled, cancelled OR op = 'cancel'
 FROM (SELECT l.stream, l.n, op, q, high, lost, closed, cancelled, CASE WHEN op = 'push' AND NOT closed AND NOT cancelled AND len(q) < 5 THEN list_append(q, 't' || l.n) WHEN op = 'pop' AND NOT cancelled THEN q[2:] WHEN op = 'cancel' THEN [] ELSE q END AS q2 FROM run JOIN log l ON l.stream = run.stream AND l.n = run.seq + 1))
SELECT stream, seq, status, task, CAST(len(q) AS BIGINT) AS queued, high AS high_watermark, lost AS unprocessed FROM run WHERE seq >= 0""")
def task_queue(spark, sf_dir):
    """Pushes and pops of five tasks at most; half of the queues are closed, half cancelled."""
    n = F.col("n")
    op = F.when(n == 50, F.when(F.col("stream") % 2 == 0, "close").otherwise("cancel")).when((n < 56) & (F.floor("value") % 3 < 2), "push").otherwise("pop")
    log = video_frames(spark, sf_dir).select("stream", n.alias("seq"), op.alias("op"), F.concat(F.lit("t"), n).alias("task"))
    return fold(log, lambda: TaskQueue(5))


_PLAY = "CASE WHEN n % 40 = 0 THEN 'prepare' WHEN n % 40 = 1 THEN 'start' WHEN n % 40 = 38 THEN ['stop', 'abort', 'finished'][stream % 3 + 1] WHEN n % 40 = 39 THEN 'reset' WHEN n % 3 = 0 THEN 'callback' ELSE 'tick' END"


@query(f"""WITH RECURSIVE {FRAMES}, log AS (SELECT stream, n, {_PLAY} AS op, n * 10000 AS now, CAST(floor(value) AS BIGINT) % 400 AS c, CASE WHEN stream % 13 = 0 THEN 0 ELSE 1500 END AS clip, CASE WHEN stream % 11 = 0 THEN 2 ELSE 1 END AS channels FROM frames),
run AS (
 SELECT DISTINCT stream, -1::BIGINT AS seq, '' AS status, 'kIdle' AS state, 0::BIGINT AS total, 0::BIGINT AS taken, 0::BIGINT AS anchor, 0::BIGINT AS anchor_us, 0::BIGINT AS last FROM log
 UNION ALL
 SELECT stream, n, CASE WHEN op = 'prepare' THEN CASE WHEN state <> 'kIdle' THEN 'kInvalidState' WHEN clip <= 0 THEN 'kEmptyAudio' WHEN channels <> 1 THEN 'kUnsupportedChannels' ELSE 'kOk' END WHEN op = 'start' AND state <> 'kPrepared' OR op = 'callback' AND state <> 'kRunning' OR op IN ('stop', 'abort') AND state NOT IN ('kRunning', 'kCompleted') THEN 'kInvalidState' ELSE 'kOk' END,
  CASE WHEN op = 'prepare' AND state = 'kIdle' AND clip > 0 AND channels = 1 THEN 'kPrepared' WHEN op = 'start' AND state = 'kPrepared' THEN 'kRunning' WHEN op = 'reset' THEN 'kIdle' WHEN runs AND op IN ('stop', 'finished') AND taken >= total THEN 'kCompleted' WHEN runs AND op IN ('stop', 'abort') THEN 'kStopped' ELSE state END,
  CASE WHEN op = 'reset' THEN 0 WHEN op = 'prepare' AND state = 'kIdle' AND clip > 0 AND channels = 1 THEN clip ELSE total END, CASE WHEN op = 'reset' OR op = 'start' AND state = 'kPrepared' THEN 0 WHEN runs AND op = 'callback' THEN least(total, taken + c) ELSE taken END,
  CASE WHEN op = 'reset' OR op = 'start' AND state = 'kPrepared' THEN 0 WHEN runs AND op = 'callback' THEN taken ELSE anchor END, CASE WHEN op = 'reset' THEN 0 WHEN runs AND op = 'callback' OR op = 'start' AND state = 'kPrepared' THEN now ELSE anchor_us END,
  CASE WHEN op = 'reset' OR op = 'start' AND state = 'kPrepared' THEN 0 WHEN runs AND op IN ('stop', 'finished') AND taken >= total THEN total WHEN runs AND op IN ('callback', 'tick', 'stop', 'abort') AND now >= anchor_us THEN greatest(last, least(anchor + (now - anchor_us) * 16000 // 1000000, taken, total)) ELSE last END
 FROM (SELECT l.*, state, total, taken, anchor, anchor_us, last, state = 'kRunning' AS runs FROM run JOIN log l ON l.stream = run.stream AND l.n = run.seq + 1))
SELECT stream, seq, status, state, last AS frame FROM run WHERE seq >= 0""")
def playback_states(spark, sf_dir):
    """Clips of 1500 samples prepared, started, fed by callbacks, stopped in three ways and reset, in turns of forty events."""
    op = F.expr(_PLAY.replace("['stop', 'abort', 'finished'][stream % 3 + 1]", "element_at(array('stop', 'abort', 'finished'), cast(stream % 3 + 1 as int))"))
    log = video_frames(spark, sf_dir).select(
        "stream", F.col("n").alias("seq"), op.alias("op"), (F.col("n") * 10_000).alias("now"), (F.floor("value") % 400).alias("n"), F.when(F.col("stream") % 13 == 0, 0).otherwise(1500).alias("total"),
        F.lit(16000).alias("rate"), F.when(F.col("stream") % 11 == 0, 2).otherwise(1).alias("channels"), F.lit(True).alias("finite"),
    )
    return fold(log, Playback)


@query(f"""WITH {FRAMES}, t AS (SELECT stream, n, n * 160 AS anchor, n * 10000 AS a_us, n * 10000 + CAST(floor(value) AS BIGINT) * 500 AS now, n * 200 AS sub FROM frames), c AS (SELECT stream, n, least(anchor + (now - a_us) * 16000 // 1000000, sub, 9000) AS f FROM t)
SELECT stream, n, greatest(0, max(f) OVER (PARTITION BY stream ORDER BY n ROWS UNBOUNDED PRECEDING)) AS frame FROM c""")
def played_frames(spark, sf_dir):
    """The frame played at each tick of a stream: it never falls, whatever the anchors say."""
    n = F.col("n")
    ticks = video_frames(spark, sf_dir).select("stream", "n", (n * 160).alias("anchor_frame"), (n * 10_000).alias("anchor_us"), (n * 10_000 + F.floor("value") * 500).alias("now_us"), F.lit(16000).alias("rate"), (n * 200).alias("submitted"), F.lit(9000).cast("long").alias("total"))
    return sync.played_frames(ticks).select("stream", "n", "frame")


@query(f"""WITH {FRAMES}, d AS (SELECT stream, n, sum(CASE WHEN CAST(floor(value) AS BIGINT) % 3 < 2 THEN 1 ELSE -1 END) OVER w AS s FROM frames WINDOW w AS (PARTITION BY stream ORDER BY n ROWS UNBOUNDED PRECEDING)),
q AS (SELECT stream, s - least(0, min(s) OVER (PARTITION BY stream ORDER BY n ROWS UNBOUNDED PRECEDING)) AS depth FROM d) SELECT stream, CAST(max(depth) AS BIGINT) AS high_watermark FROM q GROUP BY stream""")
def queue_watermark(spark, sf_dir):
    from lumentide.plans.metrics import high_watermark

    steps = video_frames(spark, sf_dir).select("stream", "n", F.when(F.floor("value") % 3 < 2, 1).otherwise(-1).alias("step"))
    return high_watermark(steps, "stream", "n")
