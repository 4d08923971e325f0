"""Ordering and matching of timestamps that need no state machine: windows and closed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamped_pts(frames: DataFrame) -> DataFrame:
    """Adds ``out_pts``: strictly rising per stream, never under pts. Frames: stream, n (0, 1, ... in order), pts in frame units.

    The step out = max(p, previous + 1) has the closed form n + max(0, running max of p - n).
    """
    so_far = Window.partitionBy("stream").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("out_pts", F.col("n") + F.greatest(F.lit(0), F.max(F.col("pts") - F.col("n")).over(so_far)))


def first_of_each_pts(frames: DataFrame) -> DataFrame:
    """The first arrival of each pts of a stream. Frames: stream, pts, arrival."""
    order = Window.partitionBy("stream", "pts").orderBy("arrival")
    return frames.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def strictly_newer(frames: DataFrame) -> DataFrame:
    """Frames whose pts is over all before them in arrival order."""
    before = Window.partitionBy("stream").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("__m", F.max("pts").over(before)).where("__m IS NULL OR pts > __m").drop("__m")


def played_frame(anchor_frame: Column, anchor_us: Column, now_us: Column, rate: Column, submitted: Column, total: Column, last: Column) -> Column:
    """The frame that a device plays at ``now_us``, from its last anchor; never back, never over what was submitted."""
    bound = F.least(submitted, total)
    held = F.least(last, bound)
    usable = (rate > 0) & (anchor_us >= 0) & (now_us >= anchor_us)
    moved = F.call_function("div", ((now_us - anchor_us).cast("decimal(20,0)") * rate.cast("decimal(10,0)")).cast("decimal(38,0)"), F.lit(1_000_000))
    return F.when(usable, F.least(F.greatest(held, anchor_frame + moved), bound)).otherwise(held)


def played_frames(ticks: DataFrame) -> DataFrame:
    """Adds ``frame`` to a stream's ticks (stream, n, and ``played_frame``'s columns but the last frame): a running maximum, as what was submitted never falls."""
    c = F.col
    own = played_frame(c("anchor_frame"), c("anchor_us"), c("now_us"), c("rate"), c("submitted"), c("total"), F.lit(0).cast("long"))
    return ticks.withColumn("frame", F.max(own).over(Window.partitionBy("stream").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))


def nearest_frames(ticks: DataFrame, frames: DataFrame, tolerance_us: int) -> DataFrame:
    """(stream, ref, pts, diff_us, action): for each tick the latest frame no more than the tolerance ahead.

    An as-of join by union and one window per stream: each side is read once.
    """
    rows = ticks.select("stream", F.col("ref").alias("at"), F.lit(1).alias("kind"), "ref", F.lit(None).cast("long").alias("pts"))
    rows = rows.unionByName(frames.select("stream", (F.col("pts") - tolerance_us).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("ref"), "pts"))
    before = Window.partitionBy("stream").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    matched = rows.withColumn("pts", F.last("pts", ignorenulls=True).over(before)).where("kind = 1")
    diff = F.col("pts") - F.col("ref")
    action = F.when(diff.isNull(), "kBufferingNoFrame").when(diff < -tolerance_us, "kLate").otherwise("kDeliver")
    return matched.select("stream", "ref", "pts", diff.alias("diff_us"), action.alias("action"))


def callback_copy(first: Column, asked: Column, total: Column) -> Column:
    """(copied, silent, complete) of a device callback that asks for samples from ``first`` on."""
    copied = F.greatest(F.lit(0), F.least(asked, total - first))
    return F.struct(copied.alias("copied"), (asked - copied).alias("silent"), (first + copied >= total).alias("complete"))


def audio_blocks(clips: DataFrame, size: int) -> DataFrame:
    """(clip, block, start, length): an encoder's blocks of a clip of ``length`` samples, the last one short; start is its pts."""
    count = F.expr(f"(length + {size - 1}) div {size}")
    blocks = clips.where("length > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    start = F.col("block") * size
    return blocks.select("clip", "block", start.alias("start"), F.least(F.lit(size).cast("long"), F.col("length") - start).alias("length"))


def writer_valid(numerator: Column, denominator: Column, video_bits: Column, audio_bits: Column, rate: Column, path: Column) -> Column:
    """Whether a writer can be set up so."""
    return (numerator > 0) & (denominator > 0) & (video_bits > 0) & (audio_bits > 0) & (rate > 0) & (F.coalesce(path, F.lit("")) != "")
