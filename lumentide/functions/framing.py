"""Overlapping frames, windows and chunks over long-form rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COVER, EVERY_HOP, DROP = "CoverLast", "StartEveryHop", "Drop"


@dataclass(frozen=True)
class FrameOptions:
    size: int = 400
    hop: int = 160
    window: str = "hamming"
    policy: str = COVER


SPEECH = FrameOptions()
LIP_SYNC = FrameOptions(800, 200, "hann")


def samples_of(rate: int, ms: float) -> int:
    return math.floor(rate * ms / 1000 + 0.5)


def samples_in(ms: Column, rate: Column) -> Column:
    """Whole samples of a span of milliseconds, rounded half away from zero."""
    return F.round(rate * ms / 1000).cast("long")


def ms_of(samples: Column, rate: Column) -> Column:
    return samples * 1000.0 / rate


def num_frames(length: Column, size: int, hop: int, policy: str) -> Column:
    """How many frames a signal of ``length`` samples has."""
    if size <= 0 or hop <= 0:
        return F.lit(0).cast("long")
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    n = {COVER: 1 + div(length - size + (hop - 1), hop), EVERY_HOP: div(length + (hop - 1), hop), DROP: 1 + div(length - size, hop)}[policy]
    return F.when(length <= 0, 0).when(length < size, 0 if policy == DROP else 1).otherwise(n).cast("long")


def window_value(k: Column, size: int, kind: str) -> Column:
    """Symmetric windows; one sample has the value 1."""
    if size == 1 or kind == "none":
        return F.lit(1.0)
    theta = k.cast("double") * (2 * math.pi / (size - 1))
    return {"hamming": 0.54 - 0.46 * F.cos(theta), "hann": 0.5 * (1 - F.cos(theta))}[kind]


def frame_rows(pcm: DataFrame, o: FrameOptions = SPEECH) -> DataFrame:
    """(clip, frame, k, x): every frame's samples that the signal has, windowed. Each sample goes to the frames that hold it; padding has no rows.

    A sample is sent to size / hop frames, with no join and no array of the whole signal.
    """
    length = F.max("i").over(Window.partitionBy("clip")) + 1
    sized = pcm.withColumn("frames", num_frames(length, o.size, o.hop, o.policy))
    first = F.greatest(F.lit(0), F.floor((F.col("i") - o.size) / o.hop) + 1).cast("long")
    last = F.least(F.expr(f"i div {o.hop}"), F.col("frames") - 1)
    frames = sized.withColumn("frame", F.explode(F.when(first <= last, F.sequence(first, last))))
    k = F.col("i") - F.col("frame") * o.hop
    return frames.select("clip", "frame", k.alias("k"), (F.col("x") * window_value(k, o.size, o.window)).alias("x"))


def create_frame(samples: Column, start: Column, size: int, pad: bool = True) -> Column:
    """One frame of a packed signal; what lies behind its end is zero, or left out."""
    held = F.slice(samples, (start + 1).cast("int"), F.greatest(F.lit(0), F.least(F.lit(size), F.size(samples) - start)).cast("int"))
    return F.slice(F.concat(held, F.array_repeat(F.lit(0.0), size)), 1, size) if pad else held


def apply_window(samples: Column, size: int, kind: str) -> Column:
    """A packed frame times its window; the shorter of the two decides."""
    weights = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: window_value(k, size, kind)) if size > 0 else samples
    n = F.least(F.size(samples), F.lit(size)) if size > 0 else F.size(samples)
    return F.zip_with(F.slice(samples, 1, n), F.slice(weights, 1, n), lambda x, w: x * w) if size > 0 else samples


def frame_summary(pcm: DataFrame, o: FrameOptions = SPEECH) -> DataFrame:
    """(clip, frame, start_sample, end_sample, contains_padding) without touching samples."""
    clips = pcm.groupBy("clip").agg((F.max("i") + 1).alias("length"))
    counted = clips.withColumn("n", num_frames(F.col("length"), o.size, o.hop, o.policy)).where("n > 0")
    frames = counted.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    start = F.col("frame") * o.hop
    return frames.select("clip", "frame", start.alias("start_sample"), (start + o.size).alias("end_sample"), (start + o.size > F.col("length")).alias("contains_padding"))


def streamed_frame_count(length: Column, size: int, hop: int, policy: str = COVER) -> Column:
    """Frames that the chunked framer gives after its flush: one more than in a batch where frames end with the signal and overlap."""
    whole = F.when(length < size, 0).otherwise(1 + F.call_function("div", length - size, F.lit(hop).cast("long")))
    rest = F.when(length < size, length).otherwise(length - whole * hop)
    return (whole + F.when((rest > 0) & (F.lit(policy != DROP)), 1).otherwise(0)).cast("long")


def mel_chunks(mel: DataFrame, rows: int = 16, hop: int = 1, freq_major: bool = True) -> DataFrame:
    """(clip, chunk, values) of all whole windows of ``rows`` mel rows (clip, frame, mel), flattened by frequency or by time."""
    if hop <= 0:
        raise ValueError("hop must be positive")
    ahead = Window.partitionBy("clip").orderBy("frame").rowsBetween(0, rows - 1)
    held = mel.select("clip", "frame", F.collect_list("mel").over(ahead).alias("rows")).where((F.size("rows") == rows) & (F.col("frame") % hop == 0))
    if freq_major:
        bands = F.sequence(F.lit(1), F.size(F.element_at("rows", 1)))
        values = F.flatten(F.transform(bands, lambda f: F.transform("rows", lambda r: F.element_at(r, f))))
    else:
        values = F.flatten("rows")
    return held.select("clip", F.expr(f"frame div {hop}").alias("chunk"), values.alias("values"))


def clamped_rows(ticks: DataFrame, mel: DataFrame, rows: int = 16) -> DataFrame:
    """(clip, tick, t, mel): the ``rows`` mel rows from each tick's ``start`` row on, moved into the signal, its last row repeated where the signal is short.

    Ticks and mel rows meet by an equi-join on the exploded row number.
    """
    counts = mel.groupBy("clip").agg(F.count("*").alias("total"))
    wanted = ticks.join(counts, "clip").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    begin = F.when(F.col("total") >= rows, F.greatest(F.lit(0), F.least(F.col("start"), F.col("total") - rows))).otherwise(F.lit(0))
    wanted = wanted.withColumn("frame", F.least(begin + F.col("t"), F.col("total") - 1).cast("long"))
    return wanted.join(mel, ["clip", "frame"]).select("clip", "tick", "t", "mel")


def clamped_chunk_rows(ticks: DataFrame, mel: DataFrame, rows: int = 16) -> DataFrame:
    """(clip, tick, t, f, v): the chunks of ``clamped_rows``, a row for each value."""
    return clamped_rows(ticks, mel, rows).select("clip", "tick", "t", F.posexplode("mel").alias("f", "v"))


def clamped_chunks(ticks: DataFrame, mel: DataFrame, rows: int = 16) -> DataFrame:
    """(clip, tick, values): the chunks of ``clamped_rows``, flattened by frequency; only their mel rows are shuffled and collected."""
    held = clamped_rows(ticks, mel, rows).groupBy("clip", "tick").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "mel"))), lambda r: r["mel"]).alias("rows"))
    bands = F.sequence(F.lit(0), F.size(F.get("rows", F.lit(0))) - 1)
    return held.select("clip", "tick", F.flatten(F.transform(bands, lambda f: F.transform("rows", lambda r: F.get(r, f)))).alias("values"))
