"""The job from a clip's samples to one model input for each video frame, as one lazy plan.

Shuffles: one by clip for the windows, one for each frame's samples, one for its mel rows;
ticks meet mel rows by an equi-join on row numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentide.functions import framing, signal, spectral
from lumentide.functions.timestamps import frame_count, mel_start, video_index_to_us


def mel_rows(pcm: DataFrame, frames: framing.FrameOptions = framing.LIP_SYNC, mel: spectral.MelOptions = spectral.MelOptions(), prepare: signal.PreprocessOptions = signal.PreprocessOptions(normalize=False)) -> DataFrame:
    """(clip, frame, mel)."""
    rows = framing.frame_rows(signal.preprocess(pcm, prepare), frames)
    sample = F.struct("k", "x")
    packed = rows.groupBy("clip", "frame").agg(F.transform(F.array_sort(F.collect_list(sample)), lambda s: s["x"]).alias("samples"))
    return spectral.mel_features(packed, mel)


def video_chunks(pcm: DataFrame, frames: framing.FrameOptions = framing.LIP_SYNC, mel: spectral.MelOptions = spectral.MelOptions(), prepare: signal.PreprocessOptions = signal.PreprocessOptions(normalize=False), rate: int = 16000, numerator: int = 25, denominator: int = 1, rows: int = 16) -> DataFrame:
    """(clip, tick, pts_us, values): each video frame's chunk of mel rows, by frequency."""
    features = mel_rows(pcm, frames, mel, prepare)
    lengths = pcm.groupBy("clip").agg((F.max("i") + 1).alias("length"))
    ticks = lengths.withColumn("tick", F.explode(F.sequence(F.lit(0).cast("long"), frame_count(F.col("length"), rate, numerator, denominator) - 1)))
    ticks = ticks.select("clip", "tick", mel_start(F.col("tick"), numerator, denominator).alias("start"))
    chunks = framing.clamped_chunks(ticks, features, rows)
    pts = video_index_to_us(F.col("tick"), F.lit(numerator), F.lit(denominator))["microseconds"]
    return chunks.select("clip", "tick", pts.alias("pts_us"), "values")
