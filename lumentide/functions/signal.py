"""Sample-level operators over long-form signals (clip, i, x): columns, windows and aggregates, no UDFs.

One clip is a window partition; clips are many, so windows spread over the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PreprocessOptions:
    normalize: bool = True
    peak: float = 0.95
    max_gain: float = 20.0
    silence: float = 1e-6
    gate: bool = False
    gate_db: float = -50.0
    pre_emphasis: bool = True
    alpha: float = 0.97


@dataclass(frozen=True)
class VadOptions:
    frame: int = 320
    scale: float = 0.5
    least: float = 0.01
    hangover: int = 10


def int16_to_float(sample: Column) -> Column:
    return (sample.cast("float") / F.lit(32768.0)).cast("float")


def is_finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == float("inf")))


def finite_status(pcm: DataFrame) -> DataFrame:
    """(clip, status): any NaN or infinity fails the whole clip."""
    bad = F.max((~is_finite(F.col("x"))).cast("int"))
    return pcm.groupBy("clip").agg(F.when(bad == 1, "kInvalidPcmData").otherwise("kOk").alias("status"))


def pcm_stats(pcm: DataFrame) -> DataFrame:
    """One row for each clip. Minimum and maximum pass over NaN, unless it comes first."""
    x = F.col("x")
    number = F.when(~F.isnan(x), x)
    first = F.min_by("x", "i")
    lo, hi = F.min(number), F.max(number)
    return pcm.groupBy("clip").agg(
        F.count("*").alias("n"),
        F.when(F.isnan(first), float("nan")).otherwise(lo).alias("min"),
        F.when(F.isnan(first), float("nan")).otherwise(hi).alias("max"),
        F.when(F.isnan(first), float("nan")).otherwise(F.greatest(F.abs(lo), F.abs(hi))).alias("max_abs"),
        F.avg(F.abs(x)).alias("mean_abs"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.avg((x == 0).cast("double")).alias("zero_ratio"),
        F.max(F.isnan(x)).alias("has_nan"),
        F.max(F.abs(number) == float("inf")).alias("has_inf"),
    )


def peak_normalize(pcm: DataFrame, o: PreprocessOptions = PreprocessOptions()) -> DataFrame:
    """Adds ``gain`` and scales x to the peak; silence keeps gain 1."""
    top = F.max(F.abs("x")).over(Window.partitionBy("clip"))
    gain = F.when(top < o.silence, 1.0).otherwise(F.least(F.lit(o.peak) / top, F.lit(o.max_gain)))
    with_gain = pcm.withColumn("gain", gain)
    loud = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x") * F.col("gain")))
    return with_gain.withColumn("x", F.when(top < o.silence, F.col("x")).otherwise(loud))


def noise_gate(x: Column, db: float) -> Column:
    return F.when(F.abs(x) < 10 ** (db / 20), 0.0).otherwise(x)


def pre_emphasis(pcm: DataFrame, alpha: float) -> DataFrame:
    """y[n] = x[n] - alpha * x[n-1] with the input's x[n-1]; the first sample stays."""
    before = F.lag("x").over(Window.partitionBy("clip").orderBy("i"))
    return pcm.withColumn("x", F.col("x") - F.coalesce(before * alpha, F.lit(0.0)))


def preprocess(pcm: DataFrame, o: PreprocessOptions = PreprocessOptions()) -> DataFrame:
    """Normalise, gate, emphasise; one shuffle by clip serves all three."""
    out = peak_normalize(pcm, o).drop("gain") if o.normalize else pcm
    if o.gate:
        out = out.withColumn("x", noise_gate(F.col("x"), o.gate_db))
    return pre_emphasis(out, o.alpha) if o.pre_emphasis else out


def preprocess_report(pcm: DataFrame, o: PreprocessOptions = PreprocessOptions()) -> DataFrame:
    """One row for each clip: status, processed_samples, gain, and the statistics of its input and output. A clip with NaN or infinity has its status alone. One shuffle by clip."""
    own = Window.partitionBy("clip")
    bad = F.max((~is_finite(F.col("x"))).cast("int")).over(own)
    kept = pcm.select("clip", "i", "x", bad.alias("bad"), F.col("x").alias("raw"))
    sound = F.when(F.col("bad") == 0, F.col("x"))
    done = peak_normalize(kept.withColumn("x", sound), o) if o.normalize else kept.withColumn("x", sound).withColumn("gain", F.lit(1.0))
    if o.gate:
        done = done.withColumn("x", noise_gate(F.col("x"), o.gate_db))
    done = pre_emphasis(done, o.alpha) if o.pre_emphasis else done

    def stats(c: str) -> Column:
        x = F.col(c)
        return F.struct(F.min(x).alias("min"), F.max(x).alias("max"), F.max(F.abs(x)).alias("max_abs"), F.avg(F.abs(x)).alias("mean_abs"), F.sqrt(F.avg(x * x)).alias("rms"), F.avg((x == 0).cast("double")).alias("zero_ratio"))

    out = done.groupBy("clip").agg(F.max("bad").alias("bad"), F.count("*").alias("n"), F.max("gain").alias("gain"), stats("raw").alias("input"), stats("x").alias("output"))
    ok = F.col("bad") == 0
    good = lambda c: F.when(ok, F.col(c))
    return out.select("clip", F.when(ok, "kOk").otherwise("kInvalidPcmData").alias("status"), good("n").alias("processed_samples"), good("gain").alias("gain"), good("input").alias("input"), good("output").alias("output"))


def vad_frames(pcm: DataFrame, o: VadOptions = VadOptions()) -> DataFrame:
    """(clip, frame, rms, threshold, speech, active) of all whole frames; active adds the hangover."""
    frame = F.expr(f"i div {o.frame}")
    rms = pcm.groupBy("clip", frame.alias("frame")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count("*").alias("n")).where(F.col("n") == o.frame)
    threshold = F.greatest(F.avg("rms").over(Window.partitionBy("clip")) * o.scale, F.lit(o.least))
    lit = rms.withColumn("threshold", threshold).withColumn("speech", F.col("rms") > F.col("threshold"))
    recent = Window.partitionBy("clip").orderBy("frame").rowsBetween(-o.hangover, 0)
    return lit.select("clip", "frame", "rms", "threshold", "speech", F.max("speech").over(recent).alias("active"))


def vad_segments(pcm: DataFrame, o: VadOptions = VadOptions()) -> DataFrame:
    """(clip, start_frame, end_frame): half-open runs of active frames."""
    by_frame = Window.partitionBy("clip").orderBy("frame")
    runs = vad_frames(pcm, o).where("active").withColumn("island", F.col("frame") - F.row_number().over(by_frame))
    return runs.groupBy("clip", "island").agg(F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame")).drop("island")


def chunked_pre_emphasis(chunks: DataFrame, alpha: float) -> DataFrame:
    """Streams cut into chunks (clip, chunk, i, x): a chunk's first sample sees the last of the chunk before."""
    before = F.lag("x").over(Window.partitionBy("clip").orderBy("chunk", "i"))
    return chunks.withColumn("x", F.col("x") - F.coalesce(before * alpha, F.lit(0.0)))
