"""Run statistics of a job, observed while it runs, without a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def observed(results: DataFrame, name: str = "job") -> tuple[DataFrame, Observation]:
    """The same rows, and counters that are there once an action has ended: frames, succeeded, failed, retried, recovered."""
    seen = Observation(name)
    ok = F.col("status") == "kOk"
    counters = [F.count(F.lit(1)).alias("frames"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if(F.col("attempts") > 1).alias("retried"), F.count_if("recovered").alias("recovered")]
    return results.observe(seen, *counters), seen


def termination(frames: int, succeeded: int, failed: int, cancelled: bool) -> str:
    """The state that a job ends in: the first error decides, then a cancel, then the end of its input."""
    if failed:
        return "kFailed"
    return "kCancelled" if cancelled and succeeded < frames else "kSucceeded"


def high_watermark(steps: DataFrame, key: str, order: str) -> DataFrame:
    """(key, high_watermark): the deepest that a queue was. ``step``: 1 for what goes in, -1 for what goes out; from an empty queue nothing does."""
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    walked = steps.select(key, order, F.sum("step").over(so_far).alias("sum"))
    depth = F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far))
    return walked.select(key, depth.alias("depth")).groupBy(key).agg(F.max("depth").cast("long").alias("high_watermark"))


def stage_sums(steps: DataFrame, *keys: str, sums: tuple[str, ...] = ("h2d_ms", "forward_ms"), peaks: tuple[str, ...] = ("peak_memory",)) -> DataFrame:
    """Times of a run's stages added up, and the peaks of what it held."""
    return steps.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in peaks])


def run_summary(runs: DataFrame, *keys: str) -> DataFrame:
    """Frames a second and inference time a frame over the runs that succeeded. Runs: keys, frames, wall_ms, infer_ms, ok."""
    fps = F.when(F.col("ok"), F.col("frames") * 1000.0 / F.col("wall_ms"))
    return runs.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.sum(F.col("ok").cast("long")).alias("successful"), F.avg(fps).alias("avg_fps"), F.min(fps).alias("min_fps"), F.max(fps).alias("max_fps"),
        F.avg(F.when(F.col("ok"), F.col("infer_ms") / F.col("frames"))).alias("avg_inference_ms"),
    )
