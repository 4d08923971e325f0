"""Pixel algebra over long-form images (image, y, x, channels) and packed planes, as expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def normalized(value: Column, mode: str) -> Column:
    return {"none": value, "unit": value / 255.0, "signed": value / 127.5 - 1.0}[mode]


def quantized(value: Column) -> Column:
    """(status, level, corrected) of a prediction in [0, 1]; what is off by no more than the tolerance is clamped."""
    finite = ~(F.isnan(value) | (F.abs(value) == float("inf")))
    status = F.when(~finite, "kNonFinitePrediction").when((value < -TOLERANCE) | (value > 1 + TOLERANCE), "kRangeViolation").otherwise("kOk")
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    ok = status == "kOk"
    return F.struct(status.alias("status"), F.when(ok, F.floor(bounded * 255 + 0.5)).alias("level"), F.when(ok, (bounded != value).cast("int")).alias("corrected"))


def packed_planes(pixels: DataFrame, mask_row: int) -> DataFrame:
    """(image, plane, y, x, value): six planes, B G R with the rows from ``mask_row`` blank, then B G R, scaled to [0, 1]. Pixels: image, y, x, b, g, r."""
    planes = [F.when(F.col("y") >= mask_row, 0.0).otherwise(F.col(c) / 255.0) for c in "bgr"] + [F.col(c) / 255.0 for c in "bgr"]
    return pixels.select("image", "y", "x", F.posexplode(F.array(*planes)).alias("plane", "value"))


def masked_stats(pixels: DataFrame, over: float = 0.01) -> DataFrame:
    """(image, channel, n, base_mean, base_std, gen_mean, gen_std) where the mask is over ``over``. Pixels: image, channel, y, x, base, gen, mask."""
    live = pixels.where(F.col("mask") > over)
    return live.groupBy("image", "channel").agg(
        F.count("*").alias("n"), F.avg("base").alias("base_mean"), F.stddev_pop("base").alias("base_std"), F.avg("gen").alias("gen_mean"), F.stddev_pop("gen").alias("gen_std")
    )


def color_matched(pixels: DataFrame, least: int = 4, over: float = 0.01) -> DataFrame:
    """Pixels with ``gen`` matched to the base's mean and deviation per channel, unless that takes the mean further away.

    Statistics are windows over (image, channel): one shuffle, no join back.
    """
    own = Window.partitionBy("image", "channel")
    live = F.col("mask") > over
    stat = lambda f, c: f(F.when(live, F.col(c))).over(own)
    with_stats = pixels.select(
        "*", F.sum(live.cast("int")).over(own).alias("__n"), stat(F.avg, "base").alias("__bm"), stat(F.stddev_pop, "base").alias("__bs"), stat(F.avg, "gen").alias("__gm"), stat(F.stddev_pop, "gen").alias("__gs")
    )
    moved = (F.col("gen") - F.col("__gm")) * (F.col("__bs") / F.greatest(F.col("__gs"), F.lit(1e-6))) + F.col("__bm")
    tried = with_stats.withColumn("__c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)))
    worse = F.abs(stat(F.avg, "__c") - F.col("__bm")) > F.abs(F.col("__gm") - F.col("__bm")) + 1e-6
    out = F.when((F.col("__n") < least) | worse, F.col("gen")).otherwise(F.col("__c"))
    return tried.withColumn("gen", out).select(*pixels.columns)


def alpha_blend(base: Column, generated: Column, mask: Column) -> Column:
    return generated * mask + base * (1 - mask)


def gray(b: Column, g: Column, r: Column) -> Column:
    """Of whole levels, in whole thousandths, so that halves round alike everywhere."""
    return F.call_function("div", 114 * b + 587 * g + 299 * r + 500, F.lit(1000).cast("long"))


def laplacian_variance(pixels: DataFrame, value: str = "v") -> DataFrame:
    """(image, sharpness): population variance of the four-neighbour Laplacian; edges are mirrored without repeating the edge."""
    row, column = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    v = F.col(value)
    near = lambda w: (F.coalesce(F.lag(v).over(w), F.lead(v).over(w), v), F.coalesce(F.lead(v).over(w), F.lag(v).over(w), v))
    (left, right), (up, down) = near(row), near(column)
    # dealt by image once, which serves both windows and the sum
    return pixels.repartition("image").select("image", (left + right + up + down - 4 * v).alias("l")).groupBy("image").agg(F.var_pop("l").alias("sharpness"))


def border_cleared(value: Column, x: Column, y: Column, width: int, height: int, border: int) -> Column:
    edge = (x < border) | (y < border) | (x >= width - border) | (y >= height - border)
    return F.when(edge, 0.0).otherwise(value)


def mask_stats(pixels: DataFrame) -> DataFrame:
    """(image, width, height, min, max, mean, non_zero) of a mask."""
    v = F.col("mask")
    return pixels.groupBy("image").agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sum((v != 0).cast("long")).alias("non_zero")
    )


def replicated_mask(mask: Column, depth: str, channels: int = 3) -> Column:
    """A packed one-channel mask as interleaved channels; levels of 0 to 255 become shares, other depths give nothing."""
    if depth not in ("u8", "f32"):
        return F.array().cast("array<double>")
    scaled = F.transform(mask, lambda v: v.cast("double") / (255.0 if depth == "u8" else 1.0))
    return F.flatten(F.transform(scaled, lambda v: F.array_repeat(v, channels)))
