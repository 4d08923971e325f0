"""Registration of queries, and the views that let the driver's tables stand in for signals, frames and images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL twin if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Rounds; adding 0.0 makes a negative zero positive."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in names})


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip for each user: (clip, i, x)."""
    # named before the window, so that its partitioning by clip holds for all that follows
    named = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), "event_id", ((F.col("value") - 50) / 500).alias("x"))
    i = F.row_number().over(Window.partitionBy("clip").orderBy("event_id")) - 1
    return named.select("clip", i.cast("long").alias("i"), "x")


PCM = "pcm AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, (value - 50) / 500 AS x FROM events)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame of 64 samples for each vector, eight vectors a clip: (clip, frame, samples)."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("clip"), (F.col("vec_id") % 8).alias("frame"), F.transform("embedding", lambda v: v.cast("double")).alias("samples"))


VECTORS = "vectors AS (SELECT vec_id // 8 AS clip, vec_id % 8 AS frame, CAST(embedding AS DOUBLE[]) AS samples FROM embeddings)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8 x 8 image of levels 0 to 255 in three channels: (image, y, x, b, g, r)."""
    long = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("p", "v"))
    level = lambda k: F.floor(F.abs(F.col("v").cast("double")) * k % 256)
    return long.select("image", F.expr("p div 8").cast("long").alias("y"), (F.col("p") % 8).cast("long").alias("x"), level(1000).alias("b"), level(1700).alias("g"), level(2900).alias("r"))


PIXELS = """flat AS (SELECT vec_id AS image, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(64)) AS p FROM embeddings),
pixels AS (SELECT image, p // 8 AS y, p % 8 AS x, CAST(floor(abs(v) * 1000 % 256) AS BIGINT) AS b, CAST(floor(abs(v) * 1700 % 256) AS BIGINT) AS g, CAST(floor(abs(v) * 2900 % 256) AS BIGINT) AS r FROM flat)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as 32 points within a few hundred pixels: (image, label, points)."""
    v = F.col("embedding")
    at = lambda k: F.element_at(v, k).cast("double") * 100 + 100
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(at(2 * k + 1).alias("x"), at(2 * k + 2).alias("y")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), "label", pts.alias("points"))


POINTS = """coords AS (SELECT vec_id AS image, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
points AS (SELECT image, label, unnest(range(32)) AS k, e FROM coords),
pts AS (SELECT image, label, k, e[2 * k + 1] * 100 + 100 AS px, e[2 * k + 2] * 100 + 100 AS py FROM points)"""


def video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as frames: (stream, n, arrival, pts)."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    named = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("arrival"), us.alias("us"), "value")
    own = Window.partitionBy("stream")
    n = F.row_number().over(own.orderBy("arrival")) - 1
    return named.select("stream", n.cast("long").alias("n"), "arrival", (F.col("us") - F.min("us").over(own)).alias("pts"), "value")


FRAMES = "frames AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, event_id AS arrival, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS pts, value FROM events)"
