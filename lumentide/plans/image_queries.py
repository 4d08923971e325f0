"""Queries over rectangles, landmarks, masks and pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumentide.functions import geometry, pixels as px
from lumentide.operators import raster
from lumentide.plans.registry import PIXELS, POINTS, pixels, points, query, rounded, table

_RECT = "CAST(floor(e1 * 300) AS BIGINT) AS x, CAST(floor(e2 * 300) AS BIGINT) AS y, CAST(floor(abs(e3) * 400) AS BIGINT) AS w, CAST(floor(abs(e4) * 400) AS BIGINT) AS h"
_RECTS = f"r0 AS (SELECT vec_id AS image, CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2, CAST(embedding[3] AS DOUBLE) AS e3, CAST(embedding[4] AS DOUBLE) AS e4 FROM embeddings), rects AS (SELECT image, {_RECT} FROM r0)"
_WIDTH, _HEIGHT = 160, 120


def _rects(spark, sf_dir):
    e = lambda k: F.element_at("embedding", k).cast("double").alias(f"e{k}")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), *map(e, range(1, 5))).selectExpr("image", *_RECT.split(", "))


def _box():
    return F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(_WIDTH), F.lit(_HEIGHT)


@query(f"WITH {_RECTS} SELECT image, w > 0 AND h > 0 AND x >= 0 AND y >= 0 AND x + w <= {_WIDTH} AND y + h <= {_HEIGHT} AS valid FROM rects")
def rect_valid(spark, sf_dir):
    return _rects(spark, sf_dir).select("image", geometry.rect_valid(*_box()).alias("valid"))


@query(f"WITH {_RECTS} SELECT image, greatest(x, 0) AS x, greatest(y, 0) AS y, greatest(least(x + w, {_WIDTH}) - greatest(x, 0), 0) AS w, greatest(least(y + h, {_HEIGHT}) - greatest(y, 0), 0) AS h FROM rects")
def rect_clamp(spark, sf_dir):
    return _rects(spark, sf_dir).select("image", geometry.rect_clamp(*_box()).alias("r")).select("image", "r.*")


def _face(spark, sf_dir):
    """Each image's 32 points told round to 68."""
    return points(spark, sf_dir).withColumn("points", F.transform(F.sequence(F.lit(0), F.lit(67)), lambda k: F.element_at("points", k % 32 + 1)))


@query(f"WITH {POINTS}, k20 AS (SELECT unnest(range(20)) AS p) SELECT image, CAST(p AS INTEGER) AS p, round(px, 6) AS x, round(py, 6) AS y FROM pts JOIN k20 ON k = (p + 48) % 32")
def mouth_slice(spark, sf_dir):
    out = _face(spark, sf_dir).select("image", F.posexplode(geometry.mouth_points(F.col("points"))).alias("p", "v"))
    return rounded(out.select("image", "p", "v.x", "v.y"), 6, "x", "y")


@query(f"WITH {POINTS} SELECT image, CAST(k AS INTEGER) AS k, round(0.5 * px + 0.1 * py + 10, 6) AS x, round(-0.1 * px + 0.5 * py + 20, 6) AS y FROM pts")
def landmark_affine(spark, sf_dir):
    m = [F.lit(v) for v in (0.5, 0.1, 10.0, -0.1, 0.5, 20.0)]
    out = points(spark, sf_dir).select("image", F.posexplode(geometry.apply_affine(F.col("points"), m)).alias("k", "v"))
    return rounded(out.select("image", "k", "v.x", "v.y"), 6, "x", "y")


@query(f"WITH {POINTS} SELECT image, round(avg(px), 6) AS x, round(avg(py), 6) AS y FROM pts GROUP BY image")
def landmark_centroid(spark, sf_dir):
    return rounded(points(spark, sf_dir).select("image", geometry.centroid(F.col("points")).alias("c")).select("image", "c.*"), 6, "x", "y")


@query(f"""WITH {POINTS}, a AS (SELECT image, avg(px) AS x, avg(py) AS y FROM pts WHERE k < 6 GROUP BY image), b AS (SELECT image, avg(px) AS x, avg(py) AS y FROM pts WHERE k BETWEEN 6 AND 11 GROUP BY image),
e AS (SELECT image, CASE WHEN a.x < b.x THEN a.x ELSE b.x END AS lx, CASE WHEN a.x < b.x THEN a.y ELSE b.y END AS ly, CASE WHEN a.x < b.x THEN b.x ELSE a.x END AS rx, CASE WHEN a.x < b.x THEN b.y ELSE a.y END AS ry FROM a JOIN b USING (image)),
s AS (SELECT image, 38.4 / sqrt(power(rx - lx, 2) + power(ry - ly, 2)) AS scale, atan2(ry - ly, rx - lx) AS angle, (lx + rx) / 2 AS cx, (ly + ry) / 2 AS cy FROM e),
m AS (SELECT image, scale * cos(angle) AS c, scale * sin(angle) AS s, cx, cy FROM s)
SELECT image, round(c, 5) + 0.0 AS m0, round(s, 5) + 0.0 AS m1, round((1 - c) * cx - s * cy + 48 - cx, 5) + 0.0 AS m2, round(-s, 5) + 0.0 AS m3, round(c, 5) + 0.0 AS m4, round(s * cx + (1 - c) * cy + 38.4 - cy, 5) + 0.0 AS m5 FROM m""")
def eye_align_matrix(spark, sf_dir):
    eyes = [geometry.centroid(F.slice("points", at, 6)) for at in (1, 7)]
    both = points(spark, sf_dir).select("image", eyes[0].alias("a"), eyes[1].alias("b"))
    out = both.select("image", geometry.eye_matrix(F.col("a"), F.col("b")).alias("m")).where("m IS NOT NULL").select("image", "m.*")
    return rounded(out, 5, *[f"m{k}" for k in range(6)])


@query(f"""WITH {_RECTS}, c AS (SELECT image, greatest(0, x) AS l, greatest(0, y) AS t, least({_WIDTH}, x + w) AS r, least({_HEIGHT}, y + h + 10) AS b FROM rects WHERE w > 0 AND h > 0), k AS (SELECT image, l, t, 96.0::DOUBLE / (r - l) AS sx, 96.0::DOUBLE / (b - t) AS sy FROM c WHERE r > l AND b > t)
SELECT image, round(sx, 6) AS m0, 0.0::DOUBLE AS m1, round(-l * sx + (sx - 1) * 0.5, 6) + 0.0 AS m2, 0.0::DOUBLE AS m3, round(sy, 6) AS m4, round(-t * sy + (sy - 1) * 0.5, 6) + 0.0 AS m5 FROM k""")
def prepare_face_matrix(spark, sf_dir):
    crops = _rects(spark, sf_dir).select("image", geometry.padded_crop(*_box()).alias("crop")).where("crop IS NOT NULL")
    return rounded(crops.select("image", geometry.crop_matrix(F.col("crop")).alias("m")).select("image", "m.*"), 6, *[f"m{k}" for k in range(6)])


@query(f"""WITH {POINTS}, i AS (SELECT image, bool_and(px >= 0 AND py >= 0 AND px < {_WIDTH} AND py < {_HEIGHT}) AS inside FROM pts GROUP BY image), {_RECTS}
SELECT image, round(CASE WHEN w >= 64 THEN 0.3 ELSE 0 END + CASE WHEN h >= 64 THEN 0.3 ELSE 0 END + CASE WHEN inside THEN 0.4 ELSE 0 END, 3)::DOUBLE AS score FROM rects JOIN i USING (image)""")
def quality_score(spark, sf_dir):
    both = _rects(spark, sf_dir).join(points(spark, sf_dir), "image")
    return rounded(both.select("image", geometry.quality_score(F.col("w"), F.col("h"), F.col("points"), F.lit(_WIDTH), F.lit(_HEIGHT)).alias("score")), 3, "score")


@query("SELECT CAST(vec_id AS BIGINT) AS n, CAST(CASE WHEN vec_id - 3 < 1 THEN 1 WHEN (vec_id - 3) % 2 = 0 THEN vec_id - 2 ELSE vec_id - 3 END AS BIGINT) AS size FROM embeddings")
def kernel_size(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), geometry.kernel_size(F.col("vec_id") - 3).alias("size"))


@query(f"WITH {PIXELS} SELECT image, y, x, b / 255.0::DOUBLE AS unit, g / 127.5::DOUBLE - 1 AS signed FROM pixels")
def image_normalize(spark, sf_dir):
    return pixels(spark, sf_dir).select("image", "y", "x", px.normalized(F.col("b"), "unit").alias("unit"), px.normalized(F.col("g"), "signed").alias("signed"))


@query(f"WITH {PIXELS} SELECT image, min(least(b, g, r)) AS least, max(greatest(b, g, r)) AS most FROM pixels GROUP BY image")
def pixel_range(spark, sf_dir):
    return pixels(spark, sf_dir).groupBy("image").agg(F.min(F.least("b", "g", "r")).alias("least"), F.max(F.greatest("b", "g", "r")).alias("most"))


@query(f"""WITH {PIXELS}, p AS (SELECT image, y, x, unnest([0, 1, 2, 3, 4, 5]) AS plane, unnest([CASE WHEN y >= 4 THEN 0 ELSE b END, CASE WHEN y >= 4 THEN 0 ELSE g END, CASE WHEN y >= 4 THEN 0 ELSE r END, b, g, r]) / 255.0::DOUBLE AS value FROM pixels)
SELECT image, CAST(plane AS INTEGER) AS plane, y, x, round(value, 9) AS value FROM p""")
def pack_chw(spark, sf_dir):
    return rounded(px.packed_planes(pixels(spark, sf_dir), 4), 9, "value")


_PRED = "CASE image % 7 WHEN 0 THEN b / 255.0::DOUBLE + 5e-7 WHEN 1 THEN b / 200.0::DOUBLE ELSE b / 255.0::DOUBLE END"


@query(f"""WITH {PIXELS}, v AS (SELECT image, y, x, {_PRED} AS v FROM pixels)
SELECT image, y, x, CASE WHEN v < -1e-6 OR v > 1 + 1e-6 THEN 'kRangeViolation' ELSE 'kOk' END AS status, CASE WHEN v BETWEEN -1e-6 AND 1 + 1e-6 THEN CAST(floor(greatest(0, least(1, v)) * 255 + 0.5) AS BIGINT) END AS level,
 CASE WHEN v BETWEEN -1e-6 AND 1 + 1e-6 THEN CASE WHEN v > 1 OR v < 0 THEN 1 ELSE 0 END END AS corrected FROM v""")
def quantize(spark, sf_dir):
    v = F.when(F.col("image") % 7 == 0, F.col("b") / 255.0 + 5e-7).when(F.col("image") % 7 == 1, F.col("b") / 200.0).otherwise(F.col("b") / 255.0)
    return pixels(spark, sf_dir).select("image", "y", "x", px.quantized(v).alias("q")).select("image", "y", "x", "q.*")


def _layers(spark, sf_dir):
    """Base and generated channels under a mask that is blank at the border."""
    p = pixels(spark, sf_dir)
    mask = px.border_cleared(F.col("r") / 255.0, F.col("x"), F.col("y"), 8, 8, 1)
    pairs = F.array(*[F.struct(F.lit(n).alias("channel"), (F.col(a) / 255.0).alias("base"), (F.col(b) / 320.0 + 0.1).alias("gen")) for n, a, b in ((0, "b", "g"), (1, "g", "r"), (2, "r", "b"))])
    return p.select("image", "y", "x", mask.alias("mask"), F.explode(pairs).alias("c")).select("image", "c.channel", "y", "x", "c.base", "c.gen", "mask")


_LAYERS = f"""{PIXELS}, masked AS (SELECT *, CASE WHEN x < 1 OR y < 1 OR x >= 7 OR y >= 7 THEN 0.0 ELSE r / 255.0::DOUBLE END AS mask FROM pixels),
layers AS (SELECT image, y, x, mask, unnest([0, 1, 2]) AS channel, unnest([b, g, r]) / 255.0::DOUBLE AS base, unnest([g, r, b]) / 320.0::DOUBLE + 0.1 AS gen FROM masked)"""


@query(f"WITH {_LAYERS} SELECT image, channel, count(*) AS n, round(avg(base), 6) AS base_mean, round(stddev_pop(base), 6) AS base_std, round(avg(gen), 6) AS gen_mean, round(stddev_pop(gen), 6) AS gen_std FROM layers WHERE mask > 0.01 GROUP BY image, channel")
def masked_mean_std(spark, sf_dir):
    return rounded(px.masked_stats(_layers(spark, sf_dir)), 6, "base_mean", "base_std", "gen_mean", "gen_std")


_MATCHED = f"""{_LAYERS}, st AS (SELECT image, channel, count(*) AS n, avg(base) AS bm, stddev_pop(base) AS bs, avg(gen) AS gm, stddev_pop(gen) AS gs FROM layers WHERE mask > 0.01 GROUP BY image, channel),
tried AS (SELECT l.*, n, bm, gm, greatest(0, least(1, (gen - gm) * (bs / greatest(gs, 1e-6)) + bm)) AS c FROM layers l JOIN st USING (image, channel)),
after AS (SELECT image, channel, avg(c) AS cm FROM tried WHERE mask > 0.01 GROUP BY image, channel),
matched AS (SELECT image, channel, y, x, base, mask, CASE WHEN n < 4 OR abs(cm - bm) > abs(gm - bm) + 1e-6 THEN gen ELSE c END AS gen FROM tried JOIN after USING (image, channel))"""


@query(f"WITH {_MATCHED} SELECT image, channel, y, x, round(gen, 6) + 0.0 AS gen FROM matched")
def color_match(spark, sf_dir):
    return rounded(px.color_matched(_layers(spark, sf_dir)).select("image", "channel", "y", "x", "gen"), 6, "gen")


@query(f"WITH {_MATCHED} SELECT image, channel, y, x, round(gen * mask + base * (1 - mask), 6) + 0.0 AS value FROM matched")
def alpha_blend(spark, sf_dir):
    out = px.color_matched(_layers(spark, sf_dir)).select("image", "channel", "y", "x", px.alpha_blend(F.col("base"), F.col("gen"), F.col("mask")).alias("value"))
    return rounded(out, 6, "value")


@query(f"WITH {_LAYERS} SELECT image, 8::BIGINT AS width, 8::BIGINT AS height, round(min(mask), 6) AS min, round(max(mask), 6) AS max, round(avg(mask), 6) AS mean, count(*) FILTER (mask <> 0) AS non_zero FROM layers WHERE channel = 0 GROUP BY image")
def mask_border_clear(spark, sf_dir):
    return rounded(px.mask_stats(_layers(spark, sf_dir).where("channel = 0")), 6, "min", "max", "mean")


@query(f"""WITH {PIXELS}, gr AS (SELECT image, y, x, ((114 * b + 587 * g + 299 * r + 500) // 1000)::DOUBLE AS v FROM pixels),
l AS (SELECT a.image, u.v + d.v + l.v + r.v - 4 * a.v AS l FROM gr a JOIN gr u ON u.image = a.image AND u.x = a.x AND u.y = abs(a.y - 1) JOIN gr d ON d.image = a.image AND d.x = a.x AND d.y = CASE WHEN a.y = 7 THEN 6 ELSE a.y + 1 END
 JOIN gr l ON l.image = a.image AND l.y = a.y AND l.x = abs(a.x - 1) JOIN gr r ON r.image = a.image AND r.y = a.y AND r.x = CASE WHEN a.x = 7 THEN 6 ELSE a.x + 1 END)
SELECT image, round(sqrt(var_pop(l)), 6) AS deviation FROM l GROUP BY image""")
def sharpness(spark, sf_dir):
    gray = pixels(spark, sf_dir).select("image", "y", "x", px.gray(F.col("b"), F.col("g"), F.col("r")).cast("double").alias("v"))
    return rounded(px.laplacian_variance(gray).select("image", F.sqrt("sharpness").alias("deviation")), 6, "deviation")


@query(f"WITH {PIXELS} SELECT image, CAST(3 * (y * 8 + x) + c AS INTEGER) AS p, round(r / 255.0::DOUBLE, 9) AS value FROM pixels, (SELECT unnest(range(3)) AS c)")
def mask_channels(spark, sf_dir):
    at = F.struct("y", "x", "r")
    packed = pixels(spark, sf_dir).groupBy("image").agg(F.transform(F.array_sort(F.collect_list(at)), lambda p: p["r"]).alias("mask"))
    return rounded(packed.select("image", F.posexplode(px.replicated_mask(F.col("mask"), "u8")).alias("p", "value")), 9, "value")


def _taps(name: str, size: int, sigma: float) -> str:
    """SQL of a mirrored blur's weights: which place of 0 to 7 gives how much to which."""
    r = size // 2
    return f"""{name}0 AS (SELECT x, x + d AS p, exp(-d * d / (2 * {sigma}::DOUBLE * {sigma}::DOUBLE)) AS w FROM (SELECT unnest(range(8)) AS x), (SELECT unnest(range(-{r}, {r} + 1)) AS d)),
{name} AS (SELECT x, CASE WHEN p < 0 THEN -p WHEN p > 7 THEN 14 - p ELSE p END AS s, w / sum(w) OVER (PARTITION BY x) AS w FROM {name}0)"""


def _blurred(source: str, taps: str) -> str:
    return f"(SELECT image, c, b.x AS y, a.x AS x, sum(a.w * b.w * v) AS v FROM {source} JOIN {taps} a ON a.s = {source}.x JOIN {taps} b ON b.s = {source}.y GROUP BY ALL)"


@query(f"""WITH {PIXELS}, {_taps("t3", 3, 0.8)}, {_taps("t7", 7, 1.0)}, {_taps("t11", 11, 1.2)}, base AS (SELECT image, y, x, unnest(range(3)) AS c, CAST(unnest([b, g, r]) AS DOUBLE) AS v FROM pixels), gen AS (SELECT image, 7 - y AS y, 7 - x AS x, 2 - c AS c, v FROM base),
hard AS (SELECT image, c, y, x, CASE WHEN v > 99 THEN 1.0::DOUBLE ELSE 0 END AS v FROM gen WHERE c = 0), mask AS (SELECT image, y, x, greatest(0, least(1, v)) AS m FROM {_blurred("hard", "t3")}),
sharp AS (SELECT g.image, g.c, g.y, g.x, greatest(0, least(255, round_even(g.v * 1.25 - s.v * 0.25, 0))) / 255 AS g FROM gen g JOIN {_blurred("gen", "t7")} s USING (image, c, y, x)),
layers AS (SELECT image, c, y, x, g, base.v / 255 AS b, m, base.v / 255 - soft.v / 255 AS fine FROM sharp JOIN base USING (image, c, y, x) JOIN mask USING (image, y, x) JOIN {_blurred("base", "t11")} soft USING (image, c, y, x)),
st AS (SELECT image, c, count(*) AS n, avg(b) AS bm, stddev_pop(b) AS bs, avg(g) AS gm, stddev_pop(g) AS gs FROM layers WHERE m > 0.01 GROUP BY ALL),
tried AS (SELECT l.*, n, bm, gm, greatest(0, least(1, (g - gm) * (bs / greatest(gs, 1e-6)) + bm)) AS t FROM layers l LEFT JOIN st USING (image, c)), after AS (SELECT image, c, avg(t) AS tm FROM tried WHERE m > 0.01 GROUP BY ALL),
matched AS (SELECT tried.*, CASE WHEN coalesce(n, 0) < 4 OR abs(tm - bm) > abs(gm - bm) + 1e-6 THEN g ELSE t END AS h FROM tried LEFT JOIN after USING (image, c)),
done AS (SELECT image, round_even(greatest(0, least(1, h * m + b * (1 - m) + fine * m * 0.12)) * 255, 0) AS v FROM matched)
SELECT image, CAST(sum(v) AS BIGINT) AS total, max(v) AS most FROM done GROUP BY image""")
def raster_blend(spark, sf_dir):
    """Packed 8 x 8 planes through the dense kernels: a mask is blurred and the generated image blended in."""

    def kernel(base: np.ndarray, generated: np.ndarray) -> np.ndarray:
        mask = np.clip(raster.blur(np.where(generated[..., 0] > 99, 1.0, 0.0), 3), 0, 1)
        return raster.blend(base, raster.sharpen(generated), mask).astype(float)

    at = F.struct("y", "x", F.array("b", "g", "r").alias("v"))
    packed = pixels(spark, sf_dir).groupBy("image").agg(F.flatten(F.transform(F.array_sort(F.collect_list(at)), lambda p: p["v"])).alias("base"))
    packed = packed.withColumn("generated", F.reverse("base"))
    blended = packed.select("image", raster.image_udf(kernel, (8, 8, 3), (8, 8, 3))(F.col("base"), F.col("generated")).alias("v"))
    return blended.select("image", F.aggregate("v", F.lit(0.0), lambda s, v: s + v).cast("long").alias("total"), F.array_max("v").alias("most"))


@query()
def mouth_masks(spark, sf_dir):
    """Alpha masks of 96 x 96 over twenty points of each face."""

    def kernel(points: np.ndarray) -> np.ndarray:
        return raster.mouth_mask(points * 0.3 + 20)

    pts = F.flatten(F.transform(geometry.mouth_points(F.col("points")), lambda p: F.array(p["x"], p["y"])))
    masks = _face(spark, sf_dir).select("image", raster.image_udf(kernel, (20, 2))(pts).alias("mask"))
    return masks.select("image", F.size("mask").alias("n"), F.round(F.array_max("mask"), 6).alias("most"), F.size(F.filter("mask", lambda v: v > 0)).alias("non_zero"))
