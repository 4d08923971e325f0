"""Queries over the face path: alignment, preparation, model inputs, preprocessing, image facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentide.functions import tensors
from lumentide.operators import face_path
from lumentide.plans.image_queries import _RECTS, _face, _rects
from lumentide.plans.registry import PIXELS, POINTS, pixels, query, rounded, table
from lumentide.sources import media

_M = [f"m{k}" for k in range(6)]
_I = [f"i{k}" for k in range(6)]


def _faces(spark, sf_dir):
    """A rectangle and 68 points for each image, some of them spoilt."""
    kind = F.col("image") % 11
    own = _face(spark, sf_dir).select("image", F.when(kind == 3, F.slice("points", 1, 67)).when(kind == 4, F.transform("points", lambda p: F.struct(F.lit(7.0).alias("x"), F.lit(9.0).alias("y")))).otherwise(F.col("points")).alias("points"))
    both = _rects(spark, sf_dir).join(own, "image")
    return both.select("*", F.when(kind == 1, 0).otherwise(160).alias("width"), F.lit(120).alias("height"), F.when(kind == 2, 1).otherwise(3).alias("channels"))


def _told(rows, points: str):
    at = lambda k, c: F.col(points)[k][c].alias(f"{c}{k}")
    named = [F.col("matrix")[f"m{k}"].alias(m) for k, m in enumerate(_M)] + [F.col("inverse")[f"m{k}"].alias(i) for k, i in enumerate(_I)]
    return [*named, at(0, "x"), at(0, "y"), at(67, "x"), at(67, "y")]


_DIGITS = ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in (*_M, *_I, "x0", "y0", "x67", "y67"))
_INVERSE = "m4 / det AS i0, -m1 / det AS i1, (m1 * m5 - m4 * m2) / det AS i2, -m3 / det AS i3, m0 / det AS i4, (m3 * m2 - m0 * m5) / det AS i5, m0 * fx + m1 * fy + m2 AS x0, m3 * fx + m4 * fy + m5 AS y0, m0 * lx0 + m1 * ly0 + m2 AS x67, m3 * lx0 + m4 * ly0 + m5 AS y67"


@query(f"""WITH {POINTS}, {_RECTS}, e AS (SELECT image, avg(px) FILTER (k BETWEEN 4 AND 9) AS ax, avg(py) FILTER (k BETWEEN 4 AND 9) AS ay, avg(px) FILTER (k BETWEEN 10 AND 15) AS bx, avg(py) FILTER (k BETWEEN 10 AND 15) AS bz,
 max(px) FILTER (k = 0) AS fx, max(py) FILTER (k = 0) AS fy, max(px) FILTER (k = 3) AS lx0, max(py) FILTER (k = 3) AS ly0 FROM pts GROUP BY image),
s AS (SELECT image, fx, fy, lx0, ly0, CASE WHEN ax < bx THEN ax ELSE bx END AS lx, CASE WHEN ax < bx THEN ay ELSE bz END AS ly, CASE WHEN ax < bx THEN bx ELSE ax END AS rx, CASE WHEN ax < bx THEN bz ELSE ay END AS ry,
 CASE WHEN image % 11 = 1 THEN 'kEmptyImage' WHEN image % 11 = 2 THEN 'kInvalidImageType' WHEN greatest(0, least(x + w, 160) - greatest(x, 0)) = 0 OR greatest(0, least(y + h, 120) - greatest(y, 0)) = 0 THEN 'kInvalidFaceRect'
  WHEN image % 11 = 3 THEN 'kInvalidLandmarkCount' WHEN image % 11 = 4 THEN 'kDegenerateEyeGeometry' ELSE 'kOk' END AS status FROM e JOIN rects USING (image)),
c AS (SELECT *, 38.4 / (power(rx - lx, 2) + power(ry - ly, 2)) AS k, (lx + rx) / 2 AS cx, (ly + ry) / 2 AS cy FROM s),
m AS (SELECT *, k * (rx - lx) AS m0, k * (ry - ly) AS m1, (1 - k * (rx - lx)) * cx - k * (ry - ly) * cy + 48 - cx AS m2, -k * (ry - ly) AS m3, k * (rx - lx) AS m4, k * (ry - ly) * cx + (1 - k * (rx - lx)) * cy + 38.4 - cy AS m5 FROM c WHERE status = 'kOk'),
d AS (SELECT *, m0 * m4 - m1 * m3 AS det FROM m), o AS (SELECT image, {", ".join(_M)}, {_INVERSE} FROM d), r AS (SELECT image, {_DIGITS} FROM o)
SELECT image, status, {", ".join((*_M, *_I))}, x0, y0, x67, y67 FROM s LEFT JOIN r USING (image)""")
def align_faces(spark, sf_dir):
    out = face_path.align_faces(_faces(spark, sf_dir))
    return rounded(out.select("image", "status", *_told(out, "aligned")), 4, *_M, *_I, "x0", "y0", "x67", "y67")


@query(f"""WITH {POINTS}, {_RECTS}, p AS (SELECT image, max(px) FILTER (k = 0) AS fx, max(py) FILTER (k = 0) AS fy, max(px) FILTER (k = 3) AS lx0, max(py) FILTER (k = 3) AS ly0 FROM pts GROUP BY image),
c AS (SELECT *, greatest(0, x) AS l, greatest(0, y) AS t, least(160, x + w) AS r, least(120, y + h + 10) AS b FROM rects JOIN p USING (image)),
s AS (SELECT *, CASE WHEN image % 11 = 1 THEN 'kEmptySourceImage' WHEN image % 11 = 2 THEN 'kInvalidSourceImageType' WHEN w <= 0 OR h <= 0 THEN 'kInvalidFaceRect' WHEN image % 11 = 3 THEN 'kInvalidFaceLandmarks' WHEN r <= l OR b <= t THEN 'kInvalidFaceRect' ELSE 'kOk' END AS status FROM c),
k AS (SELECT image, l, t, r - l AS cw, b - t AS ch, 96.0::DOUBLE / (r - l) AS m0, 0.0::DOUBLE AS m1, 0.0::DOUBLE AS m3, 96.0::DOUBLE / (b - t) AS m4, CASE WHEN image % 11 = 4 THEN 7 ELSE fx END AS fx, CASE WHEN image % 11 = 4 THEN 9 ELSE fy END AS fy, CASE WHEN image % 11 = 4 THEN 7 ELSE lx0 END AS lx0, CASE WHEN image % 11 = 4 THEN 9 ELSE ly0 END AS ly0 FROM s WHERE status = 'kOk'),
m AS (SELECT *, -l * m0 + (m0 - 1) * 0.5 AS m2, -t * m4 + (m4 - 1) * 0.5 AS m5, m0 * m4 AS det FROM k), o AS (SELECT image, {", ".join(_M)}, {_INVERSE} FROM m), r AS (SELECT image, {_DIGITS} FROM o)
SELECT image, status, {", ".join((*_M, *_I))}, x0, y0, x67, y67, m.l AS cx, m.t AS cy, m.cw, m.ch FROM s LEFT JOIN r USING (image) LEFT JOIN (SELECT image, l, t, cw, ch FROM m) m USING (image)""")
def prepare_faces(spark, sf_dir):
    out = face_path.prepare_faces(_faces(spark, sf_dir))
    crop = [F.col("crop")[c].alias(f"c{c}") for c in "xywh"]
    return rounded(out.select("image", "status", *_told(out, "prepared"), *crop), 4, *_M, *_I, "x0", "y0", "x67", "y67")


_SMALL = tensors.ModelShape(side=4, channels=6, bands=8, frames=4)
_SPOILT = "vec_id % 9"


@query(f"""WITH v AS (SELECT vec_id AS image, CAST(embedding AS DOUBLE[]) AS e, CASE {_SPOILT} WHEN 1 THEN 'kEmptyAlignedFace' WHEN 2 THEN 'kInvalidFaceSize' WHEN 3 THEN 'kInvalidFaceType' WHEN 4 THEN 'kInvalidMelChunkSize' WHEN 5 THEN 'kNonFiniteMelValue' ELSE 'kOk' END AS status FROM embeddings),
p AS (SELECT image, e, unnest(range(96)) AS p FROM v WHERE status = 'kOk'),
f AS (SELECT image, CAST(p AS INTEGER) AS p, round(CASE WHEN p // 16 < 3 AND p % 16 >= 8 THEN 0 ELSE floor(abs(e[p % 16 * 3 + p // 16 % 3 + 1]) * 1000 % 256) / 255.0::DOUBLE END, 9) AS value FROM p)
SELECT image, status, p, value FROM v LEFT JOIN f USING (image)""")
def build_inputs(spark, sf_dir):
    kind = F.expr(_SPOILT)
    mel = F.slice(F.transform("embedding", lambda v: v.cast("double")), 1, 32)
    faces = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image"), F.when(kind == 1, 0).when(kind == 2, 5).otherwise(4).alias("width"), F.lit(4).alias("height"), F.when(kind == 3, 4).otherwise(3).alias("channels"),
        F.transform(F.slice("embedding", 1, 48), lambda v: F.floor(F.abs(v.cast("double")) * 1000 % 256).cast("int")).alias("pixels"),
        F.when(kind == 4, F.slice(mel, 1, 31)).when(kind == 5, F.concat(F.array(F.lit(float("nan"))), F.slice(mel, 1, 31))).otherwise(mel).alias("mel"),
    )
    out = face_path.build_inputs(faces, _SMALL).select("image", F.col("build_status").alias("status"), F.posexplode_outer("face_chw").alias("p", "value"))
    return rounded(out, 9, "value")


_TINY = tensors.ModelShape(side=2, channels=6, bands=5, frames=4)


@query(f"""WITH v AS (SELECT vec_id AS image, CAST(embedding AS DOUBLE[]) AS e, CASE {_SPOILT} WHEN 1 THEN 'kInvalidFaceSize' WHEN 2 THEN 'kInvalidMelChunkSize' WHEN 3 THEN 'kNonFiniteFaceValue' WHEN 4 THEN 'kNonFiniteMelValue' ELSE 'kOk' END AS status FROM embeddings),
p AS (SELECT image, e, unnest(range(44)) AS p FROM v WHERE status = 'kOk'),
r AS (SELECT image, CASE WHEN p < 24 THEN 'face' ELSE 'mel' END AS part, CAST(CASE WHEN p < 24 THEN p // 4 ELSE (p - 24) // 4 END AS INTEGER) AS row, CAST(p % 4 AS INTEGER) AS col, round(e[p + 1], 6) + 0.0 AS value FROM p)
SELECT image, status, part, row, col, value FROM v LEFT JOIN r USING (image)""")
def tensor_layout(spark, sf_dir):
    kind, e = F.expr(_SPOILT), F.transform("embedding", lambda v: v.cast("double"))
    bad = F.array(F.lit(float("nan")))
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image"), F.when(kind == 1, F.slice(e, 1, 23)).when(kind == 3, F.concat(bad, F.slice(e, 1, 23))).otherwise(F.slice(e, 1, 24)).alias("face"),
        F.when(kind == 2, F.slice(e, 1, 19)).when(kind == 4, F.concat(bad, F.slice(e, 1, 19))).otherwise(F.slice(e, 25, 20)).alias("mel"),
    )
    checked = rows.withColumn("status", tensors.tensor_status(F.col("face"), F.col("mel"), _TINY))
    parts = F.array(F.struct(F.lit("face").alias("part"), tensors.face_planes(F.col("face"), _TINY).alias("rows")), F.struct(F.lit("mel").alias("part"), tensors.mel_bands(F.col("mel"), _TINY).alias("rows")))
    told = checked.select("image", "status", F.explode_outer(F.when(F.col("status") == "kOk", parts)).alias("x"))
    told = told.select("image", "status", "x.part", F.posexplode_outer("x.rows").alias("row", "values"))
    return rounded(told.select("image", "status", "part", "row", F.posexplode_outer("values").alias("col", "value")), 6, "value")


def _packed_images(spark, sf_dir):
    """8 x 8 images as packed bytes, of one, two, three or no channels."""
    kind, at = F.col("image") % 7, F.struct("y", "x", F.array("b", "g", "r").alias("v"))
    packed = pixels(spark, sf_dir).groupBy("image").agg(F.transform(F.array_sort(F.collect_list(at)), lambda p: p["v"]).alias("v"))
    levels = F.when(kind == 1, F.transform("v", lambda v: v[0])).when(kind == 2, F.flatten(F.transform("v", lambda v: F.slice(v, 1, 2)))).otherwise(F.flatten("v"))
    data = F.unhex(F.array_join(F.transform(levels, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return packed.select("image", F.when(kind == 3, 0).otherwise(8).alias("width"), F.lit(8).alias("height"), F.when(kind == 1, 1).when(kind == 2, 2).otherwise(3).alias("channels"), data.alias("data"))


@query(f"""WITH {PIXELS}, s AS (SELECT DISTINCT image, CASE image % 7 WHEN 3 THEN 'kEmptyImage' WHEN 2 THEN 'kInvalidChannels' ELSE 'kOk' END AS status FROM pixels),
c AS (SELECT image, y // 2 AS y, x // 2 AS x, round_even(avg(CASE WHEN image % 7 = 1 THEN b ELSE r END), 0) AS c0, round_even(avg(CASE WHEN image % 7 = 1 THEN b ELSE g END), 0) AS c1, round_even(avg(b), 0) AS c2 FROM pixels GROUP BY ALL),
v AS (SELECT image, y, x, unnest(range(3)) AS c, unnest([c0, c1, c2]) / 127.5::DOUBLE - 1 AS v FROM c),
r AS (SELECT image, CAST((y * 4 + x) * 3 + c AS INTEGER) AS p, round(v, 5) + 0.0 AS value FROM v JOIN s USING (image) WHERE status = 'kOk'), m AS (SELECT image, min(value) AS least, max(value) AS most FROM r GROUP BY image)
SELECT image, status, least, most, p, value FROM s LEFT JOIN m USING (image) LEFT JOIN r USING (image)""")
def preprocess_images(spark, sf_dir):
    out = face_path.preprocess_images(_packed_images(spark, sf_dir), 4, rgb=True, mode="signed")
    told = out.select("image", "status", "least", "most", F.posexplode_outer("values").alias("p", "value"))
    return rounded(told.withColumn("value", F.col("value").cast("double")), 5, "least", "most", "value")


_BLEND = "CASE vec_id % 10 WHEN 1 THEN 'kEmptyBaseImage' WHEN 2 THEN 'kInvalidBaseImageType' WHEN 3 THEN 'kEmptyGeneratedImage' WHEN 4 THEN 'kInvalidGeneratedType' WHEN 5 THEN 'kInvalidGeneratedSize' WHEN 6 THEN 'kEmptyMask' WHEN 7 THEN 'kInvalidInverseTransform' ELSE 'kOk' END"


@query(f"WITH s AS (SELECT vec_id AS image, {_BLEND} AS status FROM embeddings) SELECT image, status, CASE WHEN status = 'kOk' THEN 100 + image % 50 END AS least, CASE WHEN status = 'kOk' THEN 100 + image % 50 END AS most FROM s")
def blend_mouths(spark, sf_dir):
    """A flat base under a flat generated face: the colours are matched, so the base's level stays."""
    k, side = F.col("vec_id") % 10, 12
    flat = lambda level, n: F.unhex(F.repeat(F.lpad(F.hex(level), 2, "0"), F.lit(n)))
    shift = F.struct(*[F.lit(float(v)).alias(f"m{i}") for i, v in enumerate((1, 0, 2, 0, 1, 3))])
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image"), F.when(k == 1, 0).otherwise(side).alias("width"), F.lit(side).alias("height"), F.when(k == 2, 1).otherwise(3).alias("channels"), flat(100 + F.col("vec_id") % 50, 3 * side * side).alias("data"),
        F.when(k == 3, 0).when(k == 5, 7).otherwise(8).alias("gen_width"), F.lit(8).alias("gen_height"), F.when(k == 4, 4).otherwise(3).alias("gen_channels"), flat(F.lit(180), 3 * 64).alias("gen_data"),
        F.when(k != 6, F.array_repeat(F.lit(0.5), 64)).alias("mask_values"), F.when(k != 7, shift).alias("inverse"),
    )
    out = face_path.blend_mouths(rows, 8)
    levels = F.when(F.col("status") == "kOk", F.transform(F.sequence(F.lit(1), F.lit(3 * side * side)), lambda p: F.conv(F.hex(F.substring(F.col("blended"), p, F.lit(1))), 16, 10).cast("long")))
    return out.select("image", "status", F.array_min(levels).alias("least"), F.array_max(levels).alias("most"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'a/' || l_partkey || '.PNG' WHEN 2 THEN 'a/' || l_partkey || '.txt' ELSE 'a/' || l_partkey || '.jpeg' END AS path, l_suppkey % 7 <> 0 AS found, l_suppkey % 3 <> 0 AS file FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN path = '' THEN 'kEmptyPath' WHEN NOT found THEN 'kFileNotFound' WHEN NOT file THEN 'kNotRegularFile' WHEN path LIKE '%.txt' THEN 'kUnsupportedFormat' ELSE 'kOk' END AS status FROM v""")
def image_path_validation(spark, sf_dir):
    path = F.expr("CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'a/' || l_partkey || '.PNG' WHEN 2 THEN 'a/' || l_partkey || '.txt' ELSE 'a/' || l_partkey || '.jpeg' END")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", media.image_path_status(path, F.col("l_suppkey") % 7 != 0, F.col("l_suppkey") % 3 != 0).alias("status"))


@query("""WITH v AS (SELECT o_orderkey, o_orderkey % 4 AS w, o_custkey % 3 AS h, [1, 3, 4][o_orderkey % 3 + 1] AS n FROM orders)
SELECT o_orderkey, CASE WHEN w > 0 AND h > 0 THEN 'x' || o_orderkey || '.bmp' ELSE '' END AS path, CASE WHEN w > 0 AND h > 0 THEN 'bmp' ELSE '' END AS format, CAST(CASE WHEN w > 0 AND h > 0 THEN w ELSE 0 END AS INTEGER) AS width, CAST(CASE WHEN w > 0 AND h > 0 THEN h ELSE 0 END AS INTEGER) AS height,
 CAST(CASE WHEN w > 0 AND h > 0 THEN n ELSE 0 END AS INTEGER) AS channels, CAST(CASE WHEN w > 0 AND h > 0 THEN (n - 1) * 8 ELSE 0 END AS INTEGER) AS type, 0 AS depth, CAST(CASE WHEN w > 0 AND h > 0 THEN n ELSE 0 END AS INTEGER) AS elem_size, w > 0 AND h > 0 AS continuous FROM v""")
def image_info(spark, sf_dir):
    images = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("x"), "o_orderkey", F.lit(".bmp")).alias("path"), (F.col("o_orderkey") % 4).alias("width"), (F.col("o_custkey") % 3).alias("height"), F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4)), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("channels"))
    return media.image_info(images, "o_orderkey")


@query("SELECT o_orderkey, CAST(floor(16000 * (o_orderkey % 400) / 1000.0 + 0.5) AS BIGINT) AS samples, round(o_custkey * 1000.0::DOUBLE / 44100, 6) AS ms FROM orders")
def samples_and_ms(spark, sf_dir):
    from lumentide.functions import framing

    out = table(spark, sf_dir, "orders").select("o_orderkey", framing.samples_in(F.col("o_orderkey") % 400, F.lit(16000)).alias("samples"), framing.ms_of(F.col("o_custkey"), F.lit(44100)).alias("ms"))
    return rounded(out, 6, "ms")

