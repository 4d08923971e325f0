"""The face path over tables: alignment, preparation, model inputs and blending, each row with a status.

Geometry and guards are columns; a row that fails keeps its place and says why. Pixels
are touched by numpy kernels behind mapInPandas, in slices of bounded bytes, and only of
rows whose status is kOk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentide.functions import geometry, tensors
from lumentide.operators import raster

#: bytes of images that a kernel's slice holds
SLICE_BYTES = 1 << 26


@dataclass(frozen=True)
class AlignOptions:
    size: int = 96
    distance: float = 0.40
    center: tuple[float, float] = (0.50, 0.40)


@dataclass(frozen=True)
class PrepareOptions:
    """Pads: top, bottom, left, right."""

    size: int = 96
    pads: tuple[int, int, int, int] = (0, 10, 0, 0)


def _matrix(m: Column) -> list[Column]:
    return [m[f"m{k}"] for k in range(6)]


def _named(values: list[Column]) -> Column:
    return F.struct(*[v.alias(f"m{k}") for k, v in enumerate(values)])


def _image_status(width: Column, height: Column, channels: Column, empty: str, kind: str) -> Column:
    return F.when(F.coalesce(width, F.lit(0)) <= 0, empty).when(F.coalesce(height, F.lit(0)) <= 0, empty).when(channels != 3, kind)


def align_faces(faces: DataFrame, o: AlignOptions = AlignOptions()) -> DataFrame:
    """Adds status, matrix, inverse and aligned (the moved points). Needs width, height, channels, x, y, w, h and points."""
    c = F.col
    box = geometry.rect_clamp(c("x"), c("y"), c("w"), c("h"), c("width"), c("height"))
    eyes = [geometry.centroid(F.slice("points", first + 1, last - first)) for first, last in (geometry.FIRST_EYE, geometry.SECOND_EYE)]
    m = geometry.eye_matrix(*eyes, o.size, o.distance, o.center)
    known = _image_status(c("width"), c("height"), c("channels"), "kEmptyImage", "kInvalidImageType")
    known = known.when((box["w"] <= 0) | (box["h"] <= 0), "kInvalidFaceRect").when(F.coalesce(F.size("points"), F.lit(0)) != geometry.LANDMARKS, "kInvalidLandmarkCount")
    out = faces.withColumn("status", known).withColumn("matrix", F.when(c("status").isNull(), m))
    out = out.withColumn("status", F.coalesce("status", F.when(c("matrix").isNull(), "kDegenerateEyeGeometry").otherwise("kOk")))
    ok = c("matrix").isNotNull()
    return out.withColumn("inverse", F.when(ok, _named(geometry.invert_affine(_matrix(c("matrix")))))).withColumn("aligned", F.when(ok, geometry.apply_affine(c("points"), _matrix(c("matrix")))))


def prepare_faces(faces: DataFrame, o: PrepareOptions = PrepareOptions()) -> DataFrame:
    """Adds status, crop, matrix, inverse and prepared (the moved points). Needs what ``align_faces`` needs."""
    c = F.col
    crop = geometry.padded_crop(c("x"), c("y"), c("w"), c("h"), c("width"), c("height"), o.pads)
    known = _image_status(c("width"), c("height"), c("channels"), "kEmptySourceImage", "kInvalidSourceImageType")
    if min(o.pads) < 0:
        known = known.otherwise("kInvalidFacePadding")
    else:
        known = known.when((c("w") <= 0) | (c("h") <= 0), "kInvalidFaceRect").when(F.coalesce(F.size("points"), F.lit(0)) != geometry.LANDMARKS, "kInvalidFaceLandmarks")
    out = faces.withColumn("status", known).withColumn("crop", F.when(c("status").isNull(), crop))
    out = out.withColumn("status", F.coalesce("status", F.when(c("crop").isNull(), "kInvalidFaceRect").otherwise("kOk")))
    out = out.withColumn("matrix", geometry.crop_matrix(c("crop"), o.size))
    ok = c("crop").isNotNull()
    return out.withColumn("inverse", F.when(ok, _named(geometry.invert_affine(_matrix(c("matrix")))))).withColumn("prepared", F.when(ok, geometry.apply_affine(c("points"), _matrix(c("matrix")))))


def build_inputs(faces: DataFrame, shape: tensors.ModelShape = tensors.ModelShape()) -> DataFrame:
    """Adds build_status and face_chw (flat planes of [0, 1]) of prepared faces: width, height, channels, pixels (interleaved levels) and mel; all other columns pass through."""
    c = F.col
    status = tensors.build_status(c("width"), c("height"), c("channels"), c("mel"), shape)
    out = faces.withColumn("build_status", status)
    return out.withColumn("face_chw", F.when(c("build_status") == "kOk", tensors.masked_planes(c("pixels"), shape)))


# pixels


def _kernel_rows(df: DataFrame, out: str, kernel: Callable[[dict], bytes | None], weight: Callable[[dict], int], columns: list[str]) -> DataFrame:
    """Adds the binary column ``out``: what the kernel makes of a row's columns, for rows of status kOk."""
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made, begin, size = [], 0, 0
            for k, row in enumerate(frame[columns].to_dict("records")):
                made.append(kernel(row) if frame["status"].iat[k] == "kOk" else None)
                size += weight(row)
                if size >= SLICE_BYTES:
                    yield frame.iloc[begin : k + 1].assign(**{out: made})
                    made, begin, size = [], k + 1, 0
            if made:
                yield frame.iloc[begin:].assign(**{out: made})

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` binary").select(*names, out)


def _pixels(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(int(row["height"]), int(row["width"]), int(row["channels"]))


def _values(m) -> np.ndarray:
    return np.array([m[f"m{k}"] for k in range(6)], float).reshape(2, 3)


def _weight(row: dict) -> int:
    return len(row["data"] or b"")


def warp_aligned(aligned: DataFrame, o: AlignOptions = AlignOptions()) -> DataFrame:
    """Adds aligned_data: the face of each row of ``align_faces`` by its matrix, cubic, black outside. Needs data."""

    def kernel(row: dict) -> bytes:
        out = raster.warp(_pixels(row), _values(row["matrix"]), o.size, o.size, cubic=True)
        return np.clip(np.rint(out), 0, 255).astype(np.uint8).tobytes()

    return _kernel_rows(aligned, "aligned_data", kernel, _weight, ["data", "width", "height", "channels", "matrix"])


def resize_prepared(prepared: DataFrame, o: PrepareOptions = PrepareOptions()) -> DataFrame:
    """Adds prepared_data: the padded crop of each row of ``prepare_faces``, resized. Needs data."""

    def kernel(row: dict) -> bytes:
        crop, image = row["crop"], _pixels(row)
        cut = image[crop["y"] : crop["y"] + crop["h"], crop["x"] : crop["x"] + crop["w"]]
        return np.rint(raster.resize(cut, o.size, o.size)).astype(np.uint8).tobytes()

    return _kernel_rows(prepared, "prepared_data", kernel, _weight, ["data", "width", "height", "channels", "crop"])


def blend_status(size: int = 96) -> Column:
    """The first guard that a blend's inputs fail: base, generated face, mask, matrix. Needs width, height, channels, gen_width, gen_height, gen_channels, mask_values and inverse."""
    c = F.col
    status = _image_status(c("width"), c("height"), c("channels"), "kEmptyBaseImage", "kInvalidBaseImageType")
    status = status.when((F.coalesce(c("gen_width"), F.lit(0)) <= 0) | (F.coalesce(c("gen_height"), F.lit(0)) <= 0), "kEmptyGeneratedImage").when(c("gen_channels") != 3, "kInvalidGeneratedType")
    status = status.when((c("gen_width") != size) | (c("gen_height") != size), "kInvalidGeneratedSize")
    return status.when(F.coalesce(F.size("mask_values"), F.lit(0)) == 0, "kEmptyMask").when(c("inverse").isNull(), "kInvalidInverseTransform").otherwise("kOk")


def blend_mouths(rows: DataFrame, size: int = 96) -> DataFrame:
    """Adds status and blended: the generated mouth sharpened, laid into the original by the inverse matrix, colour matched, blended and its detail restored. Needs what ``blend_status`` needs, data and gen_data."""

    def kernel(row: dict) -> bytes:
        generated = np.frombuffer(row["gen_data"], np.uint8).reshape(size, size, 3)
        mask = np.asarray(row["mask_values"], float).reshape(size, size)
        return raster.blend_mouth(_pixels(row), generated, mask, _values(row["inverse"])).tobytes()

    columns = ["data", "width", "height", "channels", "gen_data", "mask_values", "inverse"]
    return _kernel_rows(rows.withColumn("status", blend_status(size)), "blended", kernel, lambda row: 9 * _weight(row), columns)


def preprocess_status(width: Column, height: Column, channels: Column, size: int = 96) -> Column:
    if size <= 0:
        return F.when((F.coalesce(width, F.lit(0)) <= 0) | (F.coalesce(height, F.lit(0)) <= 0), "kEmptyImage").otherwise("kInvalidTargetSize")
    empty = (F.coalesce(width, F.lit(0)) <= 0) | (F.coalesce(height, F.lit(0)) <= 0)
    return F.when(empty, "kEmptyImage").when(~channels.isin(1, 3, 4), "kInvalidChannels").otherwise("kOk")


def preprocess_images(images: DataFrame, size: int = 96, rgb: bool = False, mode: str = "unit") -> DataFrame:
    """A batch of images (width, height, channels, data), failures kept: adds status, values (flat float32 of size x size x 3), least and most."""
    checked = images.withColumn("status", preprocess_status(F.col("width"), F.col("height"), F.col("channels"), size))
    names = checked.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, SLICE_BYTES // (size * size * 3 * 8))
        for frame in frames:
            for at in range(0, len(frame), step):
                part = frame.iloc[at : at + step].reset_index(drop=True)
                made = [(None, None, None)] * len(part)
                # images of one shape go through the kernel together
                shapes = part[["height", "width", "channels"]][part["status"] == "kOk"]
                for shape, own in shapes.groupby(["height", "width", "channels"]).groups.items():
                    stack = np.stack([np.frombuffer(part["data"].iat[k], np.uint8).reshape([int(v) for v in shape]) for k in own])
                    for k, out in zip(own, raster.preprocess_stack(stack, size, rgb, mode), strict=True):
                        made[k] = (out.astype(np.float32).ravel(), float(out.min()), float(out.max()))
                yield part.assign(**dict(zip(("values", "least", "most"), map(list, zip(*made, strict=True)), strict=True)))

    return checked.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in checked.schema) + ", values array<float>, least double, most double").select(*names, "values", "least", "most")
