"""Model inputs as columns: guards, channel planes and rows of a flat tensor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumentide.functions.signal import is_finite


@dataclass(frozen=True)
class ModelShape:
    """Face planes of side x side, and a mel chunk of bands x frames."""

    side: int = 96
    channels: int = 6
    bands: int = 80
    frames: int = 16

    @property
    def face(self) -> int:
        return self.channels * self.side * self.side

    @property
    def mel(self) -> int:
        return self.bands * self.frames


def _all_finite(values: Column) -> Column:
    return F.forall(values, lambda v: v.isNotNull() & is_finite(v))


def tensor_status(face: Column, mel: Column, s: ModelShape = ModelShape()) -> Column:
    """The first guard that flat buffers fail: sizes before values, the face before the mel chunk."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return (
        F.when(size(face) != s.face, "kInvalidFaceSize")
        .when(size(mel) != s.mel, "kInvalidMelChunkSize")
        .when(~_all_finite(face), "kNonFiniteFaceValue")
        .when(~_all_finite(mel), "kNonFiniteMelValue")
        .otherwise("kOk")
    )


def rows_of(values: Column, rows: int, width: int) -> Column:
    """A flat tensor as an array of ``rows`` arrays: a face by channel planes, a mel chunk (by frequency) by bands."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda k: F.slice(values, k * width + 1, F.lit(width)))


def face_planes(face: Column, s: ModelShape = ModelShape()) -> Column:
    return rows_of(face, s.channels, s.side * s.side)


def mel_bands(mel: Column, s: ModelShape = ModelShape()) -> Column:
    return rows_of(mel, s.bands, s.frames)


def build_status(width: Column, height: Column, channels: Column, mel: Column, s: ModelShape = ModelShape()) -> Column:
    """The first guard that a prepared 8-bit face and its mel chunk fail; nothing is resized or converted here."""
    return (
        F.when(width.isNull() | (width <= 0) | height.isNull() | (height <= 0), "kEmptyAlignedFace")
        .when((width != s.side) | (height != s.side), "kInvalidFaceSize")
        .when(channels != 3, "kInvalidFaceType")
        .when(F.coalesce(F.size(mel), F.lit(0)) != s.mel, "kInvalidMelChunkSize")
        .when(~_all_finite(mel), "kNonFiniteMelValue")
        .otherwise("kOk")
    )


def masked_planes(pixels: Column, s: ModelShape = ModelShape()) -> Column:
    """Interleaved BGR levels of a face as six flat planes of [0, 1]: the first three black from the middle row on."""
    area, half = s.side * s.side, s.side // 2 * s.side
    at = F.sequence(F.lit(0), F.lit(6 * area - 1))

    def value(k: Column) -> Column:
        pixel, plane = k % area, F.floor(k / area).cast("int")
        level = F.get(pixels, pixel * 3 + plane % 3) / F.lit(255.0)
        return F.when((plane < 3) & (pixel >= half), 0.0).otherwise(level)

    return F.transform(at, value)
