"""Face detection and landmarks around a pluggable detector; guards and post-processing are ours.

A detector is picklable and has ``faces(image, upsample) -> [(x, y, w, h), ...]`` and
``landmarks(image, rect) -> 68 points``. No model ships here; ``BrightBox`` is a
deterministic stand-in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lumentide.operators.raster import resize

SCHEMA = "image string, face int, status string, x int, y int, w int, h int, points array<struct<x:double,y:double>>, score double"


class Detector(Protocol):
    def faces(self, image: np.ndarray, upsample: int) -> list[tuple[int, int, int, int]]: ...
    def landmarks(self, image: np.ndarray, rect: tuple[int, int, int, int]) -> np.ndarray: ...


@dataclass
class BrightBox:
    """Takes the box of all pixels over ``level`` for a face, and spreads 68 points over it."""

    level: int = 128

    def faces(self, image, upsample):
        y, x = np.nonzero(image.max(2) > self.level)
        return [(int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1))] if len(x) else []

    def landmarks(self, image, rect):
        x, y, w, h = rect
        t = np.arange(68)
        return np.stack((x + (t % 10) / 10 * w, y + (t // 10) / 7 * h), 1)


@dataclass(frozen=True)
class DetectOptions:
    most_width: int = 1600
    least_width: int = 800
    least_face: int = 64
    upsamples: tuple[int, ...] = (0, 1)
    clamp: bool = True


def as_bgr(image: np.ndarray) -> np.ndarray | None:
    if image.ndim == 2 or image.shape[2] == 1:
        return np.repeat(image.reshape(*image.shape[:2], 1), 3, axis=2)
    return image[..., :3] if image.shape[2] in (3, 4) else None


def detect(image: np.ndarray, detector: Detector, o: DetectOptions = DetectOptions()) -> tuple[str, list[tuple[int, int, int, int]]]:
    """(status, rectangles in the image). No face is a success of its own status."""
    if image.size == 0:
        return "kEmptyImage", []
    bgr = as_bgr(image)
    if bgr is None:
        return "kInvalidImageChannels", []
    h, w = bgr.shape[:2]
    to = min(max(w, o.least_width), o.most_width)
    scaled = bgr if to == w else np.rint(resize(bgr, max(1, round(h * to / w)), to)).astype(np.uint8)
    found: list = []
    for upsample in o.upsamples:  # a second look only where the first finds nothing
        found = detector.faces(scaled, upsample)
        if found:
            break
    out = []
    for rect in found:
        x, y, fw, fh = (round(v * w / to) for v in rect)
        if o.clamp:
            left, top = max(0, x), max(0, y)
            x, y, fw, fh = left, top, max(0, min(x + fw, w) - left), max(0, min(y + fh, h) - top)
        if fw > 0 and fh > 0:
            out.append((x, y, fw, fh))
    return ("kOk" if out else "kNoFace"), out


def landmarks(image: np.ndarray, rect: tuple[int, int, int, int], detector: Detector | None, o: DetectOptions = DetectOptions()) -> tuple[str, np.ndarray | None, float | None]:
    """(status, points, score)."""
    if detector is None:
        return "kModelNotLoaded", None, None
    if image.size == 0:
        return "kEmptyImage", None, None
    bgr = as_bgr(image)
    if bgr is None:
        return "kInvalidImageChannels", None, None
    (x, y, w, h), (height, width) = rect, bgr.shape[:2]
    if not (w > 0 and h > 0 and x >= 0 and y >= 0 and x + w <= width and y + h <= height):
        return "kInvalidFaceRect", None, None
    if w < o.least_face or h < o.least_face:
        return "kFaceTooSmall", None, None
    points = np.asarray(detector.landmarks(bgr, rect), float)
    inside = ((points >= 0) & (points < (width, height))).all()
    return "kOk", points, 0.3 * (w >= o.least_face) + 0.3 * (h >= o.least_face) + 0.4 * bool(inside)


def detect_faces(images: DataFrame, detector: Detector, o: DetectOptions = DetectOptions()) -> DataFrame:
    """One row for each face of images (path, status, width, height, channels, data), or one that says why there is none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if r.status != "kOk":
                    rows.append((r.path, None, r.status, *[None] * 6))
                    continue
                image = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.channels))
                status, rects = detect(image, detector, o)
                if not rects:
                    rows.append((r.path, None, status, *[None] * 6))
                for k, rect in enumerate(rects):
                    status, points, score = landmarks(image, rect, detector, o)
                    rows.append((r.path, k, status, *rect, None if points is None else [{"x": float(a), "y": float(b)} for a, b in points], score))
            out = pd.DataFrame(rows, columns=["image", "face", "status", "x", "y", "w", "h", "points", "score"])
            yield out.astype({c: "Int32" for c in ("face", "x", "y", "w", "h")})

    return images.select("path", "status", "width", "height", "channels", "data").mapInPandas(run, SCHEMA)
