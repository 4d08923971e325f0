"""Batched model inference with input guards, classified retries and per-row status.

A failure is a row, never an exception: batches keep their alignment. The model is any
picklable object with ``predict(mel, face) -> prediction``; one that has ``predict_batch(mels,
faces) -> predictions`` is given the good rows of a slice at once, and only rows of a slice
that fails are tried one by one. Workers unpickle the model once for each task. Retries
are of a row within its task and have nothing to do with Spark's.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentide.operators.raster import sharpness

FACE, MEL, PREDICTION, SIDE = 6 * 96 * 96, 80 * 16, 3 * 96 * 96, 96
SLICE = 64
RETRYABLE = ("kExtractFailed", "kOutputEmpty")
RESULT = "status string, pred array<float>, attempts int, recovered boolean, first_failure string, model_generation long"


class Model(Protocol):
    def predict(self, mel: np.ndarray, face: np.ndarray) -> np.ndarray: ...


class ExtractFailed(Exception):
    """A forward pass that may succeed if tried again."""


@dataclass
class StandIn:
    """A deterministic model: the upper half as it is, the lower half scaled by the mel mean."""

    def predict(self, mel: np.ndarray, face: np.ndarray) -> np.ndarray:
        out = face.reshape(6, SIDE, SIDE)[3:].astype(np.float32).copy()
        out[:, SIDE // 2 :] *= np.float32(np.clip(0.5 + mel.mean() / 8, 0, 1))
        return np.clip(out, 0, 1).ravel()

    def predict_batch(self, mels: np.ndarray, faces: np.ndarray) -> np.ndarray:
        out = faces.reshape(-1, 6, SIDE, SIDE)[:, 3:].astype(np.float32)
        out[:, :, SIDE // 2 :] *= np.clip(0.5 + mels.mean(axis=1) / 8, 0, 1).astype(np.float32)[:, None, None, None]
        return np.clip(out, 0, 1, out=out).reshape(len(mels), -1)


@dataclass
class ModelRegistry:
    """The published model: a load that fails keeps the one before, each success counts the generation up."""

    model: Model | None = None
    generation: int = 0
    errors: list[str] = field(default_factory=list)

    def publish(self, model: Model, warm_up: bool = True) -> str:
        try:
            if warm_up and np.asarray(model.predict(np.zeros(MEL, np.float32), np.zeros(FACE, np.float32))).size != PREDICTION:
                raise ValueError("prediction of another size")
        except Exception as e:
            self.errors.append(str(e))
            return "kWarmupFailed"
        self.model, self.generation = model, self.generation + 1
        return "kOk"

    def snapshot(self) -> tuple[Model | None, int]:
        return self.model, self.generation


def guard(mel, face) -> str:
    """The first guard that an input fails."""
    for name, value, size in (("Mel", mel, MEL), ("Face", face, FACE)):
        if value is None or len(value) == 0:
            return f"kEmpty{name}Input"
        if len(value) != size:
            return f"kInvalid{name}Shape"
        if not np.isfinite(value).all():
            return f"kNonFinite{name}Input"
    return "kOk"


def attempt(model: Model, mel: np.ndarray, face: np.ndarray) -> tuple[str, np.ndarray | None]:
    try:
        out = np.asarray(model.predict(mel, face), np.float32)
    except ExtractFailed:
        return "kExtractFailed", None
    return ("kOutputEmpty", None) if out.size == 0 else ("kOk", out)


def output_guard(out: np.ndarray) -> str:
    if out.size != PREDICTION:
        return "kOutputShapeMismatch"
    if not np.isfinite(out).all():
        return "kOutputNonFinite"
    return "kOk" if out.min() >= -1e-6 and out.max() <= 1 + 1e-6 else "kOutputRangeViolation"


def infer_one(model: Model | None, mel, face, max_retries: int = 1) -> tuple:
    """(status, prediction, attempts, recovered, first failure)."""
    if model is None:
        return "kModelNotLoaded", None, 0, False, None
    status = guard(mel, face)
    if status != "kOk":
        return status, None, 0, False, None
    mel, face, first, tries = np.asarray(mel, np.float32), np.asarray(face, np.float32), None, 0
    while True:
        tries += 1
        status, out = attempt(model, mel, face)
        if status == "kOk":
            break
        first = first or status
        if status not in RETRYABLE or tries > max_retries:
            if status in RETRYABLE and tries > 1:
                status = "kRetryExhausted"
            return status, None, tries, False, first
    status = output_guard(out)
    if status != "kOk":
        return status, None, tries, False, first or status
    return "kOk", out, tries, tries > 1, first


def infer_slice(model: Model | None, mels: list, faces: list, max_retries: int = 1) -> list[tuple]:
    """``infer_one`` of each row; the good ones go through the model together where it takes batches."""
    whole = getattr(model, "predict_batch", None)
    checked = [guard(m, f) for m, f in zip(mels, faces, strict=True)] if whole else []
    good = [k for k, status in enumerate(checked) if status == "kOk"]
    made: dict[int, np.ndarray] = {}
    if good:
        try:
            held = faces[good[0]]
            one = all(faces[k] is held for k in good)
            stack = np.broadcast_to(np.asarray(held, np.float32), (len(good), FACE)) if one else np.stack([np.asarray(faces[k], np.float32) for k in good])
            out = np.asarray(whole(np.stack([np.asarray(mels[k], np.float32) for k in good]), stack), np.float32)
            made = dict(zip(good, out, strict=True)) if out.ndim == 2 and out.shape[1] else {}
        except (ExtractFailed, ValueError):
            made = {}
    rows = []
    for k, (m, f) in enumerate(zip(mels, faces, strict=True)):
        if k in made:
            status = output_guard(made[k])
            rows.append(("kOk", made[k], 1, False, None) if status == "kOk" else (status, None, 1, False, status))
        elif checked and checked[k] != "kOk":
            rows.append((checked[k], None, 0, False, None))
        else:
            rows.append(infer_one(model, m, f, max_retries))
    return rows


def infer(inputs: DataFrame, registry: ModelRegistry, max_retries: int = 1, face: np.ndarray | None = None, images: bool = False, least_sharpness: float | None = None, deadline: float | None = None) -> DataFrame:
    """Inputs with ``mel`` and ``face`` replaced by the result's columns.

    ``face``: one prepared face for all rows of a job, sent once instead of with each row.
    ``images``: predictions leave the worker as converted images of a quarter of the size.
    ``deadline``: seconds since 1970 that all rows share; what isn't begun by then is kQueueWaitTimeout.
    Results leave in slices of ``SLICE`` rows, whatever the input's batch, and each row keeps the columns that number it.
    """
    model, generation = registry.snapshot()
    sent = inputs.sparkSession.sparkContext.broadcast((model, face))  # of the model's size, whatever the data's
    rest = [c for c in inputs.columns if c not in ("mel", "face")]

    def told(status, pred, *rest) -> tuple:
        if not images:
            return (status, pred, *rest)
        return (*(convert_one(pred, least_sharpness) if status == "kOk" else (status, None, None, None, None)), *rest)

    names = ["status", *(["image", "corrected", "sharpness", "sharp"] if images else ["pred"]), "attempts", "recovered", "first_failure"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, shared = sent.value
        for frame in frames:
            for at in range(0, len(frame), SLICE):
                part = frame.iloc[at : at + SLICE].reset_index(drop=True)
                faces = part["face"] if shared is None else [shared] * len(part)
                late = deadline is not None and time.time() > deadline
                rows = [("kQueueWaitTimeout", None, 0, False, None)] * len(part) if late else infer_slice(model, list(part["mel"]), list(faces), max_retries)
                out = pd.DataFrame([told(*r) for r in rows], columns=names)
                yield pd.concat([part[rest], out.astype({"corrected": "Int32"}) if images else out], axis=1).assign(model_generation=generation)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema if f.name in rest)
    result = "status string, image binary, corrected int, sharpness double, sharp boolean, attempts int, recovered boolean, first_failure string, model_generation long" if images else RESULT
    return inputs.mapInPandas(run, f"{kept}, {result}")


def by_index(inputs: DataFrame, results: DataFrame, index: str = "index") -> DataFrame:
    """A batch's results in its inputs' places: one row for each input, kTaskException where it has none."""
    told = results.select(index, *[c for c in results.columns if c != index and c not in inputs.columns])
    return inputs.join(told, index, "left").withColumn("status", F.coalesce("status", F.lit("kTaskException")))


def admission(model_loaded: bool, workers: int, queue: int, timeout_ms: int, threads: int, cores: int, oversubscribe: bool = False) -> str:
    """Whether an engine may start so: the first check that fails. Threads are those that a model's kernels use in one worker."""
    if not model_loaded:
        return "kModelNotLoaded"
    if workers <= 0:
        return "kInvalidWorkerCount"
    if queue <= 0:
        return "kInvalidQueueCapacity"
    if timeout_ms < 0:
        return "kInvalidTimeout"
    return "kOk" if oversubscribe or workers * max(threads, 1) <= max(cores, 1) else "kOversubscribed"


def retry_outcome(first: Column, second: Column, max_retries: int = 1) -> Column:
    """(status, attempts, recovered, first_failure) of at most two attempts' statuses, as an expression."""
    again = first.isin(*RETRYABLE) & F.lit(max_retries > 0)
    status = F.when(~again, first).when(second.isin(*RETRYABLE), "kRetryExhausted").otherwise(second)
    return F.struct(
        status.alias("status"), F.when(again, 2).otherwise(1).alias("attempts"), (again & (second == "kOk")).alias("recovered"), F.when(first != "kOk", first).alias("first_failure")
    )


def batch_summary(results: DataFrame, *keys: str) -> DataFrame:
    """One row for each batch. Results: keys, status, attempts, recovered, start_ms, end_ms."""
    is_ = lambda *names: F.col("status").isin(*names)
    count = lambda c: F.sum(c.cast("long"))
    span = F.max("end_ms") - F.min("start_ms")
    out = results.groupBy(*keys).agg(
        F.count("*").alias("total"), count(~is_("kQueueWaitTimeout", "kEngineStopping", "kEngineNotRunning")).alias("accepted"), count(is_("kOk")).alias("success"), count(~is_("kOk")).alias("failure"),
        count(is_("kQueueWaitTimeout")).alias("timeout"), count(is_("kEngineStopping")).alias("rejected"), count(is_("kTaskException")).alias("exception"), count(F.col("recovered")).alias("recovered"),
        span.alias("makespan_ms"), F.when(span > 0, F.count("*") * 1000.0 / span).otherwise(0.0).alias("throughput"),
    )
    return out.withColumn("status", batch_status(F.col("total"), F.col("success")))


def batch_status(total: Column, success: Column) -> Column:
    return F.when(total == 0, "kEmptyBatchInput").when(success == total, "kOk").when(success == 0, "kAllFailed").otherwise("kPartialFailure")


def convert_one(pred, least_sharpness: float | None = None) -> tuple:
    """(status, BGR levels, corrected, sharpness, passed) of a prediction; low sharpness is told, and never fails."""
    if least_sharpness is not None and not (np.isfinite(least_sharpness) and least_sharpness >= 0):
        return "kInvalidSharpnessThreshold", None, None, None, None
    if pred is None or len(pred) == 0:
        return "kEmptyPrediction", None, None, None, None
    if len(pred) != PREDICTION:
        return "kInvalidPredictionShape", None, None, None, None
    planes = np.asarray(pred, np.float64).reshape(3, SIDE, SIDE)
    if not np.isfinite(planes).all():
        return "kNonFinitePrediction", None, None, None, None
    if planes.min() < -1e-6 or planes.max() > 1 + 1e-6:
        return "kRangeViolation", None, None, None, None
    bounded = np.clip(planes, 0, 1)
    image = np.floor(bounded * 255 + 0.5).astype(np.uint8).transpose(1, 2, 0)
    score = sharpness(image)
    return "kOk", image.tobytes(), int((bounded != planes).sum()), score, least_sharpness is None or score >= least_sharpness


def convert(results: DataFrame, least_sharpness: float | None = None) -> DataFrame:
    """Results of ``infer`` with ``pred`` turned into an image and its measures; a row that failed before keeps its status."""
    rest = [c for c in results.columns if c not in ("pred", "status")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [convert_one(p, least_sharpness) if s == "kOk" else (s, None, None, None, None) for s, p in zip(frame["status"], frame["pred"], strict=True)]
            out = pd.DataFrame(rows, columns=["status", "image", "corrected", "sharpness", "sharp"]).astype({"corrected": "Int32"})
            yield pd.concat([frame[rest].reset_index(drop=True), out], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in results.schema if f.name in rest)
    return results.mapInPandas(run, f"{kept}, status string, image binary, corrected int, sharpness double, sharp boolean")


def content_key(values: Column) -> Column:
    """A key under which equal inputs can be inferred once."""
    return F.sha2(F.to_json(values), 256)


def digest(pred: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(pred, np.float32).tobytes()).hexdigest()
