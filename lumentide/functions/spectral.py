"""Spectra and mel features: a bounded filter table, JVM arithmetic, one Arrow kernel for the transform."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MelOptions:
    rate: int = 16000
    n_fft: int = 800
    n_mels: int = 80
    fmin: float = 55.0
    fmax: float = 7600.0
    min_db: float = -100.0
    ref_db: float = 20.0
    amin: float = 1e-5
    max_abs: float = 4.0
    slaney: bool = True
    area_norm: bool = True

    def __post_init__(self):
        if not (self.rate > 0 and self.n_fft > 0 and self.n_mels > 0 and 0 <= self.fmin < self.fmax <= self.rate / 2 and self.max_abs > 0):
            raise ValueError("mel options out of range")


SPEECH = MelOptions(n_fft=400, n_mels=40, fmin=80.0, fmax=8000.0, slaney=False, area_norm=False)

_LINEAR, _KNEE, _STEP = 200 / 3, 1000.0, math.log(6.4) / 27


def hz_to_mel_htk(hz: Column) -> Column:
    return 2595.0 * F.log10(1.0 + hz / 700.0)


def mel_to_hz_htk(mel: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), mel / 2595.0) - 1.0)


def hz_to_mel_slaney(hz: Column) -> Column:
    return F.when(hz < _KNEE, hz / _LINEAR).otherwise(15.0 + F.ln(hz / _KNEE) / _STEP)


def mel_to_hz_slaney(mel: Column) -> Column:
    return F.when(mel < 15.0, mel * _LINEAR).otherwise(_KNEE * F.exp((mel - 15.0) * _STEP))


def mel_points(o: MelOptions) -> list[float]:
    """The n_mels + 2 band edges in Hz."""
    if o.slaney:
        to = lambda f: f / _LINEAR if f < _KNEE else 15 + math.log(f / _KNEE) / _STEP
        back = lambda m: m * _LINEAR if m < 15 else _KNEE * math.exp((m - 15) * _STEP)
    else:
        to, back = lambda f: 2595 * math.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    lo, hi = to(o.fmin), to(o.fmax)
    return [back(lo + k * (hi - lo) / (o.n_mels + 1)) for k in range(o.n_mels + 2)]


def filter_bank(o: MelOptions) -> np.ndarray:
    edges, bins = np.array(mel_points(o)), np.arange(o.n_fft // 2 + 1) * (o.rate / o.n_fft)
    left, center, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((bins - left) / (center - left), (right - bins) / (right - center)))
    return bank * (2 / (right - left)) if o.area_norm else bank


def filter_table(spark: SparkSession, o: MelOptions) -> DataFrame:
    """(mel, bin, weight) of non-zero weights; its size depends on the options alone."""
    bank = filter_bank(o)
    rows = [(int(m), int(b), float(bank[m, b])) for m, b in zip(*np.nonzero(bank), strict=True)]
    return spark.createDataFrame(rows, "mel int, bin int, weight double")


def spectrum(frames: DataFrame, n_fft: int) -> DataFrame:
    """(clip, frame, magnitude) of packed frames (clip, frame, samples): bins 0 to n_fft / 2; longer frames are cut, shorter ones padded."""
    return _transformed(frames, n_fft, "magnitude", None)


def mel_spectrum(frames: DataFrame, o: MelOptions) -> DataFrame:
    """(clip, frame, energy): the filters' energies of packed frames, an array for each; the bank is of bounded size and is multiplied where the spectra are made."""
    return _transformed(frames, o.n_fft, "energy", filter_bank(o).T)


def _transformed(frames: DataFrame, n_fft: int, name: str, bank: np.ndarray | None) -> DataFrame:
    kind = frames.schema["clip"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            table = np.zeros((len(batch), n_fft))
            rows = np.repeat(np.arange(len(batch)), sizes)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = at < n_fft
            table[rows[keep], at[keep]] = flat[keep]
            out = np.abs(np.fft.rfft(table, axis=1))
            out = out if bank is None else out @ bank
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * out.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))], ["clip", "frame", name])

    return frames.select("clip", F.col("frame").cast("long").alias("frame"), F.transform("samples", lambda v: v.cast("double")).alias("samples")).mapInArrow(run, f"clip {kind}, frame long, {name} array<double>")


def mel_energies(spectra: DataFrame, o: MelOptions) -> DataFrame:
    """(clip, frame, mel, energy): each bin meets the few filters that hold it. The filter table is of bounded size and is broadcast."""
    bins = spectra.select("clip", "frame", F.posexplode("magnitude").alias("bin", "magnitude"))
    weighted = bins.join(F.broadcast(filter_table(spectra.sparkSession, o)), "bin")
    return weighted.groupBy("clip", "frame", "mel").agg(F.sum(F.col("weight") * F.col("magnitude")).alias("energy"))


def symmetric_db(value: Column, o: MelOptions = MelOptions()) -> Column:
    """Decibels over the reference, mapped to [-max_abs, max_abs]."""
    db = F.greatest(20.0 * F.log10(F.greatest(value, F.lit(o.amin))) - o.ref_db, F.lit(o.min_db))
    unit = (db - o.min_db) / -o.min_db
    return F.greatest(F.lit(-o.max_abs), F.least(F.lit(o.max_abs), 2 * o.max_abs * unit - o.max_abs))


def mel_features(frames: DataFrame, o: MelOptions = MelOptions()) -> DataFrame:
    """(clip, frame, mel array) from packed frames, without a shuffle."""
    return mel_spectrum(frames, o).select("clip", "frame", F.transform("energy", lambda e: symmetric_db(e, o)).alias("mel"))
