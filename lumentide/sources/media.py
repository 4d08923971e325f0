"""Media files as tables: WAV audio, PPM/PGM and BMP images, from ``binaryFile`` or a binary column.

Files that can't be read stay as rows with a status, so a batch keeps its alignment. Other
containers and codecs need a decoder, given as a function; none ships here.
"""

from __future__ import annotations

import io
import struct
import wave
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO_EXTENSIONS = ("wav", "mp3", "aac", "m4a", "mp4", "flac")
IMAGE_EXTENSIONS = ("bmp", "jpg", "jpeg", "png")
READABLE_IMAGES = ("bmp", "png", "ppm", "pgm")
#: bytes of decoded media that a batch of rows holds
BATCH_BYTES = 1 << 26
#: bytes at a file's start in which its header is looked for
HEADER_BYTES = 1 << 16

AUDIO = "path string, status string, rate int, channels int, source_samples long, duration_ms double, pcm array<float>"
IMAGE = "path string, status string, width int, height int, channels int, data binary"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def has_extension(path: Column, allowed: Sequence[str] = AUDIO_EXTENSIONS) -> Column:
    return extension(path).isin(*allowed)


def path_status(path: Column, exists: Column, is_directory: Column, rate: Column, channels: Column, check_format: bool = True) -> Column:
    """The first check that a request fails."""
    status = F.when(F.coalesce(path, F.lit("")) == "", "kEmptyPath").when(rate <= 0, "kInvalidTargetSampleRate").when(channels != 1, "kInvalidTargetChannels")
    status = status.when(~exists, "kFileNotFound").when(is_directory, "kPathIsDirectory")
    return (status.when(~has_extension(path), "kUnsupportedFormat") if check_format else status).otherwise("kOk")


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation; equal rates leave samples alone."""
    if source == target or not len(x):
        return x
    n = max(1, int(round(len(x) * target / source)))
    return np.interp(np.arange(n) * source / target, np.arange(len(x)), x)


def decode_wav(content: bytes, rate: int, max_samples: int = 0) -> tuple:
    """(status, rate, channels, source samples, ms, pcm) of 16-bit PCM; channels are averaged."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            channels, source, n = w.getnchannels(), w.getframerate(), w.getnframes()
            if w.getsampwidth() != 2:
                return "kDecoderNotFound", source, channels, n, None, None
            data = np.frombuffer(w.readframes(n), "<i2").reshape(-1, channels)
    except (wave.Error, EOFError, struct.error, ValueError):
        return "kOpenInputFailed", None, None, None, None, None
    if not len(data):
        return "kNoSamplesDecoded", source, channels, n, 0.0, None
    mono = np.clip(np.rint(resample(data.astype(np.float64).mean(1), source, rate)), -32768, 32767)
    mono = mono[:max_samples] if max_samples > 0 else mono
    return "kOk", source, channels, n, n * 1000.0 / source, (mono / 32768.0).astype(np.float32)


def encode_wav(pcm: Sequence[float], rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(np.asarray(pcm, float) * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def probe_wav(head: bytes) -> tuple:
    """(status, rate, channels, frames, ms) from the chunks at a file's start; samples aren't looked at."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return "kOpenInputFailed", None, None, None, None
    at, form = 12, None
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(head):
            form = struct.unpack_from("<HHIIHH", head, at + 8)
        if name == b"data" and form:
            _, channels, rate, _, align, _ = form
            if not (channels and rate and align):
                break
            return "kOk", rate, channels, size // align, size // align * 1000.0 / rate
        at += 8 + size + size % 2
    return ("kNoAudioStream" if form else "kOpenInputFailed"), None, None, None, None


def probe_audio(binaries: DataFrame) -> DataFrame:
    """(path, status, rate, channels, source_samples, duration_ms): only the first bytes of each file reach the worker."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *probe_wav(bytes(h or b""))) for p, h in zip(frame["path"], frame["head"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "status", "rate", "channels", "source_samples", "duration_ms"]).astype({"rate": "Int32", "channels": "Int32", "source_samples": "Int64"})

    heads = binaries.select("path", F.substring("content", 1, HEADER_BYTES).alias("head"))
    return heads.mapInPandas(run, "path string, status string, rate int, channels int, source_samples long, duration_ms double")


def _batches(rows: Iterator[tuple], names: list[str], kinds: dict[str, str], weight: Callable[[tuple], int]) -> Iterator[pd.DataFrame]:
    """Rows in batches of about ``BATCH_BYTES``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH_BYTES:
            yield pd.DataFrame(held, columns=names).astype(kinds)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names).astype(kinds)


def load_audio(binaries: DataFrame, rate: int = 16000, max_samples: int = 0, pcm: bool = True, decoder: Callable[[bytes, int, int], tuple] = decode_wav) -> DataFrame:
    """One row for each (path, content)."""
    names, kinds = ["path", "status", "rate", "channels", "source_samples", "duration_ms", "pcm"], {"rate": "Int32", "channels": "Int32", "source_samples": "Int64"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = ((p, *decoder(bytes(c or b""), rate, max_samples)) for p, c in zip(frame["path"], frame["content"], strict=True))
            for out in _batches(rows, names, kinds, lambda r: 64 + (0 if r[-1] is None else 4 * len(r[-1]))):
                yield out if pcm else out.assign(pcm=None)

    return binaries.select("path", "content").mapInPandas(run, AUDIO)


#: samples of one row of ``load_blocks``
BLOCK_SAMPLES = 1 << 16


def load_blocks(binaries: DataFrame, rate: int = 16000, max_samples: int = 0, decoder: Callable[[bytes, int, int], tuple] = decode_wav) -> DataFrame:
    """(clip, start, pcm): the clips that can be read, in rows of ``BLOCK_SAMPLES`` at most, so no row holds a whole signal."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, c in zip(frame["path"], frame["content"], strict=True):
                status, *_, pcm = decoder(bytes(c or b""), rate, max_samples)
                for at in range(0, len(pcm), BLOCK_SAMPLES) if status == "kOk" else ():
                    yield pd.DataFrame({"clip": [p], "start": [at], "pcm": [pcm[at : at + BLOCK_SAMPLES]]})

    return binaries.select("path", "content").mapInPandas(run, "clip string, start long, pcm array<float>")


def long_pcm(clips: DataFrame) -> DataFrame:
    """(clip, i, x) of the clips that were read, from ``load_audio`` or ``load_blocks``."""
    if "start" in clips.columns:
        at = clips.select("clip", "start", F.posexplode("pcm").alias("k", "x"))
        return at.select("clip", (F.col("start") + F.col("k")).alias("i"), F.col("x").cast("double").alias("x"))
    return clips.where("status = 'kOk'").select(F.col("path").alias("clip"), F.posexplode("pcm").alias("i", "x")).select("clip", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


def decode_png(content: bytes) -> tuple:
    """(status, width, height, channels, BGR rows) of a PNG of 8-bit grey, grey with alpha, RGB or RGBA, not interlaced."""
    at, packed, width = 8, [], 0
    while at + 8 <= len(content):
        size, name = struct.unpack_from(">I4s", content, at)
        if name == b"IHDR":
            width, height, bits, kind, _, _, interlaced = struct.unpack_from(">IIBBBBB", content, at + 8)
        elif name == b"IDAT":
            packed.append(content[at + 8 : at + 8 + size])
        at += 12 + size
    if bits != 8 or interlaced or kind not in (0, 2, 4, 6):
        return "kUnsupportedFormat", None, None, None, None
    n = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    out, above = np.zeros((height, width, n), np.uint8), np.zeros((width, n), np.int64)
    for y, line in enumerate(lines):
        how, own = int(line[0]), line[1:].reshape(width, n).astype(np.int64)
        if how == 1:
            above = np.cumsum(own, axis=0) & 255
        elif how in (0, 2):
            above = (own + above * (how == 2)) & 255
        elif how in (3, 4):
            left = corner = np.zeros(n, np.int64)
            for x in range(width):
                up = above[x].copy()
                if how == 3:
                    guess = (left + up) // 2
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (own[x] + guess) & 255, up
                above[x] = left
        else:
            return "kDecodeFailed", None, None, None, None
        out[y] = above
    if n == 2:
        out, n = out[..., :1], 1
    if n >= 3:
        out = np.concatenate((out[..., 2::-1], out[..., 3:]), axis=2)
    return "kOk", width, height, n, np.ascontiguousarray(out).tobytes()


def decode_image(content: bytes) -> tuple:
    """(status, width, height, channels, BGR rows) of a PPM, PGM, 24/32-bit BMP or 8-bit PNG."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return decode_png(content)
        if content[:2] == b"BM":
            at, width, height, bits = struct.unpack_from("<I", content, 10)[0], *struct.unpack_from("<ii", content, 18), struct.unpack_from("<H", content, 28)[0]
            channels = {24: 3, 32: 4}[bits]
            stride = (width * channels + 3) // 4 * 4
            rows = np.frombuffer(content, np.uint8, stride * abs(height), at).reshape(abs(height), stride)[:, : width * channels].reshape(abs(height), width, channels)
            return "kOk", width, abs(height), channels, (rows[::-1] if height > 0 else rows).tobytes()
        if content[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                end = at + 1
                while content[end : end + 1].isspace():
                    end += 1
                if content[end : end + 1] == b"#":
                    at = content.index(b"\n", end)
                    continue
                if end >= len(content):
                    return "kDecodeFailed", None, None, None, None
                at = end
                while at < len(content) and not content[at : at + 1].isspace():
                    at += 1
                fields.append(int(content[end:at]))
            width, height, _ = fields
            channels = 3 if content[:2] == b"P6" else 1
            data = np.frombuffer(content, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)
            return "kOk", width, height, channels, np.ascontiguousarray(data[..., ::-1]).tobytes()
    except (KeyError, ValueError, IndexError, UnboundLocalError, struct.error, zlib.error):
        return "kDecodeFailed", None, None, None, None
    return ("kEmptyImageData" if not content else "kUnsupportedFormat"), None, None, None, None


def encode_ppm(bgr: np.ndarray) -> bytes:
    h, w = bgr.shape[:2]
    return f"P6 {w} {h} 255\n".encode() + np.ascontiguousarray(bgr[..., ::-1].astype(np.uint8)).tobytes()


def as_mode(image: np.ndarray, mode: str) -> np.ndarray:
    """``color``: three channels; ``grayscale``: one, by the usual weights; ``unchanged``."""
    n = image.shape[2]
    if mode == "color":
        return np.repeat(image, 3, axis=2) if n == 1 else image[..., :3]
    if mode == "grayscale" and n > 1:
        b, g, r = (image[..., k].astype(np.int64) for k in range(3))
        return ((114 * b + 587 * g + 299 * r + 500) // 1000).astype(np.uint8)[..., None]
    return image


def load_images(binaries: DataFrame, decoder: Callable[[bytes], tuple] = decode_image, mode: str = "unchanged") -> DataFrame:
    """One row for each (path, content): packed BGR rows, or a status. ``mode``: as of ``as_mode``."""
    if mode not in ("color", "grayscale", "unchanged"):
        raise ValueError(mode)
    names, kinds = ["path", "status", "width", "height", "channels", "data"], {"width": "Int32", "height": "Int32", "channels": "Int32"}

    def decoded(content: bytes) -> tuple:
        status, width, height, channels, data = decoder(content)
        if status == "kOk" and mode != "unchanged":
            image = as_mode(np.frombuffer(data, np.uint8).reshape(height, width, channels), mode)
            channels, data = image.shape[2], np.ascontiguousarray(image).tobytes()
        return status, width, height, channels, data

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = ((p, *decoded(bytes(c or b""))) for p, c in zip(frame["path"], frame["content"], strict=True))
            yield from _batches(rows, names, kinds, lambda r: 64 + len(r[-1] or b""))

    return binaries.select("path", "content").mapInPandas(run, IMAGE)


def image_path_status(path: Column, exists: Column, is_file: Column) -> Column:
    """The first check that an image's path fails."""
    status = F.when(F.coalesce(path, F.lit("")) == "", "kEmptyPath").when(~exists, "kFileNotFound").when(~is_file, "kNotRegularFile")
    return status.when(~has_extension(path, IMAGE_EXTENSIONS), "kUnsupportedFormat").otherwise("kOk")


def image_info(images: DataFrame, *keys: str) -> DataFrame:
    """Nine facts of each image (path, width, height, channels, and the keys, which stay): 8-bit levels, whose type counts 8 for each channel over one; zeros where there is none."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    there = (n("width") > 0) & (n("height") > 0)
    fact = lambda c: F.when(there, c).otherwise(0).cast("int")
    return images.select(
        *keys, F.when(there, F.col("path")).otherwise("").alias("path"), F.when(there, extension(F.col("path"))).otherwise("").alias("format"), fact(n("width")).alias("width"), fact(n("height")).alias("height"),
        fact(n("channels")).alias("channels"), fact((n("channels") - 1) * 8).alias("type"), F.lit(0).alias("depth"), fact(n("channels")).alias("elem_size"), there.alias("continuous"),
    )


def job_json(results: DataFrame) -> DataFrame:
    """(job_id, json): one machine-readable result for each job."""
    fields = [c for c in results.columns if c != "job_id"]
    return results.select("job_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), *fields), {"ignoreNullFields": "false"}).alias("json"))
