from __future__ import annotations

import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentide.functions import tensors
from lumentide.operators import face_path, inference, raster
from lumentide.operators.fold import fold
from lumentide.operators.scheduling import Playback
from lumentide.sources import media, writer

IMAGE = "path string, width int, height int, channels int, data binary, x int, y int, w int, h int, points array<struct<x:double,y:double>>"


def eyes(left=(150, 117), right=(250, 117)):
    points = [(float(k), 2.0 * k) for k in range(68)]
    points[36:42], points[42:48] = [left] * 6, [right] * 6
    return [(float(x), float(y)) for x, y in points]


def face(spark, side=400, fill=128, rect=(100, 60, 200, 220), points=None, channels=3):
    image = np.full((side, side, channels), fill, np.uint8)
    return spark.createDataFrame([("a", side, side, channels, bytearray(image.tobytes()), *rect, points or eyes())], IMAGE)


def test_alignment_puts_the_eyes_level(spark):
    row = face_path.align_faces(face(spark)).first()
    left, right = row["aligned"][36], row["aligned"][42]
    assert row["status"] == "kOk" and left["y"] == pytest.approx(38.4) == right["y"]
    assert (left["x"] + right["x"]) / 2 == pytest.approx(48) and right["x"] - left["x"] == pytest.approx(38.4)
    m, i = (np.array([row[c][f"m{k}"] for k in range(6)]).reshape(2, 3) for c in ("matrix", "inverse"))
    assert np.allclose(m[:, :2] @ i[:, :2], np.eye(2)) and np.allclose(m[:, :2] @ i[:, 2] + m[:, 2], 0)


def test_statuses_keep_their_places(spark):
    rows = face(spark).unionByName(face(spark, rect=(500, 500, 10, 10))).unionByName(face(spark, channels=1)).unionByName(face(spark, points=eyes()[:60])).unionByName(face(spark, points=eyes((9, 9), (9, 9))))
    got = [r["status"] for r in face_path.align_faces(rows.coalesce(1)).collect()]
    assert got == ["kOk", "kInvalidFaceRect", "kInvalidImageType", "kInvalidLandmarkCount", "kDegenerateEyeGeometry"]
    got = [r["status"] for r in face_path.prepare_faces(rows.coalesce(1)).collect()]
    assert got == ["kOk", "kInvalidFaceRect", "kInvalidSourceImageType", "kInvalidFaceLandmarks", "kOk"]
    assert face_path.prepare_faces(rows, face_path.PrepareOptions(pads=(-1, 0, 0, 0))).where("status = 'kInvalidFacePadding'").count() == 4


def test_pixels_of_the_path(spark):
    aligned = face_path.warp_aligned(face_path.align_faces(face(spark))).first()["aligned_data"]
    assert set(aligned) == {128} and len(aligned) == 96 * 96 * 3
    prepared = face_path.resize_prepared(face_path.prepare_faces(face(spark, fill=77))).first()["prepared_data"]
    assert set(prepared) == {77}


def test_model_inputs(spark):
    side = 96
    pixels = (np.arange(side * side * 3) % 256).astype(int)
    df = spark.createDataFrame([(side, side, 3, pixels.tolist(), [0.5] * 1280)], "width int, height int, channels int, pixels array<int>, mel array<double>")
    row = face_path.build_inputs(df).first()
    planes = np.array(row["face_chw"]).reshape(6, side, side)
    bgr = pixels.reshape(side, side, 3) / 255
    assert row["build_status"] == "kOk" and np.allclose(planes[3:], bgr.transpose(2, 0, 1)) and (planes[:3, 48:] == 0).all() and np.allclose(planes[:3, :48], planes[3:, :48])
    mel = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(1279)), lambda p: (p / 16).cast("int") * 1000.0 + p % 16).alias("mel"))
    assert mel.select(tensors.mel_bands(F.col("mel"))[7][3].alias("v")).first()["v"] == 7003


def test_blend_into_the_original(spark):
    base, made, mask = np.full((120, 140, 3), 100, np.uint8), np.full((96, 96, 3), 200, np.uint8), np.zeros((96, 96))
    mask[30:60, 30:60] = 1.0
    shift = {f"m{k}": float(v) for k, v in enumerate((1, 0, 20, 0, 1, 10))}
    schema = "width int, height int, channels int, data binary, gen_width int, gen_height int, gen_channels int, gen_data binary, mask_values array<double>, inverse struct<m0:double,m1:double,m2:double,m3:double,m4:double,m5:double>"
    df = spark.createDataFrame([(140, 120, 3, bytearray(base.tobytes()), 96, 96, 3, bytearray(made.tobytes()), mask.ravel().tolist(), shift)], schema)
    row = face_path.blend_mouths(df).first()
    want = raster.blend_mouth(base, made, mask, np.array([1, 0, 20, 0, 1, 10.0]).reshape(2, 3))
    assert row["status"] == "kOk" and row["blended"] == want.tobytes()


@pytest.mark.parametrize("shape", [(8, 8, 3), (13, 5, 1), (9, 21, 4)])
def test_stacks_as_single_images(shape):
    images = np.random.default_rng(1).integers(0, 256, (5, *shape)).astype(np.uint8)
    for mode, rgb in (("unit", True), ("signed", False), ("none", True)):
        out = raster.preprocess_stack(images, 8, rgb, mode)
        for image, one in zip(images, out, strict=True):
            assert np.array_equal(raster.preprocess(image, 8, rgb, mode)[0], one)


class Flaky:
    """Refuses batches with a mel of 9, and once a single one of 5."""

    def predict(self, mel, face):
        if mel[0] == 9:
            raise inference.ExtractFailed
        return np.full(inference.PREDICTION, 0.25, np.float32)

    def predict_batch(self, mels, faces):
        if (mels[:, 0] == 9).any():
            raise inference.ExtractFailed
        return np.full((len(mels), inference.PREDICTION), 0.25, np.float32)


def test_slices_are_as_single_rows():
    one = np.zeros(inference.FACE, np.float32)
    rows = [np.full(inference.MEL, v, np.float32) for v in (1, 2)] + [None, np.zeros(3), np.full(inference.MEL, np.nan)]
    for bad in ([], [np.full(inference.MEL, 9, np.float32)]):
        mels = rows + bad
        got = inference.infer_slice(Flaky(), mels, [one] * len(mels))
        want = [inference.infer_one(Flaky(), m, one) for m in mels]
        assert [g[:1] + g[2:] for g in got] == [w[:1] + w[2:] for w in want]
    stand, faces = inference.StandIn(), np.random.default_rng(0).random((4, inference.FACE)).astype(np.float32)
    mels = np.random.default_rng(1).normal(size=(4, inference.MEL)).astype(np.float32)
    assert np.allclose(stand.predict_batch(mels, faces), [stand.predict(m, f) for m, f in zip(mels, faces, strict=True)], atol=1e-6)


def test_shared_deadline_and_index(spark):
    registry = inference.ModelRegistry()
    registry.publish(inference.StandIn())
    inputs = spark.createDataFrame([(k, [0.0] * inference.MEL) for k in range(5)], "index long, mel array<double>")
    kept = np.zeros(inference.FACE, np.float32)
    late = inference.infer(inputs, registry, face=kept, deadline=time.time() - 1).collect()
    assert {r["status"] for r in late} == {"kQueueWaitTimeout"}
    some = inference.infer(inputs.where("index <> 3"), registry, face=kept, deadline=time.time() + 600).select("index", "status", "attempts")
    got = {r["index"]: r["status"] for r in inference.by_index(inputs, some).collect()}
    assert got == {0: "kOk", 1: "kOk", 2: "kOk", 3: "kTaskException", 4: "kOk"}


def png(image, filters):
    h, w, n = image.shape
    lines, above = [], np.zeros((w, n), int)
    for y in range(h):
        own, how = image[y].astype(int), filters[y % len(filters)]
        left = np.vstack([np.zeros((1, n), int), own[:-1]])
        corner = np.vstack([np.zeros((1, n), int), above[:-1]])
        guess = left + above - corner
        a, b, c = abs(guess - left), abs(guess - above), abs(guess - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        lines.append(bytes([how]) + ((own - [0, left, above, (left + above) // 2, paeth][how]) % 256).astype(np.uint8).tobytes())
        above = own
    chunk = lambda name, data: len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0])
    packed = zlib.compress(b"".join(lines))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", packed[:10]) + chunk(b"IDAT", packed[10:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png(channels):
    image = np.random.default_rng(channels).integers(0, 256, (11, 7, channels)).astype(np.uint8)
    status, w, h, n, data = media.decode_image(png(image, [0, 1, 2, 3, 4]))
    got = np.frombuffer(data, np.uint8).reshape(h, w, n)
    want = image[..., :1] if channels < 3 else np.concatenate((image[..., 2::-1], image[..., 3:]), axis=2)
    assert status == "kOk" and np.array_equal(got, want)
    assert media.decode_image(png(image, [0])[:60])[0] in ("kDecodeFailed", "kUnsupportedFormat")


def test_modes_and_info(spark):
    image = np.random.default_rng(5).integers(0, 256, (4, 6, 3)).astype(np.uint8)
    files = spark.createDataFrame([("a/x.ppm", bytearray(media.encode_ppm(image))), ("b.ppm", bytearray(b"P6"))], "path string, content binary")
    grey = media.load_images(files, mode="grayscale").where("status = 'kOk'").first()
    assert grey["channels"] == 1 and len(grey["data"]) == 24
    assert media.load_images(files, mode="color").where("status = 'kOk'").first()["data"] == image.tobytes()
    info = {r["path"]: r for r in media.image_info(media.load_images(files)).collect()}
    assert (info["a/x.ppm"]["width"], info["a/x.ppm"]["type"], info["a/x.ppm"]["elem_size"], info["a/x.ppm"]["format"]) == (6, 16, 3, "ppm") and not info[""]["continuous"]


def test_probe_reads_headers_alone(spark):
    whole = media.encode_wav([0.1] * 40_000, 16000)
    files = spark.createDataFrame([("a", bytearray(whole)), ("b", bytearray(whole[:64])), ("c", bytearray(b"RIFFxxxxWAVE")), ("d", bytearray(b"")), ("e", None)], "path string, content binary")
    got = {r["path"]: tuple(r)[1:] for r in media.probe_audio(files).collect()}
    assert got["a"] == got["b"] == ("kOk", 16000, 1, 40_000, 2500.0) and {got[k][0] for k in "cde"} == {"kOpenInputFailed"}
    blocks = media.load_blocks(files)
    assert sorted((r["clip"], r["start"], len(r["pcm"])) for r in blocks.where("clip = 'a'").collect()) == [("a", 0, 40_000)]
    assert media.long_pcm(blocks.where("clip = 'a'")).orderBy("i").limit(3).collect() == media.long_pcm(media.load_audio(files).where("path = 'a'")).orderBy("i").limit(3).collect()


def test_frames_are_written_by_job(spark, tmp_path):
    frames = spark.createDataFrame([(j, n, 64 if (j, n) != (2, 3) else 65, 48, bytearray(b"x")) for j in (1, 2, 3) for n in range(5)], "job_id long, n long, width int, height int, data binary")
    ends = spark.createDataFrame([(1, "kSucceeded"), (2, "kSucceeded"), (3, "kCancelled"), (4, "kSucceeded")], "job_id long, state string")
    told = {r["job_id"]: (r["error"], r["written_frames"], r["committed"]) for r in writer.finalised(frames, ends).collect()}
    assert told == {1: ("kOk", 5, True), 2: ("kInvalidFrameDimensions", 3, False), 3: ("kOk", 5, False), 4: ("kOk", 0, False)}
    path = str(tmp_path / "out")
    writer.write_jobs(frames, ends, path)
    assert {(r["job_id"], r["n"]) for r in spark.read.parquet(path).collect()} == {(1, n) for n in range(5)}
    writer.write_frames(frames.where("job_id = 3"), path, order="n")  # another job's frames stay
    assert {r["job_id"] for r in spark.read.parquet(path).select("job_id").distinct().collect()} == {1, 3}


def test_playback(spark):
    log = [("prepare", 0, 0), ("start", 0, 0), ("callback", 400, 1000), ("tick", 0, 11_000), ("tick", 0, 9_000), ("tick", 0, 900_000), ("callback", 400, 25_000), ("finished", 0, 0), ("callback", 400, 50_000), ("finished", 0, 0), ("stop", 0, 0), ("start", 0, 0), ("reset", 0, 0), ("abort", 0, 0)]
    df = spark.createDataFrame([(1, k, op, n, now, 1000, 16000, 1, True) for k, (op, n, now) in enumerate(log)], "stream long, seq long, op string, n int, now long, total int, rate int, channels int, finite boolean")
    got = [(r["status"], r["state"], r["frame"]) for r in fold(df, Playback).orderBy("seq").collect()]
    assert got == [
        ("kOk", "kPrepared", 0), ("kOk", "kRunning", 0), ("kOk", "kRunning", 0), ("kOk", "kRunning", 160), ("kOk", "kRunning", 160), ("kOk", "kRunning", 400), ("kOk", "kRunning", 400), ("kOk", "kRunning", 400), ("kOk", "kRunning", 800),
        ("kOk", "kCompleted", 1000), ("kOk", "kCompleted", 1000), ("kInvalidState", "kCompleted", 1000), ("kOk", "kIdle", 0), ("kInvalidState", "kIdle", 0),
    ]
