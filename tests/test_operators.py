from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentide.operators import inference, raster
from lumentide.operators.fold import fold, fold_stream
from lumentide.operators.scheduling import FrameScheduler, MelChunker, RingBuffer, StreamEmphasis, StreamFramer, TaskQueue
from lumentide.sources import media


def push(s, pts, index=0):
    return s.step({"op": "push", "pts": pts, "frame_index": index})[0][0]


def tick(s, ref):
    return s.step({"op": "schedule", "ref": ref})[0]


def test_scheduler_tolerance_and_states():
    s = FrameScheduler(6, 2, 10000)
    assert tick(s, 0)[0] == "kBufferingNoFrame"
    assert push(s, 0) == "kAccepted" and tick(s, 0)[0] == "kBufferingNoFrame"
    assert push(s, 40000) == "kAccepted"
    assert tick(s, 10000)[:4] == ("kDeliver", 0, 0, -10000)
    assert tick(s, 29999)[0] == "kRepeatLast" and tick(s, 30000)[:4] == ("kDeliver", 40000, 0, 10000)
    assert tick(s, 20000)[0] == "kRejectedInvalidReferenceTime"
    assert tick(s, 30000)[0] == "kRepeatLast" and not s.running
    for p in (80000, 120000, 160000):
        push(s, p)
    assert tick(s, 165000)[:5] == ("kDropAndDeliver", 160000, 0, -5000, 2)
    assert tick(s, None)[0] == "kClockUnavailable"
    assert push(s, 160000) == "kRejectedStalePts" and push(s, -1) == "kRejectedInvalidFrame"


def test_scheduler_overflow():
    s = FrameScheduler(2, 1, 0)
    push(s, 10)
    push(s, 20)
    assert push(s, 20) == "kRejectedDuplicatePts" and push(s, 30) == "kDroppedOldest" and [q[0] for q in s.queue] == [20, 30]
    s = FrameScheduler(1, 1, 0, drop_oldest=False)
    push(s, 10)
    assert push(s, 20) == "kRejectedQueueFull"
    with pytest.raises(ValueError):
        FrameScheduler(0, 1, 0)


def test_ring_buffer():
    b = RingBuffer(8)
    put = lambda n, **k: b.step({"op": "push", "values": [float(v) for v in n], **k})[0]
    put(range(1, 6))
    status = put(range(6, 13), strategy="OverwriteOldest")
    assert status[0] == "kOk" and status[5] == 4 and b.data == [5, 6, 7, 8, 9, 10, 11, 12]
    assert put([1] * 4, strategy="DropNewest")[0] == "kInsufficientSpace" and b.lost == 4
    assert put([1], timeout=-1)[0] == "kWouldBlock" and put([1], timeout=5)[0] == "kTimeout" and put([1])[0] == "kBlocked"
    assert put([1] * 9, strategy="OverwriteOldest")[0] == "kInvalidChunk"
    assert put([])[0] == "kEmptyInput" and put([float("nan")])[0] == "kInvalidPcmData"
    b.step({"op": "close"})
    assert put([1])[0] == "kClosed"
    assert b.step({"op": "pull", "n": 5})[0][:3] == ("kOk", [5, 6, 7, 8, 9], 0)
    assert b.step({"op": "pull", "n": 5})[0][0] == "kClosed" and b.step({"op": "pull", "n": 3})[0][2] == 5


def test_framer_counts_as_the_closed_form(spark):
    from lumentide.functions.framing import streamed_frame_count

    for length in (0, 3, 8, 12, 16, 17):
        f, n = StreamFramer(8, 4), 0
        for k in range(length):
            n += len(f.step({"op": "push", "values": [float(k)]}))
        n += len(f.step({"op": "flush"}))
        assert n == spark.range(1).select(streamed_frame_count(F.lit(length).cast("long"), 8, 4)).first()[0]


def test_queue_and_chunker():
    q = TaskQueue(2)
    say = lambda op, task=None: q.step({"op": op, "task": task})[0][:2]
    assert [say("push", "a"), say("push", "b"), say("push", "c")] == [("kOk", None), ("kOk", None), ("kBlocked", None)]
    say("close")
    assert [say("push", "d"), say("pop"), say("pop"), say("pop")] == [("kClosed", None), ("kOk", "a"), ("kOk", "b"), ("kEnd", None)]
    m = MelChunker(3, 2)
    out = [m.step({"op": "push", "values": [float(k), 10.0 + k]}) for k in range(5)]
    assert [len(o) for o in out] == [0, 0, 1, 0, 1] and out[4][0][1] == [2, 3, 4, 12, 13, 14]


def log(n=60, streams=3, seed=1):
    rnd = random.Random(seed)
    return [(s, k, rnd.choice(("push", "push", "schedule")), rnd.randrange(0, 3000) if rnd.random() < 0.9 else None, k, k * 50 if rnd.random() < 0.9 else None) for s in range(streams) for k in range(n)]


SCHEMA = "stream long, seq long, op string, pts long, frame_index long, ref long"


def test_fold_in_batch_and_in_a_stream(spark, tmp_path):
    rows = log()
    want = []
    for s in range(3):
        m = FrameScheduler(4, 2, 60)
        for r in [r for r in rows if r[0] == s]:
            want += [(s, r[1], *o) for o in m.step(dict(zip(("stream", "seq", "op", "pts", "frame_index", "ref"), r, strict=True)))]
    make = lambda: FrameScheduler(4, 2, 60)
    random.Random(2).shuffle(rows)
    got = [tuple(r) for r in fold(spark.createDataFrame(rows, SCHEMA), make).collect()]
    assert sorted(got, key=lambda r: r[:2]) == want
    # events cross between micro-batches: the stream waits for those that are missing
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = fold_stream(stream, make).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start(sink)
    q.awaitTermination(120)
    assert sorted((tuple(r) for r in spark.read.parquet(sink).collect()), key=lambda r: r[:2]) == want


def test_emphasis_machine_round_trip():
    m = StreamEmphasis(0.5)
    out = m.step({"values": [1.0, 2.0]})[0][0]
    other = StreamEmphasis(0.5)
    other.load(json.loads(json.dumps(m.dump())))
    assert out + other.step({"values": [4.0, 8.0]})[0][0] == [1.0, 1.5, 3.0, 6.0]


class Flaky:
    def __init__(self, fails):
        self.fails = fails

    def predict(self, mel, face):
        self.fails -= 1
        if self.fails >= 0:
            raise inference.ExtractFailed
        return np.full(inference.PREDICTION, 0.5, np.float32)


def test_retries():
    mel, face = np.zeros(inference.MEL), np.zeros(inference.FACE)
    ask = lambda m, n=1: tuple(v for k, v in enumerate(inference.infer_one(m, mel, face, n)) if k != 1)
    assert ask(Flaky(0)) == ("kOk", 1, False, None)
    assert ask(Flaky(1)) == ("kOk", 2, True, "kExtractFailed")
    assert ask(Flaky(2)) == ("kRetryExhausted", 2, False, "kExtractFailed")
    assert ask(Flaky(1), 0) == ("kExtractFailed", 1, False, "kExtractFailed")
    assert inference.infer_one(None, mel, face)[0] == "kModelNotLoaded"
    assert inference.infer_one(Flaky(0), mel[:3], face)[0] == "kInvalidMelShape"
    assert inference.infer_one(Flaky(0), np.full(inference.MEL, np.nan), face)[0] == "kNonFiniteMelInput"


def test_registry_keeps_what_worked():
    r = inference.ModelRegistry()
    assert r.publish(inference.StandIn()) == "kOk" and r.generation == 1
    assert r.publish(Flaky(99)) == "kWarmupFailed" and r.generation == 1 and isinstance(r.snapshot()[0], inference.StandIn)


def test_raster_kernels():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (12, 16, 3)).astype(np.uint8)
    assert np.allclose(raster.resize(image, 12, 16), image)
    identity = np.array([[1.0, 0, 0], [0, 1, 0]])
    assert np.allclose(raster.warp(image, identity, 12, 16), image) and np.allclose(raster.warp(image, identity, 12, 16, cubic=True), image)
    m = np.array([[0.5, 0.1, 3], [-0.2, 0.7, 1]])
    assert np.allclose(raster.invert(raster.invert(m)), m)
    assert np.allclose(raster.blur(np.full((9, 9), 7.0), 4), 7) and raster.gaussian_kernel(7).sum() == pytest.approx(1)
    dot = np.zeros((9, 9), np.uint8)
    dot[4, 4] = 255
    assert (raster.dilate(dot, 2) > 0).sum() == raster.ellipse(2).sum()
    square = raster.fill_polygon(np.array([[2, 2], [6, 2], [6, 5], [2, 5]]), 9, 9)
    assert (square > 0).sum() == 20
    assert np.array_equal(raster.blend(image, image, np.zeros((12, 16)), detail=0), image)
    other = np.full_like(image, 200)
    assert np.abs(raster.blend(image, other, np.ones((12, 16)), match=False, detail=0).astype(int) - 200).max() <= 2
    one = lambda v: np.full((1, 1, 3), v, np.uint8)
    assert abs(int(raster.blend(one(100), one(200), np.full((1, 1), 0.25), match=False, detail=0)[0, 0, 0]) - 125) <= 2
    mask = raster.mouth_mask(np.array([[30 + 2 * k, 52 + (k * 7) % 20] for k in range(18)], float))
    assert mask.shape == (96, 96) and 0 < mask.max() <= 1 and mask[:2].max() == 0 and mask[:, -2:].max() == 0


def test_preprocess():
    grey = np.full((40, 40), 128, np.uint8)
    out, least, most = raster.preprocess(grey)
    assert out.shape == (96, 96, 3) and least == most == pytest.approx(0.502, abs=1e-3)
    bgr = np.zeros((96, 96, 3), np.uint8) + np.array([50, 100, 200], np.uint8)
    assert raster.preprocess(bgr, rgb=True, mode="none")[0][0, 0].tolist() == [200, 100, 50]
    assert raster.preprocess(np.zeros((4, 4, 4), np.uint8), mode="signed")[1:] == (-1.0, -1.0)


def test_convert():
    ask = lambda p, s=None: inference.convert_one(p, s)
    flat = np.full(inference.PREDICTION, 0.25)
    status, image, corrected, sharp, passed = ask(flat, 1.0)
    assert (status, len(image), corrected, sharp, passed) == ("kOk", inference.PREDICTION, 0, 0.0, False) and image[0] == 64
    edge = flat.copy()
    edge[:2] = (-0.5e-6, 1 + 0.5e-6)
    assert ask(edge)[2] == 2 and ask(edge)[1][0] == 0
    bad = flat.copy()
    bad[0] = 1.1
    assert [ask(p)[0] for p in (None, flat[:5], bad, np.full(inference.PREDICTION, np.nan))] == ["kEmptyPrediction", "kInvalidPredictionShape", "kRangeViolation", "kNonFinitePrediction"]
    assert ask(flat, -1.0)[0] == "kInvalidSharpnessThreshold"


def test_infer_and_convert_frames(spark):
    registry = inference.ModelRegistry()
    registry.publish(inference.StandIn())
    rows = [(i, [0.1] * (inference.MEL if i % 3 else 9)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, mel array<float>")
    face = np.full(inference.FACE, 0.5, np.float32)
    preds = inference.infer(df, registry, face=face)
    images = {r["id"]: r for r in inference.infer(df, registry, face=face, images=True).collect()}
    for r in inference.convert(preds).collect():
        other = images[r["id"]]
        assert (r["status"], r["image"], r["corrected"], r["sharpness"]) == (other["status"], other["image"], other["corrected"], other["sharpness"])
        assert r["status"] == ("kOk" if r["id"] % 3 else "kInvalidMelShape")
    with_face = df.limit(2).withColumn("face", F.array_repeat(F.lit(0.5).cast("float"), inference.FACE))
    assert {r["status"] for r in inference.infer(with_face, registry).collect()} <= {"kOk", "kInvalidMelShape"}


def test_faces():
    from lumentide.operators import faces

    image = np.zeros((120, 160, 3), np.uint8)
    image[20:100, 30:110] = 255
    box, o = faces.BrightBox(), faces.DetectOptions(least_width=160)
    assert faces.detect(image, box, o) == ("kOk", [(30, 20, 80, 80)])
    assert faces.detect(image * 0, box, o) == ("kNoFace", []) and faces.detect(image[:0], box, o)[0] == "kEmptyImage"
    assert faces.detect(image[..., :2], box, o)[0] == "kInvalidImageChannels"
    (x, y, w, h), = faces.detect(image, box)[1]  # found on an enlarged image, mapped back
    assert abs(x - 30) <= 1 and abs(w - 80) <= 2
    status, points, score = faces.landmarks(image, (30, 20, 80, 80), box)
    assert status == "kOk" and len(points) == 68 and score == 1.0
    assert [faces.landmarks(image, r, box)[0] for r in ((0, 0, 500, 9), (0, 0, 20, 20))] == ["kInvalidFaceRect", "kFaceTooSmall"]
    assert faces.landmarks(image, (0, 0, 80, 80), None)[0] == "kModelNotLoaded"


def test_media_files(spark):
    x = [0.5, -0.25, 0.125, 0.0]
    rows = [("a.wav", bytearray(media.encode_wav(x, 16000))), ("b.wav", bytearray(b"RIFF")), ("c.wav", bytearray(media.encode_wav([], 16000))), ("d.wav", bytearray(media.encode_wav(x, 8000)))]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: r for r in media.load_audio(df).collect()}
    assert got["a.wav"]["pcm"] == x and [got[k]["status"] for k in ("b.wav", "c.wav")] == ["kOpenInputFailed", "kNoSamplesDecoded"]
    assert len(got["d.wav"]["pcm"]) == 8 and got["d.wav"]["duration_ms"] == 0.5
    assert len(media.load_audio(df, max_samples=2).where("path = 'a.wav'").first()["pcm"]) == 2
    bgr = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    images = spark.createDataFrame([("a.ppm", bytearray(media.encode_ppm(bgr))), ("b.png", bytearray(b"\x89PNG")), ("c.bmp", bytearray(b"BM"))], "path string, content binary")
    got = {r["path"]: r for r in media.load_images(images).collect()}
    assert bytes(got["a.ppm"]["data"]) == bgr.tobytes() and (got["a.ppm"]["width"], got["a.ppm"]["height"]) == (4, 2)
    assert got["b.png"]["status"] == "kUnsupportedFormat" and got["c.bmp"]["status"] == "kDecodeFailed"


def test_image_source_from_files(spark, tmp_path):
    (tmp_path / "x.ppm").write_bytes(media.encode_ppm(np.zeros((3, 5, 3), np.uint8)))
    (tmp_path / "y.txt").write_text("no")
    got = media.load_images(media.files(spark, str(tmp_path), "*.ppm")).collect()
    assert [(r["status"], r["width"], r["height"]) for r in got] == [("kOk", 5, 3)]


def test_admission_and_metrics(spark):
    from lumentide.plans.metrics import observed, termination

    ask = inference.admission
    assert [ask(False, 1, 1, 0, 1, 8), ask(True, 0, 1, 0, 1, 8), ask(True, 1, 0, 0, 1, 8), ask(True, 1, 1, -1, 1, 8), ask(True, 4, 1, 0, 4, 8), ask(True, 4, 1, 0, 4, 8, True), ask(True, 2, 4, 0, 4, 8)] == [
        "kModelNotLoaded", "kInvalidWorkerCount", "kInvalidQueueCapacity", "kInvalidTimeout", "kOversubscribed", "kOk", "kOk",
    ]
    df = spark.createDataFrame([("kOk", 1, False), ("kOk", 2, True), ("kRetryExhausted", 2, False)], "status string, attempts int, recovered boolean")
    rows, seen = observed(df, "t")
    assert rows.count() == 3 and seen.get == {"frames": 3, "succeeded": 2, "failed": 1, "retried": 2, "recovered": 1}
    assert [termination(3, 2, 1, True), termination(3, 2, 0, True), termination(3, 3, 0, True), termination(0, 0, 0, False)] == ["kFailed", "kCancelled", "kSucceeded", "kSucceeded"]
