from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentide.functions import framing, geometry, pixels, signal, spectral, sync
from lumentide.functions import timestamps as ts


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def pcm(spark, x, clip=1):
    return spark.createDataFrame([(clip, i, float(v)) for i, v in enumerate(x)], "clip long, i long, x double")


def test_audio_and_video_microseconds(spark):
    audio = lambda i, r: ts.audio_index_to_us(F.lit(i).cast("long"), F.lit(r))
    got = values(spark, audio(0, 16000), audio(1, 16000), audio(8000, 16000), audio(16000, 16000), audio(-1, 16000), audio(1, 0), audio((1 << 63) - 1, 16000))
    assert [(g["status"], g["microseconds"]) for g in got] == [("kOk", 0), ("kOk", 63), ("kOk", 500000), ("kOk", 1000000), ("kNegativeIndex", None), ("kInvalidSampleRate", None), ("kOverflow", None)]
    video = lambda i, n, d: ts.video_index_to_us(F.lit(i).cast("long"), F.lit(n), F.lit(d))
    got = values(spark, video(1, 25, 1), video(25, 25, 1), video(1, 30000, 1001), video(30000, 30000, 1001), video(107892, 30000, 1001), video(1, 0, 1), video((1 << 63) - 1, 25, 1))
    assert [g["microseconds"] for g in got] == [40000, 1000000, 33367, 1001000000, 3599996400, None, None]
    assert [g["status"] for g in got[-2:]] == ["kInvalidFrameRate", "kOverflow"]


def test_milliseconds(spark):
    us = lambda v: ts.us_to_milliseconds(F.lit(v).cast("long"))
    assert values(spark, us(499), us(500), us(-499), us(-500), us((1 << 63) - 1)) == [0, 1, 0, -1, 9223372036854776]
    ms = lambda v: ts.milliseconds_to_us(F.lit(v).cast("long"))["status"]
    assert values(spark, ms(-1), ms(5), ms(1 << 62)) == ["kNegativeTimestamp", "kOk", "kOverflow"]


def test_counts_of_frames(spark):
    n = lambda length, policy: framing.num_frames(F.lit(length).cast("long"), 400, 160, policy)
    assert values(spark, *[n(1600, p) for p in (framing.COVER, framing.EVERY_HOP, framing.DROP)], n(0, framing.COVER), n(100, framing.COVER), n(100, framing.DROP)) == [9, 10, 8, 0, 1, 0]
    assert values(spark, framing.num_frames(F.lit(1600).cast("long"), 800, 200, framing.COVER), framing.num_frames(F.lit(5).cast("long"), 0, 1, framing.COVER)) == [5, 0]
    assert [framing.samples_of(16000, ms) for ms in (25, 50, 10, 12.5)] == [400, 800, 160, 200]


def test_framing_a_ramp(spark):
    o = framing.FrameOptions(400, 160, "none")
    info = framing.frame_summary(pcm(spark, range(1600)), o).orderBy("frame").collect()
    assert len(info) == 9 and info[8]["start_sample"] == 1280 and [r["contains_padding"] for r in info] == [False] * 8 + [True]
    rows = framing.frame_rows(pcm(spark, range(1600)), o).collect()
    assert sorted((r["frame"], r["k"], r["x"]) for r in rows) == [(f, k, 160 * f + k) for f in range(9) for k in range(400) if 160 * f + k < 1600]


def test_windows(spark):
    ham = [r[0] for r in spark.range(400).select(framing.window_value(F.col("id"), 400, "hamming")).collect()]
    assert 0.06 < ham[0] < 0.1 and ham[199] > 0.99
    assert values(spark, framing.window_value(F.lit(0), 400, "hann"), framing.window_value(F.lit(0), 1, "hann")) == [0.0, 1.0]


def test_peak_gate_and_statistics(spark):
    quiet = signal.peak_normalize(pcm(spark, [0, 0, 0])).collect()
    assert [(r["x"], r["gain"]) for r in quiet] == [(0.0, 1.0)] * 3
    loud = [r["x"] for r in signal.peak_normalize(pcm(spark, [0.5, 0.3, -0.25])).orderBy("i").collect()]
    assert loud == pytest.approx([0.95, 0.57, -0.475])
    gated = [r["x"] for r in pcm(spark, [0.5, 0.005, -0.5, 0.001, 0.8, -0.002]).withColumn("x", signal.noise_gate(F.col("x"), -20)).orderBy("i").collect()]
    assert gated == [0.5, 0, -0.5, 0, 0.8, 0]
    s = signal.pcm_stats(pcm(spark, [0, 1, -1])).first()
    assert (s["max_abs"], round(s["rms"], 3), round(s["zero_ratio"], 3), s["has_nan"]) == (1.0, 0.816, 0.333, False)
    s = signal.pcm_stats(pcm(spark, [0.1, float("nan"), 0.3])).first()
    assert (s["min"], s["max"], s["has_nan"]) == (0.1, 0.3, True)
    assert signal.finite_status(pcm(spark, [1.0, float("inf")])).first()["status"] == "kInvalidPcmData"


def test_chunked_emphasis_is_that_of_the_whole(spark):
    x = [math.sin(i) for i in range(50)]
    whole = [r["x"] for r in signal.pre_emphasis(pcm(spark, x), 0.5).orderBy("i").collect()]
    parts = [r["x"] for r in signal.chunked_pre_emphasis(pcm(spark, x).withColumn("chunk", F.expr("i div 7")), 0.5).orderBy("i").collect()]
    assert whole == parts
    assert whole[:2] == [x[0], x[1] - 0.5 * x[0]]


def test_speech_is_found(spark):
    x = [0.8 * math.sin(2 * math.pi * 440 * i / 16000) if 8000 <= i < 16000 or 24000 <= i else 0.001 for i in range(32000)]
    got = sorted((r["start_frame"], r["end_frame"]) for r in signal.vad_segments(pcm(spark, x)).collect())
    assert got == [(25, 60), (75, 100)]
    assert signal.vad_segments(pcm(spark, [0.0] * 3200)).count() == 0


def test_hangover_is_a_counter(spark):
    rnd = random.Random(3)
    rms = [rnd.choice((0.0, 1.0)) for _ in range(200)]
    got = [r["active"] for r in signal.vad_frames(pcm(spark, [v for v in rms for _ in range(2)]), signal.VadOptions(2, 0.5, 0.01, 3)).orderBy("frame").collect()]
    left, want = 0, []
    for v in rms:
        left = 3 if v else left - 1
        want.append(bool(v) or left >= 0)
    assert got[4:] == want[4:]


def test_spectrum_and_bank(spark):
    bank = spectral.filter_bank(spectral.MelOptions())
    assert bank.shape == (80, 401) and bank.min() >= 0
    x = [math.sin(2 * math.pi * 440 * i / 16000) for i in range(800)]
    frames = spark.createDataFrame([(1, 0, x), (1, 1, x[:200])], "clip long, frame long, samples array<double>")
    for r, want in zip(spectral.spectrum(frames, 800).orderBy("frame").collect(), (x, x[:200] + [0.0] * 600), strict=True):
        assert np.allclose(r["magnitude"], np.abs(np.fft.rfft(want)))
    mel = spectral.mel_features(frames).orderBy("frame").first()["mel"]
    assert len(mel) == 80 and min(mel) >= -4 and max(mel) <= 4
    with pytest.raises(ValueError):
        spectral.MelOptions(fmax=9000)


def test_chunks(spark):
    rows = [(1, t, [1000.0 * f + t for f in range(80)]) for t in range(32)]
    mel = spark.createDataFrame(rows, "clip long, frame long, mel array<double>")
    chunks = framing.mel_chunks(mel).orderBy("chunk").collect()
    assert len(chunks) == 17 and chunks[0]["values"][7 * 16 + 3] == 7003 and chunks[16]["values"][0] == 16
    assert framing.mel_chunks(mel.where("frame < 5")).count() == 0
    assert framing.mel_chunks(mel, freq_major=False).orderBy("chunk").first()["values"][3 * 80 + 7] == 7003
    with pytest.raises(ValueError):
        framing.mel_chunks(mel, hop=0)


@pytest.mark.parametrize("total", [3, 20])
def test_clamped_chunks(spark, total):
    mel = spark.createDataFrame([(1, t, [float(t)]) for t in range(total)], "clip long, frame long, mel array<double>")
    ticks = spark.createDataFrame([(1, k, s) for k, s in enumerate((0, 3, 10, 99))], "clip long, tick long, start long")
    got = {(r["tick"], r["t"]): r["v"] for r in framing.clamped_chunk_rows(ticks, mel, 16).collect()}
    for k, s in enumerate((0, 3, 10, 99)):
        begin = min(s, total - 16) if total >= 16 else 0
        assert [got[k, t] for t in range(16)] == [min(begin + t, total - 1) for t in range(16)]


def test_clamped_pts(spark):
    rnd = random.Random(5)
    for _ in range(3):
        pts = [rnd.randrange(-3, 30) for _ in range(40)]
        out, last = [], -1
        for p in pts:
            last = max(p, last + 1) if p >= 0 else last + 1
            out.append(last)
        df = spark.createDataFrame([(1, n, p) for n, p in enumerate(pts)], "stream long, n long, pts long")
        assert [r["out_pts"] for r in sync.clamped_pts(df).orderBy("n").collect()] == out


def test_played_frame(spark):
    f = lambda *v: sync.played_frame(*[F.lit(x).cast("long") for x in v])
    assert values(spark, f(800, 1000000, 1025000, 16000, 1400, 9999, 0), f(800, 2000000, 1025000, 16000, 1400, 9999, 320), f(800, 1000000, 9000000, 16000, 1400, 1000, 0)) == [1200, 320, 1000]


def test_affine(spark):
    pts = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((100, 200), (300, 400))])
    m = [F.lit(v) for v in (0.5, 0.0, 10.0, 0.0, 0.5, 20.0)]
    got = values(spark, geometry.apply_affine(pts, m))[0]
    assert [tuple(p) for p in got] == [(60, 120), (160, 220)]
    back = values(spark, geometry.apply_affine(geometry.apply_affine(pts, m), geometry.invert_affine(m)))[0]
    assert [tuple(p) for p in back] == [(100, 200), (300, 400)]
    eye = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    a, b = values(spark, geometry.eye_matrix(eye(250, 130), eye(150, 117)), geometry.eye_matrix(eye(1, 1), eye(1, 1)))
    assert b is None
    put = lambda x, y: (a[0] * x + a[1] * y + a[2], a[3] * x + a[4] * y + a[5])
    (lx, ly), (rx, ry) = put(150, 117), put(250, 130)
    assert (lx + rx) / 2 == pytest.approx(48) and ly == pytest.approx(38.4) and ry == pytest.approx(38.4) and rx - lx == pytest.approx(38.4)


def test_quantize(spark):
    q = lambda v: pixels.quantized(F.lit(v))
    got = values(spark, q(0.0), q(0.5), q(1.0), q(-0.5e-6), q(1 + 0.5e-6), q(1.1), q(float("nan")))
    assert [(g["level"], g["corrected"]) for g in got[:5]] == [(0, 0), (128, 0), (255, 0), (0, 1), (255, 1)]
    assert [g["status"] for g in got[5:]] == ["kRangeViolation", "kNonFinitePrediction"]


def test_color_match_never_takes_the_mean_away(spark):
    rnd = random.Random(9)
    rows = [(i, 0, y, x, rnd.random(), rnd.random() ** 3, float(i < 3 or x == 0 and y < 3)) for i in range(5) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(rows, "image long, channel int, y long, x long, base double, gen double, mask double")
    before = {r["image"]: r for r in pixels.masked_stats(df).collect()}
    after = {r["image"]: r for r in pixels.masked_stats(pixels.color_matched(df)).collect()}
    for i in range(5):
        d = lambda r: abs(r["gen_mean"] - r["base_mean"])
        assert d(after[i]) <= d(before[i]) + 1e-6
        assert (i < 3) == (d(after[i]) < d(before[i]) - 1e-9)  # under four pixels nothing is matched
