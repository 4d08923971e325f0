from __future__ import annotations

from lumentide.operators.fold import fold
from lumentide.operators.scheduling import MelChunker, RingBuffer, StreamFramer
from lumentide.streaming import processors as p

SCHEMA = "stream long, seq long, op string, n int, values array<double>, strategy string, timeout int"


def events():
    return [(s, k, "pull" if k % 4 == 3 else "push", 3, [float(k), float(k + s)], "OverwriteOldest", -1) for s in range(2) for k in range(24)]


def run(spark, tmp_path, make_stream):
    rows, source = events(), str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    told, batches = [], []
    q = p.write_to_sink(make_stream(stream), str(tmp_path / "out"), str(tmp_path / "c"), lambda df, n: batches.append(n))
    assert p.finish(q, told.append, 120) == "kSucceeded" and told == ["kSucceeded"] and batches
    return sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()), key=repr)


def batch(spark, make):
    return sorted((tuple(r) for r in fold(spark.createDataFrame(events(), SCHEMA), make).collect()), key=repr)


def test_ring_buffer(spark, tmp_path):
    assert run(spark, tmp_path, lambda s: p.buffered_samples(s, 5)) == batch(spark, lambda: RingBuffer(5))


def test_framer(spark, tmp_path):
    assert run(spark, tmp_path, lambda s: p.framed_samples(s.selectExpr("stream", "seq", "IF(op = 'pull', 'flush', op) AS op", "values"), 4, 2)) == sorted(
        (tuple(r) for r in fold(spark.createDataFrame(events(), SCHEMA).selectExpr("stream", "seq", "IF(op = 'pull', 'flush', op) AS op", "values"), lambda: StreamFramer(4, 2)).collect()), key=repr
    )


def test_mel_chunks(spark, tmp_path):
    keep = lambda df: df.selectExpr("stream", "seq", "'push' AS op", "values")
    want = sorted((tuple(r) for r in fold(keep(spark.createDataFrame(events(), SCHEMA)), lambda: MelChunker(3)).collect()), key=repr)
    assert run(spark, tmp_path, lambda s: p.chunked_mel(keep(s), 3)) == want


def test_failure_is_told_once(spark, tmp_path):
    spark.createDataFrame(events(), SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))

    def broken(df, n):
        raise RuntimeError("sink")

    told = []
    assert p.finish(p.write_to_sink(stream, str(tmp_path / "out"), str(tmp_path / "c"), broken), told.append, 120) == "kFailed" and told == ["kFailed"]


def test_missing_events_are_given_up(spark, tmp_path):
    """Over so many early events the first missing number is told by an empty row, and what waits goes on."""
    from lumentide.operators.fold import fold_stream

    rows = [(1, k, "push", 3, [float(k), 1.0], "OverwriteOldest", -1) for k in (0, 1, 4, 5, 6, 2)]
    source = str(tmp_path / "in")
    for k in range(6):
        spark.createDataFrame(rows[k : k + 1], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    out = fold_stream(stream, lambda: RingBuffer(50), most_early=2)
    assert p.finish(p.write_to_sink(out, str(tmp_path / "out"), str(tmp_path / "c")), lambda s: None, 120) == "kSucceeded"
    got = sorted((r["seq"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "kOk"), (1, "kOk"), (2, None), (4, "kOk"), (5, "kOk"), (6, "kOk")]


def test_stop_is_idempotent(spark, tmp_path):
    spark.createDataFrame(events(), SCHEMA).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    assert p.stop(q) == "kStopped" and p.stop(q) == "kStopped"
