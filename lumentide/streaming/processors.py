"""Structured Streaming forms of the stateful operators, and a sink that ends exactly once.

Each takes a streaming DataFrame of events (stream, seq, ...) and keeps its machine as
the key's state. Batch forms are ``lumentide.operators.fold.fold`` with the same machines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lumentide.operators.fold import fold_stream
from lumentide.operators.scheduling import FrameScheduler, MelChunker, Playback, RingBuffer, StreamEmphasis, StreamFramer, TaskQueue


def scheduled_frames(events: DataFrame, max_queue: int = 4, min_buffered: int = 2, tolerance_us: int = 20_000, drop_oldest: bool = True) -> DataFrame:
    return fold_stream(events, lambda: FrameScheduler(max_queue, min_buffered, tolerance_us, drop_oldest))


def buffered_samples(events: DataFrame, capacity: int, rate: int = 16000) -> DataFrame:
    return fold_stream(events, lambda: RingBuffer(capacity, rate))


def framed_samples(events: DataFrame, size: int, hop: int, drop_tail: bool = False) -> DataFrame:
    return fold_stream(events, lambda: StreamFramer(size, hop, drop_tail))


def emphasized_samples(events: DataFrame, alpha: float = 0.97) -> DataFrame:
    return fold_stream(events, lambda: StreamEmphasis(alpha))


def chunked_mel(events: DataFrame, rows: int = 16, hop: int = 1) -> DataFrame:
    return fold_stream(events, lambda: MelChunker(rows, hop))


def queued_tasks(events: DataFrame, capacity: int) -> DataFrame:
    return fold_stream(events, lambda: TaskQueue(capacity))


def played_states(events: DataFrame) -> DataFrame:
    return fold_stream(events, Playback)


def stop(query: StreamingQuery, drain: bool = True) -> str:
    """Ends a query: what has arrived is worked off first, if wanted. A query that has ended already stays so."""
    if query.isActive:
        if drain:
            query.processAllAvailable()
        query.stop()
    return "kFailed" if query.exception() else "kStopped"


def write_to_sink(frames: DataFrame, path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends micro-batches to a table, each under its number, so that a batch that runs again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_batch:
            on_batch(batch, number)

    return frames.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(query: StreamingQuery, on_terminal: Callable[[str], None], timeout: int | None = None) -> str:
    """Waits for the end and tells it once: kSucceeded, kFailed or kCancelled."""
    try:
        ended = query.awaitTermination(timeout) if timeout else (query.awaitTermination(), True)[1]
        state = "kSucceeded" if ended else "kCancelled"
        if not ended:
            query.stop()
    except Exception:
        state = "kFailed"
    on_terminal(state)
    return state
