"""State machines of the synchronisation layer: frame scheduler, sample ring buffer, chunked framer.

They are plain Python and run one event at a time; ``fold`` and ``fold_stream`` drive them.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass, field


@dataclass
class FrameScheduler:
    """Frames are pushed as they come and handed out against a reference clock.

    Events: op ``push`` (pts, frame_index, valid), ``schedule`` (ref; null when the clock
    can't be read) or ``reset``.
    """

    max_queue: int
    min_buffered: int
    tolerance_us: int
    drop_oldest: bool = True
    queue: list[tuple[int, int]] = field(default_factory=list)
    last: tuple[int, int] | None = None
    ref: int | None = None
    running: bool = False

    OUT = "result string, pts long, frame_index long, diff_us long, dropped long, queued long, state string"

    def __post_init__(self):
        if self.max_queue <= 0 or self.min_buffered <= 0 or self.min_buffered > self.max_queue or self.tolerance_us < 0:
            raise ValueError("scheduler options out of range")

    def step(self, event: dict) -> list[tuple]:
        result, frame, diff, dropped = {"push": self._push, "schedule": self._schedule, "reset": self._reset}[event["op"]](event)
        pts, index = frame or (None, None)
        return [(result, pts, index, diff, dropped, len(self.queue), "kRunning" if self.running else "kBuffering")]

    def _push(self, e: dict):
        pts, index = e.get("pts"), e.get("frame_index")
        if e.get("valid") is False or pts is None or index is None or pts < 0 or index < 0:
            return "kRejectedInvalidFrame", None, None, 0
        frame = (int(pts), int(index))
        if self.last and frame[0] <= self.last[0]:
            return "kRejectedStalePts", None, None, 0
        if any(q[0] == frame[0] for q in self.queue):
            return "kRejectedDuplicatePts", None, None, 0
        result = "kAccepted"
        if len(self.queue) >= self.max_queue:
            if not self.drop_oldest:
                return "kRejectedQueueFull", None, None, 0
            self.queue.pop(0)
            result = "kDroppedOldest"
        bisect.insort(self.queue, frame)
        return result, frame, None, int(result == "kDroppedOldest")

    def _none(self, diff: int | None = None, dropped: int = 0):
        return ("kRepeatLast", self.last, diff, dropped) if self.last else ("kBufferingNoFrame", None, diff, dropped)

    def _schedule(self, e: dict):
        ref = e.get("ref")
        if ref is None:
            return "kClockUnavailable", None, None, 0
        ref = int(ref)
        if ref < 0 or (self.ref is not None and ref < self.ref):
            return "kRejectedInvalidReferenceTime", None, None, 0
        self.ref = ref
        if not self.running and len(self.queue) < self.min_buffered:
            return self._none()
        dropped = 0
        while self.queue and self.queue[0][0] - ref < -self.tolerance_us:
            self.queue.pop(0)
            dropped += 1
        if not self.queue:
            self.running = False
            return self._none(None, dropped)
        diff = self.queue[0][0] - ref
        if diff > self.tolerance_us:
            return self._none(diff, dropped)
        self.last, self.running = self.queue.pop(0), True
        return "kDropAndDeliver" if dropped else "kDeliver", self.last, diff, dropped

    def _reset(self, e: dict):
        self.queue, self.last, self.ref, self.running = [], None, None, False
        return "kReset", None, None, 0

    def dump(self) -> dict:
        return {"queue": self.queue, "last": self.last, "ref": self.ref, "running": self.running}

    def load(self, held: dict) -> None:
        self.queue = [tuple(q) for q in held["queue"]]
        self.last = tuple(held["last"]) if held["last"] else None
        self.ref, self.running = held["ref"], held["running"]


@dataclass
class RingBuffer:
    """Samples in a bounded buffer.

    Events: op ``push`` (values, strategy ``Block`` | ``OverwriteOldest`` | ``DropNewest``,
    timeout), ``pull`` (n, timeout), ``close``, ``clear`` or ``reset``. Waiting is not
    simulated: a blocked operation says at once how its wait would end, ``kBlocked`` where
    it would wait for ever. A chunk larger than the buffer is refused.
    """

    capacity: int
    rate: int = 16000
    data: list[float] = field(default_factory=list)
    pulled: int = 0
    overwritten: int = 0
    lost: int = 0
    closed: bool = False

    OUT = "status string, values array<double>, start_index long, pts_ms double, size long, total_overwritten long, total_dropped long"

    def step(self, event: dict) -> list[tuple]:
        op = event["op"]
        status, values, start = "kOk", None, None
        if op == "push":
            status = self._push(event)
        elif op == "pull":
            status, values, start = self._pull(event)
        elif op == "close":
            self.closed = True
        else:
            self.data = []
            if op == "reset":  # a closed buffer stays closed
                self.pulled = self.overwritten = self.lost = 0
        return [(status, values, start, None if start is None else start * 1000.0 / self.rate, len(self.data), self.overwritten, self.lost)]

    def _push(self, e: dict) -> str:
        values, strategy, timeout = e.get("values") or [], e.get("strategy") or "Block", e.get("timeout") or 0
        if not values:
            return "kEmptyInput"
        if not all(math.isfinite(v) for v in values):
            return "kInvalidPcmData"
        if self.closed:
            return "kClosed"
        over = len(self.data) + len(values) - self.capacity
        if over > 0:
            if strategy == "DropNewest":
                self.lost += len(values)
                return "kInsufficientSpace"
            if len(values) > self.capacity:
                return "kInvalidChunk"
            if strategy == "Block":
                return "kWouldBlock" if timeout < 0 else "kTimeout" if timeout > 0 else "kBlocked"
            del self.data[:over]
            self.overwritten += over
        self.data += values
        return "kOk"

    def _pull(self, e: dict) -> tuple[str, list[float] | None, int | None]:
        n, timeout = int(e.get("n") or 0), e.get("timeout") or 0
        if n <= 0:
            return "kInvalidReadSize", None, None
        if n > len(self.data):
            return "kClosed" if self.closed else "kInsufficientData" if timeout < 0 else "kTimeout" if timeout > 0 else "kBlocked", None, None
        values, start = self.data[:n], self.pulled
        del self.data[:n]
        self.pulled += n
        return "kOk", values, start

    def dump(self) -> dict:
        return {k: getattr(self, k) for k in ("data", "pulled", "overwritten", "lost", "closed")}

    def load(self, held: dict) -> None:
        for k, v in held.items():
            setattr(self, k, v)


@dataclass
class StreamFramer:
    """Chunks in, frames out. Events: op ``push`` (values) or ``flush``; a flush pads what is left to one frame, unless the policy drops it."""

    size: int
    hop: int
    drop_tail: bool = False
    data: list[float] = field(default_factory=list)
    index: int = 0

    OUT = "frame long, padded boolean, samples array<double>"

    def step(self, event: dict) -> list[tuple]:
        out, at = [], 0
        if event["op"] == "push":
            self.data += event.get("values") or []
            while len(self.data) - at >= self.size:
                out.append((self.index, False, self.data[at : at + self.size]))
                self.index += 1
                at += self.hop
            self.data = self.data[at:]
        else:
            if self.data and not self.drop_tail:
                rest = self.data[: self.size]
                out.append((self.index, True, rest + [0.0] * (self.size - len(rest))))
                self.index += 1
            self.data = []
        return out

    def dump(self) -> dict:
        return {"data": self.data, "index": self.index}

    def load(self, held: dict) -> None:
        self.data, self.index = held["data"], held["index"]


@dataclass
class StreamEmphasis:
    """Pre-emphasis over chunks: each chunk's first sample sees the last input of the chunk before."""

    alpha: float = 0.97
    last: float | None = None

    OUT = "values array<double>"

    def step(self, event: dict) -> list[tuple]:
        values = event.get("values") or []
        out = [v - (self.alpha * p if p is not None else 0.0) for p, v in zip([self.last, *values], values)]
        self.last = values[-1] if values else self.last
        return [(out,)]

    def dump(self) -> dict:
        return {"last": self.last}

    def load(self, held: dict) -> None:
        self.last = held["last"]


@dataclass
class MelChunker:
    """Mel rows in, chunks of ``rows`` out, by frequency; ``hop`` rows go for each. Events: op ``push`` (values) or ``flush``."""

    rows: int = 16
    hop: int = 1
    held: list[list[float]] = field(default_factory=list)
    index: int = 0

    OUT = "chunk long, values array<double>"

    def step(self, event: dict) -> list[tuple]:
        if event["op"] == "flush":
            self.held = []
            return []
        self.held.append(event["values"])
        out = []
        while len(self.held) >= self.rows:
            out.append((self.index, [r[f] for f in range(len(self.held[0])) for r in self.held[: self.rows]]))
            self.index += 1
            del self.held[: max(1, self.hop)]
        return out

    def dump(self) -> dict:
        return {"held": self.held, "index": self.index}

    def load(self, held: dict) -> None:
        self.held, self.index = held["held"], held["index"]


@dataclass
class TaskQueue:
    """A bounded FIFO of tasks. Events: op ``push`` (task), ``pop``, ``close`` or ``cancel``; close lets what is queued out, cancel throws it away."""

    capacity: int
    items: list = field(default_factory=list)
    closed: bool = False
    cancelled: bool = False
    high: int = 0
    unprocessed: int = 0

    OUT = "status string, task string, queued long, high_watermark long, unprocessed long"

    def step(self, event: dict) -> list[tuple]:
        op, status, task = event["op"], "kOk", None
        if op == "push":
            if self.closed or self.cancelled:
                status = "kClosed"
            elif len(self.items) >= self.capacity:
                status = "kBlocked"
            else:
                self.items.append(event.get("task"))
                self.high = max(self.high, len(self.items))
        elif op == "pop":
            if self.cancelled or (self.closed and not self.items):
                status = "kEnd"
            elif not self.items:
                status = "kBlocked"
            else:
                task = self.items.pop(0)
        elif op == "close":
            self.closed = self.closed or not self.cancelled
        elif not self.cancelled:
            self.cancelled, self.unprocessed, self.items = True, len(self.items), []
        return [(status, task, len(self.items), self.high, self.unprocessed)]

    def dump(self) -> dict:
        return {k: getattr(self, k) for k in ("items", "closed", "cancelled", "high", "unprocessed")}

    def load(self, held: dict) -> None:
        for k, v in held.items():
            setattr(self, k, v)


@dataclass
class Playback:
    """The states of one clip's playback, without a device: its callbacks are events.

    Events: op ``prepare`` (total, rate, channels, finite), ``start`` (now), ``callback``
    (n: frames that the device takes; now), ``tick`` (now), ``finished``, ``stop`` (now),
    ``abort`` (now) or ``reset``. Times are microseconds. The frame that is told never
    falls, runs on from the last callback by the clock, and stops at what was taken.
    """

    state: str = "kIdle"
    total: int = 0
    rate: int = 0
    taken: int = 0
    anchor: int = 0
    anchor_us: int = 0
    last: int = 0

    OUT = "status string, state string, frame long"

    def step(self, event: dict) -> list[tuple]:
        op = event["op"]
        status = {"prepare": self._prepare, "start": self._start, "callback": self._callback, "tick": self._tick, "finished": self._finished, "stop": self._end, "abort": self._end, "reset": self._reset}[op](event)
        return [(status, self.state, self.last)]

    def _prepare(self, e: dict) -> str:
        if self.state != "kIdle":
            return "kInvalidState"
        if (e.get("total") or 0) <= 0:
            return "kEmptyAudio"
        if (e.get("rate") or 0) <= 0:
            return "kInvalidSampleRate"
        if e.get("channels") != 1:
            return "kUnsupportedChannels"
        if e.get("finite") is False:
            return "kInvalidPcmData"
        self.total, self.rate, self.state = int(e["total"]), int(e["rate"]), "kPrepared"
        return "kOk"

    def _start(self, e: dict) -> str:
        if self.state != "kPrepared":
            return "kInvalidState"
        self.taken = self.anchor = self.last = 0
        self.anchor_us, self.state = int(e.get("now") or 0), "kRunning"
        return "kOk"

    def _callback(self, e: dict) -> str:
        if self.state != "kRunning":
            return "kInvalidState"
        self._tick(e)
        self.anchor, self.anchor_us = self.taken, int(e.get("now") or 0)
        self.taken = min(self.total, self.taken + int(e.get("n") or 0))
        return "kOk"

    def _tick(self, e: dict) -> str:
        if self.state == "kRunning":
            elapsed = int(e.get("now") or 0) - self.anchor_us
            if elapsed >= 0:
                self.last = max(self.last, min(self.anchor + elapsed * self.rate // 1_000_000, self.taken, self.total))
        return "kOk"

    def _finished(self, e: dict) -> str:
        if self.state == "kRunning" and self.taken >= self.total:
            self.state, self.last = "kCompleted", self.total
        return "kOk"

    def _end(self, e: dict) -> str:
        if self.state == "kCompleted":
            return "kOk"
        if self.state != "kRunning":
            return "kInvalidState"
        self._tick(e)
        done = e["op"] == "stop" and self.taken >= self.total
        self.state = "kCompleted" if done else "kStopped"
        self.last = self.total if done else self.last
        return "kOk"

    def _reset(self, e: dict) -> str:
        self.load(Playback().dump())
        return "kOk"

    def dump(self) -> dict:
        return {k: getattr(self, k) for k in ("state", "total", "rate", "taken", "anchor", "anchor_us", "last")}

    def load(self, held: dict) -> None:
        for k, v in held.items():
            setattr(self, k, v)
