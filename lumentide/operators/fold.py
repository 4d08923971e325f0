"""Ordered folds: a state machine run over each key's events in order, in batch or in a stream.

In batch, rows are dealt by key, sorted within partitions and streamed through one
machine at a time, so memory holds a machine and an Arrow batch, never a whole key. In a
stream, events carry a sequence number from 0; what arrives early waits in the state, so
many events at most: then the missing ones are given up, which a row tells.

A machine has ``step(event: dict) -> list[tuple]``, ``dump() -> dict`` (JSON) and
``load(dict)``. Its class has ``OUT``, the output columns after key and seq.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Machine(Protocol):
    OUT: str

    def step(self, event: dict) -> list[tuple]: ...
    def dump(self) -> dict: ...
    def load(self, held: dict) -> None: ...


def _plain(event: dict) -> dict:
    return {k: None if v is None or (isinstance(v, float) and v != v and k != "values") else list(v) if hasattr(v, "__len__") and not isinstance(v, str) else v for k, v in event.items()}


def _names(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in schema.split(",")]


def fold(events: DataFrame, make: Callable[[], Machine], key: str = "stream", order: str = "seq") -> DataFrame:
    """(key, order, machine's columns): what the machine says to each event."""
    kinds = events.schema[key].dataType.simpleString(), events.schema[order].dataType.simpleString()
    schema = f"{key} {kinds[0]}, {order} {kinds[1]}, {make().OUT}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, machine = object(), None
        for frame in frames:
            out = []
            for event in frame.to_dict("records"):
                if event[key] != current:
                    current, machine = event[key], make()
                out += [(event[key], event[order], *row) for row in machine.step(_plain(event))]
            yield pd.DataFrame(out, columns=_names(schema)).astype({key: frame[key].dtype, order: frame[order].dtype})

    return events.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def fold_stream(events: DataFrame, make: Callable[[], Machine], key: str = "stream", order: str = "seq", most_early: int = 10_000) -> DataFrame:
    """``fold`` over a streaming DataFrame. ``order`` counts each key's events from 0; early ones are held until those before them come.

    Where over ``most_early`` events of a key wait, the first missing number is told by a row without the machine's columns, and the
    earliest of those that wait is next, so a lost event can't make the state grow for ever. Of a gap's late events nothing is made.
    """
    kinds = events.schema[key].dataType.simpleString(), events.schema[order].dataType.simpleString()
    schema = f"{key} {kinds[0]}, {order} {kinds[1]}, {make().OUT}"
    names = _names(schema)

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine, held = make(), {"next": 0, "early": [], "machine": None}
        if state.exists:
            held = json.loads(state.get[0])
            machine.load(held["machine"])
        fresh = [_plain(e) for frame in frames for e in frame.to_dict("records")]
        early = sorted(held["early"] + fresh, key=lambda e: e[order])
        out, at = [], 0
        while at < len(early):
            ahead = early[at][order] - held["next"]
            if ahead > 0 and len(early) - at <= most_early:
                break
            if ahead > 0:
                out.append((name[0], held["next"], *[None] * (len(names) - 2)))
                held["next"] = early[at][order]
            elif ahead == 0:
                out += [(name[0], early[at][order], *row) for row in machine.step(early[at])]
                held["next"] += 1
                at += 1
            else:  # seen before, or given up
                at += 1
        state.update((json.dumps({"next": held["next"], "early": early[at:], "machine": machine.dump()}, default=float),))
        yield pd.DataFrame(out, columns=names)

    return events.groupBy(key).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.NoTimeout)
