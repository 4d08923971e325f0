"""Connected components by alternating large-star and small-star.

Links are contracted within tasks first: each task's links become stars on the smallest
node they reach. Then each round hangs a node's larger neighbours on the smallest node it
knows (large-star), and its smaller neighbours and itself on the smallest of them
(small-star), until the edges are those of the round before. Edges stay at most as many
as at the start. Minima are combined before they are shuffled; a hot node's minimum is
broadcast to its edges, as there can't be many hot nodes. Each round is written to the
shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentide.llm.shared import FEW, Shared, with_facts

ROWS_A_FILE = 500_000


def components(links: DataFrame, shared: Shared, name: str = "stars") -> DataFrame:
    """(id, component) for every node of ``links`` (a, b) but the smallest of each component, which is its component's name. ``links`` is a written table.

    Null ends, loops and repeated links are ignored.
    """
    some = links.where("a <> b").select("a", "b")
    edges = some.coalesce(1 + some.count() // ROWS_A_FILE).mapInArrow(_contracted, "u long, v long").distinct()
    edges = shared.write(edges, f"{name}-0")
    before, turn = _mark(edges), 0
    while before[0]:
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # there are at most twice as many nodes as edges
        met = both.where("v > u").join(F.broadcast(least), "u") if 2 * before[0] <= FEW else with_facts(both.where("v > u"), least, ["u"], "n", 2 * before[0], written=False)
        large = met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct()
        # edges never grow, so a table of few rows needs few files
        edges = shared.write(after.coalesce(1 + before[0] // ROWS_A_FILE), f"{name}-{turn}")
        shared.drop(f"{name}-{turn - 1}")
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (node, smallest node) of a task's links, some ``ROWS_A_FILE`` of them at once."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2)]))
        if sum(h.shape[1] for h in held) > ROWS_A_FILE:
            held = [stars(np.concatenate(held, 1))]
            if held[0].shape[1] > ROWS_A_FILE // 2:
                yield _edges(held.pop())
    if held:
        yield _edges(stars(np.concatenate(held, 1)))


def _edges(table: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(table[0]), pa.array(table[1])], ["u", "v"])


def stars(links: np.ndarray) -> np.ndarray:
    """Each node of the links but the smallest of its component, over that smallest."""
    nodes, ends = np.unique(links, return_inverse=True)
    a, b = ends.reshape(links.shape)
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack((nodes[leaf], nodes[root[leaf]]))


def _mark(edges: DataFrame) -> tuple:
    """A count and a sum of hashes that tell two edge sets apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
