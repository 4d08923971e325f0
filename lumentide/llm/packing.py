"""Harmonic packing of token sequences.

A document's ids are cut into pieces: whole sequences first, then the largest powers of
two, until a tail of at most ``capacity / 16`` is left. A piece belongs to a class 1/k: it
is at most capacity/k long and a sequence of that class takes exactly k pieces, so that a
worker fills the sequences of a class by counting alone. A worker's share of each class
begins where the counts of the workers before it end; only these counts meet, never the
pieces. What is left over of each class, fewer than k pieces whatever the size of the
input, is packed by first fit decreasing in one small task.

Cases: a null or empty text is one piece that holds the end id. Repeated rows are
packed as rows of their own, told apart by ``worker`` and ``rank``. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from lumentide.llm.shared import Shared
from lumentide.llm.textio import blocks
from lumentide.llm.tokens import WordTokenizer, held

CAPACITY = 4096


def classes(capacity: int, ratio: float = 1.12) -> list[int]:
    """The k of all classes: powers of two up to 16, then a grid up to ``capacity``."""
    out = [k for k in (1, 2, 4, 8, 16) if k <= capacity]
    while out[-1] < capacity:
        out.append(min(capacity, max(out[-1] + 1, int(out[-1] * ratio))))
    return out


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > capacity // 16:
        out.append(1 << (n.bit_length() - 1))
        n -= out[-1]
    return out + [n] * (n > 0)


def crc_payload(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    capacity: int = CAPACITY,
    payload: tuple[str, Callable[[np.ndarray], object], str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece: id, start, length, doc_tokens, sequence_id, offset, and the payload.

    ``payload``: name, function of a piece's ids and Spark type; by default the ids themselves.
    ``capacity`` is a power of two, 16 or more.
    """
    if capacity < 16 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two, 16 or more")
    name, value, kind = payload or ("ids", lambda ids: ids.tolist(), "array<int>")
    spark, grid = docs.sparkSession, np.array(classes(capacity))
    ids_kind = docs.schema[id_col].dataType.simpleString()
    # the largest k with length <= capacity / k
    class_of = grid[np.searchsorted(grid, capacity // np.maximum(np.arange(capacity + 1), 1), side="right") - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, worker, ranks = held(WordTokenizer, tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part, texts in blocks(batches):
            ids, bounds = tokenizer.encode_block(texts)
            rows, starts, lengths, totals, values = [], [], [], [], []
            for i, (b, e) in enumerate(pairwise(bounds.tolist())):
                own, at = np.append(ids[b:e].astype(np.uint32), np.uint32(end_id)), 0
                for n in cut(len(own), capacity):
                    rows.append(i)
                    starts.append(at)
                    lengths.append(n)
                    totals.append(len(own))
                    values.append(value(own[at : at + n]))
                    at += n
            k = class_of[np.array(lengths)]
            order = np.argsort(k, kind="stable")
            heads = np.flatnonzero(np.concatenate(([True], k[order[1:]] != k[order[:-1]])))
            counts = np.diff(np.append(heads, len(k)))
            rank = np.empty(len(k), np.int64)
            rank[order] = np.arange(len(k)) - np.repeat(heads, counts) + np.repeat(ranks[k[order[heads]]], counts)
            ranks[k[order[heads]]] += counts
            columns = [part.column(0).take(pa.array(rows)), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(values, out_type), pa.array(k, pa.int64()), pa.array(np.full(len(k), worker, np.int64)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "doc_tokens", "payload", "k", "worker", "rank"])

    out_type = to_arrow_type(_parse_datatype_string(kind))
    shared = Shared(spark, "pack")
    pieces = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {ids_kind}, start long, length long, doc_tokens long, payload {kind}, k long, worker long, rank long")
    pieces = shared.write(pieces, "pieces")

    before = Window.partitionBy("k").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    shares = pieces.groupBy("k", "worker").count()
    shares = shared.write(shares.select("k", "worker", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"), "count"), "shares")
    # one row for each class, at most len(grid) of them
    base, tables = 0, {}
    for k, total in sorted(shares.groupBy("k").agg(F.sum("count")).collect()):
        tables[k] = (base, total // k * k)
        base += total // k
    firsts = F.create_map(*[F.lit(x) for k, (first, _) in tables.items() for x in (k, first)]) if tables else F.create_map().cast("map<bigint,bigint>")
    fulls = F.create_map(*[F.lit(x) for k, (_, full) in tables.items() for x in (k, full)]) if tables else F.create_map().cast("map<bigint,bigint>")
    placed = pieces.join(shares.drop("count"), ["k", "worker"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "worker")
    full = F.col("rank") < F.element_at(fulls, F.col("k"))
    packed = placed.where(full).withColumn("sequence_id", F.element_at(firsts, F.col("k")).cast("long") + F.expr("rank div k"))
    rest = placed.where(~full)

    def first_fit(left: pd.DataFrame) -> pd.DataFrame:
        """Longest first, each sequence takes the longest that still fits; sizes are few, so each is a stack."""
        left = left.sort_values(["length", "k", "rank"], ignore_index=True)
        stacks = {n: list(g.index) for n, g in left.groupby("length")}
        sizes, sequence, out = sorted(stacks), base, np.zeros(len(left), np.int64)
        while sizes:
            room = capacity
            for n in reversed(list(sizes)):
                while n <= room and stacks[n]:
                    out[stacks[n].pop()] = sequence
                    room -= n
            sizes = [n for n in sizes if stacks[n]]
            sequence += 1
        return left.assign(sequence_id=out)

    # fewer than the sum of all k rows, whatever the input
    rest_columns = [*rest.columns, "sequence_id"]
    kept = rest.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda p: first_fit(p)[rest_columns], rest.withColumn("sequence_id", F.lit(0).cast("long")).schema)
    inside = Window.partitionBy("sequence_id").orderBy("k", "rank").rowsBetween(Window.unboundedPreceding, -1)
    out = packed.unionByName(kept).withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return out.select(F.col("id").alias(id_col), "start", "length", F.col("payload").alias(name), "doc_tokens", "sequence_id", "offset")
