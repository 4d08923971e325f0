"""From band keys to verified components, without pairs of whole buckets.

1. Each task sorts its pairs (key, id), and of ids that share a key there all but the
   first, its pivot, are paired with it on the spot. Only pivots meet by key; the others
   travel spread evenly, so a key that a third of all items have is no more than some
   rows from each task. Where a key's pivots meet they are paired with the first of them.
2. These pairs, as many as rows, are verified, and the links' components found.
3. Buckets whose members still lie in several components are gone through again, in
   blocks. What isn't of a bucket's largest component is compared by signature with all
   blocks, in the first band that a pair shares; then only what is likely enough gets its
   text, and the likeliest pairs come first to be confirmed on full sets. What a confirmed
   link joins needs no further pair. Only links leave a task. Blocks grow with the root of
   their bucket, so n items that are all of small components are sent some n ** 1.5 / 11
   times, without texts, not n ** 2 / 128 times.

So each pair of a bucket has been confirmed or refuted on full sets, ruled out by its
signature, or joined already: no link is lost for the shortcut, and near copies in
thousands cost as many rows as there are copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentide.llm.components import components
from lumentide.llm.shared import Shared, partitions, with_facts
from lumentide.llm.textio import common_counts

#: items of a small bucket's block, and thousands of characters of a block's texts
BLOCK, BLOCK_THOUSANDS = 128, 8_000
#: a key's low bits are its band, and the next one tells a pivot that has company in its task
BAND_BITS = 5
COMPANY = 1 << BAND_BITS
#: bytes compared at once
_AT_ONCE = 1 << 22
#: texts whose sets are made at once, and shingles that are held
_SETS, _SHINGLES = 64, 1 << 22
_TEXT_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Similarity:
    """How items are compared. ``sets``: from texts, their sorted distinct shingles of 57 bits in a row and bounds; ``least``: equal signature bytes below which a pair can't be a link."""

    sets: Callable[[list[bytes | None]], tuple[np.ndarray, np.ndarray]]
    percent: int
    least: int

    def linked(self, one: np.ndarray, two: np.ndarray) -> bool:
        if not len(one) or not len(two):
            return False
        if len(one) > len(two):
            one, two = two, one
        if 100 * len(one) < self.percent * len(two):
            return False
        both = int(np.count_nonzero(two.take(two.searchsorted(one), mode="clip") == one))
        return 100 * both >= self.percent * (len(one) + len(two) - both)


# dealing


def packed(deal: np.ndarray, columns: list[np.ndarray], parts: int, first_part: int = 0) -> pa.RecordBatch:
    """Rows (part, data): the columns' rows dealt to ``parts`` by the upper half of ``deal``, packed column after column; all of 64 bits."""
    part = (deal.view(np.uint64) >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
    part, table = part[order], [np.ascontiguousarray(c)[order] for c in columns]
    heads = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
    spans = list(zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True)) if len(part) else []
    data = [b"".join(c[b:e].tobytes() for c in table) for b, e in spans]
    return pa.RecordBatch.from_arrays([pa.array([first_part + int(part[b]) for b, _ in spans], pa.int64()), pa.array(data, pa.binary())], ["part", "data"])


def part_count(spark) -> int:
    """Parts are a quarter of a shuffle partition, so that one is small to sort."""
    return 4 * partitions(spark)


SPREAD = np.int64(0x1E3779B97F4A7C15)


class Dealer:
    """Deals a task's rows (key, id), some ``most`` of them at once: pivots (key with the ``COMPANY`` bit, id) by key to the first ``parts``, the others (key, id, pivot) by id to as many behind."""

    def __init__(self, parts: int, most: int = 1 << 20):
        self.parts, self.most, self.held, self.size = parts, most, [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((keys, ids))
        self.size += len(keys)
        if self.size >= self.most:
            yield from self.dealt()

    def dealt(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        k, i = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        k, i, heads, counts = _grouped(k, i)
        yield packed(k[heads], [k[heads] + COMPANY * (counts > 1), i[heads]], self.parts)
        rest = np.ones(len(k), bool)
        rest[heads] = False
        if rest.any():
            pivots = np.repeat(i[heads], counts)[rest]
            with np.errstate(over="ignore"):
                yield packed(i[rest] * SPREAD, [k[rest], i[rest], pivots], self.parts, self.parts)


def _grouped(k: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows by key and id, the first row of each key, and its number of rows."""
    order = np.argsort(k)
    k, i = k[order], i[order]
    same = k[1:] == k[:-1]
    if (many := np.concatenate(([False], same)) | np.concatenate((same, [False]))).any():  # most rows are alone with their key
        at = np.flatnonzero(many)
        i[at] = i[at][np.lexsort((i[at], k[at]))]
        fresh = np.concatenate(([True], ~same | (i[1:] != i[:-1])))
        k, i = k[fresh], i[fresh]
    heads = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k, i, heads, np.diff(np.append(heads, len(k)))


#: numbers that a task holds at once, 128 MB
HELD = 1 << 24


def met(rows: DataFrame, width: Callable[[int], int], make: Callable[[int], Callable[[np.ndarray, bool], Iterator[pa.RecordBatch]]], schema: str, held: int = HELD) -> DataFrame:
    """Deals rows (part, data) of ``packed`` by part and feeds each part to what ``make(part)`` gives, as tables of ``width(part)`` rows.

    A task holds its few parts side by side, ``held`` numbers at most: mostly each is one
    table; a swollen one comes in pieces, and the second argument tells the last, which
    may be empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feeds, tables, sizes = {}, {}, {}

        def fed(part: int, last: bool) -> Iterator[pa.RecordBatch]:
            sizes.pop(part)
            return feeds[part](np.concatenate(tables.pop(part), axis=1), last)

        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part not in feeds:
                    feeds[part] = make(part)
                table = np.frombuffer(data, np.int64).reshape(width(part), -1)
                tables.setdefault(part, []).append(table)
                sizes[part] = sizes.get(part, 0) + table.size
            while sum(sizes.values()) > held:  # the largest part gives what it has
                yield from fed(max(sizes, key=sizes.get), False)
        for part in sorted(feeds):
            if part in sizes:
                yield from fed(part, True)
            else:
                yield from feeds[part](np.zeros((width(part), 0), np.int64), True)

    return rows.repartition(partitions(rows.sparkSession), "part").mapInArrow(run, schema)


BUCKETS = "key long, id long, pivot long"


def buckets(dealt: DataFrame, parts: int, held: int = HELD) -> DataFrame:
    """(key, id, pivot) of all rows of keys that two ids or more have, of rows of ``Dealer``."""
    return met(dealt, lambda part: 2 if part < parts else 3, lambda part: Buckets().feed if part < parts else passed, BUCKETS, held)


def passed(table: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
    yield bucket_rows(*table)


def bucket_rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "pivot"])


class Buckets:
    """The pivots (key, id) of one part. Between pieces only each key's pivot and members are kept."""

    def __init__(self):
        self.keys = self.pivots = self.sizes = None

    def feed(self, table: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        k, i = table
        if not len(k):
            return
        n = 1 + ((k & COMPANY) != 0)
        k = k & ~np.int64(COMPANY)
        if self.keys is None and last:  # most pivots are alone with their key, and go before the finer sort
            order = np.argsort(k)
            k, i, n = k[order], i[order], n[order]
            same = k[1:] == k[:-1]
            some = np.concatenate(([False], same)) | np.concatenate((same, [False])) | (n > 1)
            k, i, n = k[some], i[some], n[some]
            if not len(k):
                return
        order = np.lexsort((-n, i, k))
        k, i, n = k[order], i[order], n[order]
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])))  # one id from several tasks is one row, of most company
        k, i, n = k[fresh], i[fresh], n[fresh]
        heads = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        counts = np.diff(np.append(heads, len(k)))
        keys, pivots, before = k[heads], i[heads].copy(), np.zeros(len(heads), np.int64)
        again = np.zeros(len(k), bool)
        if self.keys is not None:
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            seen = self.keys[at] == keys
            pivots[seen], before[seen] = self.pivots[at[seen]], self.sizes[at[seen]]
            again = np.repeat(seen, counts) & (i == np.repeat(pivots, counts))
        sizes = np.add.reduceat(n - again, heads)
        alone = (before == 1) & (sizes > 0)  # pivots that had no company till now
        if alone.any():
            yield bucket_rows(keys[alone], pivots[alone], pivots[alone])
        give = np.repeat(sizes + before > 1, counts) & ~again
        if give.any():
            yield bucket_rows(k[give], i[give], np.repeat(pivots, counts)[give])
        if not last:
            known = [] if self.keys is None else [(self.keys, self.pivots, self.sizes)]
            every, p, n = (np.concatenate(c) for c in zip(*known, (keys, pivots, sizes), strict=True))
            order = np.argsort(every, kind="stable")
            heads = np.flatnonzero(np.concatenate(([True], every[order][1:] != every[order][:-1])))
            self.keys, self.pivots, self.sizes = every[order][heads], p[order][heads], np.add.reduceat(n[order], heads)


# mixed buckets


@dataclass
class Members:
    """Items of one bucket, side by side."""

    ids: np.ndarray
    groups: np.ndarray
    asks: np.ndarray
    visits: np.ndarray
    sigs: np.ndarray
    keys: np.ndarray
    texts: list[bytes | None] | None = None

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at: np.ndarray) -> Members:
        return Members(*(x[at] for x in (self.ids, self.groups, self.asks, self.visits, self.sigs, self.keys)), self.texts and [self.texts[i] for i in at.tolist()])

    def span(self, b: int, e: int) -> Members:
        return Members(*(x[b:e] for x in (self.ids, self.groups, self.asks, self.visits, self.sigs, self.keys)), self.texts and self.texts[b:e])

    @staticmethod
    def joined(parts: list[Members]) -> Members:
        columns = zip(*((p.ids, p.groups, p.asks, p.visits, p.sigs, p.keys) for p in parts), strict=True)
        return Members(*map(np.concatenate, columns), None if parts[0].texts is None else [t for p in parts for t in p.texts])


def likely_pairs(band: int, one: Members, home: Members, how: Similarity) -> np.ndarray:
    """Rows (score, x, y) of pairs of an asking member of ``one`` and one of ``home``: of different groups, likely by signature, of no bucket of a band before, and if both ask then once."""
    found, step = [np.zeros((0, 3), np.int64)], max(1, _AT_ONCE // max(1, home.sigs.size))
    asking = np.flatnonzero(one.asks)
    for at in range(0, len(asking), step):
        own = asking[at : at + step]
        score = (one.sigs[own, None, :] == home.sigs[None, :, :]).sum(-1, dtype=np.int32)
        alike = (score >= how.least) & (one.groups[own, None] != home.groups[None, :])
        alike &= ~home.asks[None, :] | (one.ids[own, None] < home.ids[None, :])
        x, y = np.nonzero(alike)
        if not len(x):
            continue
        before = np.zeros(len(x), bool)
        for column in range(band):
            before |= one.keys[own[x], column] == home.keys[y, column]
        found.append(np.stack((score[x, y], own[x], y), 1)[~before])
    return np.concatenate(found)


class Roots:
    """Which groups have been joined in a bucket's block."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def of(self, g: int) -> int:
        while (p := self.parent.get(g, g)) != g:
            self.parent[g] = self.parent.get(p, p)
            g = p
        return g


class SetCache:
    """Shingle sets of the items that were asked for last."""

    def __init__(self, how: Similarity):
        self.how, self.held, self.size = how, {}, 0

    def fill(self, m: Members, wanted: np.ndarray) -> None:
        """Make the sets of many at once, as far as they can be held."""
        todo = [i for i in np.unique(wanted).tolist() if int(m.ids[i]) not in self.held]
        for at in range(0, len(todo), _SETS):
            some = todo[at : at + _SETS]
            if self.size + sum(len(m.texts[i] or b"") for i in some) > _SHINGLES:
                return
            sets, bounds = self.how.sets([m.texts[i] for i in some])
            for i, b, e in zip(some, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                self._hold(int(m.ids[i]), sets[b:e].copy())

    def of(self, m: Members, i: int) -> np.ndarray:
        key = int(m.ids[i])
        if key not in self.held:
            own = self.how.sets([m.texts[i]])[0]
            while self.held and self.size + len(own) > _SHINGLES:
                self.size -= len(self.held.pop(next(iter(self.held))))
            self._hold(key, own)
        return self.held[key]

    def _hold(self, key: int, own: np.ndarray) -> None:
        self.held[key] = own
        self.size += len(own)


def confirmed(pairs: np.ndarray, one: Members, home: Members, how: Similarity, roots: Roots, cache: SetCache) -> list[tuple[int, int]]:
    """Links that join groups, the likeliest pairs first."""
    links = []
    if one is home:  # its sets are made together
        cache.fill(home, pairs[:, 1:])
    else:
        cache.fill(one, pairs[:, 1])
        cache.fill(home, pairs[:, 2])
    for x, y in pairs[np.argsort(-pairs[:, 0], kind="stable"), 1:].tolist():
        g, h = roots.of(int(one.groups[x])), roots.of(int(home.groups[y]))
        if g != h and how.linked(cache.of(one, x), cache.of(home, y)):
            roots.parent[g] = h
            links.append((int(one.ids[x]), int(home.ids[y])))
    return links


def _blocks_of(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[tuple[tuple[int, int], Members, pa.RecordBatch]]:
    """((key, block), members, rows) of rows sorted so, those at home first: all of them at once, then visitors by the block."""
    for batch in batches:
        if not len(batch):
            continue
        key, block = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "block"))
        every = _numbers(batch)  # at once, as most blocks are of a few rows
        visits = every.visits
        edges = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (visits[1:] != visits[:-1])) + 1
        for b, e in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
            for at in range(b, e, BLOCK):
                part, members = batch.slice(at, min(BLOCK, e - at)), every.span(at, min(at + BLOCK, e))
                if texts:  # only a block's, as they may be long
                    members.texts = part.column(part.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()
                yield (int(key[b]), int(block[b])), members, part


def _numbers(batch: pa.RecordBatch) -> Members:
    """All rows of a batch, without their texts."""
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    number = lambda c: column(c).to_numpy(zero_copy_only=False)
    matrix = lambda c, kind: np.frombuffer(b"".join(column(c).to_pylist()), kind).reshape(len(batch), -1)
    return Members(number("id"), number("component"), number("asks"), number("visits"), matrix("sig", np.uint8), matrix("keys", np.int64))


def _walked(batches: Iterator[pa.RecordBatch], texts: bool, compare: Callable, fresh: Callable, close: Callable) -> Iterator[pa.RecordBatch]:
    """Feeds ``compare(state, key, one, rows, home, home rows)`` block by block: a block with itself, then its visitors; ``close`` ends a state of ``fresh()``."""
    current, home, at_home, state = None, [], [], None

    def settle():
        nonlocal home, at_home
        if len(home) > 1:
            home, at_home = [Members.joined(home)], [pa.concat_batches(at_home)]

    def ended() -> Iterator[pa.RecordBatch]:
        if current is not None:
            if not state["met"]:
                settle()
                yield from compare(state, current[0], home[0], at_home[0], home[0], at_home[0])
            yield from close(state, home, at_home)

    for name, members, rows in _blocks_of(batches, texts):
        if name != current:
            yield from ended()
            current, home, at_home, state = name, [], [], {"met": False, **fresh()}
        if not members.visits[0]:
            home.append(members)
            at_home.append(rows)
            continue
        if not home:  # nothing at home that could be met
            state["met"] = True
            continue
        settle()
        if not state["met"]:
            yield from compare(state, current[0], home[0], at_home[0], home[0], at_home[0])
            state["met"] = True
        yield from compare(state, current[0], members, rows, home[0], at_home[0])
    yield from ended()


def _surviving(batches: Iterator[pa.RecordBatch], how: Similarity) -> Iterator[pa.RecordBatch]:
    """The rows that have a likely pair in their block."""
    names = ["key", "block", "visits", "id", "component", "asks", "sig", "keys", "thousands"]

    def compare(state, key, one, rows, home, at_home):
        pairs = likely_pairs(key & ((1 << BAND_BITS) - 1), one, home, how)
        state["home"].update(pairs[:, 2].tolist())
        if one is home:
            state["home"].update(pairs[:, 1].tolist())
        elif len(pairs):
            yield rows.take(pa.array(np.unique(pairs[:, 1]))).select(names)

    def close(state, home, at_home):
        if state["home"]:
            yield at_home[0].take(pa.array(sorted(state["home"]))).select(names)

    return _walked(batches, False, compare, lambda: {"home": set()}, close)


def _linking(batches: Iterator[pa.RecordBatch], how: Similarity) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows that have their texts."""

    def compare(state, key, one, rows, home, at_home):
        pairs = likely_pairs(key & ((1 << BAND_BITS) - 1), one, home, how)
        if links := confirmed(pairs, one, home, how, state["roots"], state["cache"]):
            a, b = zip(*(sorted(x) for x in links), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _walked(batches, True, compare, lambda: {"roots": Roots(), "cache": SetCache(how)}, lambda *_: iter(()))


# the whole way


def _confirm(batches: Iterator[pa.RecordBatch], how: Similarity) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, sig_a, sig_b, text_a, text_b) the links."""
    for batch in batches:
        if not len(batch):
            continue
        column = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
        x, y = (np.frombuffer(b"".join(column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
        like = np.flatnonzero((x == y).sum(1) >= how.least)
        a, b = column("a").to_numpy()[like], column("b").to_numpy()[like]
        left, right = (column(c).cast(pa.large_binary()).take(pa.array(like)) for c in ("text_a", "text_b"))
        sizes = np.cumsum([len(t) + len(u) for t, u in zip(left.to_pylist(), right.to_pylist(), strict=True)])
        keep, at = np.zeros(len(a), bool), 0
        while at < len(a):
            # as many pairs as can be looked at together; one pair of long texts is alone
            to = max(at + 1, min(at + _SETS, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _TEXT_AT_ONCE, side="right"))))
            one, two = how.sets(left[at:to].to_pylist()), how.sets(right[at:to].to_pylist())
            both, n, m = common_counts(*one, *two), np.diff(one[1]), np.diff(two[1])
            keep[at:to] = (both > 0) & (100 * both >= how.percent * (n + m - both))
            at = to
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def least_equal(hashes: int, percent: int) -> int:
    """Equal signature bytes that a pair at the threshold has fewer of with a chance under 1 in 100,000."""
    p = percent / 100
    return int(hashes * p - 4.3 * (hashes * p * (1 - p)) ** 0.5)


def in_blocks(rows: DataFrame, shared: Shared) -> DataFrame:
    """Rows (key, block, visits, id, component, asks) of rows (key, id, component, asks, thousands): each at home in one of its bucket's blocks, what asks in all of them."""
    total = rows.count()
    number = F.greatest(F.floor(F.sqrt(F.count("*") / BLOCK)), F.floor(F.sum("thousands") / BLOCK_THOUSANDS))
    blocks = shared.write(rows.groupBy("key").agg(F.count("*").alias("members"), (1 + number).alias("blocks")), "blocks", total)
    rows = with_facts(rows.drop("thousands"), blocks, ["key"], "members", total)
    home = F.pmod(F.xxhash64("id"), F.col("blocks"))
    there = F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(home))
    rows = rows.select("key", "id", "component", "asks", home.alias("home"), F.explode(there).alias("block"))
    return rows.select("key", "block", (F.col("block") != F.col("home")).alias("visits"), "id", "component", "asks")


def cut_blocks(likely: DataFrame, shared: Shared) -> DataFrame:
    """A table of ``_surviving``'s rows, with blocks cut whose texts at home are too many to be held: what is at home stays in one part, what asks visits the others."""
    home = F.sum(F.when(~F.col("visits"), F.col("thousands")))
    total = likely.count()
    heavy = likely.groupBy("key", "block").agg(home.alias("held"), F.count("*").alias("members")).where(F.col("held") >= BLOCK_THOUSANDS)
    heavy = shared.write(heavy.select("key", "block", "members", (1 + F.floor(F.col("held") / BLOCK_THOUSANDS)).alias("parts")), "heavy", total)
    if heavy.isEmpty():
        return likely
    rows = with_facts(likely, heavy, ["key", "block"], "members", total).withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))  # another hash than that of blocks
    there = F.when(F.col("asks"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(own))
    rows = rows.withColumn("own", own).withColumn("part", F.explode(there))
    moved = {"visits": F.col("visits") | (F.col("part") != F.col("own")), "block": F.col("block") + F.col("part") * (1 << 32)}
    return rows.withColumns(moved).select(*likely.columns)


def linked_components(multi: DataFrame, describe: Callable[[DataFrame], DataFrame], how: Similarity, shared: Shared, given: DataFrame | None = None) -> DataFrame:
    """(id, component) of all ids that are linked with another, but the components' smallest.

    ``multi``: a table of ``buckets``' rows. ``describe``: takes the ids (id) that matter, and gives id, sig
    (binary of one width), keys (its key of each band, 8 bytes each) and text of each. ``given``: links (a, b) that hold anyhow.
    """
    spark = multi.sparkSession
    most = multi.count()
    items = describe(shared.write(multi.select("id").distinct(), "ids", most))  # a table, so that a small one is broadcast
    items = shared.write(items.select("id", "sig", "keys", "text"), "items")
    signed = items.drop("keys")
    pairs = multi.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    pairs = pairs.join(signed.toDF("b", "sig_b", "text_b"), "b").join(signed.toDF("a", "sig_a", "text_a"), "a")
    links = pairs.mapInArrow(lambda it: _confirm(it, how), "a long, b long")
    links = shared.write(links if given is None else links.unionByName(given), "links")
    stars = components(links, shared, "stars")
    shared.drop("links")

    wide = multi.join(stars, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    wide = shared.write(wide, "wide")
    mixed = wide.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
    mixed = shared.write(mixed.where("lo <> hi AND members > 2").select("key", "members"), "mixed", most)  # of a bucket of two, the one pair has been looked at
    if mixed.isEmpty():
        return stars
    rows = with_facts(wide, mixed, ["key"], "members", wide.count()).where("members IS NOT NULL")
    rows = shared.write(rows.select("key", "id", "component"), "mixed-members")
    shared.drop("wide")
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = shared.write(sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("members")), "largest", most)
    rows = with_facts(rows, largest, ["key"], "members", rows.count())
    rows = rows.select("key", "id", "component", (F.col("component") != F.col("largest")).alias("asks"))
    order = ("key", "block", "visits", "id")
    many = partitions(spark)
    thousands = (F.length("text") / 1000).alias("thousands")
    width, text = items.agg(F.max(F.length("sig") + F.length("keys")), F.avg(F.length("text"))).first()
    if text <= width:  # texts that are no longer than signatures go with them
        rows = shared.write(rows.join(items.select("id", thousands), "id"), "mixed-rows")
        told = in_blocks(rows, shared).join(items, "id")
    else:
        rows = shared.write(rows.withColumn("thousands", F.lit(0.0)), "mixed-rows")  # only the likely get texts
        signed = in_blocks(rows, shared).join(items.select("id", "sig", "keys", thousands), "id").repartition(many, "key", "block").sortWithinPartitions(*order)
        likely = signed.mapInArrow(lambda it: _surviving(it, how), "key long, block long, visits boolean, id long, component long, asks boolean, sig binary, keys binary, thousands double")
        told = cut_blocks(shared.write(likely, "likely"), shared).drop("thousands").join(items.select("id", "text"), "id")
    told = told.repartition(many, "key", "block").sortWithinPartitions(*order)
    more = shared.write(told.mapInArrow(lambda it: _linking(it, how), "a long, b long"), "more-links")
    shared.drop("mixed-members", "mixed-rows", "largest", "blocks", "likely", "heavy")
    if more.isEmpty():
        return stars
    return components(shared.write(stars.toDF("a", "b").unionByName(more), "all-links"), shared, "all-stars")
