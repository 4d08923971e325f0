"""Fuzzy line de-duplication by MinHash over character shingles.

A line is looked at lower-cased and without white space at its ends. Its id is a 64-bit
hash of that content, so equal lines are one item without a shuffle of texts; a second
hash guards removal, so a line that only shares another's id stays. Signatures of
``bands`` x ``rows`` minima over its character shingles meet by band, candidate pairs
are confirmed by exact Jaccard of their shingle sets, and distributed components (large-
star and small-star) join them. Of each component the line that comes first, by document
id and then line number, stays.

Cases: null texts have no lines and stay null; blank lines are never removed and link
with nothing. Lines shorter than a shingle are one shingle. A row is known by its id and
a hash of its text: rows that repeat an id with other texts lose lines each for itself,
in the order of that hash; repeated rows (one id, one text) are one document, so the
first line stays in each of them. A null id comes before all others. Very long lines
and texts are taken whole. Extra columns stay as they are, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentide.llm.neardup import band_keys, known, minima
from lumentide.llm.neighbours import SPREAD, Buckets, Dealer, Similarity, least_equal, linked_components, met, packed, part_count
from lumentide.llm.shared import Shared, free, sized, with_facts
from lumentide.llm.textio import binary_rows, blocks, distinct_by_row, mix, place_of, power_tables

_CODES = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


@dataclass(frozen=True)
class LineDup:
    """``sketch`` minima make the signature, the first of them the bands. 16 bands of 4 find a pair at 0.8 with a chance of 0.9998, one at 0.9 always but for one in 10**7."""

    shingle: int = 8
    percent: int = 80
    bands: int = 16
    rows: int = 4
    seed: int = 29
    sketch: int = 256

    @property
    def least(self) -> int:
        return least_equal(self.sketch, self.percent)


def split_lines(text: str) -> list[str]:
    """The lines as they are compared, blank ones empty."""
    return [line.strip() for line in text.lower().split("\n")]


class LineHashes:
    """Content ids and shingle hashes of lines none of which is empty."""

    def __init__(self, lines: list[str], size: int):
        codes = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        powers, inverse = power_tables(len(codes) + 1)
        x = _CODES[np.minimum(codes, 0xFFFF)]
        if (wide := codes > 0xFFFF).any():
            x[wide] = mix(codes[wide].astype(np.uint64) + np.uint64(1))
        x *= powers[: len(x)]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        self.ids = mix((total[ends] - total[starts]) * inverse[starts] + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        #: shingles of each line; a line shorter than a shingle is one
        self.counts = np.maximum(sizes - size + 1, 1)
        self.bounds = np.concatenate(([0], np.cumsum(self.counts)))
        # hashes of the runs at all places of the text, of which those within a line are shingles
        runs = total[size:] - total[:-size] if len(total) > size else total[:0]
        runs *= inverse[: len(runs)]
        at = np.arange(int(self.bounds[-1])) + np.repeat(starts - self.bounds[:-1], self.counts)
        values = runs[np.minimum(at, max(len(runs) - 1, 0))] if len(runs) else np.zeros(len(at), np.uint64)
        short = np.flatnonzero(sizes < size)
        values[self.bounds[short]] = (total[ends[short]] - total[starts[short]]) * inverse[starts[short]]
        self.shingles = mix(values)

    @property
    def guards(self) -> np.ndarray:
        """A second hash of each content: of its shingles, whatever their order."""
        return mix(np.add.reduceat(self.shingles, self.bounds[:-1])).view(np.int64)

    def minima(self, count: int, seed: int) -> np.ndarray:
        return minima((self.shingles >> np.uint64(32)).astype(np.uint32), self.bounds, count, seed)


#: characters that are hashed at once, so that all arrays of a pass stay in a core's own cache; a longer line is a pass of its own
_STRETCH = 1 << 16


def hashed(lines: list[str], size: int) -> Iterator[LineHashes]:
    """Hashes of all lines in their order, some ``_STRETCH`` characters of them at once."""
    begin = held = 0
    for k, line in enumerate(lines):
        if k > begin and held + len(line) > _STRETCH:
            yield LineHashes(lines[begin:k], size)
            begin, held = k, 0
        held += len(line) + 1
    if len(lines) > begin:
        yield LineHashes(lines[begin:], size)


#: lines that a task holds before it deals their places
_LINES_AT_ONCE = 1 << 17


def _read(batches: Iterator[pa.RecordBatch], s: LineDup, parts: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of ``Dealer`` for the line contents; behind 2 * ``parts`` (id, document, place, line, guard) of each line that isn't blank; behind 3 * ``parts`` the same of the task's first line of each content, and how many it has."""
    dealer, held, size = Dealer(parts), [], 0

    def placed() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        # dealt by document: a line that a third of all documents have may not meet in one task
        with np.errstate(over="ignore"):
            yield packed((columns[1] + columns[2]) * SPREAD, columns, parts, 2 * parts)
        first = _first_lines([*columns, np.ones(len(columns[0]), np.int64)])
        yield packed(first[0], first, parts, 3 * parts)

    for part, texts in blocks(batches):
        docs, places, names, which, doc, number = part.column(0).to_numpy(), part.column(1).to_numpy(), {}, [], [], []
        for i, t in enumerate(texts):
            for k, line in enumerate(split_lines(t.decode()) if t else ()):
                if line:
                    which.append(names.setdefault(line, len(names)))
                    doc.append(i)
                    number.append(k)
        if not names:
            continue
        own = [(h.ids, h.guards, h.minima(s.bands * s.rows, s.seed)) for h in hashed(list(names), s.shingle)]
        ids, guards, mins = (np.concatenate(c, axis=-1) for c in zip(*own, strict=True))
        keys = band_keys(mins, s.bands, s.rows)
        yield from dealer.add(keys.ravel().view(np.int64), np.repeat(ids, s.bands))
        which, doc = np.array(which), np.array(doc)
        held.append([ids[which], docs[doc], places[doc], np.array(number, np.int64), guards[which]])
        size += len(which)
        if size >= _LINES_AT_ONCE:
            yield from placed()
            held, size = [], 0
    if held:
        yield from placed()
    yield from dealer.dealt()


def _first_lines(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Of rows (id, document, place, line, guard, lines) each id's first, with the sum of lines."""
    order = np.argsort(columns[0])
    ids = columns[0][order]
    same = ids[1:] == ids[:-1]
    if (many := np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))).size:  # most are alone
        own = order[many]
        order[many] = own[np.lexsort([c[own] for c in columns[3::-1]])]
    heads = np.flatnonzero(np.concatenate(([True], ~same)))
    return [*(c[order[heads]] for c in columns[:5]), np.add.reduceat(columns[5][order], heads)]


_COLUMNS = ["kind", *"abcdef"]


def _kind(kind: int, columns: list) -> pa.RecordBatch:
    size = len(columns[0])
    fill = [pa.array(np.zeros(size, np.int64))] * (len(_COLUMNS) - 1 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int64)), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns), *fill], _COLUMNS)


class _Firsts:
    """First lines of one part, of ids that have several; between pieces only each id's first is kept."""

    def __init__(self):
        self.held = None

    def feed(self, table: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
        if not table.shape[1] and self.held is None:
            return
        columns = list(table) if self.held is None else [np.concatenate(c) for c in zip(self.held, table, strict=True)]
        self.held = _first_lines(columns)
        if last:
            several = self.held[5] > 1
            yield _kind(2, [c[several] for c in self.held])


def _sorted_out(part: int, parts: int) -> Callable[[np.ndarray, bool], Iterator[pa.RecordBatch]]:
    """Rows of kind 0 (key, id, pivot), 1 (id, document, place, line, guard) and 2 (the same of the first line of an id that has several, and how many)."""
    if part < parts:
        pivots = Buckets()
        return lambda table, last: (_kind(0, b.columns) for b in pivots.feed(table, last))
    if part >= 3 * parts:
        return _Firsts().feed
    return lambda table, last: iter([_kind(int(part >= 2 * parts), list(table))] if table.shape[1] else [])


_WIDTHS = (2, 3, 5, 6)


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, line) of the numbered lines of each document. Input: doc, t, text, wanted (array of line, id); repeated rows are in one task, and the first of them is enough."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        ids, lines, at = [], [], 0
        wanted = batch.column(3)
        number, name = (wanted.flatten().field(c).to_pylist() for c in ("line", "id"))
        for doc, t, text, n in zip(*(batch.column(c).to_pylist() for c in range(3)), pc.list_value_length(wanted).to_pylist(), strict=True):
            at += n
            if (doc, t) in seen:
                continue
            seen.add((doc, t))
            own = split_lines(text)
            ids += name[at - n : at]
            lines += [own[k] for k in number[at - n : at]]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], ["id", "line"])


def _signed(batches: Iterator[pa.RecordBatch], s: LineDup) -> Iterator[pa.RecordBatch]:
    for part, lines in blocks(batches, "line"):
        own = []
        for h in hashed([x.decode() for x in lines], s.shingle):
            mins = h.minima(s.sketch, s.seed)
            own.append((mins[: s.bands * s.rows], (mix(mins.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)))
        mins, sigs = (np.concatenate(c, axis=1) for c in zip(*own, strict=True))
        keys = band_keys(mins, s.bands, s.rows)
        names = part.schema.get_field_index
        yield pa.RecordBatch.from_arrays([part.column(names("id")), binary_rows(keys), binary_rows(sigs.T), part.column(names("line"))], ["id", "keys", "sig", "text"])


def line_sets(lines: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all lines in a row, and the bounds of each."""
    h = LineHashes([x.decode() for x in lines], size)
    return distinct_by_row(h.shingles, h.counts)


#: lines of which the texts go through one task of a join
_LINES_A_PART = 500_000


def removed_lines(docs: DataFrame, settings: LineDup = LineDup(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(doc, t, lines): for each document that loses lines, their numbers from 0, ascending, by its id and text's place; and how many parts a join with the texts should have."""
    spark, shared, parts = docs.sparkSession, Shared(docs.sparkSession, "lines"), part_count(docs.sparkSession)
    plain = docs.select(known(F.col(id_col)).alias("doc"), place_of(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    read = plain.mapInArrow(lambda it: _read(it, settings, parts), "part long, data binary")
    both = met(read, lambda part: _WIDTHS[part // parts], lambda part: _sorted_out(part, parts), ", ".join(f"{c} long" for c in _COLUMNS))
    both = shared.write(both, "lines")
    multi = both.where("kind = 0").selectExpr("a AS key", "b AS id", "c AS pivot")
    listed = both.where("kind = 1").selectExpr("a AS id", "b AS doc", "c AS t", "d AS line", "e AS guard")
    several = both.where("kind = 2").selectExpr("a AS id", "b AS doc", "c AS t", "d AS line", "e AS guard", "f AS n")
    lines = listed.count()
    many = sized(spark, lines, _LINES_A_PART)

    places: list[DataFrame] = []

    def describe(ids: DataFrame) -> DataFrame:
        # the guard that counts for an id is that of its first line
        first = F.min(F.struct("doc", "t", "line", "guard")).alias("first")
        places.append(shared.write(listed.join(ids, "id", "left_semi").groupBy("id").agg(first, F.count("*").alias("n")).select("id", "first.*", "n"), "placed", lines))
        wanted = places[0].select("doc", "t", F.struct("line", "id").alias("want")).groupBy("doc", "t").agg(F.collect_list("want").alias("wanted"))
        # by hash, so that texts needn't be sorted; the other side has a short row for a document at most
        rows = plain.repartition(many, "doc", "t").join(wanted.repartition(many, "doc", "t").hint("shuffle_hash"), ["doc", "t"]).select("doc", "t", "text", "wanted")
        return rows.mapInArrow(lambda it: _signed(_picked(it), settings), "id long, keys binary, sig binary, text string")

    how = Similarity(lambda lines: line_sets(lines, settings.shingle), settings.percent, settings.least)
    stars = linked_components(multi, describe, how, shared)
    stars = shared.write(stars.unionByName(stars.selectExpr("component AS id", "component").distinct()), "linked", lines)
    # lines that occur once and are like no other stay out of all that follows
    known_lines = several.join(stars, "id", "left").unionByName(places[0].where("n = 1").join(stars, "id"))
    rooted = known_lines.select("id", "guard", F.coalesce("component", "id").alias("root"), F.struct("doc", "t", "line").alias("first"), "n")
    rooted = shared.write(rooted, "rooted", lines)
    shared.keep("lines", "rooted")
    groups = rooted.groupBy("root").agg(F.min("first").alias("keeper"), F.sum("n").alias("total"), F.count("*").alias("ids")).where("total > 1")
    keepers = with_facts(rooted.drop("first"), groups, ["root"], "ids", rooted.count()).where("keeper IS NOT NULL")
    keepers = shared.write(keepers.select("id", F.col("guard").alias("own"), "keeper", "n"), "keepers", lines)
    shared.keep("lines", "keepers")
    gone = with_facts(listed, keepers, ["id"], "n", lines).where("keeper IS NOT NULL AND guard = own AND NOT (doc = keeper.doc AND t = keeper.t AND line = keeper.line)")
    return gone.groupBy("doc", "t").agg(F.array_sort(F.collect_set(F.col("line").cast("int"))).alias("lines")), many


def dedup_lines(docs: DataFrame, settings: LineDup = LineDup(), id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents with all their columns, their texts without the removed lines. ``count_col``: name of a further column, of lines removed."""
    gone, many = removed_lines(docs, settings, id_col, text_col)
    doc, t, lines = (free(c, docs.columns) for c in ("line_doc", "line_place", "line_numbers"))
    keyed = docs.withColumns({doc: known(F.col(id_col)), t: place_of(F.col(text_col))}).repartition(many, doc, t)
    joined = keyed.join(gone.toDF(doc, t, lines).repartition(many, doc, t).hint("shuffle_hash"), [doc, t], "left")
    # line numbers are those of the text split at each newline, which JVM functions do alike; within ``transform`` it is split once
    stay = lambda own: F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(lines))
    left = F.transform(F.array(F.split(F.col(text_col), "\n", -1)), lambda own: F.array_join(F.transform(stay(own), lambda k: F.get(own, k)), "\n"))
    text = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.element_at(left, 1))
    extra = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(count_col)] if count_col else []
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], *extra)
