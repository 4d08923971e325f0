"""Near-duplicate documents by MinHash.

A document's set holds the distinct ``shingle``-word runs of its lower-cased words. Sets
that are equal are one class, found by a digest of the whole set. Of each class's set
``bands`` x ``rows`` universal hash minima are taken; bands of them meet as keys, one byte
of each minimum is the signature that rules pairs out, and pairs that pass are confirmed
on full sets. Components of the links come from alternating large-star and small-star.

Cases: a null or blank text has an empty set and is linked with nothing, so its row
stays; with fewer words than ``shingle`` the whole sequence is the one shingle. Repeated
rows and ties fall into one class. Rows that repeat an id with other texts are one
document: what any of them is like is one component, and they stand or fall together. A
null id is linked by its text and joins what it is like, but is no document's name and
never the same as another null: such a row goes if its component has a document with an
id (whose least id stays), else it stays, with a null component. Very long texts are
taken whole. Extra columns are kept by ``drop_near_duplicates`` and ignored by
``near_duplicates``, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentide.llm.neighbours import BAND_BITS, Dealer, Similarity, buckets, least_equal, linked_components, part_count
from lumentide.llm.shared import Shared, free, sized, with_facts
from lumentide.llm.textio import Words, binary_rows, blocks, distinct_by_row, mix, ngram_hashes, place_of


@dataclass(frozen=True)
class NearDup:
    """A link has 100 * |intersection| >= ``percent`` * |union|. ``sketch`` minima make the signature, the first of them the bands. 32 bands of 5 miss a pair at 0.8 with a chance of 3 in a million."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    seed: int = 11
    sketch: int = 256

    @property
    def least(self) -> int:
        return least_equal(self.sketch, self.percent)


def shingle_sets(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of 57 bits of all documents in a row, and the bounds of each."""
    w = Words(texts, lower=True)
    words, counts = w.hashes(), w.counts
    grams = ngram_hashes(words, size)
    # of a document with fewer words than a shingle all words are one
    sizes = np.where(counts >= size, counts - size + 1, counts > 0)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(int(bounds[-1])) + np.repeat(w.bounds[:-1] - bounds[:-1], sizes)
    values = grams[np.minimum(at, max(len(grams) - 1, 0))] if len(grams) else np.zeros(len(at), np.uint64)
    for i in np.flatnonzero((counts > 0) & (counts < size)).tolist():
        values[bounds[i]] = ngram_hashes(words[w.bounds[i] : w.bounds[i + 1]], int(counts[i]))[0]
    some = sizes > 0
    sets, ends = distinct_by_row(values, sizes[some])
    out = np.zeros(len(texts) + 1, np.int64)
    out[1:][some] = ends[1:]
    return sets, np.maximum.accumulate(out)


def minima(values: np.ndarray, bounds: np.ndarray, count: int, seed: int) -> np.ndarray:
    """``count`` multiply-add minima of each non-empty set, one row for each hash function. Values: well mixed, 32 or 64 bits."""
    rng = np.random.Generator(np.random.PCG64(seed))
    bits = values.dtype.itemsize * 8 - 1
    draws = rng.integers(0, 1 << bits, (count, 2), dtype=np.uint64)  # the first functions are the same for any count
    factors, terms = (draws[:, 0] * np.uint64(2) + np.uint64(1)).astype(values.dtype), draws[:, 1].astype(values.dtype)
    starts = bounds[:-1][np.diff(bounds) > 0]
    out, work = np.empty((count, len(starts)), values.dtype), np.empty_like(values)
    for j in range(count):
        np.multiply(values, factors[j], out=work)
        work += terms[j]
        out[j] = np.minimum.reduceat(work, starts)
    return out


def band_keys(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each set (row) and band (column); its low bits are the band, the one above is unset."""
    if bands > 1 << BAND_BITS:
        raise ValueError(f"at most {1 << BAND_BITS} bands")
    keys = np.empty((mins.shape[1], bands), np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for band in range(bands):
        key = np.full(mins.shape[1], ((band + 1) * int(factor)) & ((1 << 64) - 1), np.uint64)
        for row in mins[band * rows : (band + 1) * rows]:
            key = mix(key * factor + row)
        keys[:, band] = (key >> np.uint64(BAND_BITS + 1) << np.uint64(BAND_BITS + 1)) + np.uint64(band)
    return keys


def _signed(batches: Iterator[pa.RecordBatch], settings: NearDup) -> Iterator[pa.RecordBatch]:
    """Input: id, t, text. One numbered row for each text: the size and a digest of its set, its band keys and its signature; the last two are null for an empty set."""
    row = TaskContext.get().partitionId() << 40
    for part, texts in blocks(batches):
        values, bounds = shingle_sets(texts, settings.shingle)
        sizes = np.diff(bounds)
        full = sizes > 0
        digests = np.zeros((2, len(texts)), np.uint64)
        keys, sigs = np.zeros((len(texts), settings.bands), np.uint64), np.zeros((len(texts), settings.sketch), np.uint8)
        if full.any():
            starts = bounds[:-1][full]
            digests[0, full] = np.add.reduceat(values, starts)
            digests[1, full] = np.add.reduceat(mix(values), starts)
            mins = minima(values, bounds, settings.sketch, settings.seed)
            keys[full] = band_keys(mins, settings.bands, settings.rows)
            sigs[full] = (mix(mins.ravel()).reshape(mins.shape) >> np.uint64(56)).astype(np.uint8).T
        numbers = pa.array(row + np.arange(len(texts)))
        row += len(texts)
        columns = [numbers, part.column(0), part.column(1), pa.array(sizes), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), binary_rows(keys), binary_rows(sigs)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "id", "t", "n", "d1", "d2", "keys", "sig"])


def _dealt(batches: Iterator[pa.RecordBatch], parts: int, bands: int) -> Iterator[pa.RecordBatch]:
    dealer = Dealer(parts)
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        yield from dealer.add(keys, np.repeat(batch.column(0).to_numpy(), bands))
    yield from dealer.dealt()


_CLASS = ["d1", "d2", "n"]


def _components(docs: DataFrame, settings: NearDup, id_col: str, text_col: str) -> DataFrame:
    """(id, t, n, component) of each row; t is the place of its text, as of ``place_of``."""
    spark, shared = docs.sparkSession, Shared(docs.sparkSession, "neardup")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), place_of(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    signed = plain.mapInArrow(lambda it: _signed(it, settings), "row long, id long, t long, n long, d1 long, d2 long, keys binary, sig binary")
    signed = shared.write(signed, "signed")
    rows = signed.count()
    full = signed.where("n > 0")
    # a class is named by its first row
    classes = full.groupBy(*_CLASS).agg(F.min("row").alias("class"), F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = shared.write(classes, "classes", rows)
    own = full.join(classes.select(F.col("class").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), F.col("id").alias("doc"), "t", "keys", "sig")
    own = shared.write(own, "own", 10 * rows)  # a row has keys and a signature

    # ids that several classes have link these
    several = full.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(*_CLASS)).alias("lo"), F.max(F.struct(*_CLASS)).alias("hi"), F.count("*").alias("copies")).where("lo <> hi")
    several = shared.write(several.select("id", "copies"), "several", rows)
    given = None
    if not several.isEmpty():
        repeated = with_facts(full.select("id", *_CLASS), several, ["id"], "copies", rows).where("copies IS NOT NULL").select("id", *_CLASS).distinct()
        repeated = shared.write(repeated.join(classes.select(*_CLASS, "class"), _CLASS).select("id", "class"), "repeated")
        given = repeated.join(repeated.groupBy("id").agg(F.min("class").alias("a")), "id").select("a", F.col("class").alias("b"))

    parts = part_count(spark)
    dealt = own.select("id", "keys").mapInArrow(lambda it: _dealt(it, parts, settings.bands), "part long, data binary")
    many = sized(spark, rows, 50_000)

    def describe(ids: DataFrame) -> DataFrame:
        wanted = own.join(ids, "id").withColumn("doc", known(F.col("doc"))).repartition(many, "doc", "t")
        texts = plain.select(known(F.col("id")).alias("doc"), "t", "text").repartition(many, "doc", "t")
        return wanted.join(texts, ["doc", "t"]).dropDuplicates(["doc", "t"])

    how = Similarity(lambda texts: shingle_sets(texts, settings.shingle), settings.percent, settings.least)
    stars = linked_components(shared.write(buckets(dealt, parts), "buckets"), describe, how, shared, given)
    named = classes.join(stars.withColumnRenamed("id", "class"), "class", "left").select(*_CLASS, "least", "copies", F.coalesce("component", "class").alias("root"))
    named = shared.write(named, "named", rows)
    names = named.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("classes"))
    facts = with_facts(named, names, ["root"], "classes", rows).select(*_CLASS, "copies", "component")
    facts = shared.write(facts, "facts", rows)
    shared.keep("signed", "facts")
    told = with_facts(signed.select("id", "t", *_CLASS), facts, _CLASS, "copies", rows)
    return told.select("id", "t", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def known(c: Column) -> Column:
    """An id that is never null, for joins."""
    return F.coalesce(c.cast("long"), F.lit(-(1 << 63)))


def near_duplicates(docs: DataFrame, settings: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component (smallest id reachable), kept. Ids are integers."""
    told = _components(docs, settings, id_col, text_col)
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component", F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, settings: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the smallest of their component, with all their columns."""
    told = _components(docs, settings, id_col, text_col)
    a, b = free("gone_id", docs.columns), free("gone_t", docs.columns)
    gone = told.where(~F.col("id").eqNullSafe(F.col("component"))).select(known(F.col("id")).alias(a), F.col("t").alias(b)).distinct()
    return docs.join(gone, (known(F.col(id_col)) == F.col(a)) & (place_of(F.col(text_col)) == F.col(b)), "left_anti")
