"""Quality rules by repetition, read off suffix arrays.

The words of many documents are sorted as suffixes in one array, each word told apart by its
document, so that intervals of common prefixes never leave a document. Prefix doubling
keeps the ranks of each power of two; common prefixes of neighbours follow from those
ranks by binary lifting. A suffix that shares at least ``min_repeat`` words with a
neighbour starts a repeated substring; the union of these spans is limited to a share of
the words, and the longest of them, which says how much was pasted twice, to ``max_longest``
words whatever the text's length.

Cases: a null, empty or blank text has no words, fails the base rule and is not kept.
A text of one word repeated is one overlapping repeat and is rejected. Equal rows are
judged alike, each by itself. Extra columns of the input stay where the operator
returns documents, and are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumentide.llm.textio import Words, blocks, inside, mix, ngram_hashes

_SYMBOLS = [c.encode() for c in "#*$%&|<>"]
_SPACES = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"]

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long, base_failed boolean, kept boolean"


@dataclass(frozen=True)
class QualityRules:
    """Limits. ``min_repeat``: words from which a repeated substring counts."""

    min_words: int = 50
    max_window_repeat: float = 0.5
    min_repeat: int = 10
    max_covered: float = 0.4
    max_longest: int = 200


def suffix_repeats(words: np.ndarray, bounds: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: words covered by repeated substrings of ``min_repeat`` words or more, and the words of the longest repeat."""
    docs, n = len(bounds) - 1, len(words)
    covered, longest = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    if not n:
        return covered, longest
    owner = np.repeat(np.arange(docs, dtype=np.int64), np.diff(bounds))
    ends = np.repeat(bounds[1:], np.diff(bounds))
    # a suffix's first rank is by its document and first word; equal words of two documents differ here, so no interval leaves a document
    key = mix(words + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order, rank = np.argsort(key), np.empty(n, np.int64)
    new = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    ranks, width = [rank], 1
    while True:
        # suffixes whose rank is shared are the only ones still to be told apart
        tied = ~(new & np.concatenate((new[1:], [True])))
        if not tied.any():
            break
        at = order[tied]
        after = np.where(at + width < ends[at], rank[np.minimum(at + width, n - 1)], -1)
        inner = np.lexsort((after, rank[at]))
        order[tied] = at = at[inner]
        after = after[inner]
        old = rank[at]
        fresh = np.concatenate(([True], (old[1:] != old[:-1]) | (after[1:] != after[:-1])))
        slots = np.flatnonzero(tied)
        rank = rank.copy()
        rank[at] = slots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        new = new.copy()
        new[slots] = fresh
        ranks.append(rank)
        width *= 2
    # common prefix of neighbours in the suffix array, by binary lifting over the ranks
    a, b = order[:-1], order[1:]
    same = owner[a] == owner[b]
    slots = np.flatnonzero(same & (ranks[0][a] == ranks[0][b]))
    a, b = a[slots], b[slots]
    lcp = np.zeros(len(slots), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        ok = (x < ends[a]) & (y < ends[b])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        # equal ranks at a level mean 2**level equal words, or the same shorter rest, which two suffixes of a document can't share
        ok &= (ranks[level][x] == ranks[level][y]) & (x + (1 << level) <= ends[a]) & (y + (1 << level) <= ends[b])
        lcp += ok * np.int64(1 << level)
    longest_at = np.zeros(n, np.int64)
    np.maximum.at(longest_at, a, lcp)
    np.maximum.at(longest_at, b, lcp)
    at = np.flatnonzero(longest_at >= min_repeat)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + longest_at[at], -1)
    covered += np.add.reduceat(np.concatenate((np.cumsum(cover[:n]) > 0, [False])).astype(np.int64), bounds[:-1]) * (np.diff(bounds) > 0)
    np.maximum.at(longest, owner[at], longest_at[at])
    return covered, longest


def window_repeats(words: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Words of each document in windows of ``size`` words that it holds twice or more."""
    docs, n = len(bounds) - 1, len(words)
    starts = inside(bounds, size, n)
    cover = np.zeros(n + 1, np.int64)
    if len(starts):
        owner = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(bounds))[starts]
        key = ngram_hashes(words, size)[starts] + owner * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key)
        equal = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(starts), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        np.add.at(cover, starts[twice], 1)
        np.add.at(cover, starts[twice] + size, -1)
    return np.add.reduceat(np.concatenate((np.cumsum(cover[:n]) > 0, [False])).astype(np.int64), bounds[:-1]) * (np.diff(bounds) > 0)


def _dup_lines(text: bytes) -> int:
    seen, dups = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dups += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    return dups


def _chars(text: bytes) -> int:
    return len(text) if text.isascii() else len(text.decode())


def measure(texts: list[bytes | None], rules: QualityRules) -> dict[str, np.ndarray]:
    words = Words(texts)
    hashes, n = words.hashes(), words.counts
    full = [t or b"" for t in texts]
    long = lambda values: np.fromiter(values, np.int64, len(texts))
    repeat = window_repeats(hashes, words.bounds, 3)
    covered, longest = suffix_repeats(hashes, words.bounds, rules.min_repeat)
    failed = (n < rules.min_words) | (repeat > rules.max_window_repeat * n)
    return {
        "n_words": n,
        "word_chars": long(_chars(t) - sum(t.count(c) for c in _SPACES) for t in full),
        "n_symbols": long(sum(t.count(c) for c in _SYMBOLS) for t in full),
        "n_dup_lines": long(map(_dup_lines, full)),
        "n_repeat_words": repeat,
        "n_covered": covered,
        "longest_repeat": longest,
        "base_failed": failed,
        "kept": ~failed & (covered <= rules.max_covered * n) & (longest <= rules.max_longest),
    }


def quality_measures(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id, the measures and the verdict ``kept``. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            yield pa.RecordBatch.from_pydict({"id": part.column(0), **{k: pa.array(v) for k, v in measure(texts, rules).items()}})

    ids = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {ids}, {MEASURES}").withColumnRenamed("id", id_col)


def quality_filter(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text") -> DataFrame:
    """The documents that all rules keep, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, f"c{at}"):
            yield part.filter(pa.array(measure(texts, rules)["kept"]))

    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema))
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).mapInArrow(run, kinds).toDF(*docs.columns)
