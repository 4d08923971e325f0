"""Benchmark decontamination by the CGK embedding.

The embedding walks over a word sequence: at step j it writes the word it stands on and
moves on by a random bit of (j, word). Two sequences of small edit distance fall into step
again after each edit, so their walks differ in few places, and sampling a few steps is a
locality-sensitive hash for edit distance. As walks drift apart with the number of edits,
items are cut into so many pieces that one of them has at most ``piece_edits`` edits
wherever the edits of a match are. Pieces and piece-sized windows are embedded with the
same bits, several times over; where a window agrees with a piece in any sample, the
text about it is aligned with the whole item and kept if the word edit distance is within
``max_rate`` of the item's words.

Windows are embedded only where such a piece can begin: each edit breaks at most two
pairs of neighbouring words, so a window with fewer of the items' pairs than a piece of
its class must keep can't match, nor can a text with fewer of an item's pairs than the
item must keep. These filters lose nothing.

Words are lower-case runs of ASCII letters and digits and of bytes outside ASCII.

Cases: items without a word match nothing; items of so few words that ``max_rate`` grants
no edit must occur word for word. Null and empty documents match nothing; windows never cross documents.
Very long documents are searched whole. Repeated rows are reported each; of several
places that match an item the closest, then the first, is reported. Items are sent to the executors
``items_at_once`` at a time, so what is broadcast is bounded. Extra columns are kept by
``decontaminate`` and ignored by ``find_leaks``. Empty tables give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumentide.llm.textio import Words, blocks, mix, ngram_hashes

_AS_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_PAD = np.uint64(0)
_NONE = np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Leaks:
    """``max_rate``: word edits to an item's words. ``walks`` x ``samples`` hashes of ``width`` steps find a piece of at most ``piece_edits`` edits with the recall that the tests measure."""

    max_rate: float = 0.2
    walks: int = 8
    samples: int = 6
    width: int = 3
    piece_edits: int = 2
    class_ratio: float = 1.15
    items_at_once: int = 20_000

    def edits(self, n: int) -> int:
        return int(self.max_rate * n)

    def pieces(self, n: int) -> int:
        return self.edits(n) // (self.piece_edits + 1) + 1


def match_words(texts: list[bytes | None]) -> Words:
    return Words([t.translate(_AS_SPACE) if t else t for t in texts], lower=True)


class _Class:
    """Pieces of about one length, with the keys of their embeddings. ``pieces``: their numbers; ``words`` and ``edits``: of all pieces."""

    def __init__(self, least: int, pieces: list[int], words: list[np.ndarray], edits: list[int], settings: Leaks, seed: int):
        self.pieces, self.least = np.array(pieces), least
        sizes = [len(words[i]) for i in pieces]
        self.window = max(len(words[i]) + edits[i] for i in pieces)
        self.pairs = least > 2
        self.needed = min(len(words[i]) - 1 - 2 * edits[i] if self.pairs else len(words[i]) for i in pieces)
        rng = np.random.Generator(np.random.PCG64(seed))
        self.steps = max(2 * least, 1)
        self.bits = rng.integers(0, 1 << 63, (settings.walks, self.steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # a sample is of the steps that lie within the shortest piece
        self.chosen = [[sorted(rng.choice(self.steps, min(settings.width, self.steps), replace=False).tolist()) for _ in range(settings.samples)] for _ in range(settings.walks)]
        self.factors = rng.integers(0, 1 << 63, self.steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        flat = np.concatenate([words[i] for i in pieces])
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        keys = self.embed(flat, bounds[:-1], bounds[1:])
        self.tables = []
        for column in keys:
            order = np.argsort(column, kind="stable")
            self.tables.append((column[order], self.pieces[order]))

    def embed(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sample keys of the sequences words[start:end], one row for each walk and sample."""
        out = np.zeros((len(self.chosen) * len(self.chosen[0]), len(starts)), np.uint64)
        padded = np.append(words, _PAD)
        for walk, chosen in enumerate(self.chosen):
            at = starts.copy()
            for j in range(max(map(max, chosen)) + 1):
                symbol = padded[np.minimum(at, ends)]  # behind the end both sequences differ anyhow
                for t, steps in enumerate(chosen):
                    if j in steps:
                        out[walk * len(chosen) + t] += symbol * self.factors[j]
                at += (symbol * self.bits[walk, j] >> np.uint64(63)).view(np.int64)
        return mix(out)

    def candidates(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a start, piece) pairs that agree in a sample."""
        found = []
        for (keys, pieces), column in zip(self.tables, self.embed(words, starts, ends), strict=True):
            lo, hi = np.searchsorted(keys, column, "left"), np.searchsorted(keys, column, "right")
            hit = np.flatnonzero(hi > lo)
            size = (hi - lo)[hit]
            who = np.repeat(hit, size)
            which = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            found.append((who, pieces[which]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class LeakIndex:
    """Bounded state that each worker holds: the items' pieces by length class, and all their pairs of words."""

    def __init__(self, texts: list[bytes | None], settings: Leaks):
        self.settings = settings
        w = match_words(texts)
        hashes = w.hashes()
        self.words = [hashes[b:e] for b, e in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)]
        pieces, edits, item, offset = [], [], [], []
        by_size: dict[tuple[bool, int], list[int]] = {}
        for i, x in enumerate(self.words):
            parts = settings.pieces(len(x))
            cuts = [len(x) * k // parts for k in range(parts + 1)]
            for begin, end in pairwise(cuts) if len(x) else ():
                by_size.setdefault((settings.edits(len(x)) > 0, end - begin), []).append(len(pieces))
                pieces.append(x[begin:end])
                edits.append(settings.edits(len(x)) // parts)
                item.append(i)
                offset.append(begin)
        self.item, self.offset = np.array(item, np.int64), np.array(offset, np.int64)
        self.classes, group = [], []
        for loose, n in sorted(by_size):
            if group and (n > group[0][1] * settings.class_ratio or group[0][0] != loose or n <= 3):
                self._close(group, by_size, pieces, edits)
                group = []
            group.append((loose, n))
        if group:
            self._close(group, by_size, pieces, edits)
        self.own_pairs = [ngram_hashes(x, 2) if len(x) > 2 else _NONE for x in self.words]
        self.pairs = np.unique(np.concatenate([_NONE, *self.own_pairs]))
        ones = [x for x in self.words if 0 < len(x) <= 2]
        self.ones = np.unique(np.concatenate(ones)) if ones else np.zeros(0, np.uint64)
        self.maps = [self._map(self.pairs), self._map(self.ones)]

    def _close(self, sizes: list[tuple[bool, int]], by_size: dict[tuple[bool, int], list[int]], pieces: list[np.ndarray], edits: list[int]) -> None:
        self.classes.append(_Class(sizes[0][1], [i for n in sizes for i in by_size[n]], pieces, edits, self.settings, 7919 + sizes[0][1]))

    @staticmethod
    def _map(keys: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[(keys >> np.uint64(44)).astype(np.int64)] = True
        return out

    def _known(self, values: np.ndarray, keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
        out = seen[(values >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(keys) and len(at):
            place = np.minimum(np.searchsorted(keys, values[at]), len(keys) - 1)
            out[at] = keys[place] == values[at]
        return out

    def search(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Columns: document, item, edits, first word, words. One row for each document and item that it holds."""
        w = match_words(texts)
        n = len(w)
        empty = [np.zeros(0, np.int64)] * 5
        if not n or not self.classes:
            return empty
        words, owner = w.hashes(), w.owner()
        ends = w.bounds[1:][owner]
        sums, of_pairs = {}, np.append(ngram_hashes(words, 2), _PAD)
        for pairs, keys, seen in ((True, self.pairs, self.maps[0]), (False, self.ones, self.maps[1])):
            values = of_pairs if pairs else words
            hit = self._known(values, keys, seen)
            if pairs:
                hit[ends[:n] - 1 == np.arange(n)] = False  # the pair would leave its document
            sums[pairs] = np.concatenate(([0], np.cumsum(hit))), hit.any()
        doc, item, start = [], [], []
        for c in self.classes:
            total, some = sums[c.pairs]
            if not some:
                continue
            stop = np.minimum(np.arange(n) + c.window - c.pairs, ends - c.pairs)
            starts = np.flatnonzero(total[np.maximum(stop, np.arange(n))] - total[:n] >= max(c.needed, 1))
            if not len(starts):
                continue
            who, which = c.candidates(words, starts, ends[starts])
            if len(who):
                doc.append(owner[starts[who]])
                item.append(self.item[which])
                start.append(starts[who] - self.offset[which])  # about where the item begins
        if not doc:
            return empty
        table = np.unique(np.stack([np.concatenate(doc), np.concatenate(item), np.concatenate(start)], 1), axis=0)
        # neighbouring starts of one item are one region
        sizes = np.array([len(x) for x in self.words])[table[:, 1]]
        fresh = np.concatenate(([True], (table[1:, :2] != table[:-1, :2]).any(1) | (table[1:, 2] - table[:-1, 2] > sizes[1:])))
        heads = np.flatnonzero(fresh)
        tails = np.append(heads[1:], len(table)) - 1
        rows = []
        for h, t in zip(heads.tolist(), tails.tolist(), strict=True):
            d, i = int(table[h, 0]), int(table[h, 1])
            pattern, most = self.words[i], self.settings.edits(len(self.words[i]))
            lo = max(int(w.bounds[d]), int(table[h, 2]) - len(pattern))
            hi = min(int(w.bounds[d + 1]), int(table[t, 2]) + 2 * len(pattern) + most)
            if len(pattern) > 2 and np.isin(of_pairs[lo : hi - 1], self.own_pairs[i]).sum() < len(pattern) - 1 - 2 * most:
                continue
            if np.isin(words[lo:hi], pattern).sum() < len(pattern) - most:
                continue  # each of an item's words that the run lacks is an edit
            edits, begin, end = best_match(pattern, words[lo:hi])
            if edits <= most:
                rows.append((d, i, edits, lo + begin - int(w.bounds[d]), end - begin))
        rows.sort()
        best = [r for k, r in enumerate(rows) if not k or r[:2] != rows[k - 1][:2]]
        return [np.array(c, np.int64) for c in zip(*best, strict=True)] if best else empty


def best_match(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``pattern`` to any run of ``text``, and that run; the first end, then the longest of equals."""
    m = len(text)
    cost, begin, j = np.zeros(m + 1, np.int64), np.arange(m + 1), np.arange(m + 1)
    big = np.int64(1 << 32)
    for i, p in enumerate(pattern, 1):
        # costs and begins in one number, so that the smaller begin wins among equal costs
        packed = cost * big + begin
        up = packed + big
        diagonal = packed[:-1] + np.where(text == p, 0, big)
        best = up.copy()
        best[0] = i * big
        np.minimum(best[1:], diagonal, out=best[1:])
        best = np.minimum.accumulate(best - j * big) + j * big
        cost, begin = best >> 32, best & (big - 1)
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def _chunks(benchmark: DataFrame, settings: Leaks, item_col: str, text_col: str) -> Iterator[tuple[list, list[bytes | None]]]:
    """The items in bounded parts, so that neither the driver nor a broadcast holds all of a large benchmark."""
    rows = benchmark.select(item_col, text_col).toLocalIterator()
    ids, texts = [], []
    for item, text in rows:
        ids.append(item)
        texts.append(text.encode() if text else None)
        if len(ids) == settings.items_at_once:
            yield ids, texts
            ids, texts = [], []
    if ids:
        yield ids, texts


_built: dict[int, LeakIndex] = {}


def _index(shared, settings: Leaks) -> LeakIndex:
    """The index of a broadcast list of texts, built once for each worker process."""
    if shared.id not in _built:
        _built.clear()
        _built[shared.id] = LeakIndex(shared.value, settings)
    return _built[shared.id]


class _Sent:
    """A broadcast with a name that is the same in all workers."""

    def __init__(self, spark, texts: list[bytes | None]):
        self.inner = spark.sparkContext.broadcast(texts)
        self.id = self.inner._jbroadcast.id()

    def __getstate__(self):
        return {"inner": self.inner, "id": self.id}

    @property
    def value(self):
        return self.inner.value


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Leaks = Leaks(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row for each document and benchmark item that it holds: id, item, edits, item_words, start_word, n_words. No shuffle."""
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, edits long, item_words long, start_word long, n_words long"
    plain = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    out = None
    for ids, texts in _chunks(benchmark, settings, item_col, "text"):
        sent, names = _Sent(docs.sparkSession, texts), ids

        def run(batches: Iterator[pa.RecordBatch], sent=sent, names=names) -> Iterator[pa.RecordBatch]:
            index, kind = _index(sent, settings), None
            sizes = np.array([len(x) for x in index.words], np.int64)
            for part, bodies in blocks(batches):
                doc, item, edits, start, n = index.search(bodies)
                kind = kind or (pa.int64() if all(isinstance(x, int) or x is None for x in names) else pa.string())
                columns = [part.column(0).take(pa.array(doc)), pa.array(names, kind).take(pa.array(item)), *(pa.array(x) for x in (edits, sizes[item] if len(item) else item, start, n))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "item", "edits", "item_words", "start_word", "n_words"])

        part = plain.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Leaks = Leaks(), text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. One pass over them for each bounded part of the benchmark."""
    at, names = docs.columns.index(text_col), docs.columns
    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema))
    for _, texts in _chunks(benchmark, settings, item_col, "text"):
        sent = _Sent(docs.sparkSession, texts)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = _index(sent, settings)
            for part, bodies in blocks(batches, f"c{at}"):
                clean = np.ones(len(bodies), bool)
                clean[index.search(bodies)[0]] = False
                yield part.filter(pa.array(clean))

        docs = docs.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, kinds).toDF(*names)
    return docs
