"""A hidden Markov language model: Baum-Welch over partitions, exact scores by the scaled forward recursion.

Words are counted over all training documents. The most frequent are symbols of their
own; all others share symbols by their ending and length, and within such a class a word
has its smoothed share of the class, with one slot for words never seen. Latent states
emit symbols, so the model is a proper distribution over texts of known and unknown
words, ended by one end token.

Baum-Welch starts from sticky random states. First rounds take one in ``start_share`` of
the training documents, chosen by a hash of id and content and of any length, so the
share grows with the corpus; then come rounds over every training document, ``rounds`` at
most, until one gains less than ``settled`` a token. In each round tasks add up expected
counts of whole documents, Spark sums them by symbol, and only sums as large as the model
come back. Of a document's forward variables one step in ``_STRIDE`` is held, and those
between are computed again on the way back, so a very long text needs little memory.

Sizes sent to executors are bounded by ``symbols`` and ``known_words``; counts of rarer words
meet their tokens in a join.

Cases: a null or empty text is its end token. A null id is never held out, and trains.
Repeated rows train and are scored each. With no training documents every word is
unknown. Very long texts are one sequence, whose steps follow each other in one task.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentide.llm.shared import Shared
from lumentide.llm.textio import Words, blocks, mix

#: distinct words that a task holds before it hands counts on
_WORDS_AT_ONCE = 1 << 19
#: steps of which forward variables are held at once
_STRIDE = 128
#: sequences that run side by side
_ABREAST = 1024
#: symbols whose class weights are looked up at once
_SYMBOLS_AT_ONCE = 1 << 19


@dataclass(frozen=True)
class Settings:
    states: int = 8
    symbols: int = 60_000
    classes: int = 2048
    known_words: int = 250_000
    start_share: int = 10
    start_rounds: int = 10
    rounds: int = 3
    settled: float = 0.002
    smoothing: float = 0.1
    prior: float = 4.0
    seed: int = 5


# words


def word_classes(w: Words, classes: int) -> np.ndarray:
    """A class for each word, by its last three bytes and its length."""
    buf, size = w.buf, w.ends - w.starts
    key = np.minimum(size, 14).astype(np.uint64) // np.uint64(3)
    for k in (1, 2, 3):
        key = key * np.uint64(257) + np.where(size >= k, buf[np.maximum(w.ends - k, 0)], 256).astype(np.uint64)
    return (mix(key * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(classes)).astype(np.int64)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    h, c, k = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return keys, np.bincount(inverse, weights=c, minlength=len(keys)).astype(np.int64), k[first]


def _count_rows(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows (h, c, class), words combined over much of the task before they leave it; of class -1 the number of texts."""
    parts, size, ends = [], 0, 0
    for _, texts in blocks(batches):
        w, ends = Words(texts, lower=True), ends + len(texts)
        keys, first, counts = np.unique(w.hashes(), return_index=True, return_counts=True)
        parts.append((keys, counts, word_classes(w, s.classes)[first]))
        size += len(keys)
        if size > _WORDS_AT_ONCE:
            parts = [_merged(parts)]
            size = len(parts[0][0])
            if size > _WORDS_AT_ONCE // 2:
                yield _count_batch(parts[0])
                parts, size = [], 0
    if parts:
        yield _count_batch(_merged(parts))
    if ends:
        yield _count_batch((np.zeros(1, np.uint64), np.array([ends]), np.array([-1])))


def _count_batch(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1]), pa.array(part[2])], ["h", "c", "class"])


def _threshold(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words have it or more, to the eighth of an octave."""
    eighth = F.floor(F.log2("c") * 8)
    rows = counts.groupBy(eighth.alias("e")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()
    total, out = 0, 1 << 62
    for _, n, least in sorted(rows, reverse=True):
        total += n
        if total > most:
            break
        out = least
    return out


@dataclass
class Vocabulary:
    """Bounded arrays: known words sorted by hash, with their counts, and for frequent ones the symbol (else -1)."""

    hashes: np.ndarray
    log_counts: np.ndarray
    symbol: np.ndarray
    frequent: int
    classes: int
    log_end: float
    end_known: bool

    @property
    def end(self) -> int:
        return self.frequent + self.classes


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, s: Settings) -> Iterator[pa.RecordBatch]:
    v, row = vocabulary, TaskContext.get().partitionId() << 40
    top = np.flatnonzero(v.symbol >= 0)
    frequent, rest = (v.hashes[top], top), (np.delete(v.hashes, top), np.delete(np.arange(len(v.hashes)), top))
    for part, texts in blocks(batches):
        w = Words(texts, lower=True)
        h, n = w.hashes(), w.counts
        place = np.full(len(h), -1, np.int64)
        for keys, at in (frequent, rest):  # most words are found among the few frequent ones
            open_ = np.flatnonzero(place < 0)
            if len(keys) and len(open_):
                found = np.minimum(np.searchsorted(keys, h[open_]), len(keys) - 1)
                hit = keys[found] == h[open_]
                place[open_[hit]] = at[found[hit]]
        known = place >= 0
        symbol = np.where(known, v.symbol[place], -1) if len(v.symbol) else place
        logs = np.where(known, v.log_counts[place], 0.0) if len(v.symbol) else np.zeros(len(h))
        often = symbol >= 0
        symbol = np.where(often, symbol, v.frequent + word_classes(w, v.classes)).astype(np.uint16)
        sums = [np.add.reduceat(np.append(x, 0), w.bounds[:-1]) * (n > 0) for x in (known.astype(np.int64), logs * often, logs * ~often)]
        rare_bounds = np.concatenate(([0], np.cumsum(~known)))[w.bounds]
        rare = pa.ListArray.from_arrays(pa.array(rare_bounds, pa.int32()), pa.array(h[~known].view(np.int64)))
        ends = np.insert(symbol, w.bounds[1:], np.uint16(v.end))  # the end token behind each text
        data = ends.tobytes()
        offsets = ((w.bounds + np.arange(len(w.bounds))) * 2).astype(np.int32)
        symbols = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
        rows = pa.array(row + np.arange(len(texts)))
        row += len(texts)
        columns = [rows, part.column(0), part.column(1), pa.array(n + 1), pa.array(sums[0] + v.end_known), pa.array(sums[1] + v.log_end), pa.array(sums[2]), symbols, rare]
        yield pa.RecordBatch.from_arrays(columns, ["row", "id", "held_out", "n_tokens", "known", "often_sum", "mid_sum", "symbols", "rare"])


# the model


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol x state

    def _step(self, symbol: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        alpha = self.emit[symbol]
        alpha *= self.start if before is None else before @ self.move
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        return alpha, scale

    def forward(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural logarithms of the sequences' likelihoods. Sequences run side by side, longest first."""
        order = np.argsort(-sizes, kind="stable")
        at, out = starts[order], np.zeros(len(sizes))
        alpha = None
        for t, n in enumerate(_active(sizes[order])):
            alpha, scale = self._step(flat[at[:n] + t], None if t == 0 else alpha[:n])
            out[:n] += np.log(scale)
        result = np.empty(len(sizes))
        result[order] = out
        return result

    def expected(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
        """Add the sequences' expected starts, moves and emissions to ``counts``; gives their log likelihood."""
        order = np.argsort(-sizes, kind="stable")
        at, active = starts[order], _active(sizes[order])
        kept, alpha, total = [], None, 0.0
        for t, n in enumerate(active):
            if t % _STRIDE == 0:
                kept.append(None if t == 0 else alpha[:n])
            alpha, scale = self._step(flat[at[:n] + t], None if t == 0 else alpha[:n])
            total += float(np.log(scale).sum())
        ahead, back = np.zeros((0, self.emit.shape[1])), np.ascontiguousarray(self.move.T)
        for first in range(_STRIDE * (len(kept) - 1), -1, -_STRIDE):
            symbols, alphas, scales, before = [], [], [], kept.pop()
            for t, n in enumerate(active[first : first + _STRIDE], first):
                symbols.append(flat[at[:n] + t])
                before, scale = self._step(symbols[-1], None if before is None else before[:n])
                alphas.append(before)
                scales.append(scale)
            for k in range(len(alphas) - 1, -1, -1):
                alpha, behind = alphas[k], len(ahead)
                weight = self.emit[symbols[k]]
                weight /= scales[k][:, None]
                if behind:
                    counts[1][...] += self.move * (alpha[:behind].T @ ahead)
                    beta = ahead @ back
                    alpha[:behind] *= beta
                    weight[:behind] *= beta
                ahead = weight
            if first == 0:
                counts[0][...] += alphas[0].sum(0)
            every, weights = np.concatenate(symbols), np.concatenate(alphas)
            for z in range(self.emit.shape[1]):
                counts[2][:, z] += np.bincount(every, weights=weights[:, z], minlength=len(self.emit))
        return total


def _active(sizes: np.ndarray) -> list[int]:
    """How many sequences, sorted from the longest on, have a symbol at each step."""
    return np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left").tolist() if len(sizes) else []


def zero_counts(states: int, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))


def estimated(counts: tuple[np.ndarray, np.ndarray, np.ndarray], unigram: np.ndarray, prior: float) -> Model:
    start, move, emit = counts
    emit = emit + prior * unigram[:, None]
    return Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1, keepdims=True), emit / emit.sum(0))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of a binary column in a row, and each value's bounds."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return values.view(np.uint16), (bounds - bounds[0]) // 2


def _abreast(bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Sequences by size, as many as run side by side."""
    order = np.argsort(-np.diff(bounds), kind="stable")
    for at in range(0, len(order), _ABREAST):
        yield order[at : at + _ABREAST]


def _expected_rows(batches: Iterator[pa.RecordBatch], model: Model, s: Settings) -> Iterator[pa.RecordBatch]:
    """Rows (kind, z0, z1, ...) of one task's expected counts: symbols from 0, start -1, moves -2 - state, and behind these log likelihood and tokens."""
    counts, told = zero_counts(s.states, len(model.emit)), np.zeros((1, s.states))
    for batch in batches:
        flat, bounds = _flat(batch.column(0))
        for own in _abreast(bounds):
            sizes = np.diff(bounds)[own]
            told[0, :2] += model.expected(flat, bounds[own], sizes, counts), sizes.sum()
    if told.any():
        used = np.flatnonzero(counts[2].any(1))
        kinds = np.concatenate((used, [-1], -2 - np.arange(s.states + 1)))
        table = np.concatenate((counts[2][used], counts[0][None], counts[1], told))
        yield pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(table[:, z]) for z in range(s.states))], ["kind", *(f"z{z}" for z in range(s.states))])


def started(unigram: np.ndarray, s: Settings) -> Model:
    """Sticky random states, all near the unigram distribution."""
    rng = np.random.default_rng(s.seed)
    noise = rng.gamma(0.7, size=(len(unigram), s.states)) + 0.05
    emit = unigram[:, None] * noise
    move = np.full((s.states, s.states), 0.1 / s.states) + 0.9 * np.eye(s.states)
    return Model(np.full(s.states, 1 / s.states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def baum_welch(data: DataFrame, model: Model, unigram: np.ndarray, s: Settings) -> tuple[Model, float]:
    """The model after a round over all rows of ``data`` (symbols), and the log likelihood a token before it."""
    schema = "kind long, " + ", ".join(f"z{z} double" for z in range(s.states))
    sent = data.sparkSession.sparkContext.broadcast(model)
    rows = data.mapInArrow(lambda it: _expected_rows(it, sent.value, s), schema)
    sums = rows.groupBy("kind").agg(*[F.sum(f"z{z}").alias(f"z{z}") for z in range(s.states)]).toArrow()  # as large as the model
    sent.unpersist()
    counts, told = zero_counts(s.states, len(unigram)), -2 - s.states
    table, kinds = np.stack([sums[f"z{z}"].to_numpy() for z in range(s.states)], 1), sums["kind"].to_numpy()
    counts[2][kinds[kinds >= 0]] = table[kinds >= 0]
    counts[0][...] = table[kinds == -1].sum(0)
    moves = (kinds < -1) & (kinds > told)
    counts[1][-2 - kinds[moves]] = table[moves]
    logs, tokens = table[kinds == told].sum(0)[:2]
    return estimated(counts, unigram, s.prior), logs / max(tokens, 1)


def train(encoded: DataFrame, unigram: np.ndarray, s: Settings, shared: Shared) -> Model:
    """``encoded``: id, held_out, symbols. Rounds over the rows that aren't held out."""
    if s.states < 2:
        raise ValueError("at least two states")
    data, model = encoded.where("NOT held_out"), started(unigram, s)
    part = shared.write(data.where(F.pmod(F.xxhash64("id", "symbols"), F.lit(s.start_share)) == 0).select("symbols"), "start")
    for _ in range(s.start_rounds):
        model, _ = baum_welch(part, model, unigram, s)
    shared.drop("start")
    before = -np.inf
    for _ in range(s.rounds):
        model, now = baum_welch(data.select("symbols"), model, unigram, s)
        if now - before < s.settled:
            break
        before = now
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model, class_logs: np.ndarray, frequent: int) -> Iterator[pa.RecordBatch]:
    """Adds log10 likelihoods; ``class_logs``: log10 of each class's weight, by which its words' shares are divided."""
    table = np.concatenate((np.zeros(frequent), class_logs, [0.0]))
    for batch in batches:
        flat, bounds = _flat(batch.column(batch.schema.get_field_index("symbols")))
        logs = np.empty(len(batch))
        for own in _abreast(bounds):
            logs[own] = model.forward(flat, bounds[own], np.diff(bounds)[own]) / np.log(10)
        at = 0
        while at < len(logs):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _SYMBOLS_AT_ONCE, side="right")) - 1)
            logs[at:to] -= np.add.reduceat(table[flat[bounds[at] : bounds[to]]], bounds[at:to] - bounds[at])
            at = to
        rest = [c for c in batch.schema.names if c != "symbols"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(logs)], [*rest, "states_score"])


def held_out_tenth(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def score_documents(docs: DataFrame, held_out: Column, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). Learns from rows not ``held_out``."""
    if s.symbols + s.classes >= 1 << 16:
        raise ValueError("symbols and classes must fit 16 bits")
    spark, shared = docs.sparkSession, Shared(docs.sparkSession, "hmm")
    plain = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    training = plain.where("NOT held_out").select("text")
    counts = training.mapInArrow(lambda it: _count_rows(it, s), "h long, c long, class long").groupBy("h", "class").agg(F.sum("c").alias("c"))
    every = shared.write(counts, "counts")
    counts = every.where("class >= 0")
    ends = every.where("class < 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    total, types = tokens + ends, words + (ends > 0)
    log_total = float(np.log10(total + s.smoothing * (types + 1)))

    often, known = _threshold(counts, s.symbols), _threshold(counts, s.known_words)
    top = counts.where(F.col("c") >= known).select("h", "c").toArrow()  # at most known_words rows
    hashes = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, c = hashes[order], top["c"].to_numpy()[order]
    symbol = np.full(len(c), -1, np.int64)
    symbol[c >= often] = np.arange(int((c >= often).sum()))
    frequent = int((c >= often).sum())
    vocabulary = Vocabulary(hashes, np.log10(c + s.smoothing), symbol, frequent, s.classes, float(np.log10(ends + s.smoothing)), ends > 0)
    class_rows = counts.where(F.col("c") < often).groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    class_c, class_weight = np.zeros(s.classes), np.full(s.classes, s.smoothing)  # a slot for words never seen
    for k, total_c, n in class_rows:
        class_c[k], class_weight[k] = total_c, total_c + s.smoothing * (n + 1)
    unigram = np.concatenate((c[c >= often], class_c, [ends])) + s.smoothing
    unigram = unigram / unigram.sum()

    sent = spark.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, id {kind}, held_out boolean, n_tokens long, known long, often_sum double, mid_sum double, symbols binary, rare array<long>"
    encoded = shared.write(plain.mapInArrow(lambda it: _encoded(it, sent.value, s), schema), "encoded")
    model = train(encoded, unigram, s, shared)

    model_sent, class_logs = spark.sparkContext.broadcast(model), np.log10(class_weight)
    kept = encoded.select("row", "id", "held_out", "n_tokens", "known", "often_sum", "mid_sum", "symbols")
    scored_schema = f"row long, id {kind}, held_out boolean, n_tokens long, known long, often_sum double, mid_sum double, states_score double"
    scored = kept.mapInArrow(lambda it: _scored(it, model_sent.value, class_logs, frequent), scored_schema)
    rare = encoded.select("row", F.explode("rare").alias("h")).join(counts.where(F.col("c") < known).select("h", "c"), "h", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + s.smoothing)).alias("rare_sum"), F.count("c").alias("rare_known"))
    sums = F.col("mid_sum") + F.coalesce("rare_sum", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("often_sum") + sums - F.col("n_tokens") * F.lit(log_total)).alias("base_score"), (F.col("states_score") + sums).alias("score"),
    )
