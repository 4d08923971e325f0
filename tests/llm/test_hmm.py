from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lumentide.llm import hmm
from lumentide.llm.hmm import Model, Settings, estimated, held_out_tenth, score_documents, started, word_classes, zero_counts
from lumentide.llm.textio import Words

SCHEMA = "doc_id long, text string, row long, known string"


def corpus():
    rnd = random.Random(1)
    vocabs = [[f"{p}{i}" for i in range(300)] for p in ("a", "b", "é")]
    rows = []
    for d in range(300):
        v = vocabs[d % 3]
        rows.append((d, " ".join(v[min(int(rnd.expovariate(0.02)), 299)] for _ in range(rnd.randrange(1, 120)))))
    return rows + [(400, None), (401, ""), (402, " \t"), (403, "UNSEEN Words a1"), (404, "a1 " * 9000), (5, rows[5][1])]


def base(rows):
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for d, t in rows if not held[d] for w in words(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        w = words(t)
        out.append((d, held[d], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return out


@pytest.mark.parametrize("s", [Settings(), Settings(symbols=40, classes=16, known_words=100, states=3, start_share=2, start_rounds=2)])
def test_base_and_held_out(spark, s):
    rows = corpus()
    df = spark.createDataFrame([(*r, 3, "k") for r in rows], SCHEMA).repartition(3)
    got = score_documents(df, held_out_tenth("doc_id"), s).collect()
    want = sorted(base(rows))
    for g, w in zip(sorted(got, key=lambda r: r["doc_id"]), want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g["base_score"] == pytest.approx(w[5], rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "a b", 3, "k"), (2, None, 3, "k")], SCHEMA)
    assert score_documents(df.limit(0), held_out_tenth("doc_id")).count() == 0
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in score_documents(df, F.lit(True)).collect()}
    assert (got[1]["n_known"], got[1]["train_tokens"], got[1]["base_score"]) == (0, 0, 0.0)
    assert math.isfinite(got[1]["score"]) and got[1]["score"] < 0


def model(states=3, symbols=4, seed=0):
    rng = np.random.default_rng(seed)
    return Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T)


def paths(m, seq):
    for z in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[z[0]] * m.emit[seq[0], z[0]]
        for a, b, x in zip(z, z[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[x, b]
        yield z, p


@pytest.mark.parametrize("stride", [1, 2, 128])
def test_forward_and_expected_counts_are_exact(monkeypatch, stride):
    monkeypatch.setattr(hmm, "_STRIDE", stride)
    m, seqs = model(), [[0, 1, 3, 2], [2], [1, 1, 0]]
    flat = np.concatenate([np.array(x, np.uint16) for x in seqs])
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in seqs])))
    counts, want = zero_counts(3, 4), zero_counts(3, 4)
    told = m.expected(flat, bounds[:-1], np.diff(bounds), counts)
    logs = m.forward(flat, bounds[:-1], np.diff(bounds))
    assert told == pytest.approx(logs.sum())
    for k, seq in enumerate(seqs):
        total = sum(p for _, p in paths(m, seq))
        assert logs[k] == pytest.approx(math.log(total))
        for z, p in paths(m, seq):
            want[0][z[0]] += p / total
            for a, b in zip(z, z[1:]):
                want[1][a, b] += p / total
            for x, a in zip(seq, z):
                want[2][x, a] += p / total
    for got, w in zip(counts, want, strict=True):
        assert np.allclose(got, w)


def test_likelihood_rises_and_is_a_distribution():
    true, m, rng = model(seed=4), model(seed=9), np.random.default_rng(2)
    flat = rng.choice(4, 3000).astype(np.uint16)
    flat[::2] = 1
    bounds = np.arange(0, 3001, 50)
    before = -np.inf
    for _ in range(6):
        now = m.forward(flat, bounds[:-1], np.diff(bounds)).sum()
        assert now >= before - 2
        before, counts = now, zero_counts(3, 4)
        m.expected(flat, bounds[:-1], np.diff(bounds), counts)
        m = estimated(counts, np.full(4, 0.25), 0.0)
    every = np.array(list(itertools.product(range(4), repeat=3)), np.uint16)
    logs = true.forward(every.ravel(), np.arange(0, every.size, 3), np.full(len(every), 3))
    assert np.exp(logs).sum() == pytest.approx(1)


def test_long_sequences_are_not_cut():
    """Counts of one long sequence with states told by its symbols: one start, and each move, whatever the stride."""
    emit = np.array([[0.999, 0.001], [0.001, 0.999]])
    m, flat = Model(np.array([0.5, 0.5]), np.full((2, 2), 0.5), emit), np.array([0] * 1000 + [1] * 500, np.uint16)
    counts = zero_counts(2, 2)
    m.expected(flat, np.array([0]), np.array([1500]), counts)
    assert counts[0].sum() == pytest.approx(1) and counts[1].sum() == pytest.approx(1499) and counts[2].sum() == pytest.approx(1500)
    assert counts[0][0] > 0.99 and counts[1][0, 0] == pytest.approx(999, abs=4)


def plain_scores(rows, s):
    """The whole model once more with dictionaries and lists: symbols, Baum-Welch, forward recursion, shares of classes."""
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows}
    texts = {k: (t or "").encode().lower().split() for k, (_, t) in enumerate(rows)}
    train = [k for k, (d, _) in enumerate(rows) if not held[d]]
    c = Counter(w for k in train for w in texts[k])
    least = hmm_threshold(c, s.symbols)
    h = lambda w: int(Words([w]).hashes()[0])
    often = sorted((w for w in c if c[w] >= least), key=h)
    symbol = {w: k for k, w in enumerate(often)}
    cls = lambda w: int(word_classes(Words([w]), s.classes)[0])
    mass, kinds = Counter(), Counter()
    for w in c:
        if w not in symbol:
            mass[cls(w)] += c[w]
            kinds[cls(w)] += 1
    weight = {k: mass[k] + s.smoothing * (kinds[k] + 1) if kinds[k] else s.smoothing for k in range(s.classes)}
    unigram = np.array([c[w] for w in often] + [mass[k] for k in range(s.classes)] + [len(train)]) + s.smoothing
    unigram = unigram / unigram.sum()
    coded = {k: [symbol.get(w, len(often) + cls(w)) for w in t] + [len(often) + s.classes] for k, t in texts.items()}
    m = started(unigram, s)

    def forward(seq):
        out, total = [], 0.0
        for t, x in enumerate(seq):
            a = [m.emit[x, z] * (m.start[z] if t == 0 else sum(out[-1][y] * m.move[y, z] for y in range(s.states))) for z in range(s.states)]
            total += math.log(sum(a))
            out.append([v / sum(a) for v in a])
        return out, total

    for _ in range(s.start_rounds + s.rounds):
        counts = zero_counts(s.states, len(unigram))
        for k in train:
            seq = coded[k]
            alpha, beta = forward(seq)[0], [[1.0] * s.states]
            for x in seq[:0:-1]:
                b = [sum(m.move[z, y] * m.emit[x, y] * beta[0][y] for y in range(s.states)) for z in range(s.states)]
                beta.insert(0, [v / max(b) for v in b])
            for t, x in enumerate(seq):
                g = [alpha[t][z] * beta[t][z] for z in range(s.states)]
                for z in range(s.states):
                    counts[2][x, z] += g[z] / sum(g)
                    counts[0][z] += (g[z] / sum(g)) * (t == 0)
                if t + 1 < len(seq):
                    xi = np.array([[alpha[t][y] * m.move[y, z] * m.emit[seq[t + 1], z] * beta[t + 1][z] for z in range(s.states)] for y in range(s.states)])
                    counts[1][...] += xi / xi.sum()
        m = estimated(counts, unigram, s.prior)
    out = []
    for k, (d, _) in enumerate(rows):
        own = forward(coded[k])[1] / math.log(10)
        own += sum(math.log10((c[w] + s.smoothing) / weight[cls(w)]) for w in texts[k] if w not in symbol)
        out.append((d, own))
    return out


def hmm_threshold(c, most):
    """Counts in eighths of an octave, from the largest, as many as fit."""
    groups, total, least = {}, 0, 1 << 62
    for n in c.values():
        groups.setdefault(math.floor(math.log2(n) * 8), []).append(n)
    for e in sorted(groups, reverse=True):
        total += len(groups[e])
        if total > most:
            break
        least = min(groups[e])
    return least


def test_scores_match_a_plain_model(spark):
    """Frequent words, classes of rare words, words never seen, a null id, repeated rows, null and empty texts."""
    rnd = random.Random(4)
    rows = [(d, " ".join(rnd.choice(("ab", "cd", "E", "ab x", f"w{rnd.randrange(40)}", "é")) for _ in range(rnd.randrange(12)))) for d in range(24)]
    rows += [(10, "only here held out NEW"), (50, None), (51, ""), (3, rows[3][1]), (3, rows[3][1]), (None, "ab null id"), (60, "ab cd " * 150)]
    s = Settings(states=2, symbols=6, classes=8, known_words=20, start_share=1, start_rounds=2, rounds=2, settled=-1.0)
    df = spark.createDataFrame([(*r, 3, "k") for r in rows], SCHEMA).repartition(3)
    got = sorted(((r["doc_id"], r["score"]) for r in score_documents(df, held_out_tenth("doc_id"), s).collect()), key=repr)
    for g, w in zip(got, sorted(plain_scores(rows, s), key=repr), strict=True):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], rel=1e-6)


def test_rounds_end_when_settled(spark):
    df = spark.createDataFrame([(i, bytes([i % 2, 0, 1, 0])) for i in range(40)], "id long, symbols binary")
    unigram, s = np.array([0.5, 0.5]), Settings(states=2)
    m, first = hmm.baum_welch(df.select("symbols"), started(unigram, s), unigram, s)
    _, second = hmm.baum_welch(df.select("symbols"), m, unigram, s)
    assert second > first
