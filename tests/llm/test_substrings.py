from __future__ import annotations

import random

import numpy as np
import pytest

from lumentide.llm.fmindex import FMIndex, PackedBits, WaveletMatrix
from lumentide.llm.substrings import Substrings, dedup_substrings, search_shard

SCHEMA = "doc_id long, text string, doc long, runs string"


def brute(rows, window):
    least = {}
    docs = {d: (t or "").encode().split() for d, t in rows}
    for d, w in docs.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(d, least.get(k, d))
    out = {}
    for d, w in docs.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def corpus(window, seed=2):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    word = lambda: rnd.choice(vocab)
    passages = [[word() for _ in range(rnd.randrange(window - 1, 4 * window))] for _ in range(6)]
    common = [word() for _ in range(window + 15)]
    rows = []
    for d in range(120):
        w = [word() for _ in range(rnd.randrange(3 * window))]
        for _ in range(rnd.randrange(3)):
            p = list(rnd.choice(passages))
            if rnd.random() < 0.4:
                p[rnd.randrange(len(p))] = word()
            at = rnd.randrange(len(w) + 1)
            w[at:at] = p
        if d % 3 == 0:
            at = rnd.randrange(len(w) + 1)
            w[at:at] = common
        rows.append((d, " ".join(w)))
    rows += [(200 + i, rows[i][1]) for i in range(12)] + [(300, None), (301, ""), (302, "a b"), (303, "x " * 3000), (304, "x " * 2999), (305, "x y " * 700), (306, "\ty\x0bx " * 700)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("hot", "words"), [(256, 4000), (3, 4000), (256, 300)])
def test_matches_brute_force(spark, hot, words):
    s = Substrings(window=20, gram=5, longest=64, hot_least=hot, hot_share=0.0001, shard_words=words)
    rows = corpus(20)
    df = spark.createDataFrame([(*r, 9, "q") for r in rows], SCHEMA)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in dedup_substrings(df, s).collect()} == brute(rows, 20)


def test_default_window(spark):
    rows = corpus(50, 8)
    df = spark.createDataFrame([(*r, 9, "q") for r in rows], SCHEMA)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in dedup_substrings(df).collect()} == brute(rows, 50)
    assert dedup_substrings(df.limit(0)).count() == 0


def test_search_shard():
    rows = [(d, (t or "").encode()) for d, t in corpus(20, 5)]
    want = brute([(d, t.decode()) for d, t in rows], 20)
    for (d, t), runs in zip(rows, search_shard([(0, *r) for r in rows], 20), strict=True):
        gone = {i for x, n in runs for i in range(x, x + n + 19)}
        assert want[d][1] == len(gone)


def test_rank_and_backward_search():
    rng = np.random.default_rng(1)
    bits = rng.random(500) < 0.3
    at = np.arange(501)
    assert (PackedBits(bits).rank(at) == np.concatenate(([0], np.cumsum(bits)))).all()
    symbols = rng.integers(0, 7, 600)
    matrix = WaveletMatrix(symbols, 7)
    for c in range(7):
        assert (matrix.rank(np.full(601, c), np.arange(601)) == np.concatenate(([0], np.cumsum(symbols == c)))).all()
    parts = [rng.integers(1, 4, k) for k in (150, 90, 3, 160)]
    text, owners = np.concatenate([np.append(p, 0) for p in parts]), np.repeat([40, 10, 30, 20], [len(p) + 1 for p in parts])
    index = FMIndex(text, 5, 6, owners)
    least = {}
    for p, owner in zip(parts, (40, 10, 30, 20), strict=True):
        for i in range(len(p) - 5):
            key = tuple(p[i : i + 6])
            least[key] = min(owner, least.get(key, owner))
    # runs of its own and of another text, with a symbol that it lacks: what occurs is found, other windows are not
    other = rng.integers(1, 4, 300)
    other[::37] = 4
    for run in (parts[0], other, np.full(20, 4), np.full(20, 1)):
        cut = len(run) // 3
        lengths, windows = index.statistics(run, np.array([0, cut + 2]), np.array([cut, len(run)]))
        for i in [*range(cut), *range(cut + 2, len(run))]:
            stop = cut if i < cut else len(run)
            want = max(k for k in range(7) if i + k <= stop and (k == 0 or any((p[j : j + k] == run[i : i + k]).all() for p in parts for j in range(len(p) - k + 1))))
            assert lengths[i] == want and (windows[i] >= 0) == (want == 6)
            assert want < 6 or index.least[windows[i]] == least[tuple(run[i : i + 6])]


def test_index_is_compressed():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 1000, 40_000), 0)
    index = FMIndex(text, 1000, 50, np.zeros(len(text), np.int64))
    bits = sum(b.words.nbytes + b.before.nbytes for _, b, _ in index.bwt.levels)
    assert bits < 2 * len(text) and not hasattr(index, "order") and index.common.nbytes == len(text) + 1


def test_one_id_with_several_texts_and_nulls(spark):
    """Texts of one id are one document: neither is smaller, and each loses what a smaller document holds."""
    words = lambda k: " ".join(f"{k}x{i}" for i in range(70))
    rows = [(5, "short"), (5, words("a") + " tail " + words("b")), (5, words("b")), (5, words("b")), (3, "lead " + words("a")), (9, words("b") + " more"), (None, words("a")), (None, None), (None, words("c")), (10, words("c"))]
    df = spark.createDataFrame([(*r, 9, "q") for r in rows], SCHEMA).repartition(3)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in dedup_substrings(df).collect()), key=repr)
    assert got == sorted([(5, 1, 0), (5, 141, 70), (5, 70, 0), (5, 70, 0), (3, 71, 0), (9, 71, 70), (None, 70, 0), (None, 0, 0), (None, 70, 0), (10, 70, 0)], key=repr)


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b", 1, 2, "c"), (2, "a", 1, 2, "c")], "doc_id long, text string, id long, t long, doc string")
    assert sorted(r["n_words"] for r in dedup_substrings(df).collect()) == [1, 2]


def test_hot_anchor_in_pieces():
    """What two pieces of an anchor find together is what one shard finds."""
    rows = [(0, d, (t or "").encode()) for d, t in corpus(20, 6)]
    whole = search_shard(rows, 20)
    pieces = [[k for k in range(len(rows)) if k % 3 == p] for p in range(3)]
    found = [set() for _ in rows]
    for a, b in ((0, 1), (0, 2), (1, 2)):
        own = pieces[a] + pieces[b]
        for k, runs in zip(own, search_shard([rows[k] for k in own], 20), strict=True):
            found[k] |= {i for x, n in runs for i in range(x, x + n)}
    assert found == [{i for x, n in runs for i in range(x, x + n)} for runs in whole]
