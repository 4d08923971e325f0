from __future__ import annotations

import random

import numpy as np
import pytest

from lumentide.llm.decontamination import LeakIndex, Leaks, best_match, decontaminate, find_leaks, match_words

DOCS, ITEMS = "doc_id long, text string, item_id long, edits string", "item_id long, text string"


def edit_distance(p, t):
    """Least edits of p to any run of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def corpus(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{int(rnd.expovariate(0.01))}" for _ in range(4000)]
    items = [[rnd.choice(vocab) for _ in range(rnd.choice((3, 9, 16, 30, 55)))] for _ in range(25)]
    docs = []
    for d in range(120):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(1, 200))]
        if d % 2:
            p = list(rnd.choice(items))
            for _ in range(rnd.randrange(int(0.3 * len(p)) + 1)):
                k = rnd.randrange(len(p))
                p[k : k + rnd.randrange(2)] = [rnd.choice(vocab)] if rnd.random() < 0.6 else []
            at = rnd.randrange(len(w) + 1)
            w[at:at] = p
        docs.append(" ".join(w))
    return docs, [" ".join(i) for i in items]


def test_matches_brute_force(spark):
    docs, items = corpus()
    docs += ["", " ,.!", items[0].upper().replace(" ", ", "), "x " * 9000, items[3] + " " + items[3]]
    s = Leaks()
    rows = [(i, t, 1, "e") for i, t in enumerate(docs)] + [(900, None, 1, "e")]
    bench = [(100 + k, t) for k, t in enumerate(items)] + [(1, None), (2, ""), (3, "?!")]
    df, b = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(bench, ITEMS)
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in find_leaks(df, b, s).collect()}
    words = [t.translate(str.maketrans({c: " " for c in ",.!?"})).lower().split() for t in docs]
    pats = [t.split() for t in items]
    want = {}
    for i, w in enumerate(words):
        for k, p in enumerate(pats):
            d = edit_distance(p, w)
            if d <= s.edits(len(p)):
                want[i, 100 + k] = d
    missed = {k for k in want if k not in got}
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if k not in missed}
    assert len(missed) <= 0.02 * len(want)
    clean = decontaminate(df, b, s)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in got}


def test_parts_and_empty_tables(spark):
    docs, items = corpus(2)
    df = spark.createDataFrame([(i, t, 1, "e") for i, t in enumerate(docs)], DOCS)
    b = spark.createDataFrame(list(enumerate(items)), ITEMS)
    whole, parts = ({tuple(r) for r in find_leaks(df, b, Leaks(items_at_once=n)).collect()} for n in (1000, 7))
    assert {r[:2] for r in whole} == {r[:2] for r in parts} and whole
    assert find_leaks(df.limit(0), b).count() == 0 and find_leaks(df, b.limit(0)).count() == 0
    assert decontaminate(df, b.limit(0)).count() == len(docs)


def test_recall_at_the_threshold():
    """Random word edits at the full rate; the target is 0.98."""
    rnd = random.Random(7)
    docs, _ = corpus(3)
    items = [" ".join(f"v{int(rnd.expovariate(0.004))}" for _ in range(rnd.randrange(16, 60))) for _ in range(150)]
    index, found = LeakIndex([t.encode() for t in items], Leaks()), 0
    for k, t in enumerate(items):
        w = t.split()
        for _ in range(Leaks().edits(len(w))):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(99)}"
        doc, item, *_ = index.search([(docs[k % len(docs)] + " " + " ".join(w) + " " + docs[0]).encode()])
        found += k in item.tolist()
    assert found >= 0.98 * len(items)


@pytest.mark.parametrize("n", [5, 7, 8, 12, 16, 20, 30, 55, 100, 200, 500])
@pytest.mark.parametrize("even", [False, True])
def test_recall_of_each_kind_of_edit_by_length(n, even):
    """Exactly int(0.2 n) edits, at random or evenly spread: substitutions, insertions, deletions."""
    rnd, trials, s = random.Random(n), 40 if n < 200 else 12, Leaks()
    items = [[f"v{int(rnd.expovariate(0.0005))}" for _ in range(n)] for _ in range(trials)]
    index, most = LeakIndex([" ".join(t).encode() for t in items], s), s.edits(n)
    around = " ".join(f"b{k}" for k in range(40))
    for kind in ("substitute", "insert", "delete"):
        docs = []
        for t in items:
            at = [(2 * k + 1) * n // (2 * most) for k in range(most)] if even else sorted(rnd.sample(range(n), most))
            w = [[] if k in at and kind == "delete" else [f"z{rnd.randrange(10**6)}"] if k in at and kind == "substitute" else [f"z{k}", x] if k in at else [x] for k, x in enumerate(t)]
            docs.append(f"{around} {' '.join(sum(w, []))} {around}".encode())
        doc, item, *_ = index.search(docs)
        found = {int(d) for d, i in zip(doc, item, strict=True) if d == i}
        assert len(found) >= 0.97 * trials, (kind, len(found) / trials)


def test_best_match():
    rng = np.random.default_rng(0)
    for _ in range(200):
        p, t = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 15))
        cost, begin, end = best_match(p, t)
        assert cost == edit_distance(p.tolist(), t.tolist()) == edit_distance(p.tolist(), t[begin:end].tolist())


def test_words():
    w = match_words([b"A-b, c3!", None, "É x".encode()])
    assert [bytes(w.buf[b:e]) for b, e in zip(w.starts, w.ends)] == [b"a", b"b", b"c3", "É".encode(), b"x"]
    assert w.counts.tolist() == [3, 0, 2]


def test_repeated_rows_ties_and_short_items(spark):
    """Each row is reported; of places equally close the first; of closer ones the closest; items too short for an edit only word for word."""
    item = "one two three four five six seven eight nine ten"
    near = item.replace("five", "zero")
    rows = [(1, f"{near} x y {near} z", 0, "e"), (1, f"{near} x y {near} z", 0, "e"), (2, f"{near} x y {item}", 0, "e"), (None, item, 0, "e"), (4, "alpha beta gamma and alpha delta gamma beta", 0, "e")]
    b = spark.createDataFrame([(7, item), (8, item), (9, "alpha gamma beta"), (10, "alpha delta gamma beta"), (None, "alpha beta")], ITEMS)
    got = sorted((tuple(r)[:3] + (r["start_word"], r["n_words"]) for r in find_leaks(spark.createDataFrame(rows, DOCS), b).collect()), key=repr)
    twice = [(1, i, 1, 0, 10) for i in (7, 8)]
    assert got == sorted([*twice, *twice, *[(2, i, 0, 12, 10) for i in (7, 8)], *[(None, i, 0, 0, 10) for i in (7, 8)], (4, 10, 0, 4, 4), (4, None, 0, 0, 2)], key=repr)
