from __future__ import annotations

import random
import re
from collections import Counter

from lumentide.llm.quality import QualityRules, quality_filter, quality_measures

SCHEMA = "doc_id long, text string, kept string, n_words long"


def brute(text, r=QualityRules()):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n, lines, seen, dups = len(w), (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0d]", line):
            dups += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    triple = {i + k for i in range(n - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    best = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    covered = {i + k for i in range(n) if best[i] >= r.min_repeat for k in range(best[i])}
    longest = max([b for b in best if b >= r.min_repeat], default=0)
    failed = n < r.min_words or 100 * len(triple) > 50 * n
    kept = not failed and len(covered) <= r.max_covered * n and longest <= r.max_longest
    return n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dups, len(triple), len(covered), longest, failed, kept


def corpus():
    rnd = random.Random(2)
    out = [None, "", " \n\t", "one", "a b a b a b", "x " * 400, "é# " * 3 + "ß|ß", "A\nA\n\nA \nB", "l1 w\r\nl1 w\r\n"]
    for _ in range(60):
        vocab = [f"w{i}" for i in range(rnd.choice((4, 40, 1000)))]
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(1, 140))]
        for _ in range(rnd.randrange(3)):
            at, n = rnd.randrange(len(w)), rnd.randrange(1, 40)
            w[rnd.randrange(len(w)) : 0] = w[at : at + n]
        out.append(re.sub(" (?=w1)", "\n", " ".join(w)))
    return out + [" ".join(f"t{i % 70}" for i in range(180)), " ".join(map(str, range(200)))]


def test_matches_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in quality_measures(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    kept = quality_filter(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in enumerate(texts) if brute(t)[-1]}
    assert quality_measures(df.limit(0)).count() == 0 and quality_filter(df.limit(0)).count() == 0


def test_long_repeat_is_rejected(spark):
    passage = " ".join(f"p{i}" for i in range(1200))
    clean = " ".join(f"q{i}" for i in range(9000))
    df = spark.createDataFrame([(1, f"{passage} {clean} {passage}", "k", 1), (2, clean, "k", 1), (2, clean, "k", 1)], SCHEMA)
    assert sorted((r["doc_id"], r["longest_repeat"], r["kept"]) for r in quality_measures(df).collect()) == [(1, 1200, False), (2, 0, True), (2, 0, True)]
