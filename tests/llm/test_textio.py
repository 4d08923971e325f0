from __future__ import annotations

import random

import numpy as np

from lumentide.llm import textio
from lumentide.llm.textio import Words, inside, ngram_hashes, range_hashes


def test_words_are_those_of_the_pattern():
    texts = [b"", None, b" \t", b"a b\x0bc\x0cd\re\nf", "\u00a0x \u2003y".encode(), b"A" * 10]
    w = Words(texts, lower=True)
    got = [[bytes(w.buf[b:e]) for b, e in zip(w.starts[x:y], w.ends[x:y])] for x, y in zip(w.bounds[:-1], w.bounds[1:])]
    assert got == [(t or b"").lower().split() for t in texts]
    assert w.owner().tolist() == [i for i, t in enumerate(texts) for _ in (t or b"").split()]


def test_hashes_depend_on_the_word_alone(monkeypatch):
    rnd = random.Random(1)
    words = [bytes(rnd.choices(range(33, 127), k=rnd.randrange(1, 40))) for _ in range(500)]
    text = b" ".join(rnd.choice(words) for _ in range(4000))
    whole = Words([b"lead", text]).hashes()[1:]
    monkeypatch.setattr(textio, "_STRETCH", 50)
    assert (Words([text]).hashes() == whole).all()
    one = {w: int(Words([w]).hashes()[0]) for w in set(text.split())}
    assert [one[w] for w in text.split()] == whole.tolist() and len(set(one.values())) == len(one)


def test_a_word_longer_than_a_stretch():
    word = b"x" * 3_000_000
    h = Words([b"a " + word + b" b", word]).hashes()
    assert h[1] == h[3] and len(set(h.tolist())) == 3


def test_runs():
    h = Words([b"a b c a b d", b"a b c"]).hashes()
    grams = ngram_hashes(h, 2)
    assert grams[0] == grams[3] == grams[6] and grams[1] == grams[7]
    assert inside(np.array([0, 6, 9]), 3, 9).tolist() == [0, 1, 2, 3, 6]
    runs = range_hashes(h.copy(), np.array([0, 6, 0]), np.array([3, 9, 2]))
    assert runs[0] == runs[1] != runs[2] and len(ngram_hashes(h, 10)) == 0
