from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumentide.llm.packing import classes, crc_payload, cut, pack
from lumentide.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, rank long"


def texts():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgéñßü'’,.-0123ÀÉ") for _ in range(rnd.randrange(1, 9)))
    out = [" ".join(word() for _ in range(rnd.randrange(0, 900))) for _ in range(60)]
    return out + [None, "", " \n ", "the " * 20000, "I'm don't THE. end., a.b, x,", "<|endoftext|> plain <|startoftext|>", "e\u0301 e \u0301x \u0345 \u00a0 nbsp\u2003em \u0130I \u03a3\u03c3\u03c2", "\ufb01 \u2168 \U0001f600\U0001f600. \u4f60\u597d, ok"]


def test_ids_are_the_library_s():
    inner, mine = Tokenizer.from_file(PATH), WordTokenizer(PATH, cache_words=200)
    for _ in range(2):
        ids, bounds = mine.encode_block([t.encode() if t is not None else None for t in texts()])
        for k, t in enumerate(texts()):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == inner.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("capacity", [4096, 64])
def test_pieces_and_sequences(spark, capacity):
    rows = [(i, t, "s", 1) for i, t in enumerate(texts())] + [(3, texts()[3], "s", 1)]
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, capacity=capacity).collect()
    inner, docs, sequences = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in got:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts()):
        ids = inner.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(docs[i], key=lambda r: r["start"])
        assert {r["doc_tokens"] for r in pieces} == {len(ids)}
        if i == 3:  # the row is there twice
            pieces = pieces[::2]
        assert [x for r in pieces for x in r["ids"]] == ids
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
    used = padded = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert 0 < at <= capacity
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else capacity)
    assert padded <= used * 1.03 + capacity


def test_digests_and_edges(spark):
    df = spark.createDataFrame([(1, "a b", "s", 1), (2, None, "s", 1)], SCHEMA)
    got = {r["doc_id"]: r for r in pack(df, PATH, payload=("crc", crc_payload, "long")).collect()}
    assert got[2]["crc"] == zlib.crc32(np.array([2], "<u4").tobytes()) and got[2]["doc_tokens"] == 1
    assert got[1]["sequence_id"] == got[2]["sequence_id"]
    assert pack(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        pack(df, PATH, capacity=100)


def test_cutting():
    assert cut(10000, 4096) == [4096, 4096, 1024, 512, 256, 16] and cut(256, 4096) == [256] and cut(0, 4096) == []
    grid = classes(4096)
    assert grid[:5] == [1, 2, 4, 8, 16] and grid[-1] == 4096 and all(b > a for a, b in zip(grid, grid[1:]))
