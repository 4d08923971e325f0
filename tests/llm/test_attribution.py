from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from lumentide.llm.attribution import allocate, attribute_tokens
from lumentide.llm.tokens import ByteTokenizer

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, section long, start_char string"


def test_rules():
    ends, begins = np.array([2, 7, 9, 20]), np.array([0, 3, 8, 12])
    assert allocate(ends, begins, "start").tolist() == [0, 0, 1, 2]
    assert allocate(ends, begins, "end").tolist() == [0, 1, 2, 3]
    assert allocate(ends, begins, "most").tolist() == [0, 1, 1, 3]


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_matches_brute_force(spark, rule):
    texts = ["one line", "a\nb\n\n\nc  \n   d", "é\nüß\n\U0001f600\U0001f600\nx", "\n\n\n\n", "", None, "word " * 4000 + "\nend"]
    rows = [(i, t, 1, "c") for i, t in enumerate(texts)] + [(1, texts[1], 1, "c")]
    got = attribute_tokens(spark.createDataFrame(rows, SCHEMA).repartition(2), PATH, PATTERN, rule).collect()
    assert len([r for r in got if r["doc_id"] == 1]) == 12
    tokenizer = ByteTokenizer(PATH, PATTERN)
    for i, t in enumerate(texts):
        data, lines = (t or "").encode(), (t or "").split("\n")
        starts = np.cumsum([0] + [len((x + "\n").encode()) for x in lines])[:-1].tolist()
        owner = [max(k for k, s in enumerate(starts) if s <= b) for b in range(len(data))]
        want, crossing, at = [0] * len(lines), [0] * len(lines), 0
        ids, _ = tokenizer.encode_spans(data)
        for token in ids.tolist():
            own = owner[at : at + tokenizer.widths[token]]
            k = {"start": own[0], "end": own[-1], "most": max(sorted(set(own)), key=own.count)}[rule]
            want[k] += 1
            crossing[k] += own[0] != own[-1]
            at += len(own)
        mine = sorted({tuple(r) for r in got if r["doc_id"] == i}, key=lambda r: r[1])
        assert [r[4] for r in mine] == want and [r[5] for r in mine] == crossing and {r[6] for r in mine} == {len(ids)}
        full = t or ""
        assert [full[r[2] : r[3]] for r in mine] == [x + "\n" for x in lines[:-1]] + lines[-1:]


def test_empty_table_and_bad_rule(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert attribute_tokens(df, PATH, PATTERN).count() == 0
    with pytest.raises(ValueError):
        attribute_tokens(df, PATH, PATTERN, "half")
