from __future__ import annotations

import random
import sys

import corpus_pipeline
import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import test_decontamination  # noqa: E402
import test_lines  # noqa: E402
import test_neardup  # noqa: E402
import test_packing  # noqa: E402
import test_quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(6)
    vocab = [f"w{int(rnd.expovariate(0.002))}" for _ in range(5000)]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [" ".join(words(n)) for n in (16, 25, 40, 55)]
    base, docs = [words(150) for _ in range(5)], []
    for d in range(90):
        w = list(rnd.choice(base)) if d % 4 == 0 else words(rnd.randrange(20, 220))
        for _ in range(rnd.randrange(6) if d % 4 == 0 else 0):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        if d % 7 == 0:
            w += rnd.choice(items).split()
        if d % 11 == 0:
            w += w[:100] * 2
        lines = [" ".join(w[i : i + 30]) for i in range(0, len(w), 30)]
        if d % 5 == 0:
            lines.insert(1, "All rights reserved by the usual people.")
        docs.append("\n".join(lines))
    return docs + [None, "", docs[2], docs[3].upper(), "junk " * 300], items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs, items = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def expected():
    """All stages but the last by brute force: id and text of what stays."""
    docs, items = corpus()
    rows = [(i, t) for i, t in enumerate(docs) if test_quality.brute(t)[-1]]
    rows = [(i, t) for i, t in test_lines.brute(rows).items() if t.split()]
    keep = test_neardup.brute(rows, 5, 80)
    rows = [(i, t) for i, t in rows if keep[i][1] == i]
    leaks = test_decontamination.Leaks()
    out = {}
    for i, t in rows:
        if not any(test_decontamination.edit_distance(x.split(), t.lower().replace(".", " ").split()) <= leaks.edits(len(x.split())) for x in items):
            out[i] = t
    return out


def test_stages_match_brute_force(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, tables)
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == expected()
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert {r["doc_id"] for r in packed} == set(got)
    whole = corpus_pipeline.run(spark, tables).collect()
    key = lambda r: (r["doc_id"], r["start"])
    assert sorted(map(key, whole)) == sorted(map(key, packed))
    assert {key(r): r["ids_crc32"] for r in whole} == {key(r): r["ids_crc32"] for r in packed}
    inner = test_packing.Tokenizer.from_file(test_packing.PATH)
    assert sum(r["length"] for r in packed) == sum(len(inner.encode(t, add_special_tokens=False).ids) + 1 for t in got.values())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
