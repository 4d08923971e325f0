from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from lumentide.llm import lines as line_module
from lumentide.llm.lines import LineDup, LineHashes, dedup_lines
from lumentide.llm.queries import QUERIES
from lumentide.llm.textio import mix

SCHEMA = "doc_id long, text string, lines string, component long"


def brute(rows, s=LineDup()):
    items = []
    for d, t in rows:
        for k, line in enumerate((t or "").lower().split("\n") if t else []):
            if line.strip():
                items.append((d, k, line.strip()))
    sets = {}
    for _, _, line in items:
        sets[line] = {line[i : i + s.shingle] for i in range(max(1, len(line) - s.shingle + 1))}
    names = list(sets)
    parent = {n: n for n in names}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, x in enumerate(names):
        for y in names[:i]:
            both = len(sets[x] & sets[y])
            if both and 100 * both >= s.percent * len(sets[x] | sets[y]):
                parent[root(x)] = root(y)
    keep = {}
    for d, k, line in sorted(items, key=lambda r: r[:2]):
        keep.setdefault(root(line), (d, k))
    gone = {(d, k) for d, k, line in items if keep[root(line)] != (d, k)}
    return {d: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}


def corpus(seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghé") for _ in range(rnd.randrange(2, 9)))
    base = [" ".join(word() for _ in range(rnd.randrange(1, 40))) for _ in range(40)]
    rows = []
    for d in range(80):
        lines = []
        for _ in range(rnd.randrange(0, 9)):
            line = list(rnd.choice(base)) if rnd.random() < 0.6 else list(" ".join(word() for _ in range(20)))
            for _ in range(rnd.randrange(4)):
                line[rnd.randrange(len(line))] = rnd.choice("xyz ")
            lines.append("".join(line) if rnd.random() < 0.9 else " \t")
        rows.append((d, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "ab"), (104, " AB \r"), (105, "y" * 100000), (106, "Z\n" + "y" * 99999), (107, "\U0001f600 ok then\nÉté là"), (108, "\U0001f600 OK then\nété là")]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA)
    out = dedup_lines(df, count_col="n_removed")
    assert out.columns == [*df.columns, "n_removed"]
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute(rows)


def test_repeated_row_and_empty_table(spark):
    rows = [(1, "the very same line of text"), (1, "the very same line of text"), (2, "The very same line of text ")]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA)
    assert sorted((r["doc_id"], r["text"]) for r in dedup_lines(df).collect()) == [(1, rows[0][1]), (1, rows[0][1]), (2, "")]
    assert dedup_lines(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "same line here", "q", 1), (3, "same line here", "q", 1)], SCHEMA)
    assert {r["doc_id"]: r["text"] for r in dedup_lines(null).collect()} == {None: "same line here", 3: ""}


def test_one_id_with_several_texts(spark):
    """Each text loses its own lines; the shorter comes first in the table."""
    rows = [(7, "short one here"), (7, "quite another first line\nsomething that repeats in this one\nthe last line of it"), (7, "something that repeats in this one"), (8, "the last line of it\nshort one here"), (None, "null has this line\nand this"), (None, "and this")]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in dedup_lines(df).collect()]
    assert sorted(d or 0 for d, _ in got) == [0, 0, 7, 7, 7, 8]
    lines = [x for _, t in rows for x in t.split("\n")]
    assert sorted(x for _, t in got for x in t.split("\n") if x) == sorted(set(lines))
    assert [t for d, t in got if d == 8] == [""]


def test_names_that_clash(spark):
    names = "doc_id long, text string, __lines string, line_doc long, LINE_PLACE long, line_numbers long, id long, t long, keeper long"
    df = spark.createDataFrame([(1, "a line that is there twice\nx y", "k", *range(6)), (2, "A line that is there twice\nz", "k", *range(6))], names)
    out = dedup_lines(df)
    assert out.columns == df.columns and sorted(tuple(r) for r in out.collect()) == [(1, "a line that is there twice\nx y", "k", *range(6)), (2, "z", "k", *range(6))]


def test_guards_are_a_second_hash():
    lines = ["pppp ooo", "qqqq rrr", "pppp ooo", "\U0001f600 x", "ooo pppp", "\U0001f601 x"]
    h, alone = LineHashes(lines, 8), [LineHashes([x], 8) for x in lines]
    assert len(set(h.guards.tolist())) == len(set(h.ids.tolist())) == 5 and not set(h.guards.tolist()) & set(h.ids.tolist())
    assert h.guards.tolist() == [int(a.guards[0]) for a in alone] and h.ids.tolist() == [int(a.ids[0]) for a in alone]


def test_many_lines_go_in_order(spark):
    """A document that loses thousands of its lines keeps the others in their order."""
    text = "\n".join(x for i in range(3000) for x in (f"own line number {i} with words w{i * 7919}", f"shared words {i} of the other s{i * 104729}"))
    first = "\n".join(f"shared words {i} of the other s{i * 104729}" for i in range(3000))
    df = spark.createDataFrame([(1, first, "q", 1), (2, text, "q", 1)], SCHEMA)
    s = LineDup(percent=100)
    got = {r["doc_id"]: r["text"] for r in dedup_lines(df, s).collect()}
    assert got == {1: first, 2: "\n".join(f"own line number {i} with words w{i * 7919}" for i in range(3000))}


def test_hashes_a_cores_cache_at_once(monkeypatch):
    """However much text comes at once, few lines are hashed together; their hashes are as before."""
    rnd = random.Random(2)
    own = ["".join(rnd.choice("abcdefgh é") for _ in range(rnd.choice((3, 40, 900)))).strip() or "x" for _ in range(2000)]
    own = [*dict.fromkeys(own), "z" * 200_000, "last one"]
    whole, seen, plain = LineHashes(own, 8), [], line_module.LineHashes

    def counted(some, size):
        seen.append(some)
        return plain(some, size)

    monkeypatch.setattr(line_module, "LineHashes", counted)
    texts = pa.array(["\n".join(own[k : k + 20]) for k in range(0, len(own), 20)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), texts], ["doc", "t", "text"])
    read = list(line_module._read(iter([batch]), LineDup(), 4))
    signed = list(line_module._signed(iter([pa.RecordBatch.from_arrays([pa.array(range(len(own))), pa.array(own)], ["id", "line"])]), LineDup()))
    assert [x for some in seen for x in some] == own * 2
    assert all(len(some) == 1 or sum(map(len, some)) <= 1 << 16 for some in seen)
    rows = [np.frombuffer(d, np.int64).reshape(5, -1) for b in read for p, d in zip(*(c.to_pylist() for c in b.columns), strict=True) if 8 <= p < 12]
    assert sorted(zip(*(np.concatenate(rows, 1)[k].tolist() for k in (0, 4)), strict=True)) == sorted(zip(whole.ids.tolist(), whole.guards.tolist(), strict=True))
    mins = whole.minima(256, LineDup().seed)
    sigs = (mix(mins.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).T
    assert [x for b in signed for x in b.column(2).to_pylist()] == [x.tobytes() for x in sigs]


def test_numbers_of_lines_left_without_counting_characters(spark, tmp_path):
    rows = [(1, "Ünique first line here\n\U0001f600 shared line of some length\n"), (2, "\U0001f600 shared line of some length"), (3, None), (4, ""), (5, "\n\né")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["op10_fuzzy_line_dedup"](spark, str(tmp_path))
    assert {r["doc_id"]: (r["n_removed"], r["n_lines_left"], r["text"]) for r in out.collect()} == {1: (0, 3, rows[0][1]), 2: (1, 0, ""), 3: (0, 0, None), 4: (0, 0, ""), 5: (0, 3, rows[4][1])}
    assert not re.search(r"(?<!octet_)(?<!\w)length\(", out._jdf.queryExecution().optimizedPlan().toString())
