from __future__ import annotations

import random

import numpy as np
import pytest

from lumentide.llm.components import components
from lumentide.llm.neardup import NearDup, band_keys, drop_near_duplicates, minima, near_duplicates, shingle_sets
from lumentide.llm.neighbours import BLOCK, Dealer, Members, Roots, SetCache, Similarity, buckets, confirmed, in_blocks, likely_pairs, linked_components
from lumentide.llm.shared import Shared

SCHEMA = "doc_id long, text string, key string, component long, gone long"


def words_of(text):
    return (text or "").encode().lower().split()


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(rows[x][0]), root(rows[y][0])))
                parent[b] = a
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True)}


def corpus(seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows, bases = [], []
    for _ in range(12):
        bases.append([rnd.choice(vocab) for _ in range(rnd.choice((8, 60, 300)))])
    for i in range(150):
        w = list(rnd.choice(bases)) if i % 3 else [rnd.choice(vocab) for _ in range(80)]
        for _ in range(rnd.randrange(8)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "x " * 30000), (207, rows[5][1]), (208, rows[5][1].upper())]
    return rows


@pytest.mark.parametrize("size", [4, 5])
def test_matches_brute_force(spark, size):
    rows = corpus()
    df = spark.createDataFrame([(*r, "k", 7, 8) for r in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component"], r["kept"]) for r in near_duplicates(df, NearDup(shingle=size)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(rows, size, 80).items()}


def test_drop_keeps_columns_and_one_of_each(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(*r, "k", 7, 8) for r in rows], SCHEMA)
    out = drop_near_duplicates(df, NearDup())
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == {c for _, c in brute(rows, 5, 80).values()}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    rnd = random.Random(1)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3)]
    links = path + star
    rnd.shuffle(links)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Shared(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}}


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_with_hot_nodes_and_uncontracted_links(spark, monkeypatch, few):
    """Stars wider than what counts as hot, joined by a path, with nothing contracted before."""
    from pyspark.sql import functions as F

    from lumentide.llm import components as module

    monkeypatch.setattr(module, "FEW", few)
    monkeypatch.setattr(module, "_contracted", lambda batches: (module._edges(np.stack([np.maximum(*t), np.minimum(*t)])) for b in batches for t in [[b.column(k).to_numpy() for k in range(2)]]))
    links = [(1000 + h, 5000 + 300 * h + i) for h in range(8) for i in range(300)] + [(1000 + h, 1001 + h) for h in range(5)] + [(i, i + 1) for i in range(30)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(4, F.rand(1)), Shared(spark, "t")).collect()}
    hubs = {1000 + h: 1000 if h < 6 else 1000 + h for h in range(8)}
    want = {**{i: 0 for i in range(1, 31)}, **{h: r for h, r in hubs.items() if h != r}, **{5000 + 300 * h + i: hubs[1000 + h] for h in range(8) for i in range(300)}}
    assert got == want


def test_nulls_and_repeated_ids(spark):
    """One id with two texts is one document, which joins what both are like; null ids are linked by their texts."""
    rnd = random.Random(8)
    texts = [" ".join(f"v{rnd.randrange(9999)}" for _ in range(60)) for _ in range(6)]
    near = lambda k: texts[k] + " more"
    rows = [(1, texts[0]), (2, texts[1]), (3, near(0)), (3, near(1)), (3, near(1)), (3, ""), (4, texts[2]), (None, near(2)), (None, texts[2]), (None, texts[3]), (None, near(3)), (None, None), (5, texts[4]), (5, texts[4])]
    df = spark.createDataFrame([(*r, "k", 7, 8) for r in rows], SCHEMA).repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"] > 0, r["component"], r["kept"]) for r in near_duplicates(df).collect()), key=repr)
    want = [(1, True, 1, True), (2, True, 1, False), *[(3, True, 1, False)] * 3, (3, False, 3, True), (4, True, 4, True), *[(None, True, 4, False)] * 2, *[(None, True, None, True)] * 2, (None, False, None, True), *[(5, True, 5, True)] * 2]
    assert got == sorted(want, key=repr)
    kept = sorted(((r["doc_id"], r["text"]) for r in drop_near_duplicates(df).collect()), key=repr)
    assert kept == sorted([(1, texts[0]), (3, ""), (4, texts[2]), (None, texts[3]), (None, near(3)), (None, None), (5, texts[4]), (5, texts[4])], key=repr)


def test_names_that_clash(spark):
    names = "doc_id long, text string, id long, t long, n long, row long, gone_id long, GONE_T long, component long"
    df = spark.createDataFrame([(i, f"the same words in all of them here {i // 9}", *range(7)) for i in range(3)], names)
    assert near_duplicates(df).where("kept").count() == 1
    out = drop_near_duplicates(df)
    assert out.columns == df.columns and [r["doc_id"] for r in out.collect()] == [0]


HOW = Similarity(lambda texts: shingle_sets(texts, 1), 60, 2)
PARTS = 8


def dealt(spark, *tasks):
    """What ``Dealer`` gives for the (key, id) rows of each task."""
    rows = []
    for keys, ids in tasks:
        dealer = Dealer(PARTS)
        for batch in (*dealer.add(np.asarray(keys, np.int64), np.asarray(ids, np.int64)), *dealer.dealt()):
            rows += [(r["part"], bytearray(r["data"])) for r in batch.to_pylist()]
    return spark.createDataFrame(rows, "part long, data binary")


def lists(*keys):
    return bytearray(np.array(keys, np.int64).tobytes())


@pytest.mark.parametrize("tasks", [[([0, 0, 0, 0], [1, 3, 2, 2])], [([0, 0], [1, 3]), ([0, 0], [2, 2])]])
def test_link_that_no_pivot_has_is_found(spark, tasks):
    """In one bucket of three, the first member is linked with neither of the two that are linked."""
    items = spark.createDataFrame([(1, lists(0), bytearray(b"axyz"), "p q r"), (2, lists(0), bytearray(b"abyz"), "k l m"), (3, lists(0), bytearray(b"abcd"), "k l m n")], "id long, keys binary, sig binary, text string")
    found = linked_components(buckets(dealt(spark, *tasks), PARTS), lambda ids: items.join(ids, "id"), HOW, Shared(spark, "t"))
    assert [tuple(r) for r in found.collect()] == [(3, 2)]


def test_link_is_kept_where_only_signature_bytes_meet_earlier(spark):
    """The linked pair has one byte, but not one key, in band 0, so only the bucket of band 1 has it."""
    items = spark.createDataFrame([(i, lists(100 + i, 1), bytearray(s), t) for i, s, t in ((1, b"xbyz", "p q r"), (2, b"abyz", "k l m"), (3, b"abcd", "k l m n"))], "id long, keys binary, sig binary, text string")
    found = linked_components(buckets(dealt(spark, ([1] * 4, [1, 3, 2, 2])), PARTS), lambda ids: items.join(ids, "id"), HOW, Shared(spark, "t"))
    assert [tuple(r) for r in found.collect()] == [(3, 2)]


def test_given_links_join(spark):
    items = spark.createDataFrame([(i, lists(0), bytearray(b"abcd"), "k l m" if i < 3 else "p q r") for i in range(1, 5)], "id long, keys binary, sig binary, text string")
    given = spark.createDataFrame([(2, 9), (9, 3)], "a long, b long")
    found = linked_components(buckets(dealt(spark, ([0] * 4, [1, 2, 3, 4])), PARTS), lambda ids: items.join(ids, "id"), HOW, Shared(spark, "t"), given)
    assert {r["id"]: r["component"] for r in found.collect()} == {2: 1, 3: 1, 4: 1, 9: 1}


def members(ids, groups, asks, sigs, keys, texts, visits=False):
    return Members(ids, groups, asks, np.full(len(ids), visits), sigs, keys, texts)


def test_keys_tell_the_first_shared_band():
    """Real minima: each linked pair is looked at in exactly the first band whose key both have, also if the bytes of an earlier one agree."""
    rng, pairs = np.random.default_rng(2), 300
    sets = [np.unique(rng.integers(0, 1 << 57, 40, dtype=np.uint64)) for _ in range(pairs)]
    flat = [x for s in sets for x in (s, np.unique(np.append(s[4:], rng.integers(0, 1 << 57, 2, dtype=np.uint64))))]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in flat])))
    mins = minima(np.concatenate(flat), bounds, 32, 1)
    keys, sigs = band_keys(mins, 32, 1).view(np.int64), (mins.T & np.uint64(3)).astype(np.uint8)  # bytes of two bits collide often
    how = Similarity(lambda texts: (np.concatenate([flat[0][:0], *(flat[int(t)] for t in texts)]), np.concatenate(([0], np.cumsum([len(flat[int(t)]) for t in texts])))), 80, 0)
    seen = 0
    for p in range(pairs):
        x, y = 2 * p, 2 * p + 1
        same = np.flatnonzero(keys[x] == keys[y])
        if len(same) and how.linked(flat[x], flat[y]):
            seen += 1
            both = members(np.array([x, y]), np.array([x, y]), np.array([True, False]), sigs[[x, y]], keys[[x, y]], [str(x).encode(), str(y).encode()])
            assert [len(likely_pairs(int(b), both, both, how)) for b in same[:2]] == [1, 0][: len(same)]
    assert seen > 200


def mixed_bucket(n=1400, seed=0):
    """Items of one bucket: many of one group, others of small groups, some of which are like it or each other."""
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 99, 8) for _ in range(6)]
    sets = [sorted({int(v) if rng.random() < 0.9 else int(rng.integers(100, 999)) for v in base[i % 6]}) for i in range(n)]
    groups = np.where(rng.random(n) < 0.9, 7, 1000 + rng.integers(0, 60, n))
    return groups, sets, [" ".join(map(str, s)) for s in sets]


def united(groups, pairs):
    parent = {int(g): int(g) for g in groups}

    def root(g):
        while parent[g] != g:
            g = parent[g]
        return g

    for x, y in pairs:
        parent[root(int(groups[x]))] = root(int(groups[y]))
    return {frozenset(g for g in parent if root(g) == root(h)) for h in parent}


def test_likely_and_confirmed_join_what_all_pairs_join():
    groups, sets, texts = mixed_bucket(300)
    n = len(groups)
    every = [(x, y) for x in range(n) for y in range(x) if 100 * len(set(sets[x]) & set(sets[y])) >= 60 * len(set(sets[x]) | set(sets[y]))]
    m = members(np.arange(n), groups, groups != 7, np.zeros((n, 4), np.uint8), np.zeros((n, 2), np.int64), [t.encode() for t in texts])
    pairs = likely_pairs(0, m, m, HOW)
    assert len({(min(x, y), max(x, y)) for _, x, y in pairs.tolist()}) == len(pairs) and not len(likely_pairs(1, m, m, HOW))
    links = confirmed(pairs, m, m, HOW, Roots(), SetCache(HOW))
    assert united(groups, links) == united(groups, every) and len(links) < len(set(groups.tolist()))


@pytest.mark.parametrize("pad", ["", " " * 40])
def test_mixed_bucket_of_many_blocks(spark, pad):
    """Askers visit the blocks of the others: what is joined is what all pairs join, also where signatures go before long texts."""
    groups, sets, texts = mixed_bucket(900)
    texts = [t + pad for t in texts]
    n = len(groups)
    assert n > 2 * BLOCK
    chain = [(int(x), int(y)) for g in set(groups.tolist()) for m in [np.flatnonzero(groups == g)] for x, y in zip(m[1:], m)]
    every = [(x, y) for x in range(n) for y in range(x) if 100 * len(set(sets[x]) & set(sets[y])) >= 60 * len(set(sets[x]) | set(sets[y]))]
    items = spark.createDataFrame([(i, lists(0), bytearray(b"abcd"), t) for i, t in enumerate(texts)], "id long, keys binary, sig binary, text string")
    tasks = [([0] * len(part), part) for part in np.array_split(np.arange(n), 5)]
    found = linked_components(buckets(dealt(spark, *tasks), PARTS), lambda ids: items.join(ids, "id"), HOW, Shared(spark, "t"), spark.createDataFrame(chain, "a long, b long"))
    root = {r["id"]: r["component"] for r in found.collect()}
    got = {}
    for i in range(n):
        got.setdefault(root.get(i, i), set()).add(int(groups[i]))
    assert {frozenset(g) for g in got.values()} == united(groups, every)


def test_buckets_in_pieces_and_tasks(spark):
    """A part that comes in pieces gives the same buckets; every member hangs together by pivots; one id from several tasks is no bucket."""
    rng = np.random.default_rng(4)
    keys, ids = np.append(rng.integers(0, 60, 500), [900] * 30) * 64, np.append(rng.integers(0, 200, 500), [5] * 30)
    order = rng.permutation(530)
    keys, ids = keys[order], ids[order]
    df = dealt(spark, *[(keys[at : at + 25], ids[at : at + 25]) for at in range(0, 530, 25)])
    want = {}
    for k, i in zip(keys.tolist(), ids.tolist(), strict=True):
        want.setdefault(k, set()).add(i)
    want = {k: v for k, v in want.items() if len(v) > 1}
    for held in (1 << 24, 60):
        got, pairs = {}, {}
        for r in buckets(df, PARTS, held).collect():
            got.setdefault(r["key"], set()).add(r["id"])
            pairs.setdefault(r["key"], []).append((r["id"], r["pivot"]))
        assert got == want
        for k, links in pairs.items():
            assert len(united(sorted(got[k]), [(sorted(got[k]).index(a), sorted(got[k]).index(b)) for a, b in links])) == 1


def test_components_from_pieces(spark):
    items = spark.createDataFrame([(i, lists(0), bytearray(b"abcd"), f"k l m n{i % 7}") for i in range(40)], "id long, keys binary, sig binary, text string")
    df = dealt(spark, *[([0] * 4, range(at, at + 4)) for at in range(0, 40, 4)])
    for held in (1 << 24, 20):
        found = linked_components(buckets(df, PARTS, held), lambda ids: items.join(ids, "id"), HOW, Shared(spark, "t"))
        assert {r["id"]: r["component"] for r in found.collect()} == {i: 0 for i in range(1, 40)}


def test_rows_sent_to_blocks_grow_less_than_with_the_square(spark):
    """A bucket of which all members ask: four times the members are sent eight times as often, not sixteen; each meets all blocks, one of them at home."""
    from pyspark.sql import functions as F

    sent = []
    for n in (BLOCK * 16, BLOCK * 64):
        rows = spark.range(n).select(F.lit(5).cast("long").alias("key"), "id", F.col("id").alias("component"), F.lit(True).alias("asks"), F.lit(0.0).alias("thousands"))
        placed = in_blocks(rows, Shared(spark, "t"))
        blocks = placed.select("block").distinct().count()
        assert placed.count() == placed.select("id", "block").distinct().count() == n * blocks and placed.where("NOT visits").count() == n
        sent.append(n * blocks)
    assert sent[1] < 9 * sent[0]


def test_blocks_with_too_long_texts_are_cut(spark, monkeypatch):
    """Blocks of likely rows in parts of few texts join what all pairs join."""
    from lumentide.llm import neighbours

    cut = []
    whole = neighbours.cut_blocks
    monkeypatch.setattr(neighbours, "BLOCK_THOUSANDS", 20)
    monkeypatch.setattr(neighbours, "cut_blocks", lambda likely, shared: cut.append((likely.select("key", "block").distinct().count(), (out := whole(likely, shared)).select("key", "block").distinct().count())) or out)
    test_mixed_bucket_of_many_blocks(spark, " " * 400)
    assert cut and cut[0][1] > 2 * cut[0][0]
