"""Substring de-duplication with FM-indexes whose shards are made by content.

Documents aren't streamed past every shard, which would cost documents times shards.
A window of ``window`` words is dealt by its anchor, the least hash among its runs of
``gram`` words, so that equal windows meet in one shard. Neighbouring windows mostly
share their anchor and travel as one segment. Anchors that very many segments have are
put last in the order and the segments cut again, so that common passages no longer drag
their contexts into one shard.

Equal segments are one, found by a 128-bit hash: of its copies only the smallest document
can keep words. Where an anchor has several different segments, a shard's segments of
smaller documents are indexed by a compressed FM-index and those of larger documents are
streamed through it by backward search, which gives their matching statistics (of the
stretches whose runs of ``gram`` words all occur, as others can't hold a window); each
window that the index holds has the smallest document that holds it. Segments are ranked
by document within their anchor, and one round for each bit of the rank (those without it
indexed, those with it streamed) lets each meet all smaller ones. Windows whose smallest
document is smaller than their own are reported, and their words removed. An anchor with
more than ``shard_words`` words is cut into pieces, each two of which are a shard.

Cases: null texts have no words; texts of fewer words than a window keep all. Windows
repeated within one document stay. A row is known by its id and a hash of its text: rows
that repeat an id with other texts are one document, none of them smaller than another,
and each keeps its own words; repeated rows are treated alike. Very long texts are cut
into segments like others. Ids are integers; a null id is compared with nothing. Extra
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentide.llm.fmindex import FMIndex
from lumentide.llm.neardup import known
from lumentide.llm.shared import Shared, partitions, sized, with_facts
from lumentide.llm.textio import Words, blocks, inside, mix, ngram_hashes, place_of, range_hashes

_HOT = np.uint64(1 << 63)
#: anchors that are broadcast at most
_MOST_CUT = 20_000


@dataclass(frozen=True)
class Substrings:
    """``hot_share``: anchors with more than this share of all segments, and ``hot_least`` of them, come last; there are at most 1 / hot_share of them, which bounds what is broadcast."""

    window: int = 50
    gram: int = 8
    longest: int = 512
    hot_share: float = 1 / 20_000
    hot_least: int = 256
    shard_words: int = 600_000


def segments(words: np.ndarray, bounds: np.ndarray, s: Substrings, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor) of all segments of a block of documents."""
    starts = inside(bounds, s.window, len(words))
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    order = ngram_hashes(words, s.gram) >> np.uint64(1)
    if len(hot):
        place = np.minimum(np.searchsorted(hot, order), len(hot) - 1)
        order = order | np.where(hot[place] == order, _HOT, np.uint64(0))
    span, width = s.window - s.gram + 1, 1
    while width * 2 <= span:  # least of ever longer runs of grams
        order, width = np.minimum(order[:-width], order[width:]), width * 2
    if span > width:
        order = np.minimum(order[: width - span], order[span - width :])
    anchor = order[starts]
    fresh = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)))
    heads = np.flatnonzero(fresh)
    # runs of one anchor are cut after every ``longest`` windows
    behind = np.arange(len(starts)) - np.repeat(heads, np.diff(np.append(heads, len(starts))))
    heads = np.flatnonzero(behind % s.longest == 0)
    return starts[heads], np.diff(np.append(heads, len(starts))), anchor[heads] & ~_HOT


def _segment_rows(batches: Iterator[pa.RecordBatch], s: Substrings, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, texts in blocks(batches):
        w = Words(texts)
        words = w.hashes()
        first, n, anchor = segments(words, w.bounds, s, hot)
        if not len(first):
            continue
        owner = np.searchsorted(w.bounds, first, side="right") - 1
        seg = range_hashes(words, first, first + n + s.window - 1) + n.astype(np.uint64)
        columns = [pa.array(x) for x in (first - w.bounds[owner], n, anchor.view(np.int64), seg.view(np.int64))]
        rows = pa.array(owner)
        yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *columns], ["doc", "t", "start", "n", "anchor", "seg"])


def _anchor_rows(batches: Iterator[pa.RecordBatch], s: Substrings) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.uint64)
    for _, texts in blocks(batches):
        w = Words(texts)
        yield pa.RecordBatch.from_arrays([pa.array(segments(w.hashes(), w.bounds, s, none)[2].view(np.int64))], ["anchor"])


def _segment_texts(batches: Iterator[pa.RecordBatch], s: Substrings) -> Iterator[pa.RecordBatch]:
    """Input: doc, t, text, wanted (array of start, n, seg, anchor); repeated rows are in one task, and the first of them is enough. The words of each wanted segment, parted by spaces."""
    seen: set[tuple[int, int]] = set()
    for part, texts in blocks(batches):
        out: list[list] = [[] for _ in range(4)]
        wanted = part.column(part.schema.get_field_index("wanted"))
        for doc, t, text, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, wanted.to_pylist(), strict=True):
            if (doc, t) in seen:
                continue
            seen.add((doc, t))
            words = text.split()
            for x in own:
                for column, v in zip(out, (x["seg"], x["anchor"], doc, b" ".join(words[x["start"] : x["start"] + x["n"] + s.window - 1])), strict=True):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["seg", "anchor", "doc", "words"])


def search_shard(rows: list[tuple[int, int, bytes]], window: int, gram: int = 8) -> list[list[tuple[int, int]]]:
    """For each (anchor, document, words): runs (first window, windows) that a smaller document of the same anchor holds too, and perhaps more that one of another anchor holds."""
    parts = [w.split() for _, _, w in rows]
    codes: dict[bytes, int] = {}
    coded = [np.array([*(codes.setdefault(w, len(codes) + 1) for w in p), 0], np.int64) for p in parts]
    # runs of ``gram`` words; those that end a text hold its 0 and are like no other
    gram = min(gram, window)
    lengths = np.array([len(c) for c in coded])
    flat = mix(np.concatenate(coded).astype(np.uint64)) if coded else np.zeros(0, np.uint64)
    ends = np.cumsum(lengths) if len(lengths) else lengths
    grams = np.append(ngram_hashes(flat, gram), np.zeros(min(gram - 1, len(flat)), np.uint64))
    ranks, sizes = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    groups: dict[int, list[int]] = {}
    for k in sorted(range(len(rows)), key=lambda k: rows[k][1]):
        groups.setdefault(rows[k][0], []).append(k)
    for members in groups.values():
        ranks[members], sizes[members] = np.arange(len(members)), len(members)
    owner, taken = np.repeat(np.arange(len(rows)), lengths), np.zeros(len(flat), bool)
    place = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
    inside = place + gram < np.repeat(lengths, lengths)  # the run ends before the text does
    for bit in range(int(sizes.max(initial=1) - 1).bit_length()):
        upper, some = ranks >> bit & 1 == 1, sizes > 1 << bit
        held, streamed = (some & ~upper)[owner], (some & upper)[owner]
        # a window can only be held where all its runs are; other stretches needn't be streamed
        known = np.unique(grams[held & inside])
        if not len(known):
            continue
        at = np.flatnonzero(streamed & inside)
        seen = np.zeros(len(flat) + 1, bool)
        seen[at] = known[np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)] == grams[at]
        edges = np.flatnonzero(seen[1:] != seen[:-1]) + 1
        starts, stops = (np.insert(edges, 0, 0) if seen[0] else edges).reshape(-1, 2).T
        long = stops - starts >= window - gram + 1
        starts, stops = starts[long], stops[long] + gram - 1
        if not len(starts):
            continue
        symbols = np.concatenate(coded)
        documents = np.array([d for _, d, _ in rows], np.int64)
        index = FMIndex(symbols[held], len(codes) + 1, window, documents[owner[held]])
        _, windows = index.statistics(symbols, starts, stops)
        found = np.flatnonzero(windows >= 0)
        taken[found[index.least[windows[found]] < documents[owner[found]]]] = True
    out = []
    for own in np.split(taken, ends[:-1]) if len(rows) else ():
        edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
        out.append([(int(x), int(y - x)) for x, y in edges.reshape(-1, 2)])
    return out


def _hot(counts: DataFrame, s: Substrings) -> np.ndarray:
    """Sorted anchors that come last. Each has more than ``hot_share`` of all segments, so there are at most 1 / hot_share."""
    total = counts.agg(F.sum("count")).first()[0] or 0
    rows = counts.where(F.col("count") > max(s.hot_least, s.hot_share * total)).select("anchor").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _search_groups(group: pd.DataFrame, s: Substrings) -> pd.DataFrame:
    found = search_shard(list(zip(group["anchor"].tolist(), group["doc"].tolist(), group["words"].tolist(), strict=True)), s.window, s.gram)
    rows = [(seg, anchor, x, n) for seg, anchor, runs in zip(group["seg"], group["anchor"], found, strict=True) for x, n in runs]
    return pd.DataFrame(rows, columns=["seg", "anchor", "at", "count"]).astype("int64")


#: rows that one task of a join with the texts takes
_ROWS_A_PART = 50_000


def repeated_windows(docs: DataFrame, s: Substrings = Substrings(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(doc, t, runs): for each document with repeated windows, by its id and text's place, runs (start, count) of windows that a smaller document holds; and how many parts a join with the texts should have."""
    spark, shared = docs.sparkSession, Shared(docs.sparkSession, "substrings")
    plain = docs.select(F.col(id_col).cast("long").alias("doc"), place_of(F.col(text_col)).alias("t"), F.col(text_col).alias("text")).where("doc IS NOT NULL")
    counts = plain.select("text").mapInArrow(lambda it: _anchor_rows(it, s), "anchor long").groupBy("anchor").count()
    hot = _hot(shared.write(counts, "anchors"), s)
    shared.drop("anchors")
    segs = plain.mapInArrow(lambda it: _segment_rows(it, s, hot), "doc long, t long, start long, n long, anchor long, seg long")
    segs = shared.write(segs, "segments")
    all_segs = segs.count()
    many = sized(spark, all_segs, 10 * _ROWS_A_PART)
    # the anchor is a second hash of the segment: together 128 bits
    least = segs.groupBy("seg", "anchor").agg(F.min(F.struct("doc", "t", "start", "n")).alias("first"), F.count("*").alias("copies"))
    least = shared.write(least.select("seg", "anchor", "copies", "first.*"), "least")

    # anchors with several segments, their words, and into how many pieces they are cut
    words = F.sum(F.col("n") + s.window - 1)
    several = least.groupBy("anchor").agg(F.count("*").alias("segments"), words.alias("words")).where("segments > 1")
    several = shared.write(several.select("anchor", "segments", "words", (1 + F.floor(F.col("words") * 2 / s.shard_words)).alias("pieces")), "several")
    total = several.agg(F.coalesce(F.sum("segments"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    shards = max(1, 2 * total[1] // s.shard_words)
    different = with_facts(least, several, ["anchor"], "segments", all_segs).where("segments IS NOT NULL").select("doc", "t", F.struct("start", "n", "seg", "anchor").alias("want"))
    wanted = different.groupBy("doc", "t").agg(F.collect_list("want").alias("wanted"))
    texts = plain.repartition(many, "doc", "t").join(wanted.repartition(many, "doc", "t"), ["doc", "t"]).select("doc", "t", "text", "wanted")
    texts = texts.mapInArrow(lambda it: _segment_texts(it, s), "seg long, anchor long, doc long, words binary")
    # only the few anchors that are cut need to be told apart; there are at most 2 * words / shard_words of them
    cut = several.where("pieces > 1").select("anchor", "pieces")
    texts = texts.join(F.broadcast(cut) if cut.count() <= _MOST_CUT else cut, "anchor", "left")
    own = F.pmod(F.xxhash64("seg"), F.col("pieces"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), lambda k: k != own)
    meeting = F.when(F.col("pieces").isNull(), F.array(F.struct(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), F.lit(-1).cast("long").alias("one"), F.lit(-1).cast("long").alias("two"))))
    meeting = meeting.otherwise(F.transform(others, lambda k: F.struct(F.col("anchor").alias("shard"), F.least(own, k).alias("one"), F.greatest(own, k).alias("two"))))
    dealt = texts.select("seg", "anchor", "doc", "words", F.explode(meeting).alias("m")).select("seg", "anchor", "doc", "words", "m.*")
    # a task for about each shard, as their work is much for their bytes
    dealt = dealt.repartition(max(partitions(spark), shards), "shard", "one", "two")
    found = dealt.groupBy("shard", "one", "two").applyInPandas(lambda g: _search_groups(g, s), "seg long, anchor long, at long, count long")
    found = shared.write(found.groupBy("seg", "anchor").agg(F.collect_set(F.struct("at", "count")).alias("runs")), "found")

    # copies of the smallest document's segment lose all its windows, that document's own lose those that were found
    marked = least.join(found, ["seg", "anchor"], "left").where("copies > 1 OR runs IS NOT NULL").select("seg", "anchor", "copies", F.col("doc").alias("least"), "runs")
    marked = shared.write(marked, "marked")
    shared.keep("segments", "marked")
    whole = F.array(F.struct("start", F.col("n").alias("count")))
    moved = F.transform("runs", lambda r: F.struct((r["at"] + F.col("start")).alias("start"), r["count"].alias("count")))
    hits = with_facts(segs, marked, ["seg", "anchor"], "copies", all_segs).where("copies IS NOT NULL").select("doc", "t", F.when(F.col("doc") > F.col("least"), whole).otherwise(moved).alias("runs")).where("runs IS NOT NULL")
    return hits.groupBy("doc", "t").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs")), many


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Input: id, text, runs. Rows: id, words, removed, spans kept (start, count)."""
    for part, texts in blocks(batches):
        runs = part.column(part.schema.get_field_index("runs")).to_pylist()
        counts, removed, kept = [], [], []
        for text, own in zip(texts, runs, strict=True):
            words = (text or b"").split()
            counts.append(len(words))
            if own:
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, [r["start"] for r in own], 1)
                np.add.at(cover, [r["start"] + r["count"] + window - 1 for r in own], -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            else:
                removed.append(0)
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])


def dedup_substrings(docs: DataFrame, s: Substrings = Substrings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    runs, many = repeated_windows(docs, s, id_col, text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), known(F.col(id_col)).alias("doc"), place_of(F.col(text_col)).alias("t"))
    joined = keyed.repartition(many, "doc", "t").join(runs.repartition(many, "doc", "t"), ["doc", "t"], "left")
    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.select("id", "text", "runs").mapInArrow(lambda it: _kept(it, s.window), f"id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
