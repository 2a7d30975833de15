"""Substring deduplication: recurring passages are confirmed and compiled to automata, which locate them.

A window is ``WINDOW`` consecutive words. Words that a recurring window covers are
removed. To find the recurring windows without moving all of them, each is filed under
its minimizer, the least hash of its SEED-word phrases (the leftmost on ties): equal
windows have equal minimizers at equal places, so nothing is lost.

1. Map: consecutive windows with one minimizer make a segment; rows (seed, segment
   hash, place). Only segments whose seed recurs go on (a count and an equi-join).
2. Segments are grouped by (seed, hash) into kinds. Where a seed has several kinds, one
   representative of each is cut into its windows, and windows are counted over
   representatives; those of a kind that occurs more than once recur anyway.
3. Phrases are the first window of each run of recurring windows in a kind, and the last
   one where a document's run ends: they cover what all of the run's windows cover. The
   words of a phrase are fetched from two different occurrences and compared word for
   word; only phrases that are equal in both are confirmed.
4. Documents are dealt into shards of about ``SHARD`` characters. For each shard the
   distinct confirmed phrases of the kinds that occur anywhere in it are compiled to one
   Aho-Corasick automaton. It knows no places: every document of the shard that holds
   any recurring segment streams through it whole (others can hold no phrase), and every
   occurrence that it reports is removed.

Words are hashed where they lie in a block of texts, all at once.

Work and shuffles are in proportion to the input, as a phrase goes only to shards in
which its kind occurs. Candidate windows are compared by 128 bits of hash, phrases and
occurrences word for word. Counts are pre-aggregated on the map side, joins are
equi-joins that adaptive execution splits, and what is gathered for a document or shard
is bounded by its own text. Texts travel compressed.

A null text has no words. Repeated rows, and repeated or null ids, are documents of
their own. An empty table gives no rows. Other columns are not read, so that their
names can't clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, blocks, numbered, release_heap, sized, trim
from .words import BASE, mix, rolling, window_argmin, word_hashes

WINDOW, SEED = 35, 8
#: Characters of the documents that share an automaton, most windows of a segment, characters that are hashed together, and bytes that are returned at once.
SHARD, LONGEST, TEXTS, OUT = 2_000_000, 62, 1 << 20, 4 << 20


def segments(h: np.ndarray, n: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(seed, segment hash, document, first window, windows) of each run of windows with one minimizer.

    ``h`` has the hashes of the words of documents side by side, ``n`` their numbers of words.
    """
    w = rolling(h, window)
    begin = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), np.maximum(n - window + 1, 0))  # of each window inside one document
    own = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(n - window + 1, 0)) - np.maximum(n - window + 1, 0), np.maximum(n - window + 1, 0))
    if not len(doc):
        return (np.zeros(0, dtype=np.int64),) * 5
    g = begin[doc] + own
    s = rolling(h, seed)
    at = window_argmin(s, window - seed + 1)[g]
    # a run of windows with one minimizer is cut by how far before it they begin, which is the same wherever they occur
    part = (at - g) // LONGEST
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    last = np.append(first[1:], len(at)) - 1
    whole = mix(mix(w[g[first]]) * np.uint64(5) + w[g[last]] + (last - first).astype(np.uint64))
    key = s[at[first]] + part[first].astype(np.uint64) * np.uint64(BASE)
    return key.view(np.int64), whole.view(np.int64), doc[first], own[first], last - first + 1


def _packed(docs: DataFrame, text_col: str, kind: str = "", id_col: str = "") -> DataFrame:
    """(rid, [id,] z): the text, compressed for the way through a shuffle."""
    names = ["rid", "id", "z"] if id_col else ["rid", "z"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            *keys, text = batch.columns
            yield pa.RecordBatch.from_arrays([*keys, pa.array([z.compress((t.as_py() or "").encode()) for t in text], pa.binary())], names=names)

    return docs.select("rid", *([id_col] if id_col else []), text_col).mapInArrow(run, "rid long, " + (f"id {kind}, " if id_col else "") + "z binary")


def _all_segments(docs: DataFrame, text_col: str, window: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, sizes = batch.column(0).to_numpy(), pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0)
            for x, y in blocks(sizes.to_pylist(), TEXTS):
                n, (h,) = word_hashes([t or b"" for t in batch.column(1).slice(x, y - x).cast(pa.binary()).to_pylist()], 0)
                key, seg, doc, a, nw = segments(h, n, window, seed)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(seg), pa.array(rid[x:y][doc]), pa.array(a.astype(np.int32)), pa.array(nw.astype(np.int32))], names=["seed", "seg", "rid", "a", "nw"])
            trim()

    return docs.select("rid", text_col).mapInArrow(run, "seed long, seg long, rid long, a int, nw int")


def _windows(reps: DataFrame, window: int) -> DataFrame:
    """(w1, w2, cid, o, rid, pos): two hashes of each window of the listed segments, its place in the segment and in the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for x, y in blocks([len(data.as_py()) for data in batch.column(1)], TEXTS // 4):  # of packed bytes
                n, (one, two) = word_hashes([z.decompress(data) for data in batch.column(1).slice(x, y - x).to_pylist()], 0, 1)
                w1, w2 = rolling(one, window).view(np.int64), rolling(two, window).view(np.int64)
                lists = batch.column(2).slice(x, y - x)
                cid, a, nw = (c.to_numpy() for c in lists.flatten().flatten())
                doc = np.repeat(np.arange(y - x), pa.compute.list_value_length(lists).to_numpy())
                total = int(nw.sum())
                o = np.arange(total) - np.repeat(np.cumsum(nw) - nw, nw)
                pos = np.repeat(a, nw) + o
                at = np.repeat((np.cumsum(n) - n)[doc], nw) + pos
                cols = ((w1[at], "i8"), (w2[at], "i8"), (np.repeat(cid, nw), "i8"), (o, "i4"), (np.repeat(rid[x:y][doc], nw), "i8"), (pos, "i4"))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in cols], names=["w1", "w2", "cid", "o", "rid", "pos"])
            trim()

    return reps.select("rid", "z", "listed").mapInArrow(run, "w1 long, w2 long, cid long, o int, rid long, pos int")


def _spelled(asked: DataFrame, window: int) -> DataFrame:
    """(k1, k2, words): the words of the asked windows of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for data, listed in zip(batch.column(0), batch.column(1).to_pylist()):
                words = z.decompress(data.as_py()).split()
                rows += [(x["k1"], x["k2"], b" ".join(words[x["pos"] : x["pos"] + window])) for x in listed]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["k1", "k2", "words"])

    return asked.select("z", "listed").mapInArrow(run, "k1 long, k2 long, words binary")


def confirmed(docs: DataFrame, ws: Workspace, text_col: str, per: int, window: int = WINDOW, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(block, words): for each block of ``per`` documents, the phrases that occur in it and, word for word, at two places at least.

    And (block, rids): the documents of each block that hold a recurring segment at all.
    """
    every = ws.save(_all_segments(docs, text_col, window, seed), "segments")
    # counts are tables of their own: a join with an aggregate of the same keys would share its shuffle, which can't be split for a hot key
    seeds = sized(ws.save(every.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"), "seeds"))
    found = ws.save(every.join(seeds, "seed"), "found")
    ws.drop(every)
    ws.release()
    place = F.struct("rid", "a")
    kinds = ws.save(found.groupBy("seed", "seg", "nw").agg(F.count("*").alias("c"), F.min(place).alias("rep"), F.max(place).alias("other")).withColumn("cid", F.monotonically_increasing_id()), "kinds")
    mixed = sized(ws.save(kinds.groupBy("seed").agg(F.count("*").alias("d")).where("d > 1").select("seed"), "mixed"))
    packed = _packed(docs, text_col)
    reps = kinds.join(mixed, "seed").select(F.col("rep.rid").alias("rid"), F.struct("cid", F.col("rep.a").alias("a"), "nw").alias("x")).groupBy("rid").agg(F.collect_list("x").alias("listed"))
    release_heap(docs.sparkSession)  # the joins before have grown it, and texts need the memory now
    windows = ws.save(_windows(packed.join(reps, "rid"), window), "windows")
    ws.release()
    at = F.struct("rid", "pos")
    twice = ws.save(windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(at).alias("rep"), F.max(at).alias("other")).where("n > 1").drop("n"), "twice")
    hits = windows.join(sized(twice.select("w1", "w2")), ["w1", "w2"]).groupBy("cid").agg(F.collect_list(F.struct("o", "w1", "w2")).alias("hits"))
    # runs of recurring windows in a kind: where they begin, and where they end
    copied = kinds.where("c > 1").select("cid", "seed", "seg", "nw", F.array(F.struct(F.lit(0).alias("o"), F.col("cid").alias("k1"), F.lit(-1).cast("long").alias("k2"))).alias("heads"),
                                         F.array(F.struct((F.col("nw") - 1).alias("o"), F.col("cid").alias("k1"), F.lit(-2).cast("long").alias("k2"))).alias("tails"))
    edge = "transform(filter(hits, h -> not exists(hits, g -> g.o = h.o {} 1)), h -> struct(h.o as o, h.w1 as k1, h.w2 as k2))"
    partly = kinds.where("c = 1").join(hits, "cid").select("cid", "seed", "seg", "nw", F.expr(edge.format("-")).alias("heads"), F.expr(edge.format("+")).alias("tails"))
    runs = ws.save(copied.unionAll(partly), "runs")
    ws.drop(windows)
    # the last window of a segment is needed only where the document's next segment doesn't go on
    order = Window.partitionBy("rid").orderBy("a")
    placed = found.join(runs.select("cid", "seed", "seg", "nw", F.expr("exists(heads, h -> h.o = 0)").alias("on"), F.expr("exists(tails, h -> h.o = nw - 1)").alias("open")), ["seed", "seg", "nw"])
    placed = placed.withColumn("goes", F.coalesce((F.lead("a").over(order) == F.col("a") + F.col("nw")) & F.lead("on").over(order), F.lit(False)))
    placed = ws.save(placed.select("rid", F.expr(f"rid div {per}").alias("block"), "cid", (F.col("open") & ~F.col("goes")).alias("ends")), "placed")
    needed = ws.save(placed.select("block", "cid", "ends").distinct(), "needed")
    holding = placed.groupBy("block").agg(F.collect_set("rid").alias("rids"))  # at most ``per`` of a block
    ws.drop(found)
    ws.release()
    ends = F.expr("concat(heads, filter(tails, t -> ends or t.o < nw - 1))")
    keys = ws.save(needed.join(runs.select("cid", "nw", "heads", "tails"), "cid").select("block", F.explode(ends).alias("k")).select("block", "k.k1", "k.k2").distinct(), "keys")
    # two occurrences of each phrase, whose words are compared
    whole = kinds.where("c > 1").select(F.col("cid").alias("k1"), F.explode(F.expr("array(struct(-1L as k2, 0 as o), struct(-2L as k2, nw - 1 as o))")).alias("k"), "rep", "other")
    whole = whole.select("k1", "k.k2", F.explode(F.array("rep", "other")).alias("x"), F.col("k.o").alias("o")).select("k1", "k2", "x.rid", (F.col("x.a") + F.col("o")).alias("pos"))
    single = twice.select(F.col("w1").alias("k1"), F.col("w2").alias("k2"), F.explode(F.array("rep", "other")).alias("x")).select("k1", "k2", "x.rid", "x.pos")
    used = keys.select("k1", "k2").distinct()
    asked = whole.unionAll(single).join(used, ["k1", "k2"]).groupBy("rid").agg(F.collect_list(F.struct("k1", "k2", "pos")).alias("listed"))
    spelled = _spelled(packed.join(asked, "rid"), window).groupBy("k1", "k2").agg(F.min("words").alias("words"), F.max("words").alias("other"), F.count("*").alias("n"))
    phrases = ws.save(spelled.where("n = 2 and words = other").select("k1", "k2", "words"), "phrases")
    ws.drop(kinds)
    ws.drop(twice)
    ws.release()
    return keys.join(phrases, ["k1", "k2"]).select("block", "words"), holding


class Phrases:
    """An Aho-Corasick automaton over the distinct phrases of a shard."""

    def __init__(self, phrases: list[bytes]):
        self.numbers: dict[bytes, int] = defaultdict(count(1).__next__)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for p in phrases:
            self.automaton.add_word(tuple(map(self.numbers.__getitem__, p.split())))
        if self.numbers:
            self.automaton.make_automaton()

    def covered(self, words: list[bytes]) -> np.ndarray | None:
        """Which words an occurrence of a phrase covers; None if there is none."""
        if not self.numbers or not words:
            return None
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(tuple(map(self.numbers.get, words, repeat(0))))), dtype=np.int64)
        if not len(hits):
            return None
        ends, n = hits[::2], hits[1::2]
        edge = np.bincount(ends - n + 1, minlength=len(words) + 1)
        edge -= np.bincount(ends + 1, minlength=len(words) + 1)
        return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` is the words that stay, joined by one space, in UTF-8."""
    ws = Workspace(docs.sparkSession, "substrings")
    kind = docs.schema[id_col].dataType.simpleString()
    docs = numbered(docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)), ws)
    n, size = docs.agg(F.count("*"), F.sum(F.length(text_col))).first()
    per = max(1, SHARD * n // max(size or 0, 1))
    phrases, holding = confirmed(docs, ws, text_col, per, window, seed)
    release_heap(docs.sparkSession)
    ws.release()  # what the last step shuffled is held until its frames are gone
    block = F.expr(f"rid div {per}").alias("block")
    texts = _packed(docs, text_col, kind, id_col).select(block, F.lit(2).alias("part"), "rid", "id", "z")
    # a shard's phrases, and the numbers of the documents that need a look, come before its documents
    none = F.lit(None).cast(kind).alias("id")
    given = phrases.select("block", F.lit(0).alias("part"), F.lit(-1).cast("long").alias("rid"), none, F.col("words").alias("z"))
    asked = holding.select("block", F.explode("rids").alias("rid")).select("block", F.lit(1).alias("part"), "rid", none, F.lit(None).cast("binary").alias("z"))
    both = texts.unionAll(given).unionAll(asked)
    dealt = both.repartition("block").sortWithinPartitions("block", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, now, given, looks, automaton = zstandard.ZstdDecompressor(), None, set(), set(), None
        ids, counts, removed, left, size = [], [], [], [], 0

        def done(kind_of_id: pa.DataType) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(ids, kind_of_id), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])
            for x in (ids, counts, removed, left):
                x.clear()
            return out

        for batch in batches:
            for shard, part, rid, i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                if shard != now:
                    now, given, looks, automaton = shard, set(), set(), None
                if part == 0:
                    given.add(data.as_py())
                    continue
                if part == 1:
                    looks.add(rid)
                    continue
                if automaton is None:
                    automaton = Phrases(sorted(given))
                    given = set()
                words = z.decompress(data.as_py()).split()
                gone = automaton.covered(words) if rid in looks else None
                ids.append(i)
                counts.append(len(words))
                removed.append(0 if gone is None else int(gone.sum()))
                left.append(b" ".join(words if gone is None else compress(words, (~gone).tolist())))
                size += len(left[-1])
                if size > OUT:
                    yield done(batch.schema.types[3])
                    size = 0
            yield done(batch.schema.types[3])
            size = 0
            trim()

    return dealt.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept binary")
