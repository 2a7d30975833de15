"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2h bits have a common variant within h bits of
both. Every distinct fingerprint (copies collapse first) emits all its variants within
h bits; rows meet by variant in one shuffle. All fingerprints in a variant's group lie
within h bits of it, so within 2h of each other: linking each with the least of its
group loses no connection, and a group has at most as many rows as the ball has
variants (65 for h = 1), whatever the data. Links are verified and deduplicated, then
components are found over fingerprints, never over documents.

``near_copies`` is for the general rule, a Jaccard similarity of five-word shingles of at
least 0.8, which puts the fingerprints of whole texts some 10 bits apart, out of reach of
a ball. So each text has further fingerprints, of ``BAGS`` bags of ``BAG`` shingles that
are least by as many hashes; texts of similarity s have an equal bag with probability
1 - (1 - s ** BAG) ** BAGS, 0.9998 at 0.8. Rows meet by bag (and whole texts by ball);
each is compared, exactly, with the member of its group that has most company in all of
its groups, as the original of many copies has, and those that aren't similar to it meet
again without it, as long as that finds anything.

A null text counts as empty; texts without words have the fingerprint zero and are
linked like any other. Repeated rows and ids keep a row each. An empty table gives no
rows. Only the named columns are read and returned, so that others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, sized, small_batches, trim
from .components import components
from .words import WordHashes, mix, rolling

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Of ``near_copies``: words of a shingle, least similarity, bags of a text and shingles of a bag, shingles that are hashed at once.
WORDS, SIMILARITY, BAGS, BAG, RUN = 5, 0.8, 12, 3, 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of UTF-8 text."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(length) - 1
    begins = (ends + 1 - length)[:n].tolist()
    stops = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    digest, seed = xxhash.xxh64_intdigest, SEED
    h = np.array([digest(joined[a:b], seed) for a, b in zip(begins, stops)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 4096):
        ones += np.unpackbits(h[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = None) -> DataFrame:
    """(id, fp[, rid]): fp is the fingerprint as a signed long."""
    cols = [F.col(id_col), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("t"), *([F.col(rid_col)] if rid_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), dtype=np.uint64, count=len(batch)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], names=["id", "fp", *(["rid"] if rid_col else [])])
            trim()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(*cols).mapInArrow(run, f"id {kind}, fp long" + (", rid long" if rid_col else ""))


def ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): verified links among distinct fingerprints ``fp`` that connect all within ``radius`` bits."""
    if radius % 2:
        raise ValueError("the radius has to be even: half of it is the radius of a ball")
    masks = [0, *(sum(1 << i for i in c) for k in range(1, radius // 2 + 1) for c in combinations(range(64), k))]
    signed = ", ".join(f"{m - (1 << 64) if m >> 63 else m}L" for m in masks).replace("-9223372036854775808L", "shiftleft(1L, 63)")
    variants = fps.select("fp", F.explode(F.expr(f"transform(array({signed}), m -> fp ^ m)")).alias("v"))
    least = F.expr("min(fp) over (partition by v)")
    return variants.select("fp", least.alias("b")).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, rid_col: str | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id, keep_rid[, rid]), a row for each row of ``docs``.

    component_id is the smallest id that is reachable, keep_rid (null without ``rid_col``) the rid of one such row.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    with small_batches(docs.sparkSession):
        rows = ws.save(fingerprints(docs, id_col, text_col, rid_col), "rows")
    least = F.struct(F.col("id").isNull().alias("none"), "id", (F.col("rid") if rid_col else F.lit(None).cast("long")).alias("rid"))
    fps = ws.save(rows.groupBy("fp").agg(F.min(least).alias("least")), "fps")
    roots = components(ball_links(fps.select("fp"), radius), ws)
    classed = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = classed.groupBy("root").agg(F.min("least").alias("first"))
    classes = ws.save(classed.join(first, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.rid").alias("keep_rid")), "classes")
    return rows.join(classes, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "keep_rid", *(["rid"] if rid_col else [])
    )


def shingle_set(text: bytes, hashes: WordHashes, size: int = WORDS) -> np.ndarray:
    """The distinct hashes of the text's shingles; fewer words are one shingle, none is none."""
    words = text.lower().split()
    return np.unique(rolling(hashes(words), min(size, len(words)))) if words else np.zeros(0, dtype=np.uint64)


_SALTS = mix(np.arange(1, BAGS * BAG + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def bags(shingles: np.ndarray) -> np.ndarray:
    """A fingerprint of each bag."""
    least = np.full(BAGS * BAG, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), RUN):
        least = np.minimum(least, mix(shingles[None, a : a + RUN] ^ _SALTS).min(axis=1))
    out = np.zeros(BAGS, dtype=np.uint64)
    for part in least.reshape(BAGS, BAG).T:
        out = mix(out * np.uint64(3) + part)
    return out.view(np.int64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, rid_col: str) -> DataFrame:
    """(id, rid, fp, bags): the fingerprints of the whole text and of its bags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            fp = np.fromiter((fingerprint(t) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
            every = [bags(shingle_set(t, hashes)) for t in texts]
            flat = pa.array(np.concatenate(every) if every else np.zeros(0, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BAGS, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), lists], names=["id", "rid", "fp", "bags"])
            trim()

    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    return docs.select(id_col, rid_col, text.alias("t")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, rid long, fp long, bags array<long>")


def _sets(docs: DataFrame, text_col: str, rid_col: str) -> DataFrame:
    """(rid, s): the shingle sets of some documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            every = [shingle_set(t.as_py(), hashes).view(np.int64) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, every)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(every) if every else np.zeros(0, dtype=np.int64)))], names=["rid", "s"])
            trim()

    return docs.select(rid_col, F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("t")).mapInArrow(run, "rid long, s array<long>")


def near_copies(docs: DataFrame, rid_col: str, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(rid, keep_rid) of the rows that are in a group with others: the components of pairs whose similarity is at least ``least``.

    keep_rid is the rid of the row with the smallest id of the group, then the smallest rid.
    """
    ws = Workspace(docs.sparkSession, "near")
    with small_batches(docs.sparkSession):
        rows = ws.save(_sketches(docs, id_col, text_col, rid_col), "rows")
    fps = ws.save(rows.groupBy("fp").agg(F.min("rid").alias("first")), "fps")
    same = rows.join(fps, "fp").where("rid <> first").select(F.col("rid").alias("a"), F.col("first").alias("b"))
    close = ball_links(fps.select("fp"), radius)
    for x in ("a", "b"):
        close = close.join(fps.select(F.col("fp").alias(x), F.col("first").alias(f"r{x}")), x)
    balls = ws.save(same.unionAll(close.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).distinct(), "balls")
    every = ws.save(rows.select("rid", F.posexplode("bags").alias("k", "bag")), "bags")
    met = sized(ws.save(every.groupBy("k", "bag").agg(F.count("*").alias("n")).where("n > 1"), "met"))
    left = ws.save(every.join(met, ["k", "bag"]).select("k", "bag", "rid", (F.col("n") - 1).alias("n")), "left")
    degree = ws.save(left.groupBy("rid").agg(F.sum("n").alias("company")), "company")
    left = ws.save(left.select("k", "bag", "rid").join(degree, "rid"), "left")
    ws.drop(every)
    who = sized(ws.save(degree.select("rid").unionAll(balls.select("a")).unionAll(balls.select("b")).distinct(), "who").select(F.col("rid").alias("some")))
    with small_batches(docs.sparkSession):
        sets = ws.save(_sets(docs.join(who, docs[rid_col] == who["some"], "left_semi"), text_col, rid_col), "sets")

    def similar(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rid").alias("b"), F.col("s").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.where(shared >= least * (F.size("sa") + F.size("sb") - shared) - 1e-9).select("a", "b")

    links, n = [ws.save(similar(balls), "links")], 1
    while n:
        # the member with most company stands for its group, of equals the first
        heads = left.groupBy("k", "bag").agg(F.max(F.struct("company", (-F.col("rid")).alias("r"))).alias("h"), F.count("*").alias("n")).where("n > 1").select("k", "bag", (-F.col("h.r")).alias("head"))
        others = ws.save(left.join(sized(ws.save(heads, "heads")), ["k", "bag"]).where("rid <> head"), "others")
        found = ws.save(similar(others.select(F.col("rid").alias("a"), F.col("head").alias("b")).distinct()), "links")
        links.append(found)
        n = found.count()
        # who isn't similar to the head meets the rest of the group again
        left = ws.save(others.join(found.select(F.col("a").alias("rid"), F.col("b").alias("head")), ["rid", "head"], "left_anti").select("k", "bag", "rid", "company"), "left")
        ws.release()
    roots = components(reduce(DataFrame.unionAll, links).distinct(), ws)
    # a component's smallest rid is no node of its own
    nodes = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    owned = nodes.join(rows.select("rid", "id"), nodes["node"] == F.col("rid")).select("rid", "root", F.struct(F.col("id").isNull().alias("none"), "id", "rid").alias("x"))
    owned = ws.save(owned, "owned")
    keep = sized(ws.save(owned.groupBy("root").agg(F.min("x").alias("x")).select("root", F.col("x.rid").alias("keep_rid")), "keep"))
    return owned.join(keep, "root").select("rid", "keep_rid")
