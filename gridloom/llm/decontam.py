"""Benchmark decontamination by SimHash over item-sized windows.

Every item has a SimHash over its five-word shingles (weighted by how often each
occurs). In a document every window of an item's number of words is fingerprinted: the
bits of all shingles are added up along the document once, and a window's counts are the
difference of two sums. Fingerprints are looked up in a multi-index: they are cut into
``PARTS`` blocks of 16 bits, and as two within ``RADIUS`` bits differ by at most
RADIUS // PARTS bits in one block at least, a table of each block's ball of that radius
finds every item within the radius; the whole distance is checked next. The weighted
Jaccard similarity of the shingles then decides exactly, from ``SIMILARITY`` on.

Documents that hold, all in all, fewer shingles that any of the items might have than the
shortest item needs to reach that similarity are passed over, as are windows at the end;
that loses nothing, and says nothing of which item is where.

A similarity of 0.8 puts about 10 of 64 bits apart, with a deviation of 3, so a radius of
19 misses few such windows and none that are equal; README.md has the recall as measured.
It is the largest radius with balls of 4 bits, which hold 4 % of a block's values: the
index passes a seventh of all (window, item) pairs on to the whole distance.

Words are lower-cased runs of letters, digits and underscores. An item of fewer than
five words has one shingle, all its words; one without words never matches. A document
shorter than the item is one window. Null texts count as empty, empty tables give no
rows. Repeated rows, and repeated or null ids, are judged one by one. Only the named
columns are read; ``clean`` returns all columns as they are. Documents are worked off in
runs of ``RUN`` shingles, however long they are. Items are taken ``ITEMS`` at a time (and
``BLOCK`` characters), which bounds the tables: a larger benchmark takes more passes,
each of them written to the shared folder, not more memory.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Workspace, blocks, small_batches, trim, without
from .words import WordHashes, rolling

SHINGLE, SIMILARITY, RADIUS, PARTS = 5, 0.8, 19, 4
#: Items and characters of a pass, items of a table, shingles of a run, characters of documents that are worked off together.
ITEMS, BLOCK, TABLE, RUN, DOCS = 256, 8 << 20, 8, 8192, 1 << 20
_WORD = re.compile(r"\w+")


def simhash(shingles: np.ndarray) -> int:
    ones = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8")[0])


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def ball(radius: int) -> np.ndarray:
    """The 16-bit values of at most ``radius`` ones."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= radius]


class Table:
    """Up to ``TABLE`` items of one number of words, by the blocks of their fingerprints."""

    def __init__(self, width: int, prints: list[int], near: np.ndarray, radius: int):
        self.width, self.prints, self.radius = width, np.array(prints, dtype=np.uint64), radius
        self.balls = np.zeros((PARTS, 1 << 16), dtype=np.uint8)
        for k, f in enumerate(prints):
            for b in range(PARTS):
                self.balls[b, near ^ np.uint16(f >> 16 * b & 0xFFFF)] |= np.uint8(1 << k)

    def lookup(self, f: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each item: its number, which fingerprints are within the radius, and how many bits they differ by."""
        parts = np.ascontiguousarray(f.view(np.uint16).reshape(-1, PARTS).T)
        held = self.balls[0].take(parts[0])
        for b in range(1, PARTS):
            held |= self.balls[b].take(parts[b])
        some = held.nonzero()[0]
        held, f = held[some], f[some]
        for k, own in enumerate(self.prints):
            mine = (held & np.uint8(1 << k)).nonzero()[0]
            d = np.bitwise_count(f[mine] ^ own)
            ok = (d <= self.radius).nonzero()[0]
            if len(ok):
                yield k, some[mine[ok]], d[ok]


class Index:
    """Items by number of words, each with its bag of shingles and its place in a table."""

    def __init__(self, items: list[tuple], radius: int = RADIUS, least: float = SIMILARITY):
        self.hashes, self.radius, self.least = WordHashes(), radius, least
        self.items: list[tuple] = []  # (id, words, shingle size, bag)
        groups: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            words = self.words(text or "")
            if not len(words):
                continue
            size = min(SHINGLE, len(words))
            s = rolling(words, size)
            groups[size, len(s)].append((len(self.items), simhash(s)))
            self.items.append((item_id, len(words), size, Counter(s.tolist())))
        near = ball(radius // PARTS)
        #: by shingle size: tables with the items of their places
        self.tables: dict[int, list[tuple[Table, list[int]]]] = defaultdict(list)
        for (size, width), held in sorted(groups.items()):
            for a in range(0, len(held), TABLE):
                some = held[a : a + TABLE]
                self.tables[size].append((Table(width, [f for _, f in some], near, radius), [k for k, _ in some]))
        # a bit for each shingle's upper 22 bits says quickly that no item has it
        self.maybe = {size: np.zeros(1 << 22, dtype=bool) for size in self.tables}
        for _, _, size, bag in self.items:
            self.maybe[size][(np.fromiter(bag, dtype=np.uint64, count=len(bag)) >> np.uint64(42)).astype(np.int64)] = True

    def words(self, text: str) -> np.ndarray:
        return self.hashes(_WORD.findall(text.lower()))

    def matches(self, texts: list[str]) -> list[list[tuple]]:
        """For each text (item id, similarity, differing bits, first word, words) of the best window for each item found."""
        hashed = [self.words(t) for t in texts]
        best: list[dict[int, tuple]] = [{} for _ in texts]
        for size, tables in self.tables.items():
            rolled = [rolling(h, size) for h in hashed]
            n = np.array([len(r) for r in rolled], dtype=np.int64)
            s = np.concatenate(rolled)
            if not len(s):
                continue
            begin = np.cumsum(n) - n
            known = np.concatenate([[0], np.cumsum(self.maybe[size][(s >> np.uint64(42)).astype(np.int64)])])
            least_width = min(t.width for t, _ in tables)
            need = self.least * (least_width + np.minimum(n, least_width)) / (1 + self.least)
            rolled = [r if ok else r[:0] for r, ok in zip(rolled, (known[begin + n] - known[begin] >= need - 1e-9).tolist())]
            n = np.array([len(r) for r in rolled], dtype=np.int64)
            s = np.concatenate(rolled)
            if not len(s):
                continue
            begin = np.cumsum(n) - n
            end = np.repeat(begin + n, n)  # where the document of each shingle ends
            known = np.concatenate([[0], np.cumsum(self.maybe[size][(s >> np.uint64(42)).astype(np.int64)])])

            def judge(k: int, a: np.ndarray, stop: np.ndarray, d: np.ndarray) -> None:
                """Exact similarity of the windows [a, stop) with item ``k``."""
                _, words, _, bag = self.items[k]
                width = words - size + 1
                # both bags hold at least this many of the common shingles
                need = self.least * (width + stop - a) / (1 + self.least)
                enough = known[stop] - known[a] >= need - 1e-9
                for x, y, bits in zip(a[enough].tolist(), stop[enough].tolist(), d[enough].tolist()):
                    sim = similarity(bag, Counter(s[x:y].tolist()))
                    doc = int(np.searchsorted(begin, x, side="right")) - 1
                    while not n[doc]:
                        doc -= 1
                    if sim >= self.least and sim > best[doc].get(k, (0,))[0]:
                        best[doc][k] = (sim, bits, x - int(begin[doc]), min(words, len(hashed[doc])))

            widest = max(t.width for t, _ in tables)
            for c in range(0, len(s), RUN):
                part = s[c : c + RUN + widest]
                sums = np.zeros((len(part) + 1, 64), dtype=np.uint32 if widest > 60_000 else np.uint16)  # differences are right even if sums run over
                np.cumsum(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=sums.dtype, out=sums[1:])
                prints: dict[int, np.ndarray] = {}
                for table, held in tables:
                    w = table.width
                    m = min(RUN, len(part) - w + 1)
                    if m <= 0:
                        continue
                    if w not in prints:
                        prints.clear()  # tables of one width follow each other
                        prints[w] = np.packbits(sums[w : w + m] - sums[:m] > w // 2, axis=1, bitorder="little").view(np.uint64)[:, 0]
                    for k, at, d in table.lookup(prints[w]):
                        whole = c + at + w <= end[c + at]
                        if whole.any():
                            judge(held[k], c + at[whole], c + at[whole] + w, d[whole])
            # documents that are shorter than an item are one window each
            short = np.flatnonzero((n > 0) & (n < widest))
            if len(short):
                f = np.array([simhash(rolled[x]) for x in short.tolist()], dtype=np.uint64)
                for table, held in tables:
                    for k, at, d in table.lookup(f):
                        less = n[short[at]] < table.width
                        if less.any():
                            judge(held[k], begin[short[at[less]]], (begin + n)[short[at[less]]], d[less])
        return [[(self.items[k][0], *v) for k, v in sorted(found.items())] for found in best]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, hamming, first_word, n_words): the best window of each pair that matches."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, hamming int, first_word int, n_words int"
    given = items.select(F.col(item_col).alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).distinct()
    count, size = given.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    passes = max(-(-count // ITEMS), -(-size // BLOCK))
    texts = docs.select(id_col, F.col(text_col).cast("string"))
    item_type = to_arrow_schema(given.schema).field("i").type

    def find(some: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(some, radius, least)
            for batch in batches:
                ids, found = batch.column(0), []
                for a, b in blocks([len(x) + 1 for x in (t or "" for t in batch.column(1).to_pylist())], DOCS):
                    got = index.matches([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                    found += [(i, *m) for i, some_ in zip(ids.slice(a, b - a).to_pylist(), got) for m in some_]
                cols = list(zip(*found)) or [()] * 6
                types = (batch.schema.types[0], item_type, pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "similarity", "hamming", "first_word", "n_words"])
                trim()

        return texts.mapInArrow(run, schema)

    def rows(n: int) -> list[tuple]:
        """The items of a pass, which the driver holds while it runs."""
        return sorted(((r.i, r.t) for r in given.where(F.pmod(F.xxhash64("i", "t"), F.lit(max(passes, 1))) == n).collect()), key=str)

    if passes <= 1:
        return find(rows(0))
    ws = Workspace(spark, "decontamination")
    return reduce(DataFrame.unionAll, [ws.save(find(rows(n)), f"pass{n}") for n in range(passes)])


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """The documents that match no item, all columns."""

    def judged(rows: DataFrame, name: str) -> DataFrame:
        return contaminated(rows, items, name, text_col, radius=radius, least=least).select(F.col("doc_id").alias("rid"))

    ws = Workspace(docs.sparkSession, "decontamination")
    with small_batches(docs.sparkSession):
        return without(docs, judged, ws)
