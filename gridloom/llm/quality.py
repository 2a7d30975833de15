"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words, punctuation runs, pairs of them, with
one bucket for immediate repetition): the target model from labelled good documents (a
bounded sample, ``SAMPLE``), the raw model from every document. A document's log weight
is the sum of its n-grams' log ratios. Gumbel noise, drawn from a hash of id and text,
is added, and the k largest stay: a sample without replacement by weight. k is the
share of good documents among the labelled ones, plus ``slack``, of all documents.

The model is a table of BUCKETS numbers, whatever the data. The k-th largest key is
found by counting keys in ever narrower bins; no documents are sorted or gathered.

A null text counts as empty (weight 0). Equal rows get equal keys and go the same way;
all rows at the threshold stay. Without labels of either kind nothing is rejected, and
an empty table gives no rows. Texts are read whole. Other columns are not looked at;
``keep`` returns them as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, sampled, small_batches, trim, without
from .words import WordHashes, mix

#: Labelled rows that the target model is fitted on, at most; buckets; share added to k.
SAMPLE, BUCKETS, SLACK = 20_000, 1 << 14, 0.02
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Grams:
    def __init__(self):
        self.hashes = WordHashes()

    def __call__(self, text: str) -> np.ndarray:
        """Buckets of the text's n-grams."""
        h = self.hashes(_TOKEN.findall(text))
        pair = np.where(h[:-1] == h[1:], np.uint64(1), mix(h[:-1] * np.uint64(3) + h[1:]))
        return (np.concatenate([h, pair]) & np.uint64(BUCKETS - 1)).astype(np.int32)


def _sample(labels: DataFrame, most: int, ws: Workspace) -> tuple[list, float | None]:
    """Ids of good labelled documents, and the share of good ones among all labelled."""
    good = F.sum((F.col("quality") == 1).cast("long"))
    n, g = labels.where("quality is not null").agg(F.count("*"), good).first()
    rows = sampled(labels.where("quality = 1 and doc_id is not null").select("doc_id"), most, ws)
    return sorted({r.doc_id for r in rows}), (g / n if n and 0 < g < n else None)


def fit(docs: DataFrame, labels: DataFrame, ws: Workspace, most: int = SAMPLE) -> tuple[np.ndarray | None, float]:
    """(log ratio per bucket, share of good documents); no ratios where labels can't tell."""
    ids, share = _sample(labels, most, ws)
    if share is None or not ids:
        return None, 1.0
    spark = docs.sparkSession
    good = spark.createDataFrame([(i,) for i in ids], "good_id long")  # at most ``most`` longs
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).join(F.broadcast(good), F.col("doc_id") == F.col("good_id"), "left").select("t", F.col("good_id").isNotNull().alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(), np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for t, g in zip(batch.column(0), batch.column(1).to_pylist()):
                c = np.bincount(grams(t.as_py()), minlength=BUCKETS)
                counts[0] += c
                if g:
                    counts[1] += c
        del grams
        trim()
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "raw", "target"])

    with small_batches(spark):
        rows = marked.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in rows:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if target.sum() == BUCKETS:  # no labelled document is here
        return None, 1.0
    return np.log(target / target.sum()) - np.log(raw / raw.sum()), share


def _gumbel(doc_id, text: str) -> float:
    u = (xxhash.xxh64_intdigest(f"{doc_id}\0{text}".encode(), 7) + 0.5) / 2.0**64
    return float(-np.log(-np.log(u)))


def score(docs: DataFrame, ratios: np.ndarray | None, rid_col: str | None = None) -> DataFrame:
    """(doc_id, log_weight, gumbel_key[, rid])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            w = [_weight(ratios, grams, t) for t in batch.column(1)]
            key = [x + _gumbel(i, t.as_py() or "") for x, i, t in zip(w, batch.column(0).to_pylist(), batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.float64()), pa.array(key, pa.float64()), *batch.columns[2:]], names=["doc_id", "log_weight", "gumbel_key", *(["rid"] if rid_col else [])])
        del grams
        trim()

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, log_weight double, gumbel_key double" + (", rid long" if rid_col else "")
    return docs.select("doc_id", F.col("text").cast("string"), *([rid_col] if rid_col else [])).mapInArrow(run, kind)


def _weight(ratios, grams: Grams, text: pa.Scalar) -> float:
    t = text.as_py()
    return float(ratios[grams(t)].sum()) if t and ratios is not None else 0.0


def kth_largest(df: DataFrame, value: str, k: int, bins: int = 2048) -> float:
    """The exact k-th largest of a column of doubles, by counting in ever narrower bins."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or k < 1:
        return float("inf") if k < 1 else float("-inf")
    inside: Column = F.lit(True)
    while low < high:
        width = (high - low) / bins
        if low + width == low:
            break
        at = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / width)).cast("int")
        # each bin says what it holds, so that the next step starts from real values
        rows = sorted(df.where(inside).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect(), key=lambda r: -r.lo)
        for r in rows:
            if k <= r.n:
                low, high = r.lo, r.hi
                break
            k -= r.n
        else:
            return float("-inf")
        inside = F.col(value).between(low, high)
    return low


class Quality:
    """A fitted model with the threshold that leaves the k largest keys."""

    def __init__(self, docs: DataFrame, labels: DataFrame, slack: float = SLACK, most: int = SAMPLE, rid_col: str | None = None):
        ws = Workspace(docs.sparkSession, "quality")
        self.ratios, share = fit(docs, labels, ws, most)
        with small_batches(docs.sparkSession):
            self.scores = ws.save(score(docs, self.ratios, rid_col), "scores")
        n = self.scores.count()
        k = n if self.ratios is None else min(n, int(np.ceil(n * min(1.0, share + slack))))
        self.threshold = float("-inf") if k >= n else kth_largest(self.scores, "gumbel_key", k)

    def decisions(self) -> DataFrame:
        """(doc_id, log_weight, gumbel_key, kept[, rid]) of every document."""
        return self.scores.withColumn("kept", F.col("gumbel_key") >= self.threshold)


def keep(docs: DataFrame, labels: DataFrame, slack: float = SLACK, most: int = SAMPLE) -> DataFrame:
    """The documents that stay, all columns."""
    return without(docs, lambda rows, name: Quality(rows, labels, slack, most, name).decisions().where("not kept"), Workspace(docs.sparkSession, "quality"))
