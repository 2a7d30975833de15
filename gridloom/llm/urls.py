"""URL filter: explicit rules first, gradient-boosted trees over lexical features for the rest.

Features of a URL: length, path depth, digit ratio, character entropy, parameter count,
and for the host's last one, two and three labels the smoothed share of blocked URLs
among the labelled ones. Labels come from a column, or are the verdicts of the rules: the
URLs that an explicit rule blocks or allows say how the others are to be judged. URLs
without a label take no part in training; without any, or with labels of one kind only,
no tree is grown and all URLs get that kind (allow, if there are none).

Shares are counted over all labelled rows, pre-aggregated in each task; the trees are
grown on a bounded labelled sample (``SAMPLE`` URLs, chosen by hash) on the driver.
Scoring is map-only and reads one column, unless there are so many suffixes (over
``common.BROADCAST_ROWS``) that their shares join the URLs instead of being sent.

A null URL, or one without ``://``, has an empty host and path; it is scored like any
other. URLs of any length are scored whole. Repeated rows keep a row each, an empty table
gives no rows; other columns are neither read nor returned, so that they can't clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Workspace, sampled, sized

#: The most labelled URLs that trees are grown on, and suffixes that a task counts at a time.
SAMPLE, SUFFIXES = 4000, 200_000
TREES, DEPTH, RATE, BINS = 30, 3, 0.3, 32
FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "suffix1", "suffix2", "suffix3")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (``host/path``) that fits; null if none does."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _host(url: str) -> str:
    m = re.match(r"(?s).*?://([^/?#]*)", url)
    return m[1].lower() if m else ""


def verdict_of(rule: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for verdict, r in rules:
        out = F.when(rule == r, verdict).otherwise(out)
    return out


class UrlModel:
    """Boosted regression trees on the logistic loss, over binned features."""

    def __init__(self, trees: list, prior: float, shares: list[dict[str, float]], table: DataFrame | None = None):
        self.trees, self.prior, self.shares, self.table = trees, prior, shares, table

    @classmethod
    def fit(cls, urls: list[str], labels: list[int], counts: list[tuple] | None = None) -> "UrlModel":
        """``counts`` are (k, suffix, half, n, bad) over more URLs than those that the trees are grown on."""
        y = np.asarray(labels, dtype=float)
        if not len(y) or y.min() == y.max():
            return cls([], -8.0 if not len(y) or not y.max() else 8.0, [{}, {}, {}])
        mean = float(y.mean())
        # the shares that a URL is trained with come from the other half, so that they don't hold its own label
        half = np.array([hash_bit(u) for u in urls])
        counts = _counts(urls, labels) if counts is None else counts
        shares = [_shares([c for c in counts if c[2] != k], mean) for k in (0, 1)]
        model = cls([], math.log(mean / (1 - mean)), _shares(counts, mean))
        x = np.array([features(u, shares[h], mean) for u, h in zip(urls, half)])
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        f = np.full(len(y), model.prior)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = _grow(x, y - p, p * (1 - p), cuts, DEPTH)
            model.trees.append(tree)
            f += RATE * _leaf(tree, x)
        return model

    @property
    def mean(self) -> float:
        return 1 / (1 + math.exp(-self.prior))

    def score(self, urls: list[str], shares: list[dict[str, float]] | None = None) -> np.ndarray:
        """The probability that each URL is to be blocked."""
        f = np.full(len(urls), self.prior)
        if self.trees and urls:
            x = np.array([features(u, shares or self.shares, self.mean) for u in urls])
            for t in self.trees:
                f += RATE * _leaf(t, x)
        return 1 / (1 + np.exp(-f))


def hash_bit(url: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(_host(url)) & 1 ^ xxhash.xxh64_intdigest(url) & 1


def _suffixes(url: str) -> list[str]:
    labels = _host(url).split(".")
    return [".".join(labels[-k:]) for k in (1, 2, 3)]


def _counts(urls: list[str], labels: list[int]) -> list[tuple]:
    """(k, suffix, half, n, bad): how many URLs have the suffix of k labels, and how many of them are blocked."""
    n, bad = Counter(), Counter()
    for u, v in zip(urls, labels):
        half = hash_bit(u)
        for k, s in enumerate(_suffixes(u), 1):
            n[k, s, half] += 1
            bad[k, s, half] += int(v)
    return [(*at, c, bad[at]) for at, c in n.items()]


def _shares(counts: list[tuple], mean: float) -> list[dict[str, float]]:
    n, bad = defaultdict(Counter), defaultdict(Counter)
    for k, s, _, c, v in counts:
        n[k][s] += c
        bad[k][s] += v
    return [{s: (bad[k][s] + mean) / (n[k][s] + 1) for s in n[k]} for k in (1, 2, 3)]


def features(url: str, shares: list[dict[str, float]], mean: float) -> list[float]:
    size = len(url)
    counts = Counter(url).values()
    entropy = math.log2(size) - sum(c * math.log2(c) for c in counts) / size if size else 0.0
    query = url.partition("#")[0].partition("?")[2]
    rest = url.partition("://")[2].partition("?")[0].partition("#")[0]
    depth = sum(1 for p in rest.split("/")[1:] if p)
    return [size, depth, sum(c.isdigit() for c in url) / size if size else 0.0, entropy, sum(1 for p in query.split("&") if p), *(t.get(s, mean) for t, s in zip(shares, _suffixes(url)))]


def _grow(x, g, h, cuts, depth):
    value = g.sum() / (h.sum() + 1.0)
    if depth == 0 or len(g) < 8:
        return value
    best, base = (1e-6, None, None), g.sum() ** 2 / (h.sum() + 1.0)
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        b = np.searchsorted(c, x[:, j], side="right")
        gl, hl = (np.cumsum(np.bincount(b, weights=w, minlength=len(c) + 1))[:-1] for w in (g, h))
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], j, c[k])
    if best[1] is None:
        return value
    _, j, cut = best
    low = x[:, j] < cut
    if low.all() or not low.any():
        return value
    return (j, float(cut), _grow(x[low], g[low], h[low], cuts, depth - 1), _grow(x[~low], g[~low], h[~low], cuts, depth - 1))


def _leaf(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, low, high = tree
    return np.where(x[:, j] < cut, _leaf(low, x), _leaf(high, x))


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(k, suffix, half, n, bad) over all rows of (u, y)."""
    kind = "k int, suffix string, half int, n long, bad long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*at, *c) for at, c in known.items()]
            known.clear()
            types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["k", "suffix", "half", "n", "bad"])

        for batch in batches:
            for k, s, half, n, bad in _counts(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = known.setdefault((k, s, half), [0, 0])
                c[0], c[1] = c[0] + n, c[1] + bad
            if len(known) > SUFFIXES:
                yield flush()
        yield flush()

    return labelled.select("u", "y").mapInArrow(run, kind).groupBy("k", "suffix", "half").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def labelled(urls: DataFrame, url_col: str = "url", label_col: str | None = None, rules: list[tuple[str, str]] = ()) -> DataFrame:
    """(u, y): the URLs that have a label, 1 for those to be blocked, from a column or else from the rules' verdicts."""
    u = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    y = F.col(label_col) if label_col else (verdict_of(rule_of(host_of(u), path_of(u), rules), rules) == "block")
    return urls.select(u.alias("u"), y.cast("int").alias("y")).where("y is not null")


def fit_on(urls: DataFrame, url_col: str = "url", label_col: str | None = None, rules: list[tuple[str, str]] = (), sample: int = SAMPLE) -> UrlModel:
    """Suffix shares of all labelled rows, and trees of at most ``sample`` of them, chosen by hash."""
    spark = urls.sparkSession
    ws = Workspace(spark, "urls")
    some = ws.save(labelled(urls, url_col, label_col, rules), "labelled")
    rows = sampled(some, sample, ws)
    counts = ws.save(suffix_counts(some), "suffixes")
    few = counts.count() <= common.BROADCAST_ROWS
    wanted = counts
    if not few:  # the driver needs only the suffixes of the sample
        met = sorted({(k, s) for r in rows for k, s in enumerate(_suffixes(r.u), 1)})
        wanted = counts.join(F.broadcast(spark.createDataFrame(met, "k int, suffix string")), ["k", "suffix"]).select(counts.columns)
    model = UrlModel.fit([r.u for r in rows], [r.y for r in rows], [tuple(r) for r in wanted.collect()])
    if not few and model.trees:
        share = (F.sum("bad") + F.lit(model.mean)) / (F.sum("n") + 1)
        model.table = ws.save(counts.groupBy("k", "suffix").agg(share.alias("share")), "shares")
    return model


def held_out(urls: DataFrame, url_col: str = "url", label_col: str | None = None, rules: list[tuple[str, str]] = (), sample: int = SAMPLE) -> tuple[int, float, float]:
    """(URLs, precision, recall) of blocking on the labelled URLs of half the hosts, by a model of the other half's."""
    some = labelled(urls, url_col, label_col, rules).withColumn("half", F.pmod(F.xxhash64(host_of(F.col("u"))), F.lit(2)))
    model = fit_on(some.where("half = 0"), "u", "y", sample=sample)
    other = some.where("half = 1").select(F.col("y").alias("page_id"), F.col("u").alias("url"))
    blocked, bad = F.col("verdict") == "block", F.col("page_id") == 1
    both, said, are, n = filter_urls(other, [], model).agg(F.sum((blocked & bad).cast("long")), F.sum(blocked.cast("long")), F.sum(bad.cast("long")), F.count("*")).first()
    return n, both / said if said else 1.0, both / are if are else 1.0


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score); rules are (verdict, ``host/path``)."""
    url = F.col(url_col).cast("string")
    shares, table = model.shares, model.table
    own = UrlModel(model.trees, model.prior, [{}, {}, {}] if table is not None else shares)  # without the table, which can't be sent

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(_suffixes(x or "") for x in batch.column(1).to_pylist()))) or [()] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in cols)], names=["page_id", "u", "s1", "s2", "s3"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [x or "" for x in batch.column(1).to_pylist()]
            joined = None
            if batch.num_columns > 2:
                joined = [{_suffixes(u)[k]: v for u, v in zip(urls, batch.column(2 + k).to_pylist()) if v is not None} for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own.score(urls, joined))], names=["page_id", "u", "score"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("u"))
    if table is not None:
        rows = rows.mapInArrow(cut, f"page_id {kind}, u string, s1 string, s2 string, s3 string")
        for k in (1, 2, 3):
            rows = rows.join(sized(table.where(F.col("k") == k).select(F.col("suffix").alias(f"s{k}"), F.col("share").alias(f"share{k}"))), f"s{k}", "left")
        rows = rows.select("page_id", "u", "share1", "share2", "share3")
    scored = rows.mapInArrow(run, f"page_id {kind}, u string, score double")
    parts = scored.select("page_id", "score", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
