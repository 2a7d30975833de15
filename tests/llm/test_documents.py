"""Quality, decontamination and the pipeline: against brute force and held-out labels."""

import os
import random
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import decontam, exact, quality, simhash

SF = "/root/testdata/sf0.001"


def test_kth_largest(spark):
    r = random.Random(1)
    for values in ([r.gauss(0, 9) for _ in range(500)], [1.0] * 50 + [2.0] * 3, [5.0], [-1e300, 1e300, 0.0, 1e-300, -1e-300]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for k in {1, 2, len(values) // 2, len(values)} - {0}:
            assert quality.kth_largest(df, "v", k, bins=7) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert quality.kth_largest(df.where("false"), "v", 3) == float("-inf")


def corpus(n, seed=3):
    """(doc_id, text, quality): prose, and lists of shouted or decorated words."""
    r = random.Random(seed)
    syll = ["ta", "re", "mi", "lo", "ne", "su", "ka", "ve"]
    word = lambda: "".join(r.choices(syll, k=r.randrange(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(r.randrange(30, 200))]
        if r.random() < 0.2:
            text = " ".join(w.upper() + "!!" for w in words) if i % 2 else " | ".join(f"{w}$$$" for w in words)
            out.append((i, text, 0))
        else:
            out.append((i, ". ".join(" ".join(words[j : j + 9]).capitalize() for j in range(0, len(words), 9)) + ".", 1))
    return out


def test_quality(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, lang string, log_weight double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows[:240]], "doc_id long, quality int, toxic int")
    q = quality.Quality(docs, labels)
    got = {r.doc_id: r for r in q.decisions().collect()}
    held = rows[240:]
    assert sum(got[i].kept for i, _, y in held if y) / sum(y for *_, y in held) > 0.98
    assert sum(not got[i].kept for i, _, y in held if not y) / sum(1 - y for *_, y in held) > 0.75
    # the model is what counting all documents at once gives
    grams = quality.Grams()
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, t, y in rows:
        c = np.bincount(grams(t), minlength=quality.BUCKETS)
        raw += c
        if y and i < 240:
            target += c
    assert np.allclose(q.ratios, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    keys = sorted((r.gumbel_key for r in got.values()), reverse=True)
    share = sum(y for *_, y in rows[:240]) / 240
    k = int(np.ceil(600 * min(1, share + quality.SLACK)))
    assert q.threshold == keys[k - 1] and sum(r.kept for r in got.values()) == k
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_quality_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b"), (2, ""), (2, ""), (3, "x" * 100_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in quality.Quality(docs, none).decisions().collect())
    some = spark.createDataFrame([(None, 1, 0), (2, None, 0), (99, 1, 0), (98, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep(docs, some).count() == 5
    known = spark.createDataFrame([(2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.Quality(docs, known).decisions().count() == 5
    assert quality.Quality(docs.where("false"), known).decisions().count() == 0


def words_of(t):
    return regex.findall(r"\w+", (t or "").lower())


def grams(words):
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def brute_matches(text, items):
    d, out = words_of(text), {}
    for i, t in items:
        w = words_of(t)
        size = min(5, len(w))
        if not w or len(d) < size:
            continue
        bag = grams(w)
        for a in range(max(1, len(d) - len(w) + 1)):
            some = d[a : a + len(w)]
            got = Counter(tuple(some[j : j + size]) for j in range(len(some) - size + 1))
            both = sum((bag & got).values())
            s = both / (sum(bag.values()) + sum(got.values()) - both)
            if s >= 0.8:
                out[i] = max(out.get(i, 0), s)
    return out


def leaky(seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    items = [(k, " ".join(r.choices(vocabulary, k=n))) for k, n in enumerate([1, 3, 4, 5, 6, 20, 40, 60, 80, 120])] + [(50, None), (51, "..."), (52, "the the the the the the the the")]
    docs = []
    for k in range(60):
        d = r.choices(vocabulary, k=r.choice([0, 5, 50, 300]))
        if k % 2:
            w = words_of(r.choice(items[3:10])[1])
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1])] = r.choice([["new"], []])
            at = r.randrange(len(d) + 1)
            d[at:at] = w
        docs.append((k, " ".join(x.capitalize() if r.random() < 0.3 else x + "," for x in d)))
    return items, [*docs, (100, None), (101, ""), (102, "the " * 50), (103, items[9][1].upper()), (104, " ".join(words_of(items[9][1])[:-3]))]


def test_decontamination(spark):
    items, docs = leaky()
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(df, bench).collect()}
    expected = {(i, k): s for i, t in docs for k, s in brute_matches(t, items).items()}
    assert set(got) == set(expected) and all(got[k] == pytest.approx(expected[k]) for k in got)
    assert len(got) > 15 and any(0.8 <= s < 1 for s in got.values())
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in expected}
    assert decontam.contaminated(df, bench.where("false")).count() == 0 and decontam.contaminated(df.where("false"), bench).count() == 0
    assert decontam.clean(df, bench.where("false")).count() == len(docs)


@pytest.mark.parametrize("radius", [0, 3, 7, 19])
def test_multi_index_finds_all_within_radius(radius):
    """Every fingerprint within the radius is found, and no other, as by comparing all."""
    r = random.Random(7)
    prints = [r.getrandbits(64) for _ in range(8)]
    table = decontam.Table(30, prints, decontam.ball(radius // decontam.PARTS), radius)
    asked = [f for p in prints for flips in range(25) for f in [p ^ sum(1 << b for b in r.sample(range(64), flips))]] + [r.getrandbits(64) for _ in range(500)]
    got = {(k, asked[i], int(d)) for k, at, ds in table.lookup(np.array(asked, dtype=np.uint64)) for i, d in zip(at.tolist(), ds)}
    assert got == {(k, f, (p ^ f).bit_count()) for k, p in enumerate(prints) for f in asked if (p ^ f).bit_count() <= radius}


def test_only_what_the_fingerprints_find_counts(spark):
    """The lookup decides which windows are compared: at a radius of 0 only equal fingerprints are."""
    items, docs = leaky()
    every = {(i, m[0]) for i, t in docs for m in decontam.Index(items).matches([t or ""])[0]}
    near = {(i, m[0]) for i, t in docs for m in decontam.Index(items, radius=0).matches([t or ""])[0]}
    assert near < every and all(m[2] == 0 for i, t in docs for m in decontam.Index(items, radius=0).matches([t or ""])[0])


def test_fingerprints_along_a_document():
    """Runs, documents side by side and window sums give what each window's own fingerprint gives."""
    items, docs = leaky()
    texts = [t or "" for _, t in docs] * 3
    together, before = decontam.Index(items).matches(texts), decontam.RUN
    alone = [decontam.Index(items).matches([t])[0] for t in texts]
    decontam.RUN = 50
    try:
        assert together == alone == decontam.Index(items).matches(texts)
    finally:
        decontam.RUN = before
    index = decontam.Index(items)
    for t, found in zip(texts, alone):
        for item, sim, bits, first, n in found:
            _, words, size, bag = next(x for x in index.items if x[0] == item)
            w = decontam.rolling(index.words(t)[first : first + n], size)
            assert sim == decontam.similarity(bag, Counter(w.tolist())) and bits == (decontam.simhash(w) ^ decontam.simhash(decontam.rolling(index.words(dict(items)[item]), size))).bit_count() <= decontam.RADIUS


def test_recall_of_edited_items():
    """Items with words replaced, by similarity of what is left: nearly all from 0.8 on are found, all from 0.9 on."""
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    items = [(k, " ".join(r.choices(vocabulary, k=n))) for k, n in enumerate(list(range(15, 60)) * 4)]
    index, tally = decontam.Index(items), Counter()
    for k, t in items:
        for _ in range(4):
            w = t.split()
            for _ in range(r.choice([0, 1, 1, 2])):
                w[r.randrange(len(w))] = "other"
            best = decontam.similarity(grams(t.split()), grams(w))
            if best >= 0.8:
                text = " ".join([*r.choices(vocabulary, k=60), *w, *r.choices(vocabulary, k=60)])
                tally[best >= 0.9, k in {m[0] for m in index.matches([text])[0]}] += 1
    assert tally[True, True] > 100 and not tally[True, False] and tally[False, False] <= 0.02 * tally[False, True]


def test_items_of_several_passes(spark):
    items, docs = leaky()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(tuple(r) for r in decontam.contaminated(df, bench).collect())
    before, decontam.ITEMS = decontam.ITEMS, 4
    try:
        assert sorted(tuple(r) for r in decontam.contaminated(df, bench).collect()) == one
        assert decontam.clean(df, bench).count() == len(docs) - len({r[0] for r in one})
    finally:
        decontam.ITEMS = before


def test_decontamination_odd_tables(spark):
    """Ids that are words, repeated rows, null ids, one very long text, columns of the names that are used inside."""
    items, _ = leaky()
    long = " ".join(f"x{i % 7919}" for i in range(150_000)) + " " + items[8][1] + " " + " ".join(f"y{i}" for i in range(50_000))
    rows = [("a", long, 1, 2), ("b", items[7][1], 1, 2), ("b", items[7][1], 1, 2), (None, items[7][1], 1, 2), ("c", "clean", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id string, text string, rid int, i int")
    bench = spark.createDataFrame([(str(i), t) for i, t in items], "item_id string, text string")
    got = sorted(((r.doc_id, r.item_id, r.first_word) for r in decontam.contaminated(df, bench).collect()), key=str)
    assert got == sorted([("a", "8", 150_000), ("b", "7", 0), ("b", "7", 0), (None, "7", 0)], key=str)
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [rows[4]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline(spark):
    """Each stage against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    seen = {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{simhash.Workspace(spark, 'pipe').path}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        got = [tuple(r) for r in docs.collect()]
        seen[name] = len(got)
        texts = {r[0]: r[1] for r in before.collect()} if name != "bpe" else {}
        if name == "quality":
            assert set(got) <= set(rows) and 0.8 < len(got) / len(rows) < 1
        elif name == "exact_dedup":
            best = {}
            for i, t in texts.items():
                k = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
                best[k] = min(best.get(k, (1, 0)), (-len(t or ""), i))
            assert {r[0] for r in got} == {i for _, i in best.values()}
        elif name == "near_dedup":
            ids = sorted(texts)
            shingled = {}
            for i in ids:
                w = (texts[i] or "").lower().split()
                shingled[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()
            left = set()
            todo = set(ids)
            while todo:
                group, front = set(), {min(todo)}
                while front:
                    group |= front
                    todo -= front
                    front = {j for j in todo for i in front if len(shingled[i] & shingled[j]) >= 0.8 * len(shingled[i] | shingled[j])}
                left.add(min(group))
            assert {r[0] for r in got} == left and len(left) < len(ids)
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {r[0] for r in got} == {i for i, t in texts.items() if not brute_matches(t, items)}
    assert names == ["quality", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    again = corpus_pipeline.run(spark, SF)
    assert again.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert again.count() == seen["bpe"] == seen["decontamination"]
    assert again.agg(F.min("n_tokens")).first()[0] >= 0 and exact.FIRST > 0


def tables(spark, top, docs, labels=(), items=()):
    """A folder of tables; documents have further columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), k, "g", 1.0) for k, (i, t) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid int, gone_rid string, fp double").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns, tables without rows."""
    r = random.Random(12)
    prose = lambda n: " ".join(r.choices([f"word{i}" for i in range(3000)], k=n))
    base, leak, long = [prose(60) for _ in range(6)], prose(40), prose(120_000)
    docs = [*enumerate(base), (None, base[0]), (7, None), (8, ""), (9, " "), (9, base[1]), (9, base[1]), (10, leak + " tail"), (11, long), (None, None)]
    top = tables(spark, tmp_path / "a", docs, items=[(1, leak), (None, None)])
    first, seen = spark.read.parquet(f"{top}/documents.parquet"), {}
    again = exact.exact_dedup(first)
    now = first
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, top)
        assert out.schema == first.schema, name
        out.write.parquet(f"{top}/{name}")
        now = spark.read.parquet(f"{top}/{name}")
        seen[name] = [tuple(x) for x in now.collect()]
        assert set(seen[name]) <= {tuple(x) for x in first.collect()}
    assert len(seen["quality"]) == len(docs)
    assert sorted(((x[0], x[1]) for x in seen["exact_dedup"]), key=str) == sorted([*((i, t) for i, t in enumerate(base) if i != 1), (1, base[1]), (10, leak + " tail"), (11, long), (9, " ")], key=str)
    assert {x[0] for x in seen["decontamination"]} == {x[0] for x in seen["near_dedup"]} - {10}
    done = corpus_pipeline.STAGES[-1][1](spark, now, top).collect()
    assert sorted(x.doc_id for x in done) == sorted(x[0] for x in seen["decontamination"])
    assert again.count() == len(docs)  # tables of other calls are still there
    empty = tables(spark, tmp_path / "b", [])
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_pipeline_when_cores_change(spark, tmp_path):
    """Executors that come and go between a stage's jobs don't change which rows stay."""
    from gridloom.llm import common

    r = random.Random(13)
    texts = [" ".join(r.choices([f"w{i}" for i in range(500)], k=30)) for _ in range(60)]
    docs = [(i, texts[i % 60] + (" " if i % 3 else "")) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "d"))
    cores, kept = "spark.sql.leafNodeDefaultParallelism", common.sized

    def later(df):
        spark.conf.set(cores, "1" if spark.conf.get(cores, "8") == "8" else "8")
        return kept(df)

    try:
        spark.conf.set(cores, "8")
        common.sized = exact.sized = later
        for stage in (corpus_pipeline.drop_exact_copies, corpus_pipeline.drop_near_copies):
            got = stage(spark, spark.read.parquet(str(tmp_path / "d")), "")
            left = {}
            for i, t in docs:
                left.setdefault(t.strip(), []).append((-len(t) if stage is corpus_pipeline.drop_exact_copies else 0, i))
            assert {x.doc_id for x in got.collect()} == {min(x)[1] for x in left.values()}
    finally:
        common.sized = exact.sized = kept
        spark.conf.unset(cores)


def test_bounded_samples(spark, tmp_path):
    from gridloom.llm.common import sampled, sized

    spark.range(5000).selectExpr("id % 7 as x").repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    ws = simhash.Workspace(spark, "t")
    some = sampled(df, 300, ws)
    assert len(some) == 300 and [tuple(r) for r in some] == [tuple(r) for r in sampled(df, 300, ws)]
    assert len(sampled(df, 9000, ws)) == 5000 and len({r["__rid"] for r in some}) == 300
    assert sized(df).count() == 5000
