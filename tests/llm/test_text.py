"""Tokens, exact copies, near copies, repeated passages: against the libraries and brute force."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import bpe, exact, shards, simhash, substrings, words
from gridloom.llm.components import components
from gridloom.llm.common import Workspace, numbered

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", None, " ", "\n\n \t x", "it's  we'll 'S", "a" * 700 + " b", "x" * 300 + "yz" * 200, "naïve Ünïcode ß² ½ ①  日本語 テスト 🙂🙂", "\x1c\x1f a\x85b\xa0c d", "<|endoftext|>", "12345 6,789.0", "\0nul\0", "É́ ​ end "]


def docs_of(spark, tmp_path, texts, ids=None, name="docs"):
    """A table on disk with further columns, some of whose names clash with the operators' own."""
    path = str(tmp_path / name)
    rows = [(None if ids and ids[i] is None else (ids[i] if ids else i), t, "id", 1, "z") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, fp string, n long, ids string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RANKS, public_tokenizers.PATTERN)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_codec_equals_library(codec):
    texts = [t or "" for t in ODD]
    got = codec.encode(texts)
    assert got == [packed(LIBRARY.encode_ordinary(t)) for t in texts]
    assert codec.decode(got) == [t.encode() for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_codec_on_any_text(text):
    c = test_codec_on_any_text.codec = getattr(test_codec_on_any_text, "codec", None) or bpe.Codec(RANKS, public_tokenizers.PATTERN)
    ids = c.encode([text])
    assert ids == [packed(LIBRARY.encode_ordinary(text))] and c.decode(ids) == [text.encode()]


def test_splitters_agree(codec):
    pattern = regex.compile(public_tokenizers.PATTERN)
    r = random.Random(5)
    for _ in range(3000):
        t = "".join(chr(r.choice([r.randrange(256), r.randrange(0x41, 0x7B), 0x20, 0x27])) for _ in range(12))
        assert codec.split(t) == pattern.findall(t)


def test_round_trip_query(spark, tmp_path):
    df = docs_of(spark, tmp_path, ODD + ODD)
    got = bpe.digests(bpe.round_trip(df, PATH, public_tokenizers.PATTERN))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in got.collect():
        t = (ODD + ODD)[r.doc_id] or ""
        ids = LIBRARY.encode_ordinary(t)
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    enc = bpe.encode(df, PATH, public_tokenizers.PATTERN)
    assert bpe.decode(enc, PATH, public_tokenizers.PATTERN).count() == len(ODD) * 2
    assert bpe.round_trip(df.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_long_words(codec):
    """Words of every length by the recursion, in pieces that are spliced: scripts without spaces, runs, periods."""
    r = random.Random(9)
    cjk = [chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(1500)]
    thai = [chr(r.randrange(0xE01, 0xE3A)) for _ in range(40)]
    texts = ["".join(r.choices(some, k=n))[:n] for n in (95, 96, 97, 192, 255, 256, 3000) for some in (cjk, thai, "ab", "ACGT", ["the", "ing", "er", "tion", "at"], "aaab")]
    texts += [x * n for x in ("a", "ab", "=", "-=", " ", "Ã\x82", "日", "🙂") for n in (97, 255, 256, 4000)] + ["".join(r.choices("etaoinsr", k=10_000))]
    got = codec.encode(texts)
    assert got == [packed(LIBRARY.encode_ordinary(t)) for t in texts]
    assert codec.decode(got) == [t.encode() for t in texts]


def test_a_million_characters_without_spaces(codec):
    r = random.Random(10)
    cjk = [chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(20_000)]
    text = "".join(r.choices(cjk, k=1_000_000))
    many = " ".join("".join(r.choices(cjk, k=80)) for _ in range(10_000))
    assert codec.encode([text, many]) == [packed(LIBRARY.encode_ordinary(t)) for t in (text, many)]


def test_words_are_kept_by_bytes():
    some = bpe.Recent(1000)
    for k in range(30):
        for x in some.missing({str(k), "always"}):
            some.add(x, b"1234")
        assert some["always"] == b"1234" and len(some) + len(some.older) < 15


def test_codec_takes_a_block_together(monkeypatch):
    """The words of a whole block are contracted together, and its distinct runs decoded together, whichever rows they are in."""
    monkeypatch.setattr(bpe, "BLOCK", 100_000)
    c, contracted, asked = bpe.Codec(RANKS, public_tokenizers.PATTERN), [], []
    monkeypatch.setattr(c, "_contract", lambda words, f=c._contract: contracted.append(len(words)) or f(words))
    monkeypatch.setattr(c, "con", type("", (), {"__getattr__": lambda _, k, con=c.con: (asked.append(k) if k == "sql" else None) or getattr(con, k)})())
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("aeinrstéßж", k=rng.randint(1, 12))) for _ in range(200)) for _ in range(90)] + ["", "x" * 300_000 + "!"]
    want = [packed(LIBRARY.encode_ordinary(t)) for t in texts[:-1]]
    assert bpe.BLOCK < sum(map(len, texts[:-1])) < 2 * bpe.BLOCK
    assert c.encode(texts[:-1]) == want and len([n for n in contracted if n]) == 1
    asked.clear()
    assert c.decode(want) == [t.encode() for t in texts[:-1]] and len(asked) < 3
    whole = c.encode(texts[-1:])
    assert c.decode(whole + [b""] + want[:2]) == [texts[-1].encode(), b"", texts[0].encode(), texts[1].encode()]
    for bad in ([b"ab", b"cd"], [packed([2**31])]):
        with pytest.raises(ValueError):
            c.decode(bad)


def test_numbers_when_cores_change(spark, tmp_path):
    """Row numbers stay when executors come or go between two evaluations, for scans and for anything else."""
    cores = "spark.sql.leafNodeDefaultParallelism"
    spark.range(400).selectExpr("id", "id as rid").repartition(8).write.parquet(str(tmp_path / "t"))
    ws = Workspace(spark, "t")
    try:
        t = spark.read.parquet(str(tmp_path / "t"))
        for df in (t, t.where("id % 3 > 0"), t.unionAll(t), spark.range(60).repartition(7), t.where("false")):
            spark.conf.set(cores, "8")
            own = numbered(df, ws, "no")
            first = sorted((r.id, r.no) for r in own.collect())
            assert sorted(n for _, n in first) == list(range(df.count()))
            spark.conf.set(cores, "1")
            assert sorted((r.id, r.no) for r in own.select("*").collect()) == first
        assert numbered(t, ws).columns == ["id", "rid"]
    finally:
        spark.conf.unset(cores)


def test_shared_folder_on_a_cluster(spark, monkeypatch):
    from gridloom.llm import common

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_unknown_ids(codec):
    with pytest.raises(ValueError, match="vocabulary"):
        codec.decode([packed([50_256])])


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


def test_exact_dedup(spark, tmp_path):
    r = random.Random(1)
    base = ["x" * n + c for n in (0, 1, 63, 64, 65, 1000, 20_000, 300_000) for c in ("", "a", "b")]
    texts = [*base, *base, None, "", " ", "a b", "ab", " ab", "a\x0bb ", "ab\x00", *("hot copy" for _ in range(40))]
    r.shuffle(texts)
    got = {x.doc_id: (x.keep_id, x.group_size, x.kept, x.text_sha256) for x in exact.exact_dedup(docs_of(spark, tmp_path, texts)).collect()}
    assert got == brute_exact(list(enumerate(texts)))


def test_exact_dedup_odd_ids(spark, tmp_path):
    df = docs_of(spark, tmp_path, ["a", "a", "b", "b", "b c", None], ids=[7, 7, None, 3, None, None])
    got = sorted(((x.doc_id, x.keep_id, x.group_size, x.kept) for x in exact.exact_dedup(df).collect()), key=str)
    assert got == sorted([(7, 7, 2, True), (7, 7, 2, False), (None, 3, 2, False), (3, 3, 2, True), (None, None, 1, True), (None, None, 1, True)], key=str)
    assert exact.exact_dedup(df.where("false")).count() == 0


def brute_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", t) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if root[b] < root[a] and linked(a, b):
                    root[a], changed = root[b], True
    return root


def test_simhash(spark, tmp_path):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(words, k=n)) for n in (1, 2, 3, 50, 400, 3000)]
    texts = [*ODD, *base]
    for t in base[3:]:
        for _ in range(6):
            w = t.split()
            w[r.randrange(len(w))] = "edited"
            texts += ["  ".join(w), " ".join(w).upper()]
    fp = [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint((t or "").encode()) for t in texts] == fp
    root = brute_components(range(len(texts)), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_dedup(docs_of(spark, tmp_path, texts)).collect()}
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in range(len(texts))}
    assert len({*root.values()}) < len(texts) - 5
    assert simhash.near_dedup(docs_of(spark, tmp_path, texts, name="none").where("false")).count() == 0


def test_ball_links_find_every_pair(spark):
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(30)} | {0, 1 << 63, (1 << 63) | 1}
    for f in list(fps):
        fps.add(f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert all(((x.a ^ x.b) & (1 << 64) - 1).bit_count() <= 2 for x in links)
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    pairs = {(x.a, x.b) for x in links} | {(x.b, x.a) for x in links}
    assert brute_components(fps, near) == brute_components(fps, lambda a, b: (a, b) in pairs)
    with pytest.raises(ValueError, match="even"):
        simhash.ball_links(spark.createDataFrame([(1,)], "fp long"), radius=3)


def brute_similar(texts, least=0.8):
    """Components of pairs of texts by the sets of their five-word shingles."""
    sets = []
    for t in texts:
        w = [x for x in regex.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    return brute_components(range(len(texts)), near)


def test_near_copies_by_similarity(spark, tmp_path):
    """Groups of edited copies, some of which are similar to the original alone; what is less similar stays apart."""
    r = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    texts = ["", None, "a b", "A  b", "a b c", "x " * 30]
    for n, copies in ((40, 4), (150, 25), (150, 3), (400, 6)):
        base, edited = r.choices(words, k=n), []
        for _ in range(copies):
            w = list(base)
            for at in r.sample(range(n), max(1, n // 50)):
                w[at] = r.choice(words)
            edited.append(" ".join(w))
        texts += [*edited, " ".join(base), " ".join(base[: int(n * 0.7)] + r.choices(words, k=n))]
    shared = " ".join(r.choices(words, k=60))
    texts += [shared + " " + " ".join(r.choices(words, k=90)) for _ in range(12)]
    root = brute_similar(texts)
    df = docs_of(spark, tmp_path, texts)
    got = {x.rid: x.keep_rid for x in simhash.near_copies(df.withColumn("rid", F.col("doc_id")), "rid").collect()}
    alone = {k for k in root if list(root.values()).count(root[k]) == 1}
    assert got == {k: v for k, v in root.items() if k not in alone}
    assert len(alone) > 14 and len(got) > 35
    none = docs_of(spark, tmp_path, ["x"], name="none").withColumn("rid", F.col("doc_id"))
    assert simhash.near_copies(none, "rid").count() == 0 and simhash.near_copies(none.where("false"), "rid").count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(500, 500 + i) for i in range(1, 30)] + [(5, 5)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    nodes = sorted({n for a, b in edges if a != b for n in (a, b)})
    both = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    roots = brute_components(nodes, lambda a, b: (a, b) in both)
    assert got == {n: m for n, m in roots.items() if n != m}


def brute_repeats(texts, window):
    docs = [[w for w in regex.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    seen = {}
    for k, d in enumerate(docs):
        for i in range(len(d) - window + 1):
            seen.setdefault(tuple(d[i : i + window]), []).append((k, i))
    gone = [set() for _ in docs]
    for at in seen.values():
        if len(at) > 1:
            for k, i in at:
                gone[k].update(range(i, i + window))
    return {k: (len(d), len(gone[k]), " ".join(w for i, w in enumerate(d) if i not in gone[k])) for k, d in enumerate(docs)}


def test_substrings(spark, tmp_path):
    r = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    docs = [r.choices(words, k=r.choice([0, 1, 34, 35, 36, 90, 400])) for _ in range(40)]
    passages = [r.choices(words, k=n) for n in (20, 34, 35, 36, 50, 120)]
    for d in docs[:30]:
        for p in r.sample(passages, 2):
            at = r.randrange(len(d) + 1)
            a = r.choice([0, 0, 0, 7])
            d[at:at] = p[a:]
    texts = [" ".join(d) for d in docs] + [" \n".join(docs[3]), None, "", "same " * 80, "a b " * 60, " ".join(docs[5] + docs[5])]
    got = {x.doc_id: (x.n_words, x.n_removed, bytes(x.kept).decode()) for x in substrings.remove_repeats(docs_of(spark, tmp_path, texts)).collect()}
    assert got == brute_repeats(texts, 35)
    empty = docs_of(spark, tmp_path, [None, "x"], name="small")
    assert sorted(tuple(x)[1:3] for x in substrings.remove_repeats(empty).collect()) == [(0, 0), (1, 0)]
    assert substrings.remove_repeats(empty.where("false")).count() == 0


def test_word_hashes_of_a_block():
    """All words of many texts at once: the words that ``bytes.split`` finds, equal hashes for equal words alone."""
    r = random.Random(16)
    parts = ["", "a", "abcdefgh", "abcdefgh\0", "abcdefg\0", "\0" * 8, "\0" * 9, "\0" * 16, "x" * 255, "x" * 256, "x" * 257, "x" * 5000, "\x1c\x1f", "\x85\xa0", "é", "日本語"] + ["".join(r.choices("ab", k=r.randint(1, 40))) for _ in range(3000)]
    texts = ["".join(x + r.choice([" ", "\t", "\n", "\x0b", "\x0c", "\r", " \n "]) for x in r.choices(parts, k=r.randint(0, 60))).encode() for _ in range(400)] + [b"", b" ", b"a", b" a", b"a "]
    n, (one, two) = words.word_hashes(texts, 0, 1)
    every = [w for t in texts for w in t.split()]
    assert n.tolist() == [len(t.split()) for t in texts] and len(one) == len(two) == len(every)
    for h in (one, two):
        assert len(set(h.tolist())) == len(set(every)) == len(set(zip(every, h.tolist())))
    assert not (one == two).any()
    again, (alone,) = words.word_hashes([texts[7]], 1)
    assert alone.tolist() == two[n[:7].sum() :][: again[0]].tolist()
    assert words.word_hashes([], 0)[0].tolist() == [] and words.word_hashes([b"", b" "], 0)[0].tolist() == [0, 0]


def test_phrases_know_no_places(spark, tmp_path):
    """What documents are given is words alone, each at two places at least; the automaton finds where they are."""
    r = random.Random(14)
    words = [f"w{i}" for i in range(2000)]
    passage, other = r.choices(words, k=90), r.choices(words, k=40)
    docs = [r.choices(words, k=50) + passage[a:b] + r.choices(words, k=20) + (other if k % 3 == 0 else []) for k, (a, b) in enumerate([(0, 90), (10, 80), (0, 90), (30, 70), (5, 45), (0, 34)])]
    texts = [" ".join(d) for d in docs] + [None, "x"]
    df = docs_of(spark, tmp_path, texts)
    ws = Workspace(spark, "t")
    rows = numbered(df.select("doc_id", "text"), ws)
    phrases, holding = substrings.confirmed(rows, ws, "text", per=2)
    look = {k for x in holding.collect() for k in x.rids}
    assert {x.doc_id for x in rows.collect() if x.rid in look} == {0, 1, 2, 3, 4}
    assert phrases.columns == ["block", "words"]
    for x in phrases.collect():
        p = bytes(x.words).decode()
        assert len(p.split()) == 35 and sum(t.count(p) for t in texts if t) >= 2
    assert substrings.Phrases([]).covered([b"x"]) is None
    # an occurrence that nothing handed over
    found = substrings.Phrases([" ".join(passage[:35]).encode()]).covered([b"a", *(w.encode() for w in passage), b"b"])
    assert found.tolist() == [False] + [True] * 35 + [False] * 56


def test_substrings_of_odd_tables(spark, tmp_path):
    """A very long text, repeated and null ids, other windows, and a scan that is cut otherwise later on."""
    r = random.Random(15)
    words = [f"w{i}" for i in range(4000)]
    long, shared = r.choices(words, k=150_000), r.choices(words, k=60)
    long[70_000:70_000] = shared
    texts = [" ".join(long), " ".join(r.choices(words, k=40) + shared), "a b c", "a b c", None]
    df, cores = docs_of(spark, tmp_path, texts, ids=[5, 5, None, None, 7]), "spark.sql.leafNodeDefaultParallelism"
    kept = substrings.sized

    def later(x):
        spark.conf.set(cores, "1")
        return kept(x)

    try:
        spark.conf.set(cores, "8")
        substrings.sized = later
        got = sorted((x.n_words, x.n_removed, bytes(x.kept).decode()) for x in substrings.remove_repeats(df).collect())
    finally:
        substrings.sized = kept
        spark.conf.unset(cores)
    assert got == sorted(brute_repeats(texts, 35).values())
    for window, seed in ((3, 2), (100, 8), (35, 34)):
        some = [" ".join(long[:300] + shared[:window]), " ".join(long[100:280]), *texts[1:]]
        got = {x.doc_id: x.n_removed for x in substrings.remove_repeats(docs_of(spark, tmp_path, some, name=f"w{window}{seed}"), window=window, seed=seed).collect()}
        assert got == {k: n for k, (_, n, _) in brute_repeats(some, window).items()}


def test_permutation():
    import numpy as np

    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(shards.permute(np.arange(n), n, b"k").tolist()) == list(range(n))
    assert shards.permute(np.arange(100), 100, b"a").tolist() != shards.permute(np.arange(100), 100, b"b").tolist()


def test_token_shards(spark, tmp_path):
    texts = [t for t in [*ODD, "word " * 60_000] for _ in range(3)]
    path, cores = Workspace(spark, "shards-test").path, "spark.sql.leafNodeDefaultParallelism"
    docs = docs_of(spark, tmp_path, texts, ids=[*range(len(texts))])
    count = type(docs).count
    try:
        spark.conf.set(cores, "8")
        # the scan is cut otherwise when the slots are dealt out than when the rows were counted
        shards.DataFrame.count = lambda self: (count(self), spark.conf.set(cores, "1"))[0]
        placed = shards.write_shards(docs, path, PATH, public_tokenizers.PATTERN, stride=16, shard_docs=10)
    finally:
        shards.DataFrame.count = count
        spark.conf.unset(cores)
    rows = placed.collect()
    assert sorted(x.slot for x in rows) == list(range(len(texts)))
    read = shards.read_shards(spark, path, stride=16, rows_a_task=3).collect()
    stream = {}
    for x in sorted(read, key=lambda x: (x.shard, x.row)):
        stream.setdefault(x.shard, []).extend(x.ids)
    for x in rows:
        ids = LIBRARY.encode_ordinary(texts[x.doc_id] or "")
        assert stream[x.shard][x.first_id : x.first_id + x.n_ids + 1] == [*ids, 50_256] and x.n_ids == len(ids)
        assert x.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}H", *ids)).hexdigest()
    ordered = sorted(rows, key=lambda x: x.slot)
    assert [x.shard for x in ordered] == sorted(x.shard for x in rows)
    rest = shards.read_shards(spark, path, stride=16, after=(1, 2)).collect()
    assert {(x.shard, x.row) for x in rest} == {(x.shard, x.row) for x in read if (x.shard, x.row) > (1, 2)}
    assert shards.write_shards(docs_of(spark, tmp_path, ["x"], name="e").where("false"), path + "-e", PATH, public_tokenizers.PATTERN).count() == 0


def test_long_text(spark, tmp_path):
    text = " ".join(f"w{i % 977}x{i % 31}" for i in range(200_000))
    df = docs_of(spark, tmp_path, [text, "short"])
    got = {r.doc_id: r.ids_sha256 for r in bpe.digests(bpe.round_trip(df, PATH, public_tokenizers.PATTERN)).collect()}
    assert got[0] == hashlib.sha256(packed(LIBRARY.encode_ordinary(text))).hexdigest()
    assert {r.doc_id: r.fingerprint for r in simhash.near_dedup(df).collect()}[0] == f"{brute_fingerprint(text):016x}"
    assert df.select(F.length("text")).count() == 2
