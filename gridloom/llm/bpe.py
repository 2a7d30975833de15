"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

Encoding: a text is cut into the matches of the split pattern. The distinct matches
that this worker has not met yet become rows (word, position, token); one recursive
query joins neighbouring tokens with the merge table and contracts, in every word, the
leftmost pair of minimum rank, until no word has a pair left. Decoding: the ids are cut
into runs that begin at tokens with a leading space or newline (any cut is right, as
decoding is a homomorphism; words repeat), and an ordered aggregation over
(position, id) rows joined with the vocabulary concatenates the distinct runs of a block.

Words and runs are dealt with as Arrow dictionaries: only the distinct ones of a block
become Python objects or rows, and results are gathered by their numbers.

The recursion takes as many steps over a word as it has merges, so words are contracted
in pieces. Where no token of the vocabulary holds the two bytes around a place, no merge
can cross it, and the word is cut there. What is still longer than ``PIECE`` bytes is
contracted in overlapping pieces, which are spliced at a token that both have at one
place: a sequence of tokens is the encoding of its bytes exactly if each two neighbours
are the encoding of theirs, and all neighbours of the spliced sequence are neighbours in
a piece. Without a common token a longer piece is taken, the whole word at the last.

Both are map-only: no shuffle, and memory bounded by ``CACHE`` bytes of words, ``STEPS``
rows of a recursion and ``BLOCK`` characters (or one longer text).

Null texts count as empty: zero tokens. Repeated rows and ids are encoded each by
itself, an empty table gives no rows; only the id column and the outputs are returned,
so that further columns can't clash. Ids outside the vocabulary raise ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Generator, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, trim

#: Bytes, roughly, of a generation of words; a worker keeps two.
CACHE = 96 << 20
#: Characters of text that are cut at once.
BLOCK = 4 << 20
#: Bytes of a piece, rows that a recursive query makes at most, and ids that are decoded at once.
PIECE, STEPS, QUERY_IDS = 96, 4_000_000, 400_000

_ENCODE = """
with recursive s(k, tok, live) as (
  select w::ubigint * 1048576 + pos, tok, true from words
  union all
  select k, tok, live from (
    with pairs as materialized (
           select k, tok, k >> 20 as w, lead(tok) over o as next_tok, lead(k) over o as next_k
           from s where live window o as (order by k)),
         best as (
           select w, min(m::ubigint * 1099511627776 + (k & 1048575) * 1048576 + (next_k & 1048575)) as hit
           from pairs join merges on pair = tok * 65536 + next_tok where (next_k >> 20) = w group by w)
    select p.k, p.w,
           case when (p.k & 1048575) = ((hit >> 20) & 1048575) then (hit >> 40)::uinteger else p.tok end as tok,
           hit is not null as live
    from pairs p left join best b on p.w = b.w
    where hit is null or (p.k & 1048575) <> (hit & 1048575)
  )
)
select (k >> 20)::uinteger as w, tok from s where not live order by k
"""

_DECODE = """
select string_agg(chars, '' order by pos) from runs join vocabulary using (id)
"""

#: Latin-1 letters, numbers and white space by the Unicode properties that the split pattern names.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with lines of base64 bytes and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Recent(dict):
    """What was met lately: when a generation is full, only what has been met since the one before stays."""

    def __init__(self, most: int | None = None):
        super().__init__()
        self.older: dict = {}
        self.most, self.size = most or CACHE, 0

    def add(self, key, value: bytes) -> None:
        self[key] = value
        self.size += len(key) + len(value) + 160  # what two objects and their places take besides

    def missing(self, met: list) -> list:
        """Of ``met``, what has to be worked out; the rest is at hand afterwards."""
        if self.size > self.most:
            self.older, self.size = dict(self), 0
            self.clear()
        out, older = [], self.older
        for x in met:  # a set's difference from a kind of dict would go over all of the dict
            if x not in self:
                if (v := older.get(x)) is None:
                    out.append(x)
                else:
                    self.add(x, v)
        return out


class Codec:
    """Encoder and decoder over one vocabulary, with a DuckDB database of its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        import public_tokenizers

        self.latin = pattern == public_tokenizers.PATTERN
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.uint32)
        self.size = max(ranks.values()) + 1
        self.known = np.zeros(self.size, dtype=bool)
        self.begins = np.zeros(self.size, dtype=bool)
        self.sizes = np.zeros(self.size, dtype=np.int64)
        #: whether a token holds the two bytes side by side
        self.joins = np.zeros((256, 256), dtype=bool)
        for b, i in ranks.items():
            self.known[i] = True
            self.begins[i] = b[0] < 128 and not b[:1].isalnum()
            self.sizes[i] = len(b)
            self.joins[list(b[:-1]), list(b[1:])] = True
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        pairs = [(ranks[b[:i]] << 16 | ranks[b[i:]], m) for b, m in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        self._table("merges", {"pair": np.array([p for p, _ in pairs], dtype=np.uint32), "m": np.array([m for _, m in pairs], dtype=np.uint32)})
        # bytes are shown as the characters from U+0100 on, so that none is a NUL
        self._table("vocabulary", {"id": np.fromiter(ranks.values(), dtype=np.uint32, count=len(ranks)), "chars": [b.decode("latin-1").translate(_UP) for b in ranks]})
        self.ids = Recent()

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"create or replace table {name} as select * from given")
        self.con.unregister("given")

    def split(self, text: str) -> list[str]:
        return (_LATIN if self.latin and _is_latin(text) else self.pattern).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for a, b in blocks([len(t) for t in texts], 2 * BLOCK):
            some, at = [], [0]
            for x, y in blocks([len(t) for t in texts[a:b]], BLOCK // 4):  # the words of a few texts are Python's at once
                words, n = [], at[-1]
                for t in texts[a + x : a + y]:
                    words += self.split(t)
                    at.append(n + len(words))
                some.append(pa.array(words, pa.string()))
            met = pa.concat_arrays(some).dictionary_encode()
            del some
            distinct = met.dictionary.to_numpy(zero_copy_only=False).tolist()
            self._learn(self.ids.missing(distinct))
            out += _gathered(pa.array(map(self.ids.__getitem__, distinct), pa.binary()), met.indices, at)
        return out

    def _learn(self, words: list[str]) -> None:
        """Work out the ids of new words."""
        whole: list[tuple[str, bytes]] = []
        waiting: list[tuple[Generator, list[bytes]]] = []
        for w in words:
            b = w.encode()
            if (i := self.ranks.get(b)) is not None:
                self.ids.add(w, i.to_bytes(4, "little"))
            elif len(b) <= PIECE:
                whole.append((w, b))
            else:
                run = self._spliced(w, b)
                waiting.append((run, next(run)))
        for (w, _), ids in zip(whole, self._contract([b for _, b in whole])):
            self.ids.add(w, ids)
        # a few long words at a time, so that their pieces are bounded too
        while waiting:
            some, n = [], 0
            while waiting and n < BLOCK:
                some.append(waiting.pop())
                n += sum(map(len, some[-1][1]))
            pieces = list({p for _, asked in some for p in asked})
            got = dict(zip(pieces, self._contract(pieces)))
            for run, asked in some:
                if more := run.send([got[p] for p in asked]):
                    waiting.append((run, more))

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Of each short word its ids, packed: the recursive query, over words of about one length, which take as many steps."""
        out: dict[bytes, bytes] = {}
        inorder = sorted(words, key=len)
        for a, b in blocks([len(w) * len(w) for w in inorder], STEPS):
            some = inorder[a:b]
            n = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
            self._table("words", {
                "w": np.repeat(np.arange(len(some), dtype=np.uint32), n),
                "pos": (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint32),
                "tok": self.byte_ids[np.frombuffer(b"".join(some), dtype=np.uint8)],
            })
            got = self.con.sql(_ENCODE).to_arrow_table()
            ids = got["tok"].to_numpy().astype("<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(got["w"].to_numpy(), minlength=len(some)))).tolist()
            out.update((w, ids[x:y]) for w, x, y in zip(some, [0, *ends], ends))
        return list(map(out.__getitem__, words))

    def _spliced(self, w: str, b: bytes) -> Generator:
        """Asks for the pieces of a long word by lists, is sent their ids, and keeps the word's in the end."""
        data = np.frombuffer(b, dtype=np.uint8)
        cuts = [0, *(np.flatnonzero(~self.joins[data[:-1], data[1:]]) + 1).tolist(), len(b)]
        parts = [b[x:y] for x, y in zip(cuts, cuts[1:])]
        step = PIECE // 2
        done: dict[bytes, bytes] = {}
        for a, z in blocks([2 * len(p) for p in parts], BLOCK):
            asked = {p[x : x + PIECE] for p in parts[a:z] if p not in done for x in (range(0, len(p), step) if len(p) > PIECE else (0,))}
            asked = list(asked.difference(done))
            if asked:
                done.update(zip(asked, (yield asked)))
            for p in {*parts[a:z]}:
                if p not in done:
                    done[p] = yield from self._joined(p, done)
        self.ids.add(w, b"".join(map(done.__getitem__, parts)))
        yield []

    def _joined(self, b: bytes, known: dict[bytes, bytes]) -> Generator:
        """The ids of ``b``, from those of overlapping pieces."""
        step, extra = PIECE // 2, {}

        def tokens(a: int, z: int):
            if (p := b[a:z]) not in known and p not in extra:
                if len(extra) > 4096:
                    extra.clear()
                [extra[p]] = yield [p]
            ids = np.frombuffer(known.get(p) or extra[p], dtype="<u4")
            return (a + np.cumsum(self.sizes[ids]) - self.sizes[ids]).tolist(), ids.tolist()

        at, ids = yield from tokens(0, PIECE)  # at: where the tokens begin
        end, back = min(PIECE, len(b)), 0
        while end < len(b):
            # first the piece that was asked for ahead, then pieces that begin with a token, ever longer ones
            begin = (end - step) // step * step if not back else at[max(0, bisect_right(at, end - back) - 1)]
            stop = min(begin + PIECE if not back else end + back, len(b))
            places, more = yield from tokens(begin, stop)
            if not begin:
                at, ids, end, back = places, more, stop, 0
                continue
            low = bisect_left(at, begin)
            met = set(zip(at[low:], ids[low:]))
            k = next((k for k, t in enumerate(zip(places, more)) if t in met), None)
            if k is None:
                back = 2 * back or step
                continue
            keep = bisect_left(at, places[k])
            del at[keep:], ids[keep:]
            at += places[k:]
            ids += more[k:]
            end, back = stop, 0
        return np.array(ids, dtype="<u4").tobytes()

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The bytes that each row of ids stands for."""
        out: list[bytes] = []
        for a, b in blocks([len(x) for x in rows], 4 * BLOCK):
            runs, at = self._cut(rows[a:b])
            met = runs.dictionary_encode()
            out += _gathered(self._spell(met.dictionary), met.indices, at)
        return out

    def _cut(self, rows: list[bytes]) -> tuple[pa.Array, list[int]]:
        """The runs of all rows, one after the other, and which run each row begins with."""
        if any(len(x) % 4 for x in rows):
            raise ValueError("ids take four bytes each")
        packed = b"".join(rows)
        ids = np.frombuffer(packed, dtype="<u4")
        if len(ids) and (ids.max() >= self.size or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        ends = np.cumsum([0, *(len(x) // 4 for x in rows)])
        begins = self.begins[ids]
        begins[::256] = True  # bounds a run
        begins[ends[ends < len(ids)]] = True
        first = np.flatnonzero(begins)
        places = np.append(4 * first, len(packed)).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(packed)])
        return runs, np.searchsorted(first, ends).tolist()

    def _spell(self, runs: pa.Array) -> pa.Array:
        """The bytes of each run."""
        if not len(runs):
            return pa.array([], pa.binary())
        places = np.frombuffer(runs.buffers()[1], dtype=np.int32)[: len(runs) + 1] // 4
        ids = np.frombuffer(runs.buffers()[2], dtype="<u4")[: places[-1]]
        chars = []
        for a in range(0, len(ids), QUERY_IDS):
            some = ids[a : a + QUERY_IDS]
            self._table("runs", {"pos": np.arange(len(some), dtype=np.uint32), "id": some})
            chars.append(self.con.sql(_DECODE).fetchall()[0][0].encode("utf-16-le")[::2])
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[places].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(runs), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(chars))])


def _is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def _gathered(values: pa.Array, numbers: pa.Array, at: list[int]) -> list[bytes]:
    """Of each row, which begins at a place in ``numbers``, the values of its numbers, side by side."""
    if not len(numbers):
        return [b""] * (len(at) - 1)
    joined = values.take(numbers)
    places = np.frombuffer(joined.buffers()[1], dtype=np.int32)[at].tolist()
    data = memoryview(joined.buffers()[2])
    return [bytes(data[x:y]) for x, y in zip(places, places[1:])]


_UP = {i: i + 256 for i in range(256)}
_codecs: dict[str, Codec] = {}


def _codec(packed: bytes, pattern: str) -> Codec:
    """This worker's codec; a worker serves many tasks."""
    key = hashlib.sha256(packed + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, packed.splitlines())}, pattern)
    return _codecs[key]


def _mapped(df: DataFrame, given: str, id_col: str, ranks_path: str, pattern: str, outputs: tuple[str, ...]) -> DataFrame:
    with open(ranks_path, "rb") as f:
        ranks = f.read()  # fixed size: that of the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            values = batch.column(1)
            for a, b in blocks(pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist(), 2 * BLOCK):
                some = [x or type(x or b"")() for x in values.slice(a, b - a).to_pylist()]
                cols, ids = [batch.column(0).slice(a, b - a)], some
                if "ids" in outputs:
                    ids = codec.encode([x or "" for x in some])
                    cols.append(pa.array(ids, pa.binary()))
                if "decoded" in outputs:
                    cols.append(pa.array(codec.decode(ids), pa.binary()))
                out = pa.RecordBatch.from_arrays(cols, names=[id_col, *outputs])
                del some, ids, cols
                trim()
                yield out

    schema = ", ".join([f"`{id_col}` {df.schema[id_col].dataType.simpleString()}", *(f"{x} binary" for x in outputs)])
    return df.select(id_col, given).mapInArrow(run, schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each text's token ids, packed as little-endian unsigned 32-bit integers."""
    return _mapped(df, text_col, id_col, ranks_path, pattern, ("ids",))


def decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the bytes of packed ids."""
    return _mapped(df, ids_col, id_col, ranks_path, pattern, ("decoded",))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) in one pass: what ``decode`` makes of what ``encode`` made."""
    return _mapped(df, text_col, id_col, ranks_path, pattern, ("ids", "decoded"))


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ``round_trip``."""
    return coded.select(
        F.col(id_col),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
