"""Token-ID output in training order: a keyed permutation of documents, written as fixed-stride shards.

Each document's token sequence gets a global slot: a Feistel permutation over the next
even power of two, walked along its cycle until it falls below the number of documents,
maps row numbers one-to-one onto slots. So the training order needs no sort key, no
shuffled index and no memory, and any slot can be worked out again from the key.

Slots are dealt to shards by range. A shard is written by one task in slot order: the
sequences, each closed by the end token, are packed into rows of ``stride`` ids; the
last row is filled with end tokens. Row i of a shard begins at byte ``i * stride * size``,
so a reader resumes at any row by one seek. The placement table says for every document
where it begins.

Ids are written as little-endian unsigned 16-bit integers, or 32-bit ones for
vocabularies over 65,535. Files have names that no other attempt uses; those of failed
attempts are deleted when the write commits. Null texts count as empty: a lone end
token. Repeated rows and null ids are sequences of their own. An empty table writes no
shard. Other columns of the table are not read, so that their names can't clash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Codec, Recent, read_ranks
from .common import Workspace, blocks, numbered, trim
from .warc import _fs

#: Ids of a row, documents of a shard, rounds of the permutation.
STRIDE, SHARD_DOCS, ROUNDS = 2048, 50_000, 6


def permute(index: np.ndarray, n: int, key: bytes) -> np.ndarray:
    """Slots of the row numbers ``index`` (below ``n``)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(key + bytes([r])).digest()[:8], "little")) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ k
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (f >> np.uint64(29)) & mask
        return left << np.uint64(half) | right

    out = once(np.asarray(index, dtype=np.uint64))
    while (over := out >= np.uint64(n)).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


class Encoder:
    """Ids by the tokenizer library, with the words that this worker has met kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kind: str):
        self.codec = Codec.__new__(Codec)  # for its splitter alone
        import public_tokenizers
        import regex

        self.codec.pattern, self.codec.latin = regex.compile(pattern), pattern == public_tokenizers.PATTERN
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kind, self.known = kind, Recent()

    def __call__(self, text: str) -> bytes:
        known, words = self.known, self.codec.split(text)
        for w in known.missing(set(words)):
            known.add(w, np.array(self.encoding.encode_ordinary(w), dtype=self.kind).tobytes())
        return b"".join(map(known.__getitem__, words))


_encoders: dict[tuple, Encoder] = {}


def write_shards(docs: DataFrame, path: str, ranks_path: str, pattern: str, key: bytes = b"gridloom", stride: int = STRIDE, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards below ``path``; returns (doc_id, slot, shard, file, first_id, n_ids, ids_sha256).

    ``ids_sha256`` is of the ids as they were read back from the finished file.
    """
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "placement")
    docs = numbered(docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)), ws)
    n = docs.count()
    ranks = read_ranks(ranks_path)
    end = max(ranks.values()) + 1
    kind = "<u2" if end < 1 << 16 else "<u4"
    shards = max(1, -(-n // shard_docs), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n))
    id_kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = (len(ranks), pattern, kind)
        encoder = _encoders.setdefault(at, Encoder(ranks, pattern, kind)) if at not in _encoders else _encoders[at]
        for batch in batches:
            slot = permute(batch.column(0).to_numpy(), n, key)
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(2)), 0).to_pylist()
            for a, b in blocks(lengths, 4 << 20):
                ids = [encoder(t.as_py() or "") for t in batch.column(2).slice(a, b - a)]
                trim()
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(slot[a:b]), pa.array((slot[a:b] * shards // n).astype(np.int32)), pa.array(ids, pa.binary())], names=["doc_id", "slot", "shard", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(path)
        size, now, out, rows = np.dtype(kind).itemsize, None, None, []
        stop, at, name, kind_of_id = np.array([end], dtype=kind).tobytes(), 0, "", None

        def close() -> pa.RecordBatch:
            """Finish a file, and read it back for the digests of what it holds."""
            nonlocal out, rows
            out.write(stop * (-at % stride))
            out.close()
            with fs.open_input_file(f"{base}/{name}") as f:
                done = [(*r, hashlib.sha256(f.read_at(r[5] * size, r[4] * size)).hexdigest()) for r in rows]
            out, rows = None, []
            kinds = [kind_of_id, pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=["doc_id", "slot", "shard", "file", "first_id", "n_ids", "ids_sha256"])

        for batch in batches:
            kind_of_id = batch.schema.types[0]
            for doc_id, slot, shard, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    if out is not None:
                        yield close()
                    now, at = shard, 0
                    name = f"shard-{shard:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}.bin"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                out.write(ids + stop)
                rows.append((doc_id, slot, shard, name, at, len(ids) // size))
                at += len(ids) // size + 1
        if out is not None:
            yield close()

    fs, base = _fs(path)
    fs.create_dir(base, recursive=True)
    coded = docs.select("rid", id_col, text_col).mapInArrow(encode, f"doc_id {id_kind}, slot long, shard int, ids binary")
    ordered = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    placed = ws.save(ordered.mapInArrow(write, f"doc_id {id_kind}, slot long, shard int, file string, first_id long, n_ids long, ids_sha256 string"), "placed")
    keep = {r.file for r in placed.select("file").distinct().toLocalIterator()}  # one name for each shard
    from pyarrow.fs import FileSelector

    for x in fs.get_file_info(FileSelector(base)):
        if x.base_name.endswith(".bin") and x.base_name not in keep:
            fs.delete_file(x.path)
    return placed


def read_shards(spark: SparkSession, path: str, stride: int = STRIDE, kind: str = "<u2", after: tuple[int, int] = (-1, -1), rows_a_task: int = 4096) -> DataFrame:
    """(shard, row, ids): rows of ``stride`` ids in training order, after (shard, row) where a reader stopped."""
    from pyarrow.fs import FileSelector

    fs, base = _fs(path)
    width = stride * np.dtype(kind).itemsize
    plan = []
    for x in fs.get_file_info(FileSelector(base)):
        if x.base_name.endswith(".bin"):
            shard = int(x.base_name.split("-")[1])
            begin = after[1] + 1 if shard == after[0] else 0 if shard > after[0] else None
            if begin is not None:
                plan += [(x.base_name, shard, a, min(rows_a_task, x.size // width - a)) for a in range(begin, x.size // width, rows_a_task)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(path)
        for batch in batches:
            for name, shard, first, rows in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{base}/{name}") as f:
                    f.seek(first * width)
                    data = np.frombuffer(f.read(rows * width), dtype=kind).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.arange(0, len(data) + 1, stride, dtype=np.int32)), pa.array(data))
                yield pa.RecordBatch.from_arrays([pa.array([shard] * rows, pa.int32()), pa.array(range(first, first + rows), pa.int64()), ids], names=["shard", "row", "ids"])

    tasks = spark.createDataFrame(sorted(plan, key=lambda x: (x[1], x[2])), "name string, shard int, first long, rows long")
    return tasks.repartition(max(1, len(plan)), "shard", "first").mapInArrow(run, "shard int, row long, ids array<int>")
