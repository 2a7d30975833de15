"""Writing cubes: chunked layouts, rechunking, and block-wise runs that can be resumed."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube
from ..operators.windows import Ranges, Sliding, Tumbling, Windows


def chunk_columns(cube: Cube, chunks: Mapping[str, int]) -> dict[str, object]:
    return {f"c_{d}": F.floor((F.col(d) - cube.origin.get(d, 0)) / n).cast("int") for d, n in chunks.items()}


def write_cube(cube: Cube, path: str, chunks: Mapping[str, int] | None = None, shape: Mapping[str, int] | None = None, mode: str = "errorifexists") -> None:
    """Write a cube; with ``chunks`` rows of a chunk lie side by side, in files cut by range of chunks.

    Cells outside ``shape`` are left out, as the target has no place for them. A chunk
    column is stored, so that a reader of some chunks skips the files of the others.
    """
    df = cube.df
    for d, n in (shape or {}).items():
        o = cube.origin.get(d, 0)
        df = df.where(F.col(d).between(o, o + n - 1))
    if chunks:
        cols = chunk_columns(cube, chunks)
        df = df.withColumns(cols).repartitionByRange(*cols).sortWithinPartitions(*cols, *cube.dims)
    df.write.mode(mode).parquet(path)


def same_shape(cube: Cube, shape: Mapping[str, int]) -> None:
    """ValueError if the cube hasn't the shape of its target."""
    c = cube.measured()
    if {d: c.shape[d] for d in c.dims} != dict(shape):
        raise ValueError(f"shape {c.shape} for a target of {dict(shape)}")


def copy_to(cube: Cube, path: str, shape: Mapping[str, int], chunks: Mapping[str, int] | None = None) -> None:
    """Work out a cube straight into a target of a given shape and chunking, in place of what was there."""
    same_shape(cube, shape)
    write_cube(cube, path, chunks, mode="overwrite")


def rechunk(cube: Cube, chunks: Mapping[str, int] | None, path: str, mode: str = "errorifexists", shape: Mapping[str, int] | None = None) -> Cube:
    """The same cells in another chunking (``planned_chunks`` if None), written to ``path`` and read from there."""
    chunks = planned_chunks(cube) if chunks is None else chunks
    if unknown := set(chunks) - set(cube.dims):
        raise ValueError(f"no dimensions {sorted(unknown)}")
    if shape is not None:
        same_shape(cube, shape)
    write_cube(cube, path, chunks, mode=mode)
    back = cube.df.sparkSession.read.parquet(path).select(*cube.dims, *cube.values)
    return Cube(back, cube.dims, cube.values, dict(cube.shape), dict(cube.origin))


def planned_chunks(cube: Cube, rows: int = 4_000_000, stored: Mapping[str, int] | None = None) -> dict[str, int]:
    """A chunk length for each dimension, so that a full chunk has at most about ``rows`` cells.

    Lengths are multiples of those that are ``stored`` (of 1 where nothing is known), so that
    a stored chunk is read for one new chunk. Starting from one stored chunk, the dimension
    whose chunk covers the least of its length is doubled while that fits.
    """
    c = cube.measured()
    unit = {d: max(1, min((stored or {}).get(d, 1), max(c.shape[d], 1))) for d in c.dims}
    out = dict(unit)
    while True:
        open_ = [d for d in c.dims if out[d] < c.shape[d]]
        grown = [d for d in open_ if math.prod(out.values()) * 2 <= rows]
        if not grown:
            return out
        d = min(grown, key=lambda d: out[d] / c.shape[d])
        out[d] *= 2


Block = tuple[tuple[int, int], ...]


def blocks_of(ranges: Sequence[Sequence[tuple[int, int]]]) -> list[Block]:
    """The product of the ranges of each dimension, the first one changing fastest."""
    return [tuple(reversed(b)) for b in product(*reversed(ranges))]


class Manifest:
    """The blocks of a run below ``path``, and which are done: those whose folder Spark has committed.

    With ``batches``, blocks are taken together in at most so many batches of consecutive
    ones; a batch has one folder, and its blocks are done together. A run that goes on keeps
    the batches that it was planned with.
    """

    def __init__(self, spark: SparkSession, path: str, blocks: list[Block], mode: str, batches: int | None = None):
        if mode not in ("continue", "overwrite"):
            raise ValueError(f"mode {mode!r}; there are continue and overwrite")
        if batches is not None and batches < 1:
            raise ValueError("a run has at least one batch")
        self.spark, self.path, self.blocks = spark, path, blocks
        #: blocks a batch; 0 where each block is on its own
        self.width = 0 if batches is None else max(1, -(-len(blocks) // batches))
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        plan = f"{path}/_plan"
        there = self._fs.exists(self._hadoop(plan))
        if mode == "overwrite":
            self._fs.delete(self._hadoop(path), True)
            there = False
        if there:
            rows = spark.read.parquet(plan).orderBy("n").collect()
            planned = [tuple(map(tuple, r.b)) for r in rows]
            if planned != blocks:
                raise ValueError("the manifest belongs to a run over other blocks")
            width = rows[0].width if rows else self.width
            if bool(width) != bool(self.width):
                raise ValueError("the manifest belongs to a run with or without batches")
            self.width = width
        else:
            rows = [(n, [list(x) for x in b], self.width) for n, b in enumerate(blocks)]
            spark.createDataFrame(rows, "n long, b array<array<long>>, width long").coalesce(1).write.parquet(plan)

    def folder(self, n: int) -> str:
        """The folder of block ``n``, or of the batch that it is in."""
        return f"{self.path}/batch={n // self.width}" if self.width else f"{self.path}/block={n}"

    def is_done(self, n: int) -> bool:
        return self._fs.exists(self._hadoop(f"{self.folder(n)}/_SUCCESS"))

    def parts(self) -> list[range]:
        """The blocks' numbers by batch, or one by one."""
        return [range(a, min(a + (self.width or 1), len(self.blocks))) for a in range(0, len(self.blocks), self.width or 1)]

    def open_parts(self) -> list[range]:
        return [p for p in self.parts() if not self.is_done(p[0])]

    def finished(self) -> list[Block]:
        left = {n for n, _ in self.remaining()}
        return [b for n, b in enumerate(self.blocks) if n not in left]

    def remaining(self) -> list[tuple[int, Block]]:
        return [(n, self.blocks[n]) for p in self.open_parts() for n in p]

    def delete(self) -> None:
        self._fs.delete(self._hadoop(f"{self.path}/_plan"), True)


def _windows(ranges: Sequence[tuple[int, int]]) -> Windows:
    """Ranges by a formula if they follow one (the last one may be shorter), else as listed."""
    (lo, hi), n = ranges[0], len(ranges)
    step, end = ranges[1][0] - lo if n > 1 else hi - lo + 1, ranges[-1][1]
    w = Sliding(lo, step, hi - lo + 1, n, clamp=(lo, end))
    if step > 0 and hi >= lo and all(w[k] == tuple(r) for k, r in enumerate(ranges, 1)):
        return Tumbling(lo, step, n) if w.width == step else w
    return Ranges([tuple(r) for r in ranges])


def batch_of(cube: Cube, ranges: Mapping[str, Sequence[tuple[int, int]]], numbers: range) -> Cube:
    """The cells of some consecutive blocks, with the block's number as a dimension ``block`` in front.

    A cell is there once for each block that holds it. Only the range that the blocks cover
    is asked of the scan.
    """
    index, below = F.lit(0).cast("long"), 1
    spans, df = {}, cube.df
    for d, r in ranges.items():
        # the entries of this dimension's list that the blocks use: all, where they go round it
        first, n = numbers[0] // below, numbers[-1] // below - numbers[0] // below + 1
        used = range(len(r)) if n >= len(r) or first % len(r) + n > len(r) else range(first % len(r), first % len(r) + n)
        listed = [tuple(r[k]) for k in used]
        spans[d] = min(lo for lo, _ in listed), max(hi for _, hi in listed)
        df = _windows(listed).assign(df.where(F.col(d).between(*spans[d])), d, f"__{d}")
        index = index + (F.col(f"__{d}") - 1 + used[0]) * below
        below *= len(r)
    rows = df.withColumn("block", index).where(F.col("block").between(numbers[0], numbers[-1])).select("block", *cube.dims, *cube.values)
    shape = {d: hi - lo + 1 for d, (lo, hi) in spans.items()}
    return Cube(rows, ("block", *cube.dims), cube.values, cube.shape | shape | {"block": len(numbers)}, cube.origin | {d: lo for d, (lo, _) in spans.items()} | {"block": numbers[0]})


def run_blocks(cube: Cube, f: Callable[[Cube], DataFrame], ranges: Mapping[str, Sequence[tuple[int, int]]], path: str, mode: str = "overwrite", progress: Callable[[int, int], None] | None = None, parallel: int = 8, batches: int | None = None) -> DataFrame:
    """``f`` of each block of the cube, written below ``path``; a stopped run goes on with mode ``continue``.

    ``parallel`` blocks run side by side, a job each; Spark shares its executors among them.
    ``progress`` is called with the number of blocks done and of all blocks after each one.
    A block's folder is committed as a whole and may be written again, so a block that was
    cut off leaves nothing behind. The plan goes when all blocks are done.

    A job for each block is too much where blocks are many and small. With ``batches``, the
    blocks are taken together in at most so many jobs. ``f`` then gets all blocks of a batch
    as one cube, whose first dimension ``block`` is the block's number; operators keep
    dimensions that they don't reduce apart, so what ``f`` makes of a block is the same as
    on its own. Its result has to keep the column ``block``. A batch is committed as a whole.
    """
    spark = cube.df.sparkSession
    manifest = Manifest(spark, path, blocks_of(list(ranges.values())), mode, batches)
    todo, total = manifest.open_parts(), len(manifest.blocks)
    if manifest.width and not total:  # nothing to write, so nothing to read
        return f(Cube(cube.df.where(F.lit(False)).withColumn("block", F.lit(0).cast("long")).select("block", *cube.dims, *cube.values), ("block", *cube.dims), cube.values, cube.shape | {"block": 0}, cube.origin | {"block": 0}))

    def one(part: range) -> int:
        if manifest.width:
            out = f(batch_of(cube, ranges, part))
            if "block" not in out.columns:
                raise ValueError("the result of a batch has to keep its column block")
        else:
            out = f(cube.subset(**dict(zip(ranges, manifest.blocks[part[0]]))))
        out.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(manifest.folder(part[0]))
        return len(part)

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(one), part) for part in todo]
        done = total - sum(map(len, todo))
        try:
            for job in as_completed(running):
                done += job.result()
                if progress:
                    progress(done, total)
        except BaseException:
            for job in running:
                job.cancel()
            raise
    manifest.delete()
    if manifest.width:
        return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
    return spark.read.option("basePath", path).parquet(f"{path}/block=*")
