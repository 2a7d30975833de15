"""Shared pieces of the training-data operators: shared-folder tables, row numbers, byte words."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ``[\x20\x09-\x0D]`` matches; ``bytes.split()`` splits on exactly these.
WHITE = " \t\n\x0b\x0c\r"

_libc = ctypes.CDLL(None)
_own_dirs: dict[str, str] = {}
_open: list["Workspace"] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session is one machine (tests) a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return _own_dirs[app]


class Workspace:
    """Intermediate Parquet tables of one operator call, in the shared folder.

    A saved table cuts the lineage: a lost executor costs the tasks it ran, never
    a recomputation from the source. The tables back lazy results, so they live
    until ``drop`` (one table), ``close`` or ``close_all`` is called.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _open.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self.read(path, df.schema)

    def read(self, path: str, schema) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        out._gridloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that no later step reads."""
        remove(self.spark, df._gridloom_path)

    def release(self) -> None:
        """Let the context cleaner delete the shuffle files of finished steps."""
        gc.collect()
        bus = self.spark.sparkContext._jsc.sc().listenerBus()
        with suppress(Py4JJavaError):  # events that wait hold the plans of their steps; a busy bus is no failure
            bus.waitUntilEmpty(5000)
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        remove(self.spark, self.path)
        if any(w is self for w in _open):
            _open.remove(self)


@contextmanager
def opened() -> Iterator[list[Workspace]]:
    """A list that has, afterwards, the workspaces opened meanwhile, for their caller to close."""
    before, mine = list(_open), []
    yield mine
    mine += [w for w in _open if not any(w is x for x in before)]


def close_all() -> None:
    """Delete the tables of all earlier calls; their lazy results can't be read afterwards."""
    for ws in list(_open):
        ws.close()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Files up to which their offsets, a row each, are sent to all tasks.
FILES = 200_000


def numbered(df: DataFrame, ws: Workspace, name: str = "rid") -> DataFrame:
    """``df`` with row numbers 0, 1, ... that are the same in each evaluation.

    Over a scan of whole Parquet files a row's number is the number of rows in the files
    before its own, which are counted here, and its place in the file: however the scan
    is cut, by however many executors, it stays. Anything else is saved first.
    """
    found = _placed(df, name)
    if found is None:
        found = _placed(ws.save(df, "rows"), name, trusted=True)
    return found


def _placed(df: DataFrame, name: str, trusted: bool = False) -> DataFrame | None:
    try:
        meta = df.metadataColumn("_metadata")
        rows = df.withColumns({f"__file_{name}": meta["file_path"], f"__row_{name}": meta["row_index"]})
        files = rows.groupBy(f"__file_{name}").agg(F.count("*"), F.max(f"__row_{name}") + 1).limit(FILES + 1).collect()
    except AnalysisException:  # no scan of Parquet files
        files = None
    if files is None or len(files) > FILES or any(n != last for _, n, last in files):
        if trusted:
            raise ValueError(f"a table of more than {FILES} files can't be numbered")
        return None
    begins, total = [], 0
    for path, n, _ in sorted(files):
        begins.append((path, total))
        total += n
    spark = df.sparkSession
    begin = F.broadcast(spark.createDataFrame(begins, f"__file_{name} string, __begin_{name} long"))
    return rows.join(begin, f"__file_{name}").withColumn(name, F.col(f"__begin_{name}") + F.col(f"__row_{name}")).select(*[df[c] for c in df.columns if c != name], name)


def without(docs: DataFrame, judged: Callable[[DataFrame, str], DataFrame], ws: Workspace) -> DataFrame:
    """``docs`` but for the rows whose numbers ``judged``, given the numbered rows and the number's name, returns as ``rid``."""
    name = "rid"
    while name in docs.columns:
        name += "_"
    rows = numbered(docs, ws, name)
    gone = sized(ws.save(judged(rows, name).select(F.col("rid").alias(f"gone_{name}")).distinct(), "gone"))
    return rows.join(gone, rows[name] == gone[f"gone_{name}"], "left_anti").select(*docs.columns)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What runs meanwhile passes at most ``rows`` rows at once to Python, which bounds buffers on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def release_heap(spark: SparkSession) -> None:
    """Let the executors collect garbage and give heap that they don't need back to the machine.

    Their Python workers share the machine's memory with the heap, which stays as large as
    the hungriest stage before has made it. A task for each core asks its executor.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def trim() -> None:
    """Give the memory of batches that are done back to the machine; a worker serves many tasks."""
    pa.default_memory_pool().release_unused()
    if (give := getattr(_libc, "malloc_trim", None)) is not None:
        give(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows (of a few numbers each) up to which a saved table is sent to all tasks.
BROADCAST_ROWS = 200_000


def sized(saved: DataFrame) -> DataFrame:
    """A saved table of narrow rows, marked for broadcast if its rows, which are counted, are few enough."""
    return F.broadcast(saved) if saved.count() <= BROADCAST_ROWS else saved


def sampled(df: DataFrame, most: int, ws: Workspace) -> list:
    """At most ``most`` rows, chosen by a hash of their row numbers.

    Only about as many reach the driver: a threshold on the hash, not a sort, picks them.
    """
    n = df.count()
    rows = numbered(df, ws, "__rid").withColumn("__h", F.expr("pmod(xxhash64(__rid), 1073741824)"))
    if n > most:
        rows = rows.where(F.col("__h") < int((1.1 * most + 100) / n * (1 << 30)))
    return sorted(rows.collect(), key=lambda r: (r["__h"], r["__rid"]))[:most]


def blocks(lengths: list[int], most: int):
    """Ranges of rows with about ``most`` characters in all; a longer row stands alone."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)
