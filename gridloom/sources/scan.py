"""Scans: any format that Spark reads is a cube's backing store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from ..cube import Cube


def open_cube(spark: SparkSession, path: str, dims: Sequence[str] | Mapping[str, str], values: Sequence[str], fmt: str = "parquet", schema: str | None = None, **options) -> Cube:
    """A lazy cube over files; only the named columns are read, and index ranges are pushed to the scan."""
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    return Cube.from_table(df, dims, values)


def read_range(cube: Cube, windows: Mapping[str, Sequence[tuple[int, int]]]) -> Cube:
    """The cells of the bounding range of some windows in each dimension."""
    return cube.subset(**{d: (min(a for a, _ in w), max(b for _, b in w)) for d, w in windows.items()})
