"""The cube: a DataFrame whose dimension columns are integer indices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cube:
    """``df`` has the columns ``dims`` (integers from ``origin``) and ``values``.

    ``shape`` holds the length of each dimension; lengths that are not given are measured
    when an operator needs them. A cell without a row is missing, like a null value; only
    operators that tell the two apart need ``densify``.
    """

    df: DataFrame
    dims: tuple[str, ...]
    values: tuple[str, ...]
    shape: dict[str, int] = field(default_factory=dict)
    origin: dict[str, int] = field(default_factory=dict)

    # -- construction ------------------------------------------------------------------
    @classmethod
    def from_table(cls, df: DataFrame, dims: Sequence[str] | Mapping[str, str], values: Sequence[str] | Mapping[str, Column], shape: Mapping[str, int] | None = None, origin: Mapping[str, int] | None = None) -> "Cube":
        """A cube over a table. A mapping of ``dims`` names each dimension: {name: column}."""
        named = dict(dims) if isinstance(dims, Mapping) else {d: d for d in dims}
        exprs = dict(values) if isinstance(values, Mapping) else {v: F.col(v) for v in values}
        rows = df.select(*(F.col(c).cast("long").alias(d) for d, c in named.items()), *(e.alias(v) for v, e in exprs.items()))
        return cls(rows, tuple(named), tuple(exprs), dict(shape or {}), {d: 0 for d in named} | dict(origin or {}))

    @classmethod
    def from_arrays(cls, df: DataFrame, row_dim: str, array: str, dim: str = "d", value: str = "value", shape: Mapping[str, int] | None = None, origin: int = 0) -> "Cube":
        """A cube of an array column: its places become a dimension."""
        rows = df.select(F.col(row_dim).cast("long").alias(row_dim), F.posexplode(array).alias(dim, value))
        rows = rows.select(row_dim, (F.col(dim) + origin).cast("long").alias(dim), F.col(value).cast("double").alias(value))
        return cls(rows, (row_dim, dim), (value,), dict(shape or {}), {row_dim: 0, dim: origin})

    @classmethod
    def from_nested(cls, spark: SparkSession, data, dims: Sequence[str], value: str = "value", kind: str = "double", origin: int = 1) -> "Cube":
        """A cube of nested lists in the driver's memory; None is a missing cell."""
        lengths, level = [], data
        for _ in dims:
            lengths.append(len(level))
            level = level[0] if level else []
        as_kind = (lambda x: None if x is None else float(x)) if kind in ("double", "float") else (lambda x: x)
        rows = [(*(i + origin for i in at), as_kind(reduce(lambda x, i: x[i], at, data))) for at in product(*map(range, lengths))]
        schema = ", ".join([*(f"{d} long" for d in dims), f"{value} {kind}"])
        return cls(spark.createDataFrame(rows, schema), tuple(dims), (value,), dict(zip(dims, lengths)), {d: origin for d in dims})

    @classmethod
    def constant(cls, spark: SparkSession, x, value: str = "value") -> "Cube":
        """A cube without dimensions: one number that takes part in no loop."""
        return cls(spark.range(1).select(F.lit(x).alias(value)), (), (value,), {}, {})

    @classmethod
    def product(cls, spark: SparkSession, **lists: Sequence) -> "Cube":
        """Every combination of the lists' entries: dimensions of their lengths, one value column a list."""
        dims = tuple(f"i_{n}" for n in lists)
        rows = cls(spark.range(0).select(*(F.col("id").alias(d) for d in dims)), dims, (), {d: len(v) for d, v in zip(dims, lists.values())}, {d: 1 for d in dims}).grid()
        for d, (n, v) in zip(dims, lists.items()):
            rows = rows.withColumn(n, F.element_at(F.array(*map(F.lit, v)), F.col(d).cast("int")))
        return cls(rows, dims, tuple(lists), {d: len(v) for d, v in zip(dims, lists.values())}, {d: 1 for d in dims})

    # -- shape -------------------------------------------------------------------------
    def measured(self) -> "Cube":
        """The cube with all its lengths known; one aggregation if any is not."""
        unknown = [d for d in self.dims if d not in self.shape]
        if not unknown:
            return self
        row = self.df.agg(*(F.max(d).alias(d) for d in unknown)).first()
        return replace(self, shape=self.shape | {d: 0 if row[d] is None else row[d] - self.origin.get(d, 0) + 1 for d in unknown})

    def grid(self) -> DataFrame:
        """Every index of the cube, made in parallel from one range."""
        c = self.measured()
        total = reduce(lambda a, d: a * c.shape[d], c.dims, 1)
        rows, below = c.df.sparkSession.range(total), 1
        cols = []
        for d in c.dims:  # the first dimension changes fastest
            cols.append((F.floor(F.col("id") / below) % c.shape[d] + c.origin.get(d, 0)).cast("long").alias(d))
            below *= c.shape[d]
        return rows.select(*cols)

    def densify(self) -> "Cube":
        """A row for every cell; cells that had none hold nulls."""
        c = self.measured()
        return replace(c, df=c.grid().join(c.df, list(c.dims), "left"))

    def subset(self, **ranges: tuple[int, int]) -> "Cube":
        """The cells whose indices lie in the inclusive ranges; plain comparisons, which reach the scan."""
        out = self.df
        for d, (lo, hi) in ranges.items():
            out = out.where((F.col(d) >= lo) & (F.col(d) <= hi))
        return replace(self, df=out, shape=self.shape | {d: hi - lo + 1 for d, (lo, hi) in ranges.items()}, origin=self.origin | {d: lo for d, (lo, _) in ranges.items()})

    def rename(self, **names: str) -> "Cube":
        """New dimension names: cubes meet in an operator on dimensions of one name."""
        new = {d: names.get(d, d) for d in self.dims}
        cols = [F.col(d).alias(n) for d, n in new.items()]
        return replace(self, df=self.df.select(*cols, *self.values), dims=tuple(new.values()), shape={new[d]: n for d, n in self.shape.items()}, origin={new[d]: n for d, n in self.origin.items()})

    def keepdims(self, dims: Sequence[str]) -> "Cube":
        """Dimensions that a reduction took away, as dimensions of length 1."""
        gone = [d for d in dims if d not in self.dims]
        df = self.df.select(*self.dims, *(F.lit(1).cast("long").alias(d) for d in gone), *self.values)
        return replace(self, df=df, dims=(*self.dims, *gone), shape=self.shape | {d: 1 for d in gone}, origin=self.origin | {d: 1 for d in gone})

    # -- results -----------------------------------------------------------------------
    def collect(self) -> dict[tuple, object]:
        """The cells in the driver's memory, for results that are known to be small."""
        one = len(self.values) == 1
        return {tuple(r[d] for d in self.dims): r[self.values[0]] if one else tuple(r[v] for v in self.values) for r in self.df.collect()}

    def write(self, path: str, mode: str = "errorifexists") -> None:
        self.df.write.mode(mode).parquet(path)
