"""Interpolation by weights, and pyramids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions import stats
from .windows import BROADCAST_ROWS

METHODS = ("linear", "nearest", "previous", "next")


@dataclass(frozen=True)
class Axis:
    """The coordinates of a dimension: ``x0 + (k - 1) * step``, or listed and sorted either way."""

    x0: float = 0.0
    step: float = 1.0
    n: int = 0
    listed: tuple[float, ...] | None = None

    @classmethod
    def uniform(cls, x0: float, step: float, n: int) -> "Axis":
        return cls(float(x0), float(step), n)

    @classmethod
    def of(cls, coordinates: Sequence[float]) -> "Axis":
        c = tuple(float(x) for x in coordinates)
        if list(c) not in (sorted(c), sorted(c, reverse=True)):
            raise ValueError("an axis has to be sorted")
        return cls(n=len(c), listed=c)

    @classmethod
    def in_table(cls, df: DataFrame, column: str) -> "Axis":
        """The sorted distinct coordinates of a table; an axis of more than ``BROADCAST_ROWS`` of them is refused."""
        rows = df.select(F.col(column).cast("double").alias("x")).where("x is not null").distinct().limit(BROADCAST_ROWS + 1).collect()
        if len(rows) > BROADCAST_ROWS:
            raise ValueError(f"an axis of more than {BROADCAST_ROWS} listed coordinates")
        return cls.of(sorted(r.x for r in rows))

    def __getitem__(self, k: int) -> float:
        return self.listed[k] if self.listed is not None else self.x0 + k * self.step

    def places(self, x: np.ndarray) -> np.ndarray:
        """The fractional places (from 0) of coordinates; the ends beyond the axis."""
        if self.listed is None:
            p = (x - self.x0) / self.step
        else:
            c = np.asarray(self.listed)
            if self.n > 1 and c[0] > c[-1]:
                c, x = -c, -x
            i = np.clip(np.searchsorted(c, x, side="right") - 1, 0, max(self.n - 2, 0))
            gap = np.append(np.diff(c), 0.0)[i]
            p = i + np.divide(x - c[i], gap, out=np.zeros(len(x)), where=gap != 0)
        return np.clip(p, 0.0, float(self.n - 1))


def _place(p: Column, n: int, method: str) -> Column:
    return {"nearest": F.least(F.floor(p + 0.5), F.lit(n - 1)), "previous": F.floor(p), "next": F.ceil(p)}[method]


def _nodes(p: Column, n: int, method: str) -> Column:
    """The array of (s, w): the nodes, from 0, that make up a target at place ``p``, and their weights."""
    if method != "linear":
        return F.array(F.struct(_place(p, n, method).cast("long").alias("s"), F.lit(1.0).alias("w")))
    i = F.floor(p)
    part = p - i
    one = F.struct(i.cast("long").alias("s"), (1 - part).alias("w"))
    return F.when(part == 0, F.array(one)).otherwise(F.array(one, F.struct((i + 1).cast("long").alias("s"), part.alias("w"))))


def _spread(rows: DataFrame, dim: str, origin: int, src: Axis, dst: Axis, method: str) -> DataFrame:
    """Each cell with the targets (``__t``, from 0) that it takes part in along ``dim``, and its weight there (``__w``).

    Between uniform axes a cell works its targets out, without a join. Else the targets are
    bracketed in the listed axis by binary search, in parallel, and join the cells; the
    relation has a row or two for each target.
    """
    if src.listed is None and dst.listed is None:
        i = F.col(dim) - origin
        ratio, shift = dst.step / src.step, (dst.x0 - src.x0) / src.step
        # targets whose place lies within one node of the cell, or beyond the axis at its ends
        a, b = ((i - 1 - shift) / ratio, (i + 1 - shift) / ratio)
        first, last = (a, b) if ratio > 0 else (b, a)
        low, high = (F.lit(0), F.lit(src.n - 1)) if ratio > 0 else (F.lit(src.n - 1), F.lit(0))
        first = F.when(i == low, F.lit(0)).otherwise(F.greatest(F.floor(first), F.lit(0)))
        last = F.when(i == high, F.lit(dst.n - 1)).otherwise(F.least(F.ceil(last), F.lit(dst.n - 1)))
        rows = rows.where(i.between(0, src.n - 1)).withColumn("__t", F.explode(F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))))
        # by the coordinate, as a target would be placed, so that weights are the same in all of its nodes
        p = F.least(F.greatest((F.lit(dst.x0) + F.col("__t") * dst.step - src.x0) / src.step, F.lit(0.0)), F.lit(float(src.n - 1)))
        if method == "linear":
            low, part = F.floor(p), p - F.floor(p)
            own = F.when(i == low, 1 - part).when((i == low + 1) & (part > 0), part)
        else:
            own = F.when(i == _place(p, src.n, method), F.lit(1.0))
        return rows.withColumn("__w", own).where("__w is not null")
    spark = rows.sparkSession
    if dst.listed is None:

        @F.pandas_udf("double")
        def place(k: pd.Series) -> pd.Series:
            return pd.Series(src.places(dst.x0 + k.to_numpy(dtype=float) * dst.step))

        targets = spark.range(dst.n).select(F.col("id").alias("__t"), place("id").alias("p"))
    else:
        known = src.places(np.asarray(dst.listed))
        targets = spark.createDataFrame(pd.DataFrame({"__t": np.arange(dst.n), "p": known}))
    rel = targets.select("__t", F.inline(_nodes(F.col("p"), src.n, method))).select((F.col("s") + origin).alias(dim), "__t", F.col("w").alias("__w"))
    return rows.join(F.broadcast(rel) if 2 * dst.n <= BROADCAST_ROWS else rel, dim)


def interpolate(cube: Cube, conv: Mapping[str, tuple[Axis, Axis]], method: str = "linear") -> Cube:
    """Resample along the named dimensions, each from its source axis to a target axis.

    A target is the weighted sum of two nodes in each dimension (``linear``), or the nearest,
    previous or next node; beyond the axis the edge value holds. A missing node makes the target missing. Other dimensions are kept;
    target places are numbered from the dimension's origin.
    """
    if method not in METHODS:
        raise ValueError(f"method {method!r}; there are {', '.join(METHODS)}")
    rows, value = cube.df, cube.values[0]
    weight = F.lit(1.0)
    for d, (src, dst) in conv.items():
        if method == "linear" and d in cube.shape and cube.shape[d] != src.n:
            raise ValueError(f"axis of {src.n} for {cube.shape[d]} indices of {d!r}")
        rows = _spread(rows, d, cube.origin.get(d, 0), src, dst, method).withColumnsRenamed({"__t": f"__t_{d}", "__w": f"__w_{d}"})
        weight = weight * F.col(f"__w_{d}")
    kept = [d for d in cube.dims if d not in conv]
    targets = [(F.col(f"__t_{d}") + cube.origin.get(d, 0)).alias(d) for d in conv]
    w = rows.select(*kept, *targets, (weight * F.col(value)).alias("__x"), weight.alias("__w"))
    # the weights of all nodes are 1 together, so that an absent cell shows as well as a null
    whole = (F.count(F.lit(1)) == F.count("__x")) & (F.abs(F.sum("__w") - 1) < 1e-9)
    out = w.groupBy(*kept, *conv).agg(F.when(whole, F.sum("__x")).alias(value)).select(*cube.dims, value)
    shape = {d: n for d, n in cube.shape.items() if d in kept} | {d: dst.n for d, (_, dst) in conv.items()}
    return Cube(out, cube.dims, (value,), shape, dict(cube.origin))


def pyramid(cube: Cube, dims: Sequence[str], levels: int, f="mean", skipmissing: bool = False) -> DataFrame:
    """(level, dims, value): blocks of 2, 4, ... indices along ``dims``; level l has blocks of 2 ** l.

    Statistics of which blocks' results make up those of larger blocks (sum, minimum,
    maximum, nvalid, and mean by sum and count) take each level from the one before it, so
    a level reads a fraction of the cells. For others each cell goes to its block of every
    level.
    """
    value = cube.values[0]
    blocks = [(F.floor((F.col(d) - cube.origin.get(d, 0)) / 2) + 1).cast("long").alias(d) if d in dims else F.col(d) for d in cube.dims]
    halved = [(F.floor((F.col(d) - 1) / 2) + 1).cast("long").alias(d) if d in dims else F.col(d) for d in cube.dims]
    chained = {"sum": F.sum, "minimum": F.min, "maximum": F.max, "nvalid": F.sum, "mean": F.sum}
    if f in chained:
        x = stats.finite(F.col(value)) if skipmissing else F.col(value)
        rows = cube.df.select(*blocks, (F.when(x.isNotNull(), F.lit(1)).otherwise(F.lit(0)) if f == "nvalid" else x).alias("x"), x.isNotNull().cast("long").alias("n"), F.lit(1).cast("long").alias("all"))
        out = []
        for level in range(1, levels + 1):
            now = rows.groupBy(*cube.dims).agg(chained[f]("x").alias("x"), F.sum("n").alias("n"), F.sum("all").alias("all"))
            got = F.col("x") / F.col("n") if f == "mean" else F.col("x")
            known = F.lit(True) if f == "nvalid" else F.col("n") > 0 if skipmissing else F.col("n") == F.col("all")
            out.append(now.select(F.lit(level).alias("level"), *cube.dims, F.when(known, got).alias(value)))
            rows = now.select(*halved, "x", "n", "all")
        return reduce(DataFrame.unionAll, out)
    rows = cube.df.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    blocks = [(F.floor((F.col(d) - cube.origin.get(d, 0)) / F.pow(F.lit(2), F.col("level"))) + 1).cast("long").alias(d) if d in dims else F.col(d) for d in cube.dims]
    exprs = stats.expressions(f, value, skipmissing)
    return rows.select("level", *blocks, value).groupBy("level", *cube.dims).agg(*(e.alias(k) for k, e in exprs.items()))
