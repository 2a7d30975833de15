"""Moving windows: frames cut into blocks with a halo, and n-dimensional neighbourhoods, separable ones one dimension after the other."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Mapping
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions import stats
from .aggregate import aggregate
from .windows import Windows

#: Indices of a block of ``rolling``; a block's rows are sorted in one task.
BLOCK = 65_536
#: Cells that the frames of a block of ``neighbourhood`` hold together, at most.
CELLS = 4_000_000


def rolling(cube: Cube, dim: str, before: int, after: int, f: Callable[[Column], Column], full_only: bool = False, block: int = BLOCK) -> Cube:
    """``f`` over the indices i - before ... i + after of each cell, clipped at the edges.

    A frame without partitions would put all rows into one task. So the dimension is cut
    into blocks, and rows within ``before`` or ``after`` of a block's edge are copied to
    the neighbour (one row in ``block`` or so); each block has a frame of its own.
    ``full_only`` leaves out windows that reach over the ends.
    """
    c = cube.measured() if full_only else cube
    block = max(block, before + after + 1)
    o, i = cube.origin.get(dim, 0), F.col(dim)
    own = F.floor((i - o) / block)
    # as a window of a cell at j holds i for j between i - after and i + before
    blocks = F.sequence(F.floor((i - after - o) / block), F.floor((i + before - o) / block))
    rows = cube.df.withColumn("__block", F.explode(blocks)).withColumn("__own", F.col("__block") == own)
    others = [d for d in cube.dims if d != dim]
    frame = Window.partitionBy(*others, "__block").orderBy(dim).rangeBetween(-before, after)
    outs = {v: f(F.col(v)).over(frame) for v in cube.values}
    out = rows.select(*cube.dims, "__own", *(e.alias(v) for v, e in outs.items())).where("__own").drop("__own")
    if full_only:
        out = out.where(i.between(o + before, o + c.shape[dim] - 1 - after))
    return replace(c, df=out)


def windowed(cube: Cube, f, windows: Mapping[str, Windows], skipmissing: bool = False) -> Cube:
    """The statistic ``f`` over the given windows of each dimension; results are numbered by step from 1."""
    return aggregate(cube, f, windows, skipmissing)


#: Statistics of a neighbourhood that are taken one dimension after the other: what is carried, and the result.
SEPARABLE = {"sum": F.sum, "mean": F.sum, "nvalid": F.sum, "minimum": F.min, "maximum": F.max}


def neighbourhood(cube: Cube, reach: Mapping[str, int], f, skipmissing: bool = True, side: int | None = None) -> Cube:
    """The statistic ``f`` of the cells within ``reach`` of each index in every named dimension, clipped at the edges.

    Sums, means, counts and extremes are taken one dimension after the other, by rolling
    frames. For the median and the variance the cube is cut into blocks of ``side`` indices
    (by default as many as ``CELLS`` cells of all of a block's frames allow) with a halo of
    ``reach``, and a task works on one block at a time as a dense array; for anything else each cell is sent to the windows that hold it.
    """
    if f in SEPARABLE:
        return _by_dimension(cube, reach, f, skipmissing)
    if f in ("median", "variance") and len(cube.values) == 1:
        frame = math.prod(2 * r + 1 for r in reach.values())
        return _by_block(cube, reach, f, skipmissing, side or max(1, min(BLOCK, int((CELLS / frame) ** (1 / len(reach))))))
    c = cube.measured()
    rows = c.df
    for d, r in reach.items():
        o = c.origin.get(d, 0)
        at = F.sequence(F.greatest(F.col(d) - r, F.lit(o).cast("long")), F.least(F.col(d) + r, F.lit(o + c.shape[d] - 1).cast("long")))
        rows = rows.withColumn(d, F.explode(at))
    exprs = {k: e for v in c.values for k, e in stats.expressions(f, v, skipmissing).items()}
    return replace(c, df=rows.groupBy(*c.dims).agg(*(e.alias(k) for k, e in exprs.items())), values=tuple(exprs))


def _by_dimension(cube: Cube, reach: Mapping[str, int], f: str, skipmissing: bool) -> Cube:
    """Rolling frames of the carried parts: x, the present and all cells."""
    c, value = cube.measured(), cube.values[0]
    x = stats.finite(F.col(value)) if skipmissing else F.col(value)
    rows = c.df.select(*c.dims, (x.isNotNull().cast("long") if f == "nvalid" else x).alias("__x"), x.isNotNull().cast("long").alias("__n"), F.lit(1).cast("long").alias("__all"))
    if c.df.count() < math.prod(c.shape[d] for d in c.dims):  # a frame has a result only where there is a row
        rows = c.grid().join(rows, list(c.dims), "left").fillna(0, ["__n", "__all"])
    for d, r in reach.items():
        one = {}
        for v, g in (("__x", SEPARABLE[f]), ("__n", F.sum), ("__all", F.sum)):
            one[v] = g
        rows = _rolled(replace(c, df=rows, values=tuple(one)), d, r, one)
    known = F.lit(True) if f == "nvalid" else F.col("__n") > 0 if skipmissing else F.col("__n") == F.col("__all")
    got = F.col("__x") / F.col("__n") if f == "mean" else F.col("__x")
    return replace(c, df=rows.where("__all > 0").select(*c.dims, F.when(known, got).alias(value)), values=(value,))


def _rolled(cube: Cube, dim: str, reach: int, how: Mapping[str, Callable[[Column], Column]], block: int = BLOCK) -> DataFrame:
    block, o = max(block, 2 * reach + 1), cube.origin.get(dim, 0)
    own = F.floor((F.col(dim) - o) / block)
    rows = cube.df.withColumn("__block", F.explode(F.sequence(F.floor((F.col(dim) - reach - o) / block), F.floor((F.col(dim) + reach - o) / block)))).withColumn("__own", F.col("__block") == own)
    frame = Window.partitionBy(*(d for d in cube.dims if d != dim), "__block").orderBy(dim).rangeBetween(-reach, reach)
    return rows.select(*cube.dims, "__own", *(g(F.col(v)).over(frame).alias(v) for v, g in how.items())).where("__own").drop("__own")


def _by_block(cube: Cube, reach: Mapping[str, int], f: str, skipmissing: bool, side: int) -> Cube:
    c, dims, value = cube.measured(), list(reach), cube.values[0]
    others = [d for d in c.dims if d not in reach]
    rows = c.df.select(*c.dims, F.col(value).cast("double").alias(value))
    for d, r in reach.items():
        o, n = c.origin.get(d, 0), c.shape[d]
        first, last = F.floor((F.col(d) - r - o) / side), F.floor((F.col(d) + r - o) / side)
        rows = rows.withColumn(f"__b_{d}", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit((n - 1) // side)))))
    sizes, origin = {d: c.shape[d] for d in dims}, {d: c.origin.get(d, 0) for d in dims}
    keys, every, reach = [f"__b_{d}" for d in dims], list(c.dims), dict(reach)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        begin = {d: origin[d] + int(pdf[k].iloc[0]) * side for d, k in zip(dims, keys)}
        width = [min(side, origin[d] + sizes[d] - begin[d]) for d in dims]
        at = tuple(pdf[d].to_numpy() - begin[d] + reach[d] for d in dims)
        shape = [w + 2 * reach[d] for w, d in zip(width, dims)]
        x = np.full(shape, np.nan)
        there, bad = np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)
        v = pdf[value].to_numpy(dtype=float, na_value=np.nan)
        if skipmissing:
            v = np.where(np.isfinite(v), v, np.nan)
        x[at], there[at], bad[at] = v, True, np.isnan(v)
        frame = tuple(2 * reach[d] + 1 for d in dims)
        over = tuple(range(-len(dims), 0))
        seen = np.lib.stride_tricks.sliding_window_view(x, frame)
        present = np.lib.stride_tricks.sliding_window_view(there, frame).any(axis=over)
        missing = np.lib.stride_tricks.sliding_window_view(bad, frame).any(axis=over)
        known = ~np.isnan(seen).all(axis=over)
        out = np.full(seen.shape[: len(dims)], np.nan)
        flat = seen[known].reshape(int(known.sum()), -1)
        if len(flat):
            with np.errstate(invalid="ignore", divide="ignore"), warnings.catch_warnings():
                warnings.simplefilter("ignore", RuntimeWarning)  # of the variance of one cell
                out[known] = np.nanmedian(flat, axis=1) if f == "median" else np.nanvar(flat, axis=1, ddof=1)
        if not skipmissing:
            out[missing] = np.nan
        places = np.nonzero(present)
        done = pd.DataFrame({d: p + begin[d] for d, p in zip(dims, places)})
        for d in others:
            done[d] = pdf[d].iloc[0]
        got = out[places]
        done[value] = pd.Series(got, dtype=object).where(~np.isnan(got), None)
        return done[[*every, value]]

    schema = ", ".join([*(f"{d} long" for d in c.dims), f"{value} double"])
    return replace(c, df=rows.groupBy(*others, *keys).applyInPandas(run, schema), values=(value,))
