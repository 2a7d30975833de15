"""User functions: scalar, block and aggregate ones, from one factory."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import Cube
from .stats import Mergeable


@dataclass(frozen=True)
class UserFunction:
    """What ``create_function`` returns.

    An expression function maps columns to a column, or to several for several outputs.
    A Python function (``python=True``) maps pandas series to a series. A block function
    maps the pandas frame of a block, which carries absolute indices, to a frame. With
    ``together`` it maps the frame of many whole blocks, to which a second argument, a series,
    numbers the blocks; integers and booleans are pandas' nullable ones there. That is for
    small blocks, where a call for each is nearly all of the work.
    """

    f: Callable
    outputs: dict[str, str]
    is_blockfunction: bool = False
    python: bool = False
    red: Callable | None = None
    init: Any = 0
    finalize: Callable = field(default=lambda x: x)
    filters: tuple = ()
    merge: Callable | None = None
    args: tuple = ()
    kwargs: dict = field(default_factory=dict)
    together: bool = False

    # -- cells -------------------------------------------------------------------------
    def columns(self, *cols: Column) -> list[Column]:
        """The outputs for the given inputs, one pass for all of them."""
        if self.python:
            kind = ", ".join(f"{k} {t}" for k, t in self.outputs.items())
            one, f, args, kwargs, names = len(self.outputs) == 1, self.f, self.args, self.kwargs, list(self.outputs)
            if one:
                udf = F.pandas_udf(lambda *s: f(*s, *args, **kwargs), next(iter(self.outputs.values())))
                return [udf(*cols).alias(names[0])]

            def several(*s: pd.Series) -> pd.DataFrame:
                return pd.DataFrame(dict(zip(names, f(*s, *args, **kwargs))))

            several.__annotations__ = {}
            out = F.pandas_udf(several, kind, F.PandasUDFType.SCALAR)(*cols)
            return [out.getField(k).alias(k) for k in names]
        got = self.f(*cols, *self.args, **self.kwargs)
        got = got if isinstance(got, (tuple, list)) else (got,)
        if len(got) != len(self.outputs):
            raise ValueError(f"{len(got)} results for {len(self.outputs)} outputs")
        return [c.cast(t).alias(k) for c, (k, t) in zip(got, self.outputs.items())]

    def on(self, cube: Cube) -> Cube:
        """The function of every cell."""
        if self.red is not None:
            raise ValueError("a reduction needs dimensions: use reduce")
        if self.filters:
            raise ValueError("filters judge steps of several cells: use reduce, on_blocks or maps.filtered")
        rows = cube.df.select(*cube.dims, *self.columns(*(F.col(v) for v in cube.values)))
        return Cube(rows, cube.dims, tuple(self.outputs), dict(cube.shape), dict(cube.origin))

    # -- blocks ------------------------------------------------------------------------
    def on_blocks(self, cube: Cube, blocks: dict[str, int | None]) -> DataFrame:
        """A block function over blocks of the given sizes (None: the whole dimension).

        A block is in one task, in order of its indices, so blocks are sized to fit in memory.
        Many blocks come to Python together and are cut there. Of blocks that a filter skips,
        the outputs of all cells are missing.
        """
        if not self.is_blockfunction:
            raise ValueError("not a block function")
        keys = {f"__b_{d}": F.lit(0).cast("long") if w is None else F.floor((F.col(d) - cube.origin.get(d, 0)) / w) for d, w in blocks.items()}
        rows = cube.df.select(*(k.alias(n) for n, k in keys.items()), *cube.dims, *cube.values)
        # pandas tells no nulls from numbers in columns of these kinds, and what they become is a block's own matter
        plain = [v for v in cube.values if rows.schema[v].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "boolean")]
        sent = rows.select(*keys, *cube.dims, *((F.coalesce(v, F.lit(0).cast(rows.schema[v].dataType)).alias(v) if v in plain else F.col(v)) for v in cube.values), *(F.isnull(v).alias(f"__null_{v}") for v in plain))
        # the rows of a block are together from here on, whatever join follows
        met = sent.repartition(*keys)
        if self.filters:
            met = met.join(rows.groupBy(*keys).agg(_skip(self.filters, F.col(cube.values[0])).alias("__skip")), list(keys))
        f, args, kwargs, gone, dims, given, outputs, filtered, together = self.f, self.args, self.kwargs, list(keys), list(cube.dims), [*cube.dims, *cube.values], list(self.outputs), bool(self.filters), self.together

        def one(cells: pd.DataFrame, nulls: dict[str, Any], a: int, b: int) -> pd.DataFrame:
            part = cells.iloc[a:b].reset_index(drop=True)
            for v, at in nulls.items():
                if at[a:b].any():
                    lost = part[v].dtype == bool
                    part[v] = part[v].astype(object if lost else float).mask(at[a:b], None if lost else np.nan)
            return f(part, *args, **kwargs)

        def many(cells: pd.DataFrame, nulls: dict[str, Any], at: list[int], ends: list[int], skipped: np.ndarray) -> list[pd.DataFrame]:
            for v, lost in nulls.items():
                cells = cells.assign(**{v: cells[v].astype("boolean" if cells[v].dtype == bool else "Int64").mask(lost)})
            number = pd.Series(np.repeat(np.arange(len(at)), np.subtract(ends, at)))[~skipped].reset_index(drop=True)
            return [f(cells[~skipped].reset_index(drop=True), number, *args, **kwargs)] if len(number) else []

        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf, at in whole_blocks(frames, gone):
                ends = [*at[1:], len(pdf)]
                skipped = pdf["__skip"].to_numpy(dtype=bool, na_value=False) if filtered else np.zeros(len(pdf), bool)
                cells, nulls = pdf[given], {v: pdf[f"__null_{v}"].to_numpy(dtype=bool) for v in plain}
                done = many(cells, nulls, at, ends, skipped) if together else [one(cells, nulls, a, b) for a, b in zip(at, ends) if not skipped[a]]
                if done:
                    yield done[0] if len(done) == 1 else pd.concat(done, ignore_index=True)
                if skipped.any():
                    yield pdf.loc[skipped, dims].assign(**{k: None for k in outputs})

        schema = ", ".join([*(f"{d} {cube.df.schema[d].dataType.simpleString()}" for d in cube.dims), *(f"{k} {t}" for k, t in self.outputs.items())])
        return met.sortWithinPartitions(*keys, *dims).mapInPandas(run, schema)

    # -- folds -------------------------------------------------------------------------
    def reduce(self, cube: Cube, dims: Sequence[str]) -> DataFrame:
        """red(acc, f(x)) over ``dims``, then finalize.

        ``init`` (a value or a call) enters the fold of a group once, however its cells are
        spread over partitions, and ``red`` also joins partial results. With ``merge``,
        which joins accumulators of another kind than the values, every partial fold starts
        from ``init``, which then has to be neutral. Groups that a filter skips are missing.
        """
        if self.red is None:
            raise ValueError("no red is given")
        red, f, finalize, merge = self.red, self.f, self.finalize, self.merge
        start = self.init if callable(self.init) else (lambda x=self.init: x)
        kept, value, kind = [d for d in cube.dims if d not in dims], cube.values[0], next(iter(self.outputs.values()))
        if merge is not None:
            fold = Mergeable(start, lambda acc, x: red(acc, f(x)), merge, finalize, kind, skipmissing=False)
        else:
            def both(a, b):
                return b if a is None else a if b is None else red(a, b)

            fold = Mergeable(lambda: None, lambda acc, x: both(acc, f(x)), both, lambda acc: finalize(red(start(), acc)), kind, skipmissing=bool(self.filters))
        out = fold.aggregate(cube.df, kept, value)
        if not self.filters:
            return out
        skip = _skip(self.filters, F.col(value)).alias("__skip")
        judged = cube.df.groupBy(*kept).agg(skip) if kept else cube.df.agg(skip)
        both_ = out.join(judged, kept) if kept else out.join(F.broadcast(judged), F.lit(True))
        return both_.select(*kept, F.when(~F.col("__skip"), F.col(value)).alias(value))


def whole_blocks(frames: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Frames in order of ``keys``, cut anew so that no block is in two, with the places where blocks begin."""
    held: list[pd.DataFrame] = []  # what there is of the last block
    last = None

    def joined() -> pd.DataFrame:
        return held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)

    for pdf in frames:
        if not len(pdf):
            continue
        at = pdf[list(keys)].to_numpy()
        ahead = at[:1] if last is None else last
        both = np.concatenate([ahead, at])
        new = np.flatnonzero(((both[1:] != both[:-1]) & ~(pd.isna(both[1:]) & pd.isna(both[:-1]))).any(axis=1)).tolist()
        last = at[-1:]
        if not new:
            held.append(pdf)
            continue
        # the open block, then those that begin and end here
        before = sum(map(len, held))
        if new[-1]:
            held.append(pdf.iloc[: new[-1]])
        yield joined(), [0, *(before + k for k in new[:-1])]
        held = [pdf.iloc[new[-1] :]]
    if held:
        yield joined(), [0]


def _skip(filters: Sequence[Callable[[Column], Column]], x: Column) -> Column:
    return reduce(lambda a, b: a | b, (f(x) for f in filters))


def create_function(f: Callable, outtypes, *, is_blockfunction: bool = False, python: bool = False, red: Callable | None = None, init: Any = 0, finalize: Callable | None = None, merge: Callable | None = None, filters: Sequence = (), args: Sequence = (), kwargs: dict | None = None, together: bool = False) -> UserFunction:
    """One factory for all user functions; ``outtypes`` is a type, several, or {name: type}."""
    if isinstance(outtypes, str):
        outputs = {"value": outtypes}
    elif isinstance(outtypes, dict):
        outputs = dict(outtypes)
    else:
        outputs = {f"value{k}": t for k, t in enumerate(outtypes, 1)}
    if red is not None and len(outputs) != 1:
        raise ValueError("a reduction has one output")
    if together and not is_blockfunction:
        raise ValueError("only block functions take blocks together")
    return UserFunction(f, outputs, is_blockfunction, python, red, init, finalize or (lambda x: x), tuple(filters), merge, tuple(args), dict(kwargs or {}), together)
