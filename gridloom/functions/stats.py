"""Statistics by name, as aggregate expressions, and mergeable statistics of one's own.

``skipmissing`` is part of the meaning, never of the plan: without it one missing cell
makes the result missing, with it missing and non-finite cells are passed over and a
group without any is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The approximate median's rank is off by less than one in ACCURACY.
ACCURACY = 10_000

Expr = Callable[[Column], Column]

_ONE: dict[str, Expr] = {
    "mean": F.avg,
    "sum": F.sum,
    "minimum": F.min,
    "maximum": F.max,
    "median": F.median,
    "median_approx": lambda x: F.percentile_approx(x, 0.5, ACCURACY),
    "mode": lambda x: F.mode(x, True),
    "nvalid": F.count,
    "variance": F.var_samp,
    "product": F.product,
}
#: Statistics of several columns: suffix and expression of each.
_MANY: dict[str, dict[str, Expr]] = {"extrema": {"min": F.min, "max": F.max}}


def names() -> list[str]:
    return [*_ONE, *_MANY]


def has_mergeable(name: str) -> bool:
    """Whether partial results of the statistic can be merged (the exact median's can't)."""
    return name in _ONE and name not in ("median",) or name in _MANY


def finite(x: Column) -> Column:
    """x, or null where it is missing, NaN or infinite."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), x)


def expressions(name: str | Expr, value: str, skipmissing: bool) -> dict[str, Column]:
    """Output column name and aggregate expression of a statistic of column ``value``."""
    if callable(name):
        parts = {value: name}
    elif name in _ONE:
        parts = {value: _ONE[name]}
    elif name in _MANY:
        parts = {f"{value}_{k}": f for k, f in _MANY[name].items()}
    else:
        raise ValueError(f"unknown statistic {name!r}; there are {', '.join(names())}")
    x = F.col(value)
    if skipmissing:
        return {k: f(finite(x)) for k, f in parts.items()}
    if name == "nvalid":
        return {k: f(x) for k, f in parts.items()}
    return {k: F.when(F.count(F.lit(1)) == F.count(x), f(x)) for k, f in parts.items()}


@dataclass(frozen=True)
class Mergeable:
    """A statistic given by zero, fit(acc, x), merge(acc, acc) and finish(acc).

    Rows are sorted by group within each partition, so that a task holds one accumulator
    at a time; accumulators of a group then meet in one task, so what is shuffled is a row
    for each group and partition. These are sorted and folded in the same way: a batch holds
    many groups, and none needs a call of its own from Spark. ``fit_many(acc, array)`` takes
    a whole array of a group's values at once, where ``fit`` is called for each.
    """

    zero: Callable[[], Any]
    fit: Callable[[Any, float], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]
    kind: str = "double"
    preproc: Callable[[float], float] | None = None
    skipmissing: bool = True
    fit_many: Callable[[Any, np.ndarray], Any] | None = None

    def aggregate(self, df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
        import pickle

        from pyspark.sql.pandas.types import to_arrow_type
        from pyspark.sql.types import StructType

        keys = list(keys) or ["__all"]
        rows = df if keys != ["__all"] else df.withColumn("__all", F.lit(1))
        key_kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
        kind = to_arrow_type(StructType.fromDDL(f"v {self.kind}")["v"].dataType)

        def fit_rows(batch: pa.RecordBatch):
            x = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            if self.preproc:
                x = np.array([self.preproc(v) for v in x.tolist()], dtype=float)
            good = np.isfinite(x)
            upto = [0, *np.cumsum(good).tolist()]
            x = x[good] if self.fit_many is not None else x[good].tolist()

            def add(state, a: int, b: int):
                acc, n, gone = state or (self.zero(), 0, False)
                lo, hi = upto[a], upto[b]
                if self.fit_many is None:
                    for v in x[lo:hi]:
                        acc = self.fit(acc, v)
                elif lo < hi:
                    acc = self.fit_many(acc, x[lo:hi])
                return acc, n + hi - lo, gone or hi - lo < b - a

            return add

        def partial(heads: pa.RecordBatch, states: list) -> pa.RecordBatch:
            more = [pa.array([pickle.dumps(s[0]) for s in states], pa.binary()), pa.array([s[1] for s in states], pa.int64()), pa.array([s[2] for s in states], pa.bool_())]
            return pa.RecordBatch.from_arrays([*heads.columns, *more], [*keys, "__acc", "__n", "__gone"])

        def merge_rows(batch: pa.RecordBatch):
            accs, ns, gones = (batch.column(len(keys) + j).to_pylist() for j in range(3))

            def add(state, a: int, b: int):
                for acc, n, gone in zip(map(pickle.loads, accs[a:b]), ns[a:b], gones[a:b]):
                    state = (acc, n, gone) if state is None else (self.merge(state[0], acc), state[1] + n, state[2] or gone)
                return state

            return add

        def final(heads: pa.RecordBatch, states: list) -> pa.RecordBatch:
            out = pd.Series([None if not n or gone and not self.skipmissing else self.finish(acc) for acc, n, gone in states])
            return pa.RecordBatch.from_arrays([*heads.columns, pa.Array.from_pandas(out, mask=out.isna(), type=kind, safe=False)], [*keys, value])

        inorder = rows.select(*keys, F.col(value).cast("double").alias(value)).sortWithinPartitions(*keys)
        some = inorder.mapInArrow(lambda batches: fold_sorted(batches, keys, fit_rows, partial), f"{key_kinds}, __acc binary, __n long, __gone boolean")
        met = some.repartition(*keys).sortWithinPartitions(*keys)
        out = met.mapInArrow(lambda batches: fold_sorted(batches, keys, merge_rows, final), f"{key_kinds}, {value} {self.kind}")
        return out.drop("__all") if keys == ["__all"] else out


def begins(batch: pa.RecordBatch, keys: Sequence[str], before: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row of a batch in order of ``keys`` begins a group; ``before`` is the row ahead of the batch.

    Keys are the same as for Spark's group-by: nulls are equal, and NaNs.
    """
    new = np.zeros(batch.num_rows, bool)
    new[0] = before is None
    for k in keys:
        col = batch.column(k)
        col = col if before is None else pa.concat_arrays([before.column(k), col])
        a, b = col.slice(1), col.slice(0, len(col) - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(col.type):
            differs = pc.and_not(differs, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        if col.null_count:
            differs = pc.or_(differs, pc.xor(pc.is_null(a), pc.is_null(b)))
        new[len(new) - len(a) :] |= differs.to_numpy(zero_copy_only=False)
    return new


def fold_sorted(batches: Iterable[pa.RecordBatch], keys: Sequence[str], prepare: Callable, emit: Callable) -> Iterator[pa.RecordBatch]:
    """Fold the groups of batches in order of ``keys``, one after the other.

    ``prepare(batch)`` gives add(state, a, b), which takes rows a..b - 1 of one group (state
    None: its first ones); ``emit(heads, states)`` makes a batch of the keys and states of
    groups that are complete. Only the last group of a batch stays open.
    """
    before = head = state = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.flatnonzero(begins(batch, keys, before)).tolist()
        add, ends, done = prepare(batch), [*at, batch.num_rows], []
        if ends[0]:
            state = add(state, 0, ends[0])
        for a, b in zip(at, ends[1:]):
            if state is not None:
                done.append(state)
            state = add(None, a, b)
        heads = batch.select(keys).take(pa.array(at, pa.int64()))
        heads = heads if head is None else pa.concat_batches([head, heads])
        if done:
            yield emit(heads.slice(0, len(done)), done)
        head, before = heads.slice(len(done)), batch.select(keys).slice(batch.num_rows - 1)
    if head is not None:
        yield emit(head, [state])


def stat(name: str | Mergeable, preproc: Callable[[Column], Column] | None = None, groupconv: Callable[[Column], Column] | None = None) -> dict:
    """A statistic with a step before it (``preproc``) and, for zones, one on the zone number (``groupconv``)."""
    if isinstance(name, str) and name not in names():
        raise ValueError(f"unknown statistic {name!r}")
    return {"f": name, "preproc": preproc, "groupconv": groupconv}


def derived(name: str, after: Callable[[Column], Column]) -> Expr:
    """A statistic of another one's value."""
    return lambda x: after(_ONE[name](x))
