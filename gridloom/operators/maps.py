"""Element-wise maps, alignment of several cubes, and step filters."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import Cube


def map_cells(cube: Cube, f: Callable | Mapping[str, Callable], *args, value: str = "value", **kwargs) -> Cube:
    """``f`` of each cell's values. A mapping makes several outputs in one pass; args and kwargs are bound to ``f``."""
    fs = f if isinstance(f, Mapping) else {value: f}
    outs = [partial(g, **kwargs)(*(F.col(v) for v in cube.values), *args).alias(k) for k, g in fs.items()]
    return replace(cube, df=cube.df.select(*cube.dims, *outs), values=tuple(fs))


def _lengths(cubes: Sequence[Cube]) -> dict[str, int]:
    """The length of each shared dimension; ValueError if two lengths can't go together."""
    out: dict[str, int] = {}
    for c in cubes:
        for d in c.dims:
            n = c.shape.get(d)
            if n is None:
                continue
            if d in out and out[d] != n and 1 not in (out[d], n):
                raise ValueError(f"dimension {d!r} has lengths {out[d]} and {n}")
            out[d] = max(n, out.get(d, n))
    return out


def align(*cubes: Cube) -> tuple[DataFrame, list[str]]:
    """One row for each common index, and the columns ``v0, v1, ...`` of the cubes' first values.

    Cubes meet on the dimensions that they share, by equi-joins. A dimension of length 1
    takes part in no join: its cells stretch over the others' indices.
    """
    lengths = _lengths(cubes)
    parts = []
    for k, c in enumerate(cubes):
        dims = [d for d in c.dims if not (c.shape.get(d) == 1 and lengths.get(d, 1) != 1)]
        parts.append((dims, c.df.select(*dims, F.col(c.values[0]).alias(f"v{k}"))))
    # the widest cube first, so that every other one joins on all its dimensions
    (dims, rows), *rest = sorted(parts, key=lambda p: -len(p[0]))
    have = set(dims)
    while rest:
        at = next((i for i, (d, _) in enumerate(rest) if have.intersection(d)), 0)
        dims, other = rest.pop(at)
        shared = [d for d in dims if d in have]
        # without shared dimensions: a constant or an outer product, as the shapes ask for
        rows = rows.join(other, shared) if shared else rows.crossJoin(F.broadcast(other) if not dims else other)
        have.update(dims)
    return rows, [f"v{k}" for k in range(len(cubes))]


def broadcast(f: Callable[..., Column], *operands, value: str = "value") -> Cube:
    """``f`` of the operands' cells: cubes, aligned by dimension name, and plain numbers."""
    cubes = [x for x in operands if isinstance(x, Cube)]
    if not cubes:
        raise ValueError("one operand at least has to be a cube")
    same = [i for i, c in enumerate(cubes) if c.df is cubes[0].df]
    if len(same) == len(cubes):  # one table: a projection, no join
        rows = cubes[0].df.select(*cubes[0].dims, *(F.col(c.values[0]).alias(f"v{k}") for k, c in enumerate(cubes)))
    else:
        rows, _ = align(*cubes)
    names = iter(range(len(cubes)))
    args = [F.col(f"v{next(names)}") if isinstance(x, Cube) else F.lit(x) for x in operands]
    dims = list(dict.fromkeys(d for c in cubes for d in c.dims))
    origin = reduce(lambda a, c: c.origin | a, cubes, {})
    return Cube(rows.select(*dims, f(*args).alias(value)), tuple(dims), (value,), _lengths(cubes), {d: origin.get(d, 0) for d in dims})


# -- filters: conditions on the cells of a step, under which its result is missing ------


def all_missing(x: Column) -> Column:
    return F.count(x) == 0


def any_missing(x: Column) -> Column:
    return F.count(x) != F.count(F.lit(1))


def n_valid(n: int) -> Callable[[Column], Column]:
    return lambda x: F.count(x) <= n


def std_zero(x: Column) -> Column:
    """All present cells are equal."""
    return F.coalesce(F.min(x) == F.max(x), F.lit(False))


def no_filter(x: Column) -> Column:
    return F.lit(False)


def user_filter(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """An aggregate condition of one's own; true skips the step."""
    return f


def filtered(expr: Callable[[Column], Column], *filters: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The aggregate ``expr``, missing where any of the filters holds."""

    def run(x: Column) -> Column:
        skip = reduce(lambda a, b: a | b, (f(x) for f in filters), F.lit(False))
        return F.when(~skip, expr(x))

    return run


def masked(cube: Cube, mask: Cube) -> Cube:
    """The cells whose index is in ``mask`` with a true value."""
    shared = [d for d in mask.dims if d in cube.dims]
    on = mask.df.where(F.col(mask.values[0]).cast("boolean")).select(*shared)
    return replace(cube, df=cube.df.join(on, shared, "left_semi"))
