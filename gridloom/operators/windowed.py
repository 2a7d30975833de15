"""The general operation: inputs with window lists for each dimension, one function, output windows.

Every loop dimension runs over the steps of a window list. An input's cells are assigned
to the steps whose window holds them; inputs meet on their common loop dimensions; the
function is applied to what each step sees; and where output windows send several steps
to one cell, the reduction folds them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions import stats
from .windows import Points, Windows


@dataclass(frozen=True)
class InputArray:
    """A cube with a window list for each dimension (its own indices where none is given).

    ``loops`` maps dimensions to loop dimensions, by default to those of their own names.
    """

    cube: Cube
    windows: Mapping[str, Windows] = field(default_factory=dict)
    loops: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if wrong := (set(self.windows) | set(self.loops)) - set(self.cube.dims):
            raise ValueError(f"no dimensions {sorted(wrong)}")

    def loop(self, d: str) -> str:
        return self.loops.get(d, d)

    def resolved(self) -> tuple[dict[str, Windows], Cube]:
        cube = self.cube if all(d in self.windows for d in self.cube.dims) else self.cube.measured()
        return {d: self.windows.get(d) or Points(cube.origin.get(d, 0), cube.shape[d]) for d in cube.dims}, cube

    def seen(self) -> Callable[[str], tuple]:
        """For a value name: rows (loop dimensions, name) with what each step sees."""
        windows, cube = self.resolved()
        df = cube.df
        for d, w in windows.items():
            df = w.assign(df, d, f"__l_{d}")
        loops = [F.col(f"__l_{d}").alias(self.loop(d)) for d in cube.dims]
        # a step sees a number where each window is one index, else the list of its cells in order
        single = all(w.single for w in windows.values())
        value = F.col(cube.values[0])
        if single:
            return lambda name: (df.select(*loops, value.alias(name)), [self.loop(d) for d in cube.dims])
        names = [self.loop(d) for d in cube.dims]
        cells = df.select(*loops, *(F.col(d).alias(f"__i_{d}") for d in cube.dims), value.alias("__v"))
        seen = F.sort_array(F.collect_list(F.struct(*(F.col(f"__i_{d}") for d in reversed(cube.dims)), F.col("__v")))).getField("__v")
        return lambda name: (cells.groupBy(*names).agg(seen.alias(name)), names)

    def steps(self) -> dict[str, int]:
        return {self.loop(d): len(w) for d, w in self.resolved()[0].items()}


@dataclass(frozen=True)
class OutWindows:
    """Output windows: for each loop dimension the output index of each step (itself by default)."""

    windows: Mapping[str, Windows] = field(default_factory=dict)


def windowed_op(inputs: list[InputArray], f: Callable[..., Column], out: OutWindows | None = None, red: str | None = None, value: str = "value") -> Cube:
    """Run the operation; a lazy cube over the output indices.

    ``f`` gets a column for each input: a number, or an array where its windows hold more
    than one cell. ``red`` is the statistic that folds steps of one output cell; it is
    needed where output windows repeat an index.
    """
    out = out or OutWindows()
    sizes: dict[str, int] = {}
    for i in inputs:
        for loop, n in i.steps().items():
            if sizes.setdefault(loop, n) != n:
                raise ValueError(f"loop {loop!r} has {sizes[loop]} and {n} windows")
    if wrong := set(out.windows) - set(sizes):
        raise ValueError(f"no loops {sorted(wrong)}")
    rows, have = None, []
    for k, i in enumerate(sorted(inputs, key=lambda i: -len(i.cube.dims))):
        part, loops = i.seen()(f"v{inputs.index(i)}")
        if rows is None:
            rows, have = part, loops
        else:
            shared = [d for d in loops if d in have]
            rows = rows.join(part, shared) if shared else rows.crossJoin(F.broadcast(part) if not loops else part)
            have = [*have, *(d for d in loops if d not in have)]
    done = rows.select(*have, f(*(F.col(f"v{k}") for k in range(len(inputs)))).alias(value))
    if not out.windows:
        return Cube(done, tuple(have), (value,), dict(sizes), {d: 1 for d in have})
    shape, overlapping = dict(sizes), False
    for d, w in out.windows.items():
        if len(w) != sizes[d]:
            raise ValueError(f"loop {d!r} has {sizes[d]} steps and {len(w)} output windows")
        shape.pop(d)  # measured when an operator needs it
        overlapping |= not w.disjoint
        done = w.spread(done, d)
    if red is None:
        if overlapping:
            raise ValueError("several steps write to one output cell: give red")
        return Cube(done.select(*have, value), tuple(have), (value,), shape, {d: 1 for d in have})
    e = stats.expressions(red, value, False)[value]
    return Cube(done.groupBy(*have).agg(e.alias(value)), tuple(have), (value,), shape, {d: 1 for d in have})
