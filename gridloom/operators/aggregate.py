"""Group-by over windows, reductions, slice functions, zones and value counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions import stats
from .windows import Labels, Windows

Spec = None | int | Windows | str | Column | DataFrame | Sequence


def _assign(cube: Cube, dimspec: Mapping[str, Spec], cyclic: bool) -> tuple[DataFrame, dict[str, str]]:
    """Rows with a group column for each named dimension; column by dimension."""
    df, at = cube.df, {}
    for d, spec in dimspec.items():
        if d not in cube.dims:
            raise ValueError(f"no dimension {d!r}")
        step = f"__{d}"
        if spec is None:
            at[d] = step
            df = df.withColumn(step, F.lit(1).cast("long"))
        elif isinstance(spec, bool):
            raise ValueError("a block size is an integer")
        elif isinstance(spec, int):
            # blocks of w indices; the last one may be shorter
            at[d] = step
            df = df.withColumn(step, (F.floor((F.col(d) - cube.origin.get(d, 0)) / spec) + 1).cast("long"))
        elif isinstance(spec, str):
            at[d] = spec  # a label column of the table
        elif isinstance(spec, Column):
            at[d] = step
            df = df.withColumn(step, spec)
        elif isinstance(spec, DataFrame):
            at[d] = step
            label = next(c for c in spec.columns if c != d)
            df = df.join(spec.select(d, F.col(label).alias(step)), d)
        else:
            windows = spec if isinstance(spec, Windows) else Labels(spec, cube.origin.get(d, 0), cyclic)
            if isinstance(windows, Labels) and d in cube.shape and len(windows.labels) != cube.shape[d]:
                raise ValueError(f"{len(windows.labels)} labels for {cube.shape[d]} indices of {d!r}")
            at[d] = step
            df = windows.assign(df, d, step)
    return df, at


def aggregate(cube: Cube, f, dimspec: Mapping[str, Spec], skipmissing: bool = False, strategy: str = "auto", cyclic: bool = False, keepdims: bool = True, every: bool = False) -> Cube:
    """The statistic ``f`` of each group; dimensions that are not named are kept as they are.

    ``f`` is a statistic, or a mapping {column: statistic} of several that are taken in one
    pass. A specification is None (the whole dimension), an integer (blocks of so many), a
    window list, a list of labels (one for each index), the name of a label column, or
    labels as an expression or as a table (dimension, label). Results are numbered from 1;
    labels of an expression or table by where they first appear. A dimension given by the
    name of a label column is called by it and keeps its labels. ``every`` adds the steps
    of block sizes and windows that hold no cell, as missing. ``strategy`` is checked but
    decides nothing: Spark aggregates partially wherever the statistic can be merged.
    """
    if strategy not in ("auto", "direct", "reduce"):
        raise ValueError(f"unknown strategy {strategy!r}")
    several = isinstance(f, Mapping) and "f" not in f
    given = f if isinstance(f, dict) and not several else {"f": f, "preproc": None}
    labelled = [d for d, spec in dimspec.items() if isinstance(spec, (Column, DataFrame))]
    df, at = _assign(cube, dimspec, cyclic)
    keys = [F.col(at[d]).alias(d if at[d].startswith("__") else at[d]) if d in at else F.col(d) for d in cube.dims if keepdims or dimspec.get(d, 0) is not None]
    rows = df.select(*keys, *((given["preproc"](F.col(v)) if given["preproc"] else F.col(v)).alias(v) for v in cube.values))
    names = rows.columns[: len(keys)]
    if isinstance(given["f"], stats.Mergeable):
        out = given["f"].aggregate(rows, names, cube.values[0])
        values = [cube.values[0]]
    else:
        if several:
            exprs = {name: e for name, g in f.items() for e in [next(iter(stats.expressions(g, cube.values[0], skipmissing).values()))]}
        else:
            exprs = {k: e for v in cube.values for k, e in stats.expressions(given["f"], v, skipmissing).items()}
        aggs = [e.alias(k) for k, e in exprs.items()]
        out, values = (rows.groupBy(*names).agg(*aggs) if names else rows.agg(*aggs)), list(exprs)
    for d in labelled:
        index = label_index(replace(cube, df=df), d, at[d]).withColumnRenamed(at[d], d)
        out = out.join(index, d).withColumn(d, F.col("index")).drop("index").select(*names, *values)
    if every:
        c = cube.measured()
        steps = {d: 1 if w is None else -(-c.shape[d] // w) if isinstance(w, int) else len(w) for d, w in dimspec.items()}
        full = Cube(cube.df.sparkSession.range(0).select(*(F.col("id").alias(n) for n in names)), tuple(names), (), {n: steps.get(n, c.shape.get(n, 0)) for n in names}, {n: 1 if n in steps else c.origin.get(n, 0) for n in names})
        out = full.grid().join(out, names, "left").select(*names, *values)
    shape = {d: n for d, n in cube.shape.items() if d not in dimspec}
    return Cube(out, tuple(names), tuple(values), shape, {n: cube.origin.get(n, 0) if n not in dimspec else 1 for n in names})


def label_index(cube: Cube, dim: str, label: str, block: int = 1 << 20) -> DataFrame:
    """(label, index): labels numbered from 1 by where they first appear along ``dim``.

    Labels are numbered side by side in blocks of indices; only the blocks' counts, a row
    for each ``block`` indices, are added up in one place.
    """
    from pyspark.sql import Window

    first = cube.df.groupBy(label).agg(F.min(dim).alias("__first")).withColumn("__block", F.floor(F.col("__first") / block))
    counts = first.groupBy("__block").agg(F.count_distinct("__first").alias("n"))
    before = counts.select("__block", (F.sum("n").over(Window.orderBy("__block")) - F.col("n")).alias("__before"))
    ranked = first.withColumn("__rank", F.dense_rank().over(Window.partitionBy("__block").orderBy("__first")))
    return ranked.join(before, "__block").select(label, (F.col("__before") + F.col("__rank")).cast("long").alias("index"))


_FOLDS: dict[str, Callable[[Column], Column]] = {"+": F.sum, "max": F.max, "min": F.min, "*": F.product}


def mapreduce(f: Callable[..., Column], op: str | stats.Mergeable, *cubes: Cube, dims: Sequence[str] | None = None, init: float | None = None, fin: Callable[[Column], Column] | None = None, skipmissing: bool = False, keepdims: bool = False) -> Cube:
    """``f`` of each cell (of several aligned cubes), folded by ``op`` over ``dims`` (all by default), then ``fin``.

    ``op`` is one of + * max min, or a ``Mergeable``. ``init`` takes part in the fold once a group.
    """
    from .maps import broadcast

    one = broadcast(f, *cubes) if len(cubes) > 1 else replace(cubes[0], df=cubes[0].df.select(*cubes[0].dims, f(*(F.col(v) for v in cubes[0].values)).alias("value")), values=("value",))
    gone = list(one.dims if dims is None else dims)
    kept = [d for d in one.dims if d not in gone]
    if isinstance(op, stats.Mergeable):
        out = op.aggregate(one.df, kept, "value")
    else:
        if op not in _FOLDS:
            raise ValueError(f"unknown fold {op!r}; give a Mergeable")
        e = stats.expressions(_FOLDS[op], "value", skipmissing)["value"]
        if init is not None:
            i = F.lit(init)
            # under strict rules a missing fold stays missing
            join = {"+": lambda x: x + i, "*": lambda x: x * i, "max": lambda x: F.greatest(x, i), "min": lambda x: F.least(x, i)}[op]
            e = F.when(e.isNotNull(), join(e))
        out = one.df.groupBy(*kept).agg(e.alias("value"))
    if fin is not None:
        out = out.withColumn("value", fin(F.col("value")))
    cube = Cube(out, tuple(kept), ("value",), {d: one.shape[d] for d in kept if d in one.shape}, {d: one.origin.get(d, 0) for d in kept})
    return cube.keepdims(gone) if keepdims else cube


def _reduction(name: str):
    def run(cube: Cube, dims: Sequence[str] | None = None, skipmissing: bool = False, keepdims: bool = False) -> Cube:
        gone = list(cube.dims if dims is None else dims)
        kept = [d for d in cube.dims if d not in gone]
        exprs = {k: e for v in cube.values for k, e in stats.expressions(name, v, skipmissing).items()}
        out = cube.df.groupBy(*kept).agg(*(e.alias(k) for k, e in exprs.items()))
        got = Cube(out, tuple(kept), tuple(exprs), {d: cube.shape[d] for d in kept if d in cube.shape}, {d: cube.origin.get(d, 0) for d in kept})
        return got.keepdims(gone) if keepdims else got

    run.__doc__ = f"The {name} over ``dims`` (all by default)."
    return run


total, maximum, minimum, extrema, mean = map(_reduction, ("sum", "maximum", "minimum", "extrema", "mean"))


def median(cube: Cube, dims: Sequence[str] = (), skipmissing: bool = False, keepdims: bool = False) -> Cube:
    """The exact median over ``dims``; over none, each cell is its own."""
    return _reduction("median")(cube, dims, skipmissing, keepdims)


def mapslices(f: Callable, *cubes: Cube, dims: Sequence[str], kind: str = "double", value: str = "value") -> Cube:
    """``f`` of each slice over ``dims``.

    ``f`` gets one list of values a cube, in the order of the slice's indices, as columns
    (an expression on arrays, which stays in the JVM). A slice has to fit in memory.
    """
    from .maps import align

    rows, values = align(*cubes)
    all_dims = list(dict.fromkeys(d for c in cubes for d in c.dims))
    kept = [d for d in all_dims if d not in dims]
    # the last dimension changes slowest
    cells = F.sort_array(F.collect_list(F.struct(*[F.col(d) for d in reversed([d for d in all_dims if d in dims])], *(F.col(v) for v in values))))
    out = rows.groupBy(*kept).agg(cells.alias("__s")).select(*kept, f(*(F.col("__s").getField(v) for v in values)).cast(kind).alias(value))
    shape = {d: n for c in cubes for d, n in c.shape.items() if d in kept}
    return Cube(out, tuple(kept), (value,), shape, {d: o for c in cubes for d, o in c.origin.items() if d in kept})


def zonal(cube: Cube, zones: Cube | str, f, skipmissing: bool = True) -> DataFrame:
    """(zone, value): the statistic of the cells of each zone.

    ``zones`` is a cube over some of the dimensions, or a column of the table itself.
    Cells without a zone are passed over.
    """
    given = f if isinstance(f, dict) else {"f": f, "preproc": None, "groupconv": None}
    if isinstance(zones, str):
        rows = cube.df.withColumn("zone", F.col(zones))
    else:
        shared = [d for d in zones.dims if d in cube.dims]
        rows = cube.df.join(zones.df.select(*shared, F.col(zones.values[0]).alias("zone")), shared)
    zone = given["groupconv"](F.col("zone")) if given.get("groupconv") else F.col("zone")
    value = cube.values[0]
    x = given["preproc"](F.col(value)) if given.get("preproc") else F.col(value)
    rows = rows.select(zone.alias("zone"), x.alias(value)).where(F.col("zone").isNotNull())
    if isinstance(given["f"], stats.Mergeable):
        return given["f"].aggregate(rows, ["zone"], value)
    exprs = stats.expressions(given["f"], value, skipmissing)
    return rows.groupBy("zone").agg(*(e.alias(k) for k, e in exprs.items()))


def count_map(cube: Cube, keys: Sequence[str] = (), dense: int | None = None, as_map: bool = False) -> DataFrame:
    """(keys, value, n): how often each value occurs; with ``dense`` every value below it, also those that don't occur."""
    value = cube.values[0]
    counts = cube.df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    if dense is not None:
        if keys:
            slots = counts.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(dense - 1))).alias(value))
        else:
            slots = cube.df.sparkSession.range(dense).select(F.col("id").alias(value))
        counts = slots.join(counts, [*keys, value], "left").select(*keys, value, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    if as_map:  # a map has as many entries as a group has values
        return counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(value, "n"))).alias("counts"))
    return counts
