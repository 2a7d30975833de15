"""Window lists over one dimension, and what a plan needs to know of them.

A window list gives, for each step k = 1..n of a loop, an inclusive range of indices.
``bounds(k)`` is that range as an expression on the step, and ``members(i)`` turns it
round: the array of the steps whose window holds index i. Where windows follow a formula
both are arithmetic, so no relation and no range join is needed; windows that are listed,
or lie in a table, meet the cells by an equi-join.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a listed relation, which the driver holds anyway, is sent to all tasks.
BROADCAST_ROWS = 1_000_000


def _indices(lo, hi) -> Column:
    """The array lo..hi; null if the window is empty, as a clamped one may be."""
    lo, hi = (F.col(x) if isinstance(x, str) else x for x in (lo, hi))
    return F.when(lo <= hi, F.sequence(lo, hi))


class Windows:
    """``len(w)``, ``w[k]`` (the k-th window, from 1) and their relation to indices."""

    #: whether each window is a single index, and whether no index is in two windows (None: not known)
    single: bool = False
    disjoint: bool | None = None

    def __len__(self) -> int:
        raise NotImplementedError

    def __getitem__(self, k: int) -> tuple[int, int]:
        raise NotImplementedError

    def ranges(self) -> list[tuple[int, int]]:
        return [self[k] for k in range(1, len(self) + 1)]

    def bounds(self, k: Column) -> tuple[Column, Column] | None:
        """The first and last index of step ``k``; None if there is no formula."""
        return None

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, lo, hi): made in parallel where there is a formula."""
        both = self.bounds(F.col("step"))
        if both is not None:
            steps = spark.range(1, len(self) + 1).select(F.col("id").alias("step"))
            return steps.select("step", both[0].cast("long").alias("lo"), both[1].cast("long").alias("hi"))
        return spark.createDataFrame([(k, *w) for k, w in enumerate(self.ranges(), 1)], "step long, lo long, hi long")

    def members(self, i: Column) -> Column | None:
        """The array of steps whose window holds ``i``; None if there is no formula."""
        return None

    def assign(self, df: DataFrame, dim: str, step: str) -> DataFrame:
        """A row of ``df`` for each window that holds its index, with the step number as ``step``."""
        at = self.members(F.col(dim))
        if at is None:
            rel = self.table(df.sparkSession).select(F.col("step").alias(step), F.explode(_indices("lo", "hi")).alias(dim))
            return df.join(F.broadcast(rel) if self._cells() <= BROADCAST_ROWS else rel, dim)
        return df.withColumn(step, F.explode(at)).withColumn(step, F.col(step).cast("long"))

    def _cells(self) -> int:
        return sum(hi - lo + 1 for lo, hi in self.ranges())

    def spread(self, df: DataFrame, dim: str) -> DataFrame:
        """A row of ``df`` for each index of the window of its step ``dim``, with the index in place of the step."""
        both = self.bounds(F.col(dim))
        if both is None:
            rel = self.table(df.sparkSession).withColumnRenamed("step", dim)
            df = df.join(F.broadcast(rel) if len(self) <= BROADCAST_ROWS else rel, dim)
            both = F.col("lo"), F.col("hi")
        lo, hi = (x.cast("long") for x in both)
        gone = [c for c in ("lo", "hi") if c in df.columns]
        if self.single:
            return df.withColumn(dim, lo).drop(*gone)
        return df.withColumn(dim, F.explode(_indices(lo, hi))).drop(*gone)


@dataclass(frozen=True)
class Points(Windows):
    """One index for each step: first, first + step, ..."""

    first: int
    n: int
    step: int = 1

    def __len__(self):
        return self.n

    single, disjoint = True, True

    def __getitem__(self, k):
        i = self.first + (k - 1) * self.step
        return i, i

    def bounds(self, k):
        return (i := F.lit(self.first) + (k - 1) * self.step), i

    def assign(self, df, dim, step):
        last = self.first + (self.n - 1) * self.step
        i = F.col(dim)
        rows = df.where(i.between(min(self.first, last), max(self.first, last)) & ((i - self.first) % abs(self.step) == 0))
        return rows.withColumn(step, (F.round((i - self.first) / self.step) + 1).cast("long"))


@dataclass(frozen=True)
class Whole(Windows):
    """One window over the whole dimension."""

    first: int = 1
    last: int = 1

    def __len__(self):
        return 1

    disjoint = True

    def __getitem__(self, k):
        return self.first, self.last

    def bounds(self, k):
        return F.lit(self.first), F.lit(self.last)

    def assign(self, df, dim, step):
        return df.withColumn(step, F.lit(1).cast("long"))


@dataclass(frozen=True)
class Sliding(Windows):
    """Windows of one width at a fixed step, which may be negative; ``clamp`` cuts them at both ends."""

    first: int
    step: int
    width: int
    n: int
    clamp: tuple[int, int] | None = None

    def __len__(self):
        return self.n

    def __getitem__(self, k):
        lo = self.first + (k - 1) * self.step
        hi = lo + self.width - 1
        return (max(lo, self.clamp[0]), min(hi, self.clamp[1])) if self.clamp else (lo, hi)

    @property
    def single(self):
        return self.width == 1

    @property
    def disjoint(self):
        return self.width <= abs(self.step)

    def bounds(self, k):
        lo = F.lit(self.first) + (k - 1) * self.step
        hi = lo + (self.width - 1)
        return (F.greatest(lo, F.lit(self.clamp[0])), F.least(hi, F.lit(self.clamp[1]))) if self.clamp else (lo, hi)

    def assign(self, df, dim, step):
        i = F.col(dim)
        if self.clamp:
            df = df.where(i.between(*self.clamp))
        if self.step > 0 and self.width == self.step:  # disjoint: no array, no explode
            k = F.floor((i - self.first) / self.step) + 1
            return df.where(i.between(self.first, self.first + self.n * self.step - 1)).withColumn(step, k.cast("long"))
        # lo(k) <= i <= lo(k) + width - 1
        a, b = (i - self.first - self.width + 1) / self.step, (i - self.first) / self.step
        low, high = (F.ceil(a), F.floor(b)) if self.step > 0 else (F.ceil(b), F.floor(a))
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(self.n - 1))
        steps = F.when(low <= high, F.sequence(low, high))
        return df.withColumn(step, F.explode(steps)).withColumn(step, (F.col(step) + 1).cast("long"))


def Tumbling(first: int, width: int, n: int) -> Sliding:
    """Blocks of ``width`` indices, side by side."""
    return Sliding(first, width, width, n)


@dataclass(frozen=True)
class Regular(Windows):
    """Windows of ``window`` indices whose starts advance by a fractional step; the last ones are cut at ``stop``."""

    start: int
    stop: int
    window: int
    step: float

    def __len__(self):
        return math.ceil((self.stop - self.start + 1) / self.step)

    def __getitem__(self, k):
        lo = self.start + math.floor((k - 1) * self.step)
        return lo, min(lo + self.window - 1, self.stop)

    @property
    def disjoint(self):
        return self.window <= math.floor(self.step)

    def bounds(self, k):
        lo = F.lit(self.start) + F.floor((k - 1) * F.lit(float(self.step)))
        return lo, F.least(lo + (self.window - 1), F.lit(self.stop))

    def members(self, i):
        # floor((k - 1) * step) is between i - start - window + 1 and i - start
        low = F.greatest(F.ceil((i - self.start - self.window + 1) / F.lit(float(self.step))), F.lit(0))
        high = F.least(F.ceil((i - self.start + 1) / F.lit(float(self.step))) - 1, F.lit(len(self) - 1))
        inside = i.between(self.start, self.stop) & (low <= high)
        return F.transform(F.when(inside, F.sequence(low, high)), lambda k: k + 1)


@dataclass(frozen=True)
class Ranges(Windows):
    """Listed windows: indices or inclusive (lo, hi) ranges."""

    given: tuple

    def __init__(self, given: Sequence):
        fixed = []
        for w in given:
            if isinstance(w, range) and w.step == 1 and len(w):
                w = (w[0], w[-1])
            elif isinstance(w, int):
                w = (w, w)
            if not (isinstance(w, tuple) and len(w) == 2 and all(isinstance(x, int) for x in w)):
                raise ValueError("windows are integers, ranges or pairs of integers")
            fixed.append(w)
        object.__setattr__(self, "given", tuple(fixed))

    @property
    def single(self):
        return all(lo == hi for lo, hi in self.given)

    @property
    def disjoint(self):
        inorder = sorted(self.given)
        return all(hi < lo for (_, hi), (lo, _) in zip(inorder, inorder[1:]))

    def __len__(self):
        return len(self.given)

    def __getitem__(self, k):
        return self.given[k - 1]


@dataclass(frozen=True)
class Repeated(Windows):
    """One index for all of n steps: stretches a dimension, or reduces to one output cell."""

    value: int
    n: int

    def __len__(self):
        return self.n

    single = True

    @property
    def disjoint(self):
        return self.n <= 1

    def __getitem__(self, k):
        return self.value, self.value

    def bounds(self, k):
        return F.lit(self.value), F.lit(self.value)

    def members(self, i):
        return F.when(i == self.value, F.sequence(F.lit(1), F.lit(self.n)))


@dataclass(frozen=True)
class Formula(Windows):
    """n windows given by an expression on the step: its one index, or its first and last one."""

    n: int
    low: Callable[[Column], Column]
    high: Callable[[Column], Column] | None = None

    @property
    def single(self):
        return self.high is None

    def __len__(self):
        return self.n

    def bounds(self, k):
        lo = self.low(k)
        return lo, lo if self.high is None else self.high(k)

    def assign(self, df, dim, step):
        rel = self.table(df.sparkSession).select(F.col("step").alias(step), F.explode(_indices("lo", "hi")).alias(dim))
        return df.join(rel, dim)


@dataclass(frozen=True)
class InTable(Windows):
    """Windows that lie in a table (step, lo, hi), with steps numbered from 1 to ``n``."""

    df: DataFrame
    n: int

    def __len__(self):
        return self.n

    def table(self, spark):
        return self.df.select(*(F.col(c).cast("long").alias(c) for c in ("step", "lo", "hi")))

    def assign(self, df, dim, step):
        return df.join(self.table(df.sparkSession).select(F.col("step").alias(step), F.explode(_indices("lo", "hi")).alias(dim)), dim)

    def spread(self, df, dim):
        return df.join(self.table(df.sparkSession).withColumnRenamed("step", dim), dim).withColumn(dim, F.explode(_indices("lo", "hi"))).drop("lo", "hi")


@dataclass(frozen=True)
class Labels(Windows):
    """Groups of equal labels, one for each index, numbered in the order in which they first appear.

    For labels that lie in a column or table, give ``aggregate`` that instead.
    """

    labels: tuple
    first: int = 1
    cyclic: bool = False

    def __init__(self, labels: Sequence, first: int = 1, cyclic: bool = False):
        object.__setattr__(self, "labels", tuple(labels))
        object.__setattr__(self, "first", first)
        object.__setattr__(self, "cyclic", cyclic)
        if not cyclic and sum(a != b for a, b in zip(self.labels, self.labels[1:])) >= max(1, len(set(self.labels))):
            raise ValueError("labels come back after others; pass cyclic=True for such groups")

    @property
    def names(self) -> list:
        return list(dict.fromkeys(self.labels))

    def __len__(self):
        return len(self.names)

    def __getitem__(self, k):
        at = [i for i, x in enumerate(self.labels, self.first) if x == self.names[k - 1]]
        return at[0], at[-1]

    def assign(self, df, dim, step):
        number = {x: k for k, x in enumerate(self.names, 1)}
        rows = [(i, number[x]) for i, x in enumerate(self.labels, self.first)]
        rel = df.sparkSession.createDataFrame(rows, f"{dim} long, {step} long")
        return df.join(F.broadcast(rel) if len(rows) <= BROADCAST_ROWS else rel, dim)


# -- what is true of a list of windows, from its table ------------------------------------


def _held(windows: DataFrame) -> DataFrame:
    """(lo, hi, i): the indices of each different window."""
    return windows.select("lo", "hi").distinct().select("lo", "hi", F.explode(_indices("lo", "hi")).alias("i"))


def traits(windows: DataFrame) -> DataFrame:
    """One row on a table (step, lo, hi): n, lo, hi, ordering, repeats, overlapping, covered, nested.

    Windows are taken as sets of indices. ``ordering`` is increasing (or decreasing) if no
    window begins or ends before (after) the one of the step before, else unordered;
    ``repeats`` counts windows that are equal to another one; ``overlapping`` is whether an
    index is in two different windows; ``covered`` is the share of the span's indices that
    is in any; ``nested`` counts pairs of different windows of which one contains the other.
    """
    w = windows.select("step", "lo", "hi")
    steps = w.alias("a").join(w.select((F.col("step") - 1).alias("step"), F.col("lo").alias("l"), F.col("hi").alias("h")).alias("b"), "step")
    order = steps.agg(F.coalesce(F.bool_and(F.expr("l >= lo and h >= hi")), F.lit(True)).alias("up"), F.coalesce(F.bool_and(F.expr("l <= lo and h <= hi")), F.lit(True)).alias("down"))
    order = order.select(F.when(F.col("up"), "increasing").when(F.col("down"), "decreasing").otherwise("unordered").alias("ordering"))
    whole = w.agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.count("*") - F.count_distinct("lo", "hi")).alias("repeats"))
    cells = _held(w).groupBy("i").agg(F.count("*").alias("c")).agg(F.count("*").alias("cells"), F.coalesce(F.max("c") > 1, F.lit(False)).alias("overlapping"))
    other = w.select(F.col("lo").alias("i"), F.col("hi").alias("h")).distinct()
    nested = _held(w).join(other, "i").where("h <= hi and not (i = lo and h = hi)").agg(F.count("*").alias("nested"))
    out = reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), [whole, order, cells, nested])  # of one row each
    return out.select("n", "lo", "hi", "ordering", "repeats", "overlapping", (F.col("cells") / (F.col("hi") - F.col("lo") + 1)).alias("covered"), "nested")


def breaks(*windows: DataFrame) -> DataFrame:
    """(at): indices at which every list has a window's end and no window of any list goes on."""
    ends = reduce(DataFrame.intersect, (w.select(F.col("hi").alias("at")) for w in windows))
    across = reduce(DataFrame.unionAll, (_held(w).where("i < hi").select(F.col("i").alias("at")) for w in windows))
    return ends.join(across, "at", "left_anti").distinct()


def groups(windows: DataFrame, at: Sequence[int]) -> DataFrame:
    """(step, lo, hi, grp): steps by the first break that their window doesn't pass; at most ``BROADCAST_ROWS`` breaks are sent to all tasks."""
    if len(at) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} breaks")
    ends = pd.Index(sorted(at))

    @F.pandas_udf("long")
    def number(hi: pd.Series) -> pd.Series:
        return pd.Series(ends.searchsorted(hi) + 1)

    return windows.select("step", "lo", "hi", number("hi").alias("grp"))
