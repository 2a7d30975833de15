"""Window lists: formulas against the list itself, traits, breaks and groups against brute force over sets of indices."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom import Cube, planned_chunks
from gridloom.operators.windows import Formula, InTable, Labels, Points, Ranges, Regular, Repeated, Sliding, Tumbling, Whole, breaks, groups, traits

LISTS = [
    Sliding(3, 2, 5, 9), Sliding(40, -3, 4, 9), Tumbling(0, 4, 10), Sliding(0, 5, 2, 8), Sliding(7, -2, 1, 3), Regular(2, 40, 3, 2.5), Regular(0, 30, 2, 3.3), Repeated(7, 4), Points(30, 6, -4), Whole(0, 12),
    Sliding(-2, 3, 6, 12, clamp=(1, 20)), Ranges([(1, 4), (3, 9), 12]), Ranges([5, 2, 9]), Formula(7, lambda k: k * 3, lambda k: k * 3 + 4), Formula(6, lambda k: k * k),
]


def table_of(spark, windows):
    return spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(windows, 1)], "step long, lo long, hi long")


@pytest.mark.parametrize("w", LISTS, ids=lambda w: type(w).__name__)
def test_formulas_equal_the_list(spark, w):
    listed = [(r.lo, r.hi) for r in w.table(spark).orderBy("step").collect()]
    if not isinstance(w, Formula):
        assert listed == w.ranges()
    pairs = {(i, k) for k, (a, b) in enumerate(listed, 1) for i in range(a, b + 1)}
    cells = spark.range(-5, 60).withColumnRenamed("id", "i")
    held = cells if not isinstance(w, Whole) else cells.where("i between 0 and 12")
    assert {(r.i, r.k) for r in w.assign(held, "i", "k").collect()} == pairs
    steps = spark.range(1, len(w) + 1).select(F.col("id").alias("k"), F.col("id").alias("was"))
    assert {(r.k, r.was) for r in w.spread(steps, "k").collect()} == pairs
    counts = [i for i, _ in pairs]
    if w.disjoint is not None:
        assert w.disjoint == (len(counts) == len(set(counts)))
    assert w.single == all(a == b for a, b in listed) or not w.single


def brute_traits(windows):
    sets = [frozenset(range(a, b + 1)) for a, b in windows]
    different = set(sets)
    union = frozenset().union(*sets)
    lo, hi = min(a for a, _ in windows), max(b for _, b in windows)
    pairs = list(zip(windows, windows[1:]))
    ordering = "increasing" if all(c >= a and d >= b for (a, b), (c, d) in pairs) else "decreasing" if all(c <= a and d <= b for (a, b), (c, d) in pairs) else "unordered"
    nested = sum(x > y for x in different for y in different)
    return len(sets), lo, hi, ordering, len(sets) - len(different), sum(map(len, different)) > len(union), len(union) / (hi - lo + 1), nested


def test_traits(spark):
    r = random.Random(11)
    lists = [[(a, a + r.randrange(4)) for a in r.choices(range(20), k=n)] for n in (1, 2, 5, 9)]
    lists += [[(a, a) for a in range(9, 0, -2)], [(a, a + 6) for a in range(0, 30, 3)], [(4, 4)] * 3 + [(5, 5)], [(1, 9), (2, 3)], [(0, 2), (50, 52)]]
    for windows in lists:
        got = traits(table_of(spark, windows)).first()
        assert tuple(got) == pytest.approx(brute_traits(windows)) if got.ordering is None else tuple(got)[:6] + (round(got.covered, 9), got.nested) == tuple(round(x, 9) if isinstance(x, float) else x for x in brute_traits(windows))


def test_breaks_and_groups(spark):
    r = random.Random(12)

    def cut(n, most):
        out, at = [], 0
        while at < n:
            end = min(n, at + r.randrange(1, most))
            out.append((at, end - 1))
            at = end
        return out

    for _ in range(3):
        lists = [cut(60, most) for most in (4, 7)]
        expected = [i for i in range(60) if all(any(b == i for _, b in w) and not any(a <= i < b for a, b in w) for w in lists)]
        at = sorted(x["at"] for x in breaks(*(table_of(spark, w) for w in lists)).collect())
        assert at == expected
        for w in lists:
            for x in groups(table_of(spark, w), at).collect():
                assert x.grp == 1 + sum(b < x.hi for b in at)


def test_windows_in_a_table(spark):
    windows = [(5, 9), (0, 2), (5, 6)]
    w = InTable(table_of(spark, windows), 3)
    cells = spark.range(12).withColumnRenamed("id", "i")
    assert {(x.i, x.k) for x in w.assign(cells, "i", "k").collect()} == {(i, k) for k, (a, b) in enumerate(windows, 1) for i in range(a, b + 1)}


def test_errors():
    with pytest.raises(ValueError, match="integers"):
        Ranges([1.5])
    with pytest.raises(ValueError, match="come back"):
        Labels(["a", "b", "a"])
    assert len(Labels(["a", "b", "a"], cyclic=True)) == 2 and Labels(["x", "x", "y"]).ranges() == [(1, 2), (3, 3)]
    with pytest.raises(ValueError, match="breaks"):
        groups(None, range(1_000_001))


def test_planned_chunks(spark):
    cube = Cube(spark.range(0), ("x", "y", "t"), (), {"x": 1000, "y": 500, "t": 40})
    for rows in (1, 100, 30_000, 10**9):
        got = planned_chunks(cube, rows, {"x": 10, "t": 4})
        cells = got["x"] * got["y"] * got["t"]
        assert got["x"] % 10 == 0 and got["t"] % 4 == 0 and (cells <= rows or got == {"x": 10, "y": 1, "t": 4})
        assert cells * 2 > rows or all(got[d] >= n for d, n in cube.shape.items())
