"""Cube operators against values worked out by hand or by numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import Axis, Cube, InputArray, OutWindows, Ranges, Repeated, Tumbling, aggregate, broadcast, create_function, interpolate, map_cells, mapreduce, mapslices, median, pyramid, rechunk, run_blocks, windowed_op, zonal
from gridloom.functions.stats import Mergeable, finite, has_mergeable
from gridloom.operators import aggregate as A
from gridloom.operators import maps, moving
from gridloom.plans import inspect
from gridloom.sources.layout import Manifest, blocks_of, copy_to, write_cube


def vector(spark, data, kind="double"):
    return Cube.from_nested(spark, data, ["i"], kind=kind)


def test_sum_of_sums(spark):
    inner = aggregate(vector(spark, list(range(1, 21))), "sum", {"i": 5})
    assert inner.collect() == {(1,): 15, (2,): 40, (3,): 65, (4,): 90}
    assert aggregate(inner, "sum", {"i": 2}).collect() == {(1,): 55.0, (2,): 155.0}


def test_general_operation_is_the_same(spark):
    c = vector(spark, list(range(1, 21)))
    first = windowed_op([InputArray(c, {"i": Tumbling(1, 5, 4)})], lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x))
    second = windowed_op([InputArray(first)], lambda v: v, OutWindows({"i": Ranges([1, 1, 2, 2])}), red="sum")
    assert second.collect() == {(1,): 55.0, (2,): 155.0}
    with pytest.raises(ValueError, match="give red"):
        windowed_op([InputArray(c)], lambda v: v, OutWindows({"i": Repeated(1, 20)}))
    with pytest.raises(ValueError, match="windows"):
        windowed_op([InputArray(c), InputArray(vector(spark, [1.0, 2.0]))], lambda a, b: a + b)
    with pytest.raises(ValueError, match="no loops"):
        windowed_op([InputArray(c)], lambda v: v, OutWindows({"j": Repeated(1, 20)}))


def test_strict_and_skipping(spark):
    c = vector(spark, [1.0, None, 3.0, 4.0, float("nan"), float("inf"), None, None, 5.0])
    assert aggregate(c, "sum", {"i": 2}).collect()[(1,)] is None
    got = aggregate(c, "mean", {"i": 2}, skipmissing=True).collect()
    assert got == {(1,): 1.0, (2,): 3.5, (3,): None, (4,): None, (5,): 5.0}
    assert A.total(c.subset(i=(1, 4)), skipmissing=True).collect() == {(): 8.0}
    assert has_mergeable("mean") and not has_mergeable("median")
    with pytest.raises(ValueError, match="strategy"):
        aggregate(c, "sum", {"i": 2}, strategy="other")
    with pytest.raises(ValueError, match="unknown statistic"):
        aggregate(c, "summ", {"i": 2})
    with pytest.raises(ValueError, match="no dimension"):
        aggregate(c, "sum", {"j": 2})
    with pytest.raises(ValueError, match="labels"):
        aggregate(c, "sum", {"i": ["a", "b"]})


def test_broadcast_shapes(spark):
    a = Cube.from_nested(spark, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], ["i", "j"])
    row = Cube.from_nested(spark, [[10.0, 20.0, 30.0]], ["i", "j"])
    assert broadcast(lambda x, y: x + y, a, row).collect()[(2, 3)] == 36.0
    column = Cube.from_nested(spark, [5.0, 7.0], ["i"])
    assert broadcast(lambda x, y, z: x * y + z, a, column, 1).collect()[(2, 1)] == 29.0
    with pytest.raises(ValueError, match="lengths"):
        broadcast(lambda x, y: x + y, a, Cube.from_nested(spark, [1.0, 2.0, 3.0], ["i"]))
    outer = broadcast(lambda x, y: x * y, column, Cube.from_nested(spark, [1.0, 2.0, 3.0], ["i"]).rename(i="k"))
    assert len(outer.collect()) == 6


def test_reductions_and_slices(spark):
    data = np.arange(24.0).reshape(2, 3, 4)
    c = Cube.from_nested(spark, data.tolist(), ["i", "j", "k"])
    assert A.total(c, ["i", "k"]).collect() == {(j + 1,): data[:, j].sum() for j in range(3)}
    assert A.extrema(c, ["j", "k"]).collect() == {(1,): (0.0, 11.0), (2,): (12.0, 23.0)}
    assert median(c).collect() == {(i + 1, j + 1, k + 1): data[i, j, k] for i in range(2) for j in range(3) for k in range(4)}
    assert mapreduce(lambda x: x * 2, "max", c, dims=["i", "j"], init=40.0, fin=lambda x: x + 1).collect()[(4,)] == 47.0
    last = mapslices(lambda x: F.element_at(x, -1), c, dims=["i", "j"])
    assert last.collect() == {(k + 1,): data[1, 2, k] for k in range(4)}
    kept = A.mean(c, ["j"], keepdims=True)
    assert set(kept.dims) == {"i", "j", "k"} and kept.shape["j"] == 1
    two = mapslices(lambda x, y: F.array_max(x) + F.array_max(y), c, c, dims=["j", "k"])
    assert two.collect() == {(1,): 22.0, (2,): 46.0}


def test_own_statistics(spark):
    squares = Mergeable(lambda: 0.0, lambda a, x: a + x * x, lambda a, b: a + b, lambda a: a)
    c = vector(spark, [1.0, None, 3.0, 4.0])
    assert aggregate(c, squares, {"i": 2}).collect() == {(1,): 1.0, (2,): 25.0}
    f = create_function(lambda x: x, "double", red=lambda a, b: max(a, b), init=lambda: 0.0, finalize=lambda a: -a)
    assert [r.value for r in f.reduce(vector(spark, [2.0, 9.0, 4.0]), ["i"]).collect()] == [-9.0]
    with pytest.raises(ValueError, match="one output"):
        create_function(lambda x: (x, x), ["double", "double"], red=max)
    with pytest.raises(ValueError, match="results"):
        create_function(lambda x: (x, x), "double").on(c)


def test_zones(spark):
    c = vector(spark, [1.0, 2.0, 3.0, None])
    zones = Cube.from_nested(spark, [7, 8, 7, None], ["i"], kind="long")
    assert {r.zone: r.value for r in zonal(c, zones, "sum").collect()} == {7: 4.0, 8: 2.0}


def test_count_maps(spark):
    c = vector(spark, [3, 3, 1, None], kind="long")
    assert {r.value: r.n for r in A.count_map(c).collect()} == {3: 2, 1: 1}
    dense = {r.value: r.n for r in A.count_map(c, dense=5).collect()}
    assert dense == {0: 0, 1: 1, 2: 0, 3: 2, 4: 0}
    assert A.count_map(c, as_map=True).first()["counts"] == {3: 2, 1: 1}


def test_rolling_over_blocks(spark):
    data = np.random.default_rng(3).normal(size=200)
    c = vector(spark, data.tolist())
    got = moving.rolling(c, "i", 3, 2, F.max, block=16).collect()
    assert got == {(i + 1,): data[max(0, i - 3) : i + 3].max() for i in range(200)}
    full = moving.rolling(c, "i", 3, 2, F.max, full_only=True, block=16).collect()
    assert sorted(full) == [(i,) for i in range(4, 199)]


def test_neighbourhood(spark):
    data = np.random.default_rng(4).normal(size=(6, 5))
    got = moving.neighbourhood(Cube.from_nested(spark, data.tolist(), ["i", "j"]), {"i": 1, "j": 2}, "median").collect()
    for i in range(6):
        for j in range(5):
            assert got[i + 1, j + 1] == pytest.approx(np.median(data[max(0, i - 1) : i + 2, max(0, j - 2) : j + 3]))


@pytest.mark.parametrize("f", ["sum", "mean", "nvalid", "minimum", "maximum", "median", "variance", "mode"])
@pytest.mark.parametrize("skipmissing", [True, False])
def test_neighbourhoods_equal_brute_force(spark, f, skipmissing):
    """Separable and block-wise neighbourhoods, with missing cells and cells that have no row."""
    r = np.random.default_rng(6)
    data = np.round(r.normal(size=(9, 7)) * 2) + 0.0
    data[r.random(data.shape) < 0.25] = np.nan
    gone = r.random(data.shape) < 0.2
    rows = [(i, j, 5, None if np.isnan(data[i, j]) else float(data[i, j])) for i in range(9) for j in range(7) if not gone[i, j]]
    c = Cube(spark.createDataFrame(rows, "i long, j long, t long, v double"), ("i", "j", "t"), ("v",), {"i": 9, "j": 7}, {"i": 0, "j": 0, "t": 5})
    extra = {"side": 4} if f in ("median", "variance") else {}
    got = moving.neighbourhood(c, {"i": 2, "j": 1}, f, skipmissing, **extra).collect()
    of = {"sum": np.sum, "mean": np.mean, "nvalid": len, "minimum": np.min, "maximum": np.max, "median": np.median, "variance": lambda x: np.var(x, ddof=1) if len(x) > 1 else None, "mode": lambda x: min(set(x), key=lambda v: (-list(x).count(v), v))}[f]
    for i in range(9):
        for j in range(7):
            at = [(a, b) for a in range(max(0, i - 2), min(9, i + 3)) for b in range(max(0, j - 1), min(7, j + 2)) if not gone[a, b]]
            x = np.array([data[p] for p in at])
            if not at:
                assert (i, j, 5) not in got
                continue
            here = x[~np.isnan(x)]
            missing = not skipmissing and len(here) < len(x) and f != "nvalid"
            want = None if missing or not len(here) and f != "nvalid" else of(here)
            assert got[i, j, 5] == (want if want is None else pytest.approx(want)), (i, j)


@pytest.mark.parametrize("method", ["linear", "nearest", "previous", "next"])
def test_interpolation_on_axes_of_all_kinds(spark, method):
    """Arithmetic spreading and listed axes give what placing every target one by one gives."""
    values = [1.0, 4.0, 9.0, 16.0, 25.0, 36.0]
    c = Cube.from_nested(spark, values, ["i"], origin=3)
    up, down = Axis.uniform(10, 2, 6), Axis.uniform(20, -2, 6)
    lists = [Axis.of([10, 12, 14, 16, 18, 20]), Axis.of([20, 17, 16, 11, 3, 2])]
    for src in (up, down, *lists):
        for dst in (Axis.uniform(5, 0.75, 30), Axis.uniform(27, -1.3, 20), Axis.of([3, 10, 10.5, 19, 20, 40])):
            xs = [dst[k] for k in range(dst.n)]
            known = [src[k] for k in range(src.n)]
            pairs = sorted(zip(known, range(6)))
            places = np.interp(xs, [x for x, _ in pairs], [k for _, k in pairs])
            p = np.clip(places, 0, 5)
            want = {"linear": np.interp(p, range(6), values), "nearest": [values[min(int(q + 0.5), 5)] for q in p], "previous": [values[int(np.floor(q + 1e-12))] for q in p], "next": [values[int(np.ceil(q - 1e-12))] for q in p]}[method]
            got = interpolate(c, {"i": (src, dst)}, method).collect()
            assert [got[k + 3,] for k in range(dst.n)] == pytest.approx(list(want)), (src, dst)


@pytest.mark.parametrize("f", ["sum", "mean", "minimum", "nvalid", "median"])
@pytest.mark.parametrize("skipmissing", [True, False])
def test_pyramid_levels(spark, f, skipmissing):
    data = [1.0, 2.0, None, 4.0, 5.0, 7.0, 8.0, None, None, None, 3.0]
    got = {(r.level, r.i): r.value for r in pyramid(vector(spark, data), ["i"], 3, f, skipmissing).collect()}
    for level in (1, 2, 3):
        for b in range(-(-len(data) // 2**level)):
            x = data[b * 2**level : (b + 1) * 2**level]
            here = [v for v in x if v is not None]
            want = float(len(here)) if f == "nvalid" else None if not here or not skipmissing and len(here) < len(x) else {"sum": sum, "mean": np.mean, "minimum": min, "median": np.median}[f](here)
            assert got[level, b + 1] == want, (level, b)


def test_several_statistics_and_empty_groups(spark):
    c = Cube(vector(spark, [1.0, 2.0, 3.0, 4.0, 5.0]).df.where("i <> 3 and i <> 4"), ("i",), ("value",), {"i": 5}, {"i": 1})
    got = {r.i: (r.low, r.n) for r in aggregate(c, {"low": "minimum", "n": "nvalid"}, {"i": 2}, every=True).df.collect()}
    assert got == {1: (1.0, 2), 2: (None, None), 3: (5.0, 1)}
    labels = c.df.select("i", F.when(F.col("i") == 5, "a").otherwise("z").alias("l"))
    assert aggregate(c, "sum", {"i": labels}).collect() == {(1,): 3.0, (2,): 5.0}
    many = Cube(spark.range(300).select(F.col("id").alias("i"), (F.col("id") * 7 % 100).cast("string").alias("l")), ("i",), ())
    index = {r.l: r["index"] for r in A.label_index(many, "i", "l", block=16).collect()}
    assert index == {str(k * 7 % 100): k + 1 for k in range(100)}


def test_start_values_and_filters(spark):
    c = Cube(spark.range(100).select(F.col("id").alias("i"), F.lit(1.0).alias("value")).repartition(4), ("i",), ("value",))
    plus = create_function(lambda x: x, "double", red=lambda a, b: a + b, init=10.0)
    assert [r.value for r in plus.reduce(c, ["i"]).collect()] == [110.0]
    pairs = create_function(lambda x: x, "double", red=lambda a, x: (a[0] + 1, a[1] + x), init=(0, 0.0), merge=lambda a, b: (a[0] + b[0], a[1] + b[1]), finalize=lambda a: a[0] * 1000 + a[1])
    assert [r.value for r in pairs.reduce(c, ["i"]).collect()] == [100_100.0]
    skipped = create_function(lambda x: x, "double", red=lambda a, b: a + b, filters=[maps.std_zero])
    assert [r.value for r in skipped.reduce(c, ["i"]).collect()] == [None]
    with pytest.raises(ValueError, match="filters"):
        create_function(lambda x: x, "double", filters=[maps.std_zero]).on(c)


def test_interpolation_of_a_linear_field(spark):
    data = [[[i + j + k for k in range(1, 7)] for j in range(1, 6)] for i in range(1, 5)]
    c = Cube.from_nested(spark, data, ["i", "j", "k"])
    src, dst = Axis.uniform(5, 5, 4), Axis.uniform(5, 0.5, 31)
    down, ddst = Axis.of([14, 11, 8, 5, 2]), Axis.uniform(1.5, 1, 14)
    got = interpolate(c, {"i": (src, dst), "j": (down, ddst)}).collect()
    assert len(got) == 31 * 14 * 6
    for a, x in enumerate(np.arange(5, 20.01, 0.5)):
        for b, y in enumerate(np.arange(1.5, 14.6, 1)):
            place = (14 - min(max(y, 2), 14)) / 3 + 1
            assert got[a + 1, b + 1, 2] == pytest.approx(x / 5 + place + 2)
    with pytest.raises(ValueError, match="sorted"):
        Axis.of([1, 3, 2])
    with pytest.raises(ValueError, match="method"):
        interpolate(c, {"i": (src, dst)}, method="cubic")


def test_missing_node_makes_missing_target(spark):
    c = vector(spark, [1.0, None, 3.0])
    got = interpolate(c, {"i": (Axis.uniform(0, 1, 3), Axis.uniform(0, 0.5, 5))}).collect()
    assert got == {(1,): 1.0, (2,): None, (3,): None, (4,): None, (5,): 3.0}


def test_filters(spark):
    c = vector(spark, [1.0, 1.0, None, 2.0, None, None])
    rows = c.df.groupBy(F.floor((F.col("i") - 1) / 2).alias("k"))
    run = lambda *f: {r.k: r.v for r in rows.agg(maps.filtered(F.sum, *f)(F.col("value")).alias("v")).collect()}
    assert run(maps.all_missing) == {0: 2.0, 1: 2.0, 2: None}
    assert run(maps.any_missing) == {0: 2.0, 1: None, 2: None}
    assert run(maps.n_valid(1)) == {0: 2.0, 1: None, 2: None}
    assert run(maps.std_zero) == {0: None, 1: None, 2: None}
    assert run(maps.no_filter, maps.user_filter(lambda x: F.count(x) == 1)) == {0: 2.0, 1: None, 2: None}


def test_plans(spark, tmp_path):
    spark.range(1000).selectExpr("id as i", "id * 2.0 as value", "id as other").write.parquet(str(tmp_path / "t"))
    c = Cube.from_table(spark.read.parquet(str(tmp_path / "t")), ["i"], ["value"])
    twice = map_cells(map_cells(c, lambda v: v + 1), lambda v: v * 2)
    assert inspect.is_fused(twice.df) and inspect.shuffles(twice.df) == 0
    part = c.subset(i=(10, 19))
    assert any("GreaterThanOrEqual(i,10)" in p for p in inspect.pushed(part.df))
    assert inspect.read_columns(part.df) == [["i", "value"]]
    assert inspect.shuffles(aggregate(c, "sum", {"i": 10}).df) == 1
    assert "shuffles: 1" in inspect.describe(aggregate(c, "sum", {"i": 10}).df)


def test_rechunk_and_write(spark, tmp_path):
    c = Cube.from_nested(spark, np.arange(60.0).reshape(6, 10).tolist(), ["i", "j"])
    assert rechunk(c, {"i": 2, "j": 5}, str(tmp_path / "a")).collect() == c.collect()
    with pytest.raises(ValueError, match="no dimensions"):
        rechunk(c, {"z": 2}, str(tmp_path / "b"))
    with pytest.raises(ValueError, match="target"):
        rechunk(c, {"i": 2}, str(tmp_path / "c"), shape={"i": 6, "j": 11})
    copy_to(map_cells(c, lambda v: v * 2), str(tmp_path / "d"), {"i": 6, "j": 10}, {"i": 3})
    assert spark.read.parquet(str(tmp_path / "d")).agg(F.sum("value")).first()[0] == 2 * sum(range(60))
    write_cube(c, str(tmp_path / "e"), shape={"i": 4, "j": 10})
    assert spark.read.parquet(str(tmp_path / "e")).count() == 40


def test_product(spark):
    got = Cube.product(spark, a=[1, 2, 3], b=["x", "y"], c=[1.5, 2.5, 3.5, 4.5]).collect()
    assert len(got) == 24 and got[1, 1, 1] == (1, "x", 1.5) and got[3, 2, 4] == (3, "y", 4.5)


def test_restart(spark, tmp_path):
    c = Cube.from_nested(spark, [[i + 3 * j for j in range(10)] for i in range(1, 4)], ["i", "j"], kind="long")
    ranges = {"i": [(1, 1), (2, 2), (3, 3)], "j": [(1, 4), (5, 8), (9, 10)]}
    path = str(tmp_path / "run")

    def failing(block):
        return block.df.withColumn("value", F.when(F.col("value") == 28, F.raise_error(F.lit("stopped here")).cast("long")).otherwise(F.col("value")))

    def resumed(block):
        return block.df.withColumn("value", F.when(F.col("value") < 25, F.raise_error(F.lit("not again")).cast("long")).otherwise(F.col("value")))

    with pytest.raises(Exception, match="stopped here"):
        run_blocks(c, failing, ranges, path, parallel=1)
    with pytest.raises(Exception, match="not again"):
        run_blocks(c, resumed, ranges, str(tmp_path / "other"))
    told = []
    got = run_blocks(c, resumed, ranges, path, mode="continue", progress=lambda n, of: told.append((n, of)))
    assert told[-1] == (9, 9) and 0 < len(told) <= 3
    assert sorted(r.value for r in got.collect()) == list(range(1, 31))
    assert not (tmp_path / "run/_plan").exists()
    side_by_side = run_blocks(c, lambda block: block.df, ranges, path, parallel=4)
    assert sorted(r.value for r in side_by_side.collect()) == list(range(1, 31))


def test_manifest(spark, tmp_path):
    blocks = blocks_of([[(1, 3), (4, 6), (7, 9), (10, 10)], [(1, 1), (2, 3), (4, 6)]])
    m = Manifest(spark, str(tmp_path / "m"), blocks, "overwrite")
    for n in (0, 2, 4):
        spark.range(1).write.parquet(m.folder(n))
    (tmp_path / "m" / "block=5").mkdir()  # cut off before it was committed
    again = Manifest(spark, str(tmp_path / "m"), blocks, "continue")
    assert again.finished() == [((1, 3), (1, 1)), ((7, 9), (1, 1)), ((1, 3), (2, 3))]
    assert sorted(b for _, b in again.remaining()) == [((1, 3), (4, 6)), ((4, 6), (1, 1)), ((4, 6), (2, 3)), ((4, 6), (4, 6)), ((7, 9), (2, 3)), ((7, 9), (4, 6)), ((10, 10), (1, 1)), ((10, 10), (2, 3)), ((10, 10), (4, 6))]
    with pytest.raises(ValueError, match="other blocks"):
        Manifest(spark, str(tmp_path / "m"), blocks[1:], "continue")
    with pytest.raises(ValueError, match="mode"):
        Manifest(spark, str(tmp_path / "m"), blocks, "append")


def test_grid(spark):
    c = Cube.from_nested(spark, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], ["i", "j"])
    rows = [(r.i, r.j) for r in c.grid().collect()]
    assert sorted(rows) == [(i, j) for i in (1, 2, 3) for j in (1, 2)]
    holes = Cube(c.df.where("value <> 4"), c.dims, c.values, c.shape, c.origin).densify().collect()
    assert holes[2, 2] is None and len(holes) == 6
    assert finite(F.lit(1)) is not None


def test_own_statistics_fold_many_groups_a_batch(spark):
    """Groups that begin, go on and end anywhere in a batch, and keys that are null, NaN or beyond a double's integers."""
    n = 700
    rows = spark.range(n).select(
        F.when(F.col("id") % 7 != 3, F.floor(F.col("id") % 40 / 4) + (1 << 60)).alias("k"), F.when(F.col("id") % 5 > 0, F.lit(float("nan"))).alias("z"),
        F.when(F.col("id") % 11 > 0, F.col("id").cast("double")).alias("value"),
    ).repartition(5)
    want = {}
    for i in range(n):
        want.setdefault(((i % 40) // 4 + (1 << 60) if i % 7 != 3 else None, i % 5 > 0), []).append(i if i % 11 else None)
    total = Mergeable(lambda: (0, 0.0), lambda a, x: (a[0] + 1, a[1] + x), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a: a[1])
    strict = Mergeable(lambda: 0.0, lambda a, x: a + x, lambda a, b: a + b, lambda a: a, skipmissing=False, fit_many=lambda a, x: a + float(x.sum()))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3", "64", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {(r.k, r.z is not None): r.value for r in total.aggregate(rows, ["k", "z"], "value").collect()}
            assert got == {k: sum(x for x in v if x is not None) for k, v in want.items()}
            got = {(r.k, r.z is not None): r.value for r in strict.aggregate(rows, ["k", "z"], "value").collect()}
            assert got == {k: None if None in v else sum(v) for k, v in want.items()}
            assert [r.value for r in total.aggregate(rows, [], "value").collect()] == [sum(i for i in range(n) if i % 11)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert total.aggregate(rows.where("k < 0"), ["k"], "value").collect() == []
    assert "FlatMapGroupsInPandas" not in inspect.nodes(total.aggregate(rows, ["k", "z"], "value"))


@pytest.mark.parametrize("ranges", [
    {"i": [(a, a + 6) for a in range(0, 300, 7)]},  # the last one is cut
    {"i": [(a, min(a + 9, 299)) for a in range(0, 300, 4)]},  # overlapping
    {"i": [(a, a + 2) for a in range(0, 300, 5)]},  # with gaps
    {"i": [(0, 3), (4, 50), (51, 51), (60, 299), (2, 8)]},  # listed, overlapping
    {"i": [(a, a + 39) for a in range(0, 300, 40)], "j": [(0, 0), (1, 1), (2, 2), (3, 3)]},
])
def test_blocks_in_batches(spark, tmp_path, ranges):
    """Many blocks in few jobs: each is what it is on its own, a batch that failed is made once more, the others aren't."""
    c = Cube(spark.range(1200).select((F.col("id") % 300).alias("i"), F.floor(F.col("id") / 300).alias("j"), (F.col("id") * 1.5).alias("value")), ("i", "j"), ("value",), {"i": 300, "j": 4}, {"i": 0, "j": 0})
    blocks, path, made = blocks_of(list(ranges.values())), str(tmp_path / "run"), []

    def sums(part, fails):
        numbers = range(part.origin["block"], part.origin["block"] + part.shape["block"])
        if fails and len(blocks) // 2 in numbers:
            raise RuntimeError("stopped")
        made.append(numbers)
        return aggregate(part, "sum", {"i": None, "j": None}, keepdims=False).df

    with pytest.raises(RuntimeError, match="stopped"):
        run_blocks(c, lambda p: sums(p, True), ranges, path, parallel=1, batches=4)
    with pytest.raises(ValueError, match="batches"):
        run_blocks(c, lambda p: p.df, ranges, path, mode="continue")
    told = []
    out = run_blocks(c, lambda p: sums(p, False), ranges, path, mode="continue", batches=2, progress=lambda n, of: told.append((n, of)))
    assert len(made) <= 4 and sorted(n for m in made for n in m) == list(range(len(blocks)))
    assert told[-1] == (len(blocks), len(blocks))
    want = {}
    for n, b in enumerate(blocks):
        spans = dict(zip(ranges, b))
        (a, z), (p, q) = spans["i"], spans.get("j", (0, 3))
        want[n] = sum((i + 300 * j) * 1.5 for i in range(a, min(z, 299) + 1) for j in range(p, q + 1))
    assert {r.block: r.value for r in out.collect()} == want
    with pytest.raises(ValueError, match="column block"):
        run_blocks(c, lambda p: p.df.select("value"), ranges, str(tmp_path / "lost"), batches=4)


def test_block_functions_get_whole_blocks_in_order(spark):
    """Blocks that lie across batches, with null integers in some, and skipped ones: one call a block, its cells in order."""
    n = 203
    rows = spark.range(n).select(F.col("id").alias("i"), F.when((F.col("id") % 9 > 0) & (F.floor(F.col("id") / 5) % 3 > 0), F.col("id") + (1 << 60)).alias("value")).repartition(6)
    c = Cube(rows, ("i",), ("value",), {}, {"i": 0})

    def running(pdf):
        present = pdf["value"].dropna()
        whole = str(pdf["value"].dtype) == "int64" and int(pdf["value"].iloc[-1]) == int(pdf["i"].iloc[-1]) + (1 << 60)
        return pdf.assign(first=pdf["i"].iloc[0], place=pdf.index, n=len(present), whole=whole)[["i", "first", "place", "n", "whole"]]

    kinds = {"first": "long", "place": "int", "n": "int", "whole": "boolean"}
    f = create_function(running, kinds, is_blockfunction=True, filters=[maps.all_missing])
    values = [i if i % 9 and i // 5 % 3 else None for i in range(n)]
    want = {}
    for i in range(n):
        block = [values[j] for j in range(i // 5 * 5, min(i // 5 * 5 + 5, n))]
        present = [x for x in block if x is not None]
        want[i] = (i // 5 * 5, i % 5, len(present), len(present) == len(block)) if present else (None,) * 4
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("2", "5", "48", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            out = f.on_blocks(c, {"i": 5})
            got = out.collect()
            assert len(got) == n and {r.i: (r["first"], r.place, r.n, r.whole) for r in got} == want
            both = create_function(lambda pdf, block: pdf.assign(first=pdf["i"].groupby(block).transform("min"), n=pdf["value"].groupby(block).transform("count"), high=pdf["value"].groupby(block).transform("max"))[["i", "first", "n", "high"]], {"first": "long", "n": "int", "high": "long"}, is_blockfunction=True, filters=[maps.all_missing], together=True)
            got = both.on_blocks(c, {"i": 5}).collect()
            assert len(got) == n and {r.i: (r["first"], r.n) for r in got} == {i: (w[0], w[2]) for i, w in want.items()}
            assert all(r.high == (max(j for j in range(r["first"], min(r["first"] + 5, n)) if values[j] is not None) + (1 << 60) if r.n else None) for r in got)
            one = create_function(running, kinds, is_blockfunction=True).on_blocks(c, {"i": None}).collect()
            assert sorted((r.i, r["first"], r.place) for r in one) == [(i, 0, i) for i in range(n)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert "FlatMapGroupsInPandas" not in inspect.nodes(out)


def test_filtered_fold_of_many_small_groups(spark):
    """Few calls for many groups, and each group as the filter and the start value have it."""
    n = 7000
    rows = spark.range(n).select(F.col("id").alias("i"), F.floor(F.col("id") / 7).alias("k"), F.when(F.col("id") * F.col("id") % 11 > 3, F.col("id").cast("double")).alias("value")).repartition(3)
    f = create_function(lambda x: x, "double", red=lambda a, b: a + b, init=5.0, filters=[maps.n_valid(2)])
    out = f.reduce(Cube(rows, ("i", "k"), ("value",)), ["i"])
    want = {}
    for k in range(n // 7):
        present = [i for i in range(7 * k, 7 * k + 7) if i * i % 11 > 3]
        want[k] = sum(present) + 5 if len(present) > 2 else None
    assert {r.k: r.value for r in out.collect()} == want
    assert "FlatMapGroupsInPandas" not in inspect.nodes(out)
