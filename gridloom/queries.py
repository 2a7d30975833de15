"""The registered queries of the cube operators, each with the SQL that it equals."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cube import Cube
from .functions.stats import Mergeable, derived, has_mergeable, stat
from .functions.userfunc import create_function
from .operators import aggregate as A
from .operators import maps, moving
from .operators.resample import Axis, interpolate, pyramid
from .operators.windowed import InputArray, OutWindows, windowed_op
from .operators.windows import Formula, InTable, Points, Ranges, Regular, Repeated, Sliding, Tumbling, breaks, groups, traits
from .plans import inspect
from .sources.layout import copy_to, rechunk, run_blocks, write_cube
from .sources.scan import open_cube

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- cubes on the tables ---------------------------------------------------------------


def events(spark: SparkSession, d: str) -> Cube:
    return open_cube(spark, f"{d}/events.parquet", {"i": "event_id"}, ["value"])


def embeddings(spark: SparkSession, d: str) -> Cube:
    return Cube.from_arrays(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", "d", "x")


def sales(spark: SparkSession, d: str, flag: str | None = None) -> Cube:
    """Supplier by month (1 is January 1992)."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = rows.where(F.col("l_returnflag") == flag) if flag else rows
    month = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")).cast("long")
    sums = rows.groupBy(F.col("l_suppkey").alias("s"), month.alias("m")).agg(F.sum("l_extendedprice").alias("v"))
    return Cube.from_table(sums, ["s", "m"], ["v"], origin={"m": 1})


def parts(spark: SparkSession, d: str) -> Cube:
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("long").alias("p_size"))
    return Cube.from_table(rows, {"i": "p_partkey"}, ["p_size"])


def _rounded(df: DataFrame, *names: str, digits: int = 6, **kinds: str) -> DataFrame:
    """Result columns in the types that both engines agree on."""
    out = {n: F.round(F.col(n), digits) for n in names} | {n: F.col(n).cast(t) for n, t in kinds.items()}
    return df.withColumns(out)


def _holes(c: Cube) -> Cube:
    """Every seventh value missing."""
    return maps.map_cells(Cube(c.df.select("i", F.col("i").alias("k"), "value"), ("i",), ("k", "value"), c.shape, c.origin), lambda k, v: F.when(k % 7 != 0, v))


EMB = "e as (select vec_id, i - 1 as d, embedding[i]::double as x from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings))"
SM = "(select l_suppkey as s, (year(l_shipdate) - 1992) * 12 + month(l_shipdate) as m, sum(l_extendedprice) as v from lineitem {} group by all)"
HOLES = "h as (select event_id as i, case when event_id % 7 <> 0 then value end as value from events)"


# -- maps ------------------------------------------------------------------------------


@_query(f"with {EMB} select vec_id, d, round(x - avg(x) over (partition by d), 6) as value from e")
def map_diff_broadcast(spark, d):
    c = embeddings(spark, d)
    out = maps.broadcast(lambda x, m: x - m, c, A.mean(c, ["vec_id"]))
    return _rounded(out.df, "value")


@_query("select event_id as i, round(value * 1.8 + 32, 6) as value from events")
def map_affine(spark, d):
    return _rounded(maps.map_cells(events(spark, d), lambda v: v * 1.8 + 32).df, "value")


@_query("select event_id as i, round(value + 1, 6) as up, round(value - 1, 6) as down from events")
def map_multi_output(spark, d):
    return _rounded(maps.map_cells(events(spark, d), {"up": lambda v: v + 1, "down": lambda v: v - 1}).df, "up", "down")


@_query(f"select s, m, round(a.v - b.v, 4) as value from {SM.format("where l_returnflag = 'A'")} a join {SM.format("where l_returnflag = 'R'")} b using (s, m)")
def map_align_two(spark, d):
    out = maps.broadcast(lambda a, b: a - b, sales(spark, d, "A"), sales(spark, d, "R"))
    return _rounded(out.df, "value", digits=4)


@_query("select event_id as i, round(value * 2.5 - 4, 6) as value from events")
def scalar_bound_args(spark, d):
    return _rounded(maps.map_cells(events(spark, d), lambda v, a, b: v * a + b, 2.5, b=-4).df, "value")


@_query("select event_id as i, round(value + 10, 6) as value from events")
def map_constant_input(spark, d):
    return _rounded(maps.broadcast(lambda a, b: a + b, events(spark, d), Cube.constant(spark, 10)).df, "value")


@_query(f"with {EMB}, m as (select d, max(x) as top from e group by d) select vec_id, d, round(x / top, 6) as value from e join m using (d)")
def map_size_one_stretch(spark, d):
    c = embeddings(spark, d).measured()
    top = A.maximum(c, ["vec_id"], keepdims=True)
    return _rounded(maps.broadcast(lambda x, m: x / m, c, top).df, "value")


@_query(f"with {EMB} select vec_id, g, round(a.x * b.x, 6) as value from (select vec_id, sum(x) as x from e group by 1) a join (select d as g, avg(x) as x from e group by 1) b on true")
def map_new_dimension(spark, d):
    c = embeddings(spark, d)
    return _rounded(maps.broadcast(lambda a, b: a * b, A.total(c, ["d"]), A.mean(c, ["vec_id"]).rename(d="g")).df, "value")


@_query("select event_id as i, value from events where event_id between 100 and 199")
def subset_range(spark, d):
    return events(spark, d).subset(i=(100, 199)).df


@_query("select event_id as i, value from events where event_id % 2 = 0 and event_id % 3 = 0")
def mask_cells(spark, d):
    c = events(spark, d)
    mask = maps.map_cells(Cube(c.df.select("i", F.col("i").alias("k")), ("i",), ("k",)), lambda k: (k % 2 == 0) & (k % 3 == 0))
    return maps.masked(c, mask).df


# -- reductions ------------------------------------------------------------------------


@_query(f"with {EMB} select d, round(sum(x), 6) as x from e group by d")
def reduce_sum_dim1(spark, d):
    return _rounded(A.total(embeddings(spark, d), ["vec_id"]).df, "x")


@_query(f"with {EMB} select vec_id, round(sum(x), 6) as x from e group by vec_id")
def reduce_sum_dim2(spark, d):
    return _rounded(A.total(embeddings(spark, d), ["d"]).df, "x")


@_query(f"with {EMB} select round(sum(x), 6) as x from e")
def reduce_sum_all(spark, d):
    return _rounded(A.total(embeddings(spark, d)).df, "x")


@_query(f"with {EMB} select vec_id, 1::bigint as d, round(sum(x), 6) as x from e group by vec_id")
def reduce_keepdims(spark, d):
    return _rounded(A.total(embeddings(spark, d), ["d"], keepdims=True).df, "x")


@_query(f"with {EMB} select d, round(1 + sum(x * x), 6) as value from e group by d")
def mapreduce_squares(spark, d):
    return _rounded(A.mapreduce(lambda x: x * x, "+", embeddings(spark, d), dims=["vec_id"], init=1.0).df, "value")


@_query(f"with {EMB} select vec_id, round(sum(e.x * m.x), 6) as value from e join (select d, avg(x) as x from e group by d) m using (d) group by vec_id")
def mapreduce_two_inputs(spark, d):
    c = embeddings(spark, d)
    return _rounded(A.mapreduce(lambda a, b: a * b, "+", c, A.mean(c, ["vec_id"]), dims=["d"]).df, "value")


@_query(f"with {EMB} select vec_id, round(min(x), 6) as low, round(max(x), 6) as high from e group by vec_id")
def reduce_minmax(spark, d):
    c = embeddings(spark, d)
    low, high = A.minimum(c, ["d"]).df.withColumnRenamed("x", "low"), A.maximum(c, ["d"]).df.withColumnRenamed("x", "high")
    return _rounded(low.join(high, "vec_id"), "low", "high")


@_query(f"with {EMB} select vec_id, round(min(x), 6) as x_min, round(max(x), 6) as x_max from e group by vec_id")
def reduce_extrema(spark, d):
    return _rounded(A.extrema(embeddings(spark, d), ["d"]).df, "x_min", "x_max")


@_query(f"with {EMB} select vec_id, round(median(x), 6) as x from e group by vec_id")
def slice_median(spark, d):
    return _rounded(A.median(embeddings(spark, d), ["d"]).df, "x")


@_query(f"with {EMB} select vec_id, round(avg(x), 6) as x from e group by vec_id")
def slice_mean(spark, d):
    return _rounded(A.mean(embeddings(spark, d), ["d"]).df, "x")


@_query(f"with {EMB} select vec_id, round(max(x) filter (d = 63) - max(x) filter (d = 0), 6) as value from e group by vec_id")
def slice_function(spark, d):
    out = A.mapslices(lambda x: F.element_at(x, -1) - F.element_at(x, 1), embeddings(spark, d), dims=["d"])
    return _rounded(out.df, "value")


@_query("select round(sum(value), 4) as value from events where event_id % 7 <> 0")
def reduce_sum_skipmissing(spark, d):
    return _rounded(A.total(_holes(events(spark, d)), skipmissing=True).df, "value", digits=4)


# -- group-by over windows -------------------------------------------------------------


@_query("select event_id // 100 + 1 as i, round(avg(value), 6) as value from events group by 1")
def agg_tumbling_100(spark, d):
    return _rounded(A.aggregate(events(spark, d), "mean", {"i": 100}).df, "value")


@_query("select event_id // 300 + 1 as i, round(sum(value), 4) as value, count(*) as n from events group by 1")
def agg_tumbling_partial_tail(spark, d):
    return _rounded(A.aggregate(events(spark, d), {"value": "sum", "n": "nvalid"}, {"i": 300}).df, "value", digits=4)


@_query(f"with {EMB} select vec_id // 50 + 1 as vec_id, d // 8 + 1 as d, round(avg(x), 6) as x from e group by 1, 2")
def agg_tumbling_2d(spark, d):
    return _rounded(A.aggregate(embeddings(spark, d), "mean", {"vec_id": 50, "d": 8}).df, "x")


@_query(f"with {EMB} select 1::bigint as vec_id, d // 8 + 1 as d, round(avg(x), 6) as x from e group by 2")
def agg_whole_and_block(spark, d):
    return _rounded(A.aggregate(embeddings(spark, d), "mean", {"vec_id": None, "d": 8}).df, "x")


@_query("with g as (select date_trunc('day', ts) as day, min(event_id) as f, avg(value) as v from events group by 1) select dense_rank() over (order by f)::bigint as grp, round(v, 6) as value from g")
def agg_labels_day(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("i"), "value", F.date_trunc("day", "ts").alias("day"))
    c = Cube(rows, ("i",), ("value",))
    days = A.aggregate(c, "mean", {"i": "day"}).df
    return _rounded(days.join(A.label_index(c, "i", "day"), "day").select(F.col("index").alias("grp"), "value"), "value")


@_query("select event_id // 1000 + 1 as i, round(avg(value), 6) as value from events group by 1")
def agg_label_vector(spark, d):
    label = F.concat(F.lit("run "), F.floor(F.col("i") / 1000).cast("string"))
    return _rounded(A.aggregate(events(spark, d), "mean", {"i": label}).df, "value")


@_query("select event_id % 3 + 1 as i, round(avg(value), 6) as value from events group by 1")
def agg_label_cyclic(spark, d):
    c = events(spark, d)
    labels = c.df.select("i", F.element_at(F.array(*map(F.lit, "xyz")), (F.col("i") % 3 + 1).cast("int")).alias("label"))
    return _rounded(A.aggregate(c, "mean", {"i": labels}, cyclic=True).df, "value")


@_query(f"with {HOLES} select i // 7 + 1 as i, round(avg(value), 6) as value from h group by 1")
def agg_reduce_skipmissing(spark, d):
    return _rounded(A.aggregate(_holes(events(spark, d)), "mean", {"i": 7}, skipmissing=True).df, "value")


@_query(f"with {HOLES} select i // 5 + 1 as i, case when count(*) = count(value) then round(sum(value), 6) end as value from h group by 1")
def agg_strict_missing(spark, d):
    return _rounded(A.aggregate(_holes(events(spark, d)), "sum", {"i": 5}).df, "value")


@_query("with h as (select event_id as i, case event_id % 11 when 0 then 'nan'::double when 1 then 'inf'::double else value end as value from events) select i // 50 + 1 as i, round(avg(value), 6) as value from h where isfinite(value) group by 1")
def agg_skip_nonfinite(spark, d):
    rows = events(spark, d).df.withColumn("value", F.when(F.col("i") % 11 == 0, F.lit(float("nan"))).when(F.col("i") % 11 == 1, F.lit(float("inf"))).otherwise(F.col("value")))
    return _rounded(A.aggregate(Cube(rows, ("i",), ("value",)), "mean", {"i": 50}, skipmissing=True).df, "value")


@_query("select event_id // 500 + 1 as i, count(*) as n, true as within from events group by 1")
def agg_median_approx(spark, d):
    """``within``: the rank of each block's approximate median is at most a 200th of the block off the middle."""
    c = events(spark, d)
    got = A.aggregate(c, "median_approx", {"i": 500}, skipmissing=True).df.withColumnRenamed("value", "m")
    cells = c.df.select((F.floor(F.col("i") / 500) + 1).alias("i"), "value").join(got, "i")
    ranks = cells.groupBy("i").agg(F.count("value").alias("n"), F.sum((F.col("value") < F.col("m")).cast("long")).alias("below"), F.sum((F.col("value") <= F.col("m")).cast("long")).alias("upto"))
    return ranks.select("i", "n", F.expr("below <= n / 2 + n / 200 and upto >= n / 2 - n / 200").alias("within"))


@_query("select event_id // 250 + 1 as i, round(median(value), 6) as value from events group by 1")
def agg_median_exact(spark, d):
    return _rounded(A.aggregate(events(spark, d), "median", {"i": 250}).df, "value")


@_query(f"select m, round(avg(v), 4) as v from {SM.format('')} group by m")
def agg_sparse_kept_dim(spark, d):
    return _rounded(A.mean(sales(spark, d), ["s"], skipmissing=True).df, "v", digits=4)


@_query(f"with t as {SM.format('')} select round(avg(a), 4) as value from (select s, avg(v) as a from t group by s)")
def agg_two_level_mean(spark, d):
    inner = A.mean(sales(spark, d), ["m"], skipmissing=True)
    return _rounded(A.mean(inner, skipmissing=True).df.withColumnRenamed("v", "value"), "value", digits=4)


@_query("select event_id // 100 + 1 as i, round(sqrt(avg(value)), 6) as value from events group by 1")
def agg_derived_statistic(spark, d):
    return _rounded(A.aggregate(events(spark, d), derived("mean", F.sqrt), {"i": 100}).df, "value")


@_query("select event_id // 1000 + 1 as i, round(sum(value * value), 4) as value from events group by 1")
def udaf_grouped(spark, d):
    squares = Mergeable(lambda: 0.0, lambda a, x: a + x * x, lambda a, b: a + b, lambda a: a, fit_many=lambda a, x: a + float(x @ x))
    return _rounded(A.aggregate(events(spark, d), squares, {"i": 1000}).df, "value", digits=4)


@_query("select event_type as zone, round(avg(value), 6) as value from events group by 1")
def zonal_mean(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("i"), "value", "event_type")
    return _rounded(A.zonal(Cube(rows, ("i",), ("value",)), "event_type", "mean"), "value")


@_query(f"with {EMB} select label::bigint as zone, round(avg(x), 6) as x from e join embeddings using (vec_id) group by 1")
def zonal_join(spark, d):
    labels = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("label").cast("long").alias("label"))
    return _rounded(A.zonal(embeddings(spark, d), Cube.from_table(labels, ["vec_id"], ["label"]), "mean"), "x")


@_query(f"with {EMB} select label % 3 + 1 as zone, round(sum(abs(x)), 4) as x from (select vec_id, label::bigint as label from embeddings) join e using (vec_id) group by 1")
def zonal_converted(spark, d):
    labels = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("label").cast("long").alias("label"))
    s = stat("sum", preproc=F.abs, groupconv=lambda z: z % 3 + 1)
    return _rounded(A.zonal(embeddings(spark, d), Cube.from_table(labels, ["vec_id"], ["label"]), s), "x", digits=4)


@_query("select p_size::bigint as p_size, count(*) as n from part group by 1")
def countmap_values(spark, d):
    return A.count_map(parts(spark, d))


@_query("select r.i as p_size, count(p_size)::bigint as n from range(256) r(i) left join part on p_size = r.i group by 1")
def countmap_dense(spark, d):
    return A.count_map(parts(spark, d), dense=256)


@_query("select p_partkey // 200 + 1 as i, p_size::bigint as p_size, count(*) as n from part group by 1, 2")
def countmap_windows(spark, d):
    c = parts(spark, d)
    rows = c.df.select((F.floor(F.col("i") / 200) + 1).alias("i"), "p_size")
    return A.count_map(Cube(rows, ("i",), ("p_size",)), ["i"])


@_query("select i, p_size from (select p_partkey // 100 + 1 as i, p_size::bigint as p_size, row_number() over (partition by p_partkey // 100 order by count(*) desc, p_size) as r from part group by p_partkey // 100, p_size) where r = 1")
def mode_blocks(spark, d):
    return A.aggregate(parts(spark, d), "mode", {"i": 100}).df


# -- windows ---------------------------------------------------------------------------


@_query("with w as (select event_id as i, avg(value) over o as v, count(*) over o as n from events window o as (order by event_id rows between current row and 6 following)) select i, round(v, 6) as value from w where n = 7")
def win_sliding_step1(spark, d):
    return _rounded(moving.rolling(events(spark, d), "i", 0, 6, F.avg, full_only=True).df, "value")


@_query("select k::bigint as i, round(sum(value), 6) as value from (select unnest(range(1, count(*) // 10 + 1)) as k from events) join events on event_id // 10 between k - 1 and k group by 1")
def win_hopping(spark, d):
    c = events(spark, d).measured()
    return _rounded(moving.windowed(c, "sum", {"i": Sliding(0, 10, 20, c.shape["i"] // 10)}).df, "value")


@_query("select (n - 1 - event_id) // 5 + 1 as i, round(sum(value), 6) as value from events, (select count(*) as n from events) where (n - 1 - event_id) % 5 <= 1 and (n - 1 - event_id) // 5 < n // 5 group by 1")
def win_reverse(spark, d):
    c = events(spark, d).measured()
    n = c.shape["i"]
    return _rounded(moving.windowed(c, "sum", {"i": Sliding(n - 2, -5, 2, n // 5)}).df, "value")


@_query("with n as (select count(*) as n from events) select k::bigint as i, round(sum(value), 6) as value from (select event_id, value, n, unnest([(event_id + 3) // 4 - 2, (event_id + 3) // 4 - 1, (event_id + 3) // 4]) + 1 as k from events, n) where event_id between 10 and n - 11 and event_id - ((k - 1) * 4 - 3) between 0 and 8 and k between 1 and n // 4 group by 1")
def win_clamped(spark, d):
    c = events(spark, d).measured()
    n = c.shape["i"]
    return _rounded(moving.windowed(c, "sum", {"i": Sliding(-3, 4, 9, n // 4, clamp=(10, n - 11))}).df, "value")


@_query("select event_id as i, round(avg(value) over (order by event_id rows between 3 preceding and 3 following), 6) as value from events")
def win_centered_mean_1d(spark, d):
    return _rounded(moving.rolling(events(spark, d), "i", 3, 3, F.avg).df, "value")


@_query("select event_id as i, round(median(value) over (order by event_id rows between 3 preceding and 3 following), 6) as value from events")
def win_centered_median_1d(spark, d):
    return _rounded(moving.neighbourhood(events(spark, d), {"i": 3}, "median").df, "value")


@_query(f"with {EMB}, w as (select vec_id + a as vec_id, d + b as d, x from e, range(-1, 2) r(a), range(-1, 2) q(b)) select vec_id, d, round(median(x), 6) as x from w where vec_id between 0 and (select max(vec_id) from embeddings) and d between 0 and 63 group by 1, 2")
def win_centered_2d_median(spark, d):
    return _rounded(moving.neighbourhood(embeddings(spark, d), {"vec_id": 1, "d": 1}, "median").df, "x")


@_query("with w as (select unnest(range(1, round(sqrt(count(*)))::bigint)) as k from events) select k::bigint as i, round(avg(value), 6) as value from w join events on event_id between (k - 1) * (k - 1) and k * k + k group by 1")
def win_irregular(spark, d):
    c = events(spark, d).measured()
    w = Ranges([((k - 1) ** 2, k * k + k) for k in range(1, round(c.shape["i"] ** 0.5))])
    return _rounded(moving.windowed(c, "mean", {"i": w}).df, "value")


@_query("with w as (select unnest(range(1, ceil(n / 2.5)::bigint + 1)) as k, n from (select count(*) as n from events)), m as (select k, unnest(range(floor((k - 1) * 2.5)::bigint, least(floor((k - 1) * 2.5)::bigint + 2, n - 1) + 1)) as event_id from w) select k::bigint as i, round(sum(value), 6) as value from m join events using (event_id) group by 1")
def win_regular_fractional(spark, d):
    c = events(spark, d).measured()
    return _rounded(moving.windowed(c, "sum", {"i": Regular(0, c.shape["i"] - 1, 3, 2.5)}).df, "value")


@_query("select event_id // 3 + 1 as fwd, (count(*) over () - event_id // 3)::bigint as rev, round(value, 6) as value from events where event_id % 3 = 0")
def win_strided_reverse_points(spark, d):
    c = events(spark, d).measured()
    n = -(-c.shape["i"] // 3)
    fwd = Points(0, n, 3).assign(c.df, "i", "fwd")
    return _rounded(Points(3 * (n - 1), n, -3).assign(fwd, "i", "rev").select("fwd", "rev", "value"), "value")


#: A window for each customer: one to five indices, in no order.
CUSTOMER_WINDOWS = "w as (select c_custkey as step, (c_custkey * 37) % 1000 as lo, (c_custkey * 37) % 1000 + c_custkey % 5 as hi from customer)"


def customer_windows(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("long")
    lo = key * 37 % 1000
    return spark.read.parquet(f"{d}/customer.parquet").select(key.alias("step"), lo.alias("lo"), (lo + key % 5).alias("hi"))


@_query(f"""with {CUSTOMER_WINDOWS}, u as (select distinct lo, hi from w), x as (select i, count(*) as c from (select unnest(range(lo, hi + 1)) as i from u) group by i),
o as (select step, lo, hi, lead(lo) over s as l, lead(hi) over s as h from w window s as (order by step))
select (select count(*) from w) as n, (select min(lo) from w) as lo, (select max(hi) from w) as hi,
case when (select bool_and(l >= lo and h >= hi) from o where l is not null) then 'increasing' when (select bool_and(l <= lo and h <= hi) from o where l is not null) then 'decreasing' else 'unordered' end as ordering,
(select count(*) from w) - (select count(*) from u) as repeats, (select max(c) > 1 from x) as overlapping, (select count(*) from x) / ((select max(hi) from w) - (select min(lo) from w) + 1) as covered,
(select count(*) from u a join u b on b.lo >= a.lo and b.hi <= a.hi and (a.lo <> b.lo or a.hi <> b.hi)) as nested""")
def win_traits(spark, d):
    return traits(customer_windows(spark, d))


@_query(f"with {CUSTOMER_WINDOWS} select step as i, round(sum(value), 6) as value from w join events on event_id between lo and hi group by 1")
def win_unordered_table(spark, d):
    w = customer_windows(spark, d)
    return _rounded(moving.windowed(events(spark, d), "sum", {"i": InTable(w, w.count())}).df, "value")


@_query("select event_id as step, event_id // 12 * 12 + 11 as at, event_id // 12 + 1 as grp from events where event_id // 12 * 12 + 11 < (select count(*) from events)")
def win_breaks(spark, d):
    """Indices where windows of three, of four and of six end together, and the points up to each."""
    n = events(spark, d).measured().shape["i"] // 12 * 12
    tables = [Tumbling(0, k, n // k).table(spark) for k in (3, 4, 6)]
    at = sorted(r["at"] for r in breaks(*tables).collect())
    return groups(Points(0, n).table(spark), at).select((F.col("step") - 1).alias("step"), (F.col("grp") * 12 - 1).alias("at"), "grp")


@_query("select 1::bigint as i, round(sum(value), 4) as value from events")
def win_repeated_output(spark, d):
    c = events(spark, d).measured()
    return _rounded(windowed_op([InputArray(c)], lambda v: v, OutWindows({"i": Repeated(1, c.shape["i"])}), red="sum").df, "value", digits=4)


@_query("select (event_id // 3) + 1 as i, round(max(value), 6) as value from events group by 1")
def win_output_groups(spark, d):
    c = events(spark, d).measured()
    out = Formula(c.shape["i"], lambda k: F.floor((k - 1) / 3) + 1)
    return _rounded(windowed_op([InputArray(c)], lambda v: v, OutWindows({"i": out}), red="maximum").df, "value")


@_query("select j as i, count(*) as n, round(sum(value), 6) as value from (select value, unnest([event_id // 5 + 1, event_id // 5 + 2]) as j from events) group by 1")
def win_output_overlapping(spark, d):
    """Output windows of two cells, each one further every five steps: what is folded, and how often a cell is written."""
    c = events(spark, d).measured()
    out = OutWindows({"i": Formula(c.shape["i"], lambda k: F.floor((k - 1) / 5) + 1, lambda k: F.floor((k - 1) / 5) + 2)})
    total, n = (windowed_op([InputArray(c)], lambda v: v, out, red=r).df for r in ("sum", "nvalid"))
    return _rounded(total.join(n.withColumnRenamed("value", "n"), "i"), "value", n="long")


@_query("select event_id // 100 as step, event_id // 100 * 100 as lo, event_id // 100 * 100 + 99 as hi, min(event_id) as first_i, max(event_id) as last_i from events group by 1, 2, 3")
def win_lookup(spark, d):
    """The windows that hold any event, with the first and last index that is looked up in each."""
    c = events(spark, d).measured()
    w = Tumbling(0, 100, -(-c.shape["i"] // 100))
    held = w.assign(c.df, "i", "step").groupBy("step").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"))
    return w.table(spark).join(held, "step").select((F.col("step") - 1).alias("step"), "lo", "hi", "first_i", "last_i")


@_query("with a as (select event_id // 5 as k, sum(value) as s from events group by 1) select k + 1 as i, round(s * value, 6) as value from a join events on event_id = k * 5")
def op_two_windows(spark, d):
    c = events(spark, d).measured()
    n = c.shape["i"] // 5
    inputs = [InputArray(c, {"i": Tumbling(0, 5, n)}), InputArray(c, {"i": Points(0, n, 5)})]
    return _rounded(windowed_op(inputs, lambda w, v: F.aggregate(w, F.lit(0.0), lambda a, x: a + x) * v).df, "value")


@_query(f"with {EMB} select vec_id + 1 as vec_id, d + 1 as d, round(e.x * m, 6) as value from e join (select d, avg(x) as m from e group by d) using (d)")
def op_lower_dimension(spark, d):
    c = embeddings(spark, d)
    return _rounded(windowed_op([InputArray(c), InputArray(A.mean(c, ["vec_id"]))], lambda a, b: a * b).df, "value")


# -- filters ---------------------------------------------------------------------------

GAPS = "h as (select event_id as i, case when event_id // 7 % 5 = 0 or event_id * event_id % 11 < 4 then null when event_id // 7 % 3 = 0 then 1 else value end as value from events)"
_FILTER_SQL = f"with {GAPS} select i // 7 + 1 as i, case when {{}} then round(sum(value), 6) end as value from h group by 1"


def _filter_query(spark, d, *filters):
    """Steps of seven indices, some with a few values, with none, or with equal ones."""
    i, step = F.col("i"), F.floor(F.col("i") / 7)
    gap = (step % 5 == 0) | (i * i % 11 < 4)
    rows = events(spark, d).df.select((step + 1).alias("i"), F.when(~gap, F.when(step % 3 == 0, 1.0).otherwise(F.col("value"))).alias("value"))
    return _rounded(rows.groupBy("i").agg(maps.filtered(F.sum, *filters)(F.col("value")).alias("value")), "value")


@_query(_FILTER_SQL.format("count(value) > 2"))
def filter_nvalid(spark, d):
    return _filter_query(spark, d, maps.n_valid(2))


@_query(_FILTER_SQL.format("count(value) > 0"))
def filter_allmissing(spark, d):
    return _filter_query(spark, d, maps.all_missing)


@_query(_FILTER_SQL.format("count(value) = count(*)"))
def filter_anymissing(spark, d):
    return _filter_query(spark, d, maps.any_missing)


@_query(_FILTER_SQL.format("coalesce(min(value) <> max(value), true)"))
def filter_stdzero(spark, d):
    return _filter_query(spark, d, maps.std_zero)


@_query(_FILTER_SQL.format("count(value) > 0 and not sum(value) > 200"))
def filter_user_composed(spark, d):
    return _filter_query(spark, d, maps.all_missing, maps.user_filter(lambda x: F.coalesce(F.sum(x) > 200, F.lit(False))), maps.no_filter)


# -- resampling ------------------------------------------------------------------------


@_query("with n as (select count(*) as n from events), t as (select k, least(k * 0.5, n - 1) as p from (select unnest(range(0, 2 * n)) as k, n from n)) select k::bigint as i, round(a.value * (1 - (p - floor(p))) + case when p > floor(p) then b.value * (p - floor(p)) else 0 end, 6) as value from t join events a on a.event_id = floor(p)::bigint left join events b on b.event_id = floor(p)::bigint + 1")
def interp_linear_uniform(spark, d):
    c = events(spark, d).measured()
    n = c.shape["i"]
    return _rounded(interpolate(c, {"i": (Axis.uniform(0, 1, n), Axis.uniform(0, 0.5, 2 * n))}).df, "value")


@_query("""with o as (select date_diff('day', date '1992-01-01', o_orderdate::date) as x, sum(o_totalprice) as v from orders group by 1),
a as (select x, v, lead(x) over (order by x) as nx, lead(v) over (order by x) as nv, min(x) over () as lo, max(x) over () as hi, first(v) over (order by x) as fv from o),
t as (select k, -20 + k * 7 as x from range(0, 360) r(k))
select t.k::bigint as day, round(case when t.x < a.lo then a.fv when a.nx is null then a.v else a.v + (a.nv - a.v) * (t.x - a.x) / (a.nx - a.x) end, 4) as v
from t join a on (t.x >= a.x and (t.x < a.nx or a.nx is null)) or (t.x < a.lo and a.x = a.lo)""")
def interp_linear_irregular(spark, d):
    c, axis = order_days(spark, d)
    return _rounded(interpolate(c, {"day": (axis, Axis.uniform(-20, 7, 360))}).df, "v", digits=4)


def order_days(spark: SparkSession, d: str) -> tuple[Cube, Axis]:
    """Sales by day, and the axis of the days there are."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    sums = spark.read.parquet(f"{d}/orders.parquet").groupBy(day.alias("x")).agg(F.sum("o_totalprice").alias("v"))
    axis = Axis.in_table(sums, "x")
    places = A.label_index(Cube(sums, ("x",), ("v",)), "x", "x")
    return Cube(places.join(sums, "x").select((F.col("index") - 1).alias("day"), "v"), ("day",), ("v",), {"day": axis.n}), axis


@_query("""with o as (select date_diff('day', date '1992-01-01', o_orderdate::date) as x, sum(o_totalprice) as v from orders group by 1),
t as (select k, -20 + k * 7 as x from range(0, 360) r(k))
select t.k::bigint as day, round(coalesce((select v from o where o.x <= t.x order by o.x desc limit 1), (select v from o order by o.x limit 1)), 4) as v from t""")
def interp_previous_irregular(spark, d):
    c, axis = order_days(spark, d)
    return _rounded(interpolate(c, {"day": (axis, Axis.uniform(-20, 7, 360))}, method="previous").df, "v", digits=4)


@_query("select k::bigint as i, round(value, 6) as value from (select unnest(range(0, 2 * n)) as k, n from (select count(*) as n from events)) join events on event_id = ceil(least(k * 0.4::double, n - 1))::bigint")
def interp_next(spark, d):
    c = events(spark, d).measured()
    n = c.shape["i"]
    return _rounded(interpolate(c, {"i": (Axis.uniform(0, 1, n), Axis.uniform(0, 0.4, 2 * n))}, method="next").df, "value")


@_query(f"""with {EMB}, n as (select count(*) as n from embeddings), p as (select i, least(greatest(-1.0::double + i * 0.7::double, 0), n - 1) as a from (select unnest(range(0, round(n / 0.7)::bigint)) as i, n from n)), q as (select j, least(greatest(-0.5::double + j * 0.9::double, 0), 63) as b from range(0, 73) r(j)),
w as (select i, floor(a)::bigint + k as vec_id, case k when 0 then 1 - (a - floor(a)) else a - floor(a) end as u from p, range(0, 2) r(k)),
z as (select j, floor(b)::bigint + k as d, case k when 0 then 1 - (b - floor(b)) else b - floor(b) end as v from q, range(0, 2) r(k))
select i::bigint as vec_id, j::bigint as d, round(sum(u * v * x), 6) as x from e join w using (vec_id) join z using (d) where u > 0 and v > 0 group by 1, 2""")
def interp_2d(spark, d):
    c = embeddings(spark, d).measured()
    n = c.shape["vec_id"]
    conv = {"vec_id": (Axis.uniform(0, 1, n), Axis.uniform(-1, 0.7, round(n / 0.7))), "d": (Axis.uniform(0, 1, 64), Axis.uniform(-0.5, 0.9, 73))}
    return _rounded(interpolate(c, conv).df, "x")


@_query("select k::bigint as i, round(value, 6) as value from (select unnest(range(0, 3 * n)) as k, n from (select count(*) as n from events)) join events on event_id = floor(least(k * 0.3::double, n - 1) + 0.5)::bigint")
def interp_nearest(spark, d):
    c = events(spark, d).measured()
    n = c.shape["i"]
    return _rounded(interpolate(c, {"i": (Axis.uniform(0, 1, n), Axis.uniform(0, 0.3, 3 * n))}, method="nearest").df, "value")


@_query(f"with {EMB} select l::int as level, vec_id // 2 ** l::int + 1 as vec_id, d // 2 ** l::int + 1 as d, round(avg(x), 6) as x from (select l, vec_id, d, x from e, range(1, 4) r(l)) group by 1, 2, 3".replace("vec_id // 2 ** l::int", "vec_id // (1 << l::int)").replace("d // 2 ** l::int", "d // (1 << l::int)"))
def pyramid_mean(spark, d):
    return _rounded(pyramid(embeddings(spark, d), ["vec_id", "d"], 3), "x", level="int")


@_query("select l::int as level, i, p_size from (select l, p_partkey // (1 << l::int) + 1 as i, p_size::bigint as p_size, row_number() over (partition by l, p_partkey // (1 << l::int) order by count(*) desc, p_size) as r from part, range(1, 4) t(l) group by l, p_partkey // (1 << l::int), p_size) where r = 1")
def pyramid_mode(spark, d):
    return _rounded(pyramid(parts(spark, d), ["i"], 3, "mode"), level="int")


# -- stacked operations, user functions, layout -----------------------------------------


@_query("with a as (select event_id // 5 as k, sum(value) as v from events group by 1) select k // 2 + 1 as i, round(sum(v), 6) as value from a group by 1")
def stack_sum_sum(spark, d):
    inner = A.aggregate(events(spark, d), "sum", {"i": 5})
    return _rounded(A.aggregate(inner, "sum", {"i": 2}).df, "value")


@_query("with a as (select event_id // 24 as k, avg(value) + 273.15 as v from events group by 1), b as (select k // 10 as g, avg(v) as v from a group by 1) select k + 1 as i, round(a.v - b.v, 6) as value from a join b on a.k // 10 = b.g")
def stack_agg_map(spark, d):
    warm = maps.map_cells(A.aggregate(events(spark, d), "mean", {"i": 24}), lambda v: v + 273.15)
    coarse = A.aggregate(warm, "mean", {"i": 10})
    spread = Cube(warm.df.withColumn("g", F.floor((F.col("i") - 1) / 10) + 1), ("i",), ("value",))
    out = spread.df.join(coarse.df.select(F.col("i").alias("g"), F.col("value").alias("c")), "g").select("i", (F.col("value") - F.col("c")).alias("value"))
    return _rounded(out, "value")


@_query("with b as (select event_id as i, value, avg(value) over o as m, stddev_pop(value) over o as s from events window o as (partition by event_id // 500)) select i, round((value - m) / s, 6) as z from b")
def udf_block(spark, d):
    def standard(pdf):
        return pdf.assign(z=(pdf["value"] - pdf["value"].mean()) / pdf["value"].std(ddof=0))[["i", "z"]]

    f = create_function(standard, {"z": "double"}, is_blockfunction=True)
    return _rounded(f.on_blocks(events(spark, d), {"i": 500}), "z")


@_query("select event_id as i, round(value * value + 3, 6) as value from events")
def udf_scalar_pandas(spark, d):
    f = create_function(lambda v, k: v * v + k, "double", python=True, args=[3.0])
    return _rounded(f.on(events(spark, d)).df, "value")


@_query("select event_id as i, round(value + 1, 6) as a, round(value * 2, 6) as b from events")
def udf_expression_outputs(spark, d):
    f = create_function(lambda v: (v + 1, v * 2), {"a": "double", "b": "double"})
    return _rounded(f.on(events(spark, d)).df, "a", "b")


@_query(f"with {EMB} select vec_id, round(sum(x * x), 4) as x from e group by vec_id")
def udaf_fold(spark, d):
    f = create_function(lambda x: x * x, "double", red=lambda a, b: a + b, init=0.0)
    return _rounded(f.reduce(embeddings(spark, d), ["d"]), "x", digits=4)


@_query(f"with {EMB} select vec_id, d, round(x, 6) as x from e")
def rechunk_identity(spark, d):
    path = _scratch(spark, "rechunk")
    return _rounded(rechunk(embeddings(spark, d), {"vec_id": 128, "d": 16}, path).df, "x")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; where the session names none, one machine's own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        import tempfile

        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@_query(f"with t as {SM.format('')}, s as (select distinct s from t), lo as (select min(m) as a, max(m) as b from t) select s.s, r.m::bigint as m, round(v, 4) as v from s, lo, lateral (select unnest(range(1, b + 1)) as m) r left join t on t.s = s.s and t.m = r.m")
def densify_cube(spark, d):
    return _rounded(sales(spark, d).densify().df, "v", digits=4)


@_query("select event_id // 64 + 1 as i, histogram.n::bigint as n, round(lo, 6) as low from (select event_id // 64 as k, count(*) as n, min(value) as lo from events group by 1) histogram, lateral (select k * 64 as event_id)")
def multi_statistic(spark, d):
    return _rounded(A.aggregate(events(spark, d), {"n": "nvalid", "low": "minimum"}, {"i": 64}).df, "low", n="long")


# -- user functions with a start value and with filters ---------------------------------


@_query("select event_id // 100 as k, round(1000 + sum(value), 4) as value from events group by 1")
def udaf_init(spark, d):
    """A start value that isn't neutral enters each group once, on however many partitions its cells are."""
    c = events(spark, d)
    rows = Cube(c.df.select("i", F.floor(F.col("i") / 100).alias("k"), "value").repartition(7), ("i", "k"), ("value",))
    f = create_function(lambda x: x, "double", red=lambda a, b: a + b, init=1000.0)
    return _rounded(f.reduce(rows, ["i"]), "value", digits=4)


@_query("select event_id // 100 as k, round(sum(value) / count(value), 6) as value from events group by 1")
def udaf_pairs(spark, d):
    """Accumulators (count, sum) of another kind than the values, joined by ``merge``."""
    rows = Cube(events(spark, d).df.select("i", F.floor(F.col("i") / 100).alias("k"), "value").repartition(5), ("i", "k"), ("value",))
    f = create_function(lambda x: x, "double", red=lambda acc, x: (acc[0] + 1, acc[1] + x), init=(0, 0.0), merge=lambda a, b: (a[0] + b[0], a[1] + b[1]), finalize=lambda acc: acc[1] / acc[0])
    return _rounded(f.reduce(rows, ["i"]), "value")


@_query(f"with {GAPS} select i // 7 as k, case when count(value) > 2 then round(sum(value) + 5, 6) end as value from h group by 1")
def udaf_filtered(spark, d):
    i, step = F.col("i"), F.floor(F.col("i") / 7)
    gap = (step % 5 == 0) | (i * i % 11 < 4)
    rows = events(spark, d).df.select("i", step.alias("k"), F.when(~gap, F.when(step % 3 == 0, 1.0).otherwise(F.col("value"))).alias("value"))
    f = create_function(lambda x: x, "double", red=lambda a, b: a + b, init=5.0, filters=[maps.n_valid(2)])
    return _rounded(f.reduce(Cube(rows, ("i", "k"), ("value",)), ["i"]), "value")


@_query("select event_id as i, case when event_id // 10 % 4 = 0 then null else round(value - avg(value) over (partition by event_id // 10), 6) end as z from events")
def udf_block_filtered(spark, d):
    rows = events(spark, d).df.select("i", F.when(F.floor(F.col("i") / 10) % 4 != 0, F.col("value")).alias("value"))
    f = create_function(lambda pdf, block: pdf.assign(z=pdf["value"] - pdf["value"].groupby(block).transform("mean"))[["i", "z"]], {"z": "double"}, is_blockfunction=True, filters=[maps.all_missing], together=True)
    return _rounded(f.on_blocks(Cube(rows, ("i",), ("value",), {}, {"i": 0}), {"i": 10}), "z")


@_query(_FILTER_SQL.format("true"))
def filter_none(spark, d):
    return _filter_query(spark, d, maps.no_filter)


# -- groups without cells, statistics by name --------------------------------------------


@_query("select k + 1 as i, case when k % 3 > 0 then round(avg(value), 6) end as value from (select unnest(range(0, (count(*) + 9) // 10)) as k from events) left join events on event_id // 10 = k and k % 3 > 0 group by k")
def agg_empty_groups(spark, d):
    c = events(spark, d).measured()
    some = Cube(c.df.where(F.floor(F.col("i") / 10) % 3 > 0), ("i",), ("value",), c.shape, c.origin)
    return _rounded(A.aggregate(some, "mean", {"i": 10}, every=True).df, "value")


@_query("""select event_id // 400 + 1 as i, round(avg(value), 6) as mean, round(sum(value), 4) as sum, round(min(value), 6) as minimum, round(max(value), 6) as maximum, count(value)::double as nvalid, round(var_samp(value), 4) as variance from events group by 1""")
def agg_mergeable_names(spark, d):
    """The statistics whose partial results can be merged, in one pass."""
    names_ = [n for n in ("mean", "sum", "minimum", "maximum", "nvalid", "variance", "median") if has_mergeable(n)]
    out = A.aggregate(events(spark, d), {n: n for n in names_}, {"i": 400}).df
    return _rounded(_rounded(out, "mean", "minimum", "maximum", nvalid="double"), "sum", "variance", digits=4)


# -- inputs and targets --------------------------------------------------------------------


@_query(f"with {EMB} select vec_id, d, round(x * (d * d + 0.5), 6) as value from e")
def map_nested_input(spark, d):
    """A vector in the driver's memory, met on a dimension."""
    weights = Cube.from_nested(spark, [k * k + 0.5 for k in range(64)], ["d"], origin=0)
    return _rounded(maps.broadcast(lambda x, w: x * w, embeddings(spark, d), weights).df, "value")


@_query("select event_id as i, round(value - 1, 6) as down from events")
def map_pruned_output(spark, d):
    """One of two outputs: the other isn't worked out."""
    both = maps.map_cells(events(spark, d), {"up": lambda v: v + 1, "down": lambda v: v - 1}).df
    return _rounded(both.select("i", "down"), "down")


@_query("select k as i, round(sum(value), 4) as value from (select event_id // 1000 as k, value from events) group by 1")
def result_collected(spark, d):
    """A small result in the driver's memory, and a cube of it."""
    cells = A.aggregate(events(spark, d), "sum", {"i": 1000}).collect()
    data = [cells[k] for k in sorted(cells)]
    return _rounded(Cube.from_nested(spark, data, ["i"], origin=0).df, "value", digits=4)


def _target(spark: SparkSession, path: str, dims: tuple[str, ...], value: str) -> DataFrame:
    return spark.read.parquet(path).select(*dims, value)


@_query(f"with {EMB} select vec_id, d, round(x * 2, 6) as x from e")
def copy_into_target(spark, d):
    """A result straight into a chunked target that held something else."""
    c, path = embeddings(spark, d).measured(), _scratch(spark, "target")
    copy_to(c, path, c.shape, {"vec_id": 256, "d": 32})
    copy_to(maps.map_cells(c, {"x": lambda x: x * 2}), path, c.shape, {"vec_id": 64, "d": 16})
    return _rounded(_target(spark, path, c.dims, "x"), "x")


@_query(f"with {EMB} select vec_id, d, round(x, 6) as x from e where vec_id < 100 and d < 10")
def write_clipped(spark, d):
    """Cells beyond the target's shape have no place in it."""
    c, path = embeddings(spark, d), _scratch(spark, "clipped")
    write_cube(c, path, {"vec_id": 32, "d": 4}, shape={"vec_id": 100, "d": 10})
    return _rounded(_target(spark, path, c.dims, "x"), "x")


@_query(f"with {EMB} select vec_id // 100 as c_vec_id, d // 16 as c_d, count(*) as n, round(sum(x), 4) as x from e group by 1, 2")
def write_shared_chunks(spark, d):
    """Chunks that many tasks write to: nothing is lost, and blocks pass through as they are."""
    c, path = embeddings(spark, d), _scratch(spark, "shared")
    mixed = Cube(c.df.repartition(9), c.dims, c.values, c.shape, c.origin)
    write_cube(mixed, path, {"vec_id": 100, "d": 16})
    out = spark.read.parquet(path).groupBy(F.col("c_vec_id").cast("long").alias("c_vec_id"), F.col("c_d").cast("long").alias("c_d")).agg(F.count("*").alias("n"), F.sum("x").alias("x"))
    return _rounded(out, "x", digits=4)


@_query(_SQL["interp_2d"])
def interp_into_target(spark, d):
    c, path = embeddings(spark, d).measured(), _scratch(spark, "resampled")
    n = c.shape["vec_id"]
    conv = {"vec_id": (Axis.uniform(0, 1, n), Axis.uniform(-1, 0.7, round(n / 0.7))), "d": (Axis.uniform(0, 1, 64), Axis.uniform(-0.5, 0.9, 73))}
    out = interpolate(c, conv)
    copy_to(out, path, {"vec_id": round(n / 0.7), "d": 73}, {"vec_id": 100, "d": 73})
    return _rounded(_target(spark, path, out.dims, "x"), "x")


@_query(f"with {EMB} select vec_id, d, round(x, 6) as x from e")
def rechunk_planned(spark, d):
    return _rounded(rechunk(embeddings(spark, d), None, _scratch(spark, "planned")).df, "x")


@_query("select event_id as i, round(value * 3, 6) as value, event_id // 700 as block from events")
def run_resumed(spark, d):
    """A run that fails at one block and goes on later: finished blocks aren't made again."""
    c, path, made = events(spark, d).measured(), _scratch(spark, "resumed"), []
    ranges = {"i": [(a, a + 699) for a in range(0, c.shape["i"], 700)]}

    def triple(part: Cube, fails: bool) -> DataFrame:
        blocks = range(part.origin["block"], part.origin["block"] + part.shape["block"])
        if fails and 1 in blocks:
            raise RuntimeError("stopped")
        made.extend(blocks)
        return maps.map_cells(part, lambda v: v * 3).df

    try:
        run_blocks(c, lambda part: triple(part, True), ranges, path, batches=16)
    except RuntimeError:
        pass
    out = run_blocks(c, lambda part: triple(part, False), ranges, path, mode="continue", batches=16)
    if sorted(made) != list(range(len(ranges["i"]))):
        raise ValueError("each block is made once, also the one that failed, when the run goes on")
    return _rounded(out.select("i", "value", F.col("block").cast("long").alias("block")), "value")


# -- what the plan makes of stacked operations ---------------------------------------------


@_query("select event_id as i, round((value * 2 + 1) * 3 - 4, 6) as value, true as fused from events where event_id between 50 and 5000")
def plan_fused_maps(spark, d):
    """Three maps and a range: one projection over one scan that takes the range."""
    c = events(spark, d).subset(i=(50, 5000))
    for f in (lambda v: v * 2 + 1, lambda v: v * 3, lambda v: v - 4):
        c = maps.map_cells(c, f)
    fused = inspect.is_fused(c.df) and bool(inspect.pushed(c.df)) and inspect.shuffles(c.df) == 0
    return _rounded(c.df, "value").withColumn("fused", F.lit(fused))


@_query("with s as (select event_id // 10 as k, sum(value) as v from events group by 1) select a.k + 1 as i, round(a.v + b.v * 0.5, 6) as value, true as shared from s a join s b on a.k = b.k")
def plan_shared_subplan(spark, d):
    """One aggregation that is used twice: its shuffle is made once."""
    one = A.aggregate(events(spark, d), "sum", {"i": 10})
    out = maps.broadcast(lambda a, b: a + b * 0.5, one, Cube(one.df.select("*"), one.dims, one.values, one.shape, one.origin)).df
    return _rounded(out, "value").withColumn("shared", F.lit(inspect.reused(out) > 0))


@_query("select k + 1 as i, round(avg(v), 6) as value, 1::bigint as scans, 2::bigint as aggregations from (select event_id // 20 as k, max(value) as v from events group by event_id // 5, event_id // 20) group by 1")
def plan_chain(spark, d):
    """The operators of a chain of two aggregations, as the plan has them: one scan, two shuffles."""
    out = A.aggregate(A.aggregate(events(spark, d), "maximum", {"i": 5}), "mean", {"i": 4}).df
    found = inspect.nodes(out)
    return _rounded(out, "value").withColumn("scans", F.lit(found["FileScan"] + found["Scan"]).cast("long")).withColumn("aggregations", F.lit(inspect.shuffles(out)).cast("long"))
