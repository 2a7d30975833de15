"""Connected components by alternating large-star and small-star rounds.

Every round pre-aggregates each node's smallest neighbour on the map side and joins it
back by an equi-join that adaptive execution splits for hubs; no neighbourhood is
collected. The edge list of a round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _star(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (v, m) from pairs (u, v) and the least node m at u."""
    return pairs.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b) that reach a smaller node; root is the smallest one."""
    now = ws.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        # large star: neighbours above u hang below the least of u and its neighbours
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _star(both.where("v > u"), least).distinct()
        # small star: u and its lower neighbours hang below the least of them
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _star(down, low).unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        after = ws.save(small, "edges")
        # stars: nothing that is pointed at points on
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        ws.drop(now)
        now = after
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        ws.release()
