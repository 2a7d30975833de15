"""Exact deduplication by distributed MSD radix partitioning.

Normalised texts are split by their leading bytes, every group of more than one row
again by the bytes that follow, and so on with windows that grow by a factor, until a
group has a single row or its texts have ended. Rows are equal when they reach the end
in one group: bytes are compared with bytes, no digest decides.

A round makes two shuffles. The counts of (group, bytes) are pre-aggregated on the map
side, so that a group of copies is one row per map task; rows then join their count,
a plain equi-join that adaptive execution splits where a group is hot. After the first
round only rows that share their prefix with another carry what is left of their text.

A null text counts as empty; a null id stays null and is never preferred as the
keeper. Rows with the same id are separate rows: of equal ones, one is kept. An
empty table gives no rows. Only the named columns are read and returned, so that
further columns can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Workspace, sized

#: Bytes that the first round compares; each later one compares GROWTH times as many.
FIRST, GROWTH = 64, 16


def radix_groups(rows: DataFrame, ws: Workspace, carried: list[str], first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """Rows with ``round`` and ``gid``, which name the group of equal ``b`` (binary), and its size ``n``."""
    finished, r, width = [], 0, first
    state = rows.withColumn("gid", F.lit(0).cast("long"))
    while True:
        keyed = state.select(
            *carried, F.col("gid").alias("parent"),
            F.expr(f"substring(b, 1, {width})").alias("c"),
            (F.octet_length("b") <= width).alias("ended"),
            F.expr(f"substring(b, {width + 1})").alias("rest"),
        )
        split = ws.save(keyed.groupBy("parent", "c", "ended").agg(F.count("*").alias("n")).withColumn("gid", F.monotonically_increasing_id()), f"split{r}")
        done = F.col("ended") | (F.col("n") == 1)
        joined = keyed.join(split, ["parent", "c", "ended"]).select(*carried, F.lit(r).alias("round"), "gid", "n", done.alias("done"), F.when(~done, F.col("rest")).alias("b"))
        state_all = ws.save(joined, f"rows{r}")
        ws.drop(split)
        finished.append(state_all.where("done").select(*carried, "round", "gid", "n"))
        state = state_all.where(~F.col("done")).select(*carried, "gid", "b")
        if state.isEmpty():
            return reduce(DataFrame.unionAll, finished)
        r, width = r + 1, width * growth
        ws.release()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256[, rid]), a row for each row of ``docs``.

    Of equal texts (white space of ``common.WHITE`` removed) the one with the most code
    points in the original stays, then the smallest id.
    """
    ws = Workspace(docs.sparkSession, "exact")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.col(rid_col) if rid_col else F.monotonically_increasing_id()).alias("rid"),
        F.length(text).alias("chars"),
        F.encode(F.translate(text, WHITE, ""), "UTF-8").alias("b"),
    ).select("doc_id", "rid", "chars", F.unhex(F.sha2("b", 256)).alias("sha"), "b")
    groups = radix_groups(rows, ws, ["doc_id", "rid", "chars", "sha"])
    order = F.struct((-F.col("chars")).alias("x"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid"))
    several = groups.where("n > 1")
    keepers = sized(ws.save(several.groupBy("round", "gid").agg(F.min(order).alias("k")).select("round", "gid", "k.keep_id", "k.keep_rid"), "keepers"))
    out = ["doc_id", "keep_id", F.col("n").alias("group_size"), F.col("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *(["rid"] if rid_col else [])]
    copies = several.join(keepers, ["round", "gid"]).withColumn("kept", F.col("rid") == F.col("keep_rid"))
    single = groups.where("n = 1").withColumn("keep_id", F.col("doc_id")).withColumn("kept", F.lit(True))
    return single.select(*out).unionAll(copies.select(*out))
