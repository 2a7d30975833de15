"""What a plan does: node counts, shuffles, pushed filters, lineage of columns."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def nodes(df: DataFrame) -> Counter:
    """Operators of the physical plan, by name."""
    names = re.findall(r"^[\s:|+\-*()\d]*([A-Z]\w+)", physical(df), re.M)
    return Counter(names)


def shuffles(df: DataFrame) -> int:
    return nodes(df)["Exchange"]


def pushed(df: DataFrame) -> list[str]:
    """The filters that the scans took."""
    return [x for x in re.findall(r"PushedFilters: \[([^\]]*)\]", physical(df)) if x]


def read_columns(df: DataFrame) -> list[list[str]]:
    """The columns that each scan reads."""
    return [[c.split(":")[0] for c in s.split(",") if ":" in c] for s in re.findall(r"ReadSchema: struct<([^>]*)>", physical(df))]


def is_fused(df: DataFrame) -> bool:
    """Whether stacked maps have become one projection."""
    return optimized(df).count("Project ") <= 1


def reused(df: DataFrame) -> int:
    """How many shuffles are read again instead of being made again, as planned without adaptive execution."""
    name = "spark.sql.adaptive.enabled"
    spark = df.sparkSession
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return nodes(df.select("*"))["ReusedExchange"]
    finally:
        spark.conf.set(name, before)


def describe(df: DataFrame) -> str:
    """Operators, shuffles, pushed filters and columns read, and Spark's own estimate of sizes."""
    cost = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost"))
    return "\n".join([f"operators: {dict(nodes(df))}", f"shuffles: {shuffles(df)}", f"pushed: {pushed(df)}", f"columns: {read_columns(df)}", cost])
