"""Integrity rules as violations; Parquet enforces none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """(table, rule, violations): rows for which a rule does not hold; null is no violation. One pass for all rules."""
    counts = df.agg(*[F.coalesce(F.sum((~rule).cast("long")), F.lit(0)).alias(name) for name, rule in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(n).alias("rule"), F.col(n).cast("long").alias("violations")) for n in rules])))


def duplicates(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return d.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(table).alias("table_name"), F.lit("unique " + ",".join(keys)).alias("rule"), "violations")


def orphans(df: DataFrame, table: str, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    left = df.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
    return left.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(table).alias("table_name"), F.lit(f"{key} references {parent_key}").alias("rule"), "violations")


def between(column: str, low: float, high: float) -> Column:
    return F.col(column).between(low, high)


def implies(a: Column, b: Column) -> Column:
    return ~a | b


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
