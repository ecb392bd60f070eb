"""Reports on the quality of a table: violations by group, profiles, duplicates, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(rows: DataFrame, group: str, checks: dict[str, Column]) -> DataFrame:
    """check_name, ``group``, n_rows, n_bad: all checks in one pass over the table; null counts as no violation."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n_rows"), *(F.count_if(c).alias(f"c{i}") for i, c in enumerate(checks.values())))
    told = F.array(*(F.struct(F.lit(name).alias("check_name"), F.col(f"c{i}").alias("n_bad")) for i, name in enumerate(checks)))
    return counts.select(group, "n_rows", F.inline(told))


def profile(rows: DataFrame) -> DataFrame:
    """col, n_null, n_values, pct (of nulls) for every column, in one aggregate."""
    counts = rows.agg(F.count("*").alias("n"), *(x for i, c in enumerate(rows.columns) for x in (F.count_if(F.col(f"`{c}`").isNull()).alias(f"e{i}"), F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}"))))
    told = F.array(*(F.struct(F.lit(c).alias("col"), F.col(f"e{i}").alias("n_null"), F.col(f"d{i}").alias("n_values"), F.try_divide(100 * F.col(f"e{i}"), F.col("n")).alias("pct")) for i, c in enumerate(rows.columns)))
    return counts.select(F.inline(told))


def duplicates(rows: DataFrame) -> DataFrame:
    """n, n_dup: rows, and those that repeat another in every column."""
    return rows.groupBy(*(F.col(f"`{c}`") for c in rows.columns)).agg(F.count("*").alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("n_dup"))


def distribution(rows: DataFrame, column: str, rare: int = 5) -> DataFrame:
    """value, n, rare, share of each value of a column; the values are a small table."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.select("value", "n", (F.col("n") <= rare).alias("rare"), (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def gates(tests: dict[str, DataFrame]) -> DataFrame:
    """check_name, held of one-row tables with a column ``held``."""
    out = None
    for name, df in tests.items():
        one = df.select(F.lit(name).alias("check_name"), "held")
        out = one if out is None else out.unionAll(one)
    return out
