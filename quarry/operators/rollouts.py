"""Aggregates over repeated attempts at problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_problem(rollouts: DataFrame, *keys: str) -> DataFrame:
    """n_rollouts, n_correct, pass_fraction of each problem; ``correct`` is a boolean."""
    out = rollouts.groupBy(*keys).agg(F.count("*").alias("n_rollouts"), F.count_if("correct").alias("n_correct"))
    return out.withColumn("pass_fraction", F.col("n_correct") / F.col("n_rollouts"))


def pass_at(k: int, n: str = "n_rollouts", c: str = "n_correct") -> Column:
    """1 - C(n - c, k) / C(n, k): the unbiased estimate; 1 where fewer than k attempts are wrong."""
    wrong, of = F.col(n) - F.col(c), F.col(n)
    miss = F.lit(1.0)
    for i in range(k):
        miss = miss * ((wrong - i) / (of - i))
    return F.when(wrong < k, 1.0).otherwise(1 - miss)


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def saturation(problems: DataFrame, *keys: str) -> DataFrame:
    """Shares of problems with all attempts right, all wrong, either, neither."""
    right, wrong = F.col("n_correct") == F.col("n_rollouts"), F.col("n_correct") == 0
    share = lambda c: F.avg(c.cast("double"))
    return problems.groupBy(*keys).agg(F.count("*").alias("n"), share(right).alias("all_right"), share(wrong).alias("all_wrong"), share(right | wrong).alias("saturated"), share(~(right | wrong)).alias("informative"))


def patch(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with ``columns`` taken from ``changes`` where it has their key."""
    new = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("hit"))
    joined = rows.join(new, key, "left")
    return joined.select(*(F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def profile(rollouts: DataFrame, key: str, order: str, *firsts: str) -> DataFrame:
    """per_problem with the values of ``firsts`` at each problem's first attempt by ``order``, and whether any was right."""
    out = rollouts.groupBy(key).agg(F.count("*").alias("n_rollouts"), F.count_if("correct").alias("n_correct"), F.bool_or("correct").alias("solved"), *(F.min_by(c, order).alias(c) for c in firsts))
    return out.withColumn("pass_fraction", F.col("n_correct") / F.col("n_rollouts"))


def rates(rollouts: DataFrame, *keys: str) -> DataFrame:
    """Rates over attempts: of all, of those not cut off (null if all were), of those judged (null if none was).

    ``verdict`` is 1, 0 or -1 (not judged); ``truncated`` is a boolean.
    """
    right = F.count_if(F.col("verdict") == 1)
    return rollouts.groupBy(*keys).agg(
        F.count("*").alias("n"), (right / F.count("*")).alias("pass_rate"), F.try_divide(right, F.count_if(~F.col("truncated"))).alias("pass_rate_whole"), F.try_divide(right, F.count_if(F.col("verdict") >= 0)).alias("pass_rate_judged")
    )


def nearest_rank(value: Column, q: float) -> Column:
    """The value at rank round(q (n - 1)) of a group, halves to even; the group is gathered, so it must fit a task."""
    listed = F.array_sort(F.collect_list(value))
    return F.get(listed, F.bround(q * (F.size(listed) - 1)).cast("int"))
