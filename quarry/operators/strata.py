"""Stratified splits and samples, by seeded hashes: the same rows on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def split(rows: DataFrame, stratum: str, key: str, dev: float, test: float, seed: int = 42) -> DataFrame:
    """Adds ``part``: dev and test get rounded shares of each stratum, and train one row at least."""
    by = Window.partitionBy(stratum)
    sized = rows.withColumn("n", F.count("*").over(by)).withColumn("place", F.row_number().over(by.orderBy(draw(seed, F.col(key)), key)))
    d = F.least(F.bround(F.col("n") * dev), F.col("n") - 1)
    e = F.least(F.bround(F.col("n") * test), F.col("n") - 1 - d)
    return sized.withColumn("part", F.when(F.col("place") <= d, "dev").when(F.col("place") <= d + e, "test").otherwise("train")).drop("n", "place")


def sample(rows: DataFrame, stratum: str, key: str, target: int, floor: int, seed: int = 42) -> DataFrame:
    """``target`` rows: up to ``floor`` of each stratum, and the rest in proportion to what is left in each.

    What rounding leaves over goes to the strata with most rows left. The strata are
    allotted on a table with a row for each; if they are all used up there are fewer rows.
    """
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("n")).withColumn("base", F.least(F.lit(floor).cast("long"), F.col("n")))
    whole = sizes.agg(F.sum("base").alias("bases"), F.sum(F.col("n") - F.col("base")).alias("rooms"))
    each = sizes.crossJoin(F.broadcast(whole))  # one row of totals
    extra = F.least(F.col("n") - F.col("base"), F.floor(F.greatest(F.lit(target) - F.col("bases"), F.lit(0)) * (F.col("n") - F.col("base")) / F.greatest("rooms", F.lit(1))))
    each = each.withColumn("extra", extra.cast("long"))
    left = F.greatest(F.lit(target) - F.col("bases"), F.lit(0)) - F.sum("extra").over(Window.partitionBy())
    order = Window.orderBy(F.desc(F.col("n") - F.col("base") - F.col("extra")), stratum)
    nudged = each.withColumn("left", left).withColumn("turn", F.row_number().over(order))
    share = F.col("base") + F.col("extra") + F.when((F.col("turn") <= F.col("left")) & (F.col("n") > F.col("base") + F.col("extra")), 1).otherwise(0)
    allotted = nudged.select(stratum, share.alias("share"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(seed, F.col(key)), key))
    return rows.withColumn("place", place).join(F.broadcast(allotted), stratum).where("place <= share").drop("place", "share")


def split_exact(rows: DataFrame, stratum: str, key: str, n_dev: int, n_test: int, seed: int = 42) -> DataFrame:
    """Adds ``part``: ``n_dev`` and ``n_test`` rows in proportion to the strata, one of each at least.

    Strata under three rows go to train; one that would be used up gives a third to
    each. What rounding leaves over or lacks goes one by one to the largest strata,
    again and again, while they keep a row for train, or one of their own.
    """
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # over a table with a row for each stratum
    n = F.col("n")
    share = lambda target: F.greatest(F.lit(1), F.bround(target * n / F.sum("n").over(every))).cast("long")
    sizes = sizes.withColumn("dev", share(n_dev)).withColumn("test", share(n_test))
    full = F.col("dev") + F.col("test") >= n
    third = F.greatest(F.lit(1), F.floor(n / 3)).cast("long")
    sizes = sizes.select(stratum, "n", *(F.when(n < 3, 0).when(full, third).otherwise(F.col(c)).alias(c) for c in ("dev", "test")))
    for c, target in (("dev", n_dev), ("test", n_test)):
        got = F.col(c)
        turn = F.row_number().over(every.orderBy(F.desc(F.when(got > 0, n)), stratum)) - 1
        sizes = sizes.withColumn("over", F.lit(target) - F.sum(c).over(every)).withColumn("turn", turn).withColumn("of", F.count_if(got > 0).over(every))
        steps = F.greatest(F.lit(0), F.ceil((F.abs("over") - F.col("turn")) / F.greatest("of", F.lit(1))))
        moved = F.when(F.col("over") > 0, got + F.least(steps, n - 1 - got)).otherwise(got - F.least(steps, got - 1))
        sizes = sizes.withColumn(c, F.when(got > 0, moved).otherwise(0).cast("long"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(seed, F.col(key)), key))
    placed = rows.withColumn("place", place).join(sizes.select(stratum, "dev", "test"), stratum)
    part = F.when(F.col("place") <= F.col("dev"), "dev").when(F.col("place") <= F.col("dev") + F.col("test"), "test").otherwise("train")
    return placed.withColumn("part", part).drop("place", "dev", "test")


def proportional(rows: DataFrame, stratum: str, key: str, n: int, least: int = 1, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer): rounded shares of the strata, ``least`` at least, then trimmed or topped up by draw."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    whole = F.sum("size").over(Window.partitionBy())  # over a table with a row for each stratum
    take = sizes.select(stratum, F.greatest(F.lit(least), F.bround(n * F.col("size") / whole)).alias("take"))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(seed, F.col(key)), key))
    placed = rows.withColumn("place", place).join(take, stratum)
    return placed.orderBy(F.col("place") > F.col("take"), draw(seed + 1, F.col(key)), key).limit(n).drop("place", "take")


def balance(rows: DataFrame, pool: DataFrame, group: str, key: str, target: int, seed: int = 42) -> DataFrame:
    """``target`` rows of each group: drawn from ``rows``, and from ``pool`` (rows with other keys) where those are too few."""
    both = rows.withColumn("side", F.lit(0)).unionByName(pool.join(rows.select(key), key, "left_anti").withColumn("side", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(group).orderBy("side", draw(seed, F.col(key)), key))
    return both.withColumn("place", place).where(F.col("place") <= target).drop("place", "side")


def head_tail(rows: DataFrame, key: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """Adds ``part``: the first ``share`` of the rows in drawn order are head, the others tail.

    The rows before a row are counted by the draw's first characters, a table of
    65,536 rows at most, and then inside each such cell, so no task sorts all rows.
    """
    drawn = rows.withColumn("drawn", draw(seed, F.col(key))).withColumn("cell", F.substring("drawn", 1, 4))
    cells = drawn.groupBy("cell").agg(F.count("*").alias("held"))
    before = cells.withColumn("before", F.sum("held").over(Window.orderBy("cell")) - F.col("held")).withColumn("whole", F.sum("held").over(Window.partitionBy())).drop("held")
    place = F.row_number().over(Window.partitionBy("cell").orderBy("drawn", key)) + F.col("before")
    return drawn.join(F.broadcast(before), "cell").withColumn("part", F.when(place <= F.floor(F.col("whole") * share), "head").otherwise("tail")).drop("drawn", "cell", "before", "whole")


def interleave(rows: DataFrame, group: str, key: str) -> DataFrame:
    """The first row of each group, then the second of each, and so on: adds ``position``.

    A row's position follows from the sizes of all groups (one row, an entry for each
    group) and its turn in its own, so rows are never sorted in one task.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.collect_list(F.struct(F.col(group).alias("g"), "n")).alias("sizes"))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(key))
    placed = rows.withColumn("turn", turn).crossJoin(F.broadcast(sizes))
    earlier = F.expr(f"aggregate(sizes, 0L, (sum_, one_) -> sum_ + least(one_.n, turn - 1) + if(one_.n >= turn and one_.g < `{group}`, 1L, 0L))")
    return placed.withColumn("position", earlier + 1).drop("sizes")
