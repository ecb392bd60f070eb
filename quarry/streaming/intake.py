"""Streaming forms of resumable intake: each micro-batch adds only what is missing."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_per_key(spark: SparkSession, source: DataFrame, key: str, order: str, n: int, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the first ``n`` rows of each key over all micro-batches, in a parquet table.

    A batch joins its keys to the counts of what the table has. Batches are written
    to folders named by the checkpoint and their number, so a batch that is run again
    replaces itself, and a new checkpoint adds to what older ones wrote.
    """
    run = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(order)))
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            there = spark.read.parquet(target).where(F.concat_ws("-", "run", F.col("batch").cast("string")) != f"{run}-{number}").groupBy(key).agg(F.count("*").alias("have"))
            batch = batch.join(there, key, "left").where(F.col("turn") + F.coalesce("have", F.lit(0)) <= n).drop("have")
        else:
            batch = batch.where(F.col("turn") <= n)
        batch.drop("turn").write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def step_saturation(source: DataFrame, group: str, correct: str) -> DataFrame:
    """Running counts of right and all attempts of each group, for complete-mode output."""
    return source.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("n_correct"))


def refill(asked: DataFrame, attempts: DataFrame, key: str, n: int) -> DataFrame:
    """Keys with fewer than ``n`` attempts, and how many each still needs: what the next round has to issue."""
    have = attempts.groupBy(key).agg(F.count("*").alias("have"))
    missing = asked.select(key).distinct().join(have, key, "left").select(key, (F.lit(n) - F.coalesce("have", F.lit(0))).alias("missing"))
    return missing.where("missing > 0")
