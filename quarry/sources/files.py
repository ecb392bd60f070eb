"""Readers and writers of the formats that candidate rows and attempts come in."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


def read_glob(spark: SparkSession, pattern: str, tolerant: bool = False) -> DataFrame:
    """Parquet files of a glob, with their paths and each row's place in its file; unreadable files are skipped if ``tolerant``.

    Rows in the order of their files: order by file_path, file_row.
    """
    reader = spark.read.option("ignoreCorruptFiles", str(tolerant).lower())
    return reader.parquet(pattern).select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("file_row"))


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files, in the stream or the file format. Spark reads their bytes, so any store will do; a file is a task."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def opened(content: bytes):
        source = pa.BufferReader(content)
        return pa.ipc.open_file(source) if content[:6] == b"ARROW1" else pa.ipc.open_stream(source)

    with opened(files.limit(1).collect()[0]["content"]) as first:
        kind = from_arrow_schema(first.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with opened(content) as reader:
                    yield from reader.read_all().to_batches()

    return files.mapInArrow(run, kind)


def flatten(df: DataFrame) -> DataFrame:
    """Fields of struct columns as columns with dotted names, at every level."""
    def leaves(kind, path: list[str]):
        for field in kind.fields:
            here = [*path, field.name]
            if isinstance(field.dataType, StructType):
                yield from leaves(field.dataType, here)
            else:
                yield F.col(".".join(f"`{x}`" for x in here)).alias(".".join(here))

    return df.select(*leaves(df.schema, []))


def cells(spark: SparkSession, root: str, *needed: str) -> DataFrame:
    """Folders below ``root`` (two levels: group and cell) that hold all of the named files: grp, cell, path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    named = found.select(F.element_at(parts, -3).alias("grp"), F.element_at(parts, -2).alias("cell"), F.regexp_replace("path", "/[^/]*$", "").alias("path"), F.element_at(parts, -1).alias("file"))
    held = named.where(F.col("file").isin(*needed)).groupBy("grp", "cell", "path").agg(F.count_distinct("file").alias("n"))
    return held.where(F.col("n") == len(needed)).drop("n")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines file, with the file's stem as ``domain``; and its bad lines."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r"), "value", F.col("_metadata.file_path").alias("p"))
    domain = F.regexp_extract("p", r"([^/]+?)(\.[a-z]+)*$", 1).alias("domain")
    good = lines.where("r._corrupt_record is null").select(*(F.col(f"r.{c}") for c in rows.columns if c != "_corrupt_record"), domain)
    return good, lines.where("r._corrupt_record is not null").select("value", domain)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all strings; a byte order mark goes."""
    df = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    return df.toDF(*(c.removeprefix("﻿") for c in df.columns))


def read_log(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """All numbers that the first group of ``pattern`` finds in text lines."""
    found = F.explode(F.regexp_extract_all("value", F.lit(pattern), 1)).alias("number")
    return spark.read.text(path).select(found).select(F.col("number").cast("double"))


def write_once(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Write unless the table is there already, and read it back."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if force or not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_twins(df: DataFrame, path: str, reason: str = "filter_reason") -> None:
    """Rows without a reason to ``path``, the others to its ``_removed`` twin. The input is computed once: rows go to a table by side first."""
    spark, staged = df.sparkSession, f"{path}_staged"
    df.withColumn("is_kept", F.col(reason).isNull().cast("int")).write.mode("errorifexists").partitionBy("is_kept").parquet(staged)
    both = spark.read.parquet(staged)
    both.where("is_kept = 1").drop(reason, "is_kept").write.mode("errorifexists").parquet(path)
    both.where("is_kept = 0").drop("is_kept").write.mode("errorifexists").parquet(f"{path}_removed")
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_checked(df: DataFrame, path: str, report_only: bool = False) -> DataFrame:
    """Write, read back, and hold columns and rows against what was to be written. With ``report_only`` nothing is written."""
    counted = df.withColumn("checked", F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))) if report_only else df
    if report_only:
        return counted.agg(F.count("*").alias("n_rows"))
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if back.columns != df.columns or back.count() != df.count():
        raise ValueError(f"{path} reads back otherwise than it was written")
    return back


def write_summary(df: DataFrame, path: str) -> None:
    """A small table of figures as JSON lines, in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def backfill(df: DataFrame, **constants: str) -> DataFrame:
    """Columns with a constant where they are missing; those that are there stay."""
    return df.select("*", *(F.lit(v).alias(k) for k, v in constants.items() if k not in df.columns))


def union_promoted(*tables: DataFrame) -> DataFrame:
    """Union by name: columns that not all have become null there, those of different types strings; names that begin with __ go."""
    kinds: dict[str, set[str]] = {}
    for df in tables:
        for name, kind in df.dtypes:
            if not name.startswith("__"):
                kinds.setdefault(name, set()).add(kind)
    out = None
    for df in tables:
        own = df.select(*(F.col(f"`{c}`").cast("string").alias(c) if len(k) > 1 else F.col(f"`{c}`") for c, k in kinds.items() if c in df.columns))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def changed_rows(before: DataFrame, after: DataFrame, key: str, *leave: str) -> DataFrame:
    """Keys whose rows differ in a column other than ``leave``, or stand in one table only."""
    one, two = (row_digest(x, *leave).select(key, F.col("digest").alias(f"d{i}")) for i, x in enumerate((before, after)))
    return one.join(two, key, "full").where(~F.col("d0").eqNullSafe(F.col("d1"))).select(key)


def row_digest(df: DataFrame, *leave: str) -> DataFrame:
    """A digest of every column but ``leave``, to compare a table before and after a change."""
    return df.withColumn("digest", F.sha2(F.to_json(F.struct(*(c for c in df.columns if c not in leave))), 256))
