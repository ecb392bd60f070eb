from pyspark.sql import functions as F

from quarry.operators import strata
from quarry.sources import files
from quarry.streaming import intake


def test_formats(spark, tmp_path):
    (tmp_path / "mech.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "mech.jsonl"), "a int")
    assert sorted(map(tuple, good.collect())) == [(1, "mech"), (2, "mech")] and bad.count() == 1
    (tmp_path / "x.csv").write_bytes("﻿id,b\n1,2\n".encode())
    assert files.read_csv(spark, str(tmp_path / "x.csv")).columns == ["id", "b"]
    (tmp_path / "l.log").write_text("step 1 loss 0.5\nnothing\nstep 2 loss 0.25\n")
    assert [r[0] for r in files.read_log(spark, str(tmp_path / "l.log"), r"loss ([\d.]+)").collect()] == [0.5, 0.25]
    df = spark.createDataFrame([(1, None), (2, "bad")], "a int, filter_reason string")
    files.write_twins(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out_removed")).count() == 1
    assert files.write_once(df, str(tmp_path / "out")).count() == 1


def test_stream(spark, tmp_path):
    spark.range(100).select((F.col("id") % 7).alias("k"), "id").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    intake.first_per_key(spark, stream, "k", "id", 8, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("k").count().collect()
    assert {r["count"] for r in got} == {8} and len(got) == 7


def test_floor_sample(spark):
    rows = spark.createDataFrame([(s, f"{s}{i}") for s, n in (("A", 500), ("B", 200), ("C", 30), ("D", 5)) for i in range(n)], "s string, id string")
    got = {r["s"]: r["count"] for r in strata.sample(rows, "s", "id", 100, 10).groupBy("s").count().collect()}
    assert sum(got.values()) == 100 and got["D"] == 5 and got["C"] >= 10
