"""What op2's plan carries, and that repeated rows still count once."""

import re

from quarry.llm import licenses


def test_texts_are_read_once_and_not_carried_with_ngrams(spark, tmp_path):
    rows = [(1, "Released under the MIT License.\nAnd more."), (1, "Released under the MIT License.\nAnd more."), (2, None), (3, "plain words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    found = licenses.scan(spark.read.parquet(f"{tmp_path}/d"))
    assert [(r.doc_id, r.line, r.family, r.similarity, r.confirmed) for r in found.collect()] == [(1, 1, "mit", 1.0, True)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", plan)) == 1
    keys = [x for x in re.findall(r"Aggregate \[([^\]]*)\]", plan)]
    assert keys and not any("content" in x or "low#" in x for x in keys)
