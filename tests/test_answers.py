"""Gold answers, loaders, sources and splits on rows written here."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import answers as a
from quarry.functions import text as t
from quarry.operators import report, strata
from quarry.sources import files, loaders
from quarry.streaming import intake


def each(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_choices(spark):
    assert each(spark, a.mcq_gold, [r"\boxed{d}", "(B)", "A) first", r"(\text{c})", "BCD", "words", "", None]) == ["D", "B", "A", "C", "BCD", None, None, None]
    assert each(spark, a.true_false_gold, ["T", r"\boxed{No: $x$}", "so E_2=4, yes", "perhaps", None]) == ["True", "False", "True", None, None]


def test_cleaning(spark):
    values = [r"\frac{1", r"It is $\boxed{\frac{1}{2}}$ here", "$$x+y$$", r"we get \(v=3\) now", r"\\sqrt{2}", "x\n then", "Speed: $v$", "数", "x+1", None]
    got = each(spark, a.clean_gold, values)
    assert [g["tag"] for g in got[:9]] == ["truncated_dropped", "prose_extracted", "dollar_stripped", "display_math_extracted", "double_unescaped", "prose_dropped", "prose_gold_dropped", "non_latin_dropped", "unchanged"]
    assert [g["clean"] for g in got[:5]] == [r"\frac{1", r"\frac{1}{2}", "x+y", "v=3", r"\sqrt{2}"] and got[9]["clean"] is None


def test_types_and_units(spark):
    assert each(spark, a.infer_type, ["D", "(D)", "d", "12%", r"3.1 \times 10^{4}", "7.5 kg", "p = q", "g(x=2)", r"\sqrt{k}", "3(1 + cos u)", "+w", "2e5", "4, 5", ""]) == [
        "mcq", "mcq", "expression", "numerical", "numerical", "numerical", "equation", "expression", "expression", "expression", "expression", "numerical", "unknown", "unknown"]
    assert each(spark, a.unit_kind, [r"3\,\mathrm{kg}", "5N", "7 apples", "x+y"]) == ["latex_unit", "bare_unit", "fraction_unit", "no_unit"]
    assert each(spark, a.plain_unit, [r"$\mathrm{~km} / \mathrm{h}^2$", r"\mathrm{~J} \cdot \mathrm{~s}"]) == ["km / h^2", "J s"]
    assert each(spark, a.plain_quantity, [r"2.5 \times 10^{-3} \text{ kg}"]) == ["2.5e-3 kg"]
    assert each(spark, a.leading_number, ["2.97uA", r"$1.5\,$", "-3e2", "x"]) == [2.97, 1.5, -300.0, None]
    assert each(spark, lambda c: F.array_join(a.normalize_types(c), ","), ["EX, NV", '["TF"]', "?", None]) == ["expression,numerical", "true_false", "unknown", "unknown"]
    assert each(spark, a.counted_type, ['["a", "b"]', "a", "[x"]) == ["multi(2)-a", "a", "[x"] and each(spark, a.coarse_domain, ["Optics", "Modern Physics", "?"]) == ["optics", "quantum_modern", "other"]


def test_tool_calls(spark):
    xml = "<tool_call>old</tool_call> x <tool_call>\n<function=python>\n<parameter=code>\nprint(1)\n</parameter>\n</function></tool_call>"
    quoted = '<tool_call>{"name": "python", "arguments": {"code": "a = \\"b\\"\\nc"}}</tool_call>'
    assert each(spark, a.tool_call, [xml, quoted, "none", "<tool_call>{}</tool_call>"]) == ["print(1)", 'a = "b"\nc', None, None]


def test_unicode_space(spark):
    assert each(spark, t.normalize_question, ["A\u00a0\u2003 B\u3000c!", "x\x1cy"]) == ["a b c", "x y"]


def test_cut(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.2, 0.3, 1.0, 2.0)], "x double")
    edges, names = [0.0, 0.2, 1.0], ["low", "high"]
    assert [r[0] for r in df.select(t.cut(F.col("x"), edges, names)).collect()] == [None, None, "low", "high", "high", None]
    assert [r[0] for r in df.select(t.cut(F.col("x"), edges, names, lowest=True)).collect()] == [None, "low", "low", "high", "high", None]
    assert [r[0] for r in df.select(t.cut(F.col("x"), edges, names, right=False)).collect()] == [None, "low", "high", "high", None, None]


def test_loaders(spark):
    raw = spark.createDataFrame([(0, "Find v", [["1"], ["2"]], ["Numerical", "EX"], "d", "e"), (1, "求 v", [["1"]], ["NV"], "d", "e"), (2, "Q", [["1", "one"]], ["NV"], "d", "e"), (3, "Say", [["x"]], ["Open-end"], None, None)], "ordinal long, question string, answer array<array<string>>, answer_type array<string>, domain string, difficulty string")
    got = loaders.physics(raw).collect()
    assert [(r["problem_id"], r["answer"], r["answer_type"], r["split"]) for r in got] == [("PHYSICS_00000", ["1", "2"], ["numerical", "expression"], "train_candidate"), ("PHYSICS_00003", ["x"], ["open_end"], "eval_tier1")]
    raw = spark.createDataFrame([(0, "Q", ["1", "2"], "NV,EX", "m", "0.1"), (1, "Q", ["1"], "NV,EX", None, None), (2, "Q", ["7"], "NV", None, None)], "ordinal long, question string, final_answer array<string>, answer_type string, unit string, error string")
    assert [(r["problem_id"], r["answer_type"], r["tolerance"]) for r in loaders.olympiad(raw, "c").collect()] == [("OlympiadBench_c_00000", ["numerical", "expression"], "0.1"), ("OlympiadBench_c_00002", ["numerical"], "")]
    raw = spark.createDataFrame([(0, "thermo", "5", "K", "p"), (1, "atkins", "5", "K", "p"), (2, None, None, None, "p")], "ordinal long, source string, answer_number string, unit string, problem_text string")
    assert [(r["domain"], r["answer"]) for r in loaders.scibench(raw).collect()] == [("thermo", ["5"]), ("", [""])]
    raw = spark.createDataFrame([(0, "7", "q", "1.5")], "ordinal long, mid string, standard_question string, standard_answer string")
    assert loaders.abench(raw).first()["problem_id"] == "ABench_Phy_B_7_0000"
    raw = spark.createDataFrame([(0, "q", "so\n#### 1,200"), (1, "q", "none")], "ordinal long, question string, answer string")
    assert [r["answer"] for r in loaders.worked(raw).collect()] == [[r"\boxed{1200}"]]
    raw = spark.createDataFrame([(0, "mech", "en", "p", "a", "NV\nmore", None, "true"), (1, "mech", "zh", "p", "a", "NV", None, "true")], "ordinal long, subject string, language string, problem string, answers string, answer_type string, unit string, is_multiple_answer string")
    assert [(r["problem_id"], r["answer_type"], r["metadata"]) for r in loaders.ugphysics(raw).collect()] == [("UGPhysics_mech_00000", ["numerical"], {"is_multiple_answer": "true"})]
    raw = spark.createDataFrame([(0, "9", "q", ["a"], ["g"], "mech_dataset_textonly")], "ordinal long, id string, questions string, final_answers array<string>, graphs array<string>, domain string")
    assert [(r["domain"], r["metadata"]) for r in loaders.yale(raw).collect()] == [("mech", {"has_graph": "true"})]
    raw = spark.createDataFrame([(0, None, "d", "c", "t")], "ordinal long, problem_id string, problem_description string, answer_code string, code_template string")
    assert loaders.critpt(raw).first()["problem_id"] == "CritPt_CritPt_00000"
    assert [r[0] for r in spark.createDataFrame([("1e-2,5", 3), (None, 2), ("x", 1)], "e string, n int").select(loaders.errors(F.col("e"), F.col("n"))).collect()] == [[0.01, 5.0, 5.0], [1e-8, 1e-8], [1e-8]]


def test_sources(spark, tmp_path):
    table = pa.table({"a": [1, 2], "s": ["x", None]})
    for name, opened in (("f", pa.ipc.new_file), ("g", pa.ipc.new_stream)):
        with opened(str(tmp_path / f"{name}.arrow"), table.schema) as w:
            w.write_table(table)
    assert sorted(map(tuple, files.read_arrow(spark, str(tmp_path / "*.arrow")).collect()), key=str) == [(1, "x"), (1, "x"), (2, None), (2, None)]
    df = spark.createDataFrame([(1, (2, ("z",)))], "a int, b struct<c:int,d:struct<e:string>>")
    assert files.flatten(df).columns == ["a", "b.c", "b.d.e"]
    for cell, names in (("g1/c1", ("x.txt", "y.txt")), ("g1/c2", ("x.txt",))):
        (tmp_path / "cells" / cell).mkdir(parents=True)
        for n in names:
            (tmp_path / "cells" / cell / n).write_text("1")
    assert [(r["grp"], r["cell"]) for r in files.cells(spark, str(tmp_path / "cells"), "x.txt", "y.txt").collect()] == [("g1", "c1")]
    one, two = spark.createDataFrame([(1, 0.5, "t")], "id int, d double, `__x` string"), spark.createDataFrame([(2, "hard", "p")], "id int, d string, pool string")
    assert sorted(map(tuple, files.union_promoted(one, two).collect())) == [(1, "0.5", None), (2, "hard", "p")]
    files.write_checked(two, str(tmp_path / "w"))
    assert files.write_checked(two, str(tmp_path / "w"), report_only=True).first()["n_rows"] == 1 and files.backfill(two, pool="q", tag="z").columns == ["id", "d", "pool", "tag"]
    assert [r[0] for r in files.changed_rows(one.select("id", "d"), one.select("id", (F.col("d") + 1).alias("d")), "id").collect()] == [1] and not files.changed_rows(one, one, "id").count()
    files.write_summary(two, str(tmp_path / "summary"))
    assert json.loads(next((tmp_path / "summary").glob("*.json")).read_text())["id"] == 2


def test_read_glob(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(10 * i,), (10 * i + 1,)], "a int").coalesce(1).write.parquet(str(tmp_path / f"d{i}"))
    (tmp_path / "d1" / "broken.parquet").write_bytes(b"no")
    got = files.read_glob(spark, str(tmp_path / "d*" / "*.parquet"), tolerant=True).orderBy("file_path", "file_row").collect()
    assert [r["a"] for r in got] == [0, 1, 10, 11] and [r["file_row"] for r in got] == [0, 1, 0, 1]


def test_intake_with_a_new_checkpoint(spark, tmp_path):
    schema = "k long, id long"
    for part in range(2):
        spark.range(20 * part, 20 * part + 20).select((F.col("id") % 4).alias("k"), "id").coalesce(1).write.parquet(str(tmp_path / f"in{part}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"in{part}"))
        intake.first_per_key(spark, stream, "k", "id", 8, str(tmp_path / "out"), str(tmp_path / f"cp{part}")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["count"] for r in got.groupBy("k").count().collect()} == {8} and got.where("id < 20").count() == 20
    asked = spark.createDataFrame([(0,), (9,), (9,)], "k long")
    assert sorted(map(tuple, intake.refill(asked, got, "k", 8).collect())) == [(9, 8)]
    assert {(r["k"], r["n"]) for r in intake.step_saturation(got.withColumn("ok", F.lit(True)), "k", "ok").collect()} == {(k, 8) for k in range(4)}


@pytest.mark.parametrize(("dev", "test"), [(10, 12), (40, 50), (3, 2)])
def test_exact_split(spark, dev, test):
    rows = [(s, f"{s}{i}") for s, n in (("A", 90), ("B", 41), ("C", 7), ("D", 2), ("E", 3)) for i in range(n)]
    got = strata.split_exact(spark.createDataFrame(rows, "s string, id string"), "s", "id", dev, test).collect()
    parts = [r["part"] for r in got]
    assert len(got) == len(rows) and {r["part"] for r in got if r["s"] == "D"} == {"train"}
    assert all({"dev", "test", "train"} == {r["part"] for r in got if r["s"] == s} for s in "ABCE")
    if dev > 4:
        assert (parts.count("dev"), parts.count("test")) == (dev, test)


def test_samples(spark):
    rows = spark.createDataFrame([(s, f"{s}{i}") for s, n in (("A", 300), ("B", 90), ("C", 4)) for i in range(n)], "s string, id string")
    assert strata.proportional(rows, "s", "id", 50).count() == 50 and strata.proportional(rows, "s", "id", 1000).count() == 394
    assert {r["s"]: r["count"] for r in strata.balance(rows.where("id like '%0'"), rows, "s", "id", 35).groupBy("s").count().collect()} == {"A": 35, "B": 35, "C": 4}
    order = [r["s"] for r in strata.interleave(rows, "s", "id").orderBy("position").limit(10).collect()]
    assert order == list("ABCABCABCA") and strata.interleave(rows, "s", "id").agg(F.count_distinct("position"), F.max("position")).first() == (394, 394)
    assert strata.head_tail(rows, "id").where("part = 'tail'").count() == 40


def test_reports(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 1), ("b", 1)], "g string, x int")
    assert {tuple(r) for r in report.violations(df, "g", {"null": F.col("x").isNull(), "one": F.col("x") == 1}).collect()} == {("a", 2, "null", 1), ("a", 2, "one", 1), ("b", 2, "null", 0), ("b", 2, "one", 2)}
    assert tuple(report.duplicates(df).first()) == (4, 1) and tuple(report.duplicates(df.limit(0)).first()) == (0, 0)
    assert {tuple(r) for r in report.profile(df).collect()} == {("g", 0, 2, 0.0), ("x", 1, 1, 25.0)}
