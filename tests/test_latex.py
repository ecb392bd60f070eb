import pytest

from quarry.functions import latex as x


@pytest.mark.parametrize(("a", "b", "same"), [
    (r"\frac{3}{8}", "0.375", True), ("7/5", "1.4", True), (r"6.02 \times 10^3", "6020", True), (r"\sqrt{5}", "2.236", True), ("(p+q)^2", "p^2 + 2 p q + q^2", True),
    ("u^2+w", "u^2-w", False), ("V = i r", "r i = V", True), ("3 k = 6 x t", "k = 2 t x", True), ("9.81", "9.9", True), ("9.81", "1.2", False), ("5", "-5", False), (r"\bar{", "1", None),
])
def test_equivalent(a, b, same):
    assert x.equivalent(a, b) is same


@pytest.mark.parametrize(("a", "b", "same"), [("250 cm/s^2", "2.5 m/s^2", True), ("7 km/s", "7 m/s", False), ("4.5e-9 m", "4.5 nm", True), ("2.2 km", "2.2 m", False), ("6 pears", "6 m", None)])
def test_quantities(a, b, same):
    assert x.same_quantity(a, b) is same


def test_boxes():
    text = r"a \boxed{1} b \boxed{\frac{1}{2}} \boxed{open"
    assert x.boxed(text) == ["1", r"\frac{1}{2}"] and x.first_box(text) == "1" and x.last_box(text) is None
    assert x.boxed(r"\boxed{out \boxed{in}}") == [r"out \boxed{in}"] and x.last_box(r"\boxed{out \boxed{in}}") == "in"
    assert x.boxed(r"} \boxed{x} }") == ["x"] and x.boxed(None) == [] and x.boxed(r"\boxed{never \boxed{1}") == []
    assert x.answer("The answer is 4\nthen more") == "4" and x.answer("  plain ") == "plain"
    assert x.top_level_parts(r"(1,2), 3\,4, [5], ") == ["(1,2)", r"3\,4", "[5]"]
    assert x.sign_variants(r"\pm5\pm 1") == ["+5+1", "+5-1", "-5+1", "-5-1"] and x.sign_variants("7") == ["7"]


@pytest.mark.parametrize(("pred", "gold", "kind", "unit", "verdict"), [
    (r"so \boxed{3, 2}", "2, 3", "numerical", "", 1), ("1", "2,3", "numerical", "", 0), ("1", "", "numerical", "", 0), ("x", "x", "code", "", -1), ("x", "x", None, "", -1),
    (r"\boxed{7.2N}", "7.2", "numerical", "", -1), (r"\boxed{7.2}", "7.2", "NV", "N", 1), (r"\boxed{7200 mN}", "7.2", "NV", "N", 1), (r"\boxed{5 mN}", "7.2", "NV", "N", -1),
    (r"\boxed{2^{3^{4}}}", "8", "numerical", "", -1), (r"\boxed{4, k t}", [r"\boxed{4}", "t k"], ["NV", "EX"], "", 1), (r"\boxed{4, k}", "4, t", '["NV", "EX"]', "", 0),
    (r"\boxed{-3}", r"\pm 3", "numerical", "", 1), (r"\boxed{c}", "C", "MC", "", 1), ("No, never", r"\boxed{False}", "TF", "", 1), (r"\boxed{D}", "C", "mcq", "", 0), (r"\boxed{y = x}", "x", "EX", "", -1),
])
def test_verify(pred, gold, kind, unit, verdict):
    assert x.verify(pred, gold, kind, unit=unit) == verdict


def test_judge_is_asked_only_where_rules_say_no():
    asked = []

    def judge(pred, gold, problem):
        asked.append((pred, gold, problem))
        return True

    assert x.verify(r"\boxed{2}", "2", "numerical", judge=judge) == 1 and not asked
    assert x.verify(r"\boxed{0.5 u}", "0.5", "numerical", unit="nm", judge=judge, problem="q") == 1 and asked == [("0.5 u", "0.5 nm", "q")]


def test_verify_answer_columns(spark):
    from pyspark.sql import functions as F

    rows = [("3.1", "3.0", "numerical", ""), (r"\boxed{4000 mm}", "4", "NV", "m"), ("5", "4", "EX", ""), ("x", " ", "EX", ""), ("x", "x", "open_end", ""), (None, "1", "NV", ""), ("1", None, "NV", None), (r"\boxed{B}", "B", "MC", "")]
    df = spark.createDataFrame(rows, "p string, g string, k string, u string")
    got = [r[0] for r in df.select(x.verify_answer(F.col("p"), F.col("g"), F.col("k"), F.col("u"))).collect()]
    assert got == [x.verify(p, g, k, unit=u) for p, g, k, u in rows] == [1, 1, 0, 0, -1, 0, 0, 1]


def test_judged(spark):
    rows = [("a", "b", "q", -1.0), ("a", "b", "q", -1.0), ("a", "c", "q", -1.0), ("a", "b", "q", 0.0), (None, "b", None, -1.0)]
    df = spark.createDataFrame(rows, "pred string, gold string, problem string, verdict double")
    got = sorted(map(tuple, x.judged(df, lambda triples: [t[:2] == ("a", "b") for t in triples]).collect()), key=str)
    assert got == sorted([("a", "b", "q", 1.0), ("a", "b", "q", 1.0), ("a", "c", "q", 0.0), ("a", "b", "q", 0.0), (None, "b", None, 0.0)], key=str)

    def broken(triples):
        raise OSError

    assert {r["verdict"] for r in x.judged(df, broken).collect()} == {0.0}


def test_choice():
    assert x.choice(r"\boxed{c}", "mcq") == "C" and x.choice("N", "true_false") == "False" and x.choice(r"\boxed{1, 2}", "mcq") is None


def test_edit_score():
    assert x.edit_score("a+b", "b+a") == 100 and 0 < x.edit_score("a+2b+c", "a+b+c") < 60 and x.edit_score("", "a") == 0 and x.edit_score(r"\int x", "x") == 0
    assert x.tree_distance((("+", (("a", ()), ("b", ()))),), (("+", (("a", ()), ("c", ()))),)) == 1
    assert x.tree_distance((), (("+", (("a", ()), ("b", ()))),)) == 3
    big = ("+", tuple((c, ()) for c in "abcdefghi"))
    assert x.tree_distance((("*", (big, ("z", ()))),), (("*", (("z", ()),)),)) == 0.6 * 5 + 5


def test_pairs_off():
    assert x.pairs_off("2, 1", "1, 2", [1e-8]) and not x.pairs_off("1", "1, 2", [1e-8]) and x.pairs_off("50", "0.5", [1e-8]) and x.pairs_off("3.05", "3", [0.1])
    assert x.pairs_off("(0, 1]", "(0, 1]", []) and not x.pairs_off("[0, 1]", "(0, 1]", []) and x.pairs_off(r"(0, \frac{1}{2})\cup(3, 4)", r"(0, 0.5)\cup(3, 4)", [1e-6]) and x.pairs_off("x+x", "2x", [])
