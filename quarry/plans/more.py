"""More queries: gold answers, loaders' rules, rollups, samples and quality reports, with SQL twins.

The driver's tables hold no answers, so sample strings that fire each rule are dealt
to the rows of ``part`` by key, on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import answers as a
from quarry.functions import latex
from quarry.functions import text as t
from quarry.operators import dedup, report, rollouts, strata
from quarry.plans.catalog import ATTEMPTS, NORM, PROSE, Tables, attempts, query, r6
from quarry.sources import loaders

GOLDS = [
    "B", "(C)", "C. the third", r"\boxed{B}", r"(\mathrm{c})", r"\text{(B) both}", "ABD", "no choice here", "Yes, always", "F", r"\boxed{No, $x$}", "E_1=3, so it is false", "maybe",
    r"$3.5$", r"$$\frac{1}{2}$$", r"\[x+1\]", r"Therefore, the answer is: $\boxed{\frac{a}{b}}$", r"so \boxed{\sqrt{\frac{a}{\sqrt{b_{1}}}}} follows", r"\boxed{x}", r"The field is \(E=0\) inside",
    r"\\frac{a}{b} + \\pi", r"\frac{a}{b", "x = 3\n Then it rises", "This is a sentence that explains it all at length", r"Energy: $E$ and more", "x = 3 + 4 + 5 = 12", "it is approximately 3", "答案",
    "88.4%", r"8.2 \times 10^{-6}", "9.8 m/s^2", "9.8m", "100 widgets", "1.5e-3", "f(x=1)", "a=b", "2.5(1 - cos t)", "-q", "3, 4", r"\SI{3}{m}", r"x \in [0, 1]", r"5 \times 10^3 \text{ m}", r"\mathrm{~kJ} \cdot \mathrm{~mol}", "", r"12.5\text{uA}", "7 000",
]
LABELS = ["NV", "EX, EQ", '["MC", "TF"]', "Open-end", "nonsense", '["numerical"]', "[broken", "", "expression", "T/F"]


def listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sampled(d: Tables, values: list[str]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod("p_partkey", F.lit(len(values))) + 1).cast("int"))


def golds(d: Tables) -> DataFrame:
    return d.part.select("p_partkey", sampled(d, GOLDS).alias("gold"))


G = f"(SELECT p_partkey, list_extract({listed(GOLDS)}, CAST(p_partkey % {len(GOLDS)} AS INT) + 1) AS gold, trim(list_extract({listed(GOLDS)}, CAST(p_partkey % {len(GOLDS)} AS INT) + 1)) AS s FROM part)"


def sql_found(x: str, pattern: str, group: int = 1) -> str:
    return f"CASE WHEN regexp_matches({x}, '{pattern}') THEN regexp_extract({x}, '{pattern}', {group}) END"


def sql_dollars(x: str) -> str:
    x = f"trim({x})"
    return f"""CASE WHEN regexp_matches({x}, '(?s)^\\$\\$.*\\$\\$$') AND length({x}) >= 4 THEN trim(substr({x}, 3, length({x}) - 4)) WHEN regexp_matches({x}, '(?s)^\\$[^$]*\\$$') AND length({x}) >= 2 THEN trim(substr({x}, 2, length({x}) - 2))
    WHEN regexp_matches({x}, '(?s)^\\\\\\[.*\\\\\\]$') THEN trim(substr({x}, 3, length({x}) - 4)) ELSE {x} END"""


BOXED = f"trim({sql_found('s', a.BOX)})"
TRUTH_CASE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in a.TRUTH.items()) + " END"


# ---- gold answers


@query(f"""WITH u AS (SELECT p_partkey, s, trim(coalesce({BOXED}, s)) AS u FROM {G}), w AS (SELECT *, trim(coalesce({sql_found('u', a.WRAPPED)}, u)) AS w FROM u)
SELECT p_partkey, upper(coalesce({', '.join(sql_found('w', p) for p in a.LETTERS)})) AS choice,
coalesce({TRUTH_CASE.format("lower(rtrim(regexp_extract(u, '^[^' || chr(9) || chr(10) || ' ,;({[]*'), '.,'))")}, {TRUTH_CASE.format(f"regexp_extract(lower(u), '{a.TRUTH_WORD}')")}) AS truth FROM w""")
def choice_golds(d):
    g = F.col("gold")
    return golds(d).select("p_partkey", a.mcq_gold(g).alias("choice"), a.true_false_gold(g).alias("truth"))


@query(f"""WITH b AS (SELECT *, {BOXED} AS box FROM {G}),
c AS (SELECT *, {sql_dollars('box')} AS inner_box, {sql_dollars('s')} AS bare, regexp_extract_all(s, '(?s)\\\\\\((.*?)\\\\\\)', 1) || regexp_extract_all(s, '(?s)\\\\\\[(.*?)\\\\\\]', 1) AS blocks, gold AS x FROM b),
e AS (SELECT *, trim(blocks[1]) AS math FROM c)
SELECT p_partkey, CASE WHEN tag IN ('truncated_dropped', 'prose_dropped', 'prose_gold_dropped', 'non_latin_dropped', 'unchanged') THEN gold WHEN tag = 'prose_extracted' THEN inner_box WHEN tag = 'dollar_stripped' THEN bare WHEN tag = 'display_math_extracted' THEN math
ELSE replace(s, '\\\\', '\\') END AS clean, tag FROM (SELECT *, CASE
WHEN length(replace(s, '{{', '')) <> length(replace(s, '}}', '')) THEN 'truncated_dropped'
WHEN box <> '' AND s NOT IN ('\\boxed{{' || box || '}}', '$\\boxed{{' || box || '}}$', '$$\\boxed{{' || box || '}}$$') AND inner_box <> '' THEN 'prose_extracted'
WHEN bare <> s THEN 'dollar_stripped'
WHEN len(blocks) = 1 AND math <> '' AND s NOT IN ('\\(' || math || '\\)', '\\[' || math || '\\]') THEN 'display_math_extracted'
WHEN regexp_matches(s, '\\\\\\\\[a-zA-Z]') AND NOT regexp_matches(s, '(^|[^\\\\])\\\\[a-zA-Z]') THEN 'double_unescaped'
WHEN regexp_matches(s, '\\n\\s*[A-Za-z]') OR (regexp_matches(s, '{a.SENTENCE}') AND length(s) > 30) THEN 'prose_dropped'
WHEN {PROSE.replace("(x", "(s")} THEN 'prose_gold_dropped'
WHEN regexp_matches(s, '{t.NON_LATIN}') THEN 'non_latin_dropped' ELSE 'unchanged' END AS tag FROM e)""")
def cleaned_golds(d):
    return golds(d).select("p_partkey", a.clean_gold(F.col("gold")).alias("c")).select("p_partkey", "c.clean", "c.tag")


@query(rf"""WITH p AS (SELECT *, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(s, '\\(?:times|cdot)\s*10\^\{{?[+-]?[\d.]+\}}?', '', 'g')), '\\pm\s*[\d.]+', '', 'g')), '(\d)\s*[A-Za-z][A-Za-z0-9]*\s*$', '\1')) AS plain,
regexp_replace(regexp_replace(regexp_replace(s, '[({{\[][^(){{}}\[\]]*[)}}\]]', '', 'g'), '[({{\[][^(){{}}\[\]]*[)}}\]]', '', 'g'), '[({{\[][^(){{}}\[\]]*[)}}\]]', '', 'g') AS o FROM {G})
SELECT p_partkey, CASE WHEN s = '' THEN 'unknown' WHEN regexp_matches(s, '^([A-Z]|\([A-Z]\))$') THEN 'mcq' WHEN regexp_matches(s, '^[+-]?(\d+\.?\d*|\.\d+)\s*%$') OR try_cast(regexp_extract(s, '{a.SCIENTIFIC}', 1) AS DOUBLE) IS NOT NULL OR regexp_matches(plain, '{a.FLOAT}') THEN 'numerical'
WHEN contains(o, '=') THEN 'equation' WHEN regexp_matches(s, '{a.OPERATORS}') OR regexp_matches(s, '[\^_\\]') THEN 'expression'
WHEN regexp_matches(s, '\d') AND regexp_matches(s, '[a-zA-Z()+\-*/]') AND NOT contains(s, ',') AND length(s) <= 60 THEN 'expression' WHEN regexp_matches(s, '^[+-]?[a-zA-Z]\w*$') THEN 'expression'
WHEN regexp_matches(replace(replace(s, '×', 'e'), 'x', 'e'), '{a.FLOAT}') THEN 'numerical' ELSE 'unknown' END AS kind,
CASE WHEN regexp_matches(s, '{a.UNIT_COMMAND}') THEN 'latex_unit' WHEN regexp_matches(s, '{a.BARE_UNIT}') THEN 'bare_unit' WHEN regexp_matches(s, '\d\s+[A-Za-z][A-Za-z0-9/^]*\s*$') THEN 'fraction_unit' ELSE 'no_unit' END AS unit FROM p""")
def inferred_types(d):
    return golds(d).select("p_partkey", a.infer_type(F.col("gold")).alias("kind"), a.unit_kind(F.col("gold")).alias("unit"))


def _sql_replaced() -> str:
    out = "CASE WHEN contains(gold, '\\in ') THEN split_part(gold, '\\in ', 2) ELSE gold END"
    for token, other in a.TOKENS.items():
        out = f"replace({out}, '{token}', '{other.replace(chr(39), chr(39) * 2)}')"
    return out


@query(rf"""SELECT p_partkey, regexp_replace(trim({_sql_replaced()}, chr(10) || '{a.EDGES[1:]}'), '\\(?:mathrm|mathbf)\{{~?([^}}]*)\}}', '\1', 'g') AS formula,
try_cast({sql_found("regexp_replace(regexp_replace(s, '[${}]', '', 'g'), '\\\\[,;$]|\\s+', '', 'g')", r"^([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)")} AS DOUBLE) AS number,
length(list_extract(regexp_extract_all(gold, '\\boxed\{{((?:[^{{}}]|\{{[^{{}}]*\}})*)\}}', 1), 1)) AS box_chars FROM {G}""".replace(r"\\\\[,;$]", r"\\[,;$]").replace(r"|\\s+", r"|\s+"))
def plain_golds(d):
    g = F.col("gold")
    return golds(d).select("p_partkey", a.plain_latex(g).alias("formula"), a.leading_number(g).alias("number"), F.length(F.get(a.flat_boxes(g), F.lit(0))).cast("long").alias("box_chars"))


L = f"(SELECT p_partkey, list_extract({listed(LABELS)}, CAST(p_partkey % {len(LABELS)} AS INT) + 1) AS label FROM part)"
CANON = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.CANONICAL_TYPES.items()) + " ELSE 'unknown' END"


@query(f"""WITH p AS (SELECT *, CASE WHEN label LIKE '[%' AND json_valid(label) THEN from_json(label, '["VARCHAR"]') ELSE list_filter(list_transform(string_split(label, ','), lambda x: trim(x)), lambda x: x <> '') END AS parts FROM {L})
SELECT p_partkey, array_to_string(list_transform(CASE WHEN len(parts) = 0 THEN [''] ELSE parts END, lambda x: {CANON.format('x')}), '|') AS kinds, CASE WHEN label LIKE '[%' THEN 'multi-part' ELSE label END AS main,
CASE WHEN label LIKE '[%' THEN 'multi' WHEN label IN ('numerical', 'expression', 'equation', 'mcq') THEN label ELSE 'other' END AS coarse, CASE WHEN label LIKE '[%' AND json_valid(label) THEN 'multi(' || len(parts) || ')-' || parts[1] ELSE label END AS counted FROM p""")
def normalized_types(d):
    x = d.part.select("p_partkey", sampled(d, LABELS).alias("label"))
    c = F.col("label")
    return x.select("p_partkey", F.array_join(a.normalize_types(c), "|").alias("kinds"), a.primary_type(c).alias("main"), a.coarse_type(c).alias("coarse"), a.counted_type(c).alias("counted"))


PROBLEMS = ["Explain why.", "What is shown in the figure?", "Find x.", "See diagram 3", "计算 x", "See Fig. 2 first", "describe it", "A body falls."]
KINDS = ["mcq", "true_false", "numerical", ""]


@query(f"""WITH q AS (SELECT p_partkey, s, list_extract({listed(PROBLEMS)}, CAST(p_partkey // 7 % {len(PROBLEMS)} AS INT) + 1) AS problem, list_extract({listed(KINDS)}, CAST(p_partkey // 3 % {len(KINDS)} AS INT) + 1) AS kind, CASE WHEN p_partkey % 13 = 0 THEN 'zh' END AS lang FROM {G}),
u AS (SELECT *, trim(coalesce({BOXED}, s)) AS u FROM q), w AS (SELECT *, trim(coalesce({sql_found('u', a.WRAPPED)}, u)) AS w FROM u)
SELECT p_partkey, CASE WHEN lang = 'zh' THEN 'non_english_language' WHEN regexp_matches(problem, '{t.EXPLAIN}') THEN 'explanation_primary' WHEN regexp_matches(s, '{t.NON_LATIN}') THEN 'non_latin_script_gold'
WHEN kind = 'mcq' AND coalesce({', '.join(sql_found('w', p) for p in a.LETTERS)}) IS NULL THEN 'mcq_unrecoverable'
WHEN kind = 'true_false' AND coalesce({TRUTH_CASE.format("lower(rtrim(regexp_extract(u, '^[^' || chr(9) || chr(10) || ' ,;({[]*'), '.,'))")}, {TRUTH_CASE.format(f"regexp_extract(lower(u), '{a.TRUTH_WORD}')")}) IS NULL THEN 'tf_unrecoverable' END AS filter_reason,
regexp_matches(problem, '{t.FIGURE}') AS figure, regexp_matches(problem, '[一-鿿]') AS cjk FROM w""")
def rules_fired(d):
    x = d.part.select("p_partkey", sampled(d, GOLDS).alias("gold"), F.element_at(F.array(*map(F.lit, PROBLEMS)), (F.floor(F.col("p_partkey") / 7) % len(PROBLEMS) + 1).cast("int")).alias("problem"),
                      F.element_at(F.array(*map(F.lit, KINDS)), (F.floor(F.col("p_partkey") / 3) % len(KINDS) + 1).cast("int")).alias("kind"), F.when(F.col("p_partkey") % 13 == 0, "zh").alias("lang"))
    return x.select("p_partkey", t.filter_reason(F.col("problem"), F.col("gold"), F.col("lang"), F.col("kind")).alias("filter_reason"), t.figure_reference(F.col("problem")).alias("figure"), a.has_cjk(F.col("problem")).alias("cjk"))


# ---- verification


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE l_linenumber % 6 WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN abs(l_quantity * (1 + l_tax) - l_quantity) / abs(l_quantity) <= 0.05 THEN 1.0 ELSE 0.0 END WHEN 2 THEN 1.0 WHEN 3 THEN CASE WHEN l_quantity = 1 THEN 1.0 ELSE 0.0 END WHEN 4 THEN 0.0 ELSE -1.0 END AS verdict FROM lineitem""")
def verdicts(d):
    """Answers with a unit to convert, a tolerance, two parts in either order, a wrong one, a wrong number of parts, and a unit on one side only."""
    q = F.col("l_quantity").cast("bigint").cast("string")
    turn = F.col("l_linenumber") % 6
    near = (F.col("l_quantity") * (1 + F.col("l_tax"))).cast("string")
    pred = (
        F.when(turn == 0, F.concat(F.lit("so \\boxed{"), q, F.lit("000 mm}"))).when(turn == 1, F.concat(F.lit("the answer is "), near)).when(turn == 2, F.concat(F.lit("\\boxed{7, "), q, F.lit("}")))
        .when(turn == 3, F.concat(F.lit("\\boxed{"), q, F.lit("}"))).when(turn == 4, F.concat(F.lit("\\boxed{"), q, F.lit(", 1}"))).otherwise(F.concat(F.lit("\\boxed{"), q, F.lit("N}")))
    )
    gold = F.when(turn == 2, F.concat(q, F.lit(", 7"))).when(turn == 3, F.lit("1")).otherwise(q)
    verdict = latex.verify_answer(pred, gold, F.lit("numerical"), F.when(turn == 0, "m").otherwise(""))
    return d.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", verdict.cast("decimal(2,1)").alias("verdict"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, abs(l_quantity * (1 + l_tax) - l_quantity) <= 0.01 * l_quantity AS correct, regexp_replace(l_comment, '\\s+', '', 'g') = regexp_replace(l_shipmode, '\\s+', '', 'g') AS boxed FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN ' ' || l_shipmode ELSE 'x' END AS l_comment FROM (SELECT *, l_returnflag || ' ' || l_linestatus AS l_shipmode FROM lineitem))")
def scored_answers(d):
    q, mode = F.col("l_quantity"), F.concat_ws(" ", "l_returnflag", "l_linestatus")
    pred = F.concat(F.lit("\\boxed{0} then \\boxed{"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit(" "), mode)).otherwise("x"), F.lit("}"))
    return d.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", a.within_percent(q * (1 + F.col("l_tax")), q).alias("correct"), a.same_box(pred, mode).alias("boxed"))


# ---- attempts


@query(f"SELECT user_id, count(*) AS n_rollouts, count(*) FILTER (WHERE correct) AS n_correct, bool_or(correct) AS solved, arg_min(event_type, rollout) AS event_type, round(arg_min(value, rollout), 6) AS value, round(count(*) FILTER (WHERE correct) / count(*), 6) AS pass_fraction FROM {ATTEMPTS} GROUP BY user_id")
def rollup_with_firsts(d):
    p = rollouts.profile(attempts(d), "user_id", "rollout", "event_type", "value")
    return p.select("user_id", "n_rollouts", "n_correct", "solved", "event_type", r6("value", "value"), r6("pass_fraction", "pass_fraction"))


VERDICTS = "(SELECT event_type, CASE WHEN value > 50 THEN 1 WHEN value > 20 THEN 0 ELSE -1 END AS verdict, user_id % 3 = 0 AS truncated FROM events)"


@query(f"SELECT event_type, count(*) AS n, round(count(*) FILTER (WHERE verdict = 1) / count(*), 6) AS pass_rate, round(count(*) FILTER (WHERE verdict = 1) / nullif(count(*) FILTER (WHERE NOT truncated), 0), 6) AS pass_rate_whole, round(count(*) FILTER (WHERE verdict = 1) / nullif(count(*) FILTER (WHERE verdict >= 0), 0), 6) AS pass_rate_judged FROM {VERDICTS} GROUP BY event_type")
def pass_rates(d):
    v = F.when(F.col("value") > 50, 1).when(F.col("value") > 20, 0).otherwise(-1)
    out = rollouts.rates(d.events.select("event_type", v.alias("verdict"), (F.col("user_id") % 3 == 0).alias("truncated")), "event_type")
    return out.select("event_type", "n", *(r6(c, c) for c in ("pass_rate", "pass_rate_whole", "pass_rate_judged")))


@query("SELECT c_mktsegment, list_sort(list(c_custkey))[CAST(round_even(0.9 * (count(*) - 1), 0) AS INT) + 1] AS p90, list_sort(list(c_custkey))[CAST(round_even(0.5 * (count(*) - 1), 0) AS INT) + 1] AS p50 FROM customer GROUP BY c_mktsegment")
def nearest_ranks(d):
    return d.customer.groupBy("c_mktsegment").agg(rollouts.nearest_rank(F.col("c_custkey"), 0.9).alias("p90"), rollouts.nearest_rank(F.col("c_custkey"), 0.5).alias("p50"))


PER_TYPE = f"(SELECT event_type, user_id, count(*) AS n, count(*) FILTER (WHERE correct) AS c FROM {ATTEMPTS} GROUP BY ALL)"


@query(f"SELECT event_type, CAST(round_even(c / n * 8, 0) AS BIGINT) AS bin, count(*) AS n, round(avg(CASE WHEN c = 0 OR c = n THEN 1.0 ELSE 0.0 END), 6) AS saturated FROM {PER_TYPE} GROUP BY ALL")
def saturation_by_type(d):
    p = rollouts.per_problem(attempts(d), "event_type", "user_id").withColumn("bin", F.bround(F.col("pass_fraction") * 8).cast("long"))
    return rollouts.saturation(p, "event_type", "bin").select("event_type", "bin", "n", r6("saturated", "saturated"))


@query(f"""WITH z AS (SELECT event_type, avg(c / n) AS rate, count(*) AS size FROM {PER_TYPE} GROUP BY event_type)
SELECT event_type, round(rate, 6) AS rate, rate BETWEEN 0.15 AND 0.85 AS zone, sum(CASE WHEN rate BETWEEN 0.15 AND 0.85 THEN size ELSE 0 END) OVER () AS effective, CASE WHEN count(*) FILTER (WHERE rate BETWEEN 0.15 AND 0.85) OVER () >= 2 THEN 'go' ELSE 'stop' END AS gate FROM z""")
def goldilocks_zones(d):
    p = rollouts.per_problem(attempts(d), "event_type", "user_id")
    z = p.groupBy("event_type").agg(F.avg("pass_fraction").alias("rate"), F.count("*").alias("size")).withColumn("zone", F.col("rate").between(0.15, 0.85))
    every = Window.partitionBy()  # over a row for each type
    return z.select("event_type", r6("rate", "rate"), "zone", F.sum(F.when(F.col("zone"), F.col("size")).otherwise(0)).over(every).alias("effective"), F.when(F.count_if("zone").over(every) >= 2, "go").otherwise("stop").alias("gate"))


@query("SELECT event_type, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS rule, round(avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END), 6) AS judge, round(avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS delta, count(*) FILTER (WHERE value > 40 AND value <= 50) AS rescued, count(*) FILTER (WHERE value > 50 AND value <= 40) AS regressed FROM events GROUP BY event_type")
def rule_against_judge(d):
    rule, judge = F.col("value") > 50, F.col("value") > 40
    return d.events.groupBy("event_type").agg(r6(F.avg(rule.cast("double")), "rule"), r6(F.avg(judge.cast("double")), "judge"), r6(F.avg(judge.cast("double")) - F.avg(rule.cast("double")), "delta"), F.count_if(judge & ~rule).alias("rescued"), F.count_if(rule & ~judge).alias("regressed"))


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS called, round(count(*) FILTER (WHERE l_linestatus = 'F' AND l_discount > 0.05) / nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0), 6) AS ok_if_called, round(count(*) FILTER (WHERE l_linestatus <> 'F' AND l_discount > 0.05) / nullif(count(*) FILTER (WHERE l_linestatus <> 'F'), 0), 6) AS ok_if_not FROM lineitem GROUP BY l_returnflag")
def conditional_rates(d):
    called, ok = F.col("l_linestatus") == "F", F.col("l_discount") > 0.05
    share = lambda c: F.try_divide(F.count_if(c & ok), F.count_if(c))
    return d.lineitem.groupBy("l_returnflag").agg(F.count_if(called).alias("called"), r6(share(called), "ok_if_called"), r6(share(~called), "ok_if_not"))


EDGES, NAMES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], ["1", "2", "3", "4", "5"]


@query(f"""SELECT b.low, b.closed, b.fifths, count(*) AS n FROM (SELECT CASE WHEN r <= 0 THEN 'low' WHEN r <= 0.375 THEN 'medium' ELSE 'high' END AS low, CASE WHEN r >= 0 AND r <= 0.2 THEN '1' WHEN r > 0.2 AND r <= 0.4 THEN '2' WHEN r > 0.4 AND r <= 0.6 THEN '3' WHEN r > 0.6 AND r <= 0.8 THEN '4' WHEN r > 0.8 AND r <= 1 THEN '5' END AS closed,
CASE WHEN r >= 0 AND r < 0.2 THEN '1' WHEN r >= 0.2 AND r < 0.4 THEN '2' WHEN r >= 0.4 AND r < 0.6 THEN '3' WHEN r >= 0.6 AND r < 0.8 THEN '4' WHEN r >= 0.8 AND r < 1.01 THEN '5' ELSE 'unknown' END AS fifths FROM (SELECT c / n AS r FROM {PER_TYPE})) b GROUP BY ALL""")
def difficulty_bins(d):
    r = F.col("pass_fraction")
    p = rollouts.per_problem(attempts(d), "event_type", "user_id")
    fifths = F.coalesce(t.cut(r, [*EDGES[:-1], 1.01], NAMES, right=False), F.lit("unknown"))
    return p.groupBy(t.difficulty_bin(r).alias("low"), t.cut(r, EDGES, NAMES, lowest=True).alias("closed"), fifths.alias("fifths")).agg(F.count("*").alias("n"))


# ---- joins


@query("SELECT x.l_orderkey, x.l_linenumber, count(*) AS n, bool_and(x.l_quantity >= y.l_quantity) AS more FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber WHERE x.l_returnflag = 'R' GROUP BY ALL")
def two_key_join(d):
    keys = ["l_orderkey", "l_linenumber"]
    x = d.lineitem.where("l_returnflag = 'R'").select(*keys, F.col("l_quantity").alias("p"))
    return x.join(d.lineitem.select(*keys, F.col("l_quantity").alias("q")), keys).groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and(F.col("p") >= F.col("q")).alias("more"))


@query("SELECT source, lang, count(*) FILTER (WHERE toxic = 1) AS n_bad, count(*) AS n, round(count(*) FILTER (WHERE toxic = 1) / count(*), 6) AS share FROM documents JOIN labels USING (doc_id) GROUP BY ALL HAVING n_bad > 0")
def aggregate_join(d):
    j = d.documents.select("doc_id", "source", "lang").join(d.labels, "doc_id")
    g = j.groupBy("source", "lang").agg(F.count_if(F.col("toxic") == 1).alias("n_bad"), F.count("*").alias("n"))
    return g.where("n_bad > 0").withColumn("share", F.round(F.col("n_bad") / F.col("n"), 6))


@query("SELECT place, c_custkey, c_name FROM (SELECT unnest([5, 3, 3, 11, 999999999]) AS id, generate_subscripts([5, 3, 3, 11, 999999999], 1) - 1 AS place) JOIN customer ON c_custkey = id")
def ordered_gather(d):
    asked = d.spark.range(1).select(F.posexplode(F.array(*map(F.lit, (5, 3, 3, 11, 999999999)))).alias("place", "id"))  # a stated list
    return d.customer.join(F.broadcast(asked), F.col("c_custkey") == F.col("id")).select("place", "c_custkey", "c_name")


# ---- samples


@query("""WITH s AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), k AS (SELECT *, CAST(greatest(1, round_even(100 * n / sum(n) OVER (), 0)) AS BIGINT) AS d0, CAST(greatest(1, round_even(120 * n / sum(n) OVER (), 0)) AS BIGINT) AS t0 FROM s),
f AS (SELECT p_brand, n, CASE WHEN n < 3 THEN 0 WHEN d0 + t0 >= n THEN greatest(1, n // 3) ELSE d0 END AS dv, CASE WHEN n < 3 THEN 0 WHEN d0 + t0 >= n THEN greatest(1, n // 3) ELSE t0 END AS ts FROM k),
m AS (SELECT *, 100 - sum(dv) OVER () AS od, 120 - sum(ts) OVER () AS ot, row_number() OVER (ORDER BY CASE WHEN dv > 0 THEN n END DESC NULLS LAST, p_brand) - 1 AS rd, row_number() OVER (ORDER BY CASE WHEN ts > 0 THEN n END DESC NULLS LAST, p_brand) - 1 AS rt, greatest(count(*) FILTER (WHERE dv > 0) OVER (), 1) AS md, greatest(count(*) FILTER (WHERE ts > 0) OVER (), 1) AS mt FROM f),
x AS (SELECT *, greatest(0, ceil((abs(od) - rd) / md)) AS sd, greatest(0, ceil((abs(ot) - rt) / mt)) AS st FROM m),
z AS (SELECT p_brand, CASE WHEN dv = 0 THEN 0 WHEN od > 0 THEN dv + least(sd, n - 1 - dv) ELSE dv - least(sd, dv - 1) END AS dv, CASE WHEN ts = 0 THEN 0 WHEN ot > 0 THEN ts + least(st, n - 1 - ts) ELSE ts - least(st, ts - 1) END AS ts FROM x),
r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42|' || p_partkey), p_partkey) AS i FROM part)
SELECT p_partkey, p_brand, CASE WHEN i <= dv THEN 'dev' WHEN i <= dv + ts THEN 'test' ELSE 'train' END AS part FROM r JOIN z USING (p_brand)""")
def exact_split(d):
    return strata.split_exact(d.part.select("p_partkey", "p_brand"), "p_brand", "p_partkey", 100, 120)


def _sql_share(n: int, least: int) -> str:
    return f"""WITH s AS (SELECT p_brand, greatest({least}, round_even({n} * count(*) / sum(count(*)) OVER (), 0)) AS take FROM part GROUP BY p_brand),
    r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42|' || p_partkey), p_partkey) AS i FROM part)
    SELECT p_partkey, p_brand FROM r JOIN s USING (p_brand) ORDER BY i > take, md5('43|' || p_partkey), p_partkey LIMIT {n}"""


@query(_sql_share(97, 1))
def proportional_sample(d):
    return strata.proportional(d.part.select("p_partkey", "p_brand"), "p_brand", "p_partkey", 97)


@query(_sql_share(150, 6))
def proportional_with_floor(d):
    return strata.proportional(d.part.select("p_partkey", "p_brand"), "p_brand", "p_partkey", 150, 6)


@query("""SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY side, md5('42|' || c_custkey), c_custkey) AS i
FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 1 END AS side FROM customer)) WHERE i <= 20""")
def balanced_types(d):
    c = d.customer.select("c_custkey", "c_mktsegment")
    return strata.balance(c.where("c_custkey % 10 = 0"), c, "c_mktsegment", "c_custkey", 20)


@query("SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY md5('42|' || c_custkey), c_custkey) <= floor(count(*) OVER () * 0.9) THEN 'head' ELSE 'tail' END AS part FROM customer")
def head_tail_split(d):
    return strata.head_tail(d.customer.select("c_custkey"), "c_custkey")


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <= 3 AS validation FROM customer")
def first_three(d):
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey"))
    return d.customer.select("c_custkey", (place <= 3).alias("validation"))


# ---- contamination reports


@query(f"""WITH e AS (SELECT DISTINCT {NORM} AS norm, item_id % 5 AS origin FROM benchmark WHERE text IS NOT NULL), k AS (SELECT source, {NORM} AS norm FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (WHERE norm IN (SELECT norm FROM e)) AS n_found, CASE WHEN count(*) FILTER (WHERE norm IN (SELECT norm FROM e)) > 0.3 * count(*) THEN 'warn' ELSE 'ok' END AS advice FROM k GROUP BY source""")
def contamination_by_source(d):
    found = dedup.contaminated(d.documents, d.benchmark, t.exact_key(F.col("text"))).groupBy("source").agg(F.count("*").alias("n_found"))
    n = d.documents.groupBy("source").agg(F.count("*").alias("n")).join(found, "source", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    return n.withColumn("advice", F.when(F.col("n_found") > 0.3 * F.col("n"), "warn").otherwise("ok"))


@query("SELECT source, lang, count(*) AS n, count(DISTINCT md5(text)) AS n_texts FROM documents GROUP BY CUBE (source, lang)")
def corpus_overlap(d):
    return d.documents.cube("source", "lang").agg(F.count("*").alias("n"), F.count_distinct(F.md5("text")).alias("n_texts"))


# ---- quality reports


@query(f"""WITH x AS (SELECT source, text, lang, n_chars, length(text) AS n FROM documents)
SELECT check_name, source, n_rows, n_bad FROM (SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE text IS NULL) AS null_text, count(*) FILTER (WHERE text = '') AS empty_text, count(*) FILTER (WHERE n_chars IS DISTINCT FROM n) AS wrong_length, count(*) FILTER (WHERE lang NOT IN ('en', 'de', 'fr', 'es')) AS unknown_lang,
count(*) FILTER (WHERE n > 20000) AS very_long, count(*) FILTER (WHERE text LIKE '%\\boxed{{%') AS boxed, count(*) FILTER (WHERE text LIKE '%<tool_call>%') AS tool_tags FROM x GROUP BY source) UNPIVOT (n_bad FOR check_name IN (null_text, empty_text, wrong_length, unknown_lang, very_long, boxed, tool_tags))""")
def quality_report(d):
    text, n = F.col("text"), F.length("text")
    return report.violations(d.documents, "source", {
        "null_text": text.isNull(), "empty_text": text == "", "wrong_length": ~F.col("n_chars").eqNullSafe(n), "unknown_lang": ~F.col("lang").isin("en", "de", "fr", "es"),
        "very_long": n > 20000, "boxed": F.contains(text, F.lit("\\boxed{")), "tool_tags": F.contains(text, F.lit("<tool_call>")),
    })


@query("SELECT 'source' AS col, count(*) FILTER (WHERE source IS NULL) AS n_null, count(DISTINCT source) AS n_values, round(100 * count(*) FILTER (WHERE source IS NULL) / count(*), 6) AS pct FROM documents UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL), count(DISTINCT lang), round(100 * count(*) FILTER (WHERE lang IS NULL) / count(*), 6) FROM documents UNION ALL SELECT 'n_chars', count(*) FILTER (WHERE n_chars IS NULL), count(DISTINCT n_chars), round(100 * count(*) FILTER (WHERE n_chars IS NULL) / count(*), 6) FROM documents")
def column_profile(d):
    return report.profile(d.documents.select("source", "lang", "n_chars")).withColumn("pct", F.round("pct", 6))


@query("SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labels)) AS n_dup FROM labels")
def duplicate_rows(d):
    return report.duplicates(d.labels)


@query("SELECT lang AS value, count(*) AS n, count(*) <= 5 AS rare, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang")
def rare_values(d):
    return report.distribution(d.documents, "lang").withColumn("share", F.round("share", 6))


@query("SELECT check_name, held FROM (SELECT (SELECT count(*) FROM documents) >= 100 AS enough_rows, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) = 0 AS unique_ids, (SELECT count(*) FROM (SELECT item_id FROM benchmark INTERSECT SELECT doc_id FROM documents WHERE doc_id < 0)) = 0 AS disjoint) UNPIVOT (held FOR check_name IN (enough_rows, unique_ids, disjoint))")
def gates(d):
    twice = d.documents.groupBy("doc_id").count().where("count > 1")
    met = d.benchmark.select(F.col("item_id").alias("doc_id")).intersect(d.documents.where("doc_id < 0").select("doc_id"))
    return report.gates({"enough_rows": d.documents.agg((F.count("*") >= 100).alias("held")), "unique_ids": twice.agg((F.count("*") == 0).alias("held")), "disjoint": met.agg((F.count("*") == 0).alias("held"))})


# ---- loaders


@query("""SELECT 'PHYBench_' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS problem_id, p_name AS problem, p_type AS answer, 'symbolic' AS answer_type, 'PHYBench' AS source, p_brand AS domain, 'train_candidate' AS split FROM part WHERE trim(p_name) <> '' AND p_partkey % 4 <> 0""")
def load_symbolic(d):
    raw = d.part.select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("content"), F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.col("p_type")).alias("answer"), F.col("p_brand").alias("tag"))
    return loaders.phybench(raw).select("problem_id", "problem", F.col("answer")[0].alias("answer"), F.col("answer_type")[0].alias("answer_type"), "source", "domain", "split")


DIRTY = ["NV\n  \nThe answer", "EX\n```", "\\\nMC", "NV, NV", "TF", "lower", "`EQ`"]


@query(f"""WITH x AS (SELECT p_partkey, list_extract({listed(DIRTY)}, CAST(p_partkey % {len(DIRTY)} AS INT) + 1) AS raw FROM part),
y AS (SELECT *, list_filter(list_transform(string_split(raw, chr(10)), lambda l: regexp_extract(trim(regexp_replace(l, '`+', '', 'g')), '^([A-Z][A-Z](,\\s*[A-Z][A-Z])*)$|^[A-Z][A-Z]')), lambda l: l <> '') AS hits FROM x)
SELECT p_partkey, CASE WHEN len(hits) > 0 THEN hits[1] ELSE trim(string_split(raw, chr(10))[1]) END AS label FROM y""")
def dirty_labels(d):
    return d.part.select("p_partkey", loaders.clean_label(sampled(d, DIRTY)).alias("label"))
