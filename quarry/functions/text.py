"""Native column functions over question and answer texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and tables that results must agree with.
SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PUNCTUATION = r"[^\p{L}\p{N}\s\\{}^_]"
FIGURE = (
    r"(?i)shown in (the |a )?(figure|diagram|graph|image|table|circuit|plot)"
    r"|(see|refer to|from|in) (the |a )?(figure|diagram|image|circuit|table)"
    r"|(figure|diagram|image|circuit) (above|below|\d+)|as (shown|depicted|illustrated|given) (in|by|below|above)"
    r"|the (circuit|diagram|figure|image|graph) (shows|represents|depicts)|\bfig\.\s*\d+"
)
NON_LATIN = "[一-鿿぀-ヿ㐀-䶿؀-ۿऀ-ॿ가-힯]"
EXPLAIN = r"(?i)^(explain|describe|discuss)\b"
PLACEHOLDER = r"^\\boxed\{C_?\{?[12]\}?,\s*C_?\{?[12]\}?\}$"
CANONICAL_TYPES = {
    "Numerical": "numerical", "NV": "numerical", "numerical": "numerical", "Expression": "expression", "EX": "expression", "expression": "expression",
    "symbolic": "expression", "Equation": "equation", "EQ": "equation", "equation": "equation", "Interval": "interval", "IN": "interval", "interval": "interval",
    "MCQ": "mcq", "MC": "mcq", "mcq": "mcq", "True/False": "true_false", "TF": "true_false", "T/F": "true_false", "true_false": "true_false",
    "Open-end": "open_end", "open_end": "open_end", "code": "code",
}
SOURCE_PRIORITY = {"OlympiadBench": 5, "PHYSICS": 4, "UGPhysics": 3, "PHYBench": 2, "SciBench": 1}
PROSE_PATTERNS = {
    "chain": r"^[A-Za-z_]\s*=\s*.{5,}=\s*[0-9]", "markup": r"[\\{}_^]", "two_words": r"[a-z]{4,}\s[a-z]{4,}", "sentence": r"^[A-Z][a-z]+ [a-z]",
    "label": r"[A-Za-z]{3,}:\s*[$\\]", "line": r"\n\s*[A-Za-z]", "approx": r"\\approx\s*[-−]?[0-9]", "approximately": r"(?i)\bapproximately\s+[-−]?[0-9]",
}
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def normalize_question(text: Column) -> Column:
    collapsed = F.regexp_replace(F.lower(text), f"{SPACE}+", " ")
    return F.trim(F.regexp_replace(collapsed, PUNCTUATION, ""))


def exact_key(text: Column) -> Column:
    return F.sha2(normalize_question(text), 256)


def light_key(text: Column) -> Column:
    return F.md5(F.trim(F.regexp_replace(F.lower(text), f"{SPACE}+", " ")))


def problem_hash(problem: Column, gold: Column) -> Column:
    return F.substring(F.md5(F.concat(F.coalesce(problem, F.lit("")), F.lit("|||"), F.coalesce(gold, F.lit("")))), 1, 16)


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams; empty for shorter texts. One pass: a look-ahead at each character takes the n that begin there."""
    grams = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return F.when(F.length(text) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def figure_reference(text: Column) -> Column:
    return F.coalesce(text.rlike(FIGURE), F.lit(False))


def non_latin(text: Column) -> Column:
    return F.coalesce(text.rlike(NON_LATIN), F.lit(False))


def garbled_unit(unit: Column) -> Column:
    """Non-ASCII characters other than the ångström sign."""
    return F.coalesce(F.replace(unit, F.lit("Å"), F.lit("")).rlike(r"[^\x00-\x7F]"), F.lit(False))


def canonical_type(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CANONICAL_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.trim(label)), F.lit("unknown"))


def filter_reason(problem: Column, gold: Column, language: Column, kind: Column | None = None) -> Column:
    """The first rule that a row breaks, or null. With ``kind`` (the answer type), choices that can't be read break one too."""
    from quarry.functions import answers

    kind = F.lower(F.trim(F.coalesce(kind if kind is not None else F.lit(""), F.lit(""))))
    lang = F.lower(F.trim(F.coalesce(language, F.lit("en"))))
    return (
        F.when(~lang.isin("en", "", "nan"), "non_english_language")
        .when(F.trim(problem).rlike(EXPLAIN), "explanation_primary")
        .when(F.trim(gold).rlike(PLACEHOLDER), "placeholder_gold")
        .when(non_latin(gold), "non_latin_script_gold")
        .when((kind == "mcq") & answers.mcq_gold(gold).isNull(), "mcq_unrecoverable")
        .when((kind == "true_false") & answers.true_false_gold(gold).isNull(), "tf_unrecoverable")
    )


def brace_balance(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))) - (F.length(text) - F.length(F.replace(text, F.lit("}"), F.lit(""))))


def prose_gold(text: Column) -> Column:
    """Answers that narrate: any of seven tests."""
    p, long = PROSE_PATTERNS, F.length(text)
    plain = (long > 60) & ~text.rlike(p["markup"]) & text.rlike(p["two_words"])
    told = plain | (text.rlike(p["sentence"]) & (long > 40))
    for name in ("chain", "label", "line", "approx", "approximately"):
        told = told | text.rlike(p[name])
    return F.coalesce(told, F.lit(False))


def strip_dollars(text: Column) -> Column:
    """Drop one pair of $$, $ or \\[ \\] around a text."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"(?s)^\$\$.*\$\$$") & (F.length(t) >= 4), F.trim(F.substring(t, F.lit(3), F.length(t) - 4)))
        .when(t.rlike(r"(?s)^\$[^$]*\$$"), F.trim(F.substring(t, F.lit(2), F.length(t) - 2)))
        .when(t.rlike(r"(?s)^\\\[.*\\\]$"), F.trim(F.substring(t, F.lit(3), F.length(t) - 4)))
        .otherwise(t)
    )


def number(text: Column) -> Column:
    """A double, or null where the text is no plain number."""
    t = F.trim(text)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def within_tolerance(pred: Column, gold: Column, tolerance: float = 0.05) -> Column:
    """Relative tolerance; absolute where the gold value is next to zero."""
    return F.when(F.abs(gold) < 1e-12, F.abs(pred) < tolerance).otherwise(F.abs(pred - gold) <= tolerance * F.abs(gold))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")


def token_estimate(text: Column) -> Column:
    return F.length(text) / 3.5


def band(rate: Column) -> Column:
    """Pass-rate bands with right-closed edges; at n = 8, 1/8 lies in the band of 2/8 and 3/8."""
    return (
        F.when(rate <= 0.001, "0").when(rate <= 0.124, "1/8").when(rate <= 0.375, "2-3/8").when(rate <= 0.624, "4-5/8").when(rate <= 0.875, "6-7/8").otherwise("8/8")
    )


def difficulty_bin(x: Column) -> Column:
    return F.when(x.isNull() | (x <= 0), "low").when(x <= 0.375, "medium").otherwise("high")


def cut(x: Column, edges: list[float], labels: list[str], lowest: bool = False, right: bool = True) -> Column:
    """The bin of a number: closed on the right, or on the left; null outside. ``lowest``: the first edge belongs to its bin."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = (x > low) & (x <= high) if right else (x >= low) & (x < high)
        if lowest and low == edges[0]:
            inside = inside | (x == low)
        out = F.when(inside, label).otherwise(out)
    return out
