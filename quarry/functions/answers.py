"""Native column functions over gold answers: unboxing, cleaning, types, choices, units.

Balanced braces aren't regular; ``first_box`` follows them to five levels, which
compiled expressions can say. Deeper boxes count as none; ``latex.boxed`` has no limit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as t

# Patterns and tables that results must agree with.
WRAPPED = r"(?s)^\\(?:text|mathrm|mathbf)\{(.*)\}$"
LETTERS = [r"^\(\\?(?:mathrm|text|mathbf)\{([A-Za-z]{1,3})\}\)$", r"^\(([A-Za-z]{1,3})\)$", r"^\(?([A-Za-z]{1,3})\)?(?:[.):\s*\-]|$)"]
TRUTH = {"yes": "True", "y": "True", "t": "True", "true": "True", "no": "False", "n": "False", "f": "False", "false": "False"}
TRUTH_WORD = r"\b(yes|no|true|false)\b"
OPERATORS = (
    r"\\(?:frac|sqrt|pi|alpha|beta|gamma|delta|omega|lambda|mu|nu|sigma|phi|psi|theta|int|sum|prod"
    r"|partial|nabla|infty|pm|mp|leq|geq|neq)"
)
SCIENTIFIC = r"^[+-]?([\d.]+)\s*\\(?:times|cdot)\s*10\^\{?([+-]?[\d.]+)\}?$"
UNIT_COMMAND = (
    r"\\(?:text|mathrm|rm)\{[^}]+\}|\\(?:si|SI)\{[^}]+\}"
    r"|\\(?:meter|kilogram|second|ampere|kelvin|mole|candela|newton|pascal|joule|watt|coulomb|volt|ohm|farad|tesla|hertz|electronvolt|angstrom)"
)
UNIT_SYMBOLS = (
    "m km cm mm nm pm fm um Angstrom A kg g mg ug s ms us ns ps min h hr K C Hz kHz MHz GHz J kJ MJ eV keV MeV GeV"
    " W kW MW N kN Pa kPa MPa atm bar V mV kV Ohm F pF nF uF T mT uT rad deg c"
).split()
TOKENS = {"\\left": "", "\\right": "", "$": "", "\\approx": "=", "\\simeq": "=", "\\sim": "=", "^\\prime": "'", "^{\\prime}": "'", "^\\circ": "", "%": ""}
EDGES = "\n$,.:;^_=+`!@#%^&*~"
SENTENCE = r"^[A-Z][a-z]+ [a-z]"
DOMAINS = {
    "mechanics": "ClassicalMechanics Mechanics MECHANICS TheoreticalMechanics",
    "em_electro": "ClassicalElectromagnetism Electrodynamics Electromagnetism ELECTRICITY",
    "quantum_modern": "QuantumMechanics AtomicPhysics Modern_Physics MODERN ADVANCED quan",
    "thermo_stat": "StatisticalMechanics Thermodynamics thermo stat THERMODYNAMICS",
    "optics": "WaveOptics Optics GeometricalOptics OPTICS",
}

_LEVEL = r"[^{}]"
for _ in range(4):
    _LEVEL = rf"(?:[^{{}}]|\{{{_LEVEL}*\}})"
#: The content of the first balanced box.
BOX = rf"(?s)\\boxed\{{({_LEVEL}*)\}}"
#: Numbers as a program would read them.
FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Longer symbols first, so that none hides behind a shorter one.
BARE_UNIT = r"\d\s*(?:" + "|".join(sorted(set(UNIT_SYMBOLS), key=lambda x: (-len(x), x))) + r")(?:\b|$|[/\s,;])"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """What a group of a pattern holds, or null without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def first_box(text: Column) -> Column:
    return F.trim(_found(text, BOX))


def flat_boxes(text: Column) -> Column:
    """Contents of boxes with one inner level of braces at most."""
    return F.regexp_extract_all(text, F.lit(r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"), 1)


def mcq_gold(text: Column) -> Column:
    """One to three capitals, or null where none can be read."""
    inner = F.trim(F.coalesce(first_box(F.trim(text)), F.trim(text)))
    inner = F.trim(F.coalesce(_found(inner, WRAPPED), inner))
    return F.upper(F.coalesce(*(_found(inner, p) for p in LETTERS)))


def true_false_gold(text: Column) -> Column:
    """True or False, or null where neither can be read."""
    inner = F.coalesce(first_box(F.trim(text)), F.trim(text))
    table = F.create_map(*(F.lit(x) for kv in TRUTH.items() for x in kv))
    word = F.lower(F.rtrim(F.split(inner, r"[\s,;({\[]")[0], F.lit(".,")))
    return F.coalesce(F.try_element_at(table, word), F.try_element_at(table, _found(F.lower(inner), TRUTH_WORD)))


def single_math(text: Column) -> Column:
    """The one formula in a text around it; null where there are none, several, or nothing else."""
    blocks = F.concat(F.regexp_extract_all(text, F.lit(r"(?s)\\\((.*?)\\\)"), 1), F.regexp_extract_all(text, F.lit(r"(?s)\\\[(.*?)\\\]"), 1))
    inner = F.trim(F.get(blocks, F.lit(0)))
    whole = F.trim(text).isin(F.concat(F.lit("\\("), inner, F.lit("\\)")), F.concat(F.lit("\\["), inner, F.lit("\\]")))
    return F.when((F.size(blocks) == 1) & (inner != "") & ~whole, inner)


def doubled_commands(text: Column) -> Column:
    """Whether every command has its backslash twice."""
    return text.rlike(r"\\\\[a-zA-Z]") & ~text.rlike(r"(?<!\\)\\[a-zA-Z]")


def clean_gold(text: Column) -> Column:
    """struct(clean, tag): the first cleaning step that applies to a gold answer.

    The steps, in order: unbalanced braces; a box inside other text; dollar or bracket
    wrappers; one formula inside prose; doubled backslashes; prose; answers that
    narrate; other scripts. Those that drop a row leave its text as it was.
    """
    s = F.trim(text)
    box = first_box(s)
    inner = t.strip_dollars(box)
    only = s.isin(F.concat(F.lit("\\boxed{"), box, F.lit("}")), F.concat(F.lit("$\\boxed{"), box, F.lit("}$")), F.concat(F.lit("$$\\boxed{"), box, F.lit("}$$")))
    bare, math = t.strip_dollars(s), single_math(s)

    def told(clean: Column, tag: str) -> Column:
        return F.struct(clean.alias("clean"), F.lit(tag).alias("tag"))

    return (
        F.when(t.brace_balance(s) != 0, told(text, "truncated_dropped"))
        .when((box != "") & ~only & (inner != ""), told(inner, "prose_extracted"))
        .when(bare != s, told(bare, "dollar_stripped"))
        .when(math.isNotNull(), told(math, "display_math_extracted"))
        .when(doubled_commands(s), told(F.replace(s, F.lit("\\\\"), F.lit("\\")), "double_unescaped"))
        .when(s.rlike(r"\n\s*[A-Za-z]") | (s.rlike(SENTENCE) & (F.length(s) > 30)), told(text, "prose_dropped"))
        .when(t.prose_gold(s), told(text, "prose_gold_dropped"))
        .when(t.non_latin(s), told(text, "non_latin_dropped"))
        .otherwise(told(text, "unchanged"))
    )


def infer_type(text: Column) -> Column:
    """The answer type that a gold answer's form tells; nested brackets are followed to three levels."""
    s = F.trim(text)
    plain = F.trim(F.regexp_replace(s, r"\\(?:times|cdot)\s*10\^\{?[+-]?[\d.]+\}?", ""))
    plain = F.trim(F.regexp_replace(plain, r"\\pm\s*[\d.]+", ""))
    plain = F.trim(F.regexp_replace(plain, r"(\d)\s*[A-Za-z][A-Za-z0-9]*\s*$", "$1"))
    open_text = s
    for _ in range(3):  # brackets go from the inside out, and equals signs in them
        open_text = F.regexp_replace(open_text, r"[({\[][^(){}\[\]]*[)}\]]", "")
    return (
        F.when(s == "", "unknown")
        .when(s.rlike(r"^(?:[A-Z]|\([A-Z]\))$"), "mcq")
        .when(s.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)\s*%$") | (s.rlike(SCIENTIFIC) & F.regexp_extract(s, SCIENTIFIC, 1).rlike(FLOAT)) | plain.rlike(FLOAT), "numerical")
        .when(F.contains(open_text, F.lit("=")), "equation")
        .when(s.rlike(OPERATORS) | s.rlike(r"[\^_\\]"), "expression")
        .when(s.rlike(r"\d") & s.rlike(r"[a-zA-Z()+\-*/]") & ~F.contains(s, F.lit(",")) & (F.length(s) <= 60), "expression")
        .when(s.rlike(r"^[+-]?[a-zA-Z]\w*$"), "expression")
        .when(F.translate(s, "×x", "ee").rlike(FLOAT), "numerical")
        .otherwise("unknown")
    )


def unit_kind(text: Column) -> Column:
    s = F.trim(text)
    return F.when(s.rlike(UNIT_COMMAND), "latex_unit").when(s.rlike(BARE_UNIT), "bare_unit").when(s.rlike(r"\d\s+[A-Za-z][A-Za-z0-9/^]*\s*$"), "fraction_unit").otherwise("no_unit")


def plain_latex(text: Column) -> Column:
    """A formula without wrappers and decorations, for comparison."""
    out = F.when(F.contains(text, F.lit("\\in ")), F.split_part(text, F.lit("\\in "), F.lit(2))).otherwise(text)
    for token, other in TOKENS.items():
        out = F.replace(out, F.lit(token), F.lit(other))
    return F.regexp_replace(F.btrim(out, F.lit(EDGES)), r"\\(?:mathrm|mathbf)\{~?([^}]*)\}", "$1")


def plain_unit(text: Column) -> Column:
    """A unit without LaTeX: the arguments of its commands, single spaces."""
    out = F.regexp_replace(text, r"\\(?:mathrm|text|mathbf|mathit|operatorname)\{([^}]*)\}", "$1")
    out = F.regexp_replace(F.replace(out, F.lit("$"), F.lit("")), r"\\(?!times)[a-zA-Z,!]+", " ")
    return F.trim(F.regexp_replace(F.replace(out, F.lit("~"), F.lit(" ")), " +", " "))


def plain_quantity(text: Column) -> Column:
    """A quantity without LaTeX, powers of ten as exponents."""
    return plain_unit(F.regexp_replace(text, r"([+-]?\d+\.?\d*)\s*\\times\s*10\^\{?([+-]?\d+)\}?", "$1e$2"))


def leading_number(text: Column) -> Column:
    """The number that a text begins with once LaTeX wrappers are gone, or null."""
    out = F.regexp_replace(F.trim(text), r"[${}]", "")
    out = F.regexp_replace(out, r"\\[,;\\$]|\s+", "")
    return _found(out, r"^([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)").try_cast("double")


def within_percent(pred: Column, gold: Column, tolerance: float = 0.01) -> Column:
    """Relative tolerance, absolute where gold is zero; false where either can't be read."""
    return F.coalesce(F.abs(pred - gold) <= tolerance * F.when(gold == 0, 1.0).otherwise(F.abs(gold)), F.lit(False))


def normalize_types(label: Column) -> Column:
    """Canonical types as an array: of one label, a JSON list, or labels joined by commas."""
    raw = F.coalesce(label, F.lit(""))
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    parts = F.coalesce(listed, F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != ""))
    return F.transform(F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts), t.canonical_type)


def primary_type(label: Column) -> Column:
    return F.when(F.trim(label).startswith("["), "multi-part").otherwise(F.trim(label))


def coarse_type(label: Column) -> Column:
    """multi, one of the four main types, or other."""
    return F.when(label.startswith("["), "multi").when(label.isin("numerical", "expression", "equation", "mcq"), label).otherwise("other")


def counted_type(label: Column) -> Column:
    """A list of types as multi(n)-first; others as they are."""
    listed = F.from_json(label, "array<string>")
    return F.when(label.startswith("[") & listed.isNotNull(), F.format_string("multi(%d)-%s", F.size(listed), listed[0])).otherwise(label)


def coarse_domain(domain: Column) -> Column:
    table = {name.replace("_", " ") if name == "Modern_Physics" else name: to for to, names in DOMAINS.items() for name in names.split()}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.trim(domain)), F.lit("other"))


def has_cjk(text: Column, wide: bool = False) -> Column:
    """CJK ideographs; with ``wide`` also extension A, compatibility forms, punctuation and full-width forms."""
    return F.coalesce(text.rlike(r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]" if wide else r"[\x{4e00}-\x{9fff}]"), F.lit(False))


def solution(first: Column, more: Column, last: Column, interrupted: Column) -> Column:
    """The phases of an attempt joined by line feeds; the middle one only if the first was interrupted."""
    return F.concat_ws("\n", first, F.when(interrupted, more), last)


def tool_call(text: Column) -> Column:
    """The code of the last tool call: its parameter element, else the code string of its JSON form; null without either."""
    call = F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), 1), F.lit(-1))
    quoted = _found(call, r'(?s)"name"\s*:\s*"python".*?"code"\s*:\s*"((?:\\.|[^"\\])*)"')
    unescaped = F.get_json_object(F.concat(F.lit('{"c":"'), quoted, F.lit('"}')), "$.c")
    return F.coalesce(_found(call, r"(?s)<function=python>\s*<parameter=code>\s*(.*?)\s*</parameter>\s*</function>"), unescaped, quoted)


def same_box(pred: Column, gold: Column) -> Column:
    """Whether the last flat box equals that of gold, or gold itself without one, white space aside."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    last = lambda c: F.try_element_at(flat_boxes(c), F.lit(-1))
    return F.coalesce((bare(last(pred)) == bare(F.coalesce(last(gold), gold))) & (last(pred) != ""), F.lit(False))
