"""What columns can't express: balanced braces, and a small evaluator of LaTeX formulas."""

from __future__ import annotations

import functools
import itertools
import json
import math
import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import CANONICAL_TYPES, number

BOX = "\\boxed{"
# What a formula may hold.
FUNCTIONS = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "ln": math.log, "log": math.log10, "exp": math.exp, "sqrt": math.sqrt, "arcsin": math.asin, "arccos": math.acos, "arctan": math.atan, "sinh": math.sinh, "cosh": math.cosh, "tanh": math.tanh}
# SI dimensions (metre, kilogram, second, ampere, kelvin, mole) and factors of units; prefixes.
UNITS = {
    "m": (1, (1, 0, 0, 0, 0, 0)), "g": (1e-3, (0, 1, 0, 0, 0, 0)), "s": (1, (0, 0, 1, 0, 0, 0)), "A": (1, (0, 0, 0, 1, 0, 0)), "K": (1, (0, 0, 0, 0, 1, 0)), "mol": (1, (0, 0, 0, 0, 0, 1)),
    "N": (1, (1, 1, -2, 0, 0, 0)), "J": (1, (2, 1, -2, 0, 0, 0)), "W": (1, (2, 1, -3, 0, 0, 0)), "Pa": (1, (-1, 1, -2, 0, 0, 0)), "C": (1, (0, 0, 1, 1, 0, 0)), "V": (1, (2, 1, -3, -1, 0, 0)),
    "Hz": (1, (0, 0, -1, 0, 0, 0)), "T": (1, (0, 1, -2, -1, 0, 0)), "eV": (1.602176634e-19, (2, 1, -2, 0, 0, 0)), "min": (60, (0, 0, 1, 0, 0, 0)), "h": (3600, (0, 0, 1, 0, 0, 0)), "L": (1e-3, (3, 0, 0, 0, 0, 0)), "F": (1, (-2, -1, 4, 2, 0, 0)), "H": (1, (2, 1, -2, -2, 0, 0)),
}
PREFIXES = {"": 1, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "c": 1e-2, "m": 1e-3, "u": 1e-6, "μ": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "d": 1e-1}


#: Words after which a text's answer stands, tried in this order.
KEYWORDS = ("the answer is", "answer is", "answer:")
_BRACE = re.compile(r"\\boxed\{|[{}]")


def boxes(text: str | None) -> list[tuple[int, int | None, int]]:
    """Every box in the order of their starts: where its content begins and ends (None if it doesn't), and how many it is inside."""
    text, out, open_ = text or "", [], []
    for m in _BRACE.finditer(text):
        if m[0] != "}":
            open_.append(len(out) if m[0] != "{" else None)
            if m[0] != "{":
                out.append((m.end(), None, sum(x is not None for x in open_) - 1))
        elif open_ and (which := open_.pop()) is not None:
            out[which] = (out[which][0], m.start(), out[which][2])
    return out


def boxed(text: str | None) -> list[str]:
    """The contents of all complete boxes that aren't inside another, in order."""
    return [text[a:b] for a, b, inside in boxes(text) if b is not None and not inside]


def first_box(text: str | None) -> str | None:
    found = boxes(text)
    return text[found[0][0] : found[0][1]].strip() if found and found[0][1] is not None else None


def last_box(text: str | None) -> str | None:
    found = boxes(text)
    return text[found[-1][0] : found[-1][1]].strip() if found and found[-1][1] is not None else None


def answer(text: str | None) -> str:
    """The last box; else what follows the last answer keyword on its line; else the whole text."""
    text = text or ""
    found = boxed(text)
    if found:
        return found[-1]
    for word in KEYWORDS:
        _, hit, tail = text.lower().rpartition(word)
        if hit and (tail := text[len(text) - len(tail) :].strip()):
            return tail.splitlines()[0].strip()
    return text.strip()


def top_level_parts(text: str) -> list[str]:
    """Split at commas outside brackets; a thin space (backslash, comma) is no separator."""
    level = list(itertools.accumulate((c in "([{") - (c in ")]}") for c in text))
    at = [m.start() for m in re.finditer(r"(?<!\\),", text) if not level[m.start()]]
    return [p for a, b in zip([0, *(i + 1 for i in at)], [*at, len(text)]) if (p := text[a:b].strip())]


def sign_variants(text: str) -> list[str]:
    """All readings of plus-minus signs."""
    if "\\pm" not in text:
        return [text]
    return [v for sign in "+-" for v in sign_variants(re.sub(r"\\pm ?", sign, text, count=1))]


_TOKEN = re.compile(r"\s*(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+|\\[a-zA-Z]+|[a-zA-Z]|[-+*/^(){}=_|,])")


class _Parser:
    """Recursive descent over tokens; raises ValueError on what it doesn't know."""

    def __init__(self, text: str) -> None:
        text = re.sub(r"\\(left|right|,|;|!|quad)|\$", " ", text).replace("\\cdot", "*").replace("\\times", "*").replace("×", "*").replace("−", "-")
        text = re.sub(r"\\(?:mathrm|text|mathbf)\{~?([^{}]*)\}", r"\1", text)
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or len(self.tokens) > 400:
                raise ValueError(text)
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str = "") -> str:
        t = self.peek()
        if not t or want and t != want:
            raise ValueError(t)
        self.at += 1
        return t

    def sum(self):
        sign = 1
        while self.peek() in "+-" and self.peek():
            sign *= -1 if self.take() == "-" else 1
        out = ("*", ("n", float(sign)), self.product())
        while self.peek() and self.peek() in "+-":
            out = (self.take(), out, self.product())
        return out

    def product(self):
        out = self.power()
        while (t := self.peek()) and t not in "+-)}=,|":
            if t in "*/":
                self.take()
                out = (t, out, self.power())
            else:
                out = ("*", out, self.power())
        return out

    def power(self):
        base = self.atom()
        if self.peek() == "^":
            self.take()
            return ("^", base, self.group() if self.peek() == "{" else self.signed())
        return base

    def signed(self):
        if self.peek() == "-":
            self.take()
            return ("-", ("n", 0.0), self.atom())
        return self.atom()

    def group(self):
        self.take("{")
        out = self.sum()
        self.take("}")
        return out

    def atom(self):
        t = self.take()
        if t == "-":
            return ("-", ("n", 0.0), self.power())
        if re.match(r"[\d.]", t):
            return ("n", float(t))
        if t in "({":
            out = self.sum()
            self.take(")" if t == "(" else "}")
            return out
        if t == "\\frac" or t == "\\dfrac":
            return ("/", self.group(), self.group())
        if t == "\\pi":
            return ("n", math.pi)
        name = t.removeprefix("\\")
        if name in FUNCTIONS and t != name:
            return ("f", name, self.group() if self.peek() == "{" else self.power())
        if re.match(r"\\?[a-zA-Z]", t):
            if self.peek() == "_":
                self.take()
                sub = self.tokens[self.at : self.at + 1]
                if sub == ["{"]:
                    end = self.tokens.index("}", self.at)
                    sub, self.at = self.tokens[self.at + 1 : end], end + 1
                else:
                    self.at += 1
                return ("v", name + "_" + "".join(sub))
            return ("v", name)
        raise ValueError(t)


def parse(text: str):
    p = _Parser(text)
    out = p.sum()
    if p.peek():
        raise ValueError(p.peek())
    return out


def names(tree) -> set[str]:
    if tree[0] == "v":
        return {tree[1]}
    return set().union(*(names(x) for x in tree[1:] if isinstance(x, tuple)))


def value(tree, at: dict[str, float]) -> float:
    kind = tree[0]
    if kind == "n":
        return tree[1]
    if kind == "v":
        return at[tree[1]]
    if kind == "f":
        return FUNCTIONS[tree[1]](value(tree[2], at))
    a, b = value(tree[1], at), value(tree[2], at)
    return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b if kind == "/" else float(a**b)


def _near(a: float, b: float, tolerance: float) -> bool:
    return abs(a) < tolerance if abs(b) < 1e-12 else abs(a - b) / abs(b) <= tolerance


def equivalent(pred: str, gold: str, tolerance: float = 0.05) -> bool | None:
    """Numbers within a tolerance; formulas, and equations up to a factor, by values at seeded places. None: not understood."""
    try:
        if pred.count("=") == gold.count("=") == 1:
            left, right = ([parse(x) for x in e.split("=")] for e in (pred, gold))
            trees = [("-", *left), ("-", *right)]
        elif "=" in pred or "=" in gold:
            return None
        else:
            trees = [parse(pred), parse(gold)]
        free = names(trees[0]) | names(trees[1])
        if not free:
            return _near(value(trees[0], {}), value(trees[1], {}), tolerance)
        rng, ratios, pairs = random.Random(42), [], []
        for _ in range(10):
            at = {n: rng.uniform(0.5, 3) for n in sorted(free)}
            try:
                a, b = value(trees[0], at), value(trees[1], at)
            except (ArithmeticError, ValueError, TypeError):
                continue
            if isinstance(a, complex) or isinstance(b, complex):
                continue
            pairs.append((a, b))
            if abs(b) > 1e-9:
                ratios.append(a / b)
        if len(pairs) < 3:
            return None
        if "=" in pred:
            return bool(len(ratios) >= 3 and abs(ratios[0]) > 1e-9 and all(_near(r, ratios[0], 1e-6) for r in ratios))
        return all(_near(a, b, 1e-6) for a, b in pairs)
    except (ValueError, ArithmeticError, KeyError, IndexError, RecursionError, TypeError):
        return None


def quantity(text: str) -> tuple[float, tuple] | None:
    """A number with a unit, in SI; None if either isn't understood."""
    text = re.sub(r"\\(?:mathrm|text)\{~?([^{}]*)\}", r"\1", text.replace("$", "")).replace("~", " ").replace("\\,", " ")
    m = re.match(r"^\s*([+-]?[\d.]+(?:[eE][+-]?\d+)?)(?:\s*(?:\\times|×)\s*10\^\{?([+-]?\d+)\}?)?\s*([A-Za-zμ].*)$", text)
    if not m:
        return None
    try:
        total, dims = float(m[1]) * 10.0 ** int(m[2] or 0), [0] * 6
    except ValueError:
        return None
    sign = 1
    for part in re.findall(r"/|[A-Za-zμ]+(?:\^\{?-?\d+\}?)?", m[3]):
        if part == "/":
            sign = -1
            continue
        name, _, power = part.partition("^")
        n = sign * int(power.strip("{}") or 1)
        for size in range(len(name)):
            if name[:size] in PREFIXES and name[size:] in UNITS:
                factor, d = UNITS[name[size:]]
                total *= (factor * PREFIXES[name[:size]]) ** n
                dims = [x + n * y for x, y in zip(dims, d)]
                break
        else:
            return None
    return total, tuple(dims)


def same_quantity(pred: str, gold: str, tolerance: float = 0.05) -> bool | None:
    a, b = quantity(pred), quantity(gold)
    if a is None or b is None:
        return None
    return a[1] == b[1] and _near(a[0], b[0], tolerance)


#: Forms that can't be compared: a power of a power, a unit on one side only.
NESTED_POWER = re.compile(r"\^\{[^}]*\^\{")
UNIT_TAIL = re.compile(r"\d\s*[A-Za-z][A-Za-z0-9]*\s*$")
CANONICAL = CANONICAL_TYPES | {x: x for x in ("unknown", "inequality")}


def kinds(label) -> list[str]:
    """Canonical answer types of a label: one, a list, a JSON list, or several joined by commas."""
    if isinstance(label, str) and label.startswith("["):
        try:
            label = json.loads(label)
        except ValueError:
            pass
    parts = [str(x) for x in label] if isinstance(label, (list, tuple)) else [x for x in str(label or "").split(",") if x.strip()]
    return [CANONICAL.get(x.strip(), "unknown") for x in parts] or ["unknown"]


def _float(text: str) -> float | None:
    try:
        return float(text.strip())
    except ValueError:
        return None


def compare(pred: str, gold: str, tolerance: float = 0.05) -> bool | None:
    """Whether two answers without units are the same; None where that can't be told."""
    if NESTED_POWER.search(pred) or NESTED_POWER.search(gold) or bool(UNIT_TAIL.search(pred)) != bool(UNIT_TAIL.search(gold)):
        return None
    a, b = _float(pred), _float(gold)
    if a is not None and b is not None:
        return _near(a, b, tolerance)
    if pred.replace(" ", "") == gold.replace(" ", ""):
        return True
    return equivalent(pred, gold, tolerance)


def _pair(pred: str, gold: str, unit: str, tolerance: float, judge, problem: str) -> bool | None:
    if unit and same_quantity(pred if quantity(pred) else f"{pred} {unit}", f"{gold} {unit}", tolerance):
        return True
    result = compare(pred, gold, tolerance)
    if result is not True and (same := same_quantity(pred, gold, tolerance)) is not None:
        result = same
    if result is True or judge is None:
        return result
    return judge(pred, f"{gold} {unit}".strip(), problem)


def _any(results) -> bool | None:
    """True if one is; else None if one is; else False."""
    results = list(results)
    return True if True in results else None if None in results else False


def gold_parts(gold) -> list[str]:
    """The parts of a gold answer: of a list, or split at commas, then unboxed and split again."""
    sources = [str(x) for x in gold] if isinstance(gold, (list, tuple)) else top_level_parts(str(gold)) or [str(gold)]
    inner = [found[0].strip() if len(found := boxed(x.strip())) == 1 else x.strip() for x in sources]
    return [p for x in inner for p in top_level_parts(x)]


def verify(pred: str | None, gold, kind, tolerance: float = 0.05, unit: str | None = "", judge=None, problem: str = "") -> float:
    """1.0, 0.0, or -1.0 where the answer can't be checked.

    ``gold`` and ``kind`` may be lists, a part each; ``unit`` is the gold answer's.
    ``judge`` is a callable (pred, gold, problem) -> bool, asked where the rules don't say yes.
    """
    types = kinds(kind)
    if types[0] in ("unknown", "open_end", "code"):
        return -1.0
    if types[0] in ("mcq", "true_false"):
        first = gold[0] if isinstance(gold, (list, tuple)) and gold else gold
        told = choice(answer(pred), types[0])
        return float(told is not None and told == choice(str(first or ""), types[0]))
    golds, preds = gold_parts(gold or ""), top_level_parts(answer(pred))
    if not golds or len(golds) != len(preds):
        return 0.0

    def checked(order: tuple[str, ...]) -> float:
        open_ = False
        for a, b in zip(order, golds):
            found = _any(_pair(a, v, unit or "", tolerance, judge, problem) for v in sign_variants(b))
            if found is False:
                return 0.0
            open_ |= found is None
        return -1.0 if open_ else 1.0

    seen = set()
    for order in itertools.permutations(preds) if len(golds) <= 4 else [tuple(preds)]:
        if 1.0 in (seen := seen | {checked(order)}):
            return 1.0
    return min(seen)


def choice(text: str, kind: str) -> str | None:
    text = re.sub(r"\\(?:text|mathrm|mathbf)\{([^{}]*)\}", r"\1", answer(text)).strip()
    if kind == "mcq":
        m = re.match(r"^\(?([A-Za-z]{1,3})\)?(?:[.):\s*\-]|$)", text)
        return m[1].upper() if m else None
    table = {"yes": "True", "y": "True", "t": "True", "true": "True", "no": "False", "n": "False", "f": "False", "false": "False"}
    first = re.split(r"[\s,;({\[]", text)[0].rstrip(".,").lower()
    if first in table:
        return table[first]
    m = re.search(r"\b(yes|no|true|false)\b", text, re.IGNORECASE)
    return table[m[1].lower()] if m else None


def edit_score(pred: str, gold: str) -> float:
    """Expression edit distance: 100 for equals, else 60 less the distance's share of the gold tree's nodes, 0 at least."""
    if not pred.strip() or any(x in pred or x in gold for x in ("\\int", "\\sum")) or len(pred) > 3 * len(gold):
        return 0.0
    if pred.replace(" ", "") == gold.replace(" ", "") or equivalent(pred, gold, 1e-6):
        return 100.0
    try:
        a, b = (_canonical(parse(x)) for x in (pred, gold))
        return max(0.0, 60 - 100 * tree_distance((a,), (b,)) / _nodes(b))
    except (ValueError, IndexError, RecursionError):
        return 0.0


def _canonical(tree) -> tuple:
    """(label, children): sums and products flat and sorted, differences and quotients as sums and products."""
    kind = tree[0]
    if kind in "nv":
        return (f"{kind}{tree[1]}", ())
    if kind == "f":
        return (f"f{tree[1]}", (_canonical(tree[2]),))
    left, right = _canonical(tree[1]), _canonical(tree[2])
    if kind == "-":
        kind, right = "+", ("*", (("n-1.0", ()), right))
    if kind == "/":
        kind, right = "*", ("^", (right, ("n-1.0", ())))
    if kind == "^":
        return ("^", (left, right))
    flat = [y for x in (left, right) for y in (x[1] if x[0] == kind else (x,)) if not (kind == "*" and y[0] == "n1.0" or kind == "+" and y[0] == "n0.0")]
    return (kind, tuple(sorted(flat, key=lambda x: (_letters(x), x)))) if len(flat) > 1 else flat[0] if flat else left


def _letters(tree: tuple) -> str:
    """The variables of a tree, by which terms are ordered."""
    return "".join(map(_letters, tree[1])) if tree[1] else tree[0] if tree[0][0] == "v" else ""


def _nodes(tree: tuple) -> int:
    return 1 + sum(map(_nodes, tree[1]))


def _whole(tree: tuple) -> float:
    """The cost of a whole subtree: its nodes, those beyond five at a discount."""
    n = _nodes(tree)
    return min(n, 0.6 * (n - 5) + 5) if tree[1] else 1


@functools.lru_cache(100_000)
def tree_distance(a: tuple, b: tuple) -> float:
    """The least cost of making forest ``b`` of forest ``a``: nodes or whole subtrees go or come, nodes are renamed."""
    if not a or not b:
        return sum(map(_whole, a + b))
    (x, below_x), (y, below_y) = a[-1], b[-1]
    return min(
        tree_distance(a[:-1] + below_x, b) + 1, tree_distance(a, b[:-1] + below_y) + 1, tree_distance(a[:-1], b) + _whole(a[-1]), tree_distance(a, b[:-1]) + _whole(b[-1]),
        tree_distance(a[:-1], b[:-1]) + tree_distance(below_x, below_y) + (x != y),
    )


def pairs_off(pred: str, gold: str, errors: list[float]) -> bool:
    """Whether the parts of two answers pair off: intervals by their ends, numbers within an absolute error (also as per cent), formulas by value."""

    def same(a: str, b: str, error: float) -> bool:
        if a == b:
            return True
        if a[:1] in "([" and b[:1] in "([" and a[-1:] in ")]" and b[-1:] in ")]":
            ends = [[top_level_parts(y.strip()[1:-1]) for y in x.split("\\cup")] for x in (a, b)]
            return (a[0], a[-1]) == (b[0], b[-1]) and list(map(len, ends[0])) == list(map(len, ends[1])) and all(same(p, q, error) for x, y in zip(*ends) for p, q in zip(x, y))
        p, q = _float(a), _float(b)
        if p is not None and q is not None:
            return any(abs(p - r) <= 1.01 * error for r in (q, q / 100, q * 100))
        if ("=" in a) != ("=" in b):
            a, b = a.rpartition("=")[2], b.rpartition("=")[2]
        try:
            return abs(value(parse(a), {}) - value(parse(b), {})) <= 1.01 * error
        except (ValueError, ArithmeticError, KeyError, IndexError, RecursionError, TypeError):
            return equivalent(a, b, 1e-6) is True

    golds, preds = ([v for p in top_level_parts(x) for v in sign_variants(p)] for x in (gold, pred))
    errors = [*errors, *[errors[-1] if errors else 1e-8] * len(golds)]
    for g, error in zip(golds, errors):
        hit = next((i for i, p in enumerate(preds) if same(p, g, error)), None)
        if hit is None:
            return False
        preds.pop(hit)
    return not preds


@F.pandas_udf(T.ArrayType(T.StringType()))
def boxed_all(text: pd.Series) -> pd.Series:
    return text.map(boxed)


@F.pandas_udf(T.StringType())
def extract_answer(text: pd.Series) -> pd.Series:
    return text.map(answer)


@F.pandas_udf(T.DoubleType())
def _verified(pred: pd.Series, gold: pd.Series, kind: pd.Series, unit: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else verify(p, g, k, unit=u) for p, g, k, u in zip(pred, gold, kind, unit)], dtype="float64")


def verify_answer(pred: Column, gold: Column, kind: Column, unit: Column | None = None, tolerance: float = 0.05) -> Column:
    """1.0, 0.0, or -1.0 (can't be checked) of string columns.

    Unverifiable types, blank golds and plain numbers are decided by native
    expressions; only the others reach Python, in Arrow batches.
    """
    unit = unit if unit is not None else F.lit("")
    label = F.trim(F.coalesce(kind, F.lit("")))
    a, b = number(pred), number(gold)
    choices = label.isin(*(k for k, v in CANONICAL_TYPES.items() if v in ("mcq", "true_false")))
    easy = (
        F.when(label.isin("", "unknown", "open_end", "Open-end", "code"), -1.0)
        .when(F.trim(F.coalesce(gold, F.lit(""))) == "", 0.0)
        .when(a.isNotNull() & b.isNotNull() & ~choices & ~label.startswith("[") & ~F.contains(label, F.lit(",")) & (F.coalesce(unit, F.lit("")) == ""), F.when(F.when(F.abs(b) < 1e-12, F.abs(a) < tolerance).otherwise(F.abs(a - b) / F.nullif(F.abs(b), F.lit(0.0)) <= tolerance), 1.0).otherwise(F.when(label.isin(*CANONICAL_TYPES), 0.0).otherwise(-1.0)))
    )
    return F.coalesce(easy, _verified(pred, gold, F.when(easy.isNull(), kind), unit))


@F.pandas_udf(T.DoubleType())
def edit_distance_score(pred: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([edit_score(p or "", g or "") for p, g in zip(pred, gold)])


def judged(rows: DataFrame, judge, pred: str = "pred", gold: str = "gold", problem: str = "problem") -> DataFrame:
    """Rows with ``verdict`` where it is -1 replaced by a judge's: 1 or 0.

    Record and replay: each distinct (pred, gold, problem) is asked once, in batches;
    ``judge`` maps a list of such triples to booleans. A judge that fails says no.
    """
    asked = rows.where("verdict = -1").select(F.coalesce(pred, F.lit("")).alias("jp"), F.coalesce(gold, F.lit("")).alias("jg"), F.coalesce(problem, F.lit("")).alias("jq")).distinct()

    def ask(batches):
        for frame in batches:
            triples = list(zip(frame["jp"], frame["jg"], frame["jq"]))
            try:
                told = list(judge(triples))
            except Exception:  # noqa: BLE001  a judge is a service of its own
                told = [False] * len(triples)
            yield frame.assign(said=[float(bool(x)) for x in told])

    replies = asked.mapInPandas(ask, "jp string, jg string, jq string, said double")
    key = (F.coalesce(pred, F.lit("")) == F.col("jp")) & (F.coalesce(gold, F.lit("")) == F.col("jg")) & (F.coalesce(problem, F.lit("")) == F.col("jq"))
    out = rows.join(replies, key & (F.col("verdict") == -1), "left")
    return out.select(*(F.coalesce("said", "verdict").alias("verdict") if c == "verdict" else F.col(c) for c in rows.columns))
