"""Raw question sets to candidate rows.

Each loader takes the raw rows with ``ordinal``, their place in the source, and
returns COLUMNS; answers and answer types are arrays, of one element for a single
answer. What a loader drops, its docstring says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import answers as a

COLUMNS = ("problem_id", "problem", "answer", "answer_type", "source", "domain", "difficulty", "unit", "tolerance", "language", "split", "metadata")
# Labels that rows carry.
CHEMISTRY = ("atkins", "chemmc")
TIERS = {"textonly": "PHYSICS-textonly", "hard": "PHYSICS-hard", "eval": "PHYSICS-eval", "test": "PHYSICS-test"}


def _rows(raw: DataFrame, source: str, split: Column | str, prefix: str, **columns: Column) -> DataFrame:
    empty = F.lit("")
    given = {
        "problem_id": F.format_string(f"{prefix}_%05d", "ordinal"), "source": F.lit(source), "split": F.lit(split) if isinstance(split, str) else split, "domain": empty, "difficulty": empty, "unit": empty, "tolerance": empty,
        "language": F.lit("en"), "metadata": F.lit(None).cast("map<string,string>"),
    } | columns
    return raw.select(*(given[c].alias(c) for c in COLUMNS))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def clean_label(raw: Column) -> Column:
    """The first line that is codes of two capitals, or begins with one; else the first line."""
    lines = F.transform(F.split(raw, "\n"), lambda x: F.trim(F.regexp_replace(x, "`+", "")))
    codes = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^([A-Z]{2}(?:,\s*[A-Z]{2})*)$|^([A-Z]{2})", 0)), lambda x: x != "")
    return F.coalesce(F.get(codes, F.lit(0)), F.trim(F.split(raw, "\n")[0]))


def physics(raw: DataFrame) -> DataFrame:
    """question, answer (lists of alternatives), answer_type (list), domain, difficulty. Drops questions with CJK and answers with alternatives; open ends go to evaluation."""
    kept = raw.where(~a.has_cjk(F.col("question")) & ~F.exists("answer", lambda x: F.size(x) > 1))
    kinds = F.flatten(F.transform("answer_type", a.normalize_types))
    split = F.when(F.array_contains("answer_type", "Open-end"), "eval_tier1").otherwise("train_candidate")
    return _rows(kept, "PHYSICS", split, "PHYSICS", problem=F.col("question"), answer=F.flatten("answer"), answer_type=kinds, domain=_text("domain"), difficulty=_text("difficulty"))


def ugphysics(raw: DataFrame, language: str = "en") -> DataFrame:
    """subject, language, problem, answers, answer_type, unit, is_multiple_answer. Keeps one language."""
    kept = raw.where(F.col("language") == language)
    return _rows(kept, "UGPhysics", "train_candidate", "UGPhysics", problem_id=F.format_string("UGPhysics_%s_%05d", "subject", "ordinal"), problem=F.col("problem"), answer=F.array("answers"), answer_type=a.normalize_types(clean_label(F.col("answer_type"))), unit=_text("unit"), domain=F.col("subject"), language=F.lit(language), metadata=F.create_map(F.lit("is_multiple_answer"), _text("is_multiple_answer")))


def olympiad(raw: DataFrame, config: str) -> DataFrame:
    """question, final_answer (list), answer_type (joined by commas), unit, error. Drops rows with more types than answers, or fewer."""
    kinds = a.normalize_types(F.col("answer_type"))
    kept = raw.where(F.size("final_answer") == F.size(F.split(F.coalesce("answer_type", F.lit("")), ",")))
    return _rows(kept, "OlympiadBench", "train_candidate", f"OlympiadBench_{config}", problem=F.col("question"), answer=F.col("final_answer"), answer_type=kinds, unit=_text("unit"), tolerance=_text("error"), domain=F.lit(config))


def phybench(raw: DataFrame) -> DataFrame:
    """content, answer, tag. Drops blank questions and answers."""
    kept = raw.where((F.trim("content") != "") & (F.trim("answer") != ""))
    return _rows(kept, "PHYBench", "train_candidate", "PHYBench", problem=F.col("content"), answer=F.array("answer"), answer_type=F.array(F.lit("symbolic")), domain=_text("tag"))


def scibench(raw: DataFrame) -> DataFrame:
    """problem_text, answer_number, unit, source. Drops the chemistry sources."""
    kept = raw.where(~_text("source").isin(*CHEMISTRY))
    return _rows(kept, "SciBench_RL", "train_candidate", "SciBench_RL", problem=F.col("problem_text"), answer=F.array(_text("answer_number")), answer_type=F.array(F.lit("numerical")), unit=_text("unit"), domain=_text("source"))


def critpt(raw: DataFrame) -> DataFrame:
    """problem_id, problem_description, answer_code, code_template."""
    named = F.concat(F.lit("CritPt_"), F.coalesce(F.col("problem_id").cast("string"), F.format_string("CritPt_%05d", "ordinal")))
    return _rows(raw, "CritPt", "eval_tier3", "CritPt", problem_id=named, problem=F.col("problem_description"), answer=F.array(_text("answer_code")), answer_type=F.array(F.lit("code")), metadata=F.create_map(F.lit("code_template"), _text("code_template")))


def yale(raw: DataFrame) -> DataFrame:
    """id, questions, final_answers (list), graphs (list), domain: a file's stem without its tail."""
    domain = F.regexp_replace("domain", r"_dataset(_textonly)?", "")
    graph = F.create_map(F.lit("has_graph"), F.coalesce(F.size("graphs") > 0, F.lit(False)).cast("string"))
    return _rows(raw, "Yale_NLP", "eval_tier3", "Yale_NLP", problem_id=F.concat(F.lit("Yale_NLP_"), _text("id")), problem=F.col("questions"), answer=F.col("final_answers"), answer_type=F.array(F.lit("unknown")), domain=domain, metadata=graph)


def abench(raw: DataFrame, subset: str = "Phy_B") -> DataFrame:
    """mid, standard_question, standard_answer (all strings)."""
    if subset not in ("Phy_A", "Phy_B"):
        raise ValueError(subset)
    named = F.format_string(f"ABench_{subset}_%s_%04d", F.coalesce("mid", F.format_string(f"{subset}_%04d", "ordinal")), F.col("ordinal"))
    return _rows(raw, f"ABench_{subset}", "eval_tier2", "ABench", problem_id=named, problem=F.col("standard_question"), answer=F.array("standard_answer"), answer_type=F.array(F.lit("numerical")), metadata=F.create_map(F.lit("mid"), _text("mid")))


def worked(raw: DataFrame) -> DataFrame:
    """question and a worked answer that ends in #### and a number: the number boxed is the gold; rows without one go."""
    gold = F.trim(F.replace(F.regexp_extract("answer", r"####\s*(.+)", 1), F.lit(","), F.lit("")))
    return _rows(raw.where(gold != ""), "worked", "train_candidate", "worked", problem=F.col("question"), answer=F.array(F.concat(F.lit("\\boxed{"), gold, F.lit("}"))), answer_type=F.array(F.lit("numerical")))


def errors(raw: Column, parts: Column, least: float = 1e-8) -> Column:
    """A tolerance for each of ``parts`` answers from a comma-joined string: the last one repeats, ``least`` where there is none."""
    read = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    last = F.coalesce(F.try_element_at(read, F.lit(-1)), F.lit(least))
    return F.slice(F.concat(read, F.array_repeat(last, parts)), F.lit(1), parts)
