"""A corpus pipeline over the operators: each stage works on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is
written as Parquet and read again for the next one.

Decisions are about rows, not ids: a row's key is a digest of all its columns.
Rows with a null doc_id are treated like others, and so are different texts that
share a doc_id. Rows that are equal in every column are copies of each other.
Null texts are rejected by the language stage; each later stage keeps them as they
are. Columns other than those of ``documents`` are dropped. Empty tables stay so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontamination, jaccard_join, language_id, suffix_dedup
from quarry.llm.common import whole_texts, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts whose score is below this share of their language's median learning row are like no profile, and rejected.
LEAST_LANGUAGE_SHARE = 0.62
#: Passages of over so many words that repeat are cut. They are looked for as repeated strings of so many bytes: four for a word with its space.
REPEAT_WORDS, REPEAT_BYTES = 50, 200


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row_key"))


def _by_key(keyed: DataFrame) -> DataFrame:
    """What the operators see: the key in the place of the id, and the text."""
    return keyed.select(F.col("row_key").alias("doc_id"), "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; those without a letter, or like no profile, go."""
    keyed = _keyed(whole_texts(docs))
    learn = language_id.learning_rows(keyed)
    profiles = language_id.fit(learn)
    found = language_id.predict(_by_key(keyed), profiles).select(F.col("doc_id").alias("row_key"), "lang_pred", "score")
    found = written(found.where(F.col("lang_pred") != language_id.UNKNOWN).distinct())
    # a median, as learning rows may hold foreign texts too; only rows found as labelled count
    right = learn.select("row_key", F.col("lang").alias("lang_pred")).distinct().join(found, ["row_key", "lang_pred"])
    usual = right.groupBy("lang_pred").agg(F.percentile_approx("score", 0.5).alias("usual"))  # a row for each language
    found = found.join(F.broadcast(usual), "lang_pred", "left").where(F.col("score") >= LEAST_LANGUAGE_SHARE * F.coalesce("usual", F.lit(0.0)))
    return keyed.join(found.select("row_key"), "row_key", "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the row with the smallest doc_id (null last; of several, the smallest key)."""
    keyed = _keyed(whole_texts(docs))
    classes, _ = jaccard_join.join(_by_key(keyed))
    named = classes.select(F.col("doc_id").alias("row_key"), "component_id").join(keyed.select("row_key", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key").alias("place")), "row_key")
    first = named.groupBy("component_id").agg(F.min("place").alias("place")).select("place.row_key")
    return keyed.join(first, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that repeat, in any text, out of the texts; a character cut in half goes whole. Texts with nothing left go."""
    left = suffix_dedup.dedup(whole_texts(docs), REPEAT_BYTES, ("lang", "source", "n_chars"), REPEAT_WORDS)
    left = left.where((F.col("n_removed") == 0) | (F.length(F.trim("kept_text")) > 0))
    chars = F.when(F.col("n_removed") == 0, F.col("carried.n_chars")).otherwise(F.length("kept_text"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source", chars.cast("long").alias("n_chars"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    keyed = _keyed(whole_texts(docs))
    found = decontamination.find(_by_key(keyed), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(written(found.select(F.col("doc_id").alias("row_key")).distinct()), "row_key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and whether they decode to the text (null counts as empty)."""
    import public_tokenizers

    source = bpe.read_text(public_tokenizers.path("byte_bpe_50k.json"))
    keyed = _keyed(whole_texts(docs))
    decoded = bpe.decode(bpe.encode(_by_key(keyed), source), source).select(F.col("doc_id").alias("row_key"), "ids", F.sha2("decoded", 256).alias("digest"))
    told = keyed.select("row_key", F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("wanted")).distinct()
    both = decoded.join(told, "row_key")
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("digest") == F.col("wanted")).alias("decodes"))


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("benchmark", drop_benchmark),
    ("tokens", encode),
]

#: No stage but the near copies could be said in SQL; see the tests for brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
