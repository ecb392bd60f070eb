"""The queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import whole_texts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return whole_texts(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from quarry.llm import bpe

    source = bpe.read_text(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.digest(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), source), source, hashed=True))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from quarry.llm import bpe, token_counts

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), bpe.read_text(public_tokenizers.path("word_bpe_49k.json")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import language_id as li
    from quarry.llm.common import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = li.predict(docs, li.fit(li.learning_rows(docs)))
    return found.select("doc_id", held_out(found.doc_id).alias("held_out"), "lang_pred", "score", "margin")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import toxicity as tox
    from quarry.llm.common import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = tox.score(docs, tox.fit(docs, tox.learning_labels(table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", held_out(scored.doc_id).alias("held_out"), "score", "predicted")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import quality as ql
    from quarry.llm.common import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ql.score(docs, ql.fit(docs, ql.learning_labels(table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", held_out(scored.doc_id).alias("held_out"), "score", "predicted")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import jaccard_join

    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))[0]


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import decontamination

    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import ann

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from quarry.llm import suffix_dedup

    left = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_licenses": op2_licenses,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_bpe": op5_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_nearest": op7_nearest,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEQUENCES = "unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')))"

#: Containment of each item's distinct shingles in each document.
CONTAINMENT = f"""WITH it AS (SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, k, {_SEQUENCES.format(k="k")} AS g FROM it), n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
dg AS (SELECT DISTINCT r, doc_id, k, {_SEQUENCES.format(k="k")} AS g FROM d, (SELECT DISTINCT k FROM it))
SELECT DISTINCT doc_id, item_id, n_common, n AS n_item FROM (SELECT r, doc_id, item_id, count(*) AS n_common FROM dg JOIN ig USING (k, g) GROUP BY ALL) JOIN n USING (item_id) WHERE 100 * n_common >= 80 * n"""

#: Windows of 400 bytes, as hexadecimal digits, that stand twice; the runs that they cover; what is left.
WINDOWS = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, hash(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d)),
t AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1), s AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM t)),
p AS (SELECT r, i, max(i + 400) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
g AS (SELECT r, i, sum(CASE WHEN b IS NULL OR i > b THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM p),
runs AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY r, k),
cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs),
l AS (SELECT r, count(*) AS n, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS pieces FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(pieces, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN l USING (r)"""

#: Sets of shingles, links by exact counts, the smallest reachable id.
LINKS = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, doc_id, {_SEQUENCES.format(k="least(len(w), 5)")} AS g FROM d WHERE len(w) > 0), n AS (SELECT r, doc_id, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.r < y.r GROUP BY ALL),
l AS (SELECT DISTINCT u.doc_id AS a, v.doc_id AS b FROM c JOIN n u ON u.r = a JOIN n v ON v.r = b WHERE 100 * c >= 80 * (u.n + v.n - c) AND u.doc_id <> v.doc_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, m.low) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = d.doc_id"""

#: Those that SQL can express over whole tables; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op3_decontamination": CONTAINMENT, "op6_suffix_dedup": WINDOWS, "op8_jaccard_join": LINKS}
