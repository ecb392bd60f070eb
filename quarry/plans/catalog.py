"""All queries over the driver's tables, each with its SQL twin where there is one.

``documents`` stand for candidate rows, ``benchmark`` for the evaluation set,
``events`` for attempts (a user is a problem), ``lineitem`` for bulk verdicts,
``part`` and ``customer`` for strata.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import latex
from quarry.functions import text as t
from quarry.operators import dedup, rollouts, strata
from quarry.sources.scratch import written

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = (lambda spark, sf_dir: fn(Tables(spark, sf_dir)), sql)
        return fn

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def priority():
    return F.substring("source", 4, 9).cast("int")

COLLAPSED = f"regexp_replace(lower(text), '{t.SPACE}+', ' ', 'g')"
NORM = rf"trim(regexp_replace({COLLAPSED}, '[^\p{{L}}\p{{N}}\s\\{{}}^_]', '', 'g'))"
ATTEMPTS = "(SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rollout, value > 50 AS correct, value, event_id FROM events)"
PER = f"(SELECT user_id, count(*) AS n, count(*) FILTER (WHERE correct) AS c FROM {ATTEMPTS} GROUP BY user_id)"
BULK = "(SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS c FROM lineitem GROUP BY l_orderkey)"


def attempts(d: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return d.events.select("user_id", "event_type", place.alias("rollout"), (F.col("value") > 50).alias("correct"), "value", "event_id")


def per_user(d: Tables) -> DataFrame:
    return rollouts.per_problem(attempts(d), "user_id")


def per_order(d: Tables) -> DataFrame:
    return rollouts.per_problem(d.lineitem.select("l_orderkey", (F.col("l_returnflag") == "R").alias("correct")), "l_orderkey")


# ---- dedup and decontamination


@query(f"SELECT doc_id, source, row_number() OVER (PARTITION BY sha256({NORM}) ORDER BY CAST(substr(source, 4) AS INT), doc_id) = 1 AS kept FROM documents")
def exact_dedup(d):
    return dedup.exact_dedup(d.documents, t.exact_key(F.col("text")), priority(), F.col("doc_id")).select("doc_id", "source", "kept")


@query(f"""WITH k AS (SELECT doc_id, source, {NORM} AS norm, row_number() OVER (PARTITION BY {NORM} ORDER BY CAST(substr(source, 4) AS INT), doc_id) AS p FROM documents)
SELECT a.source AS kept_source, b.source AS removed_source, count(*) AS n FROM k a JOIN k b ON a.norm = b.norm AND a.p = 1 AND b.p > 1 GROUP BY ALL""")
def source_pair_overlap(d):
    k = dedup.exact_dedup(d.documents, t.exact_key(F.col("text")), priority(), F.col("doc_id")).select("key", "source", "kept")
    first = k.where("kept").select("key", F.col("source").alias("kept_source"))
    return k.where("not kept").join(first, "key").groupBy("kept_source", F.col("source").alias("removed_source")).agg(F.count("*").alias("n"))


@query(f"""WITH k AS (SELECT doc_id, source, lang, text, n_chars, row_number() OVER (PARTITION BY {NORM} ORDER BY CAST(substr(source, 4) AS INT), doc_id) AS p FROM documents)
SELECT source, count(*) AS n_input, count(*) FILTER (WHERE p = 1) AS n_exact, count(*) FILTER (WHERE p = 1 AND lang = 'en') AS n_english, count(*) FILTER (WHERE p = 1 AND lang = 'en' AND n_chars >= 200) AS n_kept FROM k GROUP BY source""")
def curation_funnel(d):
    k = dedup.exact_dedup(d.documents, t.exact_key(F.col("text")), priority(), F.col("doc_id"))
    one, en = F.col("kept"), F.col("lang") == "en"
    return k.groupBy("source").agg(F.count("*").alias("n_input"), F.count_if(one).alias("n_exact"), F.count_if(one & en).alias("n_english"), F.count_if(one & en & (F.col("n_chars") >= 200)).alias("n_kept"))


@query(f"SELECT doc_id, md5(trim({COLLAPSED})) AS light_key, substr(md5(coalesce(text, '') || '|||' || coalesce(lang, '')), 1, 16) AS problem_hash FROM documents")
def row_keys(d):
    return d.documents.select("doc_id", t.light_key(F.col("text")).alias("light_key"), t.problem_hash(F.col("text"), F.col("lang")).alias("problem_hash"))


PAIRS = f"""WITH k AS (SELECT doc_id, source, {NORM} AS norm, row_number() OVER (PARTITION BY {NORM} ORDER BY CAST(substr(source, 4) AS INT), doc_id) AS place FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(norm) - 3), lambda i: substr(norm, CAST(i AS BIGINT), 5))) AS g FROM k WHERE place = 1 AND length(norm) >= 5),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
p AS (SELECT a, b, c / (u.n + v.n - c) AS s FROM o JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE c / (u.n + v.n - c) >= 0.8)"""


def question_pairs(d: Tables, pairs: Callable) -> DataFrame:
    """Pairs among the rows that exact dedup keeps. Texts are normalized once and written; ids and digests are dealt out, not texts."""
    norm = t.normalize_question(F.col("text"))
    told = written(d.documents.select("doc_id", "source", norm.alias("norm")).withColumns({"long": F.sha2("norm", 256), "node": F.xxhash64("norm")}))
    kept = dedup.exact_dedup(told.drop("norm"), F.col("long"), priority(), F.col("doc_id")).where("kept")
    return pairs(told, "doc_id", "norm", firsts=written(kept.select("node", F.col("doc_id").alias("id"))))


@query(f"{PAIRS} SELECT a, b, round(s, 6) AS similarity FROM p")
def near_dup_pairs(d):
    return question_pairs(d, dedup.similar_pairs).select("a", "b", r6("similarity", "similarity"))


@query()
def near_dup_minhash(d):
    return question_pairs(d, dedup.minhash_pairs).select("a", "b", r6("similarity", "similarity"))


@query(f"""{PAIRS}
SELECT DISTINCT CASE WHEN (CAST(substr(s.source, 4) AS INT), a) < (CAST(substr(q.source, 4) AS INT), b) THEN b ELSE a END AS doc_id FROM p JOIN documents s ON s.doc_id = a JOIN documents q ON q.doc_id = b""")
def near_dup_removed(d):
    rank = d.documents.select(F.col("doc_id").alias("id"), F.struct(priority().alias("p"), "doc_id").alias("rank"))
    return dedup.survivors(question_pairs(d, dedup.similar_pairs), rank).select(F.col("id").alias("doc_id"))


@query(f"SELECT doc_id FROM documents WHERE sha256({NORM}) IN (SELECT sha256({NORM}) FROM benchmark)")
def exact_contamination(d):
    return dedup.contaminated(d.documents, d.benchmark, t.exact_key(F.col("text"))).select("doc_id")


@query(f"""WITH k AS (SELECT DISTINCT 0 AS side, {NORM} AS norm FROM documents UNION ALL SELECT DISTINCT 1, {NORM} FROM benchmark),
g AS (SELECT DISTINCT side, norm, unnest(list_transform(range(1, length(norm) - 3), lambda i: substr(norm, CAST(i AS BIGINT), 5))) AS g FROM k WHERE length(norm) >= 5),
n AS (SELECT side, norm, count(*) AS n FROM g GROUP BY ALL),
o AS (SELECT x.norm AS a, y.norm AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.side = 0 AND y.side = 1 GROUP BY ALL),
p AS (SELECT a FROM o JOIN n u ON u.norm = a AND u.side = 0 JOIN n v ON v.norm = b AND v.side = 1 WHERE c / (u.n + v.n - c) >= 0.8)
SELECT doc_id FROM documents WHERE {NORM} IN (SELECT norm FROM k WHERE side = 1) OR {NORM} IN (SELECT a FROM p)""")
def contamination(d):
    return dedup.contaminated_near(d.documents, d.benchmark, "text").select("doc_id")


@query("SELECT x.source AS a, y.source AS b, count(*) AS n FROM (SELECT DISTINCT source, md5(text) AS h FROM documents) x JOIN (SELECT DISTINCT source, md5(text) AS h FROM documents) y ON x.h = y.h AND x.source < y.source GROUP BY ALL")
def source_disjointness(d):
    h = d.documents.select("source", F.md5("text").alias("h")).distinct()
    return h.select(F.col("source").alias("a"), "h").join(h.select(F.col("source").alias("b"), "h"), "h").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


# ---- text rules


@query(r"""SELECT doc_id, CASE WHEN lower(trim(coalesce(lang, 'en'))) NOT IN ('en', '', 'nan') THEN 'non_english_language' WHEN regexp_matches(trim(text), '(?i)^(explain|describe|discuss)\b') THEN 'explanation_primary'
WHEN regexp_matches(trim(text), '^\\boxed\{C_?\{?[12]\}?,\s*C_?\{?[12]\}?\}$') THEN 'placeholder_gold' WHEN regexp_matches(text, '[一-鿿぀-ヿ㐀-䶿؀-ۿऀ-ॿ가-힯]') THEN 'non_latin_script_gold' END AS filter_reason FROM documents""")
def filter_chain(d):
    return d.documents.select("doc_id", t.filter_reason(F.col("text"), F.col("text"), F.col("lang")).alias("filter_reason"))


PROSE = r"""(regexp_matches(x, '^[A-Za-z_]\s*=\s*.{5,}=\s*[0-9]') OR (length(x) > 60 AND NOT regexp_matches(x, '[\\{}_^]') AND regexp_matches(x, '[a-z]{4,}\s[a-z]{4,}')) OR (regexp_matches(x, '^[A-Z][a-z]+ [a-z]') AND length(x) > 40)
OR regexp_matches(x, '[A-Za-z]{3,}:\s*[$\\]') OR regexp_matches(x, '\n\s*[A-Za-z]') OR regexp_matches(x, '\\approx\s*[-−]?[0-9]') OR regexp_matches(x, '(?i)\bapproximately\s+[-−]?[0-9]'))"""


@query(f"SELECT doc_id, {PROSE} AS prose, length(x) - length(replace(x, '!', '')) > 50 AS degenerate FROM (SELECT doc_id, text AS x FROM documents)")
def prose_and_degenerate(d):
    x = F.col("text")
    return d.documents.select("doc_id", t.prose_gold(x).alias("prose"), (F.length(x) - F.length(F.replace(x, F.lit("!"), F.lit(""))) > 50).alias("degenerate"))


@query(r"SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS slug, length(html) / 3.5 AS tokens, (length(html) - length(replace(html, '{', ''))) - (length(html) - length(replace(html, '}', ''))) AS balance FROM pages")
def page_text_functions(d):
    return d.pages.select("page_id", t.slug(F.col("url")).alias("slug"), t.token_estimate(F.col("html")).alias("tokens"), t.brace_balance(F.col("html")).alias("balance"))


@query("SELECT CASE WHEN n_chars <= 0 THEN '0' WHEN n_chars <= 20 THEN '1-20' WHEN n_chars <= 100 THEN '21-100' WHEN n_chars <= 200 THEN '101-200' ELSE '>200' END AS bucket, count(*) AS n FROM documents GROUP BY ALL")
def length_buckets(d):
    n = F.col("n_chars")
    bucket = F.when(n <= 0, "0").when(n <= 20, "1-20").when(n <= 100, "21-100").when(n <= 200, "101-200").otherwise(">200")
    return d.documents.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS gold, '$' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '$' AS wrapped, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS stripped, round(CAST(CAST(l_quantity AS BIGINT) AS DOUBLE), 6) AS value FROM lineitem")
def wrapped_numbers(d):
    whole = F.col("l_quantity").cast("bigint").cast("string")
    wrapped = F.concat(F.lit("$"), whole, F.lit("$"))
    return d.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("gold"), wrapped.alias("wrapped"), t.strip_dollars(wrapped).alias("stripped"), r6(t.number(t.strip_dollars(wrapped)), "value"))


@query("SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, length(props) AS n FROM events")
def json_props(d):
    return d.events.select("event_id", F.get_json_object("props", "$.k").isNotNull().alias("has_k"), F.length("props").alias("n"))


# ---- attempts


@query(f"SELECT user_id, n AS n_rollouts, c AS n_correct, round(c / n, 6) AS pass_fraction FROM {PER}")
def problem_rollup(d):
    return per_user(d).select("user_id", "n_rollouts", "n_correct", r6("pass_fraction", "pass_fraction"))


@query(f"""SELECT l_orderkey, CASE WHEN n - c < 1 THEN 1.0 ELSE round(1 - (n - c) / n, 6) END AS pass_1, CASE WHEN n - c < 2 THEN 1.0 ELSE round(1 - ((n - c) / n) * ((n - c - 1) / (n - 1)), 6) END AS pass_2 FROM {BULK}""")
def pass_at_k(d):
    return per_order(d).select("l_orderkey", r6(rollouts.pass_at(1), "pass_1"), r6(rollouts.pass_at(2), "pass_2"))


@query(f"SELECT count(*) AS n, round(avg(CASE WHEN c = n THEN 1.0 ELSE 0.0 END), 6) AS all_right, round(avg(CASE WHEN c = 0 THEN 1.0 ELSE 0.0 END), 6) AS all_wrong, round(avg(CASE WHEN c = n OR c = 0 THEN 1.0 ELSE 0.0 END), 6) AS saturated, round(avg(CASE WHEN c > 0 AND c < n THEN 1.0 ELSE 0.0 END), 6) AS informative FROM {BULK}")
def saturation(d):
    s = rollouts.saturation(per_order(d))
    return s.select("n", *(r6(c, c) for c in ("all_right", "all_wrong", "saturated", "informative")))


@query(f"""SELECT user_id, round(greatest((c / n + 1.9208 / n) / (1 + 3.8416 / n) - 1.96 * sqrt((c / n) * (1 - c / n) / n + 0.9604 / (n * n)) / (1 + 3.8416 / n), 0), 6) AS low,
round(least((c / n + 1.9208 / n) / (1 + 3.8416 / n) + 1.96 * sqrt((c / n) * (1 - c / n) / n + 0.9604 / (n * n)) / (1 + 3.8416 / n), 1), 6) AS high FROM {PER}""")
def wilson_intervals(d):
    low, high = rollouts.wilson(F.col("pass_fraction"), F.col("n_rollouts"))
    return per_user(d).select("user_id", r6(low, "low"), r6(high, "high"))


@query(f"SELECT event_type, count(*) AS n, round(avg(CASE WHEN c / n >= 0.15 AND c / n <= 0.85 THEN 1.0 ELSE 0.0 END), 6) AS goldilocks, round(avg(CASE WHEN c / n > 0.85 THEN 1.0 ELSE 0.0 END), 6) AS easy, round(avg(CASE WHEN c / n < 0.15 THEN 1.0 ELSE 0.0 END), 6) AS hard FROM (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE correct) AS c FROM {ATTEMPTS} GROUP BY ALL) GROUP BY GROUPING SETS ((event_type), ())")
def goldilocks(d):
    p = rollouts.per_problem(attempts(d), "user_id", "event_type")
    f = F.col("pass_fraction")
    share = lambda c, name: r6(F.avg(c.cast("double")), name)
    return p.rollup("event_type").agg(F.count("*").alias("n"), share(f.between(0.15, 0.85), "goldilocks"), share(f > 0.85, "easy"), share(f < 0.15, "hard"))


@query(f"SELECT k AS n_correct, count(p.c) AS n FROM range(0, 14) t(k) LEFT JOIN {BULK} p ON p.c = k GROUP BY k")
def correct_histogram(d):
    counts = per_order(d).groupBy("n_correct").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n_correct")).first()[0] or 0  # one row
    k = d.spark.range(max(13, most) + 1).withColumnRenamed("id", "n_correct")
    return k.join(F.broadcast(counts), "n_correct", "left").select("n_correct", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT threshold, count(*) FILTER (WHERE c / n >= threshold) AS n FROM {BULK}, (SELECT CAST(unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS DOUBLE) AS threshold) GROUP BY threshold")
def threshold_sweep(d):
    at = [0.0, 0.25, 0.5, 0.75, 1.0]
    counts = per_order(d).agg(*(F.count_if(F.col("pass_fraction") >= x).alias(f"t{i}") for i, x in enumerate(at)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(x).alias("threshold"), F.col(f"t{i}").alias("n")) for i, x in enumerate(at)))))


@query("SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def value_percentiles(d):
    p = lambda q, name: r6(F.percentile("value", q), name)
    return d.events.groupBy("event_type").agg(p(0.1, "p10"), p(0.5, "p50"), p(0.95, "p95"), r6(F.avg("value"), "mean"), r6(F.coalesce(F.stddev_samp("value"), F.lit(0)), "sd"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT c_mktsegment, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (c_mktsegment, n_name)")
def crosstab_margins(d):
    return d.customer.join(F.broadcast(d.nation), F.col("c_nationkey") == F.col("n_nationkey")).cube("c_mktsegment", "n_name").agg(F.count("*").alias("n"))


@query("SELECT l_shipmonth, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS a, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 6) AS n, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 6) AS r FROM (SELECT *, month(l_shipdate) AS l_shipmonth FROM lineitem) GROUP BY l_shipmonth")
def pivot_means(d):
    out = d.lineitem.groupBy(F.month("l_shipdate").alias("l_shipmonth")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))
    return out.select("l_shipmonth", r6("A", "a"), r6("N", "n"), r6("R", "r"))


@query(f"SELECT CASE WHEN r <= 0.001 THEN '0' WHEN r <= 0.124 THEN '1/8' WHEN r <= 0.375 THEN '2-3/8' WHEN r <= 0.624 THEN '4-5/8' WHEN r <= 0.875 THEN '6-7/8' ELSE '8/8' END AS band, count(*) AS n FROM (SELECT c / n AS r FROM {BULK}) GROUP BY ALL")
def pass_rate_bands(d):
    return per_order(d).groupBy(t.band(F.col("pass_fraction")).alias("band")).agg(F.count("*").alias("n"))


@query(f"SELECT user_id, event_id FROM {ATTEMPTS} WHERE rollout <= 8")
def first_eight(d):
    return dedup.keep_first(d.events, ["user_id"], 8, F.col("event_id")).select("user_id", "event_id")


@query(f"SELECT count(*) FILTER (WHERE k >= 8) AS n_full, count(*) FILTER (WHERE k > 0 AND k < 8) AS n_partial, count(*) FILTER (WHERE k = 0) AS n_missing FROM (SELECT c_custkey, count(event_id) AS k FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey)")
def coverage(d):
    k = d.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("event_id").alias("k"))
    k = d.customer.select("c_custkey").join(k, "c_custkey", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    return k.agg(F.count_if(F.col("k") >= 8).alias("n_full"), F.count_if((F.col("k") > 0) & (F.col("k") < 8)).alias("n_partial"), F.count_if(F.col("k") == 0).alias("n_missing"))


@query(f"SELECT user_id FROM {PER} WHERE n = (SELECT n FROM {PER} GROUP BY n ORDER BY count(*) DESC, n LIMIT 1) AND c BETWEEN 1 AND n - 1")
def complete_groups(d):
    p = per_user(d)
    modal = p.agg(F.mode("n_rollouts", True).alias("modal"))  # one row
    return p.join(F.broadcast(modal), F.col("n_rollouts") == F.col("modal")).where("n_correct between 1 and n_rollouts - 1").select("user_id")


# ---- joins and sets


@query("SELECT doc_id, text IS NOT NULL AS has_text, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def scores_left_join(d):
    return d.documents.join(d.labels, "doc_id", "left").select("doc_id", F.col("text").isNotNull().alias("has_text"), "quality", "toxic")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join(d):
    return d.documents.join(d.labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_join(d):
    return d.documents.join(d.labels, "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id, lang, CASE WHEN l.toxic = 1 THEN 'quarantine' ELSE source END AS source FROM documents LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) l USING (doc_id)")
def patch_join(d):
    changes = d.labels.where("toxic = 1").select("doc_id", F.lit("quarantine").alias("source"))
    return rollouts.patch(d.documents.select("doc_id", "lang", "source"), changes, "doc_id", ["source"])


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins(d):
    return d.events.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS wins, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS losses, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS both_wrong, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM documents JOIN labels USING (doc_id)")
def win_loss(d):
    q, x = F.col("quality") == 1, F.col("toxic") == 1
    return d.documents.select("doc_id").join(d.labels, "doc_id").agg(F.count_if(q & ~x).alias("wins"), F.count_if(~q & x).alias("losses"), F.count_if(~q & ~x).alias("both_wrong"), r6(F.avg((q == x).cast("double")), "agreement"))


@query("SELECT 'a' AS pool, struct_pack(source := source, score := CAST(NULL AS VARCHAR)).source AS source, CAST(NULL AS VARCHAR) AS score, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'b', NULL, CAST(n_chars AS VARCHAR), doc_id FROM documents WHERE lang <> 'en'")
def union_structs(d):
    a = d.documents.where("lang = 'en'").select(F.lit("a").alias("pool"), "doc_id", F.struct("source").alias("info"))
    b = d.documents.where("lang <> 'en'").select(F.lit("b").alias("pool"), "doc_id", F.struct(F.col("n_chars").cast("string").alias("score")).alias("info"))
    return a.unionByName(b, allowMissingColumns=True).select("pool", "info.source", "info.score", "doc_id")


@query("(SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase') UNION ALL (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')")
def key_sets(d):
    one, two = (d.events.where(F.col("event_type") == x).select("user_id") for x in ("click", "purchase"))
    return one.subtract(two).unionAll(one.intersect(two))


# ---- samples and splits


@query("""WITH s AS (SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42|' || p_partkey), p_partkey) AS i FROM part),
q AS (SELECT *, least(round_even(n * 0.1, 0), n - 1) AS d FROM s), w AS (SELECT *, least(round_even(n * 0.1, 0), n - 1 - d) AS e FROM q)
SELECT p_partkey, p_brand, CASE WHEN i <= d THEN 'dev' WHEN i <= d + e THEN 'test' ELSE 'train' END AS part FROM w""")
def stratified_split(d):
    return strata.split(d.part.select("p_partkey", "p_brand"), "p_brand", "p_partkey", 0.1, 0.1)


@query("""WITH s AS (SELECT p_brand, count(*) AS n, least(3, count(*)) AS base FROM part GROUP BY p_brand), w AS (SELECT *, greatest(150 - sum(base) OVER (), 0) AS room, greatest(sum(n - base) OVER (), 1) AS rooms FROM s),
x AS (SELECT *, least(n - base, floor(room * (n - base) / rooms)) AS extra FROM w), y AS (SELECT *, room - sum(extra) OVER () AS over_, row_number() OVER (ORDER BY n - base - extra DESC, p_brand) AS turn FROM x),
z AS (SELECT p_brand, base + extra + CASE WHEN turn <= over_ AND n > base + extra THEN 1 ELSE 0 END AS share FROM y)
SELECT p_partkey, p_brand FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42|' || p_partkey), p_partkey) AS i FROM part) JOIN z USING (p_brand) WHERE i <= share""")
def floor_sample(d):
    return strata.sample(d.part.select("p_partkey", "p_brand"), "p_brand", "p_partkey", 150, 3)


@query("SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7|' || c_custkey), c_custkey) AS i FROM customer) WHERE i <= 5")
def sample_per_stratum(d):
    return dedup.keep_first(d.customer, ["c_mktsegment"], 5, strata.draw(7, F.col("c_custkey")), F.col("c_custkey")).select("c_custkey", "c_mktsegment")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY i, s_nationkey) AS position FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)")
def round_robin(d):
    return strata.interleave(d.supplier, "s_nationkey", "s_suppkey").select("s_suppkey", "position")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents QUALIFY ordinal >= 100 AND ordinal < 150")
def shard_slice(d):
    few = d.documents.select("doc_id").orderBy("doc_id").offset(100).limit(50)
    return few.select("doc_id", (F.row_number().over(Window.orderBy("doc_id")) + 99).alias("ordinal"))


# ---- prompts and nested rows


@query("SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn, role) AS roles, count(*) FILTER (WHERE role = 'system') AS n_system FROM conversations GROUP BY conv_id")
def prompt_build(d):
    prompt = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    p = d.conversations.groupBy("conv_id").agg(prompt.alias("prompt"))
    return p.select("conv_id", F.size("prompt").cast("long").alias("n_turns"), F.array_join(F.col("prompt.role"), ">").alias("roles"), F.size(F.filter("prompt", lambda m: m["role"] == "system")).cast("long").alias("n_system"))


@query("SELECT conv_id, md5(string_agg(CASE WHEN turn = m AND role = 'system' THEN 'Answer in a box.' ELSE text END, chr(10) ORDER BY turn, role, text)) AS digest FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY conv_id")
def prompt_rewrite(d):
    p = d.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("p"))
    texts = F.transform("p", lambda m: F.when((m["turn"] == F.col("p")[0]["turn"]) & (m["role"] == "system"), F.lit("Answer in a box.")).otherwise(m["text"]))
    return p.select("conv_id", F.md5(F.array_join(texts, "\n")).alias("digest"))


# ---- verification


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN abs(l_quantity) < 1e-12 THEN abs(l_quantity * (1 + l_tax)) < 0.05 ELSE abs(l_quantity * (1 + l_tax) - l_quantity) <= 0.05 * abs(l_quantity) END AS correct FROM lineitem")
def numeric_tolerance(d):
    q = F.col("l_quantity")
    return d.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", t.within_tolerance(q * (1 + F.col("l_tax")), q).alias("correct"))


@query("SELECT s_suppkey, 1.0 AS same, CASE WHEN s_suppkey = 0 THEN 1.0 ELSE 0.0 END AS wrong, -1.0 AS open FROM supplier")
def verify_boxed(d):
    n = F.col("s_suppkey").cast("string")
    box = F.concat(F.lit("So \\boxed{"), n, F.lit("}"))
    double = lambda c, name: c.cast("double").alias(name)
    return d.supplier.select("s_suppkey", double(latex.verify_answer(box, n, F.lit("numerical")), "same"), double(latex.verify_answer(F.concat(F.lit("the answer is -"), n), n, F.lit("numerical")), "wrong"), double(latex.verify_answer(box, n, F.lit("open_end")), "open")).select("s_suppkey", F.col("same").cast("decimal(2,1)").alias("same"), F.col("wrong").cast("decimal(2,1)").alias("wrong"), F.col("open").cast("decimal(2,1)").alias("open"))


@query("SELECT bool_and(l_returnflag <> 'R') AS all_correct, l_partkey FROM lineitem GROUP BY l_partkey")
def all_variants_correct(d):
    return d.lineitem.groupBy("l_partkey").agg(F.bool_and(F.col("l_returnflag") != "R").alias("all_correct"))


# ---- data quality


@query("SELECT 'text' AS col, count(*) FILTER (WHERE text IS NULL) AS n_null FROM documents UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL) FROM documents UNION ALL SELECT 'source', count(*) FILTER (WHERE source IS NULL) FROM documents")
def null_profile(d):
    names = ("text", "lang", "source")
    counts = d.documents.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in names))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("n_null")) for c in names))))


@query("SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS n_dup FROM lineitem")
def duplicate_keys(d):
    k = d.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("m"))
    return k.agg(F.sum("m").alias("n"), F.sum(F.col("m") - 1).alias("n_dup"))


@query("SELECT source, CASE WHEN avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) > 0.05 THEN 'drop' WHEN avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END) > 0.6 THEN 'flag' ELSE 'keep' END AS advice FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def source_advice(d):
    j = d.documents.select("doc_id", "source").join(d.labels, "doc_id", "left")
    bad, open_ = F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0)), F.avg(F.when(F.col("quality").isNull(), 1.0).otherwise(0.0))
    return j.groupBy("source").agg(F.when(bad > 0.05, "drop").when(open_ > 0.6, "flag").otherwise("keep").alias("advice"))


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources, round(avg(n_chars), 6) AS mean_chars, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 10")
def top_languages(d):
    g = d.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), r6(F.avg("n_chars"), "mean_chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    return g.orderBy(F.desc("n"), "lang").limit(10)


from quarry.plans import more  # noqa: E402, F401  its queries register themselves
