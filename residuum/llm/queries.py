"""Registered queries of the training-data operators, with SQL where SQL can say them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.llm import conversations, html_text, language_model, order_minhash, pii, secrets, toxicity, url_filter, va_clusters
from residuum.llm.bpe import decode, encode
from residuum.llm.decontaminate import contained_items
from residuum.llm.near_dedup import near_duplicates
from residuum.llm.quality_rules import BOILERPLATE_RULE, CLOSED_RULE, NAVIGATION_RULE, judge
from residuum.storage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: A-Z lower-cased, then split into words, as DuckDB lists; a text column t is expected.
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.o = e.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o) AS component_id, r.doc_id = min(o) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


@query("op1_minhash_near_dedup", NEAR_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), n=3, percent=85).withColumnRenamed("id", "doc_id")


LEAK_SQL = f"""
WITH dw AS (SELECT doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
iw AS (SELECT item_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, len(w[1:5]) AS k, g FROM (
  SELECT item_id, w, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
  FROM iw WHERE len(w) > 0)),
d AS (SELECT DISTINCT doc_id, k, g FROM (
  SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM dw, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS s FROM d JOIN i USING (k, g) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item_shingles, s AS n_shared, s / n AS containment FROM c JOIN n USING (item_id) WHERE 100 * s >= 80 * n
"""


@query("op3_benchmark_decontamination", LEAK_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUALITY_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, text, {WORDS.format('text')} AS w, string_split(text, chr(10)) AS l FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g
  FROM b WHERE len(w) > 8)),
r AS (SELECT doc_id, sum(step) AS n FROM (
  SELECT doc_id, least(8, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 8)) AS step FROM g WHERE c > 1) GROUP BY 1),
x AS (SELECT doc_id, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM (
  SELECT doc_id, unnest(l) AS line FROM b) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
v AS (SELECT doc_id, line, length(s) AS n,
  length(s) - length(translate(s, '#*$%&|<>', '')) <= length(s) * 0.08
  AND NOT (upper(s) = s AND lower(s) <> s AND regexp_matches(s, '[^ ]+ [^ ]+ [^ ]+'))
  AND NOT regexp_matches(lower(s), '{BOILERPLATE_RULE}') AND NOT regexp_matches(s, '{NAVIGATION_RULE}')
  AND (regexp_matches(s, '{CLOSED_RULE.replace("'", "''")}') OR regexp_matches(s, '^([^ ]+[ ]+){{9}}')) AS ok FROM x),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (NOT ok), 0) / sum(n) AS lost FROM v GROUP BY 1),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 1.0) AS lost FROM b LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT * EXCLUDE (lost), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= 0.5 AS kept FROM m
"""


@query("op8_quality_rules", QUALITY_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def id_digest(ids: str = "ids"):
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)


@query("op6_bpe_codec")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ids = encode(docs, vocabulary()).drop("text")
    return decode(ids, vocabulary()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), id_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def fold(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(fold(4) != 2)
    model = toxicity.train(toxicity.labelled_rows(docs, labels, fold(4) != 2))
    scored = cut(toxicity.raw_scores(docs, model).drop("text"), "toxicity")
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = toxicity.decision_point(scored.join(marked, "doc_id"), model)
    scored = scored.withColumn("score", toxicity.probability(F.col("raw"), model)).drop("raw")
    limits = toxicity.language_thresholds(scored.join(marked, "doc_id"))
    out = scored.join(limits, scored["lang"].eqNullSafe(limits["lang"]), "left").drop(limits["lang"])
    return out.select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= toxicity.CUT, 1).otherwise(0).alias("predicted"), "lang",
        F.coalesce("threshold", F.lit(toxicity.CUT)).alias("lang_threshold"),
        (F.col("score") >= F.coalesce("threshold", F.lit(toxicity.CUT))).alias("flagged"),
    )


@query("op10_pii")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find(docs, *pii.train(docs))
    return found.select("doc_id", *pii.counts("base_spans"), F.sha2(pii.digest("base_spans"), 256).alias("base_sha256"), pii.digest("spans").alias("spans"))


RULES = [
    url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/"),
]


@query("op9_url_filter")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    rule = url_filter.match(*url_filter.parts(F.col("url")), RULES)
    blocked = [r.name for r in RULES if r.verdict == "block"]
    labelled = pages.withColumn("rule", rule).where("rule IS NOT NULL").select("url", F.col("rule").isin(blocked).cast("double").alias("y"))
    return url_filter.judge(pages, RULES, url_filter.train(labelled)).select("page_id", "host", "path", "rule", "verdict", "score")


@query("op2_secret_scan")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    words = secrets.dictionary(docs)
    found = secrets.scan(docs, secrets.train(docs, words), words)
    return found.select("doc_id", F.explode("findings").alias("f")).select(
        "doc_id", F.col("f.start").alias("start_at"), F.col("f.end").alias("end_at"), F.sha2("f.value", 256).alias("value_sha256"), "f.score", "f.secret")


@query("op5_lm_score")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return language_model.score(docs, fold(5) != 1).withColumnRenamed("id", "doc_id")


@query("op4_html_text")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op11_document_fingerprints")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.with_edits(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op12_conversation_repair")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    damaged = conversations.damage(turns)
    audits = conversations.audit(damaged, turns)
    return conversations.digest(damaged, audits)


@query("op13_centroid_clusters")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    assigned, centroids = va_clusters.cluster(table(spark, folder, "embeddings"))
    assigned = cut(assigned, "va-assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total = sum(int(r["s"]) for r in sums)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(r["cluster"], str(r["s"]), str(total), names[r["cluster"]]) for r in sums]
    about = spark.createDataFrame(rows, "cluster int, own string, every string, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", F.col("own").try_cast("long").alias("cluster_inertia"),
        F.col("every").try_cast("long").alias("inertia"), "centroid_sha256")
