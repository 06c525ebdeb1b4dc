"""Queries over loading, corpora and text normalisation."""

import uuid

from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.operators import corpus as C
from palisade.oracle import planted as _p  # noqa: F401
from palisade.oracle import text as O
from palisade.oracle.sql import cte
from palisade.plans.registry import query
from palisade.session import shared_folder
from palisade.sources.planted import messages, watchlist
from palisade.sources.tables import table


@query("load_messages", "SELECT conv_id, turn, ts_ms, direction, text FROM q_messages")
def load_messages(spark, folder):
    return messages(spark, folder).select("conv_id", "turn", "ts_ms", "direction", "text")


_FLAT = """
WITH e AS (SELECT conv_id, max(CASE WHEN direction = 'inbound' THEN truth_type END) AS t,
        max(truth_assessment) AS assessment FROM q_messages GROUP BY ALL)
SELECT 'case-' || conv_id AS case_id, turn, direction, text,
  t IS NOT NULL AS expected_detected, t AS expected_type, CASE WHEN t IS NULL THEN 'ALLOW' ELSE 'WARN' END AS expected_action,
  assessment
FROM q_messages JOIN e USING (conv_id)"""


@query("flatten_corpus", _FLAT)
def flatten_corpus(spark, folder):
    return C.flatten_cases(C.parse_cases(C.cases_as_json(messages(spark, folder))))


@query("flatten_corpus_files", _FLAT)
def flatten_corpus_files(spark, folder):
    """The same through JSON files: the corpus is written to the shared folder and read as files."""
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    C.write_corpus(C.cases_as_json(messages(spark, folder)), path)
    return C.flatten_cases(C.read_corpus(spark, path))


CASES = """
SELECT CASE conv_id % 3 WHEN 0 THEN 'development' WHEN 1 THEN 'regressions' ELSE 'holdout' END AS corpus,
  CASE WHEN conv_id % 29 = 5 THEN ' ' WHEN conv_id % 17 = 3 THEN 'c' || (conv_id - 1) ELSE 'c' || conv_id END AS case_id,
  CASE WHEN conv_id % 31 = 2 THEN 2 ELSE 1 END AS schema_version,
  count(*) AS n_messages, count(*) FILTER (WHERE length(trim(text)) = 0) AS blank_texts,
  CASE WHEN conv_id % 23 = 7 THEN 'BLOCK' WHEN max(truth_type) IS NULL THEN 'ALLOW' ELSE 'WARN' END AS action,
  conv_id % 19 = 4 OR max(truth_type) IS NOT NULL AS detected, max(truth_type) AS expected_type
FROM {messages} GROUP BY conv_id"""
cte("q_cases", CASES.format(messages="q_messages"))


def corpus_cases(spark, folder):
    return spark.sql(CASES.format(messages="{m}"), m=messages(spark, folder))


@query(
    "validate_corpus",
    """
SELECT corpus, rule, violations FROM (
  SELECT corpus, 'schema_version' AS rule, count(*) FILTER (WHERE schema_version <> 1) AS violations FROM q_cases GROUP BY corpus
  UNION ALL SELECT corpus, 'empty_id', count(*) FILTER (WHERE trim(case_id) = '') FROM q_cases GROUP BY corpus
  UNION ALL SELECT corpus, 'no_messages', count(*) FILTER (WHERE n_messages = 0) FROM q_cases GROUP BY corpus
  UNION ALL SELECT corpus, 'empty_text', count(*) FILTER (WHERE blank_texts > 0) FROM q_cases GROUP BY corpus
  UNION ALL SELECT corpus, 'unknown_action', count(*) FILTER (WHERE action NOT IN ('ALLOW','WARN','LOCK_INPUT')) FROM q_cases GROUP BY corpus
  UNION ALL SELECT corpus, 'detected_without_type', count(*) FILTER (WHERE detected <> (expected_type IS NOT NULL)) FROM q_cases GROUP BY corpus
  UNION ALL SELECT corpus, 'repeated_id', count(*) FILTER (WHERE n > 1)
    FROM (SELECT case_id, count(*) AS n, min(corpus) AS corpus FROM q_cases GROUP BY case_id) GROUP BY corpus)""",
)
def validate_corpus(spark, folder):
    return C.validate_cases(corpus_cases(spark, folder))


@query(
    "corpus_fingerprint",
    """
WITH h AS (SELECT source, sha256(replace(doc_id || '|' || text, chr(13) || chr(10), chr(10))) AS h FROM documents)
SELECT source, count(*) AS n_rows, sha256(concat_ws(':', count(*),
"""
    + ", ".join(f"sum(CAST('0x' || substr(h, {1 + 12 * i}, 12) AS BIGINT))" for i in range(5))
    + ")) AS fingerprint FROM h GROUP BY source",
)
def corpus_fingerprint(spark, folder):
    docs = table(spark, folder, "documents")
    return C.fingerprint(docs, "source", F.concat_ws("|", F.col("doc_id").cast("string"), "text"))


@query(
    "dialogue_history",
    """
WITH live AS (SELECT *, row_number() OVER (PARTITION BY conv_id, direction ORDER BY ts_ms DESC, turn DESC) AS rn
  FROM (SELECT *, max(ts_ms) OVER (PARTITION BY conv_id) AS end_ms FROM q_messages) WHERE end_ms - ts_ms < 900000)
SELECT conv_id, count(*) AS n_lines,
  string_agg(CASE direction WHEN 'outbound' THEN '[Ви]' ELSE '[Співрозмовник]' END || ': ' || text, chr(10) ORDER BY turn) AS history
FROM live WHERE rn <= 30 GROUP BY conv_id""",
)
def dialogue_history(spark, folder):
    return C.dialogue_history(messages(spark, folder))


OBFUSCATED = "[\\u200b-\\u200d\\ufeff\\u2060]|[Ѐ-ӿ][a-z0-9]|[a-z0-9][Ѐ-ӿ]|(?:^|\\s)\\S[ .]\\S[ .]\\S(?:[ .]|$)"
_OBF_SQL = OBFUSCATED.replace("\\u200b", "​").replace("\\u200d", "‍").replace("\\ufeff", "﻿").replace("\\u2060", "⁠")
cte("q_obfuscated", f"SELECT *, regexp_matches(lower(text), '{_OBF_SQL}') AS obfuscated FROM q_norm")


def profiled(df, *keep):
    """Messages with language columns and the normalised text."""
    p = df.withColumn("_p", T.language_profile(F.col("text")))
    p = p.select(
        *df.columns,
        F.col("_p.primary").alias("primary_lang"),
        F.col("_p.languages").alias("languages"),
        F.col("_p.is_mixed").alias("is_mixed"),
        F.col("_p.confidence").alias("confidence"),
        F.col("_p.script").alias("script"),
        F.col("_p.uk").alias("uk_score"),
        F.col("_p.en").alias("en_score"),
        F.col("_p.ru").alias("ru_score"),
    )
    return p


def normalized(df):
    return profiled(df).withColumn("norm", T.normalize_words(F.col("text"), F.col("primary_lang")))


def _flagged(spark, folder):
    return normalized(messages(spark, folder)).withColumn("obfuscated", F.lower("text").rlike(OBFUSCATED))


@query("normalize_words", "SELECT conv_id, turn, norm, obfuscated FROM q_obfuscated")
def normalize_words(spark, folder):
    return _flagged(spark, folder).select("conv_id", "turn", "norm", "obfuscated")


@query(
    "obfuscation_rate",
    """SELECT conv_id, direction, count(*) AS n, count(*) FILTER (WHERE obfuscated) AS n_obfuscated,
  round(count(*) FILTER (WHERE obfuscated) / count(*), 6) AS rate FROM q_obfuscated GROUP BY conv_id, direction""",
)
def obfuscation_rate(spark, folder):
    return (
        _flagged(spark, folder)
        .groupBy("conv_id", "direction")
        .agg(F.count("*").alias("n"), F.count_if("obfuscated").alias("n_obfuscated"))
        .withColumn("rate", F.round(F.col("n_obfuscated") / F.col("n"), 6))
    )


@query(
    "normalize_continuous",
    f"""SELECT sha256(solid) AS solid_key, length(solid) AS solid_len, count(*) AS n, count(DISTINCT text) AS spellings
FROM (SELECT text, {O.norm_continuous('text')} AS solid FROM q_messages) GROUP BY solid""",
)
def normalize_continuous(spark, folder):
    x = messages(spark, folder).select("text", T.normalize_continuous(F.col("text")).alias("solid"))
    # Distinct spellings first, so a text repeated very often shrinks before the group is formed.
    once = x.groupBy("solid", "text").agg(F.count("*").alias("n"))
    return (
        once.groupBy("solid")
        .agg(F.sum("n").alias("n"), F.count("*").alias("spellings"))
        .select(F.sha2("solid", 256).alias("solid_key"), F.length("solid").cast("bigint").alias("solid_len"), "n", "spellings")
    )


@query(
    "canonical_fold",
    f"""SELECT f AS fold_key, count(*) AS n_items, count(DISTINCT real_value) AS spellings, min(real_value) AS example
FROM (SELECT real_value, {O.fold('real_value')} AS f FROM q_watchlist) GROUP BY f""",
)
def canonical_fold(spark, folder):
    return (
        watchlist(spark, folder)
        .withColumn("fold_key", T.canonical_fold(F.col("real_value")))
        .groupBy("fold_key")
        .agg(
            F.count("*").alias("n_items"),
            F.countDistinct("real_value").alias("spellings"),
            F.min("real_value").alias("example"),
        )
    )


_TR = f"""
SELECT item_id, 'latin_y' AS variant, {O.to_latin('real_value', 'y')} AS name_key FROM q_watchlist
UNION ALL SELECT item_id, 'latin_i', {O.to_latin('real_value', 'i')} FROM q_watchlist
UNION ALL SELECT item_id, 'cyrillic', {O.to_cyrillic('real_value')} FROM q_watchlist"""


@query("transliterate", _TR)
def transliterate(spark, folder):
    w = watchlist(spark, folder)
    y, i = T.cyrillic_to_latin(F.col("real_value"))
    forms = F.array(
        F.struct(F.lit("latin_y").alias("variant"), y.alias("name_key")),
        F.struct(F.lit("latin_i").alias("variant"), i.alias("name_key")),
        F.struct(F.lit("cyrillic").alias("variant"), T.latin_to_cyrillic(F.col("real_value")).alias("name_key")),
    )
    return w.select("item_id", F.explode(forms).alias("f")).select("item_id", "f.*")


@query(
    "language_profile",
    "SELECT conv_id, turn, primary_lang, languages, is_mixed, confidence, script, uk_score, en_score, ru_score FROM q_lang",
)
def language_profile(spark, folder):
    return profiled(messages(spark, folder)).select(
        "conv_id", "turn", "primary_lang", "languages", "is_mixed", "confidence", "script", "uk_score", "en_score", "ru_score"
    )


@query(
    "language_mix_report",
    """SELECT coalesce(primary_lang, '*') AS primary_lang, coalesce(script, '*') AS script, is_mixed, count(*) AS n,
  round(avg(confidence), 6) AS mean_confidence, round(count(*) / (SELECT count(*) FROM q_lang), 6) AS share
FROM q_lang GROUP BY ROLLUP (primary_lang, script, is_mixed)""",
)
def language_mix_report(spark, folder):
    rows = (
        profiled(messages(spark, folder))
        .rollup("primary_lang", "script", "is_mixed")
        .agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.grouping_id().alias("g"))
    )
    total = rows.filter(F.col("g") == 7).select(F.col("n").alias("total"))
    # One row, hence safe to broadcast.
    return rows.crossJoin(F.broadcast(total)).select(
        F.coalesce("primary_lang", F.lit("*")).alias("primary_lang"),
        F.coalesce("script", F.lit("*")).alias("script"),
        "is_mixed",
        "n",
        F.round("c", 6).alias("mean_confidence"),
        F.round(F.col("n") / F.col("total"), 6).alias("share"),
    )


cte(
    "q_urls",
    f"""SELECT conv_id, turn, direction, url, {O.host('url')} AS host, contains(lower(text), url) OR contains(lower(text), url[9:]) AS plain
FROM (SELECT *, unnest({O.urls('text')}) AS url FROM q_messages)""",
)


def message_urls(df):
    """One row per URL found in a message; plain tells whether it was written without masking."""
    low = F.lower("text")
    return (
        df.withColumn("url", F.explode(T.extract_urls(F.col("text"))))
        .withColumn("host", T.host_of(F.col("url")))
        .withColumn("plain", low.contains(F.col("url")) | low.contains(F.expr("substring(url, 9)")))
        .select("conv_id", "turn", "direction", "url", "host", "plain")
    )


@query("extract_urls", "SELECT * FROM q_urls")
def extract_urls(spark, folder):
    return message_urls(messages(spark, folder))


@query(
    "url_domain_report",
    """SELECT host, direction, count(*) AS n_urls, count(DISTINCT conv_id) AS n_conversations,
  count(*) FILTER (WHERE NOT plain) AS n_masked FROM q_urls GROUP BY host, direction""",
)
def url_domain_report(spark, folder):
    per_conv = (
        message_urls(messages(spark, folder))
        .groupBy("host", "direction", "conv_id")
        .agg(F.count("*").alias("n"), F.count_if(~F.col("plain")).alias("m"))
    )
    return per_conv.groupBy("host", "direction").agg(
        F.sum("n").alias("n_urls"), F.count("*").alias("n_conversations"), F.sum("m").alias("n_masked")
    )
