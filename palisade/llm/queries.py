"""Registered queries of the training-data operators: key -> job(spark, folder), and DuckDB check queries where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from palisade.llm.decontaminate import contaminated
from palisade.llm.html_text import html_texts
from palisade.llm.mixing import BUDGET_PERCENT, DOMAIN_WEIGHTS, EPOCHS, LANGUAGE_WEIGHTS, SEED, mix
from palisade.llm.ngram_join import jaccard_components
from palisade.llm.nn_descent import nearest_neighbours
from palisade.llm.pii import pii_report
from palisade.llm.quality import quality_model
from palisade.llm.quality import score_documents as score_quality
from palisade.llm.spelling import spelling_variants
from palisade.llm.suffix_dedup import remove_repeats
from palisade.llm.toxicity import held_out, score_documents, toxicity_model
from palisade.llm.turn_repair import repair_damaged
from palisade.llm.url_filter import CONFIDENCE, RULES, SUPPORT, judge_urls
from palisade.llm.warc import archive_round_trip
from palisade.sources.tables import table

JOBS: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(job: Callable) -> Callable:
        JOBS[key] = job
        if sql is not None:
            CHECKS[key] = sql
        return job

    return register


@query("op1_ngram_jaccard_join")
def op1(spark, folder):
    return jaccard_components(table(spark, folder, "documents"))


@query("op2_html_extraction")
def op2(spark, folder):
    return html_texts(table(spark, folder, "pages"))


MIX_SQL = f"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS leaf, coalesce(CAST(doc_id AS VARCHAR), '') AS id, md5(text) AS h,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens, regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS number FROM documents),
d AS (SELECT *, CASE WHEN number = '' THEN 'web' ELSE (['web', 'news', 'books'])[CAST(number AS BIGINT) % 3 + 1] END AS domain FROM t WHERE tokens > 0),
leaves AS (SELECT domain, language, leaf, CAST(sum(tokens) AS HUGEINT) AS tokens, CAST(sum(tokens) * {EPOCHS} AS HUGEINT) AS supply FROM d GROUP BY ALL),
top0 AS (SELECT domain, CAST(sum(supply) AS HUGEINT) AS supply, CAST(CASE domain {" ".join(f"WHEN '{k}' THEN {v}" for k, v in DOMAIN_WEIGHTS.items())} ELSE 1 END AS HUGEINT) AS weight,
  (SELECT CAST(least(sum(tokens) * {BUDGET_PERCENT} // 100, sum(tokens) * {EPOCHS}) AS HUGEINT) FROM leaves) AS given FROM leaves GROUP BY domain),
top1 AS (SELECT *, given - coalesce(sum(supply) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM top0 WINDOW o AS (ORDER BY CAST(supply AS DOUBLE) / CAST(weight AS DOUBLE), domain)),
top2 AS (SELECT *, max(CASE WHEN NOT supply * weights <= rest * weight THEN weights END) OVER () AS open FROM top1),
top3 AS (SELECT *, max(CASE WHEN weights = open THEN rest END) OVER () AS open_rest FROM top2),
domains AS (SELECT domain, greatest(CASE WHEN open IS NULL OR weights > open THEN supply ELSE least(supply, CAST(open_rest * weight AS HUGEINT) // CAST(open AS HUGEINT)) END, 0) AS given FROM top3),
mid0 AS (SELECT domain, language, CAST(sum(supply) AS HUGEINT) AS supply, CAST(CASE language {" ".join(f"WHEN '{k}' THEN {v}" for k, v in LANGUAGE_WEIGHTS.items())} ELSE 1 END AS HUGEINT) AS weight, any_value(given) AS given
  FROM leaves JOIN domains USING (domain) GROUP BY domain, language),
mid1 AS (SELECT *, given - coalesce(sum(supply) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM mid0 WINDOW o AS (PARTITION BY domain ORDER BY CAST(supply AS DOUBLE) / CAST(weight AS DOUBLE), language)),
mid2 AS (SELECT *, max(CASE WHEN NOT supply * weights <= rest * weight THEN weights END) OVER (PARTITION BY domain) AS open FROM mid1),
mid3 AS (SELECT *, max(CASE WHEN weights = open THEN rest END) OVER (PARTITION BY domain) AS open_rest FROM mid2),
languages AS (SELECT domain, language, greatest(CASE WHEN open IS NULL OR weights > open THEN supply ELSE least(supply, CAST(open_rest * weight AS HUGEINT) // CAST(open AS HUGEINT)) END, 0) AS given FROM mid3),
low0 AS (SELECT l.*, given, CAST(1 AS HUGEINT) AS weight FROM leaves l JOIN languages USING (domain, language)),
low1 AS (SELECT *, given - coalesce(sum(supply) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM low0 WINDOW o AS (PARTITION BY domain, language ORDER BY CAST(supply AS DOUBLE), leaf)),
low2 AS (SELECT *, max(CASE WHEN NOT supply * weights <= rest * weight THEN weights END) OVER (PARTITION BY domain, language) AS open FROM low1),
low3 AS (SELECT *, max(CASE WHEN weights = open THEN rest END) OVER (PARTITION BY domain, language) AS open_rest FROM low2),
budgets AS (SELECT domain, language, leaf, greatest(CASE WHEN open IS NULL OR weights > open THEN supply ELSE least(supply, CAST(open_rest * weight AS HUGEINT) // CAST(open AS HUGEINT)) END, 0) AS budget FROM low3),
dealt AS (SELECT d.*, epoch, md5(concat('{SEED}:', epoch, ':', id)) AS key FROM d, range({EPOCHS}) r(epoch)),
placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, language, leaf ORDER BY epoch, key, id, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM dealt)
SELECT doc_id, lang, source, CAST(epoch AS INTEGER) AS epoch, CAST(tokens AS BIGINT) AS tokens, domain AS mix_domain FROM placed JOIN budgets USING (domain, language, leaf) WHERE before < budget
"""


@query("op3_mixing_sources", MIX_SQL)
def op3(spark, folder):
    return mix(table(spark, folder, "documents")).select("doc_id", "lang", "source", "epoch", "tokens", "mix_domain")


@query("op4_nearest_neighbours")
def op4(spark, folder):
    return nearest_neighbours(table(spark, folder, "embeddings"))


@query("op5_benchmark_decontamination")
def op5(spark, folder):
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_pii")
def op6(spark, folder):
    return pii_report(table(spark, folder, "documents"))


@query("op7_suffix_array_dedup")
def op7(spark, folder):
    return remove_repeats(table(spark, folder, "documents"))


WARC_SQL = """
WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\\x00-\\x20\\x7F]', '%20', 'g') AS url, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d),
r AS (SELECT *, lower(CASE WHEN instr(url, '://') > 0 AND substr(url, instr(url, '://') + 3) <> '' THEN substr(url, instr(url, '://') + 3) ELSE url END) AS rest FROM p),
h AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS host FROM r),
c AS (SELECT *, regexp_extract(substr(rest, length(host) + 1), '^([^#]*)', 1) AS path, CASE WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE host END AS name FROM h),
i AS (SELECT *, array_to_string(list_reverse(string_split(name, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM c)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN keeper <> page_id THEN keeper END AS refers_to,
  url_key, captured, row_number() OVER (ORDER BY encode(url_key), captured, page_id) - 1 AS capture_no
FROM i LEFT JOIN k USING (d)
"""


@query("op8_warc_index", WARC_SQL)
def op8(spark, folder):
    return archive_round_trip(table(spark, folder, "pages"))


@query("op9_toxicity")
def op9(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = score_documents(docs, toxicity_model(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_sentences", "offending")


def _url_sql() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for h, p, _ in rules]
    rule = "CASE " + " ".join(f"{f} '{h}{p}'" for f, (h, p, _) in zip(fits, rules, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"{f} '{v}'" for f, (_, _, v) in zip(fits, rules, strict=True)) + " END"
    return f"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM r),
a AS (SELECT *, substr(rest, length(raw) + 1) AS after FROM h),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(after, '^([^?#]*)', 1) AS path, regexp_extract(after, '^[^?#]*\\?([^#]*)', 1) AS query FROM a),
l AS (SELECT *, string_split(host, '.') AS names, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p),
t AS (SELECT page_id, host, path, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(list_concat([
    'top=' || names[-1], 'domain=' || array_to_string(names[-2:], '.'), 'host=' || host, 'ext=' || coalesce(nullif(lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)), ''), '-'), 'first=' || coalesce(parts[1], '-'),
    'shape=' || CASE WHEN len(parts) = 0 THEN '-' ELSE array_to_string(list_transform(parts, lambda x: regexp_replace(regexp_replace(x, '[0-9]+', '9', 'g'), '[^0-9./]+', 'a', 'g')), '/') END],
    list_transform(names[:-2], lambda x: 'label=' || x), list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'key=' || regexp_extract(x, '^([^=]*)', 1))))) END AS tokens FROM l),
known AS (SELECT doc_id AS page_id, max(toxic = 1 OR quality = 0) AS blocked FROM labels WHERE doc_id IS NOT NULL AND (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY doc_id),
tx AS (SELECT row_number() OVER () AS n, tokens, blocked FROM t JOIN known USING (page_id) WHERE len(tokens) > 0),
m AS (SELECT ceil({SUPPORT} * count(*)) AS least FROM tx),
i AS (SELECT n, blocked, unnest(tokens) AS x FROM tx),
s AS (SELECT n, blocked, [x] AS tokens, x AS last FROM i UNION ALL SELECT s.n, s.blocked, list_append(s.tokens, i.x), i.x FROM s JOIN i ON i.n = s.n AND i.x > s.last),
f AS (SELECT tokens, count(*) AS seen, count(*) FILTER (blocked) AS hits FROM s GROUP BY tokens),
rules AS (SELECT tokens, seen, hits FROM f, m WHERE hits >= least AND hits >= {CONFIDENCE} * seen),
kept AS (SELECT * FROM rules w WHERE NOT EXISTS (SELECT 1 FROM rules q WHERE len(q.tokens) < len(w.tokens) AND list_has_all(w.tokens, q.tokens) AND w.hits * q.seen <= q.hits * w.seen)),
fired AS (SELECT t.tokens, min(array_to_string(kept.tokens, ' ')) AS mined FROM (SELECT DISTINCT tokens FROM t) t JOIN kept ON list_has_all(t.tokens, kept.tokens) GROUP BY t.tokens)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN mined IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, mined FROM t LEFT JOIN fired USING (tokens)
"""


@query("op10_url_filter", _url_sql())
def op10(spark, folder):
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), F.expr("toxic = 1 or quality = 0").alias("blocked"))
    return judge_urls(table(spark, folder, "pages"), labels)


@query("op11_spelling_variants")
def op11(spark, folder):
    return spelling_variants(table(spark, folder, "documents"))


@query("op12_conversation_repair")
def op12(spark, folder):
    return repair_damaged(table(spark, folder, "conversations"))


@query("op13_quality_classifier")
def op13(spark, folder):
    docs = table(spark, folder, "documents")
    scored = score_quality(docs, quality_model(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
