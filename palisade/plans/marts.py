"""Queries over evaluation marts, stitching, external verdicts and run logs."""

import uuid

from pyspark.sql import functions as F

from palisade.operators import corpus as C
from palisade.operators import marts as M
from palisade.operators import stitching as X
from palisade.oracle import scored as _o  # noqa: F401
from palisade.oracle.sql import cte, lit
from palisade.plans.registry import query
from palisade.plans.sessions import single_verdicts
from palisade.session import shared_folder
from palisade.sources import scored as S

_PRF = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


@query(
    "binary_metrics",
    f"""SELECT *, {_PRF} FROM (SELECT coalesce(corpus, 'combined') AS corpus,
  count(*) FILTER (WHERE assessment <> 'ambiguous' AND expected_detected AND actual_detected) AS tp,
  count(*) FILTER (WHERE assessment <> 'ambiguous' AND NOT expected_detected AND actual_detected) AS fp,
  count(*) FILTER (WHERE assessment <> 'ambiguous' AND expected_detected AND NOT actual_detected) AS fn,
  count(*) FILTER (WHERE assessment <> 'ambiguous' AND NOT expected_detected AND NOT actual_detected) AS tn,
  count(*) FILTER (WHERE assessment = 'ambiguous') AS ambiguous,
  count(*) FILTER (WHERE assessment = 'ambiguous' AND actual_detected) AS ambiguous_detected
FROM q_predictions GROUP BY GROUPING SETS ((corpus), ()))""",
)
def binary_metrics(spark, folder):
    return M.binary_metrics(S.predictions(spark, folder))


@query(
    "per_type_metrics",
    f"""WITH types AS (SELECT expected_type AS intent FROM q_predictions WHERE expected_type IS NOT NULL AND assessment <> 'ambiguous'
  UNION SELECT actual_type FROM q_predictions WHERE actual_type IS NOT NULL AND assessment <> 'ambiguous')
SELECT *, {_PRF} FROM (SELECT intent,
  count(*) FILTER (WHERE coalesce(expected_type = intent, FALSE) AND coalesce(actual_type = intent, FALSE)) AS tp,
  count(*) FILTER (WHERE NOT coalesce(expected_type = intent, FALSE) AND coalesce(actual_type = intent, FALSE)) AS fp,
  count(*) FILTER (WHERE coalesce(expected_type = intent, FALSE) AND NOT coalesce(actual_type = intent, FALSE)) AS fn
FROM q_predictions, types WHERE assessment <> 'ambiguous' GROUP BY intent)""",
)
def per_type_metrics(spark, folder):
    return M.per_type_metrics(S.predictions(spark, folder))


def _abstention(source: str, keys: str) -> str:
    on = " AND ".join(f"b.{k} IS NOT DISTINCT FROM m.{k}" for k in keys.split(", "))
    bk = ", ".join(f"b.{k}" for k in keys.split(", "))
    return f"""
SELECT {bk}, n, covered, exact, round(covered / n, 6) AS coverage, round(exact / n, 6) AS exact_rate,
  round(coalesce(caught / nullif(threats, 0), 0), 6) AS threat_recall, macro_f1 FROM (
  SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE decision <> 'ABSTAIN') AS covered, count(*) FILTER (WHERE decision = expected) AS exact,
    count(*) FILTER (WHERE expected <> 'SAFE') AS threats, count(*) FILTER (WHERE expected <> 'SAFE' AND decision NOT IN ('SAFE', 'ABSTAIN')) AS caught
  FROM {source} WHERE expected <> 'AMBIGUOUS' GROUP BY ALL) b
JOIN (SELECT {keys}, ((sum(f1) // count(*) + 500000) // 1000000) / 1000000 AS macro_f1 FROM (SELECT {keys}, label, CAST(2 * tp AS HUGEINT) * 1000000000000 // (2 * tp + fp + fn) AS f1 FROM (
  SELECT {keys}, label, count(*) FILTER (WHERE expected = label AND decision = label) AS tp, count(*) FILTER (WHERE expected <> label AND decision = label) AS fp,
    count(*) FILTER (WHERE expected = label AND decision <> label) AS fn
  FROM {source}, (SELECT DISTINCT unnest([expected, decision]) AS label FROM {source} WHERE expected <> 'AMBIGUOUS') WHERE expected <> 'AMBIGUOUS' AND label <> 'ABSTAIN' GROUP BY ALL)
  WHERE tp + fp + fn > 0) GROUP BY ALL) m ON {on}"""


@query("abstention_metrics", _abstention("q_runs", "variant"))
def abstention_metrics(spark, folder):
    return M.abstention_metrics(S.model_runs(spark, folder), ["variant"])


@query("compare_variants", _abstention("q_runs", "split, variant"))
def compare_variants(spark, folder):
    return M.compare_variants(S.model_runs(spark, folder))


_OK = """(expected_detected = actual_detected AND expected_type IS NOT DISTINCT FROM actual_type AND expected_action = actual_action
  AND (NOT actual_detected OR confidence BETWEEN min_confidence AND max_confidence))"""


@query(
    "exact_match",
    f"""SELECT corpus, count(*) AS n, count(*) FILTER (WHERE {_OK}) AS exact, count(*) FILTER (WHERE expected_action <> actual_action) AS wrong_action,
  count(*) FILTER (WHERE actual_action = 'LOCK_INPUT' AND expected_action <> 'LOCK_INPUT') AS false_lock
FROM q_predictions WHERE assessment <> 'ambiguous' GROUP BY corpus""",
)
def exact_match(spark, folder):
    return M.exact_match(S.predictions(spark, folder))


@query(
    "exact_match_mismatches",
    f"""SELECT id, corpus, expected_type, actual_type, expected_action, actual_action, confidence FROM q_predictions
WHERE assessment <> 'ambiguous' AND NOT {_OK}""",
)
def exact_match_mismatches(spark, folder):
    return M.mismatches(S.predictions(spark, folder))


@query(
    "reviewer_consensus",
    """SELECT case_id, CASE WHEN a THEN x1 ELSE 'disputed' END AS assessment, CASE WHEN t THEN x2 END AS intent_type, CASE WHEN c THEN x3 END AS action,
  a AS assessment_agreed, t AS intent_type_agreed, c AS action_agreed FROM (
  SELECT case_id, count(DISTINCT assessment) = 1 AS a, count(DISTINCT coalesce(intent_type, '-')) = 1 AS t, count(DISTINCT action) = 1 AS c,
    max(assessment) AS x1, max(intent_type) AS x2, max(action) AS x3 FROM q_votes GROUP BY case_id HAVING count(*) = 2)""",
)
def reviewer_consensus(spark, folder):
    return M.reviewer_consensus(S.votes(spark, folder))


@query(
    "validate_votes",
    """SELECT case_id, reviewer, 'threat_without_type' AS problem FROM q_votes WHERE assessment = 'threat' AND intent_type IS NULL
UNION ALL SELECT case_id, reviewer, 'safe_with_action' FROM q_votes WHERE assessment = 'safe' AND action <> 'ALLOW'
UNION ALL SELECT case_id, reviewer, 'threat_allowed' FROM q_votes WHERE assessment = 'threat' AND action = 'ALLOW'
UNION ALL SELECT case_id, reviewer, 'type_without_threat' FROM q_votes WHERE assessment <> 'threat' AND intent_type IS NOT NULL
UNION ALL SELECT case_id, reviewer, 'turn_out_of_range' FROM q_votes WHERE evidence_turn NOT BETWEEN 1 AND n_turns
UNION ALL SELECT case_id, reviewer, 'no_evidence' FROM q_votes WHERE assessment = 'threat' AND evidence_turn IS NULL""",
)
def validate_votes(spark, folder):
    return M.validate_votes(S.votes(spark, folder))


@query(
    "reviewer_agreement",
    """SELECT a.reviewer AS first, b.reviewer AS second, count(*) AS n, round(avg(CAST(a.assessment = b.assessment AS INT)), 6) AS assessment_rate,
  round(avg(CAST(a.intent_type IS NOT DISTINCT FROM b.intent_type AS INT)), 6) AS intent_type_rate, round(avg(CAST(a.action = b.action AS INT)), 6) AS action_rate,
  round(avg(CAST(a.assessment = b.assessment AND a.intent_type IS NOT DISTINCT FROM b.intent_type AND a.action = b.action AS INT)), 6) AS all_rate
FROM q_votes a JOIN q_votes b ON a.case_id = b.case_id AND a.reviewer < b.reviewer GROUP BY ALL""",
)
def reviewer_agreement(spark, folder):
    return M.reviewer_agreement(S.votes(spark, folder))


PAIRS = """SELECT id, id - 1 AS source_id, CASE id % 4 WHEN 0 THEN 'typos' WHEN 1 THEN 'unicode' WHEN 2 THEN 'mixed' ELSE 'split' END AS transform
FROM {preds} WHERE id % 2 = 1"""
cte("q_pairs", PAIRS.format(preds="q_predictions").replace("id % 4", "(id // 2) % 4"))


@query(
    "paired_robustness",
    """SELECT transform, count(*) AS pairs, count(*) FILTER (WHERE n.actual_detected <> o.actual_detected) AS changed,
  count(*) FILTER (WHERE o.expected_detected AND o.actual_detected AND NOT n.actual_detected) AS threats_lost,
  count(*) FILTER (WHERE o.expected_detected AND NOT o.actual_detected AND n.actual_detected) AS threats_gained,
  count(*) FILTER (WHERE NOT o.expected_detected AND NOT o.actual_detected AND n.actual_detected) AS alarms_added,
  count(*) FILTER (WHERE NOT o.expected_detected AND o.actual_detected AND NOT n.actual_detected) AS alarms_removed
FROM q_pairs p JOIN q_predictions n ON n.id = p.id JOIN q_predictions o ON o.id = p.source_id GROUP BY transform""",
)
def paired_robustness(spark, folder):
    p = S.predictions(spark, folder)
    return M.paired_robustness(p, spark.sql(PAIRS.replace("id % 4", "(id div 2) % 4").format(preds="{p}"), p=p))


def _pct(source: str, key: str) -> str:
    return f"""SELECT {key}, count(*) AS n, list_sort(list(latency_ms))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS median,
  list_sort(list(latency_ms))[CAST(floor(count(*) * 0.95) AS INT) + 1] AS p95_element,
  list_sort(list(latency_ms))[CAST(ceil(count(*) * 0.95) AS INT)] AS p95_nearest FROM {source} GROUP BY {key}"""


@query("latency_percentiles", _pct("q_runs", "variant"))
def latency_percentiles(spark, folder):
    return M.latency_percentiles(S.model_runs(spark, folder), "variant", "latency_ms")


@query(
    "paired_variant_summary",
    f"""SELECT variant, completed, unflagged, unflagged_exact, exact, p95_nearest AS p95_ms FROM (
  SELECT variant, count(*) AS completed, count(*) FILTER (WHERE NOT flagged) AS unflagged, count(*) FILTER (WHERE NOT flagged AND decision = expected) AS unflagged_exact,
    count(*) FILTER (WHERE decision = expected) AS exact FROM q_runs WHERE status = 'completed' GROUP BY variant)
JOIN ({_pct("(SELECT * FROM q_runs WHERE status = 'completed')", "variant")}) USING (variant)""",
)
def paired_variant_summary(spark, folder):
    return M.variant_summary(S.model_runs(spark, folder))


@query(
    "variant_run_summary",
    f"""SELECT b.*, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, p95_nearest AS p95_ms FROM (SELECT variant, count(*) AS requests,
  count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status <> 'completed') AS errors,
  count(*) FILTER (WHERE status = 'completed' AND decision <> 'ABSTAIN') AS covered,
  count(*) FILTER (WHERE status = 'completed' AND expected NOT IN ('SAFE', 'AMBIGUOUS') AND decision NOT IN ('SAFE', 'ABSTAIN')) AS tp,
  count(*) FILTER (WHERE status = 'completed' AND expected = 'SAFE' AND decision NOT IN ('SAFE', 'ABSTAIN')) AS fp,
  count(*) FILTER (WHERE status = 'completed' AND expected NOT IN ('SAFE', 'AMBIGUOUS') AND decision IN ('SAFE', 'ABSTAIN')) AS fn,
  round(avg(tokens) FILTER (WHERE status = 'completed'), 6) AS mean_tokens,
  count(*) FILTER (WHERE status = 'completed' AND decision = 'CRYPTO_WALLET_COMPROMISE' AND expected <> decision) AS excess_locks
FROM q_runs GROUP BY variant) b JOIN ({_pct("(SELECT * FROM q_runs WHERE status = 'completed')", "variant")}) p USING (variant)""",
)
def variant_run_summary(spark, folder):
    return M.run_summary(S.model_runs(spark, folder))


@query(
    "ambiguity_report",
    """SELECT variant, count(*) FILTER (WHERE expected = 'AMBIGUOUS') AS ambiguous,
  count(*) FILTER (WHERE expected = 'AMBIGUOUS' AND decision = 'ABSTAIN') AS abstained, count(*) FILTER (WHERE expected = 'AMBIGUOUS' AND decision = 'SAFE') AS confident_safe,
  count(*) FILTER (WHERE expected = 'AMBIGUOUS' AND decision NOT IN ('ABSTAIN', 'SAFE')) AS confident_threat,
  count(*) FILTER (WHERE expected NOT IN ('SAFE', 'AMBIGUOUS') AND decision = 'SAFE') AS false_safe,
  count(*) FILTER (WHERE decision = 'CRYPTO_WALLET_COMPROMISE' AND expected <> decision) AS excess_locks,
  count(*) FILTER (WHERE reason = 'incomplete_request') AS incomplete_request, count(*) FILTER (WHERE reason = 'unsupported_context') AS unsupported_context
FROM q_runs GROUP BY variant""",
)
def ambiguity_report(spark, folder):
    return M.ambiguity_report(S.model_runs(spark, folder))


@query(
    "fixes_and_regressions",
    """SELECT a.id, CASE WHEN b.decision = b.expected THEN 'fixed' ELSE 'regressed' END AS change FROM q_runs a JOIN q_runs b USING (id)
WHERE a.variant = 'baseline' AND b.variant = 'guarded' AND (a.decision = a.expected) <> (b.decision = b.expected)""",
)
def fixes_and_regressions(spark, folder):
    return M.fixes_and_regressions(S.model_runs(spark, folder), "baseline", "guarded")


@query(
    "prefix_metrics",
    _abstention("q_prefix", "split, terminal"),
)
def prefix_metrics(spark, folder):
    return M.abstention_metrics(prefix_rows(S.model_runs(spark, folder)), ["split", "terminal"])


cte(
    "q_prefix",
    """SELECT * FROM (SELECT *, id % 10 = 9 AS terminal, row_number() OVER (PARTITION BY variant, split, id // 10, id % 10 = 9 ORDER BY id) AS rn
FROM q_runs) WHERE rn = 1""",
)


def prefix_rows(runs):
    """One non-terminal and one terminal turn per family (a family is ten neighbouring ids)."""
    from pyspark.sql import Window as W

    fam = runs.withColumn("terminal", F.col("id") % 10 == 9).withColumn("family", F.floor(F.col("id") / 10))
    w = W.partitionBy("variant", "split", "family", "terminal").orderBy("id")
    return fam.withColumn("rn", F.row_number().over(w)).filter("rn = 1")


HISTORY = """SELECT corpus AS series, id // 40 AS run_ms, CASE WHEN id // 40 % 6 < 4 THEN 'a' ELSE 'b' END AS corpus_hash,
  CASE WHEN id // 40 % 7 = 3 THEN NULL ELSE round(avg(CASE WHEN expected_detected = actual_detected THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) END AS metric
FROM {preds} GROUP BY corpus, id // 40"""
cte("q_history", HISTORY.format(preds="q_predictions"))


def history(spark, folder):
    return spark.sql(HISTORY.replace("//", "div").format(preds="{p}"), p=S.predictions(spark, folder))


@query(
    "history_segments",
    """SELECT series, segment, count(*) AS points, min(run_ms) AS from_ms, max(run_ms) AS to_ms, round(max(metric), 6) AS best FROM (
  SELECT *, sum(b) OVER (PARTITION BY series ORDER BY run_ms) AS segment FROM (SELECT *, CASE WHEN lag(corpus_hash) OVER w IS NULL
    OR lag(corpus_hash) OVER w <> corpus_hash OR lag(metric) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM q_history WINDOW w AS (PARTITION BY series ORDER BY run_ms)))
WHERE metric IS NOT NULL GROUP BY ALL""",
)
def history_segments(spark, folder):
    return M.history_segments(history(spark, folder))


@query(
    "append_run_history",
    """SELECT commit_id, run_ms, metric FROM (
  SELECT series || '-' || run_ms AS commit_id, run_ms, metric FROM q_history WHERE NOT (series = 'holdout' AND run_ms % 2 = 0)
  UNION ALL SELECT series || '-' || run_ms, run_ms + 1000, metric FROM q_history WHERE series = 'holdout' AND run_ms % 2 = 0)""",
)
def append_run_history(spark, folder):
    h = history(spark, folder).select(F.concat_ws("-", "series", F.col("run_ms").cast("string")).alias("commit_id"), "run_ms", "metric", "series")
    new = h.filter("series = 'holdout' AND run_ms % 2 = 0").withColumn("run_ms", F.col("run_ms") + 1000)
    kept = f"{shared_folder(spark)}/run-history-{uuid.uuid4().hex}"
    C.upsert_runs(h, kept)
    C.upsert_runs(new, kept)
    C.upsert_runs(new, kept)  # the same run once more changes nothing
    return spark.read.parquet(kept).select("commit_id", "run_ms", "metric")


# ---- stitching ----------------------------------------------------------------------------------------------------


cte(
    "q_tainted",
    """SELECT f.user_id, f.event_id, f.ts_ms, f.what, arg_max(l.event_id, (l.ts_ms, l.event_id)) AS lure_id, arg_max(l.host, (l.ts_ms, l.event_id)) AS lure_host,
  arg_max(l.scenario, (l.ts_ms, l.event_id)) AS scenario, f.ts_ms - max(l.ts_ms) AS age_ms
FROM q_lures f JOIN q_lures l ON l.user_id = f.user_id AND l.what = 'lure' AND l.ts_ms - 60000 <= f.ts_ms
WHERE f.what <> 'lure' GROUP BY f.user_id, f.event_id, f.ts_ms, f.what HAVING f.ts_ms - max(l.ts_ms) <= 900000""",
)


@query("tainted_context", "SELECT * FROM q_tainted")
def tainted_context(spark, folder):
    return X.tainted_context(S.lures(spark, folder))


EDGES = """SELECT user_id AS parent, CASE WHEN event_id % 10 = 0 THEN user_id ELSE (user_id + event_id % 7) % 150 END AS child, ts_ms FROM {lures} WHERE what <> 'lure'"""
ROOTS = """SELECT user_id AS subject, ts_ms, event_id AS session_id, scenario FROM {lures} WHERE what = 'lure'"""


# Planted: every fourth session is cleared some minutes after its lure, some of them twice, some also before it.
CLEARS = """SELECT event_id AS session_id, ts_ms + (event_id % 7 - 1) * 120000 + again * 200000 AS ts_ms FROM {lures} CROSS JOIN (SELECT * FROM (VALUES (0), (1)) AS t(again))
WHERE what = 'lure' AND event_id % 4 = 1 AND again <= event_id % 3"""


@query(
    "context_lineage",
    f"""WITH RECURSIVE edges AS MATERIALIZED ({EDGES.format(lures='q_lures')}), clears AS MATERIALIZED ({CLEARS.format(lures='q_lures')}), walk AS (
  SELECT subject, ts_ms, session_id, scenario, (SELECT min(c.ts_ms) FROM clears c WHERE c.session_id = r.session_id AND c.ts_ms >= r.ts_ms) AS cleared_ms FROM ({ROOTS.format(lures='q_lures')}) r
  UNION SELECT e.child, e.ts_ms, w.session_id, w.scenario, w.cleared_ms FROM walk w JOIN edges e ON e.parent = w.subject
  WHERE w.scenario <> 'SABOTAGE' AND e.parent <> e.child AND e.ts_ms >= w.ts_ms AND e.ts_ms - w.ts_ms <= 900000 AND (w.cleared_ms IS NULL OR e.ts_ms < w.cleared_ms))
SELECT subject, ts_ms, session_id, scenario, least(ts_ms + 900000, coalesce(cleared_ms, ts_ms + 900000)) AS until_ms, coalesce(cleared_ms <= ts_ms + 900000, FALSE) AS withdrawn FROM walk""",
)
def context_lineage(spark, folder):
    l = S.lures(spark, folder)
    part = lambda sql: spark.sql(sql.format(lures="{l}"), l=l)
    return X.context_lineage(part(ROOTS), part(EDGES), part(CLEARS))


_PROBLEM = f"""CASE WHEN is_scam IS NULL THEN 'flag_missing' WHEN confidence IS NULL THEN 'confidence_missing'
  WHEN NOT confidence BETWEEN 0 AND 100 THEN 'confidence_out_of_range' WHEN is_scam AND scam_type IS NULL THEN 'type_missing'
  WHEN is_scam AND scam_type NOT IN ({', '.join(lit(t) for t in X.THREAT_TYPES)}) THEN 'type_not_allowed'
  WHEN trim(reasoning) = '' THEN 'reason_empty' END"""


@query("validate_external_verdicts", f"SELECT conv_id, turn, {_PROBLEM} AS problem FROM q_external")
def validate_external_verdicts(spark, folder):
    return S.external_verdicts(spark, folder).select("conv_id", "turn", X.verdict_problem().alias("problem"))


REUSE = """SELECT event_id AS check_id, {ms} AS ts_ms, concat(event_type, CAST(user_id % 3 AS {text})) AS evidence FROM {events}"""


@query(
    "verdict_reuse",
    f"""WITH RECURSIVE c AS MATERIALIZED (SELECT sha256(evidence) AS key, check_id, ts_ms FROM ({REUSE.format(ms="(epoch_us(ts) // 1000)", text="VARCHAR", events="events")})),
d AS MATERIALIZED (SELECT key, ts_ms, min(check_id) AS first_id FROM c GROUP BY ALL),
n AS MATERIALIZED (SELECT x.key, x.ts_ms, y.ts_ms AS next_ms FROM d x ASOF JOIN d y ON x.key = y.key AND x.ts_ms + 300000 <= y.ts_ms),
a AS (SELECT key, min(ts_ms) AS ts_ms FROM d GROUP BY key UNION ALL SELECT n.key, n.next_ms FROM a JOIN n ON n.key = a.key AND n.ts_ms = a.ts_ms)
SELECT c.key, c.check_id, c.ts_ms, m.anchor_ms, NOT (c.ts_ms = m.anchor_ms AND c.check_id = m.first_id) AS reused
FROM c JOIN (SELECT d.key, d.ts_ms, d.first_id, a.ts_ms AS anchor_ms FROM d ASOF JOIN a ON d.key = a.key AND d.ts_ms >= a.ts_ms) m ON m.key = c.key AND m.ts_ms = c.ts_ms""",
)
def verdict_reuse(spark, folder):
    from palisade.sources.tables import table

    e = table(spark, folder, "events")
    return X.verdict_reuse(spark.sql(REUSE.format(ms="unix_millis(CAST(ts AS TIMESTAMP))", text="STRING", events="{e}"), e=e))


@query(
    "session_quarantine",
    """SELECT conv_id, turn, q AS quarantined, q OR coalesce(is_scam, FALSE) AS is_scam, CASE WHEN q THEN 99 ELSE confidence END AS confidence FROM (
  SELECT *, coalesce(max(CAST(is_scam AND confidence >= 75 AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS q
  FROM q_external)""",
)
def session_quarantine(spark, folder):
    return X.session_quarantine(S.external_verdicts(spark, folder))


@query(
    "reconcile_verdicts",
    f"""SELECT conv_id, turn, source, CASE source WHEN 'local' THEN intent WHEN 'external' THEN CASE WHEN regexp_matches(lower(concat_ws(' ', reasoning, text)), {lit(X.SABOTAGE_WORDS)})
    THEN 'MILITARY_SABOTAGE_RECRUITMENT' ELSE coalesce(scam_type, intent, 'UNKNOWN') END END AS intent,
  CASE source WHEN 'local' THEN local_confidence WHEN 'external' THEN coalesce(confidence, 75) ELSE 0 END AS confidence FROM (
  SELECT s.conv_id, s.turn, s.text, s.intent, s.confidence AS local_confidence, e.is_scam, e.confidence, e.scam_type, e.reasoning,
    CASE WHEN e.is_scam IS NULL OR (NOT e.is_scam AND e.confidence < 50) THEN 'local' WHEN NOT e.is_scam THEN 'clear' ELSE 'external' END AS source
  FROM q_single s LEFT JOIN q_external e USING (conv_id, turn))""",
)
def reconcile_verdicts(spark, folder):
    local = single_verdicts(spark, folder).select(
        "conv_id", "turn", "text", F.col("intent").alias("local_intent"), F.col("confidence").alias("local_confidence")
    )
    ext = S.external_verdicts(spark, folder).select(
        "conv_id", "turn", "is_scam", F.col("confidence").alias("ext_confidence"), "scam_type", "reasoning",
    )
    joined = local.join(ext, ["conv_id", "turn"], "left").withColumn("answered", F.col("is_scam").isNotNull())
    return X.reconcile(joined)


@query(
    "check_lifecycle",
    """SELECT check_id, coalesce(status, 'pending') AS status, started_ms, finished_ms, finished_ms - started_ms AS duration_ms FROM (
  SELECT check_id, min(ts_ms) FILTER (WHERE status = 'pending') AS started_ms,
    arg_min(status, (ts_ms, event_id)) FILTER (WHERE status <> 'pending') AS status, min(ts_ms) FILTER (WHERE status <> 'pending') AS finished_ms
  FROM q_checks GROUP BY check_id) WHERE started_ms IS NOT NULL ORDER BY started_ms DESC, check_id DESC LIMIT 150""",
)
def check_lifecycle(spark, folder):
    return X.check_lifecycle(S.check_events(spark, folder))


RISK = """SELECT user_id, event_id, ts_ms, CAST((event_id * 37) % 101 AS DOUBLE) AS score, CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS reset FROM {lures}"""


@query(
    "session_peak_risk",
    f"""SELECT user_id, event_id, segment, score, peak, CASE WHEN peak >= 76 THEN 'CRITICAL' WHEN peak >= 51 THEN 'HIGH' WHEN peak >= 21 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  peak >= 35 AND score < peak AS mitigated FROM (SELECT *, max(score) OVER (PARTITION BY user_id, segment ORDER BY ts_ms, event_id) AS peak FROM (
  SELECT *, sum(reset) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS segment FROM ({RISK.format(lures='q_lures')})))""",
)
def session_peak_risk(spark, folder):
    return X.session_peak_risk(spark.sql(RISK.format(lures="{l}"), l=S.lures(spark, folder)))


@query(
    "rolling_usage_audit",
    """SELECT event_id AS request_id, ts_ms, tokens, sum(tokens) OVER (ORDER BY ts_ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS minute_tokens,
  ts_ms - lag(ts_ms) OVER (ORDER BY ts_ms, event_id) AS gap_ms,
  sum(tokens) OVER (ORDER BY ts_ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) > 1500 AS over_ceiling
FROM (SELECT event_id, ts_ms, 500 + event_id % 400 AS tokens FROM q_lures)""",
)
def rolling_usage_audit(spark, folder):
    log = S.lures(spark, folder).select(F.col("event_id").alias("request_id"), "ts_ms", (500 + F.col("event_id") % 400).alias("tokens"))
    return X.rolling_usage(log, 1500)


REPLIES = """SELECT concat(conv_id, '-', turn) AS reply_id, CASE (conv_id + turn) % 11
  WHEN 0 THEN concat('{{"isScam": ', CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END, ', "confidence": ', CAST((conv_id * 7) % 100 AS {text}), ', "reasoning": "asks for a card"}}')
  WHEN 1 THEN '{{"fraud": "yes", "score": "high", "why": "moves to telegram"}}'
  WHEN 2 THEN 'I think this is a scam: it wants the seed phrase'
  WHEN 3 THEN '{{"is_scam": false, "confidence": "low"}}'
  WHEN 4 THEN 'hello' WHEN 5 THEN 'fine, "confidence": 30%'
  WHEN 6 THEN concat('{{"id": "x', chr(92), '"isScam', chr(92), '": false", "result": {{"isScam": "Yes", "confidence": ', CAST(conv_id % 40 AS {text}), '.5, "scamType": "identity_probing"}}}}')
  WHEN 7 THEN '[{{"scam": true, "probability": "120%", "scam_type": "Something", "reasoning": "card"}}, {{"scam": false}}]'
  WHEN 8 THEN replace(concat('"{{~is_scam~: ', CASE WHEN turn % 2 = 0 THEN '1' ELSE '0' END, ', ~score~: ~medium~}}"'), '~', concat(chr(92), '"'))
  WHEN 9 THEN concat('Here it is: ', chr(10), '{{"verdict": {{"fraud": "no", "confidence": 12}}, "note": "fraud?"}}', chr(10), 'Bye')
  ELSE '{{"isScam": true, "confidence": 55, ' END AS body FROM {conversations}"""



def _field(name: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(j, '{place}.{key}')" for place in X.REPLY_PLACES for key in X.REPLY_KEYS[name]) + ")"


def _picked(name: str) -> str:
    return rf"""nullif(regexp_extract(b, '"(?:{"|".join(X.REPLY_KEYS[name]).lower()})"\s*:\s*"?([a-z0-9_.%]+)', 1), '')"""


_JSON = "CASE WHEN json_valid({x}) AND json_type({x}) IN ('OBJECT', 'ARRAY') THEN {x} END"


@query(
    "repair_external_verdicts",
    rf"""WITH r0 AS (SELECT reply_id, body, lower(body) AS b, CASE WHEN json_valid(body) AND json_type(body) = 'VARCHAR' THEN json_extract_string(body, '$') END AS held,
  nullif(regexp_extract(body, '(?s)([\[{{].*[\]}}])', 1), '') AS cut FROM ({REPLIES.format(text='VARCHAR', conversations='conversations')})),
r AS (SELECT reply_id, b, coalesce({_JSON.format(x='body')}, {_JSON.format(x='held')}, {_JSON.format(x='cut')}) AS j FROM r0),
p AS (SELECT reply_id, b, j IS NOT NULL AS is_json, upper({_field('kind')}) AS kind, lower(trim(coalesce({_field('flag')}, {_picked('flag')}))) AS f, lower(trim(coalesce({_field('conf')}, {_picked('conf')}))) AS c FROM r),
s AS (SELECT *, CASE WHEN f IN ('true', 'yes', '1') THEN TRUE WHEN f IN ('false', 'no', '0') THEN FALSE END AS flag,
  regexp_matches(b, {lit(X.SCAM_WORDS)}) AS words, TRY_CAST(replace(c, '%', '') AS DOUBLE) AS num FROM p)
SELECT reply_id, coalesce(flag, words) AS is_scam,
  least(greatest(coalesce(num, CASE c WHEN 'high' THEN 95 WHEN 'medium' THEN 70 WHEN 'low' THEN 25 END, CASE WHEN coalesce(flag, words) THEN 90 ELSE 15 END), 0), 100) AS confidence,
  CASE WHEN coalesce(flag, words) THEN CASE WHEN kind IN ({', '.join(lit(t) for t in X.THREAT_TYPES)}) THEN kind {' '.join(f"WHEN regexp_matches(b, {lit(p)}) THEN '{n}'" for n, p in X.TYPE_WORDS)} ELSE 'UNKNOWN' END END AS scam_type,
  is_json, flag IS NULL AND NOT words AND num IS NULL AS rejected FROM s""",
)
def repair_external_verdicts(spark, folder):
    from palisade.sources.tables import table

    sql = REPLIES.replace("{conversations}", "<c>").format(text="STRING").replace("<c>", "{c}")
    # The braces of the JSON text are literal here, so the table goes in as a view-free parameter by name.
    raw = table(spark, folder, "conversations")
    raw.createOrReplaceTempView("_palisade_conversations")
    return X.repair_replies(spark.sql(sql.replace("{c}", "_palisade_conversations")))
