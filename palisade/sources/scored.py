"""Fixture tables of predictions, votes, runs and events: SQL over the given tables that both engines read the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.sources.tables import table

TYPES = ["VERIFICATION_PHISHING", "OFF_PLATFORM_REDIRECT", "PAYMENT_CREDENTIAL_THEFT", "CRYPTO_WALLET_COMPROMISE", "IDENTITY_PROBING"]
_PICK = "CASE {x} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"

PREDICTIONS = f"""
SELECT id, corpus, family, split, assessment, expected_detected, expected_type, expected_action, actual_detected,
  CASE WHEN actual_detected THEN actual_raw END AS actual_type,
  CASE WHEN NOT actual_detected THEN 'ALLOW' WHEN actual_raw = 'CRYPTO_WALLET_COMPROMISE' THEN 'LOCK_INPUT' ELSE 'WARN' END AS actual_action,
  confidence, 40.0 AS min_confidence, 95.0 AS max_confidence
FROM (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'development' WHEN 1 THEN 'regressions' ELSE 'holdout' END AS corpus,
    concat('f', CAST(doc_id % 20 AS {{text}})) AS family, CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split,
    CASE WHEN doc_id % 7 = 3 THEN 'ambiguous' WHEN toxic = 1 OR doc_id % 3 = 1 THEN 'threat' ELSE 'safe' END AS assessment,
    doc_id % 7 <> 3 AND (toxic = 1 OR doc_id % 3 = 1) AS expected_detected,
    CASE WHEN doc_id % 7 <> 3 AND (toxic = 1 OR doc_id % 3 = 1) THEN {_PICK.format(x='doc_id % 5')} END AS expected_type,
    CASE WHEN doc_id % 7 = 3 OR NOT (toxic = 1 OR doc_id % 3 = 1) THEN 'ALLOW' WHEN doc_id % 5 = 3 THEN 'LOCK_INPUT' ELSE 'WARN' END AS expected_action,
    CASE WHEN doc_id % 11 = 6 THEN NOT (toxic = 1 OR doc_id % 3 = 1) ELSE (toxic = 1 OR doc_id % 3 = 1) END AS actual_detected,
    {_PICK.format(x='(doc_id + CASE WHEN doc_id % 13 = 5 THEN 1 ELSE 0 END) % 5')} AS actual_raw,
    CAST((doc_id * 37) % 101 AS DOUBLE) AS confidence
  FROM {{labels}})"""

# Two or three variants of a learned model, each with a candidate, a score, a margin and an abstention reason.
MODEL_RUNS = f"""
SELECT variant, doc_id AS id, split, expected, candidate, latency_ms, tokens, score, margin, reason, flagged, status,
  CASE WHEN reason IS NULL AND score >= 0.6 AND margin >= 0.15 THEN candidate ELSE 'ABSTAIN' END AS decision
FROM (SELECT variant, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split,
    CASE WHEN doc_id % 7 = 3 THEN 'AMBIGUOUS' WHEN doc_id % 3 = 0 THEN 'SAFE' ELSE {_PICK.format(x='doc_id % 5')} END AS expected,
    CASE WHEN (doc_id + v) % 9 = 4 THEN 'SAFE' WHEN doc_id % 3 = 0 THEN 'SAFE' ELSE {_PICK.format(x='doc_id % 5')} END AS candidate,
    CAST((doc_id * 7919 + v * 31) % 997 AS DOUBLE) / 100 AS latency_ms, 500 + (doc_id * 13 + v) % 400 AS tokens,
    CAST(40 + (doc_id * 17 + v * 5) % 60 AS DOUBLE) / 100 AS score, CAST((doc_id * 23 + v) % 60 AS DOUBLE) / 100 AS margin,
    CASE WHEN v = 2 AND doc_id % 8 = 1 THEN 'incomplete_request' WHEN v = 2 AND doc_id % 8 = 2 THEN 'unsupported_context' END AS reason,
    doc_id % 17 = 2 AS flagged, CASE WHEN (doc_id + v) % 29 = 0 THEN 'error' ELSE 'completed' END AS status
  FROM {{labels}} CROSS JOIN (SELECT * FROM (VALUES ('baseline', 0), ('pilot', 1), ('guarded', 2)) AS t(variant, v)))"""

VOTES = """
SELECT doc_id AS case_id, reviewer, assessment, CASE WHEN assessment = 'threat' AND NOT (doc_id % 19 = 4 AND r = 1) THEN
    CASE WHEN doc_id % 11 = 5 AND r = 1 THEN 'IDENTITY_PROBING' ELSE 'OFF_PLATFORM_REDIRECT' END END AS intent_type,
  CASE WHEN assessment = 'threat' THEN CASE WHEN doc_id % 13 = 2 AND r = 1 THEN 'LOCK_INPUT' ELSE 'WARN' END ELSE 'ALLOW' END AS action,
  CASE WHEN assessment = 'threat' THEN CASE WHEN doc_id % 23 = 6 THEN 12 ELSE 1 + doc_id % 4 END END AS evidence_turn, 9 AS n_turns,
  CAST(50 + doc_id % 50 AS DOUBLE) AS confidence
FROM (SELECT doc_id, r, reviewer, CASE WHEN (doc_id + CASE WHEN doc_id % 11 = 3 THEN r ELSE 0 END) % 3 = 0 THEN 'safe'
    WHEN doc_id % 7 = 3 THEN 'ambiguous' ELSE 'threat' END AS assessment
  FROM {labels} CROSS JOIN (SELECT * FROM (VALUES ('ann', 0), ('bob', 1)) AS t(reviewer, r)) WHERE NOT (doc_id % 31 = 9 AND r = 1))"""

CHECK_EVENTS = """
SELECT event_id // 4 AS check_id, {ms} AS ts_ms, event_id, CASE event_id % 4 WHEN 0 THEN 'pending'
  WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'completed' END WHEN 2 THEN 'cancelled' ELSE 'timeout' END AS status
FROM {events} WHERE event_id % 4 < 2 + event_id // 4 % 3"""

LURES = """SELECT user_id, event_id, {ms} AS ts_ms, CASE WHEN event_type = 'error' THEN 'lure' WHEN event_type = 'purchase' THEN 'submit' WHEN event_type = 'signup' THEN 'navigate' END AS what,
  concat('h', CAST(event_id % 9 AS {text}), '.example.com') AS host,
  CASE event_id % 3 WHEN 0 THEN 'CHAT' WHEN 1 THEN 'SABOTAGE' ELSE 'DELIVERY' END AS scenario, value
FROM {events} WHERE event_type IN ('error', 'purchase', 'signup')"""

EXTERNAL = """
SELECT conv_id, turn, {ts} AS ts_ms, CASE WHEN (conv_id + turn) % 13 = 4 THEN NULL ELSE (conv_id * 3 + turn) % 4 = 1 END AS is_scam,
  CASE WHEN (conv_id + turn) % 17 = 5 THEN 140.0 WHEN (conv_id + turn) % 10 = 7 THEN NULL ELSE CAST((conv_id * 31 + turn * 17) % 101 AS DOUBLE) END AS confidence,
  CASE WHEN (conv_id * 3 + turn) % 4 <> 1 THEN NULL WHEN turn % 5 = 4 THEN 'UNKNOWN' WHEN turn % 5 = 3 THEN 'SOMETHING' WHEN turn % 2 = 0 THEN 'OFF_PLATFORM_REDIRECT' ELSE 'IDENTITY_PROBING' END AS scam_type,
  CASE WHEN (conv_id + turn) % 19 = 6 THEN ' ' WHEN turn % 3 = 2 THEN 'asks for a sabotage at the military depot' ELSE 'asks for documents' END AS reasoning
FROM {conversations}"""


def _run(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    fill = {name: "{" + name + "}" for name in frames}
    return spark.sql(
        sql.format(text="STRING", ms="unix_millis(CAST(ts AS TIMESTAMP))", ts="1704067200000 + conv_id * 60000 + turn * 20000", **fill)
        .replace("//", "div"),
        **frames,
    )


def predictions(spark, folder):
    return _run(spark, PREDICTIONS, labels=table(spark, folder, "labels"))


def model_runs(spark, folder):
    return _run(spark, MODEL_RUNS, labels=table(spark, folder, "labels"))


def votes(spark, folder):
    return _run(spark, VOTES, labels=table(spark, folder, "labels"))


def check_events(spark, folder):
    return _run(spark, CHECK_EVENTS, events=table(spark, folder, "events"))


def lures(spark, folder):
    return _run(spark, LURES, events=table(spark, folder, "events"))


def external_verdicts(spark, folder):
    return _run(spark, EXTERNAL, conversations=table(spark, folder, "conversations"))
