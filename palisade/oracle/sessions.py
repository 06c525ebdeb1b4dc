from palisade.dims import intents as I
from palisade.oracle.sql import cte, lit, strlist, values

_req, _ev, _defs = [], [], []
for intent, min_score, min_clusters, required, evidence in I.INTENTS:
    _defs.append((intent, min_score, min_clusters))
    _ev += [(intent, c) for c in evidence]
    _req += [(intent, i, c) for i, s in enumerate(required) for c in s]
cte("q_intents", values(_defs, "intent, min_score, min_clusters"))
cte("q_intent_evidence", values(_ev, "intent, cluster"))
cte("q_intent_required", values(_req, "intent, set_id, cluster"))
cte("q_set_sizes", "SELECT intent, set_id, count(*) AS size FROM q_intent_required GROUP BY ALL")

cte(
    "q_seq",
    """SELECT *, sum(CAST(direction = 'inbound' AS INT)) OVER w AS in_seq, sum(CAST(direction = 'outbound' AS INT)) OVER w AS out_seq
FROM q_messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
)
# Inbound context of every message: last 30, younger than 15 minutes.
cte(
    "q_context",
    """SELECT m.conv_id, m.turn, m.ts_ms, m.direction, c.turn AS ctx_turn, c.ts_ms AS ctx_ms, c.text AS ctx_text,
  pow(2.0, -greatest(0, m.ts_ms - c.ts_ms - 60000) / 300000) AS r
FROM q_seq m JOIN q_seq c ON c.conv_id = m.conv_id AND c.direction = 'inbound' AND c.turn <= m.turn AND c.in_seq > m.in_seq - 30
  AND m.ts_ms - c.ts_ms BETWEEN 0 AND 899999""",
)
cte(
    "q_out_context",
    """SELECT m.conv_id, m.turn, c.turn AS ctx_turn FROM q_seq m JOIN q_seq c ON c.conv_id = m.conv_id AND c.direction = 'outbound'
  AND c.turn <= m.turn AND c.out_seq > m.out_seq - 30 AND m.ts_ms - c.ts_ms BETWEEN 0 AND 899999""",
)
cte(
    "q_decayed",
    """SELECT x.conv_id, x.turn, cluster, round(max(r * weight), 9) AS weight FROM q_context x
JOIN q_clusters e ON e.conv_id = x.conv_id AND e.turn = x.ctx_turn GROUP BY ALL""",
)
cte("q_latest", "SELECT conv_id, turn, max(ctx_turn) AS latest_turn FROM q_context GROUP BY ALL")


def candidates(weights: str, current: str) -> str:
    """Relational division: evidence sums per intent, then the first required set that is wholly matched.
    weights(conv_id, turn, cluster, weight); current(conv_id, turn, cluster) are the latest message's clusters."""
    return f"""
SELECT s.conv_id, s.turn, s.intent, round(s.score, 9) AS score, r.set_id, r.set_size, s.matched, round(round(s.score, 9) / min_score, 9) AS ratio
FROM (SELECT conv_id, turn, intent, sum(weight) AS score, count(*) AS matched FROM {weights} JOIN q_intent_evidence USING (cluster) GROUP BY ALL) s
JOIN q_intents d ON d.intent = s.intent AND s.matched >= d.min_clusters AND round(s.score, 9) >= d.min_score
JOIN (SELECT conv_id, turn, intent, min(set_id) AS set_id, arg_min(n, set_id) AS set_size FROM (
    SELECT w.conv_id, w.turn, q.intent, q.set_id, count(*) AS n FROM {weights} w JOIN q_intent_required q USING (cluster) GROUP BY ALL
    ) g JOIN q_set_sizes z USING (intent, set_id) WHERE g.n = z.size GROUP BY ALL) r
  ON r.conv_id = s.conv_id AND r.turn = s.turn AND r.intent = s.intent
WHERE s.intent <> 'OFF_PLATFORM_REDIRECT' OR (SELECT count(*) FROM {current} c WHERE c.conv_id = s.conv_id AND c.turn = s.turn
  AND c.cluster IN ('off_platform', 'off_platform_action')) = 2"""


def ranked(cands: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, set_size DESC, matched DESC, ratio DESC, intent) AS rk
FROM {cands}"""


def overridden(rank: str, current: str, raw: str) -> str:
    """raw(conv_id, turn, raw) is the text the rules look at."""
    has = lambda c: f"list_contains(cs, '{c}')"
    step = lambda cond, frm, to: f"CASE WHEN {cond} AND list_contains(all_intents, '{to}') THEN '{to}' ELSE {frm} END"
    first = step(
        f"top = 'ESCROW_DELIVERY_SCAM' AND {has('off_platform_action')} AND NOT {has('transaction_redirect')} AND NOT {has('payment_claim')} "
        f"AND NOT {has('payment_credential_request')} AND NOT regexp_matches(lower(raw), {lit(I.PAYOUT_WORDS)})", "top", "OFF_PLATFORM_REDIRECT")
    second = step(f"b1 = 'VERIFICATION_PHISHING' AND {has('identity_probing')} AND NOT {has('payment_credential_request')} AND NOT {has('password_theft')}",
                  "b1", "IDENTITY_PROBING")
    money = (f"list_contains({strlist(I.FINANCIAL)}, b2) AND ({has('payment_credential_request')} OR ({has('bank_login_request')} AND {has('action_link')}))")
    verifying = f"({has('verification_purpose')} AND NOT {has('payment_purpose')})"
    wanted = f"CASE WHEN {verifying} THEN 'VERIFICATION_PHISHING' ELSE 'PAYMENT_CREDENTIAL_THEFT' END"
    return f"""
SELECT o.conv_id, o.turn, o.top, o.best, least(k.score, 100) AS confidence FROM (
  SELECT *, CASE WHEN {money} AND list_contains(all_intents, {wanted}) THEN {wanted} ELSE b2 END AS best FROM (
    SELECT *, {second} AS b2 FROM (SELECT *, {first} AS b1 FROM (
      SELECT k.conv_id, k.turn, max(intent) FILTER (WHERE rk = 1) AS top, list(intent) AS all_intents,
        any_value(coalesce(c.cs, [])) AS cs, any_value(raw) AS raw
      FROM {rank} k LEFT JOIN (SELECT conv_id, turn, list(cluster) AS cs FROM {current} GROUP BY ALL) c USING (conv_id, turn)
      JOIN {raw} USING (conv_id, turn) GROUP BY k.conv_id, k.turn)))) o
JOIN {rank} k ON k.conv_id = o.conv_id AND k.turn = o.turn AND k.intent = o.best"""


# Stateless: a message is its own context.
cte("q_cand1", candidates("q_clusters", "q_clusters"))
cte("q_rank1", ranked("q_cand1"))
cte("q_raw1", "SELECT conv_id, turn, text AS raw FROM q_messages")
cte("q_best1", overridden("q_rank1", "q_clusters", "q_raw1"))
# Stateful: decayed weights, current clusters of the latest inbound message.
cte("q_current", "SELECT l.conv_id, l.turn, e.cluster FROM q_latest l JOIN q_clusters e ON e.conv_id = l.conv_id AND e.turn = l.latest_turn")
cte("q_cand", candidates("q_decayed", "q_current"))
cte("q_rank", ranked("q_cand"))
cte("q_raw", "SELECT l.conv_id, l.turn, m.text AS raw FROM q_latest l JOIN q_messages m ON m.conv_id = l.conv_id AND m.turn = l.latest_turn")
cte("q_best", overridden("q_rank", "q_current", "q_raw"))
cte(
    "q_single",
    """SELECT m.conv_id, m.turn, m.ts_ms, m.direction, m.text, b.best IS NOT NULL AS detected, b.best AS intent, b.confidence
FROM q_messages m LEFT JOIN q_best1 b USING (conv_id, turn)""",
)
POLICY = f"""CASE WHEN NOT detected OR intent IS NULL THEN 'ALLOW' WHEN intent IN ({', '.join(lit(i) for i in I.LOCKING)}) THEN 'LOCK_INPUT' ELSE 'WARN' END"""
FALLBACK = f"""CASE WHEN confidence IS NULL OR confidence <= 0 THEN 'ALLOW'
  WHEN intent IN ({', '.join(lit(i) for i in I.LOCKING)}) THEN CASE WHEN confidence >= 75 THEN 'LOCK_INPUT' ELSE 'ALLOW' END
  WHEN intent IN ({', '.join(lit(i) for i in I.ADVISORY)}) THEN 'WARN' WHEN confidence >= 75 THEN 'WARN' ELSE 'ALLOW' END"""
