"""Registered runs of the streaming jobs over the given tables; the tests compare them with their batch twins."""

from pyspark.sql import functions as F

from palisade.operators import assets as A
from palisade.operators import evidence as E
from palisade.operators import sessions as S
from palisade.operators import watchlist as Wl
from palisade.operators.scan import only, union_all
from palisade.oracle import assets as OA
from palisade.oracle.sql import CTES, cte
from palisade.plans import assets as _a  # noqa: F401  (its named parts of check queries)
from palisade.plans.corpus_text import normalized
from palisade.plans.evidence import keyword_table
from palisade.plans.registry import query
from palisade.sources.planted import sent_ms, watchlist
from palisade.sources.tables import stored
from palisade.streaming import streams as X


@query(
    "stream_score_conversations",
    """SELECT l.conv_id, l.turn, m.direction, b.best AS intent, round(b.confidence, 4) AS confidence FROM q_latest l JOIN q_messages m ON m.conv_id = l.conv_id AND m.turn = l.turn
LEFT JOIN q_best b ON b.conv_id = l.conv_id AND b.turn = l.turn""",
)
def stream_score_conversations(spark, folder):
    """Rule verdicts of the stream; the stateful step only keeps the context, the verdict is the batch expression. Requests of listed keywords
    meet the static list and reach the context as rows of their own."""
    n = normalized(X.stream_messages(spark, folder))
    f = E.with_cluster_flags(E.with_frames(n))
    narrow = f.select("conv_id", "turn", "ts_ms", "ts", "direction", F.array_join("clusters", ",").alias("clusters"), S.speaks_of_payout(F.col("text")).alias("payout"))
    asked = E.keyword_requests(normalized(X.stream_messages(spark, folder)), keyword_table(spark, folder), ["conv_id", "turn", "ts_ms", "ts"])
    none = lambda kind: F.lit(None).cast(kind)
    marks = asked.select("conv_id", "turn", "ts_ms", "ts", none("string").alias("direction"), F.lit("identity_probing").alias("clusters"), none("boolean").alias("payout"))
    ctx = X.drain(X.with_stream_context(narrow.unionByName(marks)))
    last = F.try_element_at("ctx", F.lit(-1))
    held = only(ctx, F.size("ctx") > 0).withColumns({"cur": last["clusters"], "payout": last["payout"]})
    v = S.with_rule_verdict(S.with_weights(held, S.decayed_weights()), "cur", "payout")
    return v.select("conv_id", "turn", "direction", F.col("best.intent").alias("intent"), F.round(S.confidence(F.col("best")), 4).alias("confidence"))


_BEFORE = "(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
TURNS_PER_SESSION = 6  # planted: the other side changes every so many turns

cte(
    "q_session_items",
    "SELECT conv_id, turn, list(DISTINCT item_id) AS items FROM q_msg_tokens JOIN q_item_tokens USING (token) GROUP BY ALL",
)
cte(
    "q_session_leaks",
    f"""SELECT *, coalesce(bool_or(cvv_now) OVER w, FALSE) AS cvv_before, len(list_distinct(list(CASE WHEN cvv_now THEN coalesce(cvv, lone) END) OVER v)) AS n_cvvs FROM (
  SELECT *, cvv IS NOT NULL OR ((card_now OR card_before) AND lone IS NOT NULL) AS cvv_now FROM (
    SELECT *, coalesce(bool_or(card_now) OVER w, FALSE) AS card_before, coalesce(bool_or(exp_now) OVER w, FALSE) AS exp_before, coalesce(bool_or(n_items > 0) OVER w, FALSE) AS items_before,
      len(list_distinct(flatten(list(cards) OVER v))) AS n_cards, len(list_distinct(list(expiry) OVER v)) AS n_expiries, len(list_distinct(list(otp) OVER v)) AS n_otps,
      len(list_distinct(flatten(list(items) OVER v))) AS n_labels FROM (
      SELECT a.*, turn // {TURNS_PER_SESSION} AS session, len(cards) > 0 AS card_now, expiry IS NOT NULL AS exp_now, otp IS NOT NULL AS otp_now, gps IS NOT NULL AS has_gps, sabotage IS NOT NULL AS sab,
        {OA.lone('text')} AS lone, coalesce(i.items, []) AS items, len(coalesce(i.items, [])) AS n_items
      FROM q_assets a LEFT JOIN q_session_items i USING (conv_id, turn) WHERE direction = 'outbound')
    WINDOW w AS (PARTITION BY conv_id, session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY conv_id, session ORDER BY turn ROWS UNBOUNDED PRECEDING)))
WINDOW w AS (PARTITION BY conv_id, session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY conv_id, session ORDER BY turn ROWS UNBOUNDED PRECEDING)""",
)
cte("q_session_state", "SELECT * EXCLUDE (gps, has_gps), has_gps AS gps FROM q_session_leaks")
cte("q_session_rows", CTES["q_leak_rows"].replace("q_leak_state", "q_session_state"))


@query(
    "stream_cross_leaks",
    """SELECT conv_id, turn, session, card_now, cvv_now, exp_now, otp_now, gps, sab, n_items, card_before, exp_before, cvv_before, items_before, n_cards, n_cvvs, n_expiries, n_otps, n_labels,
  (card_before AND (cvv_now OR exp_now)) OR (card_now AND (cvv_before OR exp_before)) AS is_cross, least(s, 100) AS score,
  CASE WHEN s >= 70 THEN 'CRITICAL' WHEN s >= 50 THEN 'HIGH' WHEN s >= 25 THEN 'MEDIUM' ELSE 'SAFE' END AS risk_level, n > 0 AS any_trigger FROM (
  SELECT st.*, coalesce(n, 0) AS n, coalesce(s, 0) + CASE WHEN gps OR sab THEN 100 ELSE 0 END AS s FROM q_session_state st LEFT JOIN (
    SELECT conv_id, turn, count(*) AS n, coalesce(sum(contribution + bonus) FILTER (WHERE scenario NOT IN ('gps', 'sabotage')), 0) AS s FROM q_session_rows GROUP BY ALL) USING (conv_id, turn))""",
)
def stream_cross_leaks(spark, folder):
    """What a session has sent so far, kept by the stream; triggers and score are the batch expressions over its rows."""
    sent = lambda: X.stream_messages(spark, folder).filter("direction = 'outbound'")
    none = lambda kind: F.lit(None).cast(kind)
    m = A.with_assets(sent()).select(
        "conv_id", "turn", "ts_ms", "ts", F.floor(F.col("turn") / TURNS_PER_SESSION).alias("session"), "cards", "cvv", A.standalone_cvv(F.col("text")).alias("lone"), "expiry", "otp",
        F.col("gps").isNotNull().alias("gps"), F.col("sabotage").isNotNull().alias("sab"), none("long").alias("item_id"),
    )
    items = watchlist(spark, folder).filter("enabled")
    keyed = sent().select(F.struct("conv_id", "turn", "ts_ms", "ts").alias("doc"), "text")
    variants = stored(Wl.item_variants(items))
    hits = Wl.text_tokens(keyed, "doc", variants).join(Wl.tokens_of(variants), "token").select("doc.*", F.col("item_id").cast("long").alias("item_id"))
    marks = hits.select("conv_id", "turn", "ts_ms", "ts", *[none(f.dataType).alias(f.name) for f in m.schema.fields[4:-1]], "item_id")
    state = X.drain(X.with_stream_memory(m.unionByName(marks)))
    return state.join(A.leak_scores(A.leak_triggers(state)), ["conv_id", "turn"])


@query(
    "stream_tainted_context",
    """SELECT form_user, form_ts, form_id, form_user AS lure_user, l.t AS lure_ts, l.i AS lure_id FROM (
  SELECT f.user_id AS form_user, f.ts AS form_ts, f.event_id AS form_id, max({'t': e.ts, 'i': e.event_id}) AS l FROM events f JOIN events e ON e.user_id = f.user_id AND e.event_type = 'error'
    AND f.ts >= e.ts - INTERVAL 60 SECONDS AND f.ts <= e.ts + INTERVAL 15 MINUTES WHERE f.event_type IN ('purchase', 'signup') GROUP BY ALL)""",
)
def stream_tainted_context(spark, folder):
    e = X.stream_table(spark, folder, "events", F.col("ts")).withColumn("at", F.col("ts").cast("timestamp"))
    lures = e.filter("event_type = 'error'").select(F.col("user_id").alias("lure_user"), F.col("at").alias("lure_ts"), F.col("event_id").alias("lure_id"))
    forms = e.filter("event_type IN ('purchase', 'signup')").select(F.col("user_id").alias("form_user"), F.col("at").alias("form_ts"), F.col("event_id").alias("form_id"))
    return X.latest_lure(X.drain(X.tainted(lures, forms)))


@query("stream_dedup", "SELECT conv_id, min(turn) AS turn, text FROM q_messages WHERE direction = 'inbound' AND length(text) >= 5 GROUP BY conv_id, text")
def stream_dedup(spark, folder):
    return X.drain(X.dedup(X.stream_messages(spark, folder))).select("conv_id", "turn", "text")


@query(
    "stream_quarantine",
    f"""SELECT conv_id, turn, q AS quarantined, q OR s AS is_scam, CASE WHEN q THEN 99.0 ELSE c END AS confidence FROM (
  SELECT *, coalesce(bool_or(s AND c >= 75) OVER {_BEFORE}, FALSE) AS q FROM (
    SELECT conv_id, turn, (conv_id * 3 + turn) % 4 = 1 AS s, CAST((conv_id * 31 + turn * 17) % 101 AS DOUBLE) AS c FROM conversations))""",
)
def stream_quarantine(spark, folder):
    c = X.stream_conversations(spark, folder)
    h = (F.col("conv_id") * 31 + F.col("turn") * 17) % 101
    v = c.select("conv_id", "turn", sent_ms().alias("ts_ms"), F.timestamp_millis(sent_ms()).alias("ts"), ((F.col("conv_id") * 3 + F.col("turn")) % 4 == 1).alias("is_scam"), h.cast("double").alias("confidence"))
    return X.drain(X.quarantine(v))


_VERDICTS = "SELECT ts, 'h' || (event_id % 9) AS host, event_type AS kind FROM events"


@query(
    "stream_detection_counts",
    f"""WITH v AS ({_VERDICTS}),
g AS (SELECT *, sum(CASE WHEN ts - before <= INTERVAL 15 MINUTES THEN 0 ELSE 1 END) OVER (PARTITION BY host, kind ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, lag(ts) OVER (PARTITION BY host, kind ORDER BY ts) AS before FROM v))
SELECT 'tumbling' AS "window", time_bucket(INTERVAL 5 MINUTES, ts) AS from_ts, time_bucket(INTERVAL 5 MINUTES, ts) + INTERVAL 5 MINUTES AS to_ts, host, kind, count(*) AS n FROM v GROUP BY ALL
UNION ALL SELECT 'sliding', s, s + INTERVAL 15 MINUTES, host, kind, count(*) FROM (SELECT host, kind, time_bucket(INTERVAL 5 MINUTES, ts) - to_minutes(CAST(unnest([0, 5, 10]) AS INT)) AS s FROM v) GROUP BY ALL
UNION ALL SELECT 'session', min(ts), max(ts) + INTERVAL 15 MINUTES, host, kind, count(*) FROM g GROUP BY host, kind, island""",
)
def stream_detection_counts(spark, folder):
    def counts(window):
        e = X.closed_stream(spark, folder, "events", "ts")
        v = e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("h"), (F.col("event_id") % 9).cast("string")).alias("host"), F.col("event_type").alias("kind"))
        return X.drain(X.detection_counts(v, window)).filter("host is not null")

    return union_all([counts(w) for w in X.WINDOWS])
