"""Queries over conversation state and rule verdicts."""

from pyspark.sql import functions as F

from palisade.dims import semantics as D
from palisade.operators import evidence as E
from palisade.operators import semantic as M
from palisade.operators import sessions as S
from palisade.operators.scan import only
from palisade.oracle import sessions as O
from palisade.oracle.sql import cte
from palisade.plans.corpus_text import normalized
from palisade.plans.evidence import keyword_table
from palisade.plans.registry import query
from palisade.session import ensure_checkpoint_dir
from palisade.sources.planted import messages
from palisade.sources.tables import stored


def flagged_messages(spark, folder):
    # Two branches read the profiled and normalised texts and their clauses, so they are made once.
    texts = stored(E.with_clauses(normalized(messages(spark, folder))))
    return E.with_cluster_flags(E.with_frames(texts), E.keyword_requests(texts, keyword_table(spark, folder)))


def message_features(spark, folder):
    """What scoring needs of each message, without its text. The text is read and matched once; the narrow result is
    checkpointed because several branches of the verdicts start from it."""
    f = M.with_signals(flagged_messages(spark, folder))
    words = [f"words_{g}" for g in D.GRADED]
    narrow = f.select(
        "conv_id", "turn", "ts_ms", "direction", "clusters", "signals", *words,
        S.speaks_of_payout(F.col("text")).alias("payout"),
        M.credential_evidence(F.col("clusters"), F.col("text"), F.col("text_hints")).alias("evidence"),
        (F.length(F.trim("text")) >= 10).alias("long_enough"),
    )
    ensure_checkpoint_dir(spark)
    return narrow.checkpoint()


def contextual_features(features):
    """Rows with inbound context; cur, payout, evidence, latest_turn and long_enough are those of the latest inbound."""
    payload = ["clusters", "signals", *[f"words_{g}" for g in D.GRADED], "payout", "evidence", "long_enough"]
    c = only(S.with_context(features, payload), F.size("ctx") > 0)
    last = F.try_element_at("ctx", F.lit(-1))
    return c.withColumns(
        {"cur": last["clusters"], "payout": last["payout"], "evidence": last["evidence"], "long_enough": last["long_enough"], "latest_turn": last["turn"]}
    )


def rule_scored(spark, folder):
    """Stateful rule candidates and verdict per message."""
    c = contextual_features(message_features(spark, folder))
    return S.with_rule_verdict(S.with_weights(c, S.decayed_weights()), "cur", "payout")


@query(
    "session_window",
    """SELECT m.conv_id, m.turn, coalesce(i.n, 0) AS n_inbound, coalesce(o.n, 0) AS n_outbound FROM q_messages m
LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM q_context GROUP BY ALL) i USING (conv_id, turn)
LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM q_out_context GROUP BY ALL) o USING (conv_id, turn)""",
)
def session_window(spark, folder):
    m = messages(spark, folder).select("conv_id", "turn", "ts_ms", "direction")
    n = F.size("ctx").cast("bigint")
    inbound = S.with_context(m, []).select("conv_id", "turn", n.alias("n_inbound"))
    outbound = S.with_context(m, [], "outbound").select("conv_id", "turn", n.alias("n_outbound"))
    return inbound.join(outbound, ["conv_id", "turn"])


@query(
    "recency_weight",
    """SELECT conv_id, count(*) AS n_context, round(sum(r), 6) AS weight_kept, round(1 - sum(r) / count(*), 6) AS share_lost
FROM q_context GROUP BY conv_id""",
)
def recency_weight(spark, folder):
    c = S.with_context(messages(spark, folder).select("conv_id", "turn", "ts_ms", "direction"), [])
    weights = F.transform("ctx", lambda x: S.recency(F.col("ts_ms") - x["ts_ms"]))
    per_row = c.select("conv_id", F.size("ctx").alias("n"), F.aggregate(weights, F.lit(0.0), lambda a, b: a + b).alias("r"))
    return (
        per_row.filter("n > 0")
        .groupBy("conv_id")
        .agg(F.sum("n").alias("n_context"), F.sum("r").alias("r"))
        .select("conv_id", "n_context", F.round("r", 6).alias("weight_kept"), F.round(1 - F.col("r") / F.col("n_context"), 6).alias("share_lost"))
    )


@query("decayed_clusters", "SELECT conv_id, turn, cluster, round(weight, 6) AS weight FROM q_decayed")
def decayed_clusters(spark, folder):
    c = contextual_features(message_features(spark, folder))
    pairs = F.array(*[F.struct(F.lit(k).alias("cluster"), F.round(w, 6).alias("weight")) for k, w in S.decayed_weights().items()])
    return (
        c.select("conv_id", "turn", F.explode(F.filter(pairs, lambda p: p["weight"] > 0)).alias("p"))
        .select("conv_id", "turn", "p.*")
    )


@query("intent_candidates", "SELECT conv_id, turn, intent, round(score, 6) AS score, set_id, matched FROM q_cand")
def intent_candidates(spark, folder):
    return rule_scored(spark, folder).select("conv_id", "turn", F.explode("cands").alias("c")).select(
        "conv_id", "turn", "c.intent", F.round("c.score", 6).alias("score"), "c.set_id", "c.matched"
    )


@query("rank_intents", "SELECT conv_id, turn, intent, round(score, 6) AS score, set_size, matched FROM q_rank WHERE rk = 1")
def rank_intents(spark, folder):
    return only(rule_scored(spark, folder), F.col("top").isNotNull()).select(
        "conv_id", "turn", "top.intent", F.round("top.score", 6).alias("score"), "top.set_size", "top.matched"
    )


@query("intent_overrides", "SELECT conv_id, turn, top AS ranked_intent, best AS intent, top <> best AS overridden FROM q_best")
def intent_overrides(spark, folder):
    return only(rule_scored(spark, folder), F.col("best").isNotNull()).select(
        "conv_id", "turn", F.col("top.intent").alias("ranked_intent"), "best.intent", (F.col("top.intent") != F.col("best.intent")).alias("overridden")
    )


def single_verdicts(spark, folder):
    return S.score_single(flagged_messages(spark, folder))


@query("score_messages", "SELECT conv_id, turn, detected, intent, confidence FROM q_single")
def score_messages(spark, folder):
    return single_verdicts(spark, folder).select("conv_id", "turn", "detected", "intent", "confidence")


@query("policy_action", f"SELECT conv_id, turn, intent, {O.POLICY} AS action FROM q_single")
def policy_action(spark, folder):
    v = single_verdicts(spark, folder)
    return v.select("conv_id", "turn", "intent", S.policy_action(F.col("detected"), F.col("intent")).alias("action"))


@query("fallback_action", f"SELECT conv_id, turn, intent, {O.FALLBACK} AS action FROM q_single")
def fallback_action(spark, folder):
    v = single_verdicts(spark, folder)
    return v.select("conv_id", "turn", "intent", S.fallback_action(F.col("intent"), F.col("confidence")).alias("action"))


# Top-level domains of the copied-text filter.
LURE_URL = r"https?://[^\s]+|(?:[a-zA-Z0-9-]+\.)+(?:com|ua|org|net|xyz|top|site|cc|info|biz|ru|su|fun|online|shop|live|store)(?:/[^\s]*)?"


@query(
    "copied_lures",
    f"""SELECT s.conv_id, s.turn, intent, confidence, regexp_extract(lower(text), '{LURE_URL.replace("a-zA-Z", "a-z")}') AS url,
  EXISTS (SELECT 1 FROM q_clusters c WHERE c.conv_id = s.conv_id AND c.turn = s.turn AND c.cluster = 'off_platform') AS off_platform
FROM q_single s WHERE detected AND (regexp_matches(lower(text), '{LURE_URL.replace("a-zA-Z", "a-z")}') OR EXISTS (
  SELECT 1 FROM q_clusters c WHERE c.conv_id = s.conv_id AND c.turn = s.turn AND c.cluster = 'off_platform'))""",
)
def copied_lures(spark, folder):
    v = only(single_verdicts(spark, folder), F.col("detected"))
    url = F.regexp_extract(F.lower("text"), LURE_URL.replace("a-zA-Z", "a-z"), 0)
    v = v.select("conv_id", "turn", "intent", "confidence", url.alias("url"), F.array_contains("clusters", "off_platform").alias("off_platform"))
    return only(v, (F.col("url") != "") | F.col("off_platform"))


@query(
    "dedup_lures",
    """SELECT conv_id, text, min(turn) AS turn, count(*) AS n_seen FROM q_messages WHERE direction = 'inbound' AND length(text) >= 5 GROUP BY ALL""",
)
def dedup_lures(spark, folder):
    return S.dedup_lures(messages(spark, folder))


VISITS = """SELECT user_id, event_id, {ms} AS ts_ms, concat('https://', CASE event_type WHEN 'purchase' THEN 'shop' ELSE 'chat' END, '.example.com/',
  CASE WHEN value > 20 THEN 'c' ELSE 'k' END, '/', CAST(event_id % 3 AS {text}), CASE WHEN event_id % 5 = 0 THEN concat('?peer=', CAST(user_id % 2 AS {text})) ELSE '' END,
  CASE event_id % 7 WHEN 0 THEN '#' WHEN 1 THEN '#x1' ELSE '' END) AS url FROM {events}"""
cte("q_visits", VISITS.format(ms="(epoch_us(ts) // 1000)", text="VARCHAR", events="events"))


def visits(spark, folder):
    from palisade.sources.tables import table

    return spark.sql(VISITS.format(ms="unix_millis(CAST(ts AS TIMESTAMP))", text="STRING", events="{e}"), e=table(spark, folder, "events"))


@query(
    "conversation_boundaries",
    """SELECT user_id, event_id, changed, sum(changed) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS session_no FROM (
  SELECT *, CASE WHEN lag(place) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) IS NOT DISTINCT FROM place THEN 0 ELSE 1 END AS changed
  FROM (SELECT *, regexp_replace(url, '#$', '') AS place FROM q_visits))""",
)
def conversation_boundaries(spark, folder):
    return S.conversation_boundaries(visits(spark, folder)).select("user_id", "event_id", "changed", "session_no")


@query(
    "verdict_trajectory",
    f"""SELECT conv_id, turn // 64 AS piece, string_agg(turn || ':' || coalesce(intent, '-') || ':' || action, ' ' ORDER BY turn) AS trajectory,
  bool_or(bool_or(action = 'LOCK_INPUT' AND turn <= 8)) OVER (PARTITION BY conv_id) AS locked_early FROM (SELECT *, {O.POLICY} AS action FROM q_single) GROUP BY conv_id, turn // 64""",
)
def verdict_trajectory(spark, folder):
    v = single_verdicts(spark, folder).withColumn("action", S.policy_action(F.col("detected"), F.col("intent")))
    step = F.concat_ws(":", F.col("turn").cast("string"), F.coalesce("intent", F.lit("-")), "action")
    v = v.select("conv_id", "turn", step.alias("s"), ((F.col("action") == "LOCK_INPUT") & (F.col("turn") <= 8)).alias("lock"))
    # One row per 64 turns, numbered, keeps the collected array bounded; the lock is judged over the whole conversation.
    pieces = v.groupBy("conv_id", F.floor(F.col("turn") / 64).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("turn", "s"))).alias("l"))
    locked = v.groupBy("conv_id").agg(F.bool_or("lock").alias("locked_early"))
    return pieces.join(locked, "conv_id").select("conv_id", "piece", F.array_join(F.transform("l", lambda x: x["s"]), " ").alias("trajectory"), "locked_early")
