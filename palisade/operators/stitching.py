"""Lures carried over to later events, external verdicts and run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.operators.scan import hour_bucket, running
from palisade.sources.tables import stored

TTL_MS = 900_000
SKEW_MS = 60_000
QUARANTINE_SCORE = 75
THREAT_TYPES = [
    "ESCROW_DELIVERY_SCAM", "OFF_PLATFORM_REDIRECT", "VERIFICATION_PHISHING", "PAYMENT_CREDENTIAL_THEFT", "IDENTITY_PROBING",
    "URGENCY_PRESSURE", "MILITARY_SABOTAGE_RECRUITMENT", "CRYPTO_WALLET_COMPROMISE", "SEED_PHRASE_THEFT",
]


def tainted_context(events: DataFrame, shift_ms: int = 0) -> DataFrame:
    """As-of join: each form or navigation event with the latest lure of its user, at most 15 minutes old.

    events: user_id, event_id, ts_ms, what in lure, submit, navigate. A clock that runs back by up to a minute is
    tolerated by letting lures count from a minute before their time stamp.
    """
    lure = F.col("what") == "lure"
    seen = events.withColumn("_at", F.when(lure, F.col("ts_ms") - SKEW_MS).otherwise(F.col("ts_ms"))).withColumn(
        "_lure", F.when(lure, F.struct("ts_ms", "event_id", "host", "scenario"))
    ).withColumn("_kind", F.when(lure, 0).otherwise(1))
    # Among the lures that count, the one with the latest own time stamp; all are shifted alike, so the order holds.
    joined = running(
        seen, ["user_id"], ["_at", "_kind", "event_id"], F.floor(F.col("_at") / 3_600_000), {"lure": ("last", F.col("_lure"), True)}
    )
    hit = joined.filter(~lure & (F.col("ts_ms") - F.col("lure.ts_ms") <= TTL_MS))
    return hit.select(
        "user_id", "event_id", "ts_ms", "what", F.col("lure.event_id").alias("lure_id"), F.col("lure.host").alias("lure_host"),
        F.col("lure.scenario").alias("scenario"), (F.col("ts_ms") - F.col("lure.ts_ms")).alias("age_ms"),
    )


def context_lineage(roots: DataFrame, edges: DataFrame, clears: DataFrame) -> DataFrame:
    """Contexts handed from parent to child within the TTL of each hop, over as many hops as there are, until their session is cleared.

    roots: subject, ts_ms, session_id, scenario; edges: parent, child, ts_ms; clears: session_id, ts_ms. A sabotage context is not handed on,
    nor a subject to itself; the child's clock starts at the edge. The first clear at or after the root withdraws every context of its session,
    wherever it was handed: it ends there (`until_ms`, `withdrawn` if that is before its TTL) and is not handed on from then. Each hop is one
    equi-join of the rows that are new, stored; it ends when a hop brings nothing new, also where edges of one moment form a ring.
    """
    columns = ["subject", "ts_ms", "session_id", "scenario", "cleared_ms"]
    started = roots.select("subject", "ts_ms", "session_id", "scenario").distinct()
    ends = started.join(clears.select("session_id", F.col("ts_ms").alias("at")), "session_id").filter(F.col("at") >= F.col("ts_ms"))
    ends = ends.groupBy("session_id", "ts_ms").agg(F.min("at").alias("cleared_ms"))
    level = known = stored(started.join(ends, ["session_id", "ts_ms"], "left").select(*columns))
    while not level.isEmpty():
        e, l = edges.alias("e"), level.alias("l")
        handed = (
            l.join(e, F.col("l.subject") == F.col("e.parent"))
            .filter(
                (F.col("l.scenario") != "SABOTAGE") & (F.col("e.parent") != F.col("e.child"))
                & (F.col("e.ts_ms") >= F.col("l.ts_ms")) & (F.col("e.ts_ms") - F.col("l.ts_ms") <= TTL_MS)
                & (F.col("l.cleared_ms").isNull() | (F.col("e.ts_ms") < F.col("l.cleared_ms")))
            )
            .select(F.col("e.child").alias("subject"), F.col("e.ts_ms"), "l.session_id", "l.scenario", "l.cleared_ms")
            .distinct()
        )
        level = stored(handed.join(known, ["subject", "ts_ms", "session_id", "scenario"], "left_anti"))
        known = known.unionByName(level)
    expires = F.col("ts_ms") + TTL_MS
    return known.select(
        "subject", "ts_ms", "session_id", "scenario", F.least(expires, "cleared_ms").alias("until_ms"), F.coalesce(F.col("cleared_ms") <= expires, F.lit(False)).alias("withdrawn")
    )


def verdict_problem() -> Column:
    """First broken rule of an external verdict, or null."""
    return (
        F.when(F.col("is_scam").isNull(), "flag_missing")
        .when(F.col("confidence").isNull(), "confidence_missing")
        .when(~F.col("confidence").between(0, 100), "confidence_out_of_range")
        .when(F.col("is_scam") & F.col("scam_type").isNull(), "type_missing")
        .when(F.col("is_scam") & ~F.col("scam_type").isin(*THREAT_TYPES), "type_not_allowed")
        .when(F.length(F.trim("reasoning")) == 0, "reason_empty")
    )


def verdict_reuse(checks: DataFrame, ttl_ms: int = 300_000) -> DataFrame:
    """Checks that could reuse an earlier verdict on exactly the same evidence within five minutes.

    checks: evidence (text), check_id, ts_ms. Reuse does not extend the life of the stored verdict: the first check after an expiry stores a new
    one. Which checks store one is found by pointer doubling: every moment of a key points to its first moment after the expiry; a moment
    with nothing in the TTL before it stores a verdict for certain; from those, pointers of 1, 2, 4, ... steps reach all others in as many
    rounds as the longest chain has binary digits. No key or chain is walked in one task.
    """
    keyed = checks.withColumn("key", F.sha2("evidence", 256)).select("key", "check_id", "ts_ms")
    day = lambda c: F.floor(F.col(c) / 86_400_000)
    moments = stored(keyed.groupBy("key", "ts_ms").agg(F.min("check_id").alias("first_id")))
    prev = running(moments, ["key"], ["ts_ms"], day("ts_ms"), {"prev": ("last", F.col("ts_ms"), False)})
    reached = stored(prev.filter(F.col("prev").isNull() | (F.col("ts_ms") - F.col("prev") >= ttl_ms)).select("key", "ts_ms"))
    # Seen backwards in time, the last moment before a question put at ts + ttl is the first one at or after it.
    asked = moments.select("key", "ts_ms", (-F.col("ts_ms") - ttl_ms).alias("neg"), F.lit(1).alias("kind"))
    known = moments.select("key", "ts_ms", (-F.col("ts_ms")).alias("neg"), F.lit(0).alias("kind"))
    seen = running(known.unionByName(asked), ["key"], ["neg", "kind", "ts_ms"], day("neg"), {"dst": ("last", F.when(F.col("kind") == 0, F.col("ts_ms")), True)})
    links = seen.filter((F.col("kind") == 1) & F.col("dst").isNotNull()).select("key", F.col("ts_ms").alias("src"), "dst")
    jump = stored(links.join(reached.withColumnRenamed("ts_ms", "dst"), ["key", "dst"], "left_anti").select("key", "src", "dst"))
    while not jump.isEmpty():
        more = reached.join(jump.withColumnRenamed("src", "ts_ms"), ["key", "ts_ms"]).select("key", F.col("dst").alias("ts_ms"))
        reached = stored(reached.unionByName(more).distinct())
        on = jump.select("key", F.col("src").alias("dst"), F.col("dst").alias("end"))
        jump = stored(jump.join(on, ["key", "dst"]).select("key", "src", F.col("end").alias("dst")))
    marked = moments.join(reached.withColumn("stores", F.col("ts_ms")), ["key", "ts_ms"], "left")
    anchors = running(marked, ["key"], ["ts_ms"], day("ts_ms"), {"anchor_ms": ("last", F.col("stores"), True)})
    return keyed.join(anchors.select("key", "ts_ms", "anchor_ms", "first_id"), ["key", "ts_ms"]).select(
        "key", "check_id", "ts_ms", "anchor_ms", (~((F.col("ts_ms") == F.col("anchor_ms")) & (F.col("check_id") == F.col("first_id")))).alias("reused")
    )


def session_quarantine(verdicts: DataFrame) -> DataFrame:
    """After a scam verdict of 75 and more, every later check of the conversation is scam with 99."""
    hit = (F.col("is_scam") & (F.col("confidence") >= QUARANTINE_SCORE)).cast("int")
    q = running(verdicts, ["conv_id"], ["turn"], F.floor(F.col("turn") / 4096), {"_q": ("max", hit, False)})
    on = F.coalesce("_q", F.lit(0)) == 1
    return q.select(
        "conv_id", "turn", on.alias("quarantined"), (on | F.coalesce("is_scam", F.lit(False))).alias("is_scam"),
        F.when(on, 99.0).otherwise(F.col("confidence")).alias("confidence"),
    )


# Words that turn a scam verdict into sabotage recruitment.
SABOTAGE_WORDS = r"(?:sabotage|диверс|військов|military|підпал|тцк|координат)"


def reconcile(joined: DataFrame) -> DataFrame:
    """joined: conv_id, turn, text, local_intent, local_confidence, is_scam, ext_confidence, scam_type, reasoning, answered."""
    weak = F.col("answered") & ~F.col("is_scam") & (F.col("ext_confidence") < 50)
    fallback = ~F.col("answered") | weak
    escalate = F.lower(F.concat_ws(" ", "reasoning", "text")).rlike(SABOTAGE_WORDS)
    source = F.when(fallback, "local").when(~F.col("is_scam"), "clear").otherwise("external")
    return joined.select(
        "conv_id", "turn", source.alias("source"),
        F.when(source == "local", F.col("local_intent"))
        .when(source == "external", F.when(escalate, "MILITARY_SABOTAGE_RECRUITMENT").otherwise(F.coalesce("scam_type", "local_intent", F.lit("UNKNOWN"))))
        .alias("intent"),
        F.when(source == "local", F.col("local_confidence"))
        .when(source == "external", F.coalesce("ext_confidence", F.lit(75.0)))
        .otherwise(0.0).alias("confidence"),
    )


def check_lifecycle(events: DataFrame, keep: int = 150) -> DataFrame:
    """Latest state per check: pending until its first terminal event, later ones are ignored; the newest 150 stay."""
    t = F.struct("ts_ms", "event_id", "status")
    done = F.col("status") != "pending"
    state = events.groupBy("check_id").agg(
        F.min(F.when(~done, F.col("ts_ms"))).alias("started_ms"), F.min(F.when(done, t)).alias("end")
    ).filter(F.col("started_ms").isNotNull())
    rows = state.select(
        "check_id", F.coalesce("end.status", F.lit("pending")).alias("status"), "started_ms",
        F.col("end.ts_ms").alias("finished_ms"), (F.col("end.ts_ms") - F.col("started_ms")).alias("duration_ms"),
    )
    return rows.orderBy(F.desc("started_ms"), F.desc("check_id")).limit(keep)


def session_peak_risk(scores: DataFrame) -> DataFrame:
    """scores: user_id, event_id, ts_ms, score, reset (0/1). Running peak per segment; mitigated when the live score is
    below a peak of 35 and more."""
    bucket = hour_bucket()
    seg = running(scores, ["user_id"], ["ts_ms", "event_id"], bucket, {"segment": ("sum", F.col("reset"), True)})
    peak = running(seg, ["user_id", "segment"], ["ts_ms", "event_id"], bucket, {"peak": ("max", F.col("score"), True)})
    p = F.col("peak")
    return peak.select(
        "user_id", "event_id", "segment", "score", "peak",
        F.when(p >= 76, "CRITICAL").when(p >= 51, "HIGH").when(p >= 21, "MEDIUM").otherwise("LOW").alias("severity"),
        ((p >= 35) & (F.col("score") < p)).alias("mitigated"),
    )


def rolling_usage(log: DataFrame, ceiling: int) -> DataFrame:
    """log: request_id, ts_ms, tokens. Tokens of the last minute, gap to the request before, rows over a ceiling.

    The log is cut into minutes; every minute also gets the rows of the one before it.
    """
    minute = F.floor(F.col("ts_ms") / 60_000)
    cut = log.withColumn("_h", F.explode(F.array(minute, minute + 1)))
    w = W.partitionBy("_h").orderBy("ts_ms")
    summed = cut.withColumn("minute_tokens", F.sum("tokens").over(w.rangeBetween(-60_000, 0))).filter(F.col("_h") == minute)
    keyed = summed.withColumn("_all", F.lit(1))
    gap = running(keyed, ["_all"], ["ts_ms", "request_id"], F.col("_h"), {"_prev": ("last", F.col("ts_ms"), False)})
    return gap.select(
        "request_id", "ts_ms", "tokens", "minute_tokens", (F.col("ts_ms") - F.col("_prev")).alias("gap_ms"),
        (F.col("minute_tokens") > ceiling).alias("over_ceiling"),
    )


# Words read as confidence and as a verdict in malformed replies.
CONFIDENCE_WORDS = {"high": 95.0, "medium": 70.0, "low": 25.0}
SCAM_WORDS = r"(?:scam|fraud|phish|шахрай|мошен|загроз)"
TYPE_WORDS = [
    ("MILITARY_SABOTAGE_RECRUITMENT", r"(?:sabotage|military|диверс)"),
    ("CRYPTO_WALLET_COMPROMISE", r"(?:seed|wallet|гаман)"),
    ("IDENTITY_PROBING", r"(?:identity|passport|document)"),
    ("OFF_PLATFORM_REDIRECT", r"(?:off.?platform|messenger|telegram)"),
    ("PAYMENT_CREDENTIAL_THEFT", r"(?:cvv|card|payment)"),
]


# The keys under which replies state a field, and where in a reply its object may lie.
REPLY_KEYS = {"flag": ["isScam", "is_scam", "scam", "fraud"], "conf": ["confidence", "score", "probability"], "kind": ["scamType", "scam_type"]}
REPLY_PLACES = ["$", "$[0]", "$.result", "$.verdict", "$[0].result"]


def repair_replies(replies: DataFrame) -> DataFrame:
    """replies: reply_id, body. Well-formed JSON is read as such, whatever its shape; otherwise fields are picked out by pattern.

    The body may be an object, an array of one, an object that nests it, a JSON string that holds an escaped object, or text around one (the
    stretch from its first to its last bracket is tried). A field is looked for by its names in the places in order; a stated flag stands, without
    one the words of the body decide. Values keep their case until they are compared.
    """
    whole = F.try_parse_json("body")
    inner = F.try_parse_json(F.try_variant_get(whole, "$", "string"))
    cut = F.try_parse_json(F.nullif(F.regexp_extract("body", r"(?s)([\[{].*[\]}])", 1), F.lit("")))
    shaped = lambda v: F.when(F.substring(F.schema_of_variant(v), 1, 5).isin("OBJEC", "ARRAY"), v)
    rows = replies.select("reply_id", F.lower("body").alias("body"), whole.alias("whole"), inner.alias("inner"), cut.alias("cut"))
    rows = rows.select("reply_id", "body", F.coalesce(shaped(F.col("whole")), shaped(F.col("inner")), shaped(F.col("cut"))).alias("json"))
    field = lambda name: F.coalesce(*[F.try_variant_get("json", f"{place}.{key}", "string") for place in REPLY_PLACES for key in REPLY_KEYS[name]])
    picked = lambda name: F.nullif(F.regexp_extract("body", rf'"(?:{"|".join(REPLY_KEYS[name]).lower()})"\s*:\s*"?([a-z0-9_.%]+)', 1), F.lit(""))
    stated = rows.select(
        "reply_id", "body", F.col("json").isNotNull().alias("is_json"), field("kind").alias("kind"),
        F.lower(F.trim(F.coalesce(field("flag"), picked("flag")))).alias("f"), F.lower(F.trim(F.coalesce(field("conf"), picked("conf")))).alias("c"),
    ).withColumn("num", F.replace("c", F.lit("%"), F.lit("")).try_cast("double"))
    words = F.col("body").rlike(SCAM_WORDS)
    is_scam = F.when(F.col("f").isin("true", "yes", "1"), True).when(F.col("f").isin("false", "no", "0"), False)
    scam = F.coalesce(is_scam, words)
    confidence = F.coalesce(
        "num", *[F.when(F.col("c") == w, v) for w, v in CONFIDENCE_WORDS.items()], F.when(scam, 90.0).otherwise(15.0)
    )
    intent = F.lit(None).cast("string")
    for name, pattern in reversed(TYPE_WORDS):
        intent = F.when(F.col("body").rlike(pattern), name).otherwise(intent)
    named = F.when(F.upper("kind").isin(*THREAT_TYPES), F.upper("kind"))
    return stated.select(
        "reply_id", scam.alias("is_scam"), F.least(F.greatest(confidence, F.lit(0.0)), F.lit(100.0)).alias("confidence"),
        F.when(scam, F.coalesce(named, intent, F.lit("UNKNOWN"))).alias("scam_type"), "is_json",
        (is_scam.isNull() & ~words & F.col("num").isNull()).alias("rejected"),
    )
