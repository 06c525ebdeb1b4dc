"""Conversation state: bounded context, decayed evidence, intent candidates and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.dims import intents as I
from palisade.dims.lexicon import WEIGHTS
from palisade.operators.scan import running, turn_bucket

CHUNK = 256
HALO = I.PER_DIRECTION - 1


def recency(age_ms: Column) -> Column:
    """Full weight for a minute, then halved every five minutes."""
    return F.pow(F.lit(2.0), -F.greatest(F.lit(0), age_ms - I.FULL_WEIGHT_MS) / I.HALF_LIFE_MS)


def with_context(messages: DataFrame, payload: list[str], direction: str = "inbound", chunk: int = CHUNK,
                 turns: int = 4096) -> DataFrame:
    """Add ``ctx``: those of the last 30 messages of one direction up to each row that are younger than 15 minutes by the
    clock of the row; a message stamped later than the row (a clock that ran back) does not count.

    Messages of that direction are numbered per conversation; chunks of the numbering (plus the 29 rows before each)
    are handled apart, so a very long conversation spreads over many tasks.
    """
    own = (F.col("direction") == direction).cast("long")
    numbered = running(messages, ["conv_id"], ["turn"], turn_bucket(turns), {"_seq": ("sum", own, True)})
    piece = F.floor(F.col("_seq") / chunk)
    carry = F.col("_seq") % chunk >= chunk - HALO
    same = numbered.filter(F.col("direction") == direction)
    copies = same.withColumn(
        "_piece", F.explode(F.when(carry, F.array(piece, piece + 1)).otherwise(F.array(piece)))
    )
    frame = W.partitionBy("conv_id", "_piece").orderBy("_seq").rowsBetween(-HALO, 0)
    held = copies.withColumn("ctx", F.collect_list(F.struct("turn", "ts_ms", *payload)).over(frame))
    held = held.filter(F.col("_piece") == piece).drop("_piece")
    others = numbered.filter(F.col("direction") != direction).join(
        held.select("conv_id", "_seq", "ctx"), ["conv_id", "_seq"], "left"
    )
    age = lambda x: F.col("ts_ms") - x["ts_ms"]
    fresh = F.filter(F.coalesce("ctx", F.array()), lambda x: (age(x) >= 0) & (age(x) < I.SESSION_MS))
    return held.unionByName(others.select(*held.columns)).withColumn("ctx", fresh).drop("_seq")


def decayed_weights() -> dict[str, Column]:
    """cluster -> strongest decayed weight over the inbound context (0 when absent)."""
    now = F.col("ts_ms")
    aged = F.transform("ctx", lambda x: F.struct(recency(now - x["ts_ms"]).alias("r"), x["clusters"].alias("c")))
    return {
        c: F.coalesce(
            F.array_max(F.transform(F.filter(aged, lambda x: F.array_contains(x["c"], c)), lambda x: x["r"])), F.lit(0.0)
        ) * w
        for c, w in WEIGHTS.items()
    }


def plain_weights(clusters: Column) -> dict[str, Column]:
    return {c: F.when(F.array_contains(clusters, c), F.lit(float(w))).otherwise(0.0) for c, w in WEIGHTS.items()}


def with_weights(df: DataFrame, weights: dict[str, Column]) -> DataFrame:
    return df.withColumns({f"w_{c}": F.round(w, 9) for c, w in weights.items()})


def candidates(current: Column) -> Column:
    """array<struct> of the formed candidates, from columns w_<cluster> and the clusters of the current message."""
    weight = lambda c: F.col(f"w_{c}")
    found = []
    for intent, min_score, min_clusters, required, evidence in I.INTENTS:
        n = sum((F.when(weight(c) > 0, 1).otherwise(0) for c in evidence), F.lit(0))
        score = F.round(sum((weight(c) for c in evidence), F.lit(0.0)), 9)
        chosen = F.lit(None).cast("int")
        for i, clusters in reversed(list(enumerate(required))):
            full = F.lit(True)
            for c in clusters:
                full = full & (weight(c) > 0)
            chosen = F.when(full, F.lit(i)).otherwise(chosen)
        sizes = F.array(*[F.lit(len(s)) for s in required])
        ok = (n >= min_clusters) & (score >= min_score) & chosen.isNotNull()
        if intent == "OFF_PLATFORM_REDIRECT":
            ok = ok & F.array_contains(current, "off_platform") & F.array_contains(current, "off_platform_action")
        found.append(
            F.when(
                ok,
                F.struct(
                    score.alias("score"),
                    F.element_at(sizes, chosen + 1).alias("set_size"),
                    n.alias("matched"),
                    F.round(score / min_score, 9).alias("ratio"),
                    # Ties go to the first name in alphabetical order.
                    F.lit(-sorted(i[0] for i in I.INTENTS).index(intent)).alias("order"),
                    F.lit(intent).alias("intent"),
                    chosen.alias("set_id"),
                ),
            )
        )
    return F.array_compact(F.array(*found))


def with_rule_verdict(df: DataFrame, current: str, payout: str) -> DataFrame:
    """Add cands, top (best by rank) and best (after the three tie-breaking rules, one after the other).

    payout tells whether the latest message speaks of receiving a payout. Each rule is a column of its own: nesting them would multiply the expression.
    """
    has = lambda c: F.array_contains(current, c)
    ranked = df.withColumn("cands", candidates(F.col(current))).withColumn("top", F.array_max("cands"))
    ranked = ranked.withColumns(
        {
            "_leave": has("off_platform_action") & ~has("transaction_redirect") & ~has("payment_claim")
            & ~has("payment_credential_request") & ~F.col(payout),
            "_papers": has("identity_probing") & ~has("payment_credential_request") & ~has("password_theft"),
            "_money": has("payment_credential_request") | (has("bank_login_request") & has("action_link")),
            "_purpose": F.when(has("verification_purpose") & ~has("payment_purpose"), "VERIFICATION_PHISHING").otherwise(
                "PAYMENT_CREDENTIAL_THEFT"
            ),
            **{f"_has_{i}": F.array_contains(F.transform("cands", lambda c: c["intent"]), i)
               for i in ("OFF_PLATFORM_REDIRECT", "IDENTITY_PROBING", "VERIFICATION_PHISHING", "PAYMENT_CREDENTIAL_THEFT")},
        }
    )

    def rule(source: str, when: Column, target: str) -> Column:
        return F.when(when & F.col(f"_has_{target}"), F.lit(target)).otherwise(F.col(source))

    named = ranked.withColumn("_b0", F.col("top.intent"))
    named = named.withColumn("_b1", rule("_b0", (F.col("_b0") == "ESCROW_DELIVERY_SCAM") & F.col("_leave"), "OFF_PLATFORM_REDIRECT"))
    named = named.withColumn("_b2", rule("_b1", (F.col("_b1") == "VERIFICATION_PHISHING") & F.col("_papers"), "IDENTITY_PROBING"))
    money = F.col("_b2").isin(I.FINANCIAL) & F.col("_money")
    possible = F.when(F.col("_purpose") == "VERIFICATION_PHISHING", F.col("_has_VERIFICATION_PHISHING")).otherwise(
        F.col("_has_PAYMENT_CREDENTIAL_THEFT")
    )
    named = named.withColumn("_b3", F.when(money & possible, F.col("_purpose")).otherwise(F.col("_b2")))
    out = named.withColumn("best", F.get(F.filter("cands", lambda c: c["intent"] == F.col("_b3")), F.lit(0)))
    return out.drop(*[c for c in out.columns if c.startswith(("_b", "_has_")) or c in ("_leave", "_papers", "_money", "_purpose")])


def speaks_of_payout(text: Column) -> Column:
    return F.lower(text).rlike(I.PAYOUT_WORDS)


def confidence(best: Column) -> Column:
    return F.when(best.isNotNull(), F.least(best["score"], F.lit(100.0)))


def policy_action(detected: Column, intent: Column) -> Column:
    return (
        F.when(~detected | intent.isNull(), "ALLOW").when(intent.isin(I.LOCKING), "LOCK_INPUT").otherwise("WARN")
    )


def fallback_action(intent: Column, score: Column) -> Column:
    return (
        F.when(score.isNull() | F.isnan(score) | (score <= 0), "ALLOW")
        .when(intent.isin(I.LOCKING), F.when(score >= 75, "LOCK_INPUT").otherwise("ALLOW"))
        .when(intent.isin(I.ADVISORY), "WARN")
        .when(score >= 75, "WARN")
        .otherwise("ALLOW")
    )


def score_single(flagged: DataFrame) -> DataFrame:
    """Stateless verdict of each message from its own clusters."""
    facts = with_weights(flagged, plain_weights(F.col("clusters"))).withColumn("payout", speaks_of_payout(F.col("text")))
    scored = with_rule_verdict(facts, "clusters", "payout")
    return scored.select(
        "conv_id",
        "turn",
        "ts_ms",
        "direction",
        "text",
        "clusters",
        F.col("best").isNotNull().alias("detected"),
        F.col("best.intent").alias("intent"),
        confidence(F.col("best")).alias("confidence"),
    )


def dedup_lures(messages: DataFrame) -> DataFrame:
    """First appearance of every inbound text of five characters and more in its conversation."""
    once = messages.filter((F.col("direction") == "inbound") & (F.length("text") >= 5))
    return once.groupBy("conv_id", "text").agg(F.min("turn").alias("turn"), F.count("*").alias("n_seen"))


def conversation_boundaries(visits: DataFrame) -> DataFrame:
    """Session number per user over visits(user_id, event_id, ts_ms, url); a change of host, path, query or
    non-empty fragment starts a new session."""
    part = lambda name: F.coalesce(F.parse_url("url", F.lit(name)), F.lit(""))
    keyed = visits.withColumn("place", F.concat_ws("\u0001", part("HOST"), part("PATH"), part("QUERY"), part("REF")))
    bucket = F.floor(F.col("ts_ms") / 86_400_000)
    prev = running(
        keyed, ["user_id"], ["ts_ms", "event_id"], bucket, {"prev": ("last", F.col("place"), False)}
    ).withColumn("changed", (F.col("prev").isNull() | (F.col("prev") != F.col("place"))).cast("long"))
    return running(prev, ["user_id"], ["ts_ms", "event_id"], bucket, {"session_no": ("sum", F.col("changed"), True)})
