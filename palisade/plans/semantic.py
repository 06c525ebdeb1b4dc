"""Queries over semantic similarity and the combined conversation verdicts."""

from pyspark.sql import functions as F

from palisade.dims import semantics as D
from palisade.operators import semantic as M
from palisade.operators import sessions as S
from palisade.operators.scan import only
from palisade.oracle.sql import cte, lit, values
from palisade.plans.registry import query
from palisade.plans.sessions import contextual_features, message_features
from palisade.sources.planted import messages
from palisade.sources.tables import table

KEYS = ["conv_id", "turn"]


def _clean(x):
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _terms(source, keys):
    """source: keys, text (one row per text)."""
    concepts = "\n".join(f"UNION ALL SELECT {keys}, '__{n}__', 3.0 FROM c WHERE regexp_matches(c, {lit(p)})" for n, p in D.CONCEPTS)
    return f"""WITH c AS (SELECT {keys}, {_clean('text')} AS c FROM {source}),
w AS (SELECT {keys}, w FROM (SELECT {keys}, unnest(string_split(c, ' ')) AS w FROM c) WHERE length(w) >= 3)
SELECT {keys}, term, sum(x) AS w FROM (SELECT {keys}, w AS term, 2.0 AS x FROM w
UNION ALL SELECT {keys}, substr('_' || w || '_', i, 3), 1.0 FROM (SELECT {keys}, w, unnest(range(1, length(w) + 1)) AS i FROM w)
UNION ALL SELECT {keys}, substr('_' || w || '_', i, 4), 1.5 FROM (SELECT {keys}, w, unnest(range(1, length(w))) AS i FROM w)
{concepts}) GROUP BY ALL"""


cte("q_protos", values([(i, k, t) for i, (k, t) in enumerate(D.PROTOTYPES)], "pno, kind, text"))
cte("q_proto_terms", _terms("q_protos", "pno, kind"))
cte("q_proto_vec", "SELECT pno, kind, term, w / sqrt(sum(w * w) OVER (PARTITION BY pno)) AS w FROM q_proto_terms")
cte("q_msg_terms", _terms("q_messages", "conv_id, turn"))
cte("q_combined", f"SELECT conv_id, turn, string_agg('{M.PREFIX}' || ctx_text, chr(10) ORDER BY ctx_turn) AS text FROM q_context GROUP BY ALL")
cte("q_combined_terms", _terms("q_combined", "conv_id, turn"))
cte("q_latest_terms", _terms("(SELECT conv_id, turn, raw AS text FROM q_raw WHERE length(trim(raw)) >= 10)", "conv_id, turn"))


def _sims(terms):
    return f"""SELECT conv_id, turn, kind, round(least(1, max(s)), 6) AS s FROM (SELECT t.conv_id, t.turn, p.kind, p.pno, sum(t.w * p.w) / any_value(n.n) AS s FROM {terms} t
JOIN q_proto_vec p USING (term) JOIN (SELECT conv_id, turn, sqrt(sum(w * w)) AS n FROM {terms} GROUP BY ALL) n ON n.conv_id = t.conv_id AND n.turn = t.turn GROUP BY ALL) GROUP BY ALL"""


cte(
    "q_sims",
    f"""SELECT c.conv_id, c.turn, coalesce(max(s) FILTER (WHERE kind = '{M.MILITARY}'), 0) AS s_military, coalesce(max(s) FILTER (WHERE kind = '{M.PAYMENT}'), 0) AS s_payment
FROM q_combined c LEFT JOIN (SELECT * FROM ({_sims('q_combined_terms')}) UNION ALL SELECT * FROM ({_sims('q_latest_terms')})) x ON x.conv_id = c.conv_id AND x.turn = c.turn GROUP BY ALL""",
)


@query("ngram_vectors", "SELECT conv_id, turn, count(*) AS n_terms, round(sum(w * w), 4) AS sum_sq, round(max(w), 4) AS max_w FROM q_msg_terms GROUP BY ALL")
def ngram_vectors(spark, folder):
    w = M.term_weights(messages(spark, folder).select(*KEYS, "text"), KEYS)
    return w.groupBy(*KEYS).agg(
        F.count("*").alias("n_terms"), F.round(F.sum(F.col("w") * F.col("w")), 4).alias("sum_sq"), F.round(F.max("w"), 4).alias("max_w")
    )


@query("prototype_similarity", "SELECT conv_id, turn, round(s_military, 4) AS s_military, round(s_payment, 4) AS s_payment FROM q_sims")
def prototype_similarity(spark, folder):
    m = messages(spark, folder)
    narrow = m.select(*KEYS, "ts_ms", "direction", (F.length(F.trim("text")) >= 10).alias("long_enough"))
    last = F.try_element_at("ctx", F.lit(-1))
    c = only(S.with_context(narrow, ["long_enough"]), F.size("ctx") > 0)
    c = c.withColumns({"latest_turn": last["turn"], "long_enough": last["long_enough"]})
    s = M.similarities(c, m)
    return s.select(*KEYS, F.round("s_military", 4).alias("s_military"), F.round("s_payment", 4).alias("s_payment"))


def _sig(x, name):
    return f"regexp_matches(lower({x}), {lit(D.SIGNALS[name])})"


def _nwords(x, name):
    return f"len(list_distinct(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: regexp_matches(lower(w), {lit(D.SIGNALS[name])}))))"


@query("behaviour_signals", "SELECT conv_id, turn, " + ", ".join(f"{_sig('text', g)} AS has_{g}, {_nwords('text', g)} AS n_{g}" for g in D.GRADED) + " FROM q_messages")
def behaviour_signals(spark, folder):
    s = M.with_signals(messages(spark, folder))
    cols = []
    for g in D.GRADED:
        cols += [F.array_contains("signals", g).alias(f"has_{g}"), F.size(f"words_{g}").alias(f"n_{g}")]
    return s.select(*KEYS, *cols)


def _dims(x):
    out = []
    for d in D.DIMENSIONS:
        if d in D.GRADED:
            out.append(f"round(CASE WHEN {_sig(x, d)} THEN least(1.0, 0.5 + 0.2 * {_nwords(x, d)}) ELSE 0 END, 6) AS c_{d}")
        else:
            out.append(f"CASE WHEN {_sig(x, d)} THEN {D.FIXED_WEIGHTS[d]} ELSE 0.0 END AS c_{d}")
    return ", ".join(out)


cte("q_profile", f"SELECT conv_id, turn, {_dims('text')} FROM q_messages")
cte("q_profiles", values([(p, d, w) for p, ws in D.PROFILES.items() for d, w in zip(D.DIMENSIONS, ws)], "proto, dim, pw"))


def _cosine(profile):
    unpivot = " UNION ALL ".join(f"SELECT conv_id, turn, '{d}' AS dim, CAST(c_{d} AS DOUBLE) AS v FROM {profile}" for d in D.DIMENSIONS)
    return f"""SELECT conv_id, turn, proto, CASE WHEN count(*) FILTER (WHERE v > 0) < 2 THEN 0 ELSE greatest(0, least(1, round(sum(v * pw) / (sqrt(sum(v * v)) * sqrt(sum(pw * pw))), 2))) END AS cosine
FROM ({unpivot}) JOIN q_profiles USING (dim) GROUP BY ALL"""


@query("concept_profile", "SELECT * FROM q_profile")
def concept_profile(spark, folder):
    return M.message_profile(messages(spark, folder)).select(*KEYS, *[f"c_{d}" for d in D.DIMENSIONS])


@query("concept_cosine", _cosine("q_profile"))
def concept_cosine(spark, folder):
    p = M.message_profile(messages(spark, folder)).withColumns({k: M.concept_cosine(k) for k in D.PROFILES})
    return p.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(k).alias("proto"), F.col(k).alias("cosine")) for k in D.PROFILES])).alias("c")).select(*KEYS, "c.*")


@query(
    "embedding_neighbours",
    """WITH p AS (SELECT label AS proto_id, arg_min(embedding, vec_id) AS vec FROM embeddings GROUP BY label),
s AS (SELECT vec_id, proto_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(vec AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[])))), 6) AS cosine FROM embeddings, p)
SELECT * FROM (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, proto_id) AS rank, proto_id, cosine FROM s) WHERE rank <= 3""",
)
def embedding_neighbours(spark, folder):
    e = table(spark, folder, "embeddings")
    # The first vector of every class stands for it.
    protos = e.groupBy(F.col("label").alias("proto_id")).agg(F.min_by("embedding", "vec_id").alias("vec"))
    return M.embedding_neighbours(e, protos, 3)


_flags = ", ".join(f"bool_or({_sig('ctx_text', g)}) AS g_{g}, coalesce(max(r) FILTER (WHERE {_sig('ctx_text', g)}), 0) AS k_{g}" for g in D.SIGNALS)
cte("q_ctx_flags", f"SELECT conv_id, turn, bool_or(r < 1) AS stale, {_flags} FROM q_context GROUP BY ALL")
cte("q_ctx_profile", f"SELECT conv_id, turn, {_dims('text')} FROM q_combined")
_low = "lower(raw)"
cte(
    "q_evidence_flag",
    f"""SELECT conv_id, turn, CASE WHEN p OR (b AND al AND pp) THEN TRUE WHEN (NOT regexp_matches({_low}, {lit(D.MENTIONS_CREDENTIAL)}) AND regexp_matches({_low}, {lit(D.COMPLETED_CHECK)}))
  OR regexp_matches({_low}, {lit(D.CREDENTIAL_ADVICE)}) OR regexp_matches({_low}, {lit(D.SELF_SERVICE)}) THEN FALSE END AS evidence FROM (
  SELECT r.conv_id, r.turn, any_value(raw) AS raw, coalesce(bool_or(cluster IN ('payment_credential_request', 'password_theft')), FALSE) AS p, coalesce(bool_or(cluster = 'bank_login_request'), FALSE) AS b,
    coalesce(bool_or(cluster = 'action_link'), FALSE) AS al, coalesce(bool_or(cluster = 'payment_purpose'), FALSE) AS pp
  FROM q_raw r LEFT JOIN q_current c ON c.conv_id = r.conv_id AND c.turn = r.turn GROUP BY r.conv_id, r.turn)""",
)


@query("credential_evidence_flag", "SELECT conv_id, turn, evidence FROM q_evidence_flag")
def credential_evidence_flag(spark, folder):
    return contextual_features(message_features(spark, folder)).select(*KEYS, "evidence")


cte(
    "q_sem_facts",
    f"""SELECT *, g_reward AND g_action AND g_courier AS courier, g_target AND g_action AND (g_recon OR (g_media AND g_vehicle)) AS hostile, g_ideology AND g_target AND g_action AS cover,
  sim_m >= sim_p AS top_m, greatest(sim_m, sim_p) AS top FROM (
  SELECT f.*, e.evidence, round(greatest(s.s_military, m.cosine), 2) AS sim_m, round(greatest(s.s_payment, p.cosine), 2) AS sim_p
  FROM q_ctx_flags f JOIN q_sims s USING (conv_id, turn) JOIN ({_cosine('q_ctx_profile')}) m ON m.conv_id = f.conv_id AND m.turn = f.turn AND m.proto = '{M.MILITARY}'
  JOIN ({_cosine('q_ctx_profile')}) p ON p.conv_id = f.conv_id AND p.turn = f.turn AND p.proto = '{M.PAYMENT}' JOIN q_evidence_flag e ON e.conv_id = f.conv_id AND e.turn = f.turn)""",
)
cte(
    "q_sem",
    f"""SELECT *, CASE WHEN raw_intent IS NOT NULL AND (NOT stale OR conf >= CASE WHEN raw_intent = '{M.MILITARY}' THEN 75 WHEN top >= 0.45 THEN 45 ELSE 38 END) THEN raw_intent END AS sem_intent FROM (
SELECT *, CASE WHEN stale THEN round(raw_confidence * support) ELSE raw_confidence END AS conf FROM (
SELECT *, CASE WHEN raw_intent IS NULL OR NOT stale THEN 1 WHEN raw_intent = '{M.PAYMENT}' THEN least(k_action, k_credential_any) ELSE greatest(
    CASE WHEN pragmatic THEN least(k_action, body, greatest(CASE WHEN g_reward AND g_target THEN least(k_reward, k_target) ELSE 0 END, CASE WHEN g_reward AND g_discretion THEN least(k_reward, k_discretion) ELSE 0 END,
      CASE WHEN courier THEN least(k_reward, k_courier) ELSE 0 END, CASE WHEN hostile THEN least(k_target, greatest(k_recon, least(k_media, k_vehicle_any))) ELSE 0 END,
      CASE WHEN cover THEN least(k_ideology, k_target) ELSE 0 END, CASE WHEN g_sabotage THEN k_sabotage ELSE 0 END)) ELSE 0 END,
    CASE WHEN vector THEN least(k_action, body, greatest(k_recon, k_ideology, k_sabotage, k_courier, k_protected)) ELSE 0 END,
    CASE WHEN pure THEN least(k_media, k_protected, k_polite) ELSE 0 END) END AS support,
  CASE raw_intent WHEN '{M.MILITARY}' THEN least(95, greatest(round(top * 100), 75)) WHEN '{M.PAYMENT}' THEN least(90, round(top * 100)) END AS raw_confidence FROM (
SELECT *, CASE WHEN pragmatic OR vector OR pure THEN '{M.MILITARY}' WHEN coalesce(evidence, TRUE) AND NOT top_m AND g_action AND (top >= 0.45 OR (top >= 0.38 AND g_credential_hint)) THEN '{M.PAYMENT}' END AS raw_intent FROM (
SELECT *, greatest(k_target, k_sabotage, k_courier, k_recon, k_ideology) AS body,
  g_action AND physical AND ((g_reward AND g_target) OR (g_reward AND g_discretion) OR courier OR hostile OR cover OR g_sabotage) AS pragmatic,
  top_m AND g_action AND physical AND (g_recon OR g_ideology OR g_sabotage OR courier OR g_tied) AND top >= 0.4 AS vector,
  top_m AND NOT g_action AND g_polite AND g_media AND g_protected AND top >= 0.55 AS pure
FROM (SELECT *, g_target OR g_sabotage OR courier OR g_recon OR g_ideology AS physical FROM q_sem_facts)))))""",
)


def semantic_rows(spark, folder, features=None):
    """Rows that may form a semantic intent, with similarities, evidence and verdict."""
    features = message_features(spark, folder) if features is None else features
    cands = M.may_form(M.with_context_signals(M.may_signal(contextual_features(features))))
    sims = M.similarities(cands.select(*KEYS, "ctx", "latest_turn", "long_enough"), messages(spark, folder))
    return M.semantic_verdicts(cands.join(sims, KEYS, "left"))


@query("semantic_verdicts", "SELECT conv_id, turn, raw_intent AS intent, raw_confidence AS confidence, top AS similarity FROM q_sem WHERE raw_intent IS NOT NULL")
def semantic_verdicts(spark, folder):
    v = only(semantic_rows(spark, folder), F.col("raw_intent").isNotNull())
    return v.select(*KEYS, F.col("raw_intent").alias("intent"), F.col("raw_confidence").alias("confidence"), F.col("top_sim").alias("similarity"))


@query("recency_support", "SELECT conv_id, turn, raw_intent AS intent, round(support, 6) AS support, sem_intent IS NOT NULL AS kept, CASE WHEN sem_intent IS NOT NULL THEN conf END AS confidence FROM q_sem WHERE raw_intent IS NOT NULL")
def recency_support(spark, folder):
    v = only(semantic_rows(spark, folder), F.col("raw_intent").isNotNull())
    return v.select(*KEYS, F.col("raw_intent").alias("intent"), F.round("support", 6).alias("support"), F.col("sem_intent").isNotNull().alias("kept"), F.col("sem_confidence").alias("confidence"))


@query(
    "spectrum_report",
    f"""WITH u AS ({' UNION ALL '.join(f"SELECT conv_id, turn, '{d}' AS dim, c_{d} AS input_weight FROM q_profile" for d in D.DIMENSIONS)}),
t AS (SELECT conv_id, turn, max(cosine) AS best, CASE WHEN max(cosine) FILTER (WHERE proto = '{M.MILITARY}') >= max(cosine) FILTER (WHERE proto = '{M.PAYMENT}') THEN '{M.MILITARY}' ELSE '{M.PAYMENT}' END AS proto FROM ({_cosine('q_profile')}) GROUP BY ALL)
SELECT u.conv_id, u.turn, u.dim, round(input_weight, 2) AS input_weight, t.proto AS top_prototype, best AS similarity, round(pw, 2) AS prototype_weight FROM u JOIN t USING (conv_id, turn) JOIN q_profiles p ON p.proto = t.proto AND p.dim = u.dim""",
)
def spectrum_report(spark, folder):
    p = M.message_profile(messages(spark, folder)).withColumns({k: M.concept_cosine(k) for k in D.PROFILES})
    top_m = F.col(M.MILITARY) >= F.col(M.PAYMENT)
    rows = F.array(
        *[
            F.struct(F.lit(d).alias("dim"), F.round(f"c_{d}", 2).alias("input_weight"),
                     F.when(top_m, D.PROFILES[M.MILITARY][i]).otherwise(D.PROFILES[M.PAYMENT][i]).alias("prototype_weight"))
            for i, d in enumerate(D.DIMENSIONS)
        ]
    )
    return p.select(*KEYS, F.when(top_m, M.MILITARY).otherwise(M.PAYMENT).alias("top_prototype"), F.greatest(M.MILITARY, M.PAYMENT).alias("similarity"), F.explode(rows).alias("d")).select(
        *KEYS, "top_prototype", "similarity", "d.*"
    )


def conversation_verdicts(spark, folder):
    """Verdict at every turn: decayed rules first, then the semantic verdict, else none."""
    features = message_features(spark, folder)
    rules = S.with_rule_verdict(S.with_weights(contextual_features(features), S.decayed_weights()), "cur", "payout").select(
        *KEYS, "direction", F.col("best.intent").alias("rule_intent"), S.confidence(F.col("best")).alias("rule_confidence")
    )
    sem = semantic_rows(spark, folder, features).select(*KEYS, "sem_intent", "sem_confidence")
    j = rules.join(sem, KEYS, "left")
    return j.select(
        *KEYS, "direction", F.coalesce("rule_intent", "sem_intent").alias("intent"),
        F.round(F.coalesce("rule_confidence", "sem_confidence"), 4).alias("confidence"),
        F.when(F.col("rule_intent").isNotNull(), "rules").when(F.col("sem_intent").isNotNull(), "semantic").otherwise("none").alias("source"),
    )


@query(
    "score_conversations",
    """SELECT l.conv_id, l.turn, m.direction, coalesce(b.best, s.sem_intent) AS intent, round(coalesce(b.confidence, CASE WHEN s.sem_intent IS NOT NULL THEN s.conf END), 4) AS confidence,
  CASE WHEN b.best IS NOT NULL THEN 'rules' WHEN s.sem_intent IS NOT NULL THEN 'semantic' ELSE 'none' END AS source
FROM q_latest l JOIN q_messages m USING (conv_id, turn) LEFT JOIN q_best b USING (conv_id, turn) LEFT JOIN q_sem s USING (conv_id, turn)""",
)
def score_conversations(spark, folder):
    return conversation_verdicts(spark, folder)
