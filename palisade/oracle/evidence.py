from palisade.dims import requests as R
from palisade.dims.lexicon import WEIGHTS
from palisade.operators import evidence as E
from palisade.oracle.sql import cte, lit, values
from palisade.oracle.text import norm_words

cte("q_rules", values(E.rule_rows(), "rule_id, cluster, lang, weight, pattern"))
cte("q_weights", values(list(WEIGHTS.items()), "cluster, weight"))

# One branch per rule keeps the patterns constant. Negated occurrences are cut out of the text before matching.
def _branch(rule, raw: bool) -> str:
    rule_id, cluster, lang, weight, pattern = rule
    x = "norm"
    if not raw:
        for guard in E.GUARDS.get(cluster, []):
            x = f"regexp_replace({x}, {lit('(' + guard + ')(?:' + pattern + ')')}, '\\1', 'g')"
    active = "" if lang == "universal" else f" AND list_contains(string_split(languages, ','), '{lang}')"
    return (
        f"SELECT conv_id, turn, {rule_id} AS rule_id, '{cluster}' AS cluster, {weight} AS weight, "
        f"trim(unnest(regexp_extract_all({x}, {lit(pattern)}))) AS span FROM q_norm WHERE length(trim(text)) >= 4{active}"
    )


cte("q_matches", "\nUNION ALL ".join(_branch(r, False) for r in E.rule_rows()))
cte("q_raw_matches", "\nUNION ALL ".join(_branch(r, True) for r in E.rule_rows() if r[1] in E.GUARDS))


def _allowed(action: str) -> str:
    before = f"right(regexp_extract(norm, {lit('(?s)^(.*?)(?:' + action + ')')}, 1), 100)"
    return (
        f"(regexp_matches(norm, {lit(action)}) AND NOT regexp_matches({before}, {lit(E.ACTION_NEGATED)}) "
        f"AND NOT regexp_matches({before}, {lit(E.ACTION_QUOTED)}))"
    )


def _has(p: str) -> str:
    return f"regexp_matches(norm, {lit(p)})"


cte(
    "q_contextual",
    f"""
SELECT conv_id, turn, 'recon' AS rule, 'military_sabotage' AS cluster, 50 AS weight FROM q_norm
WHERE length(trim(text)) >= 4 AND {_allowed(E.RECON_ACTION)} AND {_has(E.PROTECTED_OBJECT)} AND {_has(E.RECON_TARGET)}
UNION ALL SELECT conv_id, turn, 'destructive', 'military_sabotage', 50 FROM q_norm
WHERE length(trim(text)) >= 4 AND {_allowed(E.DESTRUCTIVE_ACTION)} AND (({_has(E.DISABLE)} AND {_has(E.PROTECTED_OBJECT)})
  OR ({_has(E.INCENDIARY)} AND {_has(E.AT_STORE)}))
UNION ALL SELECT conv_id, turn, 'transaction_redirect', 'transaction_redirect', 65 FROM q_norm
WHERE length(trim(text)) >= 4 AND {_has(E.TRANSACTION)} AND {_has(E.PAYOUT_OR_FEE)} AND {_has(E.REDIRECT_TARGET)}
  AND {_allowed(E.REDIRECT_ACTION)} AND NOT {_has(E.REDIRECT_EXCUSE)}""",
)


def restore(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split(regexp_replace({x}, '([\\p{{L}}\\p{{N}}]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), "
        f"lambda p: CASE WHEN regexp_matches(p, '[a-z]') THEN translate(p, {lit(E.LATIN_FROM)}, {lit(E.LATIN_TO)}) ELSE p END), '')"
    )


cte(
    "q_clauses",
    f"""SELECT conv_id, turn, clause, raw, {restore('n')} AS t FROM (SELECT *, {norm_words('raw', 'primary_lang')} AS n FROM (
  SELECT conv_id, turn, primary_lang, unnest(l) AS raw, unnest(range(len(l))) AS clause FROM (
    SELECT *, list_filter(regexp_split_to_array(text, '[.!?;\\n]+'), lambda x: length(x) > 0) AS l FROM q_norm
    WHERE length(trim(text)) >= 4)))""",
)


def marked(core: str) -> str:
    core = core.replace("[ -]?", "[ -]{0,2}")
    pattern = lit("([^\\p{L}\\p{N}])(" + core + ")([^\\p{L}\\p{N}])")
    n = 3
    # The closing boundary is the last group; capturing groups inside the pattern would shift it.
    return f"trim(replace(regexp_replace(' ' || replace(t, ' ', '  ') || ' ', {pattern}, '\\1' || chr(1) || '\\2' || chr(2) || '\\{n}', 'g'), '  ', ' '))"


def objects(kind: str, core: str) -> str:
    return f"""SELECT conv_id, turn, clause, raw, t, '{kind}' AS object, parts, unnest(range(1, len(parts))) AS i
FROM (SELECT *, string_split({marked(core)}, chr(1)) AS parts FROM q_clauses)"""


_bare_code = f"""SELECT conv_id, turn, clause, raw, t, 'payment_secret' AS object, parts, i FROM (
  SELECT *, unnest(range(1, len(parts))) AS i FROM (SELECT *, string_split(
    regexp_replace({marked(R.OBJECT_PAYMENT_SECRET)}, '(^|[^\\p{{L}}\\p{{N}}' || chr(1) || '])код([^\\p{{L}}\\p{{N}}]|$)', '\\1' || chr(4) || 'код' || chr(5) || '\\2', 'g'), chr(4)) AS parts FROM q_clauses))
WHERE regexp_matches(string_split(parts[i + 1], chr(5))[2], {lit('^.{0,100}' + R.CODE_FOLLOWED_BY)})"""

cte(
    "q_objects",
    "\nUNION ALL ".join(
        [
            objects("wallet_secret", R.OBJECT_WALLET_SECRET),
            objects("payment_secret", R.OBJECT_PAYMENT_SECRET),
            objects("account_password", R.OBJECT_ACCOUNT_PASSWORD),
            objects("identity", R.OBJECT_IDENTITY),
            _bare_code,
        ]
    ),
)


def bound(source: str, extra: str) -> str:
    """Rows of ``source`` (prefix, ...) whose object is requested, with the action found."""
    return f"""
SELECT *, length(prefix) - length(gap) - length(action) AS start FROM (
  SELECT *, regexp_extract(right(prefix, 120), {lit(E.LAST_ACTION)}, 1) AS action,
    regexp_extract(right(prefix, 120), {lit(E.LAST_ACTION)}, 2) AS gap FROM {source})
WHERE action <> '' AND NOT regexp_matches(gap, {lit(E.GAP_BREAK)}) AND NOT regexp_matches(gap, {lit(E.GAP_PURPOSE)})
  AND len(list_filter(regexp_split_to_array(trim(gap), '\\s+'), lambda w: w <> '')) <= 10
  AND NOT regexp_matches(gap, {lit(R.EXPLANATORY)}) AND NOT regexp_matches(gap, {lit(E.GAP_NOT_ASKED)})
  AND NOT (regexp_matches(action, {lit(E.QUESTION_ACTION)}) AND NOT regexp_matches(trim(gap), {lit(E.QUESTION_GAP)}))
  AND NOT list_bool_or(list_transform([{lit(R.NEGATION)}, {lit(R.REPORTED)}, {lit(R.NOT_REQUESTED)}],
    lambda p: regexp_matches(rtrim(right(left(prefix, length(prefix) - length(gap) - length(action)), 100)), p))) {extra}"""


cte(
    "q_prefixed",
    """SELECT conv_id, turn, clause, raw, t, object, regexp_replace(array_to_string(parts[1:i], ''), '[\x01\x02\x04\x05]', '', 'g') AS prefix,
  string_split(string_split(parts[i + 1], chr(2))[1], chr(5))[1] AS object_text FROM q_objects""",
)
cte("q_bound", bound("q_prefixed", ""))
cte(
    "q_frames",
    f"""SELECT conv_id, turn, clause, object, action, object_text,
  CASE WHEN regexp_matches(t, {lit(R.PAYMENT_PURPOSE)}) THEN 'payment' WHEN regexp_matches(t, {lit(R.VERIFICATION_PURPOSE)}) THEN 'verification' ELSE 'unknown' END AS purpose,
  CASE WHEN regexp_matches(lower(raw), {lit(E.TO_PAGE)}) THEN 'page' WHEN regexp_matches(t, {lit(E.TO_SPEAKER)}) THEN 'interlocutor' ELSE 'unknown' END AS destination,
  start
FROM q_bound b WHERE NOT (object = 'account_password' AND EXISTS (SELECT 1 FROM q_bound w WHERE w.conv_id = b.conv_id AND w.turn = b.turn
  AND w.clause = b.clause AND w.object = 'wallet_secret' AND w.start <= length(b.prefix)
  AND length(w.prefix) + length(w.object_text) > length(b.prefix)))""",
)
cte(
    "q_frame_evidence",
    """SELECT conv_id, turn, clause, object_text, cluster, weight FROM q_frames JOIN (VALUES
  ('object', 'identity', 'identity_probing', 45), ('object', 'wallet_secret', 'crypto_phishing', 45),
  ('object', 'account_password', 'password_theft', 40), ('object', 'payment_secret', 'payment_credential_request', 60),
  ('purpose', 'payment', 'payment_purpose', 25), ('purpose', 'verification', 'verification_purpose', 40)) d(field, v, cluster, weight)
ON v = CASE field WHEN 'object' THEN object ELSE purpose END""",
)
cte("q_keywords", "SELECT DISTINCT keyword FROM q_watchlist WHERE enabled")
cte(
    "q_keyword_prefixed",
    f"""SELECT conv_id, turn, clause, keyword, parts, unnest(range(1, len(parts))) AS i,
  replace(array_to_string(parts[1:i], ''), chr(2), '') AS prefix FROM (SELECT *, string_split(
    trim(replace(regexp_replace(' ' || replace(t, ' ', '  ') || ' ', '([^\\p{{L}}\\p{{N}}])(' || replace(kw, ' ', '\\s+') || ')([^\\p{{L}}\\p{{N}}])', '\\1' || chr(1) || '\\2\\3', 'g'), '  ', ' ')), chr(1)) AS parts
  FROM q_clauses, (SELECT keyword, {norm_words('keyword', None)} AS kw FROM q_keywords) WHERE contains(t, split_part(kw, ' ', 1)))""",
)
cte(
    "q_keyword_requests",
    "SELECT conv_id, turn, clause, keyword, action FROM (" + bound(
        "(SELECT conv_id, turn, clause, keyword, replace(array_to_string(parts[1:i], ''), chr(2), '') AS prefix FROM q_keyword_prefixed)", "")
    + ")",
)
cte(
    "q_evidence",
    """SELECT DISTINCT * FROM (
SELECT conv_id, turn, cluster, weight, 'lexicon' AS source, span FROM q_matches
UNION ALL SELECT conv_id, turn, cluster, weight, 'context', rule FROM q_contextual
UNION ALL SELECT conv_id, turn, cluster, weight, 'frame', object_text FROM q_frame_evidence
UNION ALL SELECT conv_id, turn, 'identity_probing', 45, 'keyword', keyword FROM q_keyword_requests)""",
)
cte("q_clusters", "SELECT conv_id, turn, cluster, max(weight) AS weight FROM q_evidence GROUP BY ALL")
