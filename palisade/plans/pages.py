"""Queries over hosts, pages and forms."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.dims import hosts as H
from palisade.operators import pages as P
from palisade.oracle.sql import cte, lit, values
from palisade.oracle.text import host as host_sql
from palisade.plans.corpus_text import message_urls
from palisade.plans.registry import query
from palisade.sources import forms as FS
from palisade.sources.planted import messages, watchlist
from palisade.sources.tables import stored, table

# What a reader of the templates finds: (k, field number, kind of field, hiding technique).
TRUTH = [
    (0, 0, "CARD_NUMBER", None), (0, 1, "CVV", None), (1, 0, None, None), (1, 1, "CARD_NUMBER", "OPACITY_ZERO"), (2, 0, "CARD_EXPIRY", None),
    (3, 0, None, None), (4, 0, "PASSWORD", None), (5, 0, None, None), (5, 1, None, None), (6, 0, None, None), (6, 1, None, None),
    (7, 0, None, None), (7, 1, None, "TYPE_HIDDEN"), (8, 0, "PASSWORD", "OFFSCREEN"), (9, 0, "CVV", "VISUALLY_HIDDEN"), (9, 1, "CARD_EXPIRY", None),
    (10, 0, None, None), (10, 1, None, "TRANSFORM_CLOAK"), (11, 0, None, None), (11, 1, None, "DISPLAY_NONE"), (11, 2, "CVV", "TYPE_HIDDEN"),
]
# (k, card, cvv, password, filled inputs)
FILLED = [(0, True, True, False, 2), (1, False, False, False, 1), (2, False, False, False, 1), (3, False, False, False, 0), (4, False, False, True, 1),
          (5, False, False, False, 0), (6, False, False, False, 1), (7, False, False, False, 1), (8, False, False, False, 0), (9, False, False, False, 0),
          (10, False, True, False, 1), (11, True, True, False, 3)]
cte("q_templates", values([(k, a, t, tm) for k, a, t, tm, _ in FS.TEMPLATES], "k, action, form_text, timer_text"))
cte("q_template_fields", values(FS.field_rows(), FS.FIELD_COLUMNS))
cte("q_truth", values(TRUTH, "k, field_no, field_type, cloak"))
cte("q_filled", values(FILLED, "k, filled_card, filled_cvv, filled_password, n_filled"))
_SITE = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
cte(
    "q_forms",
    f"""SELECT page_id, url, 0 AS form_no, k, replace(action, '{{site}}', {_SITE}) AS action, form_text, timer_text, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS page_host
FROM pages JOIN q_templates ON k = page_id % {FS.EVERY} WHERE contains(html, '</body>')""",
)
cte(
    "q_fields",
    """SELECT f.page_id, f.url, f.form_no, f.k, f.page_host, t.field_no, tag, type, name, autocomplete, placeholder, label, u.field_type, u.cloak,
  replace(value, '{value}', CAST(3000000000 + (page_id * 7919) % 999999937 AS VARCHAR)) AS value
FROM q_forms f JOIN q_template_fields t USING (k) JOIN q_truth u ON u.k = t.k AND u.field_no = t.field_no""",
)
_flat = [(d, d in H.GATEWAYS, d in H.WHITELIST, d in H.MONITORED, d in H.USER_ALLOWED) for d in sorted({*H.GATEWAYS, *H.WHITELIST, *H.MONITORED, *H.USER_ALLOWED})]
cte("q_domains", values(_flat, "domain, is_gateway, is_whitelist, is_monitored, is_user_allowed"))


def classified(source: str) -> str:
    """source has a column host."""
    return f"""SELECT *, is_user_allowed OR (NOT is_monitored AND (is_whitelist OR is_gateway)) AS is_immune FROM (
  SELECT host, coalesce(bool_or(is_gateway), FALSE) AS is_gateway, coalesce(bool_or(is_whitelist), FALSE) OR host = 'gov.ua' OR host LIKE '%.gov.ua' AS is_whitelist,
    coalesce(bool_or(is_monitored), FALSE) AS is_monitored, coalesce(bool_or(is_user_allowed), FALSE) AS is_user_allowed
  FROM (SELECT DISTINCT host FROM {source}) LEFT JOIN q_domains ON host = domain OR ends_with(host, '.' || domain) GROUP BY host)"""


FORMS: dict[tuple, DataFrame] = {}


def version(spark, path: str) -> tuple:
    """The files of a table with their times and sizes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return tuple(sorted((f.getPath().toString(), f.getModificationTime(), f.getLen()) for f in found))


def forms(spark, folder) -> DataFrame:
    """The narrow table of forms. A page is parsed once per application as long as the files of the table are the same; all detectors read the stored table."""
    key = (spark.sparkContext.applicationId, version(spark, f"{folder}/pages.parquet"))
    if key not in FORMS:
        FORMS[key] = stored(FS.extract_forms(FS.planted_pages(spark, folder)))
    return FORMS[key]


def all_urls(spark, folder):
    pages = FS.planted_pages(spark, folder).select(F.lit("page").alias("origin"), "url")
    actions = forms(spark, folder).filter(F.col("action").rlike("^https?://.")).select(F.lit("form").alias("origin"), F.col("action").alias("url"))
    texts = message_urls(messages(spark, folder)).select(F.lit("message").alias("origin"), "url")
    return pages.unionByName(actions).unionByName(texts)


cte(
    "q_all_hosts",
    f"""SELECT origin, {host_sql('url')} AS host FROM (SELECT 'page' AS origin, url FROM pages UNION ALL
  SELECT 'form', action FROM q_forms WHERE regexp_matches(action, '^https?://.') UNION ALL SELECT 'message', url FROM q_urls)""",
)


@query("normalize_hosts", "SELECT host, origin, count(*) AS n FROM q_all_hosts GROUP BY ALL")
def normalize_hosts(spark, folder):
    return P.host_report(all_urls(spark, folder))


@query("classify_hosts", classified("q_all_hosts"))
def classify_hosts(spark, folder):
    from palisade.functions.text import host_of

    return P.classify_hosts(all_urls(spark, folder).select(host_of(F.col("url")).alias("host")))


@query(
    "extract_forms",
    "SELECT page_id, form_no, action, form_n AS n_fields, timer_text FROM q_forms JOIN (SELECT k, count(*) AS form_n FROM q_template_fields GROUP BY k) USING (k)",
)
def extract_forms(spark, folder):
    return forms(spark, folder).select("page_id", "form_no", "action", F.size("fields").cast("bigint").alias("n_fields"), "timer_text")


@query("field_sensitivity", "SELECT page_id, form_no, field_no, name, field_type FROM q_fields")
def field_sensitivity(spark, folder):
    return P.with_sensitivity(P.field_rows(forms(spark, folder))).select("page_id", "form_no", "field_no", "name", "field_type")


@query("field_cloaking", "SELECT page_id, form_no, field_no, cloak FROM q_fields WHERE cloak IS NOT NULL")
def field_cloaking(spark, folder):
    return P.with_cloaking(P.field_rows(forms(spark, folder))).filter("cloak IS NOT NULL").select("page_id", "form_no", "field_no", "cloak")


cte(
    "q_traps",
    """SELECT page_id, form_no, count(*) AS n_hidden, string_agg(DISTINCT field_type, ',' ORDER BY field_type) AS types,
  CASE WHEN bool_or(field_type <> 'PASSWORD') THEN 'AUTOFILL_CARD_TRAP' ELSE 'AUTOFILL_PASSWORD_TRAP' END AS trap, 60 AS score, 'CRITICAL' AS severity
FROM q_fields WHERE field_type IS NOT NULL AND cloak IS NOT NULL GROUP BY page_id, form_no""",
)


@query("autofill_traps", "SELECT * FROM q_traps")
def autofill_traps(spark, folder):
    return P.autofill_traps(P.with_cloaking(P.with_sensitivity(P.field_rows(forms(spark, folder)))))


_camel = "regexp_replace(name, '([a-z\\d])([A-Z])', '\\1 \\2', 'g')"
cte(
    "q_field_words",
    f"SELECT *, lower(trim(concat_ws(' ', name, {_camel}, name, {_camel}, placeholder, autocomplete, '', label))) AS d FROM q_fields WHERE tag <> 'select'",
)
cte("q_keyword_dim", values([(i, c, w.lower()) for i, (c, ws) in enumerate(H.FIELD_KEYWORDS) for w in ws], "ord, category, word"))
cte(
    "q_label_hits",
    """SELECT page_id, form_no, field_no, arg_min(category, ord) AS category FROM q_field_words JOIN q_keyword_dim ON contains(d, word) GROUP BY ALL""",
)


@query(
    "field_keyword_hits",
    "SELECT page_id, form_no, field_no, category, CASE WHEN category IN ('MOTHER_MAIDEN_NAME', 'SECRET_WORD') THEN 'A' ELSE 'B' END AS tier FROM q_label_hits",
)
def field_keyword_hits(spark, folder):
    f = P.field_rows(forms(spark, folder)).filter("tag <> 'select'").withColumn("category", P.template_category(P.descriptor()))
    return f.filter("category IS NOT NULL").select("page_id", "form_no", "field_no", "category", F.when(F.col("category").isin(P.TIER_A), "A").otherwise("B").alias("tier"))


@query(
    "field_requests",
    f"""SELECT * FROM (SELECT page_id, form_no, field_no, CASE WHEN category IS NOT NULL THEN 'ITEM:' || category WHEN regexp_matches(d, {lit(P.CVV_FIELD)}) THEN 'PAYMENT_CVV'
  WHEN regexp_matches(d, {lit(P.PIN_FIELD)}) THEN 'PAYMENT_PIN' WHEN regexp_matches(d, {lit(P.EXP_FIELD)}) THEN 'PAYMENT_EXPIRY' END AS asked,
  coalesce(category IN ('MOTHER_MAIDEN_NAME', 'SECRET_WORD'), FALSE) OR (category IS NULL AND regexp_matches(d, {lit(P.CVV_FIELD + '|' + P.PIN_FIELD)})) AS tier_a
FROM q_field_words LEFT JOIN q_label_hits USING (page_id, form_no, field_no)) WHERE asked IS NOT NULL""",
)
def field_requests(spark, folder):
    return P.field_requests(P.field_rows(P.with_host_flags(forms(spark, folder))))


cte(
    "q_hosted",
    """SELECT *, CASE WHEN trim(action) IN ('', '#') OR action LIKE 'javascript:%' THEN page_host
  WHEN regexp_matches(action, '^(https?:)?//') THEN nullif(lower(regexp_extract(action, '^(?:https?:)?//([^/?#:]*)', 1)), '') ELSE page_host END AS action_host FROM q_forms""",
)
cte("q_form_hosts", classified("(SELECT page_host AS host FROM q_hosted UNION SELECT action_host FROM q_hosted WHERE action_host IS NOT NULL)"))
_base = lambda x: f"array_to_string(string_split({x}, '.')[-2:], '.')"
cte(
    "q_mismatch",
    f"""SELECT page_id, form_no, page_host, action_host, verdict, CASE verdict WHEN 'foreign' THEN 45 WHEN 'malformed' THEN 20 WHEN 'related' THEN 5 ELSE 0 END AS mismatch_score,
  verdict IN ('foreign', 'malformed') AS mismatch_triggered FROM (SELECT f.*, CASE WHEN action_host IS NULL THEN 'malformed' WHEN action_host = page_host THEN 'same'
    WHEN h.is_gateway THEN 'gateway' WHEN {_base('action_host')} = {_base('page_host')} THEN 'related' ELSE 'foreign' END AS verdict FROM q_hosted f LEFT JOIN q_form_hosts h ON h.host = action_host)""",
)


@query("action_mismatch", "SELECT * FROM q_mismatch")
def action_mismatch(spark, folder):
    m = P.action_mismatch(P.with_host_flags(forms(spark, folder)))
    return m.select("page_id", "form_no", "page_host", "action_host", "verdict", "mismatch_score", "mismatch_triggered")


cte("q_urgency_dim", values(H.URGENCY, "pattern, tag"))
cte(
    "q_urgency",
    f"""SELECT page_id, form_no, has_timer, coalesce(tags, '') AS tags, CASE WHEN has_timer OR tags IS NOT NULL THEN 20 ELSE 0 END AS score FROM (
  SELECT page_id, form_no, regexp_matches(lower(timer_text), {lit(P.TIMER)}) OR regexp_matches(lower(timer_text), {lit(P.TEXT_TIME)}) OR regexp_matches(lower(form_text || ' ' || timer_text), {lit(P.NEAR_TIME)}) AS has_timer,
    (SELECT string_agg(tag, ',' ORDER BY tag) FROM q_urgency_dim WHERE regexp_matches(lower(form_text || ' ' || timer_text), pattern)) AS tags FROM q_forms)""",
)


@query("urgency_patterns", "SELECT * FROM q_urgency")
def urgency_patterns(spark, folder):
    return P.urgency(forms(spark, folder))


cte(
    "q_fill",
    """SELECT page_id, form_no, filled_card, filled_cvv, filled_password, n_filled, filled_card OR filled_cvv OR filled_password AS any_sensitive, n_filled = 0 AS is_empty
FROM q_forms JOIN q_filled USING (k)""",
)


@query("form_fill_state", "SELECT * FROM q_fill")
def form_fill_state(spark, folder):
    return P.fill_state(P.with_sensitivity(P.field_rows(forms(spark, folder))))


cte(
    "q_wl_hits",
    """SELECT page_id, form_no, field_no, category, max(match) AS match, CASE WHEN category IN ('MOTHER_MAIDEN_NAME', 'SECRET_WORD') THEN 'A' ELSE 'B' END AS tier FROM (
  SELECT page_id, form_no, field_no, category, 'FIELD_LABEL_MATCH' AS match FROM q_label_hits
  UNION ALL SELECT page_id, form_no, field_no, category, 'VALUE_MATCH' FROM q_fields JOIN q_watchlist ON lower(trim(value)) = lower(trim(real_value)) AND length(trim(value)) >= 2 AND enabled WHERE tag <> 'select')
GROUP BY ALL""",
)
cte(
    "q_wl_triggers",
    """SELECT page_id, form_no, bool_or(match = 'VALUE_MATCH') AS value_leak, CASE WHEN bool_or(match = 'VALUE_MATCH' OR tier = 'A') THEN 45 WHEN count(*) FILTER (WHERE tier = 'B') >= 2 THEN 35 ELSE 15 END AS score,
  CASE WHEN bool_or(match = 'VALUE_MATCH' OR tier = 'A') THEN 'CRITICAL' WHEN count(*) FILTER (WHERE tier = 'B') >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM q_wl_hits JOIN q_hosted USING (page_id, form_no) JOIN q_form_hosts ON host = page_host WHERE NOT is_immune GROUP BY page_id, form_no""",
)


def items(spark, folder):
    return watchlist(spark, folder).filter("enabled")


@query("form_watchlist_triggers", "SELECT * FROM q_wl_triggers")
def form_watchlist_triggers(spark, folder):
    f = P.with_host_flags(forms(spark, folder))
    return P.watchlist_triggers(P.watchlist_field_hits(P.field_rows(f), items(spark, folder)), f)


RISK_INPUT = """SELECT event_id, CAST(value AS INT) AS base, CASE WHEN event_id % 4 = 0 THEN 35 ELSE 0 END AS bonus,
  CASE event_id % 3 WHEN 0 THEN 'submit' WHEN 1 THEN 'paste' ELSE 'view' END AS action, event_id % 5 = 0 AS sensitive, event_id % 5 = 1 AS empty FROM {lures}"""


@query(
    "risk_score",
    f"""SELECT event_id, score, CASE WHEN score >= 76 THEN 'CRITICAL' WHEN score >= 51 THEN 'HIGH' WHEN score >= 21 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (
  SELECT event_id, greatest(0, least(100, CASE WHEN action = 'submit' AND sensitive THEN s + 35 WHEN action = 'submit' AND empty THEN least(s, 30) WHEN action = 'submit' THEN least(s, 45)
    WHEN action = 'paste' AND sensitive THEN s + 20 ELSE s END)) AS score FROM (SELECT *, base + bonus AS s FROM ({RISK_INPUT.format(lures='q_lures').replace('CAST(value AS INT)', 'CAST(trunc(value) AS INT)')})))""",
)
def risk_score(spark, folder):
    from palisade.sources.scored import lures

    r = spark.sql(RISK_INPUT.format(lures="{l}"), l=lures(spark, folder))
    s = P.risk_score(*[F.col(c) for c in ("base", "bonus", "action", "sensitive", "empty")])
    return r.select("event_id", s.alias("score"), P.risk_level(s).alias("level"))


VISITED = 250  # planted: a visit opens the pages whose number leaves the same rest as that of its event


def tainted_pages(spark, folder):
    """Pages that a user opened under a live lure of theirs: visits meet `tainted_context` by user and time."""
    from palisade.operators.stitching import tainted_context
    from palisade.sources.scored import lures

    opened = tainted_context(lures(spark, folder)).select((F.col("event_id") % VISITED).alias("_opened")).distinct()
    pages = table(spark, folder, "pages").select("page_id")
    return pages.join(opened, F.col("page_id") % VISITED == F.col("_opened"), "left_semi")


cte(
    "q_form_triggers",
    f"""SELECT page_id, form_no, 'form_action_mismatch' AS trigger, mismatch_score AS contribution FROM q_mismatch WHERE mismatch_triggered
UNION ALL SELECT page_id, form_no, 'hidden_sensitive_inputs', 60 FROM q_traps UNION ALL SELECT page_id, form_no, 'card_number', 40 FROM q_fill WHERE filled_card
UNION ALL SELECT page_id, form_no, 'cvv_code', 40 FROM q_fill WHERE filled_cvv UNION ALL SELECT page_id, form_no, 'urgency', 20 FROM q_urgency WHERE score > 0
UNION ALL SELECT page_id, form_no, 'watchlist_exposure', score FROM q_wl_triggers
UNION ALL SELECT page_id, form_no, 'active_context', 35 FROM q_forms JOIN q_form_hosts ON host = page_host WHERE page_id % {VISITED} IN (SELECT event_id % {VISITED} FROM q_tainted) AND NOT is_whitelist AND NOT is_user_allowed""",
)
cte(
    "q_risk",
    """SELECT *, CASE WHEN score >= 76 THEN 'CRITICAL' WHEN score >= 51 THEN 'HIGH' WHEN score >= 21 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (
  SELECT *, greatest(0, least(100, CASE WHEN NOT is_empty AND (filled_cvv OR filled_password OR v) THEN s + 35 WHEN is_empty THEN least(s, 30) ELSE least(s, 45) END)) AS score FROM (
    SELECT h.page_id, h.form_no, h.page_host, h.action_host, f.is_empty, f.filled_cvv, f.filled_password, coalesce(w.value_leak, FALSE) AS v, f.any_sensitive OR coalesce(w.value_leak, FALSE) AS any_sensitive,
      coalesce(t.technical, 0) AS technical, coalesce(t.ctx, FALSE) AS context_active, coalesce(t.technical, 0) + CASE WHEN t.ctx THEN 35 ELSE 0 END AS s
    FROM q_hosted h JOIN q_fill f USING (page_id, form_no) LEFT JOIN q_wl_triggers w USING (page_id, form_no)
    LEFT JOIN (SELECT page_id, form_no, sum(contribution) AS technical, bool_or(trigger = 'active_context') AS ctx FROM q_form_triggers GROUP BY ALL) t USING (page_id, form_no)))""",
)


def risk(spark, folder):
    return P.form_risk(forms(spark, folder), items(spark, folder), tainted_pages(spark, folder))


@query("form_risk", "SELECT page_id, form_no, score, level, technical, context_active, any_sensitive, is_empty FROM q_risk")
def form_risk(spark, folder):
    return risk(spark, folder).select("page_id", "form_no", "score", "level", "technical", "context_active", "any_sensitive", "is_empty")


@query(
    "form_block_decision",
    """SELECT r.page_id, r.form_no, score, level, NOT is_empty AND NOT (coalesce(a.is_user_allowed, FALSE) OR p.is_user_allowed OR coalesce(a.is_gateway, FALSE)
  OR coalesce(NOT a.is_monitored AND a.is_whitelist, FALSE) OR (NOT p.is_monitored AND p.is_whitelist)) AND (level = 'CRITICAL' OR (level = 'HIGH' AND any_sensitive)) AS block
FROM q_risk r JOIN q_form_hosts p ON p.host = r.page_host LEFT JOIN q_form_hosts a ON a.host = r.action_host""",
)
def form_block_decision(spark, folder):
    return P.block_decision(risk(spark, folder))


@query(
    "form_asset_gate",
    f"""SELECT page_id, form_no, reason, reason <> 'none' AS block FROM (SELECT page_id, form_no, CASE WHEN trusted THEN 'none' WHEN v THEN 'listed_value' WHEN code THEN 'cvv' WHEN dated THEN 'expiry' ELSE 'none' END AS reason FROM (
  SELECT f.page_id, f.form_no, bool_or(coalesce(a.is_gateway OR a.is_user_allowed OR a.is_whitelist, FALSE)) AS trusted,
    bool_or(regexp_matches(lower(concat_ws(' ', name, placeholder, autocomplete)), '(cvv|cvc|csc|код\\s*безпеки|код\\s*картки)') AND length(regexp_replace(value, '\\D', '', 'g')) IN (3, 4)) AS code,
    bool_or(regexp_matches(lower(concat_ws(' ', name, placeholder, autocomplete)), '(exp|термін|діє)') AND regexp_matches(trim(value), {lit(P.EXP_VALUE)})) AS dated,
    bool_or(w.field_no IS NOT NULL) AS v
  FROM q_fields f JOIN q_hosted h USING (page_id, form_no) LEFT JOIN q_form_hosts a ON a.host = h.action_host
  LEFT JOIN (SELECT DISTINCT page_id, form_no, field_no FROM q_wl_hits WHERE match = 'VALUE_MATCH') w ON w.page_id = f.page_id AND w.form_no = f.form_no AND w.field_no = f.field_no
  WHERE tag <> 'select' GROUP BY f.page_id, f.form_no))""",
)
def form_asset_gate(spark, folder):
    return P.asset_gate(forms(spark, folder), items(spark, folder))


@query(
    "risk_breakdown",
    """SELECT page_id, form_no, t AS technical, least(100, CAST(round(t / 60 * 100) AS INT)) AS technical_pct, e AS contextual, CASE WHEN e > 0 THEN 100 ELSE 0 END AS contextual_pct,
  35 AS action, 78 AS action_pct, 'R_tech=' || t || ', C_env=' || e || ', A_user=35, total=' || score AS formula
FROM (SELECT *, CASE WHEN context_active THEN 35 ELSE 0 END AS e, technical - CASE WHEN context_active THEN 35 ELSE 0 END AS t FROM q_risk)""",
)
def risk_breakdown(spark, folder):
    return P.breakdown(risk(spark, folder))


@query(
    "scenario_label",
    """SELECT r.page_id, r.form_no, CASE WHEN w AND NOT c THEN 'IDENTITY_HARVESTING' WHEN h THEN 'AUTOFILL_TRAP' WHEN context_active THEN 'DELIVERY_SCAM' ELSE 'UNTRUSTED_GATEWAY' END AS scenario
FROM q_risk r LEFT JOIN (SELECT page_id, form_no, bool_or(trigger = 'watchlist_exposure') AS w, bool_or(trigger IN ('card_number', 'cvv_code')) AS c, bool_or(trigger = 'hidden_sensitive_inputs') AS h
  FROM q_form_triggers GROUP BY ALL) t USING (page_id, form_no)""",
)
def scenario_label(spark, folder):
    return P.scenario_label(P.form_triggers(forms(spark, folder), items(spark, folder), tainted_pages(spark, folder)), risk(spark, folder))


@query(
    "attack_chain",
    """SELECT page_id, form_no, chain, step_no, step, severity FROM q_risk JOIN (VALUES ('stitched', 1, 'lure', 'MEDIUM'), ('stitched', 2, 'external_link', 'HIGH'), ('stitched', 3, 'unlicensed_form', 'CRITICAL'),
  ('direct', 1, 'untrusted_host', 'MEDIUM'), ('direct', 2, 'data_collection', 'CRITICAL')) s(chain, step_no, step, severity) ON chain = CASE WHEN context_active THEN 'stitched' ELSE 'direct' END""",
)
def attack_chain(spark, folder):
    return P.attack_chain(risk(spark, folder))


@query("amounts_at_risk", "SELECT page_id, form_no, CAST(1500 AS DOUBLE) AS amount FROM q_fields WHERE name = 'amount'")
def amounts_at_risk(spark, folder):
    return P.amounts(P.field_rows(forms(spark, folder)))
