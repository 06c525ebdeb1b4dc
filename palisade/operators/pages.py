"""Hosts, forms and form risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.dims import hosts as H
from palisade.functions.text import host_of
from palisade.operators.assets import cards, luhn_ok
from palisade.operators.scan import union_all

FLAGS = ["is_gateway", "is_whitelist", "is_monitored", "is_user_allowed"]


def host_dim(spark: SparkSession) -> DataFrame:
    rows: dict[str, list[bool]] = {}
    for i, listed in enumerate((H.GATEWAYS, H.WHITELIST, H.MONITORED, H.USER_ALLOWED)):
        for d in listed:
            rows.setdefault(d, [False] * 4)[i] = True
    return spark.createDataFrame([(d, *f) for d, f in rows.items()], "domain string, " + ", ".join(f"{f} boolean" for f in FLAGS))


def suffixes(host: Column) -> Column:
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def classify_hosts(hosts: DataFrame) -> DataFrame:
    """hosts: host. Exact and sub-domain matches by an equi-join on all dot suffixes of the distinct hosts."""
    once = hosts.select("host").distinct()
    # The dimension is a fixed list of some seventy rows, hence safe to broadcast.
    hit = once.select("host", F.explode(suffixes(F.col("host"))).alias("domain")).join(F.broadcast(host_dim(once.sparkSession)), "domain", "left")
    flags = hit.groupBy("host").agg(*[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in FLAGS])
    gov = F.col("host").rlike(r"(?:^|\.)gov\.ua$")
    return flags.withColumn("is_whitelist", F.col("is_whitelist") | gov).withColumn(
        "is_immune", F.col("is_user_allowed") | (~F.col("is_monitored") & (F.col("is_whitelist") | F.col("is_gateway")))
    )


def page_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1))


def with_hosts(forms: DataFrame) -> DataFrame:
    """Add page_host, action_host (the page's own for local actions, null when it cannot be read)."""
    a = F.trim("action")
    local = (a == "") | (a == "#") | a.startswith("javascript:")
    absolute = F.regexp_extract(a, r"^(?:https?:)?//([^/?#:]*)", 1)
    is_abs = a.rlike(r"^(?:https?:)?//")
    target = F.when(local, F.col("page_host")).when(is_abs & (absolute == ""), F.lit(None)).when(is_abs, F.lower(absolute)).otherwise(F.col("page_host"))
    return forms.withColumn("page_host", page_host(F.col("url"))).withColumn("action_host", target)


def _flags_for(forms: DataFrame, column: str, prefix: str) -> DataFrame:
    flags = classify_hosts(forms.select(F.col(column).alias("host")).filter("host IS NOT NULL"))
    named = flags.select(F.col("host").alias(column), *[F.col(f).alias(prefix + f) for f in [*FLAGS, "is_immune"]])
    return forms.join(named, column, "left")


def with_host_flags(forms: DataFrame) -> DataFrame:
    return _flags_for(_flags_for(with_hosts(forms), "page_host", "page_"), "action_host", "action_")


def base_domain(host: Column) -> Column:
    p = F.split(host, r"\.")
    return F.array_join(F.slice(p, F.greatest(F.lit(1), F.size(p) - 1), F.lit(2)), ".")


def action_mismatch(forms: DataFrame) -> DataFrame:
    a, p = F.col("action_host"), F.col("page_host")
    verdict = (
        F.when(a.isNull(), "malformed").when(a == p, "same").when(F.col("action_is_gateway"), "gateway")
        .when(base_domain(a) == base_domain(p), "related").otherwise("foreign")
    )
    out = forms.withColumn("verdict", verdict)
    v = F.col("verdict")
    return out.withColumn("mismatch_score", F.when(v == "foreign", 45).when(v == "malformed", 20).when(v == "related", 5).otherwise(0)).withColumn(
        "mismatch_triggered", v.isin("foreign", "malformed")
    )


# ---- fields -------------------------------------------------------------------------------------------------------

def field_rows(forms: DataFrame) -> DataFrame:
    keep = [c for c in forms.columns if c != "fields"]
    return forms.select(*keep, F.explode("fields").alias("f")).select(*keep, "f.*")


# Fixed values.
NO_INPUT_TYPES = ["checkbox", "radio", "button", "submit", "reset", "file", "image", "range", "color", "search"]
SAFE_TOKEN = r"(?:^|[_\-.])(csrf|xsrf|_token|authenticity_token|csrfmiddlewaretoken|recaptcha|cf[-_]?turnstile|turnstile|timestamp|form_id|form_build_id|__viewstate|__requestverificationtoken)(?:$|[_\-.])"
GENERIC = ["type", "name", "id", "title", "query", "filter", "val", "value", "sort", "category", "status"]
CARD_RAW = r"(?:номер|nomer)[-_\s]*(?:карт|kart)|(?:^|[^a-z0-9])(?:card[-_]?num(?:ber)?|cc[-_]?num(?:ber)?|credit[-_]?card|debit[-_]?card)(?:$|[^a-z0-9])"
CVV_RAW = r"(?:код|kod)[-_\s]*(?:безпек|карт|bezpek)|(?:^|[^a-z0-9])(?:cc[-_]?csc|cvv2?|cvc2?|security[-_]?code)(?:$|[^a-z0-9])"
EXP_RAW = r"(?:термін|срок)[-_\s]*(?:дії|действ)|(?:cc[-_]?exp|card[-_]?exp(?:ir(?:y|ation))?|exp[-_]?(?:month|year|date))(?:$|[^a-z0-9])"
PASS_RAW = r"(?:парол|parol)"


def with_sensitivity(fields: DataFrame) -> DataFrame:
    """Add tokens and field_type (null for fields that ask for nothing sensitive)."""
    low = lambda c: F.lower(F.col(c))
    raw = F.concat_ws(" ", low("name"), low("id"), low("autocomplete"), low("placeholder"), low("aria_label"))
    df = fields.withColumn("raw", raw).withColumn("tokens", F.filter(F.split("raw", r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    t, r, auto, typ = F.col("tokens"), F.col("raw"), low("autocomplete"), low("type")
    has = lambda *w: F.arrays_overlap(t, F.array(*[F.lit(x) for x in w]))
    alone = F.size(t) == 1
    card = (
        (auto == "cc-number") | r.rlike(CARD_RAW) | (has("pan") & (alone | has("card", "cc", "primary", "account", "number", "num", "no")))
        | F.exists(t, lambda x: x.endswith("iban")) | (has("card", "cc") & has("number", "num", "no", "nbr", "digits"))
    )
    cvv = (
        auto.isin("cc-csc", "cc-cvv", "cc-cvc") | r.rlike(CVV_RAW) | has("cvv", "cvc", "csc", "cvv2", "cvc2", "cid")
        | (has("security") & has("code", "num", "number")) | (has("pin", "пин", "пін") & (alone | has("card", "code", "atm", "security", "код")))
    )
    exp = (
        auto.isin("cc-exp", "cc-exp-month", "cc-exp-year") | r.rlike(EXP_RAW) | has("expiry", "expiration")
        | (has("exp") & (alone | has("month", "year", "date", "card", "cc")))
    )
    pwd = (
        (typ == "password") | auto.isin("current-password", "new-password") | r.rlike(PASS_RAW) | has("password", "passwd", "pwd", "passcode")
        | (has("pass") & (alone | has("user", "confirm", "confirmation", "new", "current", "auth", "login")))
    )
    plain = (
        (F.size(t) > 0) & F.forall(t, lambda x: x.isin(H.PLAIN_WORDS + GENERIC)) & (typ != "password")
        & ~auto.isin("cc-number", "cc-csc", "cc-exp", "current-password", "new-password")
    )
    out = typ.isin(NO_INPUT_TYPES) | low("name").rlike(SAFE_TOKEN) | low("id").rlike(SAFE_TOKEN) | plain
    kind = (
        F.when(out, None).when(F.col("tag") == "select", F.when(exp, "CARD_EXPIRY")).when(card, "CARD_NUMBER").when(cvv, "CVV")
        .when(exp, "CARD_EXPIRY").when(pwd, "PASSWORD")
    )
    return df.withColumn("field_type", kind).drop("raw", "tokens")


TINY = r"^[0-3]px$"


def _technique(style: Column, cls: Column) -> Column:
    s = F.regexp_replace(F.lower(style), r"\s*([:;])\s*", "$1")
    get = lambda name: F.regexp_extract(s, rf"(?:^|;){name}:([^;]*)", 1)
    num = lambda name: F.regexp_extract(get(name), r"^-?[0-9.]+", 0).try_cast("double")
    tiny = get("width").rlike(TINY) & get("height").rlike(TINY)
    hidden_class = cls.rlike(r"(?:^|\s)(?:visually-hidden|sr-only)(?:\s|$)")
    tf, clip, path, flt = get("transform"), get("clip"), get("clip-path"), get("filter")
    return (
        F.when(get("display") == "none", "DISPLAY_NONE").when(get("visibility") == "hidden", "VISIBILITY_HIDDEN")
        .when(num("opacity") <= 0.05, "OPACITY_ZERO")
        .when(tf.contains("scale(0") | tf.contains("matrix(0") | tf.contains("-9999px") | tf.contains("-5000px"), "TRANSFORM_CLOAK")
        .when((num("left") < -500) | (num("top") < -500), "OFFSCREEN").when(num("text-indent") < -500, "TEXT_INDENT")
        .when(clip.contains("rect(0") | clip.contains("rect(1px, 1px, 1px, 1px)"), "CLIP_RECT")
        .when(path.contains("inset(50%)") | path.contains("circle(0") | path.contains("polygon(0"), "CLIP_PATH")
        .when((tiny | hidden_class) & ((get("overflow") == "hidden") | (clip != "") | get("width").rlike(TINY)), "VISUALLY_HIDDEN")
        .when((get("width") == "0px") | (get("height") == "0px") | (get("max-height") == "0px") | (get("max-width") == "0px"), "ZERO_DIMENSIONS")
        .when(get("font-size").isin("0px", "0"), "FONT_SIZE_ZERO").when(flt.contains("opacity(0"), "OPACITY_ZERO")
    )


def with_cloaking(fields: DataFrame) -> DataFrame:
    """First hiding technique on the field itself, else on an enclosing element (inline styles)."""
    own = _technique(F.col("style"), F.col("class"))
    above = _technique(F.col("outer_style"), F.lit(""))
    return fields.withColumn("cloak", F.when(F.lower("type") == "hidden", "TYPE_HIDDEN").otherwise(F.coalesce(own, above)))


def autofill_traps(fields: DataFrame) -> DataFrame:
    """fields with field_type and cloak: per form the hidden sensitive fields."""
    g = fields.filter("field_type IS NOT NULL AND cloak IS NOT NULL").groupBy("page_id", "form_no").agg(
        F.count("*").alias("n_hidden"), F.array_join(F.array_sort(F.collect_set("field_type")), ",").alias("types"),
        F.bool_or(F.col("field_type").isin("CARD_NUMBER", "CVV", "CARD_EXPIRY")).alias("_card"),
    )
    return g.select("page_id", "form_no", "n_hidden", "types", F.when(F.col("_card"), "AUTOFILL_CARD_TRAP").otherwise("AUTOFILL_PASSWORD_TRAP").alias("trap"),
                    F.lit(60).alias("score"), F.lit("CRITICAL").alias("severity"))


def descriptor() -> Column:
    camel = lambda c: F.regexp_replace(c, r"([a-z\d])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.concat_ws(" ", "name", camel("name"), "id", camel("id"), "placeholder", "autocomplete", "aria_label", "label")))


TIER_A = ["MOTHER_MAIDEN_NAME", "SECRET_WORD"]


def template_category(desc: Column) -> Column:
    """First built-in category one of whose words occurs in a field description."""
    out = F.lit(None).cast("string")
    for category, words in reversed(H.FIELD_KEYWORDS):
        test = F.lit(False)
        for w in words:
            test = test | desc.contains(w.lower())
        out = F.when(test, category).otherwise(out)
    return out


CVV_FIELD = r"(?:^|[^a-z0-9])(?:cvv|cvc|csc|cvv2|cvc2|cid)(?:$|[^a-z0-9])|код\s*безпеки|код\s*картки"
PIN_FIELD = r"(?:^|[^a-z0-9])(?:pin|pin[-_]?code)(?:$|[^a-z0-9])|пін[-_\s]*код|пин[-_\s]*код"
EXP_FIELD = r"(?:^|[^a-z0-9])(?:exp|expiry|exp[-_]?date|card[-_]?exp)(?:$|[^a-z0-9])|термін\s*дії|срок\s*действия"


def field_requests(fields: DataFrame) -> DataFrame:
    """What each input or text area asks for; fields carry page_is_gateway."""
    df = fields.filter("tag <> 'select'").withColumn("_d", descriptor())
    d, open_host = F.col("_d"), ~F.col("page_is_gateway")
    df = df.withColumn("_cat", template_category(d))
    asked = (
        F.when(F.col("_cat").isNotNull(), F.concat(F.lit("ITEM:"), "_cat")).when(open_host & d.rlike(CVV_FIELD), "PAYMENT_CVV")
        .when(open_host & d.rlike(PIN_FIELD), "PAYMENT_PIN").when(open_host & d.rlike(EXP_FIELD), "PAYMENT_EXPIRY")
    )
    tier_a = F.col("_cat").isin(TIER_A) | asked.isin("PAYMENT_CVV", "PAYMENT_PIN")
    return df.select("page_id", "form_no", "field_no", asked.alias("asked"), F.coalesce(tier_a, F.lit(False)).alias("tier_a")).filter("asked IS NOT NULL")


TIMER = r"(?:^|[^a-z0-9_])\d{1,2}:\d{2}(?::\d{2})?(?:[^a-z0-9_]|$)"
TEXT_TIME = r"(?:^|[^a-z0-9_])\d+\s*(?:сек(?:унд)?|хв(?:илин)?|sec(?:ond)?s?|min(?:ute)?s?)(?:[^a-z0-9_]|$)"
NEAR_TIME = r"(?:залишилось|час|таймер|термін|скасуванн[яі]|expires?|time)\D{0,40}(\d{1,2}:\d{2})"


def urgency(forms: DataFrame) -> DataFrame:
    text, timer = F.lower("form_text"), F.lower("timer_text")
    clock = timer.rlike(TIMER) | timer.rlike(TEXT_TIME) | text.rlike(NEAR_TIME)
    tags = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(tag)) for p, tag in H.URGENCY]))
    return forms.select("page_id", "form_no", clock.alias("has_timer"), F.array_join(F.array_sort(tags), ",").alias("tags")).withColumn(
        "score", F.when(F.col("has_timer") | (F.col("tags") != ""), 20).otherwise(0)
    )


CVV_IN_TEXT = r"(?:^|[^\p{L}\p{N}])(?:cvv|cvc|cvv2|cvc2|свв|свс|код\s*безпеки|код\s*безопасности|код\s*картки|код\s*карты|security\s*code|three\s*digits)[\s:=_-]*([0-9]{3,4})(?:$|[^\p{L}\p{N}])"


def fill_state(fields: DataFrame) -> DataFrame:
    v = F.trim("value")
    digits = F.regexp_replace(v, r"\D", "")
    filled = (F.length(v) > 0) & (F.col("tag") != "select")
    ft = F.coalesce("field_type", F.lit(""))
    pwd = filled & ((F.lower("type") == "password") | (ft == "PASSWORD"))
    cvv = filled & (((ft == "CVV") & (F.length(v) >= 2)) | F.lower(v).rlike(CVV_IN_TEXT))
    card = filled & ((F.size(cards(v)) > 0) | luhn_ok(digits) | ((ft == "CARD_NUMBER") & (F.length(digits) >= 12)))
    g = fields.groupBy("page_id", "form_no").agg(
        F.bool_or(card).alias("filled_card"), F.bool_or(cvv).alias("filled_cvv"), F.bool_or(pwd).alias("filled_password"),
        F.count_if(filled).alias("n_filled"),
    )
    return g.withColumn("any_sensitive", F.col("filled_card") | F.col("filled_cvv") | F.col("filled_password")).withColumn("is_empty", F.col("n_filled") == 0)


def watchlist_field_hits(fields: DataFrame, items: DataFrame) -> DataFrame:
    """Label and value hits per field: item category, kind of match and tier. Values join on their digits."""
    own = fields.filter("tag <> 'select'")
    label = own.withColumn("category", template_category(descriptor())).filter("category IS NOT NULL").select("page_id", "form_no", "field_no", "category", F.lit("FIELD_LABEL_MATCH").alias("match"))
    low = F.lower(F.trim("value"))
    keyed = own.filter(F.length(low) >= 2).select("page_id", "form_no", "field_no", low.alias("k"))
    real = items.select(F.lower(F.trim("real_value")).alias("k"), "category")
    value = keyed.join(real, "k").select("page_id", "form_no", "field_no", "category", F.lit("VALUE_MATCH").alias("match"))
    both = label.unionByName(value).groupBy("page_id", "form_no", "field_no", "category").agg(F.max("match").alias("match"))
    return both.withColumn("tier", F.when(F.col("category").isin(TIER_A), "A").otherwise("B"))


def watchlist_triggers(hits: DataFrame, forms: DataFrame) -> DataFrame:
    """forms: page_id, form_no, page_is_immune."""
    open_forms = forms.filter(~F.col("page_is_immune")).select("page_id", "form_no")
    g = hits.join(open_forms, ["page_id", "form_no"]).groupBy("page_id", "form_no").agg(
        F.bool_or(F.col("match") == "VALUE_MATCH").alias("value_leak"), F.bool_or(F.col("tier") == "A").alias("tier_a"), F.count_if(F.col("tier") == "B").alias("n_b")
    )
    hard = F.col("value_leak") | F.col("tier_a")
    return g.select("page_id", "form_no", "value_leak", F.when(hard, 45).when(F.col("n_b") >= 2, 35).otherwise(15).alias("score"),
                    F.when(hard, "CRITICAL").when(F.col("n_b") >= 2, "HIGH").otherwise("MEDIUM").alias("severity"))


def risk_level(score: Column) -> Column:
    return F.when(score >= 76, "CRITICAL").when(score >= 51, "HIGH").when(score >= 21, "MEDIUM").otherwise("LOW")


def risk_score(base: Column, bonus: Column, action: Column, sensitive: Column, empty: Column) -> Column:
    s = base + bonus
    acted = (
        F.when((action == "submit") & sensitive, s + 35).when((action == "submit") & empty, F.least(s, F.lit(30)))
        .when(action == "submit", F.least(s, F.lit(45))).when((action == "paste") & sensitive, s + 20).otherwise(s)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), acted))


def form_triggers(forms: DataFrame, items: DataFrame, tainted: DataFrame) -> DataFrame:
    """Triggers of all detectors, one row each. A detector is a function from forms or fields to trigger rows.

    forms as read from the pages; tainted: page_id of pages opened under a live lure.
    """
    hosted = action_mismatch(with_host_flags(forms))
    fields = with_cloaking(with_sensitivity(field_rows(hosted)))
    state = fill_state(fields)
    row = lambda df, name, score: df.select("page_id", "form_no", F.lit(name).alias("trigger"), (score if isinstance(score, Column) else F.lit(score)).cast("int").alias("contribution"))
    open_page = hosted.filter(~F.col("page_is_whitelist") & ~F.col("page_is_user_allowed"))
    parts = [
        row(hosted.filter("mismatch_triggered"), "form_action_mismatch", F.col("mismatch_score")),
        row(autofill_traps(fields), "hidden_sensitive_inputs", 60),
        row(state.filter("filled_card"), "card_number", 40), row(state.filter("filled_cvv"), "cvv_code", 40),
        row(urgency(hosted).filter("score > 0"), "urgency", 20),
        row(watchlist_triggers(watchlist_field_hits(fields, items), hosted), "watchlist_exposure", F.col("score")),
        row(open_page.join(tainted, "page_id", "left_semi"), "active_context", 35),
    ]
    return union_all(parts)


def form_risk(forms: DataFrame, items: DataFrame, tainted: DataFrame) -> DataFrame:
    hosted = with_host_flags(forms)
    fields = with_sensitivity(field_rows(hosted))
    state = fill_state(fields)
    value = watchlist_field_hits(fields, items).join(hosted.filter(~F.col("page_is_immune")).select("page_id", "form_no"), ["page_id", "form_no"]).filter(
        "match = 'VALUE_MATCH'"
    ).select("page_id", "form_no", F.lit(True).alias("_value")).distinct()
    totals = form_triggers(forms, items, tainted).groupBy("page_id", "form_no").agg(
        F.sum("contribution").alias("technical"), F.bool_or(F.col("trigger") == "active_context").alias("_ctx")
    )
    flags = ["page_id", "form_no", "page_host", "action_host"] + [f"{s}_{f}" for s in ("page", "action") for f in FLAGS]
    j = hosted.select(*flags).join(state, ["page_id", "form_no"], "left").join(value, ["page_id", "form_no"], "left").join(totals, ["page_id", "form_no"], "left")
    val = F.coalesce("_value", F.lit(False))
    empty = F.coalesce("is_empty", F.lit(True))
    sensitive = ~empty & (F.coalesce("filled_cvv", F.lit(False)) | F.coalesce("filled_password", F.lit(False)) | val)
    ctx = F.coalesce("_ctx", F.lit(False))
    score = risk_score(F.coalesce("technical", F.lit(0)), F.when(ctx, 35).otherwise(0), F.lit("submit"), sensitive, empty)
    return j.select(
        *flags, score.cast("int").alias("score"), risk_level(score).alias("level"), F.coalesce("technical", F.lit(0)).cast("int").alias("technical"), ctx.alias("context_active"),
        (F.coalesce("any_sensitive", F.lit(False)) | val).alias("any_sensitive"), empty.alias("is_empty"),
    )


def block_decision(risk: DataFrame) -> DataFrame:
    c = lambda n: F.coalesce(F.col(n), F.lit(False))
    trusted = (
        c("action_is_user_allowed") | c("page_is_user_allowed") | c("action_is_gateway")
        | (~c("action_is_monitored") & c("action_is_whitelist")) | (~c("page_is_monitored") & c("page_is_whitelist"))
    )
    hot = (F.col("level") == "CRITICAL") | ((F.col("level") == "HIGH") & F.col("any_sensitive"))
    return risk.select("page_id", "form_no", "score", "level", (~F.col("is_empty") & ~trusted & hot).alias("block"))


EXP_VALUE = r"^[0-1]?[0-9][/.-][2-3][0-9]$"


def asset_gate(forms: DataFrame, items: DataFrame) -> DataFrame:
    """Selective gate per form on hosts that are not trusted: listed value, CVV in a CVV field, MM/YY in an expiry field."""
    hosted = with_host_flags(forms)
    fields = field_rows(hosted).filter("tag <> 'select'")
    d = F.lower(F.concat_ws(" ", "name", "id", "placeholder", "autocomplete", "aria_label"))
    v = F.trim("value")
    n = F.length(F.regexp_replace(v, r"\D", ""))
    code = d.rlike(r"(cvv|cvc|csc|код\s*безпеки|код\s*картки)") & n.isin(3, 4)
    dated = d.rlike(r"(exp|термін|діє)") & v.rlike(EXP_VALUE)
    trusted = F.coalesce(F.col("action_is_gateway") | F.col("action_is_user_allowed") | F.col("action_is_whitelist"), F.lit(False))
    found = fields.groupBy("page_id", "form_no").agg(F.bool_or(code).alias("_code"), F.bool_or(dated).alias("_dated"), F.first(trusted).alias("_t"))
    value = watchlist_field_hits(fields, items).filter("match = 'VALUE_MATCH'").select("page_id", "form_no", F.lit(True).alias("_v")).distinct()
    j = found.join(value, ["page_id", "form_no"], "left")
    why = F.when(F.col("_t"), "none").when(F.col("_v"), "listed_value").when(F.col("_code"), "cvv").when(F.col("_dated"), "expiry").otherwise("none")
    return j.select("page_id", "form_no", why.alias("reason"), (why != "none").alias("block"))


def breakdown(risk: DataFrame) -> DataFrame:
    tech = F.col("technical") - F.when(F.col("context_active"), 35).otherwise(0)
    env = F.when(F.col("context_active"), 35).otherwise(0)
    pct = lambda x, top: F.least(F.lit(100), F.round(x / top * 100).cast("int"))
    return risk.select(
        "page_id", "form_no", tech.alias("technical"), pct(tech, 60).alias("technical_pct"), env.alias("contextual"), pct(env, 35).alias("contextual_pct"),
        F.lit(35).alias("action"), pct(F.lit(35), 45).alias("action_pct"),
        F.concat(F.lit("R_tech="), tech.cast("string"), F.lit(", C_env="), env.cast("string"), F.lit(", A_user=35, total="), F.col("score").cast("string")).alias("formula"),
    )


def scenario_label(triggers: DataFrame, risk: DataFrame) -> DataFrame:
    has = lambda n: F.coalesce(F.bool_or(F.col("trigger") == n), F.lit(False))
    g = triggers.groupBy("page_id", "form_no").agg(has("watchlist_exposure").alias("_w"), has("card_number").alias("_c"), has("cvv_code").alias("_k"), has("hidden_sensitive_inputs").alias("_h"))
    j = risk.select("page_id", "form_no", "context_active").join(g, ["page_id", "form_no"], "left")
    c = lambda n: F.coalesce(F.col(n), F.lit(False))
    return j.select("page_id", "form_no", F.when(c("_w") & ~c("_c") & ~c("_k"), "IDENTITY_HARVESTING").when(c("_h"), "AUTOFILL_TRAP")
                    .when(F.col("context_active"), "DELIVERY_SCAM").otherwise("UNTRUSTED_GATEWAY").alias("scenario"))


STEPS = {
    "stitched": [("lure", "MEDIUM"), ("external_link", "HIGH"), ("unlicensed_form", "CRITICAL")],
    "direct": [("untrusted_host", "MEDIUM"), ("data_collection", "CRITICAL")],
}


def attack_chain(risk: DataFrame) -> DataFrame:
    steps = lambda kind: F.array(*[F.struct(F.lit(s).alias("step"), F.lit(v).alias("severity")) for s, v in STEPS[kind]])
    kind = F.when(F.col("context_active"), "stitched").otherwise("direct")
    chain = F.when(F.col("context_active"), steps("stitched")).otherwise(steps("direct"))
    return risk.select("page_id", "form_no", kind.alias("chain"), F.posexplode(chain).alias("i", "s")).select(
        "page_id", "form_no", "chain", (F.col("i") + 1).alias("step_no"), "s.step", "s.severity"
    )


AMOUNT = r"(\d[\d\s,.]*)\s*(?:грн|uah|₴)"


def amounts(fields: DataFrame) -> DataFrame:
    text = F.regexp_extract(F.lower("form_text"), AMOUNT, 1)
    stated = F.regexp_replace(F.regexp_replace(text, r"\s", ""), ",", ".").try_cast("double")
    named = F.lower(F.concat_ws(" ", "name", "id")).rlike("amount|sum|price")
    own = F.when(named, F.trim("value").try_cast("double"))
    return fields.groupBy("page_id", "form_no").agg(F.max(stated).alias("_t"), F.max(own).alias("_f")).select(
        "page_id", "form_no", F.coalesce("_t", F.when(F.col("_f") > 0, F.col("_f"))).alias("amount")
    ).filter("amount IS NOT NULL")


def exfiltration(sent: DataFrame, value_hits: DataFrame) -> DataFrame:
    """sent: doc_id, text, host of outbound requests; a body with a listed value to an unknown host is critical."""
    known = classify_hosts(sent.select("host")).filter("is_whitelist OR is_gateway OR is_user_allowed").select("host")
    out = sent.filter(F.length("text") >= 5).select("doc_id", "host").join(known, "host", "left_anti")
    n = value_hits.groupBy("doc_id").agg(F.count("*").alias("n_items"))
    return out.join(n, "doc_id").select("doc_id", "host", "n_items", F.lit(95).alias("score"), F.lit("CRITICAL").alias("level"))


def host_report(urls: DataFrame) -> DataFrame:
    """urls: origin, url."""
    return urls.select("origin", host_of(F.col("url")).alias("host")).groupBy("host", "origin").agg(F.count("*").alias("n"))
