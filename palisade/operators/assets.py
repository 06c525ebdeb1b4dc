"""Cards, codes and other secrets in texts, and their leaks over a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.scan import running, turn_bucket

# Fixed values. Texts are lower-cased first; \s stays ASCII.
CARD_RUN = r"(?:\d[ -]*?){13,19}"
CVV = r"(?:^|[^\p{L}\p{N}])(?:cvv|cvc|cvv2|cvc2|свв|свс|код\s*безпеки|код\s*безопасности|код\s*картки|код\s*карты|код\s*перевірки|код\s*проверки|три\s*цифри\s*(?:ззаду|на\s*звороті)|три\s*цифры\s*(?:сзади|на\s*обороте)|код\s*ззаду|код\s*сзади|security\s*code|three\s*digits)[\s\p{L}:=_-]{0,15}?([0-9]{3,4})(?:$|[^\p{L}\p{N}])"
EXPIRY = r"(?:діє\s*до|термін(?:\s*дії)?|действует\s*до|срок(?:\s*действия)?|exp(?:ir(?:y|ation))?|valid\s*thru|valid\s*until)[\s:=_-]*([0-1][0-9][/.-](?:20)?[2-3][0-9])"
EXPIRY_ALONE = r"(?:^|\s)([0-1][0-9]/[2-3][0-9])(?:\s|$|[,.])"
OTP = r"(?:код\s*з\s*смс|код\s*из\s*смс|пароль\s*підтвердження|пароль\s*подтверждения|код\s*підтвердження|код\s*подтверждения|sms\s*code|otp\s*code|otp|смс\s*код|confirmation\s*code|verification\s*code)[\s\p{L}:=_-]{0,25}?([0-9]{4,8})(?:$|[^\p{L}\p{N}])"
GPS = r"(?:^|[^a-z0-9_])([3-7]\d\.\d{4,8})\s*,\s*([2-4]\d\.\d{4,8})(?:[^a-z0-9_]|$)|https?://(?:maps\.app\.goo\.gl|goo\.gl/maps|(?:www\.)?google\.[a-z.]+/maps)"
SABOTAGE = r"(?:релейн[а-яіїєё]*\s*шаф|релейн[а-яіїєё]*\s*шкаф|підпал[а-яіїєё]*\s*(?:авто|потяг|релейн|шаф|технік)|поджог[а-яіїєё]*\s*(?:авто|поезд|релейн|шкаф|техник)|де\s*стоїть\s*ппо|где\s*стоит\s*пво|координат[а-яіїєё]*\s*(?:ппо|пво|баз|частин|частей|в/ч|склад|дислокац)|розташуванн[а-яіїєё]*\s*(?:ппо|технік|військ|батаре)|расположени[ея]\s*(?:пво|техник|воен|батаре)|фото\s*(?:підстанц|подстанц|тец|тэц|гес|гэс|трансформатор)|плачу\s*(?:за|в)\s*(?:крипт|гривн|рубл|фото|відео|видео)\s*(?:шаф|шкаф|підпал|поджог|координат))"
SEED = r"(?:seed\s*phrase|recovery\s*phrase|mnemonic|secret\s*recovery|фраза\s*відновлення|фраза\s*восстановления|сід-фраза|сід\s*фраза|сид-фраза|мнемонічн[а-яіїє]*\s*фраз[а-яіїє]*|мнемоническ[а-яё]*\s*фраз[а-яё]*|12\s*слів|12\s*слов|24\s*слова)[\s:=_-]*(?:[a-z]{3,8}\s+){11,23}[a-z]{3,8}"
SEED_ALONE = r"(?:^|\s)((?:[a-z]{3,8}\s+){11}[a-z]{3,8}|(?:[a-z]{3,8}\s+){23}[a-z]{3,8})(?:\s|$)"
PASSWORD = r"(?i)(?:password|пароль|pwd|pass|код\s*доступу|код\s*доступа)[\s:=_-]+([A-Za-z0-9!@#$%^&*()_+]{6,32})(?:\s|$)"
MONEY = r"[0-9]+(?:\s*[.,]\s*[0-9]+)?\s*(?:грн|uah|usd|eur|\$|€|євро|долар|гривень|гривні)"
PHONE = r"(?:\+?38)?\s*0\d{2}[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}"
EXPIRY_MARK = r"(?:^|\s)[0-1][0-9][/.-][2-3][0-9](?:\s|$)"
LONG_NUMBER = r"(^|[^a-z0-9_])\d{10,12}([^a-z0-9_]|$)"


def luhn_ok(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc
        + F.when((n - i) % 2 == 0, digits.substr(i, F.lit(1)).cast("int")).otherwise(
            F.when(digits.substr(i, F.lit(1)).cast("int") > 4, digits.substr(i, F.lit(1)).cast("int") * 2 - 9).otherwise(
                digits.substr(i, F.lit(1)).cast("int") * 2
            )
        ),
    )
    return n.between(13, 19) & (total % 10 == 0)


def cards(text: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit(CARD_RUN), F.lit(0)), lambda m: F.regexp_replace(m, r"\D", ""))
    return F.array_distinct(F.filter(runs, luhn_ok))


# Brand by leading digits, in order.
BRANDS = [("Visa", "^4"), ("Mastercard", "^(?:5[1-5]|2[2-7])"), ("American Express", "^3[47]"),
          ("Discover", "^(?:6011|65|64[4-9])"), ("Maestro", "^(?:50|5[6-9]|6[0-9])")]


def brand(digits: Column) -> Column:
    out = F.lit("Payment Card")
    for name, pattern in reversed(BRANDS):
        out = F.when(digits.rlike(pattern), name).otherwise(out)
    return out


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def expiry(low: Column) -> Column:
    stated = F.regexp_replace(F.regexp_replace(_first(low, EXPIRY), "^([^-]*)-", "$1/"), r"^([^.]*)\.", "$1/")
    alone = _first(low, EXPIRY_ALONE)
    month = lambda x: F.substring(x, 1, 2).cast("int")
    return F.when(month(stated).between(1, 12), stated).when(
        month(alone).between(1, 12) & F.substring(alone, 4, 2).cast("int").between(24, 39), alone
    )


def secrets(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {
        "cvv": _first(low, CVV),
        "expiry": expiry(low),
        "otp": _first(low, OTP),
        "gps": F.nullif(F.trim(F.regexp_extract(low, GPS, 0)), F.lit("")),
        "sabotage": _first(low, SABOTAGE, 0),
        "seed": F.coalesce(F.trim(_first(low, SEED, 0)), F.trim(_first(low, SEED_ALONE))),
        "password": _first(text, PASSWORD),
    }


def standalone_cvv(text: Column) -> Column:
    """A lone 3-4 digit number once cards, dates, phones, long numbers and money are out; never beside an OTP."""
    low = F.lower(text)
    x = F.regexp_replace(low, CARD_RUN, " ")
    x = F.regexp_replace(F.regexp_replace(x, EXPIRY_MARK, " "), PHONE, " ")
    x = F.regexp_replace(F.regexp_replace(x, LONG_NUMBER, "$1 $2"), MONEY, " ")
    found = F.regexp_extract_all(F.regexp_replace(x, r"(\D)", "$1$1"), F.lit(r"(?:^|\D)([0-9]{3,4})(?:$|\D)"), F.lit(1))
    kept = F.filter(found, lambda d: ~((F.length(d) == 4) & d.cast("int").between(1920, 2050)))
    return F.when(~low.rlike(OTP), F.get(kept, F.lit(0)))


KINDS = ["cvv", "expiry", "otp", "gps", "sabotage", "seed", "password"]


def with_assets(df: DataFrame) -> DataFrame:
    s = secrets(F.col("text"))
    return df.withColumn("cards", cards(F.col("text"))).withColumns(s)


def card_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    c = df.select(*keys, F.explode(cards(F.col("text"))).alias("card"))
    return c.withColumn("brand", brand(F.col("card")))


def secret_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    rows = F.array_compact(
        F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("value"))) for k, v in secrets(F.col("text")).items()])
    )
    return df.select(*keys, F.explode(rows).alias("s")).select(*keys, "s.*")


def leak_verdicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered ladder of outbound verdicts; df may carry n_items, the watch-list values found in the text."""
    a = with_assets(df).withColumn("_card", F.size("cards") > 0)
    cvv = F.coalesce("cvv", F.when(F.col("_card"), standalone_cvv(F.col("text"))))
    ladder = [
        (F.col("seed").isNotNull(), "seed", "CRITICAL"), (F.col("password").isNotNull(), "password", "HIGH"),
        (F.col("gps").isNotNull(), "gps", "CRITICAL"), (F.col("sabotage").isNotNull(), "sabotage", "CRITICAL"),
        (cvv.isNotNull(), "cvv", "CRITICAL"), (F.col("otp").isNotNull(), "otp", "CRITICAL"),
        (F.coalesce("n_items", F.lit(0)) > 0, "watchlist", "CRITICAL"),
        (F.col("expiry").isNotNull() & F.col("_card"), "expiry", "HIGH"), (F.col("expiry").isNotNull(), "expiry", "MEDIUM"),
        (F.col("_card"), "card", "SAFE"),
    ]
    why, level = F.lit("none"), F.lit("SAFE")
    for test, name, lv in reversed(ladder):
        why, level = F.when(test, name).otherwise(why), F.when(test, lv).otherwise(level)
    return a.select(*keys, why.alias("reason"), level.alias("risk_level")).withColumn(
        "action", F.when(F.col("reason").isin("none", "card"), "ALLOW").otherwise("BLOCK")
    )


def cross_message(outbound: DataFrame) -> DataFrame:
    """Cumulative leak evaluation of outbound messages; n_items and items_before count watch-list values."""
    own = with_assets(outbound).select(
        "conv_id", "turn", (F.size("cards") > 0).alias("card_now"), F.col("cvv"), F.coalesce("otp", F.lit("")).alias("otp"),
        F.col("expiry").isNotNull().alias("exp_now"), F.col("gps").isNotNull().alias("gps"),
        F.col("sabotage").isNotNull().alias("sab"), standalone_cvv(F.col("text")).alias("lone"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
    )
    as_int = lambda c: F.col(c).cast("int")
    bucket = turn_bucket()
    first = running(own, ["conv_id"], ["turn"], bucket, {
        "card_before": ("max", as_int("card_now"), False), "exp_before": ("max", as_int("exp_now"), False),
        "items_before": ("max", (F.col("n_items") > 0).cast("int"), False),
    })
    card = F.col("card_now") | (F.coalesce("card_before", F.lit(0)) == 1)
    cvv_now = first.withColumn("cvv_now", F.col("cvv").isNotNull() | (card & F.col("lone").isNotNull()))
    second = running(cvv_now, ["conv_id"], ["turn"], bucket, {"cvv_before": ("max", as_int("cvv_now"), False)})
    flag = lambda c: F.coalesce(c, F.lit(0)) == 1
    return second.select(
        "conv_id", "turn", "card_now", "cvv_now", "exp_now", (F.col("otp") != "").alias("otp_now"), "gps", "sab", "n_items",
        flag("card_before").alias("card_before"), flag("exp_before").alias("exp_before"),
        flag("cvv_before").alias("cvv_before"), flag("items_before").alias("items_before"),
    )


def leak_triggers(state: DataFrame) -> DataFrame:
    """One row per scenario of a message: scenario, severity, contribution (bonus counts for the score only)."""
    c = F.col
    full = (c("card_now") & c("cvv_now")) | (c("card_before") & c("cvv_now")) | (c("card_now") & c("cvv_before"))
    dated = (c("card_now") & c("exp_now")) | (c("card_before") & c("exp_now")) | (c("card_now") & c("exp_before"))
    blocked = c("gps") | c("sab") | full | c("cvv_now") | dated | c("otp_now") | (c("n_items") > 0)
    row = lambda test, name, sev, pts, bonus=0: F.when(
        test, F.struct(F.lit(name).alias("scenario"), F.lit(sev).alias("severity"), F.lit(pts).alias("contribution"),
                       (bonus if isinstance(bonus, Column) else F.lit(bonus)).alias("bonus")))
    rows = F.array(
        row(c("gps"), "gps", "CRITICAL", 100), row(c("sab"), "sabotage", "CRITICAL", 100),
        row(full, "card_and_cvv", "CRITICAL", 85), row(~full & c("cvv_now"), "cvv_alone", "CRITICAL", 75),
        row(dated, "card_and_expiry", "HIGH", 65), row(c("otp_now"), "otp", "CRITICAL", 90),
        row(c("n_items") > 0, "watchlist", "CRITICAL", 80, F.when(c("items_before"), 15).otherwise(0)),
        row(c("card_now") & ~blocked, "card_alone", "LOW", 15),
    )
    cross = (c("card_before") & (c("cvv_now") | c("exp_now"))) | (c("card_now") & (c("cvv_before") | c("exp_before")))
    return state.select("conv_id", "turn", cross.alias("is_cross"), F.array_compact(rows).alias("triggers"))


def leak_scores(triggers: DataFrame) -> DataFrame:
    has = lambda n: F.exists("triggers", lambda t: t["scenario"] == n)
    total = F.aggregate("triggers", F.lit(0), lambda a, t: a + F.when(t["scenario"].isin("gps", "sabotage"), 0).otherwise(t["contribution"] + t["bonus"]))
    # GPS and sabotage set the score to 100 once, whatever adds to it afterwards.
    score = total + F.when(has("gps") | has("sabotage"), 100).otherwise(0)
    return triggers.select(
        "conv_id", "turn", "is_cross", F.least(score, F.lit(100)).alias("score"),
        F.when(score >= 70, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("SAFE").alias("risk_level"),
        (F.size("triggers") > 0).alias("any_trigger"),
    )
