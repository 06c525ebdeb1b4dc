"""Lexicon evidence, request frames and contextual evidence of single messages.

Input rows carry text, primary_lang, languages and norm (see ``normalized`` in the text queries). Everything per
message is computed inside the row, so scoring needs no shuffle up to the conversation state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.dims import requests as R
from palisade.dims.lexicon import RULES, WEIGHTS
from palisade.functions.hints import finder, hints
from palisade.functions.text import normalize_words, whole_word
from palisade.operators.scan import only, union_all
from palisade.sources.tables import stored

# Negations that cancel a match they directly precede (texts hold single blanks only).
OFF_PLATFORM_NEGATION = (
    r"(?:не(?: (?:варто|треба|потрібно|радіть|раджу|пропоную|пропонуємо))?|ніколи не|not|never|do not|dont) ?"
)
SABOTAGE_NEGATION = (
    r"(?:^|[ ,;:])(?:не(?: (?:потрібно|треба|варто|слід|можна))?|ніколи не|never|do not|dont|should not|shouldnt) ?"
)
HARD_NEGATION = r"(?:^| )(?:не|ніколи не|never|do not|dont) (?:(?:просить|просит|asks?) (?:you )?(?:to )?)?"
GUARDS = {"off_platform_action": [OFF_PLATFORM_NEGATION], "military_sabotage": [SABOTAGE_NEGATION, HARD_NEGATION]}


def guarded(cluster: str, pattern: str) -> str:
    return "".join(f"(?<!{g})" for g in GUARDS.get(cluster, [])) + f"(?:{pattern})"


def rule_rows() -> list[tuple[int, str, str, int, str]]:
    rows = [(c, lang, p) for c, lang, patterns in RULES for p in patterns]
    return [(i, c, lang, WEIGHTS[c], p) for i, (c, lang, p) in enumerate(rows)]


def _active(lang: str) -> Column:
    if lang == "universal":
        return F.lit(True)
    return F.concat(F.lit(","), "languages", F.lit(",")).contains(f",{lang},")


# Messages under four characters carry no evidence.
def _long_enough() -> Column:
    return F.length(F.trim("text")) >= 4


def match_rules(normalized: DataFrame, keep_negated: bool = False) -> DataFrame:
    """One row per match: rule_id, cluster, weight, span."""
    hits = F.array(
        *[
            F.struct(
                F.lit(i).alias("rule_id"),
                F.lit(cluster).alias("cluster"),
                F.lit(weight).alias("weight"),
                F.when(
                    _active(lang) & _long_enough() & F.col("norm").rlike(p),
                    F.regexp_extract_all(
                        "norm", F.lit(f"(?:{p})" if keep_negated else guarded(cluster, p)), F.lit(0)
                    ),
                ).alias("spans"),
            )
            for i, cluster, lang, weight, p in rule_rows()
        ]
    )
    found = normalized.select("conv_id", "turn", F.explode(F.filter(hits, lambda h: F.size(h["spans"]) > 0)).alias("h"))
    return found.select(
        "conv_id", "turn", "h.rule_id", "h.cluster", "h.weight", F.explode("h.spans").alias("span")
    ).withColumn("span", F.trim("span"))


def _either(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def lexicon_flags(found=None) -> dict[str, Column]:
    """cluster -> whether any active rule matches; one alternation per cluster and language. found: pattern -> whether norm holds it."""
    found = found or finder(F.col("norm"), None, [])
    by_cluster: dict[str, list[Column]] = {}
    for cluster, lang, patterns in RULES:
        test = _active(lang) & found(_either(patterns))
        if cluster in GUARDS:
            # The guards look behind and are slow, so they run only where the plain patterns match.
            test = test & F.col("norm").rlike("|".join(guarded(cluster, p) for p in patterns))
        by_cluster.setdefault(cluster, []).append(test)
    out = {}
    for cluster, tests in by_cluster.items():
        any_hit = tests[0]
        for t in tests[1:]:
            any_hit = any_hit | t
        out[cluster] = _long_enough() & any_hit
    return out


# ---- contextual evidence ------------------------------------------------------------------------------------------

# Fixed values.
RECON_ACTION = r"(?:сфотографуй(?:те)?|фотографуйте|зніміть|зніми|поставте\s+позначку|поділіться\s+координат|photograph|send\s+(?:its\s+|the\s+)?location)"
PROTECTED_OBJECT = r"(?:військов[а-яіїє]*\s+(?:технік|частин|обєкт)|блокпост|military\s+(?:checkpoint|base|vehicle))"
RECON_TARGET = r"(?:координат|геолокац|розташуван|позначку\s+на\s+мапі|location|photograph)"
DESTRUCTIVE_ACTION = r"(?:допоможіть\s+вивести\s+з\s+ладу|виведіть\s+з\s+ладу|залишити|покладіть|залиште)"
DISABLE = r"вивести\s+з\s+ладу|виведіть\s+з\s+ладу"
INCENDIARY = r"запалювальн[а-яіїє]*\s+суміш"
AT_STORE = r"(?:біля|у|в)\s+склад"
TRANSACTION = r"(?:курєр|кур['’]єр|посилк|після\s+продажу|сервіс\s+угоди|платформа)"
PAYOUT_OR_FEE = r"(?:отримання\s+оплати|зарезервува[а-яіїє]*\s+сум|страхов[а-яіїє]*\s+збір|підтвердження\s+виплати|зарахування\s+вартості)"
REDIRECT_TARGET = r"(?:зовнішн[а-яіїє]*\s+сторін|посиланн|надіслан[а-яіїє]*\s+форм|https?:|httрs?:|авторизуйтеся)"
REDIRECT_ACTION = r"(?:підтверд[а-яіїє]*|відкрийте|оплатіть|авторизуйтеся)"
REDIRECT_EXCUSE = r"(?:офіційн[а-яіїє]*\s+(?:застосун|кабінет)|самостійно|не\s+переходьте)"
ACTION_NEGATED = r"(?:не|ніколи\s+не|never|do\s+not|dont)\s*$"
ACTION_QUOTED = r"(?:приклад|цитата|шаблон|example|quote|template|шахрай\s+(?:просить|написав))[^.!?\n]{0,90}$"


def _allowed(text: Column, action: str, found) -> Column:
    """The first occurrence of the action exists and is neither negated nor quoted."""
    before = F.regexp_extract(text, f"(?s)^(.*?)(?:{action})", 1)
    tail = F.right(before, F.lit(100))
    return found(action) & ~tail.rlike(ACTION_NEGATED) & ~tail.rlike(ACTION_QUOTED)


def contextual_flags(found=None) -> dict[str, Column]:
    t = F.col("norm")
    found = found or finder(t, None, [])
    recon = _allowed(t, RECON_ACTION, found) & found(PROTECTED_OBJECT) & found(RECON_TARGET)
    destructive = _allowed(t, DESTRUCTIVE_ACTION, found) & (
        (found(DISABLE) & found(PROTECTED_OBJECT)) | (found(INCENDIARY) & found(AT_STORE))
    )
    redirect = (
        found(TRANSACTION) & found(PAYOUT_OR_FEE) & found(REDIRECT_TARGET)
        & _allowed(t, REDIRECT_ACTION, found) & ~found(REDIRECT_EXCUSE)
    )
    return {
        "recon": _long_enough() & recon,
        "destructive": _long_enough() & destructive,
        "transaction_redirect": _long_enough() & redirect,
    }


# What the flags of a message search its norm for.
FLAG_PATTERNS = [
    *dict.fromkeys(_either(patterns) for _, _, patterns in RULES),
    RECON_ACTION, PROTECTED_OBJECT, RECON_TARGET, DESTRUCTIVE_ACTION, DISABLE, INCENDIARY, AT_STORE,
    TRANSACTION, PAYOUT_OR_FEE, REDIRECT_TARGET, REDIRECT_ACTION, REDIRECT_EXCUSE,
]


def contextual_evidence(normalized: DataFrame) -> DataFrame:
    flags = contextual_flags()
    rows = F.array(
        *[
            F.when(flag, F.struct(F.lit(name).alias("rule"), F.lit(cluster).alias("cluster"), F.lit(WEIGHTS[cluster]).alias("weight")))
            for (name, flag), cluster in zip(
                flags.items(), ("military_sabotage", "military_sabotage", "transaction_redirect")
            )
        ]
    )
    return normalized.select("conv_id", "turn", F.explode(F.array_compact(rows)).alias("e")).select("conv_id", "turn", "e.*")


# ---- request frames -----------------------------------------------------------------------------------------------

LATIN_FROM, LATIN_TO = "асеорхуі", "aceopxyi"
LAST_ACTION = rf"(?s)^(?:.*[^\p{{L}}\p{{N}}])?({R.ACTION})((?:[^\p{{L}}\p{{N}}].*)?)$"
GAP_BREAK = r"[.!?;\n]"
GAP_PURPOSE = r"(?:^|\s)(?:щоб|чтобы|аби|для|to\s+(?:sync|synchroni[sz]e|verify|receive|restore|recover|cancel)|so\s+that)(?:\s|$)"
GAP_NOT_ASKED = r"(?:^|\s)(?:не|not|never)\s+(?:просив|просить|просил|просит|потріб[а-яіїє]*|нуж[а-яё]*|request|ask|need)"
QUESTION_ACTION = r"^(?:яке|яка|какая|какое|what\s+is)$"
QUESTION_GAP = r"^(?:(?:ваш[а-яіїєё]*|your)\s*)?$"
TO_PAGE = r"https?://|(?:на\s+(?:сторінці|сайті)|у\s+форму|на\s+странице|on\s+(?:this\s+|the\s+)?(?:page|website))"
TO_SPEAKER = r"(?:^|[^\p{L}\p{N}])(?:мені|нам|сюди|мне|сюда|to\s+me|to\s+us|here)(?:[^\p{L}\p{N}]|$)"
OBJECT_KINDS = {
    "wallet_secret": R.OBJECT_WALLET_SECRET,
    "payment_secret": R.OBJECT_PAYMENT_SECRET + f"|код(?=.{{0,100}}{R.CODE_FOLLOWED_BY})",
    "account_password": R.OBJECT_ACCOUNT_PASSWORD,
    "identity": R.OBJECT_IDENTITY,
}
FRAME_CLUSTER = {
    "identity": "identity_probing",
    "wallet_secret": "crypto_phishing",
    "account_password": "password_theft",
    "payment_secret": "payment_credential_request",
}
PURPOSE_CLUSTER = {"payment": "payment_purpose", "verification": "verification_purpose"}


def restore_latin(t: Column) -> Column:
    """Give words that hold a Latin letter their Latin look-alikes back."""
    pieces = F.split(F.regexp_replace(t, r"([\p{L}\p{N}]+)", "\u0001$1\u0001"), "\u0001")
    fixed = F.transform(pieces, lambda p: F.when(p.rlike("[a-z]"), F.translate(p, LATIN_FROM, LATIN_TO)).otherwise(p))
    return F.when(t.rlike("[a-z]"), F.array_join(fixed, "")).otherwise(t)


def clauses(text: Column, lang: Column) -> Column:
    # The wrapping keeps the language a plain value inside the lambda; otherwise the optimizer may move the whole
    # language profile into it and evaluate that per clause.
    given = F.array(F.struct(F.split(text, r"[.!?;\n]+").alias("xs"), lang.alias("lang")))
    return F.transform(
        given,
        lambda g: F.transform(
            F.filter(g["xs"], lambda x: F.length(x) > 0),
            lambda x, i: F.struct(
                i.alias("clause"), x.alias("raw"), restore_latin(normalize_words(x, g["lang"])).alias("t")
            ),
        ),
    )[0]


def with_clauses(normalized: DataFrame) -> DataFrame:
    """Add clauses and asks: a bit for the actions and one for each kind of object that the clauses may hold. Frames and keyword requests both
    start from them, so a caller that needs both stores them."""
    if "clauses" in normalized.columns:
        return normalized
    split = normalized.withColumn("clauses", clauses(F.col("text"), F.col("primary_lang")))
    t = F.array_join(F.transform("clauses", lambda c: c["t"]), "\n")
    # The marks that are set around words are taken out again with any such sign of the text itself, which may join words.
    marked = t.contains("\u0001") | t.contains("\u0002")
    return split.withColumn("_hint", hints(t, [R.ACTION, *OBJECT_KINDS.values()])).withColumn("asks", F.when(marked, F.lit(-1)).otherwise(F.col("_hint"))).drop("_hint")


def _asks(*bits: int) -> Column:
    return F.col("asks").bitwiseAND(F.lit(sum(1 << b for b in bits))) != 0


def bind(prefix: Column) -> Column:
    """Nearest action before an object, given the clause text in front of it: struct(action, start, ok)."""
    near = F.right(prefix, F.lit(120))
    parts = F.struct(
        prefix.alias("prefix"),
        F.regexp_extract(near, LAST_ACTION, 1).alias("action"),
        F.regexp_extract(near, LAST_ACTION, 2).alias("gap"),
    )

    def judge(p: Column) -> Column:
        gap, action = p["gap"], p["action"]
        start = F.length(p["prefix"]) - F.length(gap) - F.length(action)
        before = F.rtrim(F.right(F.left(p["prefix"], start), F.lit(100)))
        words = F.size(F.filter(F.split(F.trim(gap), r"\s+"), lambda w: F.length(w) > 0))
        refused = (
            gap.rlike(GAP_BREAK) | gap.rlike(GAP_PURPOSE) | (words > 10) | gap.rlike(R.EXPLANATORY)
            | gap.rlike(GAP_NOT_ASKED)
            | (action.rlike(QUESTION_ACTION) & ~F.trim(gap).rlike(QUESTION_GAP))
            | before.rlike(R.NEGATION) | before.rlike(R.REPORTED) | before.rlike(R.NOT_REQUESTED)
        )
        return F.struct(action.alias("action"), start.alias("start"), ((action != "") & ~refused).alias("ok"))

    return F.transform(F.array(parts), judge)[0]


def _objects(c: Column) -> Column:
    """Clause -> array of (object, object_text, prefix) over the four kinds."""
    kinds = F.array(
        *[
            F.struct(
                F.lit(name).alias("object"),
                F.split(F.regexp_replace(c["t"], whole_word(core), "\u0001$0\u0002"), "\u0001").alias("parts"),
            )
            for name, core in OBJECT_KINDS.items()
        ]
    )

    def occurrences(k: Column) -> Column:
        n = F.size(k["parts"])
        return F.when(
            n > 1,
            F.transform(
                F.sequence(F.lit(2), n),
                lambda i: F.struct(
                    c["clause"].alias("clause"),
                    k["object"].alias("object"),
                    F.substring_index(F.element_at(k["parts"], i), "\u0002", 1).alias("object_text"),
                    F.replace(F.array_join(F.slice(k["parts"], F.lit(1), i - 1), ""), F.lit("\u0002"), F.lit("")).alias(
                        "prefix"
                    ),
                    c["raw"].alias("raw"),
                    c["t"].alias("t"),
                ),
            ),
        ).otherwise(F.array())

    return F.flatten(F.transform(F.filter(kinds, lambda k: F.size(k["parts"]) > 1), occurrences))


def request_frames() -> Column:
    """array<struct<clause,object,action,object_text,purpose,destination,start,obj_start>> of a message, from its clauses; made only where
    these may hold an action and an object."""
    objects = F.flatten(F.transform("clauses", _objects))

    def frame(o: Column) -> Column:
        b = bind(o["prefix"])
        return F.transform(
            F.array(F.struct(b.alias("b"))),
            lambda w: F.struct(
                o["clause"].alias("clause"),
                o["object"].alias("object"),
                w["b"]["action"].alias("action"),
                o["object_text"].alias("object_text"),
                F.when(o["t"].rlike(R.PAYMENT_PURPOSE), "payment")
                .when(o["t"].rlike(R.VERIFICATION_PURPOSE), "verification")
                .otherwise("unknown")
                .alias("purpose"),
                F.when(F.lower(o["raw"]).rlike(TO_PAGE), "page")
                .when(o["t"].rlike(TO_SPEAKER), "interlocutor")
                .otherwise("unknown")
                .alias("destination"),
                w["b"]["start"].alias("start"),
                F.length(o["prefix"]).alias("obj_start"),
                w["b"]["ok"].alias("ok"),
            ),
        )[0]

    bound = F.filter(F.transform(objects, frame), lambda f: f["ok"])
    wrapped = F.transform(
        F.array(F.struct(bound.alias("fs"))),
        lambda w: F.filter(
            w["fs"],
            lambda f: (f["object"] != "account_password")
            | ~F.exists(
                w["fs"],
                lambda g: (g["object"] == "wallet_secret")
                & (g["clause"] == f["clause"])
                & (g["start"] <= f["obj_start"])
                & (g["obj_start"] + F.length(g["object_text"]) > f["obj_start"]),
            ),
        ),
    )[0]
    likely = _asks(0) & _asks(*range(1, 1 + len(OBJECT_KINDS)))
    return F.when(_long_enough() & likely, wrapped).otherwise(F.array())


def with_frames(normalized: DataFrame) -> DataFrame:
    return with_clauses(normalized).withColumn("frames", request_frames()).drop("clauses", "asks")


def frame_rows(framed: DataFrame) -> DataFrame:
    # An outer explode, as for a plain one a filter on the size of the frames would be pushed down to where they are made, hints included.
    return framed.select("conv_id", "turn", F.explode_outer("frames").alias("f")).filter("f is not null").select(
        "conv_id", "turn", "f.clause", "f.object", "f.action", "f.object_text", "f.purpose", "f.destination", "f.start"
    )


def frame_evidence(frames: DataFrame) -> DataFrame:
    """Frames as cluster evidence: the object's cluster, and the purpose's where one is stated."""
    pairs = F.array_compact(
        F.array(
            *[F.when(F.col("object") == o, F.lit(c)) for o, c in FRAME_CLUSTER.items()],
            *[F.when(F.col("purpose") == p, F.lit(c)) for p, c in PURPOSE_CLUSTER.items()],
        )
    )
    weights = F.create_map(*[F.lit(x) for c in [*FRAME_CLUSTER.values(), *PURPOSE_CLUSTER.values()] for x in (c, WEIGHTS[c])])
    return frames.select("conv_id", "turn", "clause", "object_text", F.explode(pairs).alias("cluster")).withColumn(
        "weight", weights[F.col("cluster")]
    )


# ---- requests for listed keywords ---------------------------------------------------------------------------------

def keyword_requests(normalized: DataFrame, keywords: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Messages that request a listed keyword; keywords: item_id, keyword. Word runs are matched by an equi-join."""
    keys = keys or ["conv_id", "turn"]
    # The spellings of a keyword are made once, however many items have it, and stored, as two steps read them.
    wanted = stored(
        keywords.select("keyword")
        .distinct()
        .select(
            F.explode(
                F.array(
                    restore_latin(normalize_words(F.col("keyword"))), normalize_words(F.col("keyword"), F.lit("en"))
                )
            ).alias("run"),
            "keyword",
        )
        .filter(F.length("run") >= 3)
        .distinct()
    )
    lengths = wanted.agg(F.collect_set(F.size(F.split("run", " "))).alias("lengths"))  # one row: the word counts that occur
    # A request has an action, so other messages need no runs.
    one = only(with_clauses(normalized), _asks(0)).select(*keys, F.explode("clauses").alias("c"))
    worded = one.select(*keys, F.col("c.clause").alias("clause"), F.col("c.t").alias("t"), F.regexp_extract_all("c.t", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"))
    listed = F.flatten(
        F.transform(
            F.filter("lengths", lambda n: n <= F.size("words")),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.struct(i.alias("i"), F.array_join(F.slice("words", i, n), " ").alias("run"))
            ),
        )
    )
    runs = worded.crossJoin(F.broadcast(lengths)).select(*keys, "clause", "t", F.explode(listed).alias("r")).select(*keys, "clause", "t", "r.i", "r.run")
    # What stands before a word: the pieces up to its own, which begin at the words.
    parts = F.split(F.regexp_replace("t", r"([\p{L}\p{N}]+)", "\u0001$1"), "\u0001")
    hits = runs.join(wanted, "run").select(*keys, "clause", "keyword", bind(F.array_join(F.slice(parts, F.lit(1), F.col("i")), "")).alias("b"))
    return only(hits, F.col("b.ok")).select(*keys, "clause", "keyword", F.col("b.action").alias("action"))


# ---- everything together ------------------------------------------------------------------------------------------

CLUSTERS = [*WEIGHTS]


def evidence_rows(framed: DataFrame, keywords: DataFrame) -> DataFrame:
    """All evidence with its source, one row per distinct span."""
    sources = [
        match_rules(framed).select("conv_id", "turn", "cluster", "weight", F.lit("lexicon").alias("source"), "span"),
        contextual_evidence(framed).select(
            "conv_id", "turn", "cluster", "weight", F.lit("context").alias("source"), F.col("rule").alias("span")
        ),
        frame_evidence(frame_rows(framed)).select(
            "conv_id", "turn", "cluster", "weight", F.lit("frame").alias("source"), F.col("object_text").alias("span")
        ),
        keyword_requests(framed, keywords).select(
            "conv_id", "turn", F.lit("identity_probing").alias("cluster"), F.lit(45).alias("weight"),
            F.lit("keyword").alias("source"), F.col("keyword").alias("span"),
        ),
    ]
    return union_all(sources).distinct()


def with_cluster_flags(framed: DataFrame, keyword_hits: DataFrame | None = None) -> DataFrame:
    """Add ``clusters``: the sorted names of the clusters a message shows."""
    found = finder(F.col("norm"), F.col("_found"), FLAG_PATTERNS)
    flags = lexicon_flags(found)
    ctx = contextual_flags(found)

    def has(field: str, value: str) -> Column:
        return F.exists("frames", lambda f: f[field] == value)

    def also(cluster: str, test: Column) -> None:
        flags[cluster] = flags[cluster] | test if cluster in flags else test

    for obj, cluster in FRAME_CLUSTER.items():
        also(cluster, has("object", obj))
    for purpose, cluster in PURPOSE_CLUSTER.items():
        also(cluster, has("purpose", purpose))
    also("military_sabotage", ctx["recon"] | ctx["destructive"])
    also("transaction_redirect", ctx["transaction_redirect"])
    df = framed.withColumn("_found", hints(F.col("norm"), FLAG_PATTERNS))
    if keyword_hits is not None:
        marks = keyword_hits.select("conv_id", "turn").distinct().withColumn("_kw", F.lit(True))
        df = df.join(marks, ["conv_id", "turn"], "left")
        also("identity_probing", F.coalesce("_kw", F.lit(False)))
    shown = F.array_compact(F.array(*[F.when(flags[c], F.lit(c)) for c in CLUSTERS]))
    return df.withColumn("clusters", shown).drop("_kw", "_found")
