"""Semantic signals, concept profiles, n-gram similarity with threat prototypes, and semantic verdicts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.dims import semantics as D
from palisade.functions.hints import finder, hints
from palisade.operators.scan import only
from palisade.operators.sessions import recency

MILITARY, PAYMENT = "MILITARY_SABOTAGE_RECRUITMENT", "PAYMENT_CREDENTIAL_THEFT"


# What the lower-cased text of a message is searched for.
TEXT_PATTERNS = [*dict.fromkeys([*D.SIGNALS.values(), D.MENTIONS_CREDENTIAL, D.COMPLETED_CHECK, D.CREDENTIAL_ADVICE, D.SELF_SERVICE])]


def text_hints(text: Column) -> Column:
    return hints(F.lower(text), TEXT_PATTERNS)


def signals(text: Column, hint: Column) -> Column:
    found = finder(F.lower(text), hint, TEXT_PATTERNS)
    return F.array_compact(F.array(*[F.when(found(p), F.lit(name)) for name, p in D.SIGNALS.items()]))


def signal_words(text: Column, name: str) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: F.lower(w).rlike(D.SIGNALS[name])))


def with_signals(df: DataFrame) -> DataFrame:
    """Add signals and words_<signal>, and text_hints, which other searches of the same text may use."""
    t = F.col("text")
    # A word that shows a signal shows it in the text as well, as blanks bound words like the ends of a text; so words are tried only where the text has it.
    words = lambda g: F.when(t.isNull() | F.array_contains("signals", g), signal_words(t, g)).otherwise(F.array().cast("array<string>"))
    return df.withColumn("text_hints", text_hints(t)).withColumn("signals", signals(t, F.col("text_hints"))).withColumns({f"words_{g}": words(g) for g in D.GRADED})


def concept_weights(has, n_words) -> dict[str, Column]:
    """has(signal) -> Column, n_words(signal) -> Column."""
    graded = lambda g: F.when(has(g), F.least(F.lit(1.0), F.lit(0.5) + n_words(g) * F.lit(0.2))).otherwise(0.0)
    return {
        d: graded(d) if d in D.GRADED else F.when(has(d), D.FIXED_WEIGHTS[d]).otherwise(0.0) for d in D.DIMENSIONS
    }


def message_profile(df: DataFrame) -> DataFrame:
    """Concept columns c_<dimension> of single messages."""
    s = with_signals(df)
    w = concept_weights(lambda g: F.array_contains("signals", g), lambda g: F.size(f"words_{g}"))
    return s.withColumns({f"c_{d}": F.round(x, 6) for d, x in w.items()})


def concept_cosine(proto: str) -> Column:
    """Cosine of the c_ columns with a profile; 0 unless two dimensions are set."""
    w = D.PROFILES[proto]
    cols = [F.col(f"c_{d}") for d in D.DIMENSIONS]
    dot = sum((c * p for c, p in zip(cols, w)), F.lit(0.0))
    own = sum((c * c for c in cols), F.lit(0.0))
    n = sum((F.when(c > 0, 1).otherwise(0) for c in cols), F.lit(0))
    norm = sum(p * p for p in w) ** 0.5
    return F.when(n < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.try_divide(dot, F.sqrt(own) * norm), 2))))


# ---- n-gram vectors -----------------------------------------------------------------------------------------------

def clean(text: Column) -> Column:
    x = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def term_weights(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, w (not normalised); several rows of one key add up to one text."""
    # The texts of a key are moved together once; all that is counted of them stays where they are. Cleaned words have no underscore, so none is taken for a concept.
    base = texts.select(*keys, clean(F.col("text")).alias("c")).repartition(*keys)
    flags = F.array_compact(F.array(*[F.when(F.col("c").rlike(p), F.lit(f"__{n}__")) for n, p in D.CONCEPTS]))
    words = (
        base.select(*keys, F.explode(F.concat(F.split("c", " "), flags)).alias("word")).filter(F.length("word") >= 3).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    )
    padded = F.concat(F.lit("_"), "word", F.lit("_"))
    grams = lambda size: F.transform(F.sequence(F.lit(1), F.length("word") + 3 - size), lambda i: padded.substr(i, F.lit(size)))
    part = lambda term, w: F.struct(term.alias("term"), (F.lit(w) * F.col("n")).alias("w"))
    lexical = F.concat(F.array(part(F.col("word"), 2.0)), F.transform(grams(3), lambda g: part(g, 1.0)), F.transform(grams(4), lambda g: part(g, 1.5)))
    concept = F.array(F.struct(F.col("word").alias("term"), F.lit(3.0).alias("w")))
    parts = F.when(F.col("word").startswith("__"), concept).otherwise(lexical)
    return words.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.term", "p.w").groupBy(*keys, "term").agg(F.sum("w").alias("w"))


def unit_vectors(weights: DataFrame, keys: list[str]) -> DataFrame:
    """L2-normalised vectors; the norm is joined back, so one text's terms need not share a task."""
    norms = weights.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norms, keys).select(*keys, "term", (F.col("w") / F.col("norm")).alias("w"))


def prototype_terms(spark: SparkSession) -> DataFrame:
    """term -> weights in the 17 prototype texts, as an array."""
    texts = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(D.PROTOTYPES)], "pno int, text string")
    v = unit_vectors(term_weights(texts, ["pno"]), ["pno"])
    cells = [F.coalesce(F.max(F.when(F.col("pno") == i, F.col("w"))), F.lit(0.0)) for i in range(len(D.PROTOTYPES))]
    return v.groupBy("term").agg(F.array(*cells).alias("pw"))


def prototype_similarity(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Best cosine per prototype kind: keys, s_military, s_payment."""
    weights = term_weights(texts, keys)
    # Some ten thousand fixed terms, whatever the input, hence safe to broadcast.
    j = weights.join(F.broadcast(prototype_terms(texts.sparkSession)), "term", "left")
    n = len(D.PROTOTYPES)
    sums = j.groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        *[F.sum(F.col("w") * F.coalesce(F.get("pw", F.lit(i)), F.lit(0.0))).alias(f"d{i}") for i in range(n)],
    )
    best = lambda kind: F.round(F.least(F.lit(1.0), F.greatest(*[F.col(f"d{i}") for i in range(n) if D.PROTOTYPES[i][0] == kind]) / F.col("norm")), 6)
    return sums.select(*keys, best(MILITARY).alias("s_military"), best(PAYMENT).alias("s_payment"))


PREFIX = "[Співрозмовник]: "


def context_texts(ctx_rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Texts of the context of each row as written into the dialogue; ctx_rows: conv_id, turn, ctx."""
    refs = ctx_rows.select("conv_id", "turn", F.explode("ctx").alias("x")).select("conv_id", "turn", F.col("x.turn").alias("src"))
    texts = messages.select("conv_id", F.col("turn").alias("src"), F.concat(F.lit(PREFIX), "text").alias("text"))
    return refs.join(texts, ["conv_id", "src"]).select("conv_id", "turn", "text")


def similarities(ctx_rows: DataFrame, messages: DataFrame) -> DataFrame:
    """Similarity of the latest message and of the whole context, the larger per kind.

    ctx_rows: conv_id, turn, ctx, latest_turn, long_enough.
    """
    keys = ["conv_id", "turn"]
    both = prototype_similarity(context_texts(ctx_rows, messages), keys)
    refs = ctx_rows.filter("long_enough").select(*keys, F.col("latest_turn").alias("src"))
    texts = messages.select("conv_id", F.col("turn").alias("src"), "text")
    latest = prototype_similarity(refs.join(texts, ["conv_id", "src"]).select(*keys, "text"), keys)
    latest = latest.select(*keys, F.col("s_military").alias("l_m"), F.col("s_payment").alias("l_p"))
    z = F.lit(0.0)
    return both.join(latest, keys, "left").select(
        *keys, F.greatest("s_military", F.coalesce("l_m", z)).alias("s_military"), F.greatest("s_payment", F.coalesce("l_p", z)).alias("s_payment")
    )


# ---- verdicts -----------------------------------------------------------------------------------------------------

def credential_evidence(clusters: Column, raw: Column, hint: Column | None = None) -> Column:
    """True for an explicit secret request, false for advice or a finished check, else null. hint: text_hints of raw."""
    found = finder(F.lower(raw), hint, TEXT_PATTERNS)
    has = lambda c: F.array_contains(clusters, c)
    asked = has("payment_credential_request") | has("password_theft") | (has("bank_login_request") & has("action_link") & has("payment_purpose"))
    settled = (found(D.COMPLETED_CHECK) & ~found(D.MENTIONS_CREDENTIAL)) | found(D.CREDENTIAL_ADVICE) | found(D.SELF_SERVICE)
    return F.when(asked, True).when(settled, False)


def with_context_signals(df: DataFrame) -> DataFrame:
    """df: ctx (entries with signals and words_*), ts_ms. Adds g_<signal> (seen in context), k_<signal> (strongest
    recent weight), c_<dimension> and stale (some context is older than a minute)."""
    aged = F.transform("ctx", lambda x: F.struct(recency(F.col("ts_ms") - x["ts_ms"]).alias("r"), x["signals"].alias("s")))
    df = df.withColumn("_aged", aged)
    strength = {
        f"k_{g}": F.round(F.coalesce(F.array_max(F.transform(F.filter("_aged", lambda x: F.array_contains(x["s"], g)), lambda x: x["r"])), F.lit(0.0)), 9)
        for g in D.SIGNALS
    }
    df = df.withColumns(strength).withColumn("stale", F.exists("_aged", lambda x: x["r"] < 1))
    df = df.withColumns({f"n_{g}": F.size(F.array_distinct(F.flatten(F.transform("ctx", lambda x: x[f"words_{g}"])))) for g in D.GRADED})
    df = df.withColumns({f"g_{g}": F.col(f"k_{g}") > 0 for g in D.SIGNALS})
    w = concept_weights(lambda g: F.col(f"g_{g}"), lambda g: F.col(f"n_{g}"))
    return df.withColumns({f"c_{d}": F.round(x, 6) for d, x in w.items()}).drop("_aged")


def may_signal(df: DataFrame) -> DataFrame:
    """Rows of contexts that hold the signals which may_form asks for, before their weights are known."""
    seen = lambda g: F.exists("ctx", lambda x: F.array_contains(x["signals"], g))
    return only(df, seen("action") | (seen("polite") & seen("media") & seen("protected")))


def may_form(df: DataFrame) -> DataFrame:
    """Rows whose context could form a semantic intent; only these need vectors."""
    return only(df, F.col("g_action") | (F.col("g_polite") & F.col("g_media") & F.col("g_protected")))


def semantic_verdicts(rows: DataFrame) -> DataFrame:
    """rows: g_, k_, c_ columns, stale, s_military, s_payment, evidence. Adds sem_intent, sem_confidence, support."""
    g = lambda n: F.col(f"g_{n}")
    k = lambda n: F.col(f"k_{n}")
    eff = lambda s, p: F.round(F.greatest(F.coalesce(s, F.lit(0.0)), concept_cosine(p)), 2)
    df = rows.withColumn("sim_m", eff("s_military", MILITARY)).withColumn("sim_p", eff("s_payment", PAYMENT))
    df = df.withColumn("is_top_m", F.col("sim_m") >= F.col("sim_p")).withColumn("top_sim", F.greatest("sim_m", "sim_p"))
    courier = g("reward") & g("action") & g("courier")
    df = df.withColumn("b_courier", courier).withColumn("b_recon", g("target") & g("action") & (g("recon") | (g("media") & g("vehicle"))))
    df = df.withColumn("b_ideology", g("ideology") & g("target") & g("action"))
    b = lambda n: F.col(f"b_{n}")
    df = df.withColumn("b_physical", g("target") | g("sabotage") | b("courier") | g("recon") | g("ideology"))
    df = df.withColumn(
        "b_pragmatic",
        g("action") & b("physical") & (
            (g("reward") & g("target")) | (g("reward") & g("discretion")) | b("courier") | b("recon") | b("ideology") | g("sabotage")
        ),
    )
    df = df.withColumn(
        "b_vector",
        F.col("is_top_m") & g("action") & b("physical") & (g("recon") | g("ideology") | g("sabotage") | b("courier") | g("tied")) & (F.col("top_sim") >= 0.40),
    )
    df = df.withColumn("b_polite", F.col("is_top_m") & ~g("action") & g("polite") & g("media") & g("protected") & (F.col("top_sim") >= 0.55))
    df = df.withColumn(
        "b_credential",
        F.coalesce("evidence", F.lit(True)) & ~F.col("is_top_m") & g("action")
        & ((F.col("top_sim") >= 0.45) | ((F.col("top_sim") >= 0.38) & g("credential_hint"))),
    )
    df = df.withColumn("raw_intent", F.when(b("pragmatic") | b("vector") | b("polite"), MILITARY).when(b("credential"), PAYMENT))
    pct = F.round(F.col("top_sim") * 100)
    df = df.withColumn(
        "raw_confidence",
        F.when(F.col("raw_intent") == MILITARY, F.least(F.lit(95.0), F.greatest(pct, F.lit(75.0)))).when(F.col("raw_intent") == PAYMENT, F.least(F.lit(90.0), pct)),
    )
    zero = F.lit(0.0)
    when = lambda c, x: F.when(c, x).otherwise(zero)
    physical = F.greatest(k("target"), k("sabotage"), k("courier"), k("recon"), k("ideology"))
    branch = F.greatest(
        when(g("reward") & g("target"), F.least(k("reward"), k("target"))), when(g("reward") & g("discretion"), F.least(k("reward"), k("discretion"))),
        when(b("courier"), F.least(k("reward"), k("courier"))),
        when(b("recon"), F.least(k("target"), F.greatest(k("recon"), F.least(k("media"), k("vehicle_any"))))),
        when(b("ideology"), F.least(k("ideology"), k("target"))), when(g("sabotage"), k("sabotage")),
    )
    military = F.greatest(
        when(b("pragmatic"), F.least(k("action"), physical, branch)),
        when(b("vector"), F.least(k("action"), physical, F.greatest(k("recon"), k("ideology"), k("sabotage"), k("courier"), k("protected")))),
        when(b("polite"), F.least(k("media"), k("protected"), k("polite"))),
    )
    df = df.withColumn(
        "support",
        F.when(F.col("raw_intent").isNull() | ~F.col("stale"), 1.0).when(F.col("raw_intent") == MILITARY, military).otherwise(F.least(k("action"), k("credential_any"))),
    )
    df = df.withColumn("_conf", F.when(F.col("stale"), F.round(F.col("raw_confidence") * F.col("support"))).otherwise(F.col("raw_confidence")))
    floor = F.when(F.col("raw_intent") == MILITARY, 75).when(F.col("top_sim") >= 0.45, 45).otherwise(38)
    df = df.withColumn("_keep", F.col("raw_intent").isNotNull() & (~F.col("stale") | (F.col("_conf") >= floor)))
    return df.withColumn("sem_intent", F.when(F.col("_keep"), F.col("raw_intent"))).withColumn("sem_confidence", F.when(F.col("_keep"), F.col("_conf"))).drop("_conf", "_keep")


PROTOTYPE_BLOCK, VECTOR_BLOCK = 512, 4000


def _block_top(k: int):
    """One block of vectors against one block of prototypes: the k best cosines of every vector, ties to the smaller prototype."""

    def unit(column) -> tuple[np.ndarray, np.ndarray]:
        m = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        return m, np.sqrt((m * m).sum(1))

    def run(vectors: pa.Table, prototypes: pa.Table) -> pa.Table:
        none = pa.table({"vec_id": pa.array([], pa.int64()), "proto_id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        if not vectors.num_rows or not prototypes.num_rows:
            return none
        prototypes = prototypes.sort_by("proto_id")
        (v, nv), (p, np_) = unit(vectors.column("embedding")), unit(prototypes.column("vec"))
        lengths = nv[:, None] * np_[None]
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = np.where(lengths > 0, np.round(v @ p.T / lengths, 6), -2.0)  # -2: without direction, behind all others
        best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
        ids, protos = vectors.column("vec_id").to_numpy(), prototypes.column("proto_id").to_numpy()
        return pa.table({"vec_id": np.repeat(ids, best.shape[1]).astype(np.int64), "proto_id": protos[best.ravel()].astype(np.int64), "cosine": np.take_along_axis(cosine, best, 1).ravel()})

    return run


def embedding_neighbours(vectors: DataFrame, prototypes: DataFrame, k: int) -> DataFrame:
    """Top-k prototypes per vector by cosine; vectors: vec_id, embedding; prototypes: proto_id, vec. All vectors have one length.

    Any number of prototypes: blocks of prototypes meet blocks of vectors as matrix products, each gives its k best, the best of those stand.
    """
    blocks = lambda frame, size: F.lit(max(1, -(-frame.count() // size)))
    n_v, n_p = blocks(vectors, VECTOR_BLOCK), blocks(prototypes, PROTOTYPE_BLOCK)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.pmod(F.xxhash64("vec_id"), n_v).alias("vb"), F.explode(F.sequence(F.lit(0), n_p - 1)).alias("pb"))
    p = prototypes.select(F.col("proto_id").cast("long").alias("proto_id"), "vec", F.pmod(F.xxhash64("proto_id"), n_p).cast("int").alias("pb"), F.explode(F.sequence(F.lit(0).cast("long"), n_v - 1)).alias("vb"))
    found = v.groupBy("vb", "pb").cogroup(p.groupBy("vb", "pb")).applyInArrow(_block_top(k), "vec_id long, proto_id long, cosine double")
    order = W.partitionBy("vec_id").orderBy(F.desc("cosine"), "proto_id")
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select("vec_id", "rank", "proto_id", F.when(F.col("cosine") >= -1.5, F.col("cosine")).alias("cosine"))
