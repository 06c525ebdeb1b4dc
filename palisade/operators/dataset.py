"""Training data: bounded context, duplicate groups, splits, hashed features, training and abstaining scores."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.near_copies import components
from palisade.operators.scan import running, top_per_key, turn_bucket
from palisade.sources.tables import stored

# Fixed values.
LABELS = ["SAFE", "OFF_PLATFORM_REDIRECT", "VERIFICATION_PHISHING", "PAYMENT_CREDENTIAL_THEFT", "IDENTITY_PROBING",
          "ESCROW_DELIVERY_SCAM", "MILITARY_SABOTAGE_RECRUITMENT", "CRYPTO_WALLET_COMPROMISE"]
MAX_CHARS, MAX_EACH, MAX_MESSAGES = 4096, 2048, 4
DIMENSIONS = 8192
MIN_SCORE, MIN_MARGIN = 0.6, 0.15
ABSTAIN = "ABSTAIN"


def nfkc(c: Column) -> Column:
    @F.pandas_udf("string")
    def norm(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return norm(c)


def canonical_text(c: Column) -> Column:
    x = F.regexp_replace(F.lower(nfkc(c)), r"https?://\S+", " url ")
    x = F.regexp_replace(F.regexp_replace(x, r"\d+", " number "), r"[^\p{L}\p{N}]+", " ")
    return F.trim(x)


def bounded_context(messages: DataFrame) -> DataFrame:
    """Last four inbound messages of each conversation under the character budget, newest served first."""
    inbound = messages.filter("direction = 'inbound'")
    last = top_per_key(inbound, ["conv_id"], [F.desc("turn")], MAX_MESSAGES, turn_bucket())
    listed = last.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text")), asc=False).alias("l"))
    start = F.struct(F.lit(MAX_CHARS).alias("left"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("cut"))

    def take(acc: Column, m: Column) -> Column:
        n = F.least(F.length(m["text"]), acc["left"], F.lit(MAX_EACH))
        return F.struct(
            (acc["left"] - n).alias("left"),
            F.concat(F.array(m["text"].substr(F.lit(1), n)), acc["kept"]).alias("kept"),
            (acc["cut"] | (n < F.length(m["text"]))).alias("cut"),
        )

    r = listed.select("conv_id", F.aggregate("l", start, take).alias("r"))
    return r.select("conv_id", F.col("r.kept").alias("kept"), F.col("r.cut").alias("truncated"))


# ---- near duplicates ----------------------------------------------------------------------------------------------

def duplicate_groups(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group_id): connected components of the pairs; an id without a pair is a group of its own."""
    return ids.join(components(pairs), "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def group_split(records: DataFrame) -> DataFrame:
    """records: id, label, group_id. Per label the first max(1, 20%) groups by hash order go to validation, with all their records, so that no group is on
    both sides. A label with a single group keeps it in train, and so does one whose groups would all go to validation (groups may
    have several labels): its last group in hash order stays. Ranks are counted over hash ranges, so no label is sorted in one task.
    """
    g = records.select("label", "group_id").distinct().withColumn("h", F.sha2(F.col("group_id").cast("string"), 256))
    ranked = stored(running(g.withColumn("one", F.lit(1)), ["label"], ["h"], F.substring("h", 1, 3), {"rk": ("sum", F.col("one"), True)}))
    n = g.groupBy("label").agg(F.count("*").alias("n"))
    share = F.greatest(F.lit(1), F.floor(F.col("n") * 0.2))
    wanted = ranked.join(n, "label").filter((F.col("rk") <= share) & (F.col("n") > 1)).select("group_id").distinct().withColumn("_v", F.lit(True))
    sides = ranked.join(wanted, "group_id", "left").withColumn("_v", F.coalesce("_v", F.lit(False)))
    lost = sides.groupBy("label").agg(F.min("_v").alias("all"), F.max_by("group_id", "h").alias("last")).filter("all").select(F.col("last").alias("group_id"))
    chosen = wanted.join(lost.distinct(), "group_id", "left_anti")
    return records.join(chosen, "group_id", "left").select("id", "label", "group_id", F.when(F.col("_v"), "validation").otherwise("train").alias("split"))


def untrained_labels(split: DataFrame) -> DataFrame:
    """Labels of `split` (label, split, group_id) that can't be split: fewer than two groups. They are reported, not spread over both sides."""
    return split.groupBy("label").agg(F.count_distinct("group_id").alias("groups"), F.count_if(F.col("split") == "train").alias("in_train")).filter("groups < 2")


# ---- features and scores ------------------------------------------------------------------------------------------

FNV_START, FNV_PRIME, FNV_MASK = 2166136261, np.uint64(16777619), np.uint64(0xFFFFFFFF)
TOKENS_AT_ONCE = 20_000


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and their lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64), np.fromiter(map(len, words), np.int64, len(words))


def _fnv1a(states: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """FNV-1a over the code points of every word, going on from its state; all words take a step together."""
    first, order = np.cumsum(lengths) - lengths, np.argsort(-lengths, kind="stable")
    h, starts, long = states[order], first[order], -lengths[order]
    for j in range(int(lengths.max(initial=0))):
        n = np.searchsorted(long, -j)  # the words with more than j code points
        h[:n] = ((h[:n] ^ codes[starts[:n] + j]) * FNV_PRIME) & FNV_MASK
    out = np.empty_like(h)
    out[order] = h
    return out


def _after(text: str) -> np.uint64:
    return _fnv1a(np.array([FNV_START], np.uint64), *_codes([text]))[0]


def _grams(codes: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the char features of that size, and the number of the word of each."""
    word = np.repeat(np.arange(len(lengths)), lengths + 2)
    ends = np.cumsum(lengths + 2)
    wrapped = np.full(len(word), ord("^"), np.uint64)
    wrapped[ends - 1] = ord("$")
    inner = np.ones(len(word), bool)
    inner[ends - 1] = inner[ends - lengths - 2] = False
    wrapped[inner] = codes
    at = np.flatnonzero(np.arange(len(word)) + size <= ends[word])
    h = np.full(len(at), _after("char:"), np.uint64)
    for j in range(size):
        h = ((h ^ wrapped[at + j]) * FNV_PRIME) & FNV_MASK
    return h, word[at]


def _token_hashes(words: list[str], row: np.ndarray, cur: np.ndarray, first: np.ndarray):
    """(row, hash, weight) of the features of the tokens: each word, pair of neighbours in a text, word of the latest message, run of 3 and 4 characters."""
    codes, lengths = _codes(words)
    w = np.where(cur, 1.0, 0.35)
    from_start = lambda text: _fnv1a(np.full(len(words), _after(text), np.uint64), codes, lengths)
    yield row, from_start("word:"), w
    second = np.flatnonzero(~first)
    pairs = from_start("pair:")[second - 1]
    pairs = ((pairs ^ np.uint64(ord(" "))) * FNV_PRIME) & FNV_MASK
    own = ~first
    yield row[second], _fnv1a(pairs, codes[np.repeat(own, lengths)], lengths[own]), w[second] * 0.7
    yield row[cur], from_start("latest:")[cur], np.full(cur.sum(), 0.5)
    for size in (3, 4):
        h, word = _grams(codes, lengths, size)
        yield row[word], h, w[word] * 0.2


def _cells(texts: list, frames: list, dims: int) -> pa.Array:
    """The cells of every row; texts: the tokens of its messages, the latest last; frames: (name, w) of its other features."""
    words, row, cur, first, names, at, given = [], [], [], [], [], [], []
    for i, (messages, named) in enumerate(zip(texts, frames, strict=True)):
        for p, tokens in enumerate(messages or []):
            if tokens:
                words += tokens
                row += [i] * len(tokens)
                cur += [p == len(messages) - 1] * len(tokens)
                first += [True] + [False] * (len(tokens) - 1)
        for f in named or []:
            names.append(f["name"])
            at.append(i)
            given.append(f["w"])
    parts = [*_token_hashes(words, np.array(row, np.int64), np.array(cur, bool), np.array(first, bool))]
    parts.append((np.array(at, np.int64), _fnv1a(np.full(len(names), FNV_START, np.uint64), *_codes(names)), np.array(given, np.float64)))
    rows, hashes, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
    cells, where = np.unique(rows * dims + (hashes % np.uint64(dims)).astype(np.int64), return_inverse=True)
    v = np.log1p(np.bincount(where, weights, len(cells)))
    rows = cells // dims
    norm = np.sqrt(np.bincount(rows, v * v, len(texts)))
    ends = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array((cells % dims).astype(np.int32)), pa.array(v / norm[rows])], names=["idx", "value"])
    return pa.ListArray.from_arrays(pa.array(ends), found)


def _hashed(tokens: Column, frames: Column, dims: int) -> Column:
    @F.arrow_udf("array<struct<idx:int,value:double>>")
    def cells(tokens: pa.Array, frames: pa.Array) -> pa.Array:
        texts, named, out, start, held = tokens.to_pylist(), frames.to_pylist(), [], 0, 0
        for i, messages in enumerate(texts):
            held += sum(len(t) for t in messages or [] if t)
            if held >= TOKENS_AT_ONCE or i == len(texts) - 1:
                out.append(_cells(texts[start : i + 1], named[start : i + 1], dims))
                start, held = i + 1, 0
        return pa.concat_arrays(out) if out else _cells([], [], dims)

    return cells(tokens, frames)


def nfkc_all(c: Column) -> Column:
    """nfkc of every text of an array."""
    @F.arrow_udf("array<string>")
    def norm(lists: pa.Array) -> pa.Array:
        fix = lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x)
        return pa.array([None if xs is None else [fix(x) for x in xs] for xs in lists.to_pylist()], pa.list_(pa.string()))

    return norm(c)


def token_lists(kept: Column) -> Column:
    """The tokens of every kept message."""
    plain = lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), r"https?://\S+", " externalurl "), "[’ʼ']", "")
    return F.transform(nfkc_all(kept), lambda t: F.regexp_extract_all(plain(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def frame_features(frames: DataFrame) -> DataFrame:
    """frames: id, object, purpose, destination of the latest message."""
    st = lambda name, weight: F.struct(name.alias("name"), F.lit(float(weight)).alias("w"))
    rows = F.array(
        st(F.concat_ws(":", F.lit("object"), "object"), 5), st(F.concat_ws(":", F.lit("request"), "object", "purpose"), 6),
        st(F.concat_ws(":", F.lit("recipient"), "object", "destination"), 3),
    )
    return frames.select("id", F.explode(rows).alias("f")).select("id", "f.*")


def hashed_features(kept: DataFrame, named: DataFrame, dims: int = DIMENSIONS) -> DataFrame:
    """id, idx, value: hashed, log-damped, of unit length.

    kept: id, kept (the messages of a conversation in order; the latest weighs 1, earlier ones 0.35); named: id, name, w of its other features.
    A conversation is one row of bounded text, so its features are hashed and summed there and only their sums leave the row.
    """
    listed = named.groupBy("id", "name").agg(F.sum("w").alias("w")).groupBy("id").agg(F.collect_list(F.struct("name", "w")).alias("named"))
    rows = kept.filter("id is not null").withColumn("tokens", token_lists(F.col("kept"))).select("id", "tokens").join(listed, "id", "left")
    return rows.select("id", _hashed(F.col("tokens"), F.col("named"), dims).alias("cells")).select("id", F.inline("cells"))


def class_weights(records: DataFrame) -> DataFrame:
    per = records.groupBy("label").agg(F.count("*").alias("n_label"))
    # One row of totals, hence safe to broadcast.
    total = per.agg(F.sum("n_label").alias("n"), F.count("*").alias("k"))
    return per.crossJoin(F.broadcast(total)).select("label", "n_label", F.round(F.col("n") / (F.col("k") * F.col("n_label")), 6).alias("weight"))


def to_vectors(features: DataFrame, dims: int = DIMENSIONS) -> DataFrame:
    from pyspark.ml.linalg import SparseVector, VectorUDT

    @F.udf(VectorUDT())
    def build(cells):
        return SparseVector(dims, {c["idx"]: c["value"] for c in cells})

    g = features.groupBy("id").agg(F.collect_list(F.struct("idx", "value")).alias("cells"))
    return g.select("id", build("cells").alias("features"))


def train_intent_model(vectors: DataFrame, records: DataFrame, iterations: int = 60):
    """Class-balanced multinomial logistic regression; returns the fitted model and the label order."""
    from pyspark.ml.classification import LogisticRegression

    order = {l: float(i) for i, l in enumerate(LABELS)}
    mapping = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    w = class_weights(records)
    data = vectors.join(records.select("id", "label"), "id").join(F.broadcast(w.select("label", "weight")), "label").select("id", "features", "weight", mapping[F.col("label")].alias("y"))
    lr = LogisticRegression(family="multinomial", featuresCol="features", labelCol="y", weightCol="weight", maxIter=iterations, regParam=0.001)
    return lr.fit(data)


def abstain(scores: DataFrame) -> DataFrame:
    """scores: id, probs (in label order), truncated. Accept the first label when it is sure enough, else abstain."""
    named = F.transform("probs", lambda p, i: F.struct(F.round(p, 9).alias("p"), (-i).alias("o")))
    ranked = scores.withColumn("r", F.sort_array(named, asc=False))
    top, second = F.col("r")[0], F.col("r")[1]
    label = F.element_at(F.array(*[F.lit(l) for l in LABELS]), (1 - top["o"]).cast("int"))
    margin = F.round(top["p"] - second["p"], 6)
    ok = ~F.col("truncated") & (top["p"] >= MIN_SCORE) & (margin >= MIN_MARGIN)
    return ranked.select("id", label.alias("candidate"), F.round(top["p"], 6).alias("score"), margin.alias("margin"), F.when(ok, label).otherwise(ABSTAIN).alias("decision"))


def weight_table(spark: SparkSession, model, path: str) -> tuple[DataFrame, list[float]]:
    """A fitted model saved at `path`, loaded again and taken apart: (idx, w in label order), and the intercepts. At most DIMENSIONS rows."""
    from pyspark.ml.classification import LogisticRegressionModel

    model.write().overwrite().save(path)
    loaded = LogisticRegressionModel.load(path)
    w = loaded.coefficientMatrix.toArray()
    used = [i for i in range(w.shape[1]) if w[:, i].any()]
    rows = spark.createDataFrame([(i, [float(x) for x in w[:, i]]) for i in used], "idx int, w array<double>")
    return rows, [float(x) for x in loaded.interceptVector.toArray()]


def guarded(scores: DataFrame, gate: DataFrame) -> DataFrame:
    """scores: id, candidate, decision, ...; gate: id, reason (why an automatic label must abstain, or null). Adds the guarded decision and its reason."""
    j = scores.join(gate, "id", "left")
    return j.withColumn("guarded", F.when(F.col("reason").isNull(), F.col("decision")).otherwise(ABSTAIN))


def linear_scores(features: DataFrame, weights: DataFrame, intercepts: list[float] | None = None) -> DataFrame:
    """features: id, idx, value; weights: idx, w (array in label order), at most 32768 rows, hence safe to broadcast; intercepts in label order.

    A row without any weighted feature has the intercepts alone. Labels beyond the intercepts have probability 0.
    """
    k = len(intercepts) if intercepts is not None else len(LABELS)
    base = intercepts or [0.0] * k
    j = features.join(F.broadcast(weights), "idx", "left")
    logits = j.groupBy("id").agg(F.array(*[F.coalesce(F.sum(F.col("value") * F.col("w")[i]), F.lit(0.0)) + base[i] for i in range(k)]).alias("z"))
    top = logits.withColumn("e", F.transform("z", lambda z: F.exp(z - F.array_max("z"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    probs = F.transform("e", lambda x: x / F.col("_t"))
    return top.withColumn("_t", total).select("id", F.concat(probs, F.array_repeat(F.lit(0.0), len(LABELS) - k)).alias("probs"))


def validate_families(steps: DataFrame) -> DataFrame:
    """steps: family, case_id, split, topic, kind (of the last step), at_ms, prev_ms. Problems per family."""
    g = steps.groupBy("family").agg(
        F.count_distinct("case_id").alias("cases"), F.count_distinct("kind").alias("kinds"), F.count_distinct("split").alias("splits"),
        F.count_distinct("topic").alias("topics"), F.count_if(F.col("at_ms") < F.col("prev_ms")).alias("backward"),
    )
    bad = F.array_compact(F.array(F.when((F.col("cases") != 3) | (F.col("kinds") != 3), "needs_three_contrasts"), F.when(F.col("splits") > 1, "split_leak"),
                                  F.when(F.col("topics") > 1, "topic_leak"), F.when(F.col("backward") > 0, "time_runs_back")))
    return g.select("family", F.explode(bad).alias("problem"))


# ---- perturbation -------------------------------------------------------------------------------------------------

# Words replaced in the mixed-language variant.
MIXED = [("Надішліть", "Please send"), ("Надсилайте", "Send"), ("Дайте", "Send me"), ("пароль", "password"), ("код", "code")]
QUOTE = "Я читав приклад обману: «надішли пароль». Це цитата."


def perturb(requests: DataFrame) -> DataFrame:
    """requests: conv_id, text. The five variants as rows: transform, pos, direction, text."""
    t = F.col("text")
    typos = F.regexp_replace(t, r"(?<![А-Яа-яІіЇїЄєҐґ])([А-Яа-яІіЇїЄєҐґ]{2})([А-Яа-яІіЇїЄєҐґ])([А-Яа-яІіЇїЄєҐґ])(?=[А-Яа-яІіЇїЄєҐґ]{2})", "$1$3$2")
    unicode = t
    for a, b in (("а", "a"), ("о", "o"), ("е", "e"), ("і", "i"), ("с", "c")):
        unicode = F.replace(unicode, F.lit(a), F.lit(b + "​"))
    mixed = t
    for a, b in MIXED:
        mixed = F.replace(mixed, F.lit(a), F.lit(b))
    mixed = F.when(mixed == t, F.concat(F.lit("Let me clarify: "), t)).otherwise(mixed)
    words = F.split(t, " ")
    size = F.ceil(F.size(words) / 3).cast("int")
    thirds = F.filter(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.array_join(F.slice(words, i * size + 1, size), " ")), lambda s: s != "")
    one = lambda name, x: F.struct(F.lit(name).alias("transform"), F.lit(0).alias("pos"), F.lit("inbound").alias("direction"), x.alias("text"))
    split = F.transform(thirds, lambda s, i: F.struct(F.lit("split").alias("transform"), i.alias("pos"), F.lit("inbound").alias("direction"), s.alias("text")))
    quote = [F.struct(F.lit("user_quote").alias("transform"), F.lit(0).alias("pos"), F.lit("outbound").alias("direction"), F.lit(QUOTE).alias("text")),
             F.struct(F.lit("user_quote").alias("transform"), F.lit(1).alias("pos"), F.lit("inbound").alias("direction"), t.alias("text"))]
    rows = F.concat(F.array(one("typos", typos), one("unicode", unicode), one("mixed", mixed), *quote), split)
    return requests.select("conv_id", F.explode(rows).alias("v")).select("conv_id", "v.*")


def review_sample(cases: DataFrame, per_block: int = 25, batch: int = 20) -> DataFrame:
    """cases: id, block. The first 25 per block by hash order, in batches of 20."""
    h = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    top = top_per_key(cases.withColumn("h", h), ["block"], [F.col("h")], per_block, F.substring("h", 1, 2))
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("block").orderBy("h"))
    return top.select("id", "block", rn.alias("position"), F.floor((rn - 1) / batch).alias("batch"))
