"""Queries over training data, features, training and scoring."""

import uuid

from pyspark.sql import functions as F

from palisade.operators import dataset as T
from palisade.operators import evidence as E
from palisade.operators.near_copies import near_duplicate_pairs as near_duplicate_pairs_of
from palisade.operators.scan import running, top_per_key, turn_bucket
from palisade.oracle.sql import cte, lit
from palisade.plans.corpus_text import normalized
from palisade.plans.registry import query
from palisade.session import ensure_checkpoint_dir, shared_folder
from palisade.sources.planted import messages
from palisade.sources.tables import spread, table


def _canon(x):
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), 'https?://\\S+', ' url ', 'g'), '\\d+', ' number ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


cte(
    "q_last4",
    """SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM q_messages WHERE direction = 'inbound' QUALIFY age <= 4""",
)
cte(
    "q_bounded",
    """SELECT conv_id, turn, age, text, n, left(text, n) AS kept, n < length(text) AS cut FROM (
  SELECT *, CAST(greatest(0, least(least(length(text), 2048), 4096 - coalesce(sum(least(length(text), 2048)) OVER (PARTITION BY conv_id ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS n FROM q_last4)""",
)
cte("q_records", f"""SELECT conv_id, string_agg(kept, ' ' ORDER BY turn) AS text, bool_or(cut) AS truncated, count(*) AS n_messages FROM q_bounded GROUP BY conv_id""")
cte("q_labels_of", "SELECT conv_id, coalesce(arg_max(truth_type, turn) FILTER (WHERE truth_type IS NOT NULL), 'SAFE') AS label FROM q_messages WHERE direction = 'inbound' GROUP BY conv_id")


def bounded(spark, folder):
    return T.bounded_context(messages(spark, folder))


def conversation_labels(spark, folder):
    m = messages(spark, folder).filter("direction = 'inbound'")
    t = F.col("truth_type").isNotNull()
    return m.groupBy("conv_id").agg(F.coalesce(F.max_by(F.when(t, F.col("truth_type")), F.when(t, F.col("turn"))), F.lit("SAFE")).alias("label"))


@query("bounded_context", "SELECT conv_id, text, truncated, n_messages FROM q_records")
def bounded_context(spark, folder):
    return bounded(spark, folder).select("conv_id", F.array_join("kept", " ").alias("text"), "truncated", F.size("kept").cast("bigint").alias("n_messages"))


@query("canonical_text", f"SELECT conv_id, {_canon('text')} AS canon FROM q_records")
def canonical_text(spark, folder):
    return bounded(spark, folder).select("conv_id", T.canonical_text(F.array_join("kept", " ")).alias("canon"))


@query(
    "shadow_context",
    """SELECT conv_id, turn, count(*) AS n_context, min(ctx_turn) AS first_turn FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ctx_turn DESC) AS k FROM q_context WHERE direction = 'inbound') WHERE k <= 4 AND ts_ms - ctx_ms <= 60000 GROUP BY ALL""",
)
def shadow_context(spark, folder):
    from palisade.operators.sessions import with_context

    c = with_context(messages(spark, folder).select("conv_id", "turn", "ts_ms", "direction"), []).filter("direction = 'inbound'")
    recent = F.filter(F.slice("ctx", F.greatest(F.lit(1), F.size("ctx") - 3), F.lit(4)), lambda x: F.col("ts_ms") - x["ts_ms"] <= 60_000)
    return c.withColumn("r", recent).select("conv_id", "turn", F.size("r").cast("bigint").alias("n_context"), F.array_min(F.transform("r", lambda x: x["turn"])).alias("first_turn"))


def canonical_documents(spark, folder):
    d = spread(table(spark, folder, "documents"), "doc_id")
    return d.select(F.col("doc_id").alias("id"), T.canonical_text(F.col("text")).alias("canon"))


cte("q_canon", f"SELECT doc_id AS id, {_canon('text')} AS canon FROM documents")
cte("q_reps", "SELECT canon, min(id) AS rep FROM q_canon GROUP BY canon")
cte("q_grams", "SELECT id, g, count(*) OVER (PARTITION BY id) AS n FROM (SELECT rep AS id, unnest(list_distinct(list_transform(range(1, greatest(1, length(canon) - 3) + 1), lambda i: substr(canon, i, 4)))) AS g FROM q_reps WHERE length(canon) >= 4)")
cte(
    "q_near",
    """SELECT a, b, jaccard FROM (SELECT x.id AS a, y.id AS b, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS jaccard FROM q_grams x JOIN q_grams y ON x.g = y.g AND x.id < y.id AND x.n >= 0.8 * y.n AND y.n >= 0.8 * x.n GROUP BY x.id, y.id)
WHERE jaccard >= 0.8 UNION ALL SELECT rep, id, 1.0 FROM q_canon JOIN q_reps USING (canon) WHERE id <> rep""",
)


@query("near_duplicate_pairs", "SELECT a, b, jaccard FROM q_near")
def near_duplicate_pairs(spark, folder):
    ensure_checkpoint_dir(spark)
    return near_duplicate_pairs_of(canonical_documents(spark, folder))


def document_groups(spark, folder):
    ensure_checkpoint_dir(spark)
    docs = canonical_documents(spark, folder)
    return T.duplicate_groups(docs.select("id"), near_duplicate_pairs_of(docs))


_GROUPS = """WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM q_near UNION SELECT b, a FROM q_near),
reach AS (SELECT id, id AS other FROM q_canon UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other),
groups AS (SELECT id, min(other) AS group_id FROM reach GROUP BY id)
"""


@query("duplicate_groups", _GROUPS + "SELECT id, group_id FROM groups")
def duplicate_groups(spark, folder):
    return document_groups(spark, folder)


cte("q_doc_labels", "SELECT doc_id AS id, CASE WHEN toxic = 1 OR doc_id % 13 = 5 THEN 'threat' WHEN quality = 1 THEN 'safe' ELSE 'poor' END AS label FROM labels")


def doc_labels(spark, folder):
    l = table(spark, folder, "labels")
    # Every thirteenth document is planted as a threat, so that some copies have two labels.
    return l.select(F.col("doc_id").alias("id"), F.when((F.col("toxic") == 1) | (F.col("doc_id") % 13 == 5), "threat").when(F.col("quality") == 1, "safe").otherwise("poor").alias("label"))


@query(
    "conflicting_labels",
    f"""SELECT sha256({_canon('text')}) AS text_key, count(*) AS n, count(DISTINCT label) AS n_labels FROM documents JOIN q_doc_labels ON id = doc_id GROUP BY 1 HAVING count(DISTINCT label) > 1""",
)
def conflicting_labels(spark, folder):
    j = canonical_documents(spark, folder).join(doc_labels(spark, folder), "id").groupBy(F.sha2("canon", 256).alias("text_key"), "label").agg(F.count("*").alias("c"))
    return j.groupBy("text_key").agg(F.sum("c").alias("n"), F.count("*").alias("n_labels")).filter("n_labels > 1")


@query(
    "group_split",
    _GROUPS.rstrip() + """,
g AS (SELECT DISTINCT label, group_id FROM groups JOIN q_doc_labels USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256(CAST(group_id AS VARCHAR))) AS rk, count(*) OVER (PARTITION BY label) AS n FROM g),
w AS (SELECT DISTINCT group_id FROM r WHERE rk <= greatest(1, floor(n * 0.2)) AND n > 1),
lost AS (SELECT arg_max(group_id, sha256(CAST(group_id AS VARCHAR))) AS group_id FROM r GROUP BY label HAVING bool_and(group_id IN (SELECT group_id FROM w)))
SELECT id, label, group_id, CASE WHEN group_id IN (SELECT group_id FROM w) AND group_id NOT IN (SELECT group_id FROM lost) THEN 'validation' ELSE 'train' END AS split
FROM groups JOIN q_doc_labels USING (id)""",
)
def group_split(spark, folder):
    """Groups of equal and of near copies stay on one side of the split."""
    return T.group_split(document_groups(spark, folder).join(doc_labels(spark, folder), "id"))


@query(
    "holdout_leakage",
    f"""SELECT conv_id, sha256(k) AS text_key FROM (SELECT conv_id, {_canon('text')} AS k FROM q_records WHERE conv_id % 3 = 2)
WHERE k IN (SELECT {_canon('text')} FROM q_records WHERE conv_id % 3 <> 2)""",
)
def holdout_leakage(spark, folder):
    c = canonical_text(spark, folder).withColumn("text_key", F.sha2("canon", 256)).select("conv_id", "text_key")
    return c.filter("conv_id % 3 = 2").join(c.filter("conv_id % 3 <> 2").select("text_key"), "text_key", "left_semi").select("conv_id", "text_key")


def _fnv(x, dims):
    return f"(list_reduce([2166136261::BIGINT] || list_transform(string_split({x}, ''), lambda c: unicode(c)::BIGINT), lambda a, b: (xor(a, b) * 16777619) & 4294967295) % {dims})"


cte(
    "q_tokens",
    """SELECT conv_id, cur, regexp_extract_all(regexp_replace(regexp_replace(lower(kept), 'https?://\\S+', ' externalurl ', 'g'), '[’ʼ'']', '', 'g'), '[\\p{L}\\p{N}]+') AS t
FROM (SELECT conv_id, kept, age = 1 AS cur FROM q_bounded)""",
)
cte("q_tok", "SELECT conv_id, cur, CASE WHEN cur THEN 1.0 ELSE 0.35 END AS w, i, t[i] AS tok, CASE WHEN i > 1 THEN t[i - 1] END AS prev FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM q_tokens)")
cte(
    "q_named",
    """SELECT conv_id, name, sum(w) AS w FROM (SELECT conv_id, 'word:' || tok AS name, w FROM q_tok UNION ALL SELECT conv_id, 'pair:' || prev || ' ' || tok, w * 0.7 FROM q_tok WHERE i > 1
UNION ALL SELECT conv_id, 'latest:' || tok, 0.5 FROM q_tok WHERE cur
UNION ALL SELECT conv_id, 'char:' || substr('^' || tok || '$', j, k), w * 0.2 FROM (SELECT *, unnest(range(1, length(tok) + 2 - k + 2)) AS j FROM q_tok, (VALUES (3), (4)) v(k)) WHERE j + k - 1 <= length(tok) + 2
UNION ALL SELECT conv_id, unnest(['object:' || object, 'request:' || object || ':' || purpose, 'recipient:' || object || ':' || destination]), unnest([5.0, 6.0, 3.0])
  FROM q_frames JOIN (SELECT conv_id, turn FROM q_last4 WHERE age = 1) USING (conv_id, turn)) GROUP BY ALL""",
)
cte("q_cells", f"SELECT conv_id, idx, ln(1 + sum(w)) AS v FROM (SELECT conv_id, w, {_fnv('name', T.DIMENSIONS)} AS idx FROM q_named) GROUP BY ALL")
cte("q_features", "SELECT conv_id AS id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY conv_id)) AS value FROM q_cells")


def features(spark, folder):
    m = messages(spark, folder)
    kept = bounded(spark, folder).select(F.col("conv_id").alias("id"), "kept")
    ends = m.filter("direction = 'inbound'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    latest = E.frame_rows(E.with_frames(normalized(m.join(ends, ["conv_id", "turn"], "left_semi"))))
    return T.hashed_features(kept, T.frame_features(latest.withColumnRenamed("conv_id", "id")))


@query("hashed_features", "SELECT id, idx, round(value, 5) AS value FROM q_features")
def hashed_features(spark, folder):
    return features(spark, folder).select("id", "idx", F.round("value", 5).alias("value"))


def fitted(spark, folder):
    """(model, its input vectors, records): trained on four fifths of the conversations."""
    ensure_checkpoint_dir(spark)
    vectors = T.to_vectors(features(spark, folder)).checkpoint()
    records = conversation_labels(spark, folder).select(F.col("conv_id").alias("id"), "label")
    return T.train_intent_model(vectors, records.filter("id % 5 <> 0")), vectors, records


def cut_records(spark, folder):
    return bounded(spark, folder).select(F.col("conv_id").alias("id"), "truncated")


@query("train_intent_model")
def train_intent_model(spark, folder):
    from pyspark.ml.functions import vector_to_array

    model, vectors, records = fitted(spark, folder)
    scored = model.transform(vectors).select("id", vector_to_array("probability").alias("probs"))
    wide = scored.withColumn("probs", F.concat("probs", F.array_repeat(F.lit(0.0), len(T.LABELS) - F.size("probs"))))
    done = T.abstain(wide.join(cut_records(spark, folder), "id"))
    return done.join(records, "id").select("id", F.when(F.col("id") % 5 == 0, "validation").otherwise("train").alias("split"), "label", "candidate", "score", "margin", "decision")


@query("score_with_abstention_fitted")
def score_with_abstention_fitted(spark, folder):
    """The saved and reloaded model as a weight table, by plain joins and sums; beside its decision the guarded one, which also abstains
    where the context gate has a reason against the candidate."""
    from palisade.operators import request_signals as Q

    model, _, _ = fitted(spark, folder)
    weights, intercepts = T.weight_table(spark, model, f"{shared_folder(spark)}/intent-model-{uuid.uuid4().hex}")
    scores = T.abstain(T.linear_scores(features(spark, folder), weights, intercepts).join(cut_records(spark, folder), "id"))
    m = messages(spark, folder).filter("direction = 'inbound'")
    latest = m.join(m.groupBy("conv_id").agg(F.max("turn").alias("turn")), ["conv_id", "turn"], "left_semi").withColumn("signals", Q.signals(F.col("text")))
    asked = latest.select(F.col("conv_id").alias("id"), "text", "signals").join(scores.select("id", "candidate"), "id")
    return T.guarded(scores, Q.context_gate(asked, F.col("candidate")).select("id", "reason"))


_W = "CAST(((idx * 31 + l * 17) % 97) - 48 AS DOUBLE) / 5"


@query(
    "score_with_abstention",
    f"""WITH z AS (SELECT id, l, sum(value * {_W}) AS z FROM q_features, range(0, 8) r(l) GROUP BY ALL),
e AS (SELECT id, l, exp(z - max(z) OVER (PARTITION BY id)) AS e FROM z), p AS (SELECT id, l, round(e / sum(e) OVER (PARTITION BY id), 9) AS p FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, l) AS rk FROM p),
t AS (SELECT id, max(l) FILTER (WHERE rk = 1) AS l, max(p) FILTER (WHERE rk = 1) AS p1, max(p) FILTER (WHERE rk = 2) AS p2 FROM r GROUP BY id)
SELECT t.id, label AS candidate, round(p1, 6) AS score, round(p1 - p2, 6) AS margin, CASE WHEN NOT truncated AND p1 >= 0.6 AND round(p1 - p2, 6) >= 0.15 THEN label ELSE 'ABSTAIN' END AS decision
FROM t JOIN (VALUES {', '.join(f"({i}, '{l}')" for i, l in enumerate(T.LABELS))}) n(l, label) USING (l) JOIN q_records ON conv_id = t.id""",
)
def score_with_abstention(spark, folder):
    l = lambda i: (((F.col("id") * 31 + i * 17) % 97) - 48).cast("double") / 5
    weights = spark.range(T.DIMENSIONS).select(F.col("id").cast("int").alias("idx"), F.array(*[l(i) for i in range(len(T.LABELS))]).alias("w"))
    s = T.linear_scores(features(spark, folder), weights)
    cut = bounded(spark, folder).select(F.col("conv_id").alias("id"), "truncated")
    return T.abstain(s.join(cut, "id"))


@query("class_weights", "SELECT label, count(*) AS n_label, round((SELECT count(*) FROM q_labels_of) / ((SELECT count(DISTINCT label) FROM q_labels_of) * count(*)), 6) AS weight FROM q_labels_of GROUP BY label")
def class_weights(spark, folder):
    return T.class_weights(conversation_labels(spark, folder))


STEPS = """SELECT conv_id // 3 AS family, conv_id AS case_id, turn, direction, text, turn * 20000 AS at_ms, truth_type,
  CASE WHEN conv_id % 3 = 0 THEN 'safe' WHEN conv_id % 3 = 1 THEN 'ambiguous' WHEN conv_id % 33 = 2 THEN 'safe' ELSE 'threat' END AS kind,
  CASE WHEN conv_id % 27 = 4 THEN 'test' ELSE 'train' END AS split, CASE WHEN conv_id % 21 = 8 THEN 'media' ELSE 'manager' END AS topic FROM {messages}"""
cte("q_steps", STEPS.format(messages="q_messages"))


def steps(spark, folder):
    return spark.sql(STEPS.replace("//", "div").format(messages="{m}"), m=messages(spark, folder))


@query(
    "expand_annotated_steps",
    """WITH s AS (SELECT *, sum(CAST(direction = 'inbound' AS INT)) OVER (PARTITION BY case_id ORDER BY turn) AS seq FROM q_steps),
k AS (SELECT a.family, a.case_id, a.turn, coalesce(a.truth_type, 'SAFE') AS label, sha256(string_agg(b.text, chr(1) ORDER BY b.turn)) AS ctx FROM s a JOIN s b ON b.case_id = a.case_id AND b.direction = 'inbound'
  AND b.turn <= a.turn AND b.seq > a.seq - 4 AND a.at_ms - b.at_ms <= 60000 WHERE a.direction = 'inbound' AND a.kind <> 'ambiguous' GROUP BY ALL)
SELECT family, ctx, min(concat(case_id, '-', turn)) AS step_id, count(*) AS n_steps, count(DISTINCT label) > 1 AS conflict FROM k GROUP BY family, ctx""",
)
def expand_annotated_steps(spark, folder):
    from palisade.operators.sessions import with_context

    s = steps(spark, folder).filter("kind <> 'ambiguous'")
    narrow = s.select(F.col("case_id").alias("conv_id"), "turn", F.col("at_ms").alias("ts_ms"), "direction", "text", "family", F.coalesce("truth_type", F.lit("SAFE")).alias("label"))
    c = with_context(narrow, ["text"]).filter("direction = 'inbound'")
    recent = F.filter(F.slice("ctx", F.greatest(F.lit(1), F.size("ctx") - 3), F.lit(4)), lambda x: F.col("ts_ms") - x["ts_ms"] <= 60_000)
    keyed = c.select("family", "conv_id", "turn", "label", F.sha2(F.array_join(F.transform(recent, lambda x: x["text"]), "\x01"), 256).alias("ctx"))
    return keyed.groupBy("family", "ctx").agg(
        F.min(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("step_id"), F.count("*").alias("n_steps"), (F.count_distinct("label") > 1).alias("conflict")
    )


@query(
    "validate_contrast_families",
    """WITH g AS (SELECT family, count(DISTINCT case_id) AS cases, count(DISTINCT kind) AS kinds, count(DISTINCT split) AS splits, count(DISTINCT topic) AS topics FROM q_steps GROUP BY family)
SELECT family, 'needs_three_contrasts' AS problem FROM g WHERE cases <> 3 OR kinds <> 3 UNION ALL SELECT family, 'split_leak' FROM g WHERE splits > 1 UNION ALL SELECT family, 'topic_leak' FROM g WHERE topics > 1""",
)
def validate_contrast_families(spark, folder):
    s = steps(spark, folder).withColumnRenamed("case_id", "conv_id")
    p = running(s.select("family", "conv_id", "turn", "split", "topic", "kind", "at_ms"), ["conv_id"], ["turn"], turn_bucket(), {"prev_ms": ("last", F.col("at_ms"), False)})
    return T.validate_families(p.withColumnRenamed("conv_id", "case_id"))


cte("q_requests", "SELECT conv_id, text FROM q_last4 WHERE age = 1")
_cyr = "[А-Яа-яІіЇїЄєҐґ]"
_uni = "text"
for _a, _b in (("а", "a"), ("о", "o"), ("е", "e"), ("і", "i"), ("с", "c")):
    _uni = f"replace({_uni}, '{_a}', '{_b}​')"
_mix = "text"
for _a, _b in T.MIXED:
    _mix = f"replace({_mix}, {lit(_a)}, {lit(_b)})"


@query(
    "perturb_corpus",
    f"""SELECT conv_id, 'unicode' AS transform, 0 AS pos, 'inbound' AS direction, {_uni} AS text FROM q_requests
UNION ALL SELECT conv_id, 'mixed', 0, 'inbound', CASE WHEN {_mix} = text THEN 'Let me clarify: ' || text ELSE {_mix} END FROM q_requests
UNION ALL SELECT conv_id, 'user_quote', 0, 'outbound', {lit(T.QUOTE)} FROM q_requests UNION ALL SELECT conv_id, 'user_quote', 1, 'inbound', text FROM q_requests
UNION ALL SELECT conv_id, 'typos', 0, 'inbound', regexp_replace(text, '(^|[^А-Яа-яІіЇїЄєҐґ])({_cyr}{{2}})({_cyr})({_cyr})({_cyr}{{2}})', '\\1\\2\\4\\3\\5', 'g') FROM q_requests
UNION ALL SELECT conv_id, 'split', i, 'inbound', s FROM (SELECT conv_id, i, array_to_string(w[i * z + 1:i * z + z], ' ') AS s FROM (SELECT conv_id, string_split(text, ' ') AS w, CAST(ceil(len(string_split(text, ' ')) / 3) AS INT) AS z, unnest(range(0, 3)) AS i FROM q_requests)) WHERE s <> ''""",
)
def perturb_corpus(spark, folder):
    m = messages(spark, folder).filter("direction = 'inbound'")
    last = top_per_key(m, ["conv_id"], [F.desc("turn")], 1, turn_bucket())
    return T.perturb(last.select("conv_id", "text"))


@query(
    "contrast_families",
    """SELECT s.conv_id * 10 + e.ending AS case_id, CASE e.ending WHEN 0 THEN 'safe' WHEN 1 THEN 'ambiguous' ELSE 'threat' END AS kind, t AS turn,
  CASE WHEN t < 7 THEN coalesce(m.text, '') ELSE 'ending ' || e.ending || ' part ' || (t - 6) END AS text
FROM (SELECT DISTINCT conv_id FROM q_messages) s, range(0, 3) e(ending), range(0, 9) r(t) LEFT JOIN q_messages m ON m.conv_id = s.conv_id AND m.turn = t AND t < 7""",
)
def contrast_families(spark, folder):
    """Stories are the first seven turns of a conversation; each is joined with every ending into nine labelled turns."""
    m = messages(spark, folder).filter("turn < 7").select("conv_id", F.col("turn").cast("int").alias("turn"), "text")
    story = m.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("turn", "text"))).alias("said"))
    late = messages(spark, folder).select("conv_id").distinct().join(story, "conv_id", "left")
    ends = F.explode(F.sequence(F.lit(0), F.lit(2)))
    rows = late.select("conv_id", "said", ends.alias("e")).select("conv_id", "said", "e", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("t"))
    text = F.when(F.col("t") < 7, F.coalesce(F.try_element_at("said", F.col("t")), F.lit(""))).otherwise(
        F.concat(F.lit("ending "), F.col("e").cast("string"), F.lit(" part "), (F.col("t") - 6).cast("string"))
    )
    kind = F.when(F.col("e") == 0, "safe").when(F.col("e") == 1, "ambiguous").otherwise("threat")
    return rows.select((F.col("conv_id") * 10 + F.col("e")).alias("case_id"), kind.alias("kind"), F.col("t").alias("turn"), text.alias("text"))


@query(
    "review_sample",
    """SELECT id, block, position, (position - 1) // 20 AS batch FROM (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'B' ELSE 'A' END AS block,
  row_number() OVER (PARTITION BY doc_id % 4 = 0 ORDER BY sha256('sample:' || doc_id)) AS position FROM labels) WHERE position <= 25""",
)
def review_sample(spark, folder):
    l = table(spark, folder, "labels")
    return T.review_sample(l.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 0, "B").otherwise("A").alias("block")))
