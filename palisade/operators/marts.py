"""Evaluation marts over predictions, votes and model runs. Everything is a partial aggregate or an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.sources.tables import stored

ABSTAIN = "ABSTAIN"


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)


def _counts(exp: Column, act: Column) -> list[Column]:
    return [
        F.count_if(exp & act).alias("tp"),
        F.count_if(~exp & act).alias("fp"),
        F.count_if(exp & ~act).alias("fn"),
        F.count_if(~exp & ~act).alias("tn"),
    ]


def _scores(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        df.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    )


def correct(p: str = "") -> Column:
    c = lambda n: F.col(p + n)
    inside = c("confidence").between(c("min_confidence"), c("max_confidence")) | ~c("actual_detected")
    return (
        (c("expected_detected") == c("actual_detected"))
        & c("expected_type").eqNullSafe(c("actual_type"))
        & (c("expected_action") == c("actual_action"))
        & inside
    )


def binary_metrics(preds: DataFrame) -> DataFrame:
    """Per corpus and pooled; ambiguous rows are left out and counted apart."""
    scored = F.col("assessment") != "ambiguous"
    grouped = preds.groupingSets([["corpus"], []], "corpus").agg(
        *_counts(F.col("expected_detected") & scored, F.col("actual_detected") & scored)[:3],
        F.count_if(~F.col("expected_detected") & ~F.col("actual_detected") & scored).alias("tn"),
        F.count_if(~scored).alias("ambiguous"),
        F.count_if(~scored & F.col("actual_detected")).alias("ambiguous_detected"),
    )
    return _scores(grouped.withColumn("corpus", F.coalesce("corpus", F.lit("combined"))))


def per_type_metrics(preds: DataFrame) -> DataFrame:
    """One-vs-rest counts: each row counts for its expected and its actual type only."""
    scored = preds.filter("assessment <> 'ambiguous'")
    sides = scored.select(
        F.explode(
            F.array_distinct(F.array_compact(F.array("expected_type", "actual_type")))
        ).alias("intent"),
        "expected_type",
        "actual_type",
    )
    e = F.col("expected_type").eqNullSafe(F.col("intent"))
    a = F.col("actual_type").eqNullSafe(F.col("intent"))
    return _scores(sides.groupBy("intent").agg(*_counts(e, a)[:3]))


def abstention_metrics(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage, exactness and recall with abstentions, and the macro F1 over the expected labels."""
    known = runs.filter("expected <> 'AMBIGUOUS'")
    threat = F.col("expected") != "SAFE"
    took = F.col("decision") != ABSTAIN
    base = known.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(took).alias("covered"),
        F.count_if(F.col("decision") == F.col("expected")).alias("exact"),
        F.count_if(threat).alias("threats"),
        F.count_if(threat & took & (F.col("decision") != "SAFE")).alias("threats_caught"),
    )
    sides = known.select(
        *keys, "expected", "decision", F.explode(F.array_distinct(F.array("expected", "decision"))).alias("label")
    ).filter(F.col("label") != ABSTAIN)
    per = sides.groupBy(*keys, "label").agg(*_counts(F.col("expected") == F.col("label"), F.col("decision") == F.col("label"))[:3])
    # Whole numbers of 10^-12 are added and divided, so neither the order of additions nor a second rounding decides the last digit.
    part = F.expr("div(cast(2 * tp as decimal(20,0)) * cast(1000000000000 as decimal(13,0)), cast(2 * tp + fp + fn as decimal(20,0)))")
    sums = per.groupBy(*keys).agg(F.sum(part).alias("_s"), F.count("*").alias("_n"))
    macro = sums.select(*keys, (F.expr("div(div(_s, _n) + 500000, 1000000)") / 1_000_000).alias("macro_f1"))
    return (
        base.join(macro, keys)
        .withColumn("coverage", ratio(F.col("covered"), F.col("n")))
        .withColumn("exact_rate", ratio(F.col("exact"), F.col("n")))
        .withColumn("threat_recall", ratio(F.col("threats_caught"), F.col("threats")))
        .select(*keys, "n", "covered", "exact", "coverage", "exact_rate", "threat_recall", "macro_f1")
    )


def exact_match(preds: DataFrame) -> DataFrame:
    scored = preds.filter("assessment <> 'ambiguous'").withColumn("ok", correct())
    return scored.groupBy("corpus").agg(
        F.count("*").alias("n"),
        F.count_if("ok").alias("exact"),
        F.count_if(F.col("expected_action") != F.col("actual_action")).alias("wrong_action"),
        F.count_if((F.col("actual_action") == "LOCK_INPUT") & (F.col("expected_action") != "LOCK_INPUT")).alias("false_lock"),
    )


def mismatches(preds: DataFrame) -> DataFrame:
    return preds.filter("assessment <> 'ambiguous'").filter(~correct()).select(
        "id", "corpus", "expected_type", "actual_type", "expected_action", "actual_action", "confidence"
    )


FIELDS = ("assessment", "intent_type", "action")


def reviewer_consensus(votes: DataFrame) -> DataFrame:
    """Cases with exactly two votes; a field the voters disagree on becomes disputed (assessment) or null."""
    value = lambda f: F.coalesce(f, F.lit("-"))
    g = votes.groupBy("case_id").agg(
        F.count("*").alias("n_votes"),
        *[(F.min(value(F.col(f))) == F.max(value(F.col(f)))).alias(f"{f}_agreed") for f in FIELDS],
        *[F.max(f).alias(f"_{f}") for f in FIELDS],
    )
    keep = g.filter("n_votes = 2")
    return keep.select(
        "case_id",
        F.when(F.col("assessment_agreed"), F.col("_assessment")).otherwise("disputed").alias("assessment"),
        F.when(F.col("intent_type_agreed"), F.col("_intent_type")).alias("intent_type"),
        F.when(F.col("action_agreed"), F.col("_action")).alias("action"),
        *[f"{f}_agreed" for f in FIELDS],
    )


def validate_votes(votes: DataFrame) -> DataFrame:
    bad = F.array_compact(
        F.array(
            F.when((F.col("assessment") == "threat") & F.col("intent_type").isNull(), "threat_without_type"),
            F.when((F.col("assessment") == "safe") & (F.col("action") != "ALLOW"), "safe_with_action"),
            F.when((F.col("assessment") == "threat") & (F.col("action") == "ALLOW"), "threat_allowed"),
            F.when((F.col("assessment") != "threat") & F.col("intent_type").isNotNull(), "type_without_threat"),
            F.when(F.col("evidence_turn").isNotNull() & ~F.col("evidence_turn").between(1, F.col("n_turns")), "turn_out_of_range"),
            F.when((F.col("assessment") == "threat") & F.col("evidence_turn").isNull(), "no_evidence"),
        )
    )
    return votes.select("case_id", "reviewer", F.explode(bad).alias("problem"))


def reviewer_agreement(votes: DataFrame) -> DataFrame:
    a, b = votes.alias("a"), votes.alias("b")
    pairs = a.join(b, (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.reviewer") < F.col("b.reviewer")))
    same = lambda f: F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    return pairs.groupBy(F.col("a.reviewer").alias("first"), F.col("b.reviewer").alias("second")).agg(
        F.count("*").alias("n"),
        *[F.round(F.avg(same(f).cast("int")), 6).alias(f"{f}_rate") for f in FIELDS],
        F.round(F.avg((same("assessment") & same("intent_type") & same("action")).cast("int")), 6).alias("all_rate"),
    )


def paired_robustness(preds: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: id (transformed case), source_id, transform."""
    new = preds.select("id", F.col("actual_detected").alias("now"))
    old = preds.select(F.col("id").alias("source_id"), F.col("actual_detected").alias("before"), F.col("expected_detected").alias("truth"))
    j = pairs.join(new, "id").join(old, "source_id")
    t, b, n = F.col("truth"), F.col("before"), F.col("now")
    return j.groupBy("transform").agg(
        F.count("*").alias("pairs"),
        F.count_if(b != n).alias("changed"),
        F.count_if(t & b & ~n).alias("threats_lost"),
        F.count_if(t & ~b & n).alias("threats_gained"),
        F.count_if(~t & ~b & n).alias("alarms_added"),
        F.count_if(~t & b & ~n).alias("alarms_removed"),
    )


RANKS = {
    "median": lambda n: F.floor(n * 0.5) + 1,
    "p95_element": lambda n: F.floor(n * 0.95) + 1,
    "p95_nearest": lambda n: F.ceil(n * 0.95),
}


def select_ranks(runs: DataFrame, key: str, value: str, ranks: dict) -> DataFrame:
    """Per key the number of rows n and, for each of `ranks` (name -> rank as a function of n), the value at that rank. Null values don't count.

    Exact selection: values are counted, then dealt by range of (key, value), so every range holds neighbouring values and is one task. Counts per
    range tell in which range a rank lies; only rows of those ranges are ordered.
    """
    counted = runs.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    dealt = stored(counted.repartitionByRange(key, value).withColumn("range", F.spark_partition_id()))
    per_range = dealt.groupBy(key, "range").agg(F.sum("c").alias("c"))
    before = W.partitionBy(key).orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row per range of a key
    spans = per_range.withColumn("lo", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("n", F.sum("c").over(W.partitionBy(key)))
    wanted = spans.select(key, "range", "lo", "c", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r(F.col("n")).cast("bigint").alias("rank")) for k, r in ranks.items()])).alias("w"))
    wanted = wanted.filter((F.col("w.rank") > F.col("lo")) & (F.col("w.rank") <= F.col("lo") + F.col("c"))).select(key, "range", "lo", "n", "w.*")
    inside = dealt.join(wanted.select(key, "range").distinct(), [key, "range"], "left_semi")
    placed = inside.withColumn("hi", F.sum("c").over(W.partitionBy(key, "range").orderBy(value)))
    found = placed.join(wanted, [key, "range"]).filter((F.col("lo") + F.col("hi") >= F.col("rank")) & (F.col("lo") + F.col("hi") - F.col("c") < F.col("rank")))
    return found.groupBy(key).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == k, F.col(value))).alias(k) for k in ranks])


def latency_percentiles(runs: DataFrame, key: str, value: str) -> DataFrame:
    """Median and both p95 definitions, exact by rank."""
    return select_ranks(runs, key, value, RANKS)


def variant_summary(runs: DataFrame) -> DataFrame:
    done = runs.filter("status = 'completed'")
    ok = F.col("decision") == F.col("expected")
    base = done.groupBy("variant").agg(
        F.count("*").alias("completed"),
        F.count_if(~F.col("flagged")).alias("unflagged"),
        F.count_if(~F.col("flagged") & ok).alias("unflagged_exact"),
        F.count_if(ok).alias("exact"),
    )
    return base.join(latency_percentiles(done, "variant", "latency_ms").select("variant", F.col("p95_nearest").alias("p95_ms")), "variant")


def run_summary(runs: DataFrame) -> DataFrame:
    threat = ~F.col("expected").isin("SAFE", "AMBIGUOUS")
    took = F.col("decision") != ABSTAIN
    alarm = took & (F.col("decision") != "SAFE")
    done = F.col("status") == "completed"
    base = runs.groupBy("variant").agg(
        F.count("*").alias("requests"),
        F.count_if(done).alias("completed"),
        F.count_if(~done).alias("errors"),
        F.count_if(done & took).alias("covered"),
        F.count_if(done & threat & alarm).alias("tp"),
        F.count_if(done & (F.col("expected") == "SAFE") & alarm).alias("fp"),
        F.count_if(done & threat & ~alarm).alias("fn"),
        F.round(F.avg(F.when(done, F.col("tokens"))), 6).alias("mean_tokens"),
        F.count_if(done & (F.col("decision") == "CRYPTO_WALLET_COMPROMISE") & (F.col("expected") != "CRYPTO_WALLET_COMPROMISE")).alias("excess_locks"),
    )
    denominator = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    base = base.withColumn("f1", F.round(F.try_divide(2 * F.col("tp"), F.nullif(denominator, F.lit(0))), 6))
    p95 = latency_percentiles(runs.filter(done), "variant", "latency_ms").select("variant", F.col("p95_nearest").alias("p95_ms"))
    return base.join(p95, "variant")


def ambiguity_report(runs: DataFrame) -> DataFrame:
    amb = F.col("expected") == "AMBIGUOUS"
    threat = ~F.col("expected").isin("SAFE", "AMBIGUOUS")
    d = F.col("decision")
    return runs.groupBy("variant").agg(
        F.count_if(amb).alias("ambiguous"),
        F.count_if(amb & (d == ABSTAIN)).alias("abstained"),
        F.count_if(amb & (d == "SAFE")).alias("confident_safe"),
        F.count_if(amb & ~d.isin(ABSTAIN, "SAFE")).alias("confident_threat"),
        F.count_if(threat & (d == "SAFE")).alias("false_safe"),
        F.count_if((d == "CRYPTO_WALLET_COMPROMISE") & (F.col("expected") != "CRYPTO_WALLET_COMPROMISE")).alias("excess_locks"),
        F.count_if(F.col("reason") == "incomplete_request").alias("incomplete_request"),
        F.count_if(F.col("reason") == "unsupported_context").alias("unsupported_context"),
    )


def fixes_and_regressions(runs: DataFrame, old: str, new: str) -> DataFrame:
    side = lambda v, name: runs.filter(F.col("variant") == v).select(
        "id", (F.col("decision") == F.col("expected")).alias(name)
    )
    both = side(old, "was").join(side(new, "now"), "id")
    return both.filter("was <> now").select("id", F.when(F.col("now"), "fixed").otherwise("regressed").alias("change"))


def compare_variants(runs: DataFrame) -> DataFrame:
    return abstention_metrics(runs, ["split", "variant"])


def history_segments(history: DataFrame) -> DataFrame:
    """history: series, run_ms, corpus_hash, metric; a changed hash or a missing value starts a new segment."""
    w = W.partitionBy("series").orderBy("run_ms")
    broke = (
        F.lag("corpus_hash").over(w).isNull()
        | (F.lag("corpus_hash").over(w) != F.col("corpus_hash"))
        | F.lag("metric").over(w).isNull()
    )
    marked = history.withColumn("_b", broke.cast("int")).withColumn("segment", F.sum("_b").over(w))
    return marked.filter(F.col("metric").isNotNull()).groupBy("series", "segment").agg(
        F.count("*").alias("points"), F.min("run_ms").alias("from_ms"), F.max("run_ms").alias("to_ms"),
        F.round(F.max("metric"), 6).alias("best"),
    )
