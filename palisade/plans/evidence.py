"""Queries over lexicon evidence and request relations."""

from pyspark.sql import functions as F

from palisade.operators import evidence as E
from palisade.oracle import evidence as _o  # noqa: F401
from palisade.plans.corpus_text import normalized
from palisade.plans.registry import query
from palisade.sources.planted import messages, watchlist
from palisade.sources.tables import stored


def norm_messages(spark, folder):
    return normalized(messages(spark, folder))


def framed_messages(spark, folder):
    return E.with_frames(norm_messages(spark, folder))


def keyword_table(spark, folder):
    return watchlist(spark, folder).filter("enabled").select("item_id", "keyword")


@query("match_clusters", "SELECT conv_id, turn, cluster, max(weight) AS weight, count(*) AS n_spans FROM q_matches GROUP BY ALL")
def match_clusters(spark, folder):
    rows = E.match_rules(norm_messages(spark, folder))
    return rows.groupBy("conv_id", "turn", "cluster").agg(F.max("weight").alias("weight"), F.count("*").alias("n_spans"))


@query(
    "negation_guard",
    """SELECT conv_id, turn, cluster, n_raw, coalesce(n_kept, 0) AS n_kept FROM
  (SELECT conv_id, turn, cluster, count(*) AS n_raw FROM q_raw_matches GROUP BY ALL) LEFT JOIN
  (SELECT conv_id, turn, cluster, count(*) AS n_kept FROM q_matches GROUP BY ALL) USING (conv_id, turn, cluster)""",
)
def negation_guard(spark, folder):
    n = norm_messages(spark, folder)
    guarded = F.col("cluster").isin(*E.GUARDS)
    both = E.match_rules(n, keep_negated=True).filter(guarded).select("conv_id", "turn", "cluster", F.lit(1).alias("raw"), F.lit(0).alias("kept"))
    both = both.unionByName(
        E.match_rules(n).filter(guarded).select("conv_id", "turn", "cluster", F.lit(0).alias("raw"), F.lit(1).alias("kept"))
    )
    return both.groupBy("conv_id", "turn", "cluster").agg(F.sum("raw").alias("n_raw"), F.sum("kept").alias("n_kept"))


@query("request_frames", "SELECT * FROM q_frames")
def request_frames(spark, folder):
    return E.frame_rows(framed_messages(spark, folder))


@query(
    "identity_requests",
    """SELECT conv_id, turn, clause, action, object_text FROM q_frames WHERE object = 'identity'""",
)
def identity_requests(spark, folder):
    rows = E.frame_rows(framed_messages(spark, folder)).filter("object = 'identity'")
    return rows.select("conv_id", "turn", "clause", "action", "object_text")


@query("contextual_evidence", "SELECT * FROM q_contextual")
def contextual_evidence(spark, folder):
    return E.contextual_evidence(norm_messages(spark, folder))


@query("frame_to_cluster", "SELECT * FROM q_frame_evidence")
def frame_to_cluster(spark, folder):
    return E.frame_evidence(E.frame_rows(framed_messages(spark, folder)))


@query("watchlist_keyword_requests", "SELECT conv_id, turn, clause, keyword, action FROM q_keyword_requests")
def watchlist_keyword_requests(spark, folder):
    return E.keyword_requests(norm_messages(spark, folder), keyword_table(spark, folder))


@query("evidence_union", "SELECT * FROM q_evidence")
def evidence_union(spark, folder):
    # Four branches read the framed texts, so they are made once.
    return E.evidence_rows(stored(framed_messages(spark, folder)), keyword_table(spark, folder))


def signalled(spark, folder):
    from palisade.operators import request_signals as Q

    return messages(spark, folder).withColumn("signals", Q.signals(F.col("text")))


@query("request_signals")
def request_signals(spark, folder):
    s = signalled(spark, folder).select("conv_id", "turn", F.posexplode("signals").alias("pos", "s"))
    return s.select("conv_id", "turn", "pos", "s.action", "s.object", "s.stance", "s.destination", "s.purpose", "s.concealed", "s.complete")


@query("context_gate")
def context_gate(spark, folder):
    """The gate against the planted truth as the candidate label of each message."""
    from palisade.operators import request_signals as Q

    g = Q.context_gate(signalled(spark, folder), F.coalesce("truth_type", F.lit("SAFE")))
    return g.select("conv_id", "turn", F.coalesce("truth_type", F.lit("SAFE")).alias("candidate"), "reason")
