"""A sample of registered queries against their check queries on the smallest data; compare.py runs all of them."""

import pytest
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
KEYS = ["normalize_words", "language_profile", "match_clusters", "request_frames", "intent_overrides", "cross_message_leaks", "form_risk",
        "binary_metrics", "tainted_context", "group_split", "find_entities", "concept_cosine", "session_quarantine"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", KEYS)
def test_against_check_query(spark, con, key):
    import __spark_entry__ as entry

    ok, n, why = compare(spark, con, entry.queries()[key], entry.oracle_sql()[key], FOLDER)
    assert ok and n > 0, why


def test_stream_equals_batch(spark):
    import __spark_entry__ as entry

    flags = ["card_now", "cvv_now", "exp_now", "otp_now", "gps", "sab", "card_before", "exp_before", "cvv_before"]
    stream = {(r.conv_id, r.turn): tuple(r[f] for f in flags) for r in entry.queries()["stream_cross_leaks"](spark, FOLDER).collect()}
    from palisade.operators import assets as A
    from palisade.plans.streams import TURNS_PER_SESSION
    from palisade.sources.planted import messages
    from pyspark.sql import functions as F

    # a session of a conversation is a conversation of its own
    sent = messages(spark, FOLDER).filter("direction = 'outbound'").withColumn("n_items", F.lit(0))
    own = sent.withColumn("conv_id", F.col("conv_id") * 1000 + F.floor(F.col("turn") / TURNS_PER_SESSION))
    batch = {(r.conv_id // 1000, r.turn): tuple(r[f] for f in flags) for r in A.cross_message(own).collect()}
    assert stream == batch and len(stream) > 20
