from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.operators.dataset import duplicate_groups
from palisade.operators.near_copies import near_duplicate_pairs
from palisade.operators.scan import running, turn_bucket
from palisade.operators.sessions import with_context
from palisade.operators.watchlist import fuzzy_hits, hmac_sha256, osa_distance


def test_running_equals_window_across_buckets(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("turn"), ((F.col("id") * 37) % 11).alias("v"))
    nv = F.when(F.col("v") % 4 == 0, F.col("v"))
    out = running(df, ["k"], ["turn"], turn_bucket(16), {"s": ("sum", F.col("v"), True), "m": ("max", F.col("v"), False), "l": ("last", nv, False)})
    w = W.partitionBy("k").orderBy("turn")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    want = df.withColumns({"s": F.sum("v").over(w), "m": F.max("v").over(before), "l": F.last(nv, ignorenulls=True).over(before)})
    assert sorted(map(tuple, out.collect())) and sorted(map(str, out.collect())) == sorted(map(str, want.collect()))


def test_context_with_small_chunks(spark):
    df = spark.range(200).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), (F.col("id") * 10_000).alias("ts_ms"), F.when(F.col("id") % 3 == 0, "outbound").otherwise("inbound").alias("direction")
    )
    got = {r.turn: [x.turn for x in r.ctx] for r in with_context(df, [], chunk=32, turns=16).collect()}
    for t in range(200):
        inbound = [i for i in range(t + 1) if i % 3 != 0][-30:]
        assert got[t] == [i for i in inbound if (t - i) * 10_000 < 900_000]


def test_expiry_is_exact(spark):
    df = spark.createDataFrame([(1, 0, 0, "inbound"), (1, 1, 900_000, "inbound"), (2, 0, 0, "inbound"), (2, 1, 899_999, "inbound")], "conv_id long, turn long, ts_ms long, direction string")
    n = {(r.conv_id, r.turn): len(r.ctx) for r in with_context(df, []).collect()}
    assert n[(1, 1)] == 1 and n[(2, 1)] == 2


def test_near_duplicates_against_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from the old barn near the river bank"
    texts = [base, base, base.replace("lazy", "hazy"), base + " today", "something else entirely with other words in it", base[:60]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, canon string")
    got = {(r.a, r.b) for r in near_duplicate_pairs(df).collect()}
    sets = [{t[i : i + 4] for i in range(len(t) - 3)} for t in texts]
    want = {(a, b) for a in range(6) for b in range(a + 1, 6) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    # Equal texts come out as a star around the smallest id.
    assert got == {(a, b) for a, b in want if 1 not in (a, b) or (a, b) == (0, 1)}
    groups = {r.id: r.group_id for r in duplicate_groups(df.select("id"), near_duplicate_pairs(df)).collect()}
    assert groups[0] == groups[1] == groups[2] == 0 and groups[4] == 4


def test_edit_distance_and_fuzzy(spark):
    assert osa_distance("смринова", "смирнова", 2) == 1
    items = spark.createDataFrame([(1, "Смирнова", "MOTHER_MAIDEN_NAME"), (2, "дім", "SECRET_WORD")], "item_id long, real_value string, category string")
    texts = spark.createDataFrame([(1, "пані смринова тут"), (2, "Smirnova was here"), (3, "дам слово"), (4, "смирно стояти")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in fuzzy_hits(texts, items).collect()}
    assert got == {(1, 1), (2, 1), (4, 1)}


def test_hmac(spark):
    import hashlib
    import hmac

    key = bytes.fromhex("5a" * 16)
    got = spark.createDataFrame([("секрет",)], "x string").select(hmac_sha256(F.col("x"))).first()[0]
    assert got == hmac.new(key, "секрет".encode(), hashlib.sha256).hexdigest()
