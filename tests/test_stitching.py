"""Verdict reuse against a plain walk, lineage with clears, replies in every shape, run history, and exact selection."""

import json
import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import corpus as C
from palisade.operators import marts as M
from palisade.operators import stitching as X
from palisade.session import shared_folder


def walked(rows, ttl):
    out, anchor = {}, {}
    for evidence, check, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        new = evidence not in anchor or ts - anchor[evidence] >= ttl
        if new:
            anchor[evidence] = ts
        out[check] = (anchor[evidence], not new)
    return out


def test_verdict_reuse_on_long_chains_ties_and_gaps(spark):
    random.seed(1)
    rows = [("chain", i, i * 60_000) for i in range(10_000)]  # no gap of the TTL anywhere
    rows += [("ties", 20_000 + i, 1000 * (i // 4)) for i in range(2000)] + [("once", 30_000, 5)]
    at = 0
    for i in range(3000):
        at += random.choice([1, 299_999, 300_000, 300_001, 40_000])
        rows.append(("random", 40_000 + i, at))
    frame = spark.createDataFrame(rows, "evidence string, check_id long, ts_ms long").repartition(7)
    got = {r.check_id: (r.anchor_ms, r.reused) for r in X.verdict_reuse(frame).collect()}
    assert got == walked(rows, 300_000)
    assert X.verdict_reuse(frame.limit(0)).collect() == []


def test_a_clear_withdraws_the_session_everywhere(spark):
    minute = 60_000
    roots = spark.createDataFrame([(1, 0, 100, "CHAT"), (9, 0, 200, "CHAT"), (5, 0, 300, "SABOTAGE")], "subject long, ts_ms long, session_id long, scenario string")
    edges = spark.createDataFrame([(1, 2, minute), (2, 3, 2 * minute), (3, 4, 4 * minute), (9, 2, 5 * minute), (2, 6, 6 * minute), (5, 6, 1)], "parent long, child long, ts_ms long")
    clears = spark.createDataFrame([(100, 3 * minute), (100, 9 * minute), (200, -5), (77, 0)], "session_id long, ts_ms long")
    got = {(r.subject, r.session_id): (r.ts_ms, r.until_ms, r.withdrawn) for r in X.context_lineage(roots, edges, clears).collect()}
    ttl = X.TTL_MS
    assert got == {
        (1, 100): (0, 3 * minute, True), (2, 100): (minute, 3 * minute, True), (3, 100): (2 * minute, 3 * minute, True),  # not on to 4, and not to 6
        (9, 200): (0, ttl, False), (2, 200): (5 * minute, 5 * minute + ttl, False), (6, 200): (6 * minute, 6 * minute + ttl, False), (5, 300): (0, ttl, False),
    }


def test_replies_of_every_shape(spark):
    inner = {"isScam": "Yes", "confidence": 61.5, "scamType": "identity_probing"}
    bodies = {
        "plain": json.dumps(inner), "nested": json.dumps({"note": '"isScam": false', "result": inner}), "array": json.dumps([inner, {"isScam": False}]),
        "escaped": json.dumps(json.dumps(inner)), "around": f"Sure!\n```json\n{json.dumps(inner, indent=1)}\n```", "cut": '{"isScam": true, "confidence": 61.5, "type": "passport',
        "words": "this is a scam for your card", "nothing": "hello", "none": None, "list": "[1, 2]", "range": '{"scam": 1, "score": "250%"}',
    }
    got = {r.reply_id: r for r in X.repair_replies(spark.createDataFrame(list(bodies.items()), "reply_id string, body string")).collect()}
    for key in ("plain", "nested", "array", "escaped", "around", "cut"):
        assert (got[key].is_scam, got[key].confidence, got[key].scam_type, got[key].rejected) == (True, 61.5, "IDENTITY_PROBING", False), key
    assert not got["cut"].is_json and got["around"].is_json and got["escaped"].is_json
    assert (got["words"].is_scam, got["words"].confidence, got["words"].scam_type) == (True, 90.0, "PAYMENT_CREDENTIAL_THEFT")
    assert got["nothing"].rejected and got["list"].rejected and got["range"].confidence == 100.0


def test_run_history_twice_changes_nothing(spark):
    path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    run = lambda rows: spark.createDataFrame(rows, "commit_id string, run_ms long, metric double")
    C.upsert_runs(run([(f"c{i}", i, float(i)) for i in range(200)]), path)
    again = run([("c7", 900, 0.5), ("c7", 800, 0.1), ("new", 1000, None)])
    files = lambda: {f for _, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    C.upsert_runs(again, path)
    once = sorted(map(tuple, spark.read.parquet(path).select("commit_id", "run_ms", "metric").collect()), key=str)
    C.upsert_runs(again, path)
    assert sorted(map(tuple, spark.read.parquet(path).select("commit_id", "run_ms", "metric").collect()), key=str) == once
    assert len(once) == 201 and ("c7", 900, 0.5) in once and len(before - files()) <= 2  # only the partitions of c7 and new were written


@pytest.mark.parametrize("values", [[1.0], [2.0] * 50, [float(i % 977) for i in range(5000)], list(np.random.default_rng(1).random(3001))])
def test_selection_equals_sorting(spark, values):
    rows = [("a", float(v)) for v in values] + [("b", float(-v)) for v in values] + [("a", None)]
    got = {r.key: r for r in M.latency_percentiles(spark.createDataFrame(rows, "key string, v double").repartition(6), "key", "v").collect()}
    for key, mine in (("a", sorted(values)), ("b", sorted(-v for v in values))):
        n = len(mine)
        assert (got[key].n, got[key].median, got[key].p95_nearest) == (n, mine[n // 2], mine[int(np.ceil(n * 0.95)) - 1])


def test_usage_of_the_last_minute(spark):
    random.seed(4)
    rows, at = [], 0
    for i in range(400):
        at += random.choice([0, 1, 30_000, 59_999, 60_000, 60_001, 3_600_000])
        rows.append((i, at, 10 + i % 7))
    got = {r.request_id: r.minute_tokens for r in X.rolling_usage(spark.createDataFrame(rows, "request_id long, ts_ms long, tokens long"), 50).collect()}
    assert got == {i: sum(n for _, t, n in rows if 0 <= ts - t <= 60_000) for i, ts, _ in rows}


def test_macro_f1_is_rounded_once(spark):
    rows = [("v", e, d) for e, d in [("SAFE", "SAFE")] * 7 + [("SAFE", "X")] * 2 + [("X", "X")] * 3 + [("Y", "X")] * 4 + [("Y", "Y")] * 6 + [("X", "ABSTAIN")]]
    got = M.abstention_metrics(spark.createDataFrame(rows, "k string, expected string, decision string"), ["k"]).first()
    f1 = [14 / 16, 6 / 13, 12 / 16]  # SAFE, X, Y
    assert got.macro_f1 == round(sum(f1) / 3, 6)


def test_messages_of_a_later_clock_stay_out(spark):
    from palisade.operators.sessions import with_context

    rows = [(1, 0, 1_000_000, "inbound"), (1, 1, 5_000_000, "inbound"), (1, 2, 1_000_500, "inbound"), (1, 3, 1_000_600, "outbound"), (1, 4, 5_000_100, "inbound")]
    got = {r.turn: [c.turn for c in r.ctx] for r in with_context(spark.createDataFrame(rows, "conv_id long, turn long, ts_ms long, direction string"), []).collect()}
    assert got == {0: [0], 1: [1], 2: [0, 2], 3: [0, 2], 4: [1, 4]}


def test_split_keeps_every_label_in_train(spark):
    from palisade.operators import dataset as T

    rows = [(i, "many", i // 2) for i in range(40)] + [(100, "single", 900), (101, "single", 900)] + [(200, "both", 0), (201, "both", 1)]
    records = spark.createDataFrame(rows, "id long, label string, group_id long")
    split = T.group_split(records).cache()
    assert {r.label for r in split.filter("split = 'train'").collect()} == {"many", "single", "both"}
    assert split.groupBy("group_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert split.filter("split = 'validation' and label = 'many'").count() > 0
    assert [r.label for r in T.untrained_labels(split).collect()] == ["single"]
