from pyspark.sql import functions as F

from palisade.operators import assets as A
from palisade.operators import pages as P


def verdict(spark, text):
    df = spark.createDataFrame([(1, text, 0)], "id long, text string, n_items long")
    r = A.leak_verdicts(df, ["id"]).first()
    return r.action, r.risk_level


def test_leak_ladder(spark):
    assert verdict(spark, "4111 1111 1111 1111") == ("ALLOW", "SAFE")
    assert verdict(spark, "4111111111111111 код CVV 452") == ("BLOCK", "CRITICAL")
    assert verdict(spark, "4111111111111111 діє до 08/28") == ("BLOCK", "HIGH")
    assert verdict(spark, "зустріч 25/12/2026") == ("ALLOW", "SAFE")
    assert verdict(spark, "Ось код з смс 8492") == ("BLOCK", "CRITICAL")


def test_luhn(spark):
    got = spark.createDataFrame([("1234 5678 9012 3456",), ("4111-1111-1111-1111",)], "text string").select(A.cards(F.col("text"))).collect()
    assert [r[0] for r in got] == [[], ["4111111111111111"]]


def test_cross_message(spark):
    rows = [(1, 0, "4111111111111111"), (1, 1, "123"), (2, 0, "cvv 999"), (2, 1, "4111111111111111"), (3, 0, "4111111111111111"), (3, 1, "500 грн")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, text string, n_items long")
    got = {(r.conv_id, r.turn): (r.is_cross, r.risk_level) for r in A.leak_scores(A.leak_triggers(A.cross_message(df))).collect()}
    assert got[(1, 1)] == (True, "CRITICAL") and got[(2, 1)] == (True, "CRITICAL") and got[(3, 1)] == (False, "SAFE")


def test_cloaking(spark):
    styles = ["left:-9999px", "opacity:0.01", "transform:scale(0)", "clip-path: inset(50%)", "width:3px;height:3px", "color:red"]
    df = spark.createDataFrame([(s, "", "", "text") for s in styles], "style string, outer_style string, class string, type string")
    got = [r.cloak for r in P.with_cloaking(df).collect()]
    assert got == ["OFFSCREEN", "OPACITY_ZERO", "TRANSFORM_CLOAK", "CLIP_PATH", "VISUALLY_HIDDEN", None]


def test_risk_score(spark):
    cases = [(30, 0, "view", False, False, 30), (20, 30, "submit", False, False, 45), (30, 0, "submit", True, False, 65), (90, 0, "submit", False, True, 30), (50, 0, "paste", True, False, 70), (90, 60, "view", False, False, 100)]
    df = spark.createDataFrame(cases, "base int, bonus int, action string, sensitive boolean, empty boolean, want int")
    s = P.risk_score(*[F.col(c) for c in ("base", "bonus", "action", "sensitive", "empty")])
    assert all(r.s == r.want for r in df.withColumn("s", s).collect())
