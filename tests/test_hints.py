import pytest
from pyspark.sql import functions as F

from palisade.dims import requests as R
from palisade.functions.hints import finder, hints, relaxed
from palisade.operators import evidence as E
from palisade.operators import semantic as M


def test_a_hint_never_rules_out_a_text_that_holds_the_pattern(spark):
    """flags and signals search only texts that may hold a pattern."""
    patterns = [
        r"(?<![\p{L}\p{N}])pin(?![\p{L}\p{N}])", r"pay\s+now", r"(?:^|[^a-z])otp(?:[^a-z]|$)", r"a[^.!?\n]{0,12}b", r"x[.]{2}y", r"руб(?:[^а-я]|$)",
        r"код(?=.{0,100}телефон)", r"\$\d+", r"[а-яіїє\s]{3}z",
    ]
    texts = ["my pin!", "pinned", "pay\u000bnow", "pay now", "otp\n", "an otp", "a----------b", "a.b", "x..y", "xy", "сто руб", "рубль", "код на телефон", "код", "$5", "аб\u000bz", "", "🙂pin🙂", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("h", hints(F.col("text"), patterns))
    quick = finder(F.col("text"), F.col("h"), patterns)
    cols = [F.array(*[quick(p) for p in patterns]).alias("quick"), F.array(*[F.col("text").rlike(p) for p in patterns]).alias("plain")]
    got = rows.select("text", "h", *cols).collect()
    assert [r.quick for r in got] == [r.plain for r in got]
    assert {r.text: r.h for r in got}["xy"] == 0  # it does rule texts out
    with pytest.raises(ValueError):
        relaxed(r"(a)\1")


def test_all_patterns_searched_by_hint_can_be_relaxed():
    assert all(relaxed(p) for p in [*E.FLAG_PATTERNS, *M.TEXT_PATTERNS, R.ACTION, *E.OBJECT_KINDS.values()])


def test_secrets_are_searched_only_in_likely_texts(spark):
    """The hint rules out no text that a pattern changes, in any case; a text changed by one step is searched by all later ones."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import functions as F

    from palisade.functions.hints import relaxed
    from palisade.operators.privacy import _secret_steps, redact_secrets

    words = " ".join(["abcd"] * 12)
    texts = ["CVV2: 123", "КОД  Безпеки 1234.", "valid UNTİL 08/28", "valid until 08/28 ", "x 08/29, y", "Otp code 123456", "SEED phrase: " + words, words.upper(), "Пароль : Qwerty12", "pass_Qwerty 12 cvv 123", "ſms code 1234", "no secret 12", "", None,
             "seed phrase password: abcdef " + words + " cvv 777"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for pattern, _ in _secret_steps():
        found = [r[0] for r in frame.select(F.col("text").rlike(pattern)).collect()]
        likely = pc.match_substring_regex(pa.array(texts, pa.string()), relaxed(pattern)).to_pylist()
        assert all(b for a, b in zip(found, likely) if a)
        assert not likely[11]
    plain = frame.select("doc_id", F.col("text").alias("t"), F.lit(0).alias("n"))
    for pattern, mark in _secret_steps():
        plain = plain.select("doc_id", F.regexp_replace("t", pattern, "$1" + mark).alias("t"), (F.col("n") + F.regexp_count("t", F.lit(pattern))).alias("n"))
    out = redact_secrets(frame)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in plain.collect()}
    assert "found(" in out._jdf.queryExecution().optimizedPlan().toString()
