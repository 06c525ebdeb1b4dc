"""Terms of texts are counted where the text lies; words with a signal are those of the plain test word by word."""

from collections import Counter

from pyspark.sql import functions as F

from palisade.dims import semantics as D
from palisade.operators import semantic as M


def plain_terms(texts):
    out = Counter()
    for text in texts:
        for w in text.split():
            if len(w) >= 3:
                p = f"_{w}_"
                out[w] += 2.0
                for size, x in ((3, 1.0), (4, 1.5)):
                    for i in range(len(p) - size + 1):
                        out[p[i : i + size]] += x
    return dict(out)


def test_the_terms_of_a_text_are_moved_once(spark):
    rows = [(1, 1, "abcd abcd xy"), (1, 1, "abcd фото"), (None, 2, "ефг"), (2, 1, None), (2, 2, "")]
    w = M.term_weights(spark.createDataFrame(rows, "conv_id long, turn long, text string"), ["conv_id", "turn"])
    got = {}
    for r in w.collect():
        got.setdefault((r.conv_id, r.turn), {})[r.term] = r.w
    assert got == {(1, 1): {**plain_terms(["abcd abcd xy", "abcd фото"]), "__photo__": 3.0}, (None, 2): plain_terms(["ефг"])}
    again = M.term_weights(spark.createDataFrame(rows, "conv_id long, turn long, text string"), ["conv_id", "turn"])
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_words_with_a_signal_are_those_of_the_test_word_by_word(spark):
    bits = ["ставка", "СТАВКИ!", "оплата,", "$5", "робота", "ж/д", "хрест", "авто", "тихо", "5", "xx", "видали", "грн."]
    texts = [f"{a} {b}\t{c}" for a in bits for b in bits for c in ("ні", "швидко", "")] + ["", None]
    s = M.with_signals(spark.createDataFrame([(t,) for t in texts], "text string"))
    both = s.select("*", *[M.signal_words(F.col("text"), g).alias(f"plain_{g}") for g in D.GRADED])
    assert both.filter(" OR ".join(f"NOT (words_{g} <=> plain_{g})" for g in D.GRADED)).count() == 0
    assert both.filter(" AND ".join(f"size(words_{g}) > 0" for g in D.GRADED[:2])).count() > 0
