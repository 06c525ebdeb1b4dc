"""Quality classifier: gradients by finite differences, a plain score, held-out accuracy, and rows that carry little."""

import duckdb
import numpy as np
import pytest

from palisade.llm import quality as Q
from palisade.llm.queries import JOBS

GOOD = ["The river runs past the old mill and the children play there.", "A long letter came from the north with news of the harvest.", "She read the report twice before the meeting began."]
BAD = ["buy buy buy buy buy buy", "###$$$ %%% !!! ###", "CLICK!! HERE!! NOW!! FREE!!", "win win win win"]


def plain_score(text, model):
    """The score from its definition: average of the words, average of the pairs, the layer's difference."""
    tokens = (text or "").split()
    z = model.bias
    if tokens:
        z += np.mean([np.mean([model.parts[r] for r in Q.rows_of_word(t)], dtype=float) for t in tokens])
    if len(tokens) > 1:
        z += np.mean([model.parts[Q.pair_rows(np.array([Q.word_hash(a), Q.word_hash(b)], np.uint64))[0]] for a, b in zip(tokens, tokens[1:])], dtype=float)
    return 1 / (1 + np.exp(-z))


@pytest.fixture(scope="module")
def model():
    return Q.train([Q.document_rows(t) for t in GOOD * 8 + BAD * 8], [1] * 24 + [0] * 32)


def test_learns_from_words_grams_and_pairs(model):
    assert all(Q.score_text(t, model) > 0.9 for t in GOOD) and all(Q.score_text(t, model) < 0.1 for t in BAD)
    assert Q.score_text("zonk zonk zonk zonk zonk", model) < Q.score_text("the old mill", model)  # a stutter of an unknown word


@pytest.mark.parametrize("text", ["", None, "  ", "one", "two words", "The mill.\nThe mill. the old", "x" * 5000, "é ü\tß", "a " * 3000])
def test_scores_equal_the_definition(model, text, monkeypatch):
    assert Q.score_text(text, model) == pytest.approx(plain_score(text, model), abs=1e-6)
    monkeypatch.setattr(Q, "BLOCK", 40)
    monkeypatch.setattr(Q, "HELD", 2)
    assert Q.score_text(text, model) == pytest.approx(plain_score(text, model), abs=1e-6)


def test_document_rows_are_the_same_average(model):
    for text in GOOD + BAD:
        rows, weights = Q.document_rows(text)
        z = float(model.parts[rows].astype(float) @ weights) + model.bias
        assert 1 / (1 + np.exp(-z)) == pytest.approx(plain_score(text, model), abs=1e-5)
        assert weights.sum() == pytest.approx(2, abs=1e-4)


def test_one_class_or_no_labels():
    docs = [Q.document_rows("some text")]
    assert Q.score_text("any", Q.train(docs, [1])) > 0.9 and Q.score_text("any", Q.train(docs, [0])) < 0.1 and Q.score_text("any", Q.train([], [])) == 0.5


def test_the_bias_follows_the_odds_among_all_labels():
    docs = [Q.document_rows(t) for t in GOOD + BAD]
    few, many = (Q.train(docs, [1] * 3 + [0] * 4, odds) for odds in (0.1, 10.0))
    assert many.bias - few.bias == pytest.approx(np.log(100))


def test_nulls_repeats_two_labels_and_other_columns(spark):
    rows = [(i, (GOOD + BAD)[i % 7]) for i in range(60)] + [(None, "x"), (70, None), (71, ""), (1, "other text"), (1, GOOD[1]), (72, "y " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 as label", "'r' as rows", "2 as score")
    labels = [(i, int(i % 7 < 3)) for i in range(60)] + [(2, 0), (None, 1), (70, None), (71, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    scored = Q.score_documents(docs, Q.quality_model(docs, frame)).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= Q.CUT) for r in scored)
    assert Q.score_documents(docs.limit(0), Q.quality_model(docs.limit(0), frame.limit(0))).collect() == []
    held, odds = Q.sample(docs, frame.withColumnRenamed("quality", "label"), 10)
    assert sorted(r.label for r in held.collect()) == [0] * 10 + [1] * 10 and odds == pytest.approx(28 / 33)


def test_held_out_accuracy_and_same_scores_twice(spark):
    folder = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"select doc_id, quality from '{folder}/labels.parquet'").fetchall())
    rows = JOBS["op13_quality_classifier"](spark, folder).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert rows == JOBS["op13_quality_classifier"](spark, folder).collect()
