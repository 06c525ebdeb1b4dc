"""Pipeline stages on rows that repeat ids, have none, or share an id between two texts, with further columns."""

import random

import corpus_pipeline as P
import pytest

WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n=60):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def near(text):
    return text + " end"


@pytest.fixture(scope="module")
def bench_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


ITEM = "which of the seven rivers of the northern plain carries the most water in spring and why does it flood"
A, B, C, D = (prose(i) for i in range(4))
ROWS = [
    (5, A, "x"), (5, A, "y"), (5, B, "x"), (6, near(A), "x"),  # 5 twice with one text, once with another; 6 a near copy
    (None, C, "x"), (None, C, "x"), (None, near(C), "y"), (None, D, "z"),  # without ids
    (7, near(D), "x"),  # the one with an id stays
    (8, None, "x"), (9, "", "x"), (None, None, "x"), (None, "", "y"), (10, prose(9), "k"), (8, None, "x"),
]
SCHEMA = "doc_id long, text string, id string"


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_near_duplicates_keep_one_row_a_group(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("id", "key")
    got = rows_of(P.near_duplicates(spark, docs, ""))
    kept = [(r[0], r[1]) for r in got]
    assert kept.count((5, A)) == 1 and (5, B) in kept and (6, near(A)) not in kept
    assert sum(k in ((None, C), (None, near(C))) for k in kept) == 1
    assert (7, near(D)) in kept and (None, D) not in kept
    assert kept.count((8, None)) == 1 and (9, "") in kept and kept.count((None, None)) == 1 and (None, "") in kept and (10, prose(9)) in kept
    assert len(kept) == 9


def test_near_duplicates_with_an_id_per_row(spark):
    docs = spark.createDataFrame([(1, A, "a"), (2, near(A), "b"), (3, B, "c"), (-4, near(B), "d")], SCHEMA)
    assert [(r[0], r[2]) for r in rows_of(P.near_duplicates(spark, docs, ""))] == [(-4, "d"), (1, "a")]
    assert P.near_duplicates(spark, docs.limit(0), "").collect() == []


def test_decontamination_takes_only_the_rows_concerned(spark, bench_dir):
    bad = f"{prose(1, 20)} {ITEM} {prose(2, 20)}"
    docs = spark.createDataFrame([(1, bad, "a"), (1, A, "b"), (None, bad, "c"), (None, B, "d"), (2, C, "e"), (2, C, "f"), (3, None, "g"), (None, None, "h")], SCHEMA)
    assert [r[2] for r in sorted(P.decontamination(spark, docs, bench_dir).collect(), key=lambda r: r[2])] == ["b", "d", "e", "f", "g", "h"]
    assert P.decontamination(spark, docs.limit(0), bench_dir).collect() == []
