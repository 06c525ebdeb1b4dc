"""Operators and pipeline stages on tables with further columns, named as the operators name theirs: the results are those without them."""

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from palisade.llm import decontaminate, html_text, spelling, toxicity, turn_repair, url_filter, warc

ITEM = "which of the seven rivers of the northern plain carries the most water in spring and why does it flood"
DOCS = [(1, f"so {ITEM} now", "en", "s1", 10), (2, "a vile word. and bread", "de", "s2", 20), (3, None, None, None, None), (4, "", "fr", "s1", 0), (None, "mail a@b.org", "en", "s3", 12)]
NAMES = ["hash", "at", "slots", "item_id", "n", "word", "tokens", "verdict", "host", "path", "archive", "payload_digest", "label", "score", "id", "key", "_x", "component_id", "epoch", "budget", "rank"]


def more(frame):
    return frame.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES) if n not in frame.columns])


def rows(frame, columns=None):
    return sorted(map(str, frame.select(*(columns or frame.columns)).collect()))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def pages(spark):
    html = "<p>one</p><ul><li>two</ul>" + "x" * 1200
    return spark.createDataFrame([(1, "http://www.a.org/fr/x.html?q=1", html), (2, "https://b.net/", html), (3, None, None), (None, "x", "")], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(9, ITEM)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_operators(spark, docs, pages, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    labels = spark.createDataFrame([(1, True), (2, False)], "page_id long, blocked boolean")
    model = toxicity.train(["vile scum", "bread"] * 20, [1, 0] * 20)
    talks = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes")], "conv_id long, turn long, role string, text string")
    for run, frame in [
        (html_text.html_texts, pages), (lambda d: decontaminate.contaminated(d, more(bench)), docs), (warc.archive_round_trip, pages),
        (lambda d: toxicity.score_documents(d, model), docs), (lambda p: url_filter.judge_urls(p, more(labels)), pages), (spelling.spelling_variants, docs), (turn_repair.repair_damaged, talks),
    ]:
        assert rows(run(more(frame))) == rows(run(frame))


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages(spark, docs, folder, name):
    stage = dict(P.STAGES)[name]
    plain, wide = stage(spark, docs, folder), stage(spark, more(docs), folder)
    assert rows(wide, plain.columns) == rows(plain)
    if name != P.STAGES[-1][0]:
        assert plain.columns == docs.columns and wide.columns == more(docs).columns
    assert stage(spark, more(docs).limit(0), folder).count() == 0
