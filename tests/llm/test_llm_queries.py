"""Registered queries of the subpackage on the given tables: check queries, held-out accuracy, recall, and the pipeline against brute force."""

import re

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from compare import compare, connect
from palisade.llm import decontaminate, pii, toxicity
from palisade.llm.queries import CHECKS, JOBS
from test_operators import brute_base, brute_components, brute_mix

FOLDER = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(CHECKS))
def test_against_check_query(spark, key):
    ok, n, why = compare(spark, connect(FOLDER), JOBS[key], CHECKS[key], FOLDER)
    assert ok and n > 0, why


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in JOBS} == set(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "mixing_sources"]


def test_toxicity_on_held_out_rows(spark):
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{FOLDER}/labels.parquet'").fetchall())
    got = JOBS["op9_toxicity"](spark, FOLDER).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_neighbour_recall_on_the_table(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{FOLDER}/embeddings.parquet' order by vec_id").fetchall()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = JOBS["op4_nearest_neighbours"](spark, FOLDER).collect()
    right = 0
    for q in {r.query_id for r in got}:
        d = np.sqrt(((m - m[ids == q]) ** 2).sum(1))
        best = [i for i in sorted(range(len(ids)), key=lambda i: (d[i], ids[i])) if ids[i] != q][:10]
        right += len({r.vec_id for r in got if r.query_id == q} & set(ids[best].tolist()))
    assert right >= 0.9 * len(got)


def test_pii_on_the_table(spark):
    import hashlib

    texts = dict(duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall())
    for r in JOBS["op6_pii"](spark, SMALL).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(brute_base(texts[r.doc_id] or "")).encode()).hexdigest()


def test_pipeline_equals_brute_force(spark):
    rows = {r[0]: r for r in duckdb.sql(f"select doc_id, text, lang, source from '{SMALL}/documents.parquet'").fetchall()}
    model = toxicity.toxicity_model(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = {i: r for i, r in rows.items() if toxicity.score_text(r[1], model)[0] < 0.5}
    parts = brute_components([(i, r[1]) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if parts[i][1] == i}
    strip = lambda t: [w.strip(decontaminate._EDGE.decode()).lower() for w in re.split(r"[ \t-\r]+", t or "") if w]
    items = [strip(t) for (t,) in duckdb.sql(f"select text from '{SMALL}/benchmark.parquet'").fetchall()]
    wanted = [{tuple(w[k : k + 8]) for k in range(len(w) - 7)} for w in items]

    def dirty(text):
        words = strip(text)
        mine = {tuple(words[k : k + 8]) for k in range(len(words) - 7)}
        return any(len(w & mine) >= min(6, 0.5 * len(w)) for w in wanted if w)

    kept = {i: (i, pii.mask(r[1], pii.find_spans(r[1])), *r[2:]) for i, r in kept.items() if not dirty(r[1])}
    from palisade.llm.mixing import BUDGET_PERCENT, EPOCHS, SEED

    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.epoch) for r in got) == sorted(brute_mix(list(kept.values()), BUDGET_PERCENT, EPOCHS, SEED))
    assert all(r.text == kept[r.doc_id][1] for r in got) and 0 < len({r.doc_id for r in got}) < len(rows)
