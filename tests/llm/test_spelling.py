"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from palisade.llm import spelling as S
from palisade.llm.queries import JOBS
from palisade.sources.tables import table

SCHEMA = "doc_id long, text string"


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_near(words):
    """word -> its words one edit away, by trying every edit."""
    letters = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        found = set()
        for i in range(len(w) + 1):
            found |= {w[:i] + c + w[i:] for c in letters}
            if i < len(w):
                found |= {w[:i] + w[i + 1 :]} | {w[:i] + c + w[i + 1 :] for c in letters}
        near[w] = (found & words.keys()) - {w}
    return near


def plain(rows):
    words = plain_words(rows)
    near = plain_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def result(frame):
    rows = frame.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()]
    assert result(JOBS["op11_spelling_variants"](spark, folder)) == plain(rows)


@pytest.mark.parametrize("bucket", [1, 256])
def test_hot_buckets_long_words_nulls_and_repeats(spark, monkeypatch, bucket):
    """Words of one length that share nearly all letters, whatever the size from which buckets are split."""
    monkeypatch.setattr(S, "BUCKET", max(bucket, 91))
    random.seed(3)
    words = ["prefixes" + "".join(random.choice("abcÿé") for _ in range(4)) for _ in range(1200)]
    words += ["".join(random.choice("ab") for _ in range(random.randrange(4, 9))) for _ in range(400)] + ["Z" * 3000, "z" * 2999, "z" * 3000 + "y", "ÀÉabc", "àéabc"] * 2
    rows = [(d, " ".join(random.choice([w, w.upper(), w]) + random.choice([",", " 1", "\n", "_", "…"]) for w in random.sample(words, 900))) for d in range(12)]
    rows += [(None, " ".join(words)), (None, None), (5, ""), (5, "12 34"), *[(7, "colour color colours colour")] * 3, (8, "x" * 40)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "'a' as word", "2 as length").repartition(3)
    assert result(S.spelling_variants(frame)) == plain(rows)


def test_no_documents_and_no_words(spark):
    frame = spark.createDataFrame([(1, "a bb ccc")], SCHEMA)
    assert S.spelling_variants(frame).collect() == []
    assert S.spelling_variants(frame.limit(0)).collect() == []


def test_blocks_find_single_edits_only():
    words = ["abcde", "abcd", "abce", "bbcde", "abcdf", "abdce", "axcdy", "bcde"]
    raw = [w.encode() for w in words]
    sizes = np.array([len(w) for w in words])
    a, b = S.single_edits(S._matrix(raw, 5, True), S._matrix(raw, 5, False), sizes, np.array([0]), 0, len(words), 5)
    assert {words[i] for i in b} == {"abcd", "abce", "bbcde", "abcdf", "bcde"} and set(a) == {0}
