"""Decontamination and toxicity against plain versions that look at every window of every pair and at every sentence."""

import math
import random
import re

import pytest

from palisade.llm import decontaminate as D
from palisade.llm import toxicity as T

EDGE = ".,;:!?\"'()[]{}<>*_"


def plain_tokens(text):
    """(slot type or word, words of the token) by reading word after word."""
    out, before = [], None
    for line in text.split("\n"):
        start = True
        for raw in line.split():
            core = raw.strip(EDGE)
            low = core.lower()
            lead = re.match(r"[+-]?[$]?[0-9][0-9.,:/]*", core)
            number = core[:1] < ":" and (re.fullmatch(r"[+-]?[$]?[0-9][0-9.,:/]*%?(?:st|nd|rd|th)?", core) is not None or (lead is not None and core[lead.end() :].lower().encode() in D.UNITS))
            unit = not number and low.encode() in D.UNITS and before == "number"
            name = not number and not unit and not start and len(core) > 2 and core[0].isupper() and core[1:].islower()
            kind = "number" if number else "unit" if unit else "name" if name else "word"
            if kind == "unit" or (kind == "name" and before == "name"):
                out[-1][1].append(low)
            else:
                out.append(("<number>" if number else "<name>" if name else low, [low]))
            before = kind
            start = raw[-1] in ".!?:"
    return out


def plain_windows(tokens, size):
    for i in range(len(tokens) - size + 1):
        part = tokens[i : i + size]
        slots = [" ".join(w) for k, w in part if k in ("<number>", "<name>")]
        if len(slots) * 2 > size:
            yield i, ("exact", tuple(tuple(w) for _, w in part)), []
        else:
            yield i, ("template", tuple(k for k, _ in part)), slots


def plain_matches(docs, items):
    out = {}
    for doc_id, text in docs:
        tokens = plain_tokens(text)
        lines = [[w for _, t in plain_tokens(line) for w in t] for line in text.split("\n") if len(plain_tokens(line)) < D.MIN_WORDS]
        for item_id, item in items:
            want = plain_tokens(item)
            if len(want) < D.MIN_WORDS:
                if want and [w for _, t in want for w in t] in lines:
                    out[doc_id, item_id] = (1, 1)
                continue
            size = min(len(want), D.WINDOW)
            mine = list(plain_windows(want, size))
            template = sum(k[0] == "template" for _, k, _ in mine)
            shifts = {}
            for at, key, values in plain_windows(tokens, size):
                for i_at, i_key, i_values in mine:
                    if key == i_key:
                        shifts.setdefault(at - i_at, []).append((at, key[0], list(zip(values, i_values))))
            for hits in shifts.values():
                all_of, of_template = len({h[0] for h in hits}), len({h[0] for h in hits if h[1] == "template"})
                pairs = {p for h in hits for p in h[2]}
                fits = all_of >= D.RUN or all_of >= D.COVER * len(mine) or (template and of_template >= D.COVER * template)
                if fits and len(pairs) == len({i for _, i in pairs}):
                    out[doc_id, item_id] = max(out.get((doc_id, item_id), (0, 0)), (all_of, len(mine)))
    return out


def test_decontamination_equals_all_windows_of_all_pairs(spark):
    rng = random.Random(11)
    words = ["mill", "river", "walks", "the", "from", "station", "how", "many", "then", "and", "Maria", "Peter", "Anna", "12", "3", "45", "km", "3km", "miles", "9", "$4.50", "7th", "week:", "End.", "so,", "Is"]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, sentence(rng.choice([1, 2, 3, 5, 9, 14, 25]))) for i in range(40)] + [(90, "9 4 7 1 3 8 2 6 5 4 3 2 1"), (91, "Yes"), (92, "")]

    def changed(text):
        out = text.split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(out))
            out[at] = rng.choice([rng.choice(words), "77", "Helen Marie" if out[at][0].isupper() else out[at]])
        return " ".join(out)

    docs = [(d, "\n".join([sentence(rng.randrange(1, 30)), changed(rng.choice(items[:40])[1]), sentence(rng.randrange(1, 6)), rng.choice(items)[1]])) for d in range(120)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_matches(docs, items)
    for sent in (2_000_000, 3):
        got = {(r.doc_id, r.item_id): (r.matched_windows, r.item_windows) for r in D.contaminated(*frames, sent_hashes=sent).collect()}
        assert got == want and len(want) > 100


def plain_score(text, model):
    """1 - product over the sentences of 1 - sigmoid(bias + weights of the features of its distinct words); sentences without a feature count 0."""
    rest, own = 1.0, []
    for m in re.finditer(r"[^.!?\n]+[.!?\n]*|[.!?\n]+", text or ""):
        words = {w.strip(".,;:!?\"'()[]{}<>*_-") for w in m[0].lower().split()} - {""}
        weights = [model.weights[f] for w in words for f in (w, *(f"{w[:k]}*" for k in (3, 4, 5, 6, 7, 8) if len(w) >= k)) if f in model.weights]
        s = 1 / (1 + math.exp(-(model.bias + sum(weights)))) if weights else 0.0
        own.append((m.start(), m.end(), s))
        rest *= 1 - s
    return 1 - rest, own


def test_toxicity_scores_equal_the_noisy_or(spark):
    rng = random.Random(12)
    good, bad = ["river", "mill", "bread", "letter", "window"], ["vile", "scum", "filth"]
    text = lambda toxic: " ".join(" ".join(rng.choices(good, k=5)) + (f" {rng.choice(bad)}" if toxic and i == 1 else "") + rng.choice([".", "!", "?\n"]) for i in range(4))
    model = T.train([text(i % 2) for i in range(200)], [i % 2 for i in range(200)])
    assert model.weights
    texts = [text(i % 2) for i in range(50)] + ["", None, "vile", "...", "VILE! river vile.", "no end here filth " * 500]
    rows = T.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        want, own = plain_score(texts[r.doc_id], model)
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(r.score >= 0.5) and r.n_sentences == len(own)
        over = [(a, b) for a, b, s in own if s >= 0.5]
        assert not over or [(o.start, o.end) for o in r.offending] == over
