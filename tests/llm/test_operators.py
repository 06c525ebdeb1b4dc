"""Operators of the subpackage on small tables: brute-force versions, planted cases, nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from palisade.llm import decontaminate, mixing, ngram_join, nn_descent, pii, suffix_dedup, toxicity, url_filter, warc
from palisade.llm.html_text import extract, html_texts
from palisade.llm.lyndon import suffix_array
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, gram string"  # the last two clash with inner names


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or ""), 7, "x") for i, t in rows], DOCS)


WORDS = [f"w{i}" for i in range(60)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    for t in list(texts[:12]):
        words = t.split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [texts[3], texts[3].upper(), texts[4] + "\n\t ", "", None, "  ", "one two", "ONE two", " ".join(["spam"] * 3000)]
    return list(enumerate(texts))


# 1: n-gram join


def brute_components(rows):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    part = {i: i for i in sets}

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                part[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("block", [2, 1000])
def test_ngram_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus()
    got = ngram_join.jaccard_components(documents(spark, [*rows, rows[5], (None, "null id")])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert len(got) == len(rows)


def test_ngram_join_of_a_chain_and_of_an_empty_table(spark):
    words = [f"x{i}" for i in range(100)]
    rows = []
    for i in range(6):
        rows.append((10 - i, " ".join(words)))
        words = [*words[:-3], *[f"y{i}{j}" for j in range(3)]] if i % 2 else [f"z{i}a", f"z{i}b", *words[2:]]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(documents(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()} and len(set(got.values())) < len(rows)
    assert ngram_join.jaccard_components(documents(spark, [])).count() == 0


# 2: HTML


PAGE = """<html><head><title>no</title><style>.h, #g {display:none} p{margin:0}</style></head><body><h1>Hello  <b>big</b> world</h1><p>one<p>two <span hidden>no</span><i class=h>no</i>yes<br>line
<ul><li>a<li>b<ul><li>b1</ul><li>c</ul><ol start=3><li>x<li>y</ol><table><tr><th>Name<th>Qty<tr><td>apple<td>10<tr><td>fig tree<td>2</table>after<pre>
  keep
   this</pre><div style="visibility:hidden">no<b style="visibility: visible">shown</b></div>&amp; &copy;<script>var t="</p>no";</script></body></html>"""
TEXT = """Hello big world

one

two yes
line

- a
- b
  - b1
- c

3. x
4. y

Name      Qty
apple     10
fig tree  2

after

  keep
   this

shown
& ©"""


def test_html_layout():
    assert extract(PAGE) == TEXT
    assert extract(None) == extract("") == extract("<script>x</script>") == ""
    assert extract("<table><td>a<td>b</table><p>x</td>y") == "a  b\n\nxy"
    assert extract("<b>open <i>tags") == "open tags"
    assert extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert extract("<p>" + "long word " * 20000).count("word") == 20000
    assert extract("<select><option>a<option>b</select><dl><dt>t<dd>d</dl>") == "a\nb\n\nt\n    d"


def test_html_table(spark):
    rows = [(1, PAGE, "x"), (1, PAGE, "x"), (None, "<p>a", "y"), (2, None, None)]
    got = html_texts(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "a"), (1, TEXT), (1, TEXT), (2, "")]


# 3: mixing


def water(total, children):
    """Whole-number shares of (name, supply, weight), full children first."""
    out, rest = {}, total
    todo = sorted(children, key=lambda c: (c[1] / c[2], c[0]))
    while todo:
        name, supply, weight = todo[0]
        weights = sum(c[2] for c in todo)
        if supply * weights <= rest * weight:
            out[name] = supply
            rest -= supply
            todo = todo[1:]
        else:
            return out | {n: max(0, min(s, rest * w // weights)) for n, s, w in todo}
    return out


def brute_mix(rows, percent, epochs, seed):
    """rows: (doc_id, text, lang, source) -> list of (doc_id, epoch)."""
    leaves = {}
    for i, t, lang, source in rows:
        n = len(re.findall(mixing.TOKEN, t or ""))
        number = re.search("([0-9]{1,9})$", source or "")
        domain = ("web", "news", "books")[int(number[1]) % 3] if number else "web"
        if n:
            leaves.setdefault(domain, {}).setdefault(lang or "unknown", {}).setdefault(source or "unknown", []).append((i, t, n))
    tokens = lambda x: sum(r[2] for r in x) if isinstance(x, list) else sum(map(tokens, x.values()))
    total = tokens(leaves)
    taken = []
    top = water(min(total * percent // 100, total * epochs), [(d, tokens(x) * epochs, mixing.DOMAIN_WEIGHTS.get(d, 1)) for d, x in leaves.items()])
    for d, langs in leaves.items():
        middle = water(top[d], [(k, tokens(x) * epochs, mixing.LANGUAGE_WEIGHTS.get(k, 1)) for k, x in langs.items()])
        for k, sources in langs.items():
            low = water(middle[k], [(s, tokens(x) * epochs, 1) for s, x in sources.items()])
            for s, docs in sources.items():
                before = 0
                for e in range(epochs):
                    for i, _, n in sorted(docs, key=lambda r: (hashlib.md5(f"{seed}:{e}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), hashlib.md5(r[1].encode()).hexdigest())):
                        if before < low[s]:
                            taken.append((i, e))
                        before += n
    return taken


def test_mixing_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(0, 50)), rng.choice(["en", "de", "es", None]), rng.choice([f"src{k}" for k in range(5)] + ["plain", None])) for i in range(300)]
    rows += [(300 + i, prose(rng, 30), "fr", "src0") for i in range(200)] + [rows[7], (None, "a b c", "en", "src1"), (999, None, None, None)]
    frame = spark.createDataFrame([(*r, "clash", 3) for r in rows], "doc_id long, text string, lang string, source string, key string, tokens int")
    for percent, epochs in ((60, 2), (150, 2), (500, 2), (0, 1)):
        got = mixing.mix(frame, percent, epochs, "s").select("doc_id", "epoch", "key").collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.epoch) for r in got) == sorted((i if i is not None else -1, e) for i, e in brute_mix(rows, percent, epochs, "s"))
    assert mixing.mix(frame.limit(0)).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("web", "en", "a", 10), ("web", "en", "b", 1000), ("news", "en", "c", 1000), ("books", "en", "d", 1000)]
    got = mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, language string, leaf string, tokens long"), 10, 1, {"web": 2, "news": 1, "books": 1}, {})
    assert {r.leaf: int(r.budget) for r in got.collect()} == {"a": 10, "b": 140, "c": 75, "d": 75}


# 4: nearest neighbours


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    vectors = (centres[rng.integers(0, 20, 1500)] + 0.5 * rng.normal(size=(1500, 16))).astype(np.float32)
    vectors[100:400] = vectors[100]  # a hot vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)] + [(1500, None, 1), (1600, [0.0] * 16, 1), (1700, [float("nan")] * 16, 1), (1801, [1.0], 1), (200, vectors[200].tolist(), 2)]
    got = nn_descent.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.query_id for r in got} == set(range(0, 1500, 100))
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    right = 0
    for q, answers in found.items():
        answers.sort()
        d = np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(1))
        best = [i for i in sorted(range(1500), key=lambda i: (d[i], i)) if i != q][:10]
        assert [a[0] for a in answers] == list(range(1, 11))
        assert all(abs(a[2] - d[a[1]]) < 1e-12 for a in answers) and [a[1:] for a in answers] == sorted((a[1:] for a in answers), key=lambda a: (a[1], a[0]))
        right += len({a[1] for a in answers} & set(best))
    assert right >= 0.9 * 10 * len(found)
    assert [a[1] for a in found[200]] == list(range(100, 110))


def graph_recall(graph, m, k=20):
    found = {}
    for r in graph.collect():
        found.setdefault(r.src, set()).add(r.dst)
    right = 0
    for i in range(0, len(m), 10):
        d = ((m - m[i]) ** 2).sum(1)
        d[i] = np.inf
        right += len(found[i] & set(np.argsort(d)[:k].tolist()))
    return right / (k * len(range(0, len(m), 10)))


def test_cells_are_split_until_small(spark, monkeypatch):
    """Several levels of splits; no group passes the limit and the graph stays good."""
    monkeypatch.setattr(nn_descent, "GROUP", 60)
    monkeypatch.setattr(nn_descent, "PIVOTS", 40)
    monkeypatch.setattr(nn_descent, "CHUNK", 500)
    m = np.random.default_rng(2).normal(size=(3000, 12)).astype(np.float32)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "node long, vec array<float>")
    folder = nn_descent.shared_dir(spark)
    groups = nn_descent.starting_groups(nodes, folder, 60)
    sizes = [r["count"] for r in groups.groupBy("length", "cell").count().collect()]
    assert max(sizes) <= 60 and len(sizes) > 100 and groups.select("node").distinct().count() == 3000
    assert graph_recall(nn_descent.build_graph(nodes, folder), m) >= 0.9


def test_cells_that_no_split_makes_smaller(spark, monkeypatch):
    """All vectors but one equally far from each other and near the one: a split around nodes leaves a large cell."""
    monkeypatch.setattr(nn_descent, "SPLITS", 2)
    star = [[0.0] * 300] + [[float(i == j) for j in range(300)] for i in range(300)]
    star[0][0] = 0.5
    nodes = spark.createDataFrame(list(enumerate(star)), "node long, vec array<float>")
    sizes = [r["count"] for r in nn_descent.starting_groups(nodes, nn_descent.shared_dir(spark), 50).groupBy("length", "cell").count().collect()]
    assert max(sizes) < 301 and sum(sizes) >= 301


def test_neighbours_in_double_precision_and_of_every_length(spark):
    big = [(0, [16777217.0, 1.0]), (1, [16777216.0, 1.0]), (2, [16777219.5, 1.0]), (100, [1e10 + 1, 1e10]), (3, [1e10, 1e10])]
    rows = [*big, (200, [3.0]), (4, [1.0]), (5, [7.5]), (300, [1.0, 2.0, 3.0]), (6, []), (7, [float("inf"), 1.0]), (400, None), (8, [None, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as dist", "'x' as rank")
    got = {}
    for r in nn_descent.nearest_neighbours(frame).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got[0])[:2] == [(1, 1, 1.0), (2, 2, 2.5)] and sorted(got[100])[0] == (1, 3, 1.0) and len(got[0]) == len(got[100]) == 4
    assert sorted(got[200]) == [(1, 4, 2.0), (2, 5, 4.5)] and 300 not in got and 400 not in got


def test_neighbours_of_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [1.0, 1.0])]
    got = nn_descent.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 8), (2, 7)]
    assert nn_descent.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 5: decontamination


QUESTION = "A train leaves the station with 120 passengers and after the first stop another 45 passengers get on while Maria and Peter walk for 3 km to the old mill near the river"


def test_contamination_by_template(spark):
    filler = prose(random.Random(1), 80)
    other = QUESTION.replace("120", "77").replace("45", "12").replace("Maria", "Helen").replace("3 km", "9 miles")
    mixed = QUESTION.replace("120 passengers and", "88 passengers and").replace("the station with", "the station of 120 with")
    items = [(1, QUESTION), (2, "short two"), (3, None), (4, "alpha beta gamma delta epsilon"), (1, QUESTION)]
    docs = [(1, f"{filler}\n{QUESTION}. {filler}"), (2, f"{filler} {other}, {filler}"), (3, filler), (4, None), (5, ""), (6, "It said: Alpha beta, gamma delta epsilon! Ok"), (7, "short one"), (None, QUESTION), (1, f"{filler}\n{QUESTION}. {filler}"), (8, QUESTION.upper())]
    frame = documents(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame, bench).collect()}
    assert {(1, 1), (2, 1), (6, 4)} <= set(got) <= {(1, 1), (2, 1), (6, 4), (8, 1)}
    assert got[1, 1].changed_slots == 0 and got[1, 1].matched_windows == got[1, 1].item_windows and got[2, 1].changed_slots >= 4
    same = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench, sent_hashes=3).collect()}
    assert same == set(got)
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0 and decontaminate.contaminated(frame.limit(0), bench).count() == 0
    assert mixed != QUESTION


def test_inconsistent_slots_are_no_match(spark):
    item = "we add 5 apples to the big basket then we take 5 apples out of the big basket again and eat them"
    good, bad = item.replace("5", "8"), item.replace("5", "8", 1)
    got = decontaminate.contaminated(documents(spark, [(1, good), (2, bad)]), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r.doc_id for r in got.collect()] == [1]


def test_slot_heavy_items_merged_values_and_line_starts(spark):
    items = [(1, "Sort 9 4 7 1 3 8 2 6"), (2, "What is 12 + 30? Show all the steps of the sum"), (3, "12 45 9 88"), (4, "Describe the long way from the mill to the river bank")]
    docs = [
        (1, "Today we do this:\nSort 9 4 7 1 3 8 2 6\nand so on"), (2, "then What is 15 + 15? Show all the steps of the sum"), (3, "the row 12 45 9 88 ends"), (4, "Sort 9 4 7 6 3 8 2 1"),
        (5, "no stop before\nDescribe the long way from the mill to the river bank"), (6, "the row 12 45 9 87 ends"), (7, "a line\nWhat is 15 + 15? Show all the steps of the sum"),
    ]
    for sent in (2_000_000, 1):
        got = decontaminate.contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), sent_hashes=sent)
        assert {(1, 1), (7, 2), (3, 3), (5, 4)} <= {(r.doc_id, r.item_id) for r in got.collect()} <= {(1, 1), (2, 2), (7, 2), (3, 3), (5, 4)}


def test_short_items_split_slots_and_mixed_windows(spark):
    items = [(1, "Who wrote Faust"), (2, "Yes"), (3, "How far does Maria walk from the station of the town when she walks 3 km a day for two weeks?"), (4, "Name:\nPeter"),
             (5, "Order the list 9 4 7 1 3 8 2 6 5 11 12 13 14 15 16 17 from small to large and say which is the third of them all")]
    docs = [
        (1, "Quiz\nwho wrote Faust?\nGoethe"), (2, "I know who wrote Faust and when"), (3, "yes."), (4, "yes and no"),
        (5, "Then: How far does Anna Lena Schmidt walk from the station of the town when she walks 12km a day for two weeks? Tell."),
        (6, "How far does Maria walk from the station of the city when he runs 3 km a day for two weeks?"), (7, "name: peter"), (8, "Name\nPeter"),
        (9, "say 9 4 7 1 3 8 2 6 5 11 12 13 14 15 16 17 now"), (10, "say 9 4 7 1 3 8 2 6 5 11 12 19 14 15 16 17 now"),
    ]
    for sent in (2_000_000, 1):
        got = decontaminate.contaminated(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), sent_hashes=sent)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (3, 2), (5, 3), (7, 4), (9, 5)}


# 6: personal data


def brute_base(text):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for k, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_pii_equals_brute_force():
    rng = random.Random(2)
    parts = ["a.b@c.de", "x@y", "@", "me@a.b@c.d", "10.0.0.255", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", "00001.2.3.4", " ", "7", "-", ".", "+", "é@ü.de", "12345678901234567890", "٣.1.1.1"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert [f"{k}:{s}:{e}" for k, s, e, _ in pii.find_spans(text) if k in pii.BASE] == brute_base(text), text


def test_pii_checks_and_context(spark):
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 please") == ["iban"] and kinds("iban DE88 3704 0044 0532 0130 00") == []
    assert kinds("born 12.03.1980") == ["birth_date"] and kinds("published 12.03.1980") == [] and kinds("on 12.03.1980") == []
    assert kinds("passport 12345678") == ["id_number"] and kinds("page 12345678") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("order example 123-45-6789") == []
    assert pii.find_spans("9" * 200_000 + "." * 10) == [] and pii.find_spans("a" * 200_000 + "@") == []
    rows = [(1, "mail a@b.de now"), (1, "mail a@b.de now"), (None, None), (2, "")]
    got = pii.pii_report(documents(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.spans, r.base_sha256) for r in got)[2] == (1, 1, "email:5:11", hashlib.sha256(b"email:5:11").hexdigest()) and len(got) == 4
    masked = pii.mask_pii(documents(spark, rows)).collect()
    assert sorted(str(r.text) for r in masked) == ["", "None", "mail [EMAIL] now", "mail [EMAIL] now"] and masked[0].gram == "x"


# 7: suffix arrays


def test_suffix_array_equals_sorting():
    rng = random.Random(4)
    for _ in range(500):
        text = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(data[k : k + 100])
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[i] = (len(data), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def repeats_corpus():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [text(n) for n in (90, 100, 101, 150, 400)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.choice([0, 0, 7]) :] if rng.random() < 0.5 else text(rng.randint(0, 150)) for _ in range(rng.randint(0, 6))]
        rows.append((i, "".join(parts)))
    return rows + [(60, rows[3][1]), (61, "z" * 1000), (62, "zy" * 300), (63, None), (64, ""), (65, passages[4] * 3)]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeats_equal_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = repeats_corpus()
    got = suffix_dedup.remove_repeats(documents(spark, [*rows, rows[8], (None, "q" * 500)]).repartition(3)).collect()
    want = brute_repeats(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None} == want and len(got) == len(rows) + 2
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_one_id_with_two_texts_stays_whole(spark):
    rows = [(1, "k" * 300), (2, "k" * 300), (2, "other"), (3, "k" * 300)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(documents(spark, rows)).collect())
    assert got == [(1, 300, 299), (2, 5, 0), (2, 300, 0), (3, 300, 300)]  # the first string of document 1 starts nowhere earlier


# 8: WARC


def test_archives_round_trip(spark):
    big = "x" * 1200 + "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"
    rows = [(1, "http://www.B.org/a#f", big, 0), (2, "http://b.org/a", big, 0), (3, None, None, 0), (4, "http://a.org/x y", "é" * 600, 0), (5, "", "", 0), (7, "http://a.org", "x" * 999, 0), (8, "http://a.org", "x" * 999, 0), (None, "http://n.org", "n", 0), (9, "http://b.org/a", big, 0), (9, "http://b.org/a", big, 0)]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, captured int")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in by.items() if r.record_type == "revisit"} == {1: ("revisit", 9), 2: ("revisit", 9)}
    order = [r.page_id for r in sorted((r for r in got if r.page_id is not None), key=lambda r: r.capture_no)]
    assert order == [3, 5, 7, 8, 4, 1, 2, 9, 9] or set(order[:2]) == {3, 5}
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_loser_tree_and_ranges(spark):
    rng = random.Random(8)
    for k in range(0, 9):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
    rows = [(i, f"archive{i % 7}", f"key{rng.randint(0, 40)}" if i % 3 else "hot", f"t{rng.randint(0, 5)}") for i in range(900)]
    got = warc.merged_index(spark.createDataFrame(rows, "page_id long, archive string, url_key string, captured string"), warc.shared_dir(spark), range_rows=100).collect()
    want = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[3], r[0]))]
    assert [r.page_id for r in sorted(got, key=lambda r: r.capture_no)] == want and len({r.capture_no for r in got}) == 900


# 9: toxicity


def test_offending_sentence_is_found_and_unlabelled_words_are_not(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        sentences = [prose(rng, 8).replace(".", "") for _ in range(6)]
        toxic = i % 4 == 0
        if toxic:
            sentences[rng.randrange(6)] += " you " + rng.choice(["grub", "blot"])
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "w1. " * 20000), (None, "you grub")]
    docs, marks = documents(spark, rows), spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.toxicity_model(docs, marks)
    got = toxicity.score_documents(docs, model).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth) and len(got) == len(rows)
    text = dict(rows)
    assert all(("grub" in text[r.doc_id][s.start : s.end] or "blot" in text[r.doc_id][s.start : s.end]) for r in got if r.doc_id in truth for s in r.offending)
    assert {r.predicted for r in got if r.doc_id in (1000, 1001, 1002)} == {0} and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 300 + 3
    untaught = toxicity.toxicity_model(docs, marks.limit(0))
    assert toxicity.drop_toxic(docs, untaught).count() == len(rows) and toxicity.score_documents(docs.limit(0), model).count() == 0


def test_noisy_or_combines():
    assert abs(toxicity.noisy_or(np.array([0.0, 0.0])) - 0.75) < 1e-12 and toxicity.noisy_or(np.array([-800.0])) == 0


# 10: URL filters


def test_listed_rules_and_mined_rules(spark):
    rows = [(1, "http://a.example.net/en/x"), (2, "https://X.Example.NET/de"), (3, "ftp://shop.example.com/de/?q=1"), (4, "http://b.org/fr/a#z"), (5, "http://notexample.net/en/"), (6, "http://example.net"), (7, None), (8, "no scheme"), (9, "http://c.io/bad/1"), (9, "http://c.io/bad/1"), (None, "http://c.io/good/2")]
    rows += [(100 + i, f"http://h{i % 5}.io/{'bad' if i % 2 else 'good'}/{i}") for i in range(100)]
    labels = [(100 + i, bool(i % 2)) for i in range(100)] + [(101, None), (None, True)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, tokens string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(labels, "page_id long, blocked boolean"), support=0.05, confidence=0.9).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and by[2] == ("x.example.net", "/de", "net/", "block")
    assert by[3] == ("shop.example.com", "/de/", "example.com/de/", "block") and by[4] == ("b.org", "/fr/a", "org/fr/", "allow")
    assert by[5] == ("notexample.net", "/en/", "net/", "block") and by[6] == ("example.net", "", None, "allow")
    assert by[7] == by[8] == ("", "", None, "allow") and by[9] == ("c.io", "/bad/1", None, "block") and by[None][3] == "allow"
    assert {r.mined for r in got if r.verdict == "block" and r.rule is None} == {"first=bad"}
    assert url_filter.judge_urls(pages, spark.createDataFrame([], "page_id long, blocked boolean")).filter("mined is not null").count() == 0
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(labels, "page_id long, blocked boolean")).count() == 0


def test_columns_named_like_inner_ones_do_no_harm(spark):
    frame = documents(spark, corpus()[:8]).withColumn("seen", F.lit(1)).withColumn("component", F.lit(2)).withColumn("flags", F.lit("f")).withColumn("hash", F.lit("h"))
    assert ngram_join.jaccard_components(frame).count() == 8 and suffix_dedup.remove_repeats(frame).count() == 8
    assert pii.pii_report(frame).count() == 8 and mixing.mix(frame).columns[: len(frame.columns)] == frame.columns
