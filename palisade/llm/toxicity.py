"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence s has the score sigmoid(b + sum of the weights of its distinct words); a word weighs what its features (the word and its prefixes)
weigh together. A document has the noisy-or 1 - prod(1 - s). Only document labels are known, so the weights are fitted to the documents'
noisy-or (log loss, Adagrad, an L1 step that clears features without evidence). Features are first chosen by how much more often they occur
in documents of one class (support, ratio and z-score), so rare words of single documents teach nothing. The offending sentences are
those whose own score reaches 0.5, or the strongest one. A sentence without any chosen feature counts 0, however many there are.

The model is fitted on a bounded sample: at most `SAMPLE` labelled documents of each class in the order of a hash of the id (a documented
parameter; the rows are chosen by Spark and only they reach the driver). The model is at most `FEATURES` weights, so sending it to the tasks
has a fixed bound. Scoring reads every text whole in one map pass.
Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE = 2000  # labelled documents per class at most; their whole texts are read
FEATURES = 4000
PREFIXES = (3, 4, 5, 6, 7, 8)
MIN_DOCS, MIN_SHARE, RATIO, Z = 4, 0.01, 3.0, 4.0  # a feature's documents of its class (number, share), how much more often than in the other, z-score
EPOCHS, RATE, SPARSE = 100, 0.5, 1e-3
START = -10.0  # bias at the start: many harmless sentences must not add up to a toxic document
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
_STRIP = ".,;:!?\"'()[]{}<>*_-"


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)


def sentence_words(sentence: str) -> list[str]:
    return [w for w in (x.strip(_STRIP) for x in sentence.lower().split()) if w]


def noisy_or(scores: np.ndarray) -> float:
    """1 - prod(1 - sigmoid(z)) in logs: log(1 - sigmoid(z)) = -log(1 + e^z)."""
    return float(-np.expm1(-np.logaddexp(0, scores).sum()))


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) >= k)]


@dataclass
class _Lists:
    indptr: np.ndarray
    indices: np.ndarray


def _chosen(words: list[str], bags: list[np.ndarray], y: np.ndarray) -> tuple[_Lists, list[str]]:
    """Features that tell the classes apart: their numbers per word, and their names."""
    table: dict[str, int] = {}
    lists = [[table.setdefault(f, len(table)) for f in features_of(w)] for w in words]
    found = np.zeros((2, len(table)))
    for bag, label in zip(bags, y, strict=True):
        here = np.unique(np.fromiter((f for w in bag for f in lists[w]), np.int64))
        found[int(label)][here] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])[:, None]
    p = found / n
    pooled = found.sum(0) / n.sum()
    z = (p[1] - p[0]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n[0, 0] + 1 / n[1, 0]))
    smooth = (found + 0.5) / (n + 1)
    top = np.where(z > 0, found[1], found[0])
    share = np.where(z > 0, p[1], p[0])
    ratio = np.where(z > 0, smooth[1] / smooth[0], smooth[0] / smooth[1])
    good = np.flatnonzero((np.abs(z) >= Z) & (top >= MIN_DOCS) & (share >= MIN_SHARE) & (ratio >= RATIO))
    names = list(table)
    good = sorted(good.tolist(), key=lambda i: (-abs(z[i]), names[i]))[:FEATURES]
    number = np.full(len(names), -1, np.int64)
    number[good] = np.arange(len(good))
    kept = [[number[f] for f in fs if number[f] >= 0] for fs in lists]
    return _Lists(np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int64), np.fromiter((f for k in kept for f in k), np.int64)), [names[i] for i in good]


def train(texts: list[str | None], labels: list[int]) -> Model:
    """Fit on documents in memory; without both classes the score is the constant of a model that never fires."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model()
    vocabulary: dict[str, int] = {}
    bags = []
    for text in texts:
        bag = [np.array(sorted({vocabulary.setdefault(w, len(vocabulary)) for w in sentence_words(s)}), np.int32) for s in SENTENCE.findall(text or "")]
        bags.append(bag or [np.zeros(0, np.int32)])
    pairs, names = _chosen(list(vocabulary), [np.unique(np.concatenate(b)) for b in bags], y)
    index = [x for b in bags for x in b]
    counts = [len(b) for b in bags]
    sizes = np.diff(pairs.indptr)
    at = np.concatenate(index).astype(np.int64)
    sentence = np.repeat(np.repeat(np.arange(len(index)), [len(x) for x in index]), sizes[at])
    word = np.concatenate([np.zeros(0, np.int64), *(pairs.indices[pairs.indptr[i] : pairs.indptr[i + 1]] for i in at[sizes[at] > 0])]).astype(np.int64)
    words = names
    document = np.repeat(np.arange(len(counts)), counts)
    telling, sentence = np.unique(sentence, return_inverse=True)  # sentences with a feature; the others count 0
    document = document[telling]
    weight, bias = np.zeros(len(words)), START
    speed_w, speed_b = np.full(len(words), 1e-8), 1e-8
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(EPOCHS):
        z = bias + np.bincount(sentence, weight[word], minlength=len(telling))
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(-np.bincount(document, np.logaddexp(0, z), minlength=len(y)))
        p = np.clip(1 - none, 1e-6, 1 - 1e-6)
        # d loss / d z: for y = 0 the sentence's own score; for y = 1 minus its share of the responsibility, (1 - p) / p * s
        slope = np.where(y == 1, -(1 - p) / p, 1.0) * balance / len(y)
        dz = slope[document] * s
        gw, gb = np.bincount(word, dz[sentence], minlength=len(words)), dz.sum()
        speed_w += gw**2
        speed_b += gb**2
        step = RATE / np.sqrt(speed_w)
        weight -= step * gw
        weight = np.sign(weight) * np.maximum(np.abs(weight) - step * SPARSE / 10, 0)
        bias -= RATE / np.sqrt(speed_b) * gb
    kept = np.flatnonzero(np.abs(weight) > 1e-3)
    return Model(float(bias), {words[i]: float(weight[i]) for i in kept})


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """(text, label): at most `per_class` labelled documents of each class, by a hash of the id. The first pick per slice needs no shuffle of texts.

    An id with several texts teaches its smallest one.
    """
    known = labels.filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    slices = known.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    local = slices.withColumn("r", F.row_number().over(Window.partitionBy("label", "slice").orderBy(*order))).filter(F.col("r") <= per_class)
    chosen = local.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(*order))).filter(F.col("r") <= per_class).select("doc_id", "label")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # at most 2 * per_class rows of two numbers
    return found.orderBy("doc_id").select("text", "label")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sample(docs, labels).toArrow()
    return train(rows.column("text").to_pylist(), rows.column("label").to_pylist())


class WordWeights(dict):
    """word -> weight of its features together, remembered for at most `limit` words."""

    def __init__(self, model: Model, limit: int = 200_000):
        super().__init__()
        self.weights, self.limit = model.weights, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = sum(self.weights.get(f, 0.0) for f in features_of(word))
        return value


def score_text(text: str | None, model: Model, known: WordWeights | None = None) -> tuple[float, list[tuple[int, int, float]], int]:
    """(noisy-or, offending sentences as (start, end, score), number of sentences). Offsets are code points."""
    known = WordWeights(model) if known is None else known
    z, spans = [], []
    for m in SENTENCE.finditer(text or ""):
        spans.append(m.span())
        weights = [w for w in map(known.__getitem__, set(sentence_words(m[0]))) if w]
        z.append(model.bias + sum(weights) if weights else -np.inf)
    values = np.array(z, float)
    own = 1 / (1 + np.exp(-np.clip(values, -700, 700)))
    total = noisy_or(values) if z else 0.0
    bad = np.flatnonzero(own >= 0.5)
    if total >= 0.5 and not len(bad):
        bad = np.array([own.argmax()])
    return min(1.0, max(0.0, total)), [(*spans[i], float(own[i])) for i in bad], len(z)


_SCORES = "doc_id long, score double, predicted int, n_sentences int, offending array<struct<start:int,end:int,score:double>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _scorer(model: Model):
    def run(batches):
        known = WordWeights(model)
        for batch in batches:
            rows = [score_text(text.as_py(), model, known) for text in batch.column(1)]
            spans = [[{"start": a, "end": b, "score": s} for a, b, s in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([int(r[0] >= 0.5) for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array(spans, _SPAN)],
                names=["doc_id", "score", "predicted", "n_sentences", "offending"],
            )

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of `docs`: doc_id, score, predicted, n_sentences, offending. Null or empty text: score 0."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(_scorer(model), _SCORES)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted on `labels.toxic` of the rows outside the held-out fold."""
    return fit(docs, labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label")))


def _clean(model: Model):
    def run(batches):
        known = WordWeights(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([score_text(t.as_py(), model, known)[0] < 0.5 for t in texts], pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, all columns as they are; null and empty texts stay."""
    return docs.mapInArrow(_clean(model), docs.schema)
