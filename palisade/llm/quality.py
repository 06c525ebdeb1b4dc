"""Quality of documents by supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams of words are hashed to rows of one table of learned vectors. A word is the average of its own
row and those of its n-grams; a document is the average of its words and of its word pairs; a softmax layer over that vector gives the class. Vectors
and layer are trained together by stochastic gradient descent in numpy, document by document. A pair of equal words is one feature, whatever the
word, so stuttering text is seen in words never met in training.

The model is fitted on a bounded sample: at most `SAMPLE` labelled documents of each class in the order of a hash of the id (a documented parameter),
whole texts. Classes weigh alike in training; the layer's bias is then moved by the logarithm of the classes' odds among all labels, so that a score
is the probability of label 1 among documents like the labelled ones. A document's score needs of the table only each row's part in
the difference of the two outputs (`ROWS` numbers), which is what tasks get. Labels, language, source and id are no inputs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.toxicity import held_out

SAMPLE = 1500  # labelled documents of each class at most
ROWS, WIDTH = 1 << 17, 12  # hashed rows of the table, numbers of a vector
GRAMS = (3, 4)
EPOCHS, RATE = 6, 0.1
CUT = 0.3  # predicted 1 from this score on
BLOCK, HELD = 1_000_000, 400_000  # code points of a text handled at once; words, and n-grams, a task remembers
SEED = 20240613
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def row_of(feature: bytes) -> int:
    return xxhash.xxh3_64_intdigest(feature) % ROWS


def grams_of(word: str) -> list[str]:
    """Character n-grams of a word, its ends marked."""
    marked = f"<{word}>"
    return [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]


def word_row(word: str) -> int:
    return row_of(b"w" + word.encode("utf-8", "replace"))


def gram_row(gram: str) -> int:
    return row_of(b"g" + gram.encode("utf-8", "replace"))


def rows_of_word(word: str) -> list[int]:
    """Rows of a word and of its character n-grams."""
    return [word_row(word), *map(gram_row, grams_of(word))]


SAME = row_of(b"pair of equal words")


def pair_rows(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (hashes[:-1] * _P) ^ (hashes[1:] * _Q)
        mixed ^= mixed >> np.uint64(31)
        rows = ((mixed * _P) >> np.uint64(20)) % np.uint64(ROWS)
    return np.where(hashes[:-1] == hashes[1:], SAME, rows.astype(np.int64))


def blocks(text: str | None) -> Iterator[list[str]]:
    """The words of a text, a block of about BLOCK code points at a time."""
    text, at = text or "", 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end].split()
        at = end


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))


def document_rows(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, weights) of a document's average: the words' part and the pairs' part sum to 1 each. At most ROWS of them."""
    counts: Counter = Counter()
    total, pairs, last = np.zeros(ROWS), np.zeros(ROWS), np.zeros(0, np.uint64)
    for tokens in blocks(text):
        counts.update(tokens)
        hashes = np.concatenate([last, np.fromiter(map(word_hash, tokens), np.uint64, len(tokens))])
        np.add.at(pairs, pair_rows(hashes), 1.0)
        last = hashes[-1:]
    n = counts.total()
    for word, count in counts.items():
        rows = rows_of_word(word)
        for row in rows:
            total[row] += count / (len(rows) * n)
    total += pairs / max(1, n - 1)
    rows = np.flatnonzero(total)
    return rows.astype(np.int32), total[rows].astype(np.float32)


@dataclass
class Model:
    parts: np.ndarray  # per row its part in output 1 minus output 0
    bias: float


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int], odds: float | None = None, seed: int = SEED) -> Model:
    """Softmax over averaged vectors by stochastic gradient descent (Adagrad steps that fall to 0), from `document_rows` of each document.

    `odds` are those of label 1 to 0 where the model is used, else those of the given labels. Without both classes the score is a constant: near the
    label there is, 1/2 without any.
    """
    y = np.array(labels, np.int64)
    ones, zeros = int((y == 1).sum()), int((y == 0).sum())
    if not ones or not zeros:
        return Model(np.zeros(ROWS, np.float32), 5.0 * ((ones > 0) - (zeros > 0)))
    rng = np.random.default_rng(seed)
    table = (rng.random((ROWS, WIDTH)) - 0.5) / WIDTH
    layer, bias = np.zeros((WIDTH, 2)), np.zeros(2)
    weigh = np.array([0.5 * len(y) / zeros, 0.5 * len(y) / ones])
    squares_t, squares_l, squares_b = np.full(ROWS, 1e-6), np.full((WIDTH, 2), 1e-6), np.full(2, 1e-6)
    steps = [d for _ in range(EPOCHS) for d in rng.permutation(len(docs))]
    for done, d in enumerate(steps):
        rate = RATE * (1 - done / len(steps))
        rows, w = docs[d]
        if not len(rows):
            continue
        v = w @ table[rows]
        out = v @ layer + bias
        slope = np.exp(out - out.max())
        slope /= slope.sum()
        slope[y[d]] -= 1
        slope *= weigh[y[d]]
        back, outer = layer @ slope, np.outer(v, slope)
        squares_l += outer**2
        squares_b += slope**2
        squares_t[rows] += w**2 * (back @ back) / WIDTH
        layer -= rate * outer / np.sqrt(squares_l)
        bias -= rate * slope / np.sqrt(squares_b)
        table[rows] -= (rate * w / np.sqrt(squares_t[rows]))[:, None] * back[None]
    odds = ones / zeros if odds is None else odds
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0] + np.log(odds)))


def _features(batches):
    for batch in batches:
        found = [document_rows(t.as_py()) for t in batch.column(1)]
        rows, weights = pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), rows, weights], names=["label", "rows", "weights"])


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[DataFrame, float | None]:
    """(label, rows, weights) of at most `per_class` labelled documents of each class, by a hash of the id; odds of label 1 to 0 among all labels.

    An id with two labels has the larger, one with two texts the smaller. Texts become features in tasks: the driver gets at most ROWS numbers a document.
    """
    known = labels.filter("label in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))
    counts = dict(known.groupBy("label").count().collect())
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = known.filter("label = 0").orderBy(*order).limit(per_class).unionByName(known.filter("label = 1").orderBy(*order).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # at most 2 * per_class rows of two numbers are sent
    spread = found.repartition(16, "doc_id").sortWithinPartitions("doc_id").select("label", "text")
    rows = spread.mapInArrow(_features, "label int, rows array<int>, weights array<float>")
    return rows, counts[1] / counts[0] if counts.get(0) and counts.get(1) else None


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    rows, odds = sample(docs, labels, per_class)
    held = rows.toArrow()
    features = [(r.values.to_numpy(), w.values.to_numpy()) for r, w in zip(held.column("rows"), held.column("weights"), strict=True)]
    by_label = sorted(range(len(features)), key=lambda i: (held.column("label")[i].as_py(), len(features[i][0]), features[i][1].tobytes()))  # whatever the order of tasks
    return train([features[i] for i in by_label], [held.column("label")[i].as_py() for i in by_label], odds)


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted on `labels.quality` of the rows outside the held-out fold."""
    return fit(docs, labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label")))


class GramParts(dict):
    """n-gram -> its part."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, gram: str) -> float:
        if len(self) >= HELD:
            self.clear()
        value = self[gram] = float(self.model.parts[gram_row(gram)])
        return value


class WordParts(dict):
    """word -> number; hashes and parts by number. Forgets all beyond HELD words."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.grams = model, GramParts(model)
        self.hashes, self.parts = np.zeros(1024, np.uint64), np.zeros(1024)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        if n == len(self.parts):
            self.hashes, self.parts = np.resize(self.hashes, 2 * n), np.resize(self.parts, 2 * n)
        self.hashes[n] = word_hash(word)
        grams = grams_of(word)
        self.parts[n] = (float(self.model.parts[word_row(word)]) + sum(map(self.grams.__getitem__, grams))) / (1 + len(grams))
        return n


def score_text(text: str | None, model: Model, known: WordParts | None = None) -> float:
    """Probability of label 1. A text without words has that of the bias."""
    known = WordParts(model) if known is None else known
    words = pairs = 0.0
    n, last = 0, np.zeros(0, np.uint64)
    for tokens in blocks(text):
        if len(known) > HELD:
            known.clear()
        numbers = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        hashes = np.concatenate([last, known.hashes[numbers]])
        words += known.parts[numbers].sum()
        pairs += model.parts[pair_rows(hashes)].sum(dtype=np.float64)
        n += len(tokens)
        last = hashes[-1:]
    z = model.bias + words / max(1, n) + pairs / max(1, n - 1)
    return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def _scorer(model: Model):
    def run(batches):
        known = WordParts(model)
        for batch in batches:
            scores = [score_text(t.as_py(), model, known) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= CUT) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, score, predicted. Null and empty texts have the score of no words; further columns are not read."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(_scorer(model), "doc_id long, score double, predicted int")
