"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point, and the form each should take.

Words come from whole texts in one map pass that counts them before anything is shuffled. Near words are found by dense tiling: words lie in
padded matrices of code points, once aligned left and once right; a block of rows is compared with a block of rows at once, column by column, for
the lengths of the common prefix and the common suffix. A pair is a single edit where both together reach the longer length minus one.

Which blocks meet is settled by a split that loses no pair: where the rest of two words (beyond what they are known to share) has r code
points and one edit, they share its first or its last r // 2. A bucket holds the words of length L and L - 1 that share some prefix and suffix; a
bucket beyond `BUCKET` words is split in two such ways, until at most one code point is open, where it has at most as many words as the alphabet has
letters, and one. So no tile grows with the vocabulary. Small buckets are packed into tiles of about `TILE` rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import save, shared_dir

RUN = re.compile("[a-zÀ-ÿ]+")
DAMAGE = 97
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
BUCKET, TILE, BLOCK = 256, 1024, 64  # words of a bucket before it is split; rows of a tile; rows compared at once
HELD, LONG = 200_000, 1_000_000  # distinct words a task holds before it hands them on; texts over LONG code points are read run by run


def text_words(doc_id: str, text: str | None) -> Counter:
    """Words of a text after the damage, with their counts. A-Z are lower-cased, other letters stay."""
    low = (text or "").encode("utf-8", "replace").lower().decode("utf-8", "replace")
    runs = Counter(RUN.findall(low) if len(low) <= LONG else (m[0] for m in RUN.finditer(low)))
    start = zlib.crc32(f"{doc_id}:".encode())
    found: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= MIN_LENGTH:
            found[run] += n
    return found


def _count_words(batches):
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            held.update(text_words(doc_id.as_py(), text.as_py()))
            if len(held) >= HELD:
                yield out()
                held.clear()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of `docs` (doc_id, text) of MIN_LENGTH code points and MIN_COUNT occurrences. A null doc_id counts as an empty one."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    counted = texts.mapInArrow(_count_words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _matrix(words: list[bytes], width: int, left: bool) -> np.ndarray:
    """Code points (all below 256) of the words, one row each, padded with 0 on the right, or on the left for suffixes."""
    pad = bytes.ljust if left else bytes.rjust
    return np.frombuffer(b"".join(pad(w, width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def _common(a: np.ndarray, b: np.ndarray, columns: range) -> np.ndarray:
    """For every row of `a` and every row of `b` how many of `columns` agree from the first on."""
    alive = np.ones((len(a), len(b)), bool)
    total = np.zeros((len(a), len(b)), np.int32)
    for c in columns:
        alive &= a[:, c, None] == b[None, :, c]
        if not alive.any():
            break
        total += alive
    return total


def single_edits(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, long_rows: np.ndarray, lo: int, hi: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) of single edits between the block `long_rows` (words of `length`) and the rows lo to hi (that length or one less)."""
    prefix = _common(left[long_rows], left[lo:hi], range(length))
    suffix = _common(right[long_rows], right[lo:hi], range(length - 1, -1, -1))
    shorter = sizes[lo:hi]
    both = np.minimum(prefix, shorter) + np.minimum(suffix, shorter)
    a, b = np.nonzero((both >= length - 1) & (prefix < length))
    return long_rows[a], b + lo


def _tile(table: pa.Table) -> pa.Table:
    """The buckets of one tile (word, n, length, key) -> near pairs."""
    order = np.argsort(table.column("key").to_numpy(), kind="stable")
    key = table.column("key").to_numpy()[order]
    n = table.column("n").to_numpy()[order]
    names = np.array(table.column("word").to_pylist(), object)[order]
    words = [w.encode("latin-1") for w in names]
    length = table.column("length")[0].as_py()
    sizes = np.fromiter(map(len, words), np.int32)
    left, right = _matrix(words, length, True), _matrix(words, length, False)
    first, last = np.searchsorted(key, key, "left"), np.searchsorted(key, key, "right")
    tall = np.flatnonzero(sizes == length)
    found = []
    for at in range(0, len(tall), BLOCK):
        rows = tall[at : at + BLOCK]
        a, b = single_edits(left, right, sizes, rows, first[rows[0]], last[rows[-1]], length)
        keep = (key[a] == key[b]) & ((sizes[b] < length) | (a < b))
        found.append((a[keep], b[keep]))
    a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    swap = names[a] > names[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return pa.table({"a": pa.array(names[a], pa.string()), "a_n": pa.array(n[a], pa.int64()), "b": pa.array(names[b], pa.string()), "b_n": pa.array(n[b], pa.int64())})


def near_pairs(words: DataFrame, folder: str) -> DataFrame:
    """(a, a_n, b, b_n): every pair of `words` (word, n) one edit apart, once, a before b."""
    rest = F.col("length") - F.col("p") - F.col("s")
    key = F.xxhash64("length", "p", "s", F.expr("left(word, p)"), F.expr("right(word, s)"))

    def halves(rows: DataFrame) -> DataFrame:
        h = F.floor(rest / 2).cast("int")
        cuts = F.array(F.struct((F.col("p") + h).alias("p"), F.col("s").alias("s")), F.struct(F.col("p").alias("p"), (F.col("s") + h).alias("s")))
        return rows.withColumn("cut", F.explode(cuts)).select("word", "n", "length", F.col("cut.p").alias("p"), F.col("cut.s").alias("s")).withColumn("key", key)

    roles = words.withColumn("length", F.explode(F.array(F.length("word"), F.length("word") + 1))).withColumns({"p": F.lit(0), "s": F.lit(0)})
    level, closed = save(halves(roles), folder, "level-0"), []
    while True:
        large = level.filter(rest > 1).groupBy("length", "key").count().filter(F.col("count") > BUCKET).select("length", "key", F.lit(True).alias("large"))
        large = save(large, folder, f"large-{len(closed)}")
        marked = level.join(large, ["length", "key"], "left")
        closed.append(marked.filter("large is null").select("word", "n", "length", "key"))
        if large.isEmpty():
            break
        level = save(halves(marked.filter("large")), folder, f"level-{len(closed)}")
    rows = closed[0]
    for more in closed[1:]:
        rows = rows.unionByName(more)
    tiles = rows.groupBy("length").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.greatest(F.lit(1.0), F.col("length") / 32) / TILE)).alias("tiles"))
    dealt = rows.join(tiles, "length").withColumn("tile", F.pmod("key", "tiles")).select("word", "n", "length", "key", "tile")
    return dealt.groupBy("length", "tile").applyInArrow(_tile, "a string, a_n long, b string, b_n long").distinct()


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) for every row of `forms` (word, form): where following forms ends.

    A form is at least RATIO times as frequent as the word, so there are at most log2 of the largest count rounds; a round adds the words whose form was
    reached in the one before. A key of its join has at most as many rows as a word has near words.
    """
    level = save(forms.filter("form is null").select("word", F.col("word").alias("root")), folder, "roots-0")
    all_levels, below = level, forms.filter("form is not null")
    step = 0
    while not level.isEmpty():
        step += 1
        level = save(below.join(level.select(F.col("word").alias("form"), "root"), "form").select("word", "root"), folder, f"roots-{step}")
        all_levels = all_levels.unionByName(level)
    return all_levels


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word of `docs` (doc_id, text): word, form, root, n, n_near, form_n.

    Null texts have no words, a null doc_id counts as an empty one, repeated rows count again. Ties of n go to the smallest form in code-point order.
    Without documents or words there are no rows.
    """
    folder = shared_dir(docs.sparkSession)
    words = save(vocabulary(docs), folder, "words")
    pairs = save(near_pairs(words, folder), folder, "pairs")
    ends = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    ends = ends.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    takes = -F.col("best.less") >= RATIO * F.col("n")
    rows = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")
    )
    rows = save(rows, folder, "forms")
    return rows.join(roots(rows.select("word", "form"), folder), "word").select("word", "form", "root", "n", "n_near", "form_n")
