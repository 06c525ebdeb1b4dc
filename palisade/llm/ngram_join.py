"""N-gram Jaccard self-join by vertical partitioning.

Two documents link when 100 * |A & B| >= 80 * |A | B| over their sets of distinct five-word shingles. The n-grams have one
global order, which is cut into fragments; a set is cut into one segment per fragment, overlaps are counted per fragment
and summed per pair.

1. Over the order by hash, only the lowest `2(1-t)` of each set are sent to their fragments. With `k = ceil((1-t) n)`, the first
   k common n-grams of a linked pair lie in that part of both sets, so a document of which fewer than k are seen elsewhere
   has no link and is done. An n-gram met twice in a chunk travels once, so common n-grams make no hot fragment.
2. The few documents left get the order by (document frequency, hash). Equal sets are one node.
3. Candidates share an n-gram of their prefixes. First every document of a posting list is compared with the smallest one of the list
   (a star, linear in the list). Lists whose documents are then all in one component are done; in the others pairs of different
   components are compared when the sum over fragments of the smaller segment size can reach the threshold.
4. Per pair and fragment the overlap of the segments is counted; the sums decide.

No list is capped; the result has the links' components exactly (up to 64-bit hash collisions of shingles).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import WordHashes, components, offsets, save, shared_dir, windows

SHINGLE, PERCENT, FRAGMENTS = 5, 80, 16
CHUNK = 1_500_000  # n-grams a map task packs at a time
BLOCK = 1000  # documents of a posting list that are compared with as many others in one task


def shingle_set(text: str | None, words: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a shorter text is one shingle; no words: empty."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII lower case and ASCII blanks only
    if not tokens:
        return np.zeros(0, np.uint64)
    return np.unique(windows(words.of(tokens), min(size, len(tokens))))


def _low(n: int, percent: int) -> int:
    return min(n, -(-2 * (100 - percent) * n // 100) + 2)


def _pack(values: np.ndarray) -> bytes:
    """48 bits of each hash: a collision only spares a document from early pruning."""
    return (values >> np.uint64(16)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(">u8").astype(np.uint64)


_PIECES = pa.schema([("fragment", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())])


def _segments(size: int, percent: int, fragments: int):
    """Map side: low part of each set, packed per (chunk, fragment); fragment -1-x passes (doc, size, n-grams known to repeat)."""
    cut = np.uint64(int(2**64 * 2 * (100 - percent) / 100) if percent > 50 else 2**64 - 1)
    head = max(1, fragments * 4 // 5)
    tail = max(1, fragments - head)

    def fragment_of(h: np.ndarray) -> np.ndarray:
        low = h // (cut // np.uint64(head) + np.uint64(1))
        high = head + (h - cut) // ((np.uint64(2**64 - 1) - cut) // np.uint64(tail) + np.uint64(1))
        return np.where(h < cut, low, high).astype(np.int32)

    def chunk(ids: list[int], sizes: list[int], lows: list[np.ndarray]):
        grams = np.concatenate(lows) if lows else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(ids), dtype=np.int64), [len(x) for x in lows])
        kinds, where, times = np.unique(grams, return_inverse=True, return_counts=True)
        known = np.bincount(doc[times[where] > 1], minlength=len(ids))
        docs = np.array(ids, np.int64)
        rows = [(-1 - int(docs[0] % 16), docs.tobytes(), np.stack([np.array(sizes, np.int64), known]).astype(np.int64).tobytes(), b"")]
        single = times[where] == 1
        of_one, doc_one = grams[single], doc[single]
        part = fragment_of(of_one)
        order = np.lexsort((of_one, doc_one, part))
        part, of_one, doc_one = part[order], of_one[order], doc_one[order]
        many = kinds[times > 1]
        part_many = fragment_of(many)
        for f in np.union1d(part, part_many):
            lo, hi = np.searchsorted(part, [f, f + 1])
            who, count = np.unique(doc_one[lo:hi], return_counts=True)
            extra = many[part_many == f]
            rows.append((int(f), docs[who].tobytes(), count.astype(np.uint32).tobytes(), _pack(np.concatenate([of_one[lo:hi], extra]))))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECES.types, strict=True)], schema=_PIECES)

    def run(batches):
        words = WordHashes()
        ids, sizes, lows, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = shingle_set(text.as_py(), words, size)
                ids.append(doc_id)
                sizes.append(len(grams))
                lows.append(grams[: _low(len(grams), percent)])
                held += len(lows[-1]) + 8
                if held >= CHUNK:
                    yield chunk(ids, sizes, lows)
                    ids, sizes, lows, held = [], [], [], 0
        if ids:
            yield chunk(ids, sizes, lows)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Reduce side of a fragment: per document, how many of its n-grams are seen elsewhere too."""
    if table.num_rows and table.column("fragment")[0].as_py() < 0:
        docs = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()])
        both = [np.frombuffer(x, np.int64).reshape(2, -1) for x in table.column("counts").to_pylist()]
        return pa.table({"doc_id": docs, "n": np.concatenate([x[0] for x in both]), "seen": np.concatenate([x[1] for x in both])})
    grams, owners = [], []
    for docs, counts, packed in zip(*(table.column(c).to_pylist() for c in ("docs", "counts", "grams")), strict=True):
        values = _unpack(packed)
        owner = np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(counts, np.uint32))
        extra = values[len(owner) :]  # met twice in their chunk: listed twice, without an owner
        grams.append(np.concatenate([values, extra]))
        owners.append(np.concatenate([owner, np.full(2 * len(extra), np.iinfo(np.int64).min)]))
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(grams, kind="stable")
    grams, owners = grams[order], owners[order]
    same = grams[1:] == grams[:-1]
    again = np.zeros(len(grams), bool)
    again[1:] |= same
    again[:-1] |= same
    docs, seen = np.unique(owners[again], return_counts=True)
    keep = docs != np.iinfo(np.int64).min
    return pa.table({"doc_id": docs[keep], "n": np.full(keep.sum(), -1, np.int64), "seen": seen[keep].astype(np.int64)})


_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("grams", pa.list_(pa.int64()))])


def _sets(size: int):
    def run(batches):
        words = WordHashes()
        for batch in batches:
            sets = [shingle_set(text.as_py(), words, size) for text in batch.column(1)]
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets(len(s) for s in sets)), pa.array(values))
            digests = pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), digests, lists], schema=_SETS)

    return run


def document_stats(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, seen): set size and how many n-grams of the low part are seen in another document or row."""
    fragments = max(16, docs.rdd.getNumPartitions() // 2)
    pieces = docs.mapInArrow(_segments(size, percent, fragments), "fragment int, docs binary, counts binary, grams binary")
    seen = pieces.groupBy("fragment").applyInArrow(_repeated, "doc_id long, n long, seen long")
    return seen.groupBy("doc_id").agg(F.max("n").alias("n"), F.sum("seen").alias("seen"))


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, na, nb, overlap): partial overlaps per fragment, summed per pair."""
    left = segments.select(F.col("doc").alias("a"), "fragment", F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = segments.select(F.col("doc").alias("b"), "fragment", F.col("n").alias("nb"), F.col("grams").alias("gb"))
    return (
        pairs.join(left, "a").join(right, ["b", "fragment"])
        .groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum(F.size(F.array_intersect("ga", "gb"))).alias("overlap"))
    )


def _dealt(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of posting lists with themselves: a list of more than BLOCK documents is cut into blocks, and every pair of blocks (low, high) is a key
    of its own, so no task compares a whole list."""
    blocks = postings.groupBy("gram").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = postings.join(blocks, "gram").withColumn("own", F.pmod(F.xxhash64("doc"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keep = [c for c in postings.columns if c != "gram"]
    return own.select("gram", F.col("own").alias("low"), F.col("with").alias("high"), *keep), own.select("gram", F.col("with").alias("low"), F.col("own").alias("high"), *keep)


def jaccard_links(docs: DataFrame, folder: str, size: int = SHINGLE, percent: int = PERCENT, fragments: int = FRAGMENTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stats, members, links): per doc_id its set size; documents that may link with the smallest doc_id of an equal set; links (a, b) between such nodes.

    `docs` has doc_id and text, doc_id not null. Links inside a component found by the first stars are not all listed.
    """
    low = f"(({100 - percent} * n + 99) div 100)"
    stats = save(document_stats(docs, size, percent), folder, "stats")
    left = stats.filter(f"n > 0 and seen >= {low}").select("doc_id")
    sets = save(docs.join(left, "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id long, n long, digest binary, grams array<long>"), folder, "sets")
    nodes = sets.groupBy("digest").agg(F.min("doc_id").alias("doc"))
    members = save(sets.select("doc_id", "digest").distinct().join(nodes, "digest").select("doc_id", "doc"), folder, "members")
    heads = sets.join(nodes.withColumnRenamed("doc", "doc_id"), ["digest", "doc_id"], "left_semi").dropDuplicates(["digest", "doc_id"])
    grams = heads.select(F.col("doc_id").alias("doc"), "n", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = grams.join(often, "gram").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    ordered = save(ordered, folder, "ordered")  # n-grams of a single document come first in the order and are left out: n tells how many

    place = F.expr("g.df + (g.gram / 18446744073709551616.0 + 0.5) * 0.999")
    cuts = ordered.select(F.explode("grams").alias("g")).select(place.alias("p")).approxQuantile("p", [i / fragments for i in range(1, fragments)], 0.002)
    cut = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    fragment = F.size(F.filter(cut, lambda c: c <= place)).alias("fragment")
    segments = ordered.select("doc", "n", F.explode("grams").alias("g")).select("doc", "n", fragment, F.col("g.gram").alias("gram")).groupBy("doc", "n", "fragment").agg(F.collect_list("gram").alias("grams"))
    segments = save(segments, folder, "segments")
    counts = segments.groupBy("doc").agg(*[F.sum(F.when(F.col("fragment") == i, F.size("grams")).otherwise(0)).alias(f"f{i}") for i in range(fragments)])

    prefix = ordered.withColumn("k", F.expr(f"n - (({percent} * n + 99) div 100) + 1 - (n - size(grams))")).filter("k > 0")
    postings = prefix.select("doc", "n", F.explode(F.slice("grams", F.lit(1), F.col("k").cast("int"))).alias("g")).select("doc", "n", F.col("g.gram").alias("gram"))
    lists = postings.groupBy("gram").agg(F.min("doc").alias("hub"), F.count("*").alias("c")).filter("c > 1").select("gram", "hub")
    star = postings.join(lists, "gram").filter("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    enough = f"100 * overlap >= {percent} * (na + nb - overlap)"
    links = save(_overlaps(star, segments).filter(enough).select("a", "b"), folder, "links-star")

    labels = components(links, folder, "star")
    known = postings.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = known.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("doc").alias("hub")).filter("low < high").select("gram", "hub")
    rest = known.join(mixed, "gram").filter("doc <> hub").join(counts, "doc").select("gram", "doc", "n", "component", *[f"f{i}" for i in range(fragments)])
    left, right = _dealt(rest)
    other = right.select("gram", "low", "high", *[F.col(c).alias(f"o_{c}") for c in rest.columns if c != "gram"])
    reach = " + ".join(f"least(f{i}, o_f{i})" for i in range(fragments))
    pairs = left.join(other, ["gram", "low", "high"]).filter(F.expr(f"doc < o_doc and component <> o_component and 100 * least(n, o_n) >= {percent} * greatest(n, o_n) and {100 + percent} * ({reach}) >= {percent} * (n + o_n)"))
    pairs = pairs.select(F.col("doc").alias("a"), F.col("o_doc").alias("b")).distinct()
    more = save(_overlaps(pairs, segments).filter(enough).select("a", "b"), folder, "links-rest")
    return stats, members, links.unionByName(more)


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per distinct doc_id.

    Null or wordless text: n_shingles 0, own component. Null doc_id: left out. Rows repeating a doc_id are one document: its largest
    set size, linked by any of its texts. Other columns of `docs` are ignored. Empty table: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    folder = shared_dir(docs.sparkSession)
    stats, members, links = jaccard_links(docs, folder, size, percent)
    nodes = members.filter("doc_id <> doc").select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))
    labels = components(links.unionByName(nodes), folder, "all").withColumnRenamed("node", "doc_id")
    return stats.join(labels, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
