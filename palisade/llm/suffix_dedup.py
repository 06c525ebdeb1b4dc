"""Suffix-array dedup: removes each byte covered by a `LENGTH`-byte string that also starts earlier in the corpus.

A string S of LENGTH bytes has one anchor: the leftmost smallest of its KEY-byte windows by hash. Equal strings have their anchor at the same
offset, so repeats are looked for among occurrences of equal anchors only. One anchor stands for a run of starts (its domain), whose
strings all lie in one context of less than 2 * LENGTH bytes.

1. Map: anchors of each text, packed per (chunk, fragment of the anchor hash) with a hash of their whole context. What a chunk sees twice
   is settled or marked there and travels once; anchors with several contexts in one chunk are dealt by context, so common passages
   make no hot fragment. Reduce: a context seen earlier is a repeat over its whole domain; the first of each context remains.
2. Only first occurrences of anchors with several contexts (the ends of repeats) are compared in detail. Their contexts are dealt in blocks of
   anchors; a block sorts the suffixes that start at anchors with the linear grouping construction of `lyndon.py` over symbols of
   `SYMBOL` bytes. Neighbours in that order with LENGTH - d common bytes and the same d bytes before hold the same string at offset d.
   An anchor with more than `HOT` contexts is split: its strings are dealt by their own hash and aggregated.
3. Starts are joined back to the texts by document, and covered bytes are removed.

All strings are judged on the input. Hashes of 64 bits stand for equal contexts; contexts that differ are compared byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import MIX, save, shared_dir
from palisade.llm.lyndon import suffix_array

LENGTH, KEY, SYMBOL = 100, 32, 20
CHUNK = 600_000  # anchors a map task packs at a time
HOT = 20_000  # contexts of one anchor above which its strings are dealt one by one
BLOCK = 20_000  # contexts per block, about
SPAN = LENGTH - KEY + 1  # starts of KEY windows in a string; largest domain


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * MIX
        return h ^ (h >> np.uint64(29))


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as an integer."""
    return np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1)).copy().view("<u8").reshape(-1)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first start, last start, hash) of the anchors of a text of at least LENGTH bytes."""
    eight = _words(data)
    n = len(data) - KEY + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, KEY, 8):
            h = _mix(h + eight[i : i + n])
    best = np.arange(n)
    width = 1
    while width * 2 <= SPAN:  # leftmost smallest of `width` positions, doubled
        a, b = best[: len(best) - width], best[width:]
        best = np.where(h[b] < h[a], b, a)
        width *= 2
    a, b = best[: n - SPAN + 1], best[SPAN - width : SPAN - width + n - SPAN + 1]
    best = np.where(h[b] < h[a], b, a)
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.concatenate([first[1:], [len(best)]]) - 1
    return best[first], first, last, h[best[first]]


def _context_hashes(data: bytes, first: np.ndarray, last: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """64-bit hash of data[first : last + LENGTH] and the place of the anchor in it."""
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(data[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, count=len(first))
    with np.errstate(over="ignore"):
        return _mix(hashes + (pos - first).astype(np.uint64))


_ENTRY = np.dtype([("hash", "<u8"), ("context", "<u8"), ("pos", "<u4"), ("back", "u1"), ("more", "u1")])  # back: pos - first; more: pos - last
_PIECES = pa.schema([("fragment", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("entries", pa.binary())])
_FLAGS = np.dtype([("hash", "<u8"), ("pos", "<u4"), ("back", "u1"), ("more", "u1")])
_REPEAT, _FIRST = 0, 1


def _pieces(fragments: int):
    def rows(fragment: int, docs: np.ndarray, owner: np.ndarray, entries: np.ndarray):
        order = np.argsort(owner, kind="stable")
        who, counts = np.unique(owner, return_counts=True)
        return fragment, docs[who].astype(np.int64).tobytes(), counts.astype(np.uint32).tobytes(), entries[order].tobytes()

    def chunk(ids: list[int], found: list[np.ndarray]):
        docs = np.array(ids, np.int64)
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in found])
        entries = np.concatenate(found)
        order = np.lexsort((entries["pos"], docs[owner], entries["context"], entries["hash"]))
        owner, entries = owner[order], entries[order]
        new_hash = np.concatenate([[True], entries["hash"][1:] != entries["hash"][:-1]])
        new_context = new_hash | np.concatenate([[True], entries["context"][1:] != entries["context"][:-1]])
        same_row = ~new_context & np.concatenate([[False], (docs[owner[1:]] == docs[owner[:-1]]) & (entries["pos"][1:] == entries["pos"][:-1])])
        out = []
        settled = ~new_context & ~same_row  # not the first of its context in this chunk: a repeat, whatever other chunks hold
        if settled.any():
            out.append(rows(-1 - int(docs[0] % 16), docs, owner[settled], entries[settled]))
        group = np.cumsum(new_hash) - 1
        contexts = np.bincount(group, new_context).astype(np.int64)
        keep = np.flatnonzero(new_context)
        several = contexts[group[keep]] > 1  # the anchor has several contexts here: dealt by context, known to need comparison
        once, by_context = keep[~several], keep[several]
        part = (entries["hash"] % np.uint64(fragments)).astype(np.int64)
        other = (entries["context"] % np.uint64(fragments)).astype(np.int64)
        marks = np.flatnonzero(new_hash & (contexts[group] > 1))  # one entry tells the anchor's own fragment about it
        for f in range(fragments):
            here = once[part[once] == f]
            if len(here):
                out.append(rows(f, docs, owner[here], entries[here]))
            here = by_context[other[by_context] == f]
            if len(here):
                out.append(rows(f + fragments, docs, owner[here], entries[here]))
            here = marks[part[marks] == f]
            if len(here):
                out.append((f, b"", b"", entries[here].tobytes()))
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECES.types, strict=True)], schema=_PIECES)

    def run(batches):
        ids, found, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(data) < LENGTH:
                    continue
                pos, first, last, hashes = anchors(np.frombuffer(data, np.uint8))
                entries = np.empty(len(pos), _ENTRY)
                entries["hash"], entries["pos"], entries["back"], entries["more"] = hashes, pos, pos - first, pos - last
                entries["context"] = _context_hashes(data, first, last, pos)
                ids.append(doc_id)
                found.append(entries)
                held += len(pos)
                if held >= CHUNK:
                    yield chunk(ids, found)
                    ids, found, held = [], [], 0
        if ids:
            yield chunk(ids, found)

    return run


def _settle(fragments: int):
    def emit(docs: np.ndarray, kind: int, entries: np.ndarray):
        if not len(docs):
            return []
        order = np.argsort(docs, kind="stable")
        docs, entries = docs[order], entries[order]
        flags = np.empty(len(entries), _FLAGS)
        for name in _FLAGS.names:
            flags[name] = entries[name]
        who, start = np.unique(docs, return_index=True)
        ends = [*start[1:], len(docs)]
        return [(int(d), kind, flags[a:b].tobytes()) for d, a, b in zip(who, start, ends, strict=True)]

    def run(table: pa.Table) -> pa.Table:
        fragment = table.column("fragment")[0].as_py()
        docs, entries, mark = [], [], []
        for ids, counts, packed in zip(*(table.column(c).to_pylist() for c in ("docs", "counts", "entries")), strict=True):
            values = np.frombuffer(packed, _ENTRY)
            (entries if ids else mark).append(values)
            if ids:
                docs.append(np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.uint32)))
        rows: list[tuple[int, int, bytes]] = []
        if docs:
            docs, entries = np.concatenate(docs), np.concatenate(entries)
            if fragment < 0:
                rows = emit(docs, _REPEAT, entries)
            else:
                order = np.lexsort((entries["pos"], docs, entries["context"], entries["hash"]))
                docs, entries = docs[order], entries[order]
                new_hash = np.concatenate([[True], entries["hash"][1:] != entries["hash"][:-1]])
                new_context = new_hash | np.concatenate([[True], entries["context"][1:] != entries["context"][:-1]])
                same_row = ~new_context & np.concatenate([[False], (docs[1:] == docs[:-1]) & (entries["pos"][1:] == entries["pos"][:-1])])
                group = np.cumsum(new_hash) - 1
                contexts = np.bincount(group, new_context)
                shared = contexts[group] > 1
                if mark:
                    shared |= np.isin(entries["hash"], np.concatenate(mark)["hash"])
                if fragment >= fragments:
                    shared[:] = True
                repeat, first = ~new_context & ~same_row, new_context & shared
                rows = emit(docs[repeat], _REPEAT, entries[repeat]) + emit(docs[first], _FIRST, entries[first])
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["doc_id", "kind", "flags"])

    return run


def _hash_rows(batches):
    for batch in batches:
        values = np.concatenate([np.zeros(0, "<u8")] + [np.frombuffer(x, _FLAGS)["hash"] for x in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["hash"])


_CONTEXT = "hash long, doc_id long, pos long, back int, more int, context binary"


def _cut(batches):
    """Text and flags of first occurrences -> their contexts."""
    for batch in batches:
        columns: list[list] = [[], [], [], [], [], []]
        for doc_id, text, flags in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for packed in flags:
                for h, pos, back, more in np.frombuffer(packed, _FLAGS).tolist():
                    if pos - more + LENGTH <= len(data):  # else another text under the same id
                        for column, value in zip(columns, (h - 2**64 if h >= 2**63 else h, doc_id, pos, back, more, data[pos - back : pos - more + LENGTH]), strict=True):
                            column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _CONTEXT.split(", ")])


_STARTS = "doc_id long, lo long, hi long"


def _runs(doc: np.ndarray, pos: np.ndarray, repeat: np.ndarray) -> pa.Table:
    """repeat[i, d]: the string that starts d bytes before anchor i is a repeat. As ranges of starts per document."""
    padded = np.pad(repeat, ((0, 0), (1, 1))).astype(np.int8)
    step = np.diff(padded, axis=1)
    i, lo = np.nonzero(step == 1)
    _, hi = np.nonzero(step == -1)
    return pa.table([pa.array(doc[i]), pa.array(pos[i] - hi + 1), pa.array(pos[i] - lo)], names=["doc_id", "lo", "hi"])


def _block(table: pa.Table) -> pa.Table:
    """Contexts of a block of anchors -> starts of repeated strings, by the order of the suffixes at the anchors."""
    n = table.num_rows
    h, doc, pos = (table.column(c).to_numpy() for c in ("hash", "doc_id", "pos"))
    back, more = table.column("back").to_numpy().astype(np.int64), table.column("more").to_numpy().astype(np.int64)
    after, before = np.zeros((n, LENGTH), np.uint8), np.zeros((n, SPAN), np.uint8)
    for i, context in enumerate(table.column("context").to_pylist()):
        b = back[i]
        tail = np.frombuffer(context, np.uint8, offset=b)
        after[i, : len(tail)] = tail
        before[i, :b] = np.frombuffer(context, np.uint8, count=b)[::-1]
    _, anchor = np.unique(h, return_inverse=True)
    symbols = after.reshape(n * LENGTH // SYMBOL, SYMBOL)
    _, ranks = np.unique(np.ascontiguousarray(symbols).view(f"V{SYMBOL}").ravel(), return_inverse=True)
    row = np.column_stack([anchor + 2, ranks.reshape(n, -1) + 2 + anchor.max(initial=0) + 1, np.ones(n, np.int64)])
    text = np.concatenate([row.ravel(), [0]])  # per context: its anchor, its symbols, an end
    order = suffix_array(text)
    order = order[order % row.shape[1] == 0] // row.shape[1]
    order = order[order < n]  # contexts by anchor, then by what follows it
    sorted_after, sorted_anchor = after[order], anchor[order]
    differs = sorted_after[1:] != sorted_after[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH)
    common[sorted_anchor[1:] != sorted_anchor[:-1]] = -1
    back, more, doc, pos, before = back[order], more[order], doc[order], pos[order], before[order]
    repeat = np.zeros((n, SPAN), bool)
    left = np.zeros(n, np.uint64)
    for d in range(SPAN):
        if d:
            with np.errstate(over="ignore"):
                left = _mix(left * np.uint64(257) + before[:, d - 1].astype(np.uint64) + np.uint64(1))
        run = np.concatenate([[0], np.cumsum(common < LENGTH - d)])
        here = np.flatnonzero((more <= d) & (d <= back))
        if len(here) < 2:
            continue
        by = here[np.lexsort((pos[here], doc[here], left[here], run[here]))]
        head = np.concatenate([[True], (run[by[1:]] != run[by[:-1]]) | (left[by[1:]] != left[by[:-1]])])
        lead = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]  # the earliest occurrence of the same string
        twin = (doc[by] == doc[lead]) & (pos[by] == pos[lead])  # a document given twice does not repeat itself
        repeat[by[~head & ~twin], d] = True
    return _runs(doc, pos, repeat)


def _strings(batches):
    """Hot anchors: every string of a context by its own hash."""
    for batch in batches:
        columns: list[list] = [[], [], []]
        for doc_id, pos, back, more, context in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            for d in range(more, back + 1):
                columns[0].append(hashlib.md5(context[back - d : back - d + LENGTH]).digest())
                columns[1].append(doc_id)
                columns[2].append(pos - d)
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["string", "doc_id", "start"])


def removed_runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs [from, to) covered by strings starting in the ranges lo..hi."""
    order = np.argsort(lo, kind="stable")
    a, b = lo[order], np.maximum.accumulate(hi[order] + LENGTH)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    at = np.flatnonzero(new)
    return a[at], b[np.concatenate([at[1:], [len(a)]]) - 1]


_KEPT = "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(batches):
    for batch in batches:
        columns: list[list] = [[], [], [], [], [], []]
        for doc_id, text, flags, ranges, mixed in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            text = text.as_py()
            data = (text or "").encode("utf-8", "surrogatepass")
            lo, hi = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for packed in [] if mixed else flags or []:
                f = np.frombuffer(packed, _FLAGS)
                lo.append(f["pos"].astype(np.int64) - f["back"])
                hi.append(f["pos"].astype(np.int64) - f["more"])
            for r in [] if mixed else ranges or []:
                lo.append(np.array([r["lo"]]))
                hi.append(np.array([r["hi"]]))
            a, b = removed_runs(np.concatenate(lo), np.concatenate(hi)) if len(lo) > 1 else (lo[0], hi[0])
            kept = data
            if len(a):
                edges = [0, *np.column_stack([a, b]).ravel().tolist(), len(data)]
                kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                text = kept.decode("utf-8", "ignore")  # a run may cut a character; the digest is of the bytes
            for column, value in zip(columns, (doc_id, text, len(data), len(data) - len(kept), len(a), hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _KEPT.split(", ")])


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text, n_bytes, n_removed, n_spans, kept_sha256.

    Null text counts as empty bytes (and stays null). Rows that repeat a doc_id and its text are one document and are answered alike. A doc_id
    with several different texts keeps them whole, as does a null doc_id, which takes no part. Other columns are ignored. Empty table: no rows.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    fragments = max(16, docs.rdd.getNumPartitions() // 2)
    pieces = docs.filter("doc_id is not null").mapInArrow(_pieces(fragments), "fragment int, docs binary, counts binary, entries binary")
    flags = save(pieces.groupBy("fragment").applyInArrow(_settle(fragments), "doc_id long, kind int, flags binary"), folder, "flags")
    firsts = flags.filter(f"kind = {_FIRST}")
    hashes = firsts.select("flags").mapInArrow(_hash_rows, "hash long")
    counts = save(hashes.groupBy("hash").agg(F.count("*").alias("n")).groupBy((F.col("n") > HOT).alias("hot")).agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") > HOT, F.col("hash"))).alias("hashes")), folder, "counts")
    total = {r["hot"]: r["n"] for r in counts.select("hot", "n").collect()}
    blocks = max(1, -(-(total.get(False) or 0) // BLOCK))

    contexts = docs.join(firsts.groupBy("doc_id").agg(F.collect_list("flags").alias("flags")), "doc_id").mapInArrow(_cut, _CONTEXT)
    starts = contexts
    if total.get(True):  # hot anchors: few, as each has more than HOT contexts
        hot = counts.filter("hot").select(F.explode("hashes").alias("hash"))
        starts = contexts.join(hot, "hash", "left_anti")
        strings = contexts.join(hot, "hash", "left_semi").select("doc_id", "pos", "back", "more", "context").mapInArrow(_strings, "string binary, doc_id long, start long")
        earliest = strings.groupBy("string").agg(F.min(F.struct("doc_id", "start")).alias("first"))
        split = strings.join(earliest, "string").filter("struct(doc_id, start) <> first").select("doc_id", F.col("start").alias("lo"), F.col("start").alias("hi"))
    starts = starts.withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(blocks))).groupBy("block").applyInArrow(_block, _STARTS)
    if total.get(True):
        starts = starts.unionByName(split)
    ranges = starts.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    repeats = flags.filter(f"kind = {_REPEAT}").groupBy("doc_id").agg(F.collect_list("flags").alias("flags"))
    known = repeats.join(ranges, "doc_id", "full")
    same = Window.partitionBy("doc_id")
    texts = docs.join(known, "doc_id", "left").withColumn("digest", F.xxhash64("text"))
    texts = texts.withColumn("mixed", (F.min("digest").over(same) != F.max("digest").over(same)) & F.col("doc_id").isNotNull())
    return texts.select("doc_id", "text", "flags", "ranges", "mixed").mapInArrow(_remove, _KEPT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The digest of `without_repeats`: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return without_repeats(docs).drop("text")
