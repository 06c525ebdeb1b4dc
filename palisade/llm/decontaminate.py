"""Benchmark decontamination by templates: finds benchmark items in documents also when their numbers, names or units were changed.

Words are stripped of punctuation and lower-cased; numbers with their units (`3 km`, `3km`) and names (capitalised words inside a sentence,
several in a row as one) become typed placeholders, one token each, so a slot may change its number of words. Windows of `WINDOW` template
tokens with at least half of them literal are hashed and joined between documents and items; a window with more slots is hashed without
placeholders. Hits of one document and item on one diagonal (same shift) are one match; it counts when it covers `COVER` of the item's template windows,
or of all its windows, or `RUN` windows. The slots of a match must be consistent: one value of the item always stands for one value of the document, so an
exact copy or a re-parameterised question passes and a chance mix of values does not; two values of an item may become the same one. An item of fewer
than `MIN_WORDS` tokens is found where a line of a document is that item, word for word.

The window hashes of the benchmark go to the map tasks while there are at most `SENT_HASHES` of them (8 bytes each), so only hits leave
a task; with a larger benchmark all document windows are shuffled to the same join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import MIX, save, shared_dir, windows

WINDOW, MIN_WORDS, COVER, RUN = 8, 4, 0.5, 6
SENT_HASHES = 2_000_000
_NUM, _NAME, _LITERAL = 1, 2, 0
_HASHES = np.array([0, *(xxhash.xxh3_64_intdigest(x) for x in (b"<number>", b"<name>"))], np.uint64)
_NUMBER = re.compile(rb"[+-]?[$]?[0-9][0-9.,:/]*%?(?:st|nd|rd|th)?")
_LEADING = re.compile(rb"[+-]?[$]?[0-9][0-9.,:/]*")
_STOPS = b".!?:"
_EDGE = b".,;:!?\"'()[]{}<>*_"
#: Units, lower case.
UNITS = frozenset(
    b"% mm cm m km in inch inches ft feet foot yd yards mile miles g kg mg t lb lbs oz ounces pounds ml l liter liters litre litres gallon gallons "
    b"s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    b"euro euros eur usd dollar dollars cent cents gbp chf w kw v a hz degrees celsius fahrenheit mph percent".split()
)


class Words(dict):
    """word -> row in tables of literal hash and flags, remembered for at most `limit` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit
        self.hashes, self.flags = np.zeros(limit, np.uint64), np.zeros(limit, np.uint8)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        core = word.strip(_EDGE)
        if core.isascii():
            low, name = core.lower(), len(core) > 2 and core[:1].isupper() and core[1:].islower()
        else:
            text = core.decode("utf-8", "replace")
            low, name = text.lower().encode("utf-8", "replace"), len(text) > 2 and text[0].isupper() and text[1:].islower()
        number = core[:1] < b":" and (_NUMBER.fullmatch(core) is not None or ((m := _LEADING.match(core)) is not None and core[m.end() :].lower() in UNITS))
        self.hashes[at] = xxhash.xxh3_64_intdigest(low)
        self.flags[at] = number + 2 * (low in UNITS) + 4 * name + 8 * (word[-1] in _STOPS)
        return at

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) + len(words) > self.limit:
            self.clear()
            if len(words) > self.limit:
                self.limit = len(words)
                self.hashes, self.flags = np.zeros(self.limit, np.uint64), np.zeros(self.limit, np.uint8)
        at = np.fromiter(map(self.__getitem__, words), np.int64, count=len(words))
        return self.hashes[at], self.flags[at]


@dataclass
class Tokens:
    """A text as template tokens: hash, whether a slot, first word of each; all words and their hashes; hashes of whole short lines and their first words."""

    hashes: np.ndarray
    slot: np.ndarray
    first: np.ndarray
    words: list[bytes]
    plain: np.ndarray
    lines: np.ndarray
    line_at: np.ndarray

    def plain_tokens(self) -> np.ndarray:
        return self.plain if len(self.first) == len(self.words) else _joined(self.plain, self.first)

    def value(self, token: int) -> str:
        end = self.first[token + 1] if token + 1 < len(self.first) else len(self.words)
        return " ".join(w.strip(_EDGE).lower().decode("utf-8", "replace") for w in self.words[self.first[token] : end])


def _joined(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One hash per run of words from one start to the next; that of a single word is its own."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(hashes)) - np.repeat(starts, np.diff([*starts, len(hashes)]))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(place.max()) + 1, MIX)) * _MIX_INVERSE
        return np.add.reduceat(hashes * powers[place], starts)


def template(text: str | None, table: Words, with_lines: bool = True) -> Tokens:
    """Tokens of a text. First words of lines start a sentence as words after a stop do. Short lines only where they are asked for."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        none, no_hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Tokens(no_hash, np.zeros(0, bool), none, words, no_hash, no_hash, none)
    lines = np.cumsum([0, *(len(line.split()) for line in data.split(b"\n"))])
    lines = lines[lines < len(words)]
    hashes, flags = table.look_up(words)
    number = flags & 1 > 0
    start = np.ones(len(words), bool)
    start[1:] = flags[:-1] & 8 > 0
    start[lines] = True
    unit = flags & 2 > 0
    unit[1:] &= number[:-1]
    unit[:1] = False
    unit &= ~number
    name = (flags & 4 > 0) & ~start & ~number & ~unit
    unit[1:] |= name[1:] & name[:-1]  # part of the slot before
    first = np.flatnonzero(~unit)
    kind = np.where(number, _NUM, np.where(name, _NAME, _LITERAL))[first]
    tokens = Tokens(np.where(kind == _LITERAL, hashes[first], _HASHES[kind]), kind != _LITERAL, first, words, hashes, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if with_lines:
        lines = np.unique(lines)
        ends = np.append(lines[1:], len(words))
        short = np.searchsorted(first, ends) - np.searchsorted(first, lines) < MIN_WORDS
        whole = _joined(hashes, lines) ^ (ends - lines).astype(np.uint64) ^ _LINE
        tokens.lines, tokens.line_at = whole[short], lines[short]
    return tokens


_EXACT = np.uint64(0x5EED_0F_E4AC7)  # tells windows of plain words from those of template words
_LINE = np.uint64(0x11E_0F_E4AC7)
_MIX_INVERSE = np.uint64(pow(int(MIX), -1, 2**64))


def text_windows(tokens: Tokens, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, sizes, exact) of all windows: of template tokens where at least half are literal, else of plain words (exact)."""
    none = np.zeros(0, np.int64)
    slots = np.concatenate([[0], np.cumsum(tokens.slot)])
    found = [(np.zeros(0, np.uint64), none, none, np.zeros(0, bool))]
    for size in sizes:
        if len(tokens.first) >= size:
            heavy = (slots[size:] - slots[:-size]) * 2 > size
            both = windows(tokens.hashes, size) ^ np.uint64(size)
            if heavy.any():
                both = np.where(heavy, windows(tokens.plain_tokens(), size) ^ np.uint64(size) ^ _EXACT, both)
            found.append((both, np.arange(len(both)), np.full(len(both), size), heavy))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_WINDOWS = "id long, hash long, at int, word int, size int, exact boolean, slots array<string>"


class Wanted:
    """Sorted hashes behind a bit table: most windows are told apart by one look-up."""

    BITS = np.uint64(2**22 - 1)

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.table = np.zeros(int(self.BITS) + 1, bool)
        self.table[hashes & self.BITS] = True

    def hits(self, found: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(self.table[found & self.BITS])
        if not len(near):
            return near
        at = np.minimum(np.searchsorted(self.hashes, found[near]), len(self.hashes) - 1)
        return near[self.hashes[at] == found[near]]


def _emit(sizes: list[int], wanted: np.ndarray | None, own_size: bool):
    """Map over batches (id, text) -> windows; a short line is a window of size 0, given if that is among the sizes. own_size: an item has windows of
    one size, or is a line."""

    def run(batches):
        table, filtered = Words(), None if wanted is None else Wanted(wanted)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = template(text.as_py(), table, 0 in sizes)
                n = len(tokens.first)
                mine = [s for s in sizes if s] if not own_size else [min(n, WINDOW)] if n >= MIN_WORDS else []
                found, starts, lengths, exact = text_windows(tokens, mine)
                for i in np.arange(len(found)) if filtered is None else filtered.hits(found):
                    lo, size = int(starts[i]), int(lengths[i])
                    values = [] if exact[i] else [tokens.value(j) for j in range(lo, lo + size) if tokens.slot[j]]
                    rows.append((key, int(found[i].view(np.int64)), lo, int(tokens.first[lo]), size, bool(exact[i]), values))
                if 0 in sizes or (own_size and n < MIN_WORDS):
                    lines = tokens.lines if not own_size else _joined_lines(tokens)
                    places = tokens.line_at if not own_size else np.zeros(len(lines), np.int64)
                    for i in np.arange(len(lines)) if filtered is None else filtered.hits(lines):
                        rows.append((key, int(lines[i].view(np.int64)), int(places[i]), int(places[i]), 0, True, []))
            columns = list(zip(*rows, strict=True)) or [()] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("at", pa.int32()), ("word", pa.int32()), ("size", pa.int32()), ("exact", pa.bool_()), ("slots", pa.list_(pa.string()))])


def _joined_lines(tokens: Tokens) -> np.ndarray:
    """The hash that a document's line has when it is the whole item, whatever line breaks the item has."""
    if not tokens.words:
        return np.zeros(0, np.uint64)
    return _joined(tokens.plain, np.zeros(1, np.int64)) ^ np.uint64(len(tokens.words)) ^ _LINE


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, run: int = RUN, sent_hashes: int = SENT_HASHES) -> DataFrame:
    """(doc_id, item_id, at_word, matched_windows, item_windows, n_slots, changed_slots): documents with a benchmark item, the best match per pair.

    Items shorter than a window are one window of their own length, items of fewer than `MIN_WORDS` tokens one whole line. Null or
    empty texts, null ids and empty tables match nothing. Rows repeating an id count once. Ties between matches go to the earlier place.
    """
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").filter("doc_id is not null")
    benchmark = benchmark.selectExpr("cast(item_id as long) as item_id", "cast(text as string) as text").filter("item_id is not null")
    folder = shared_dir(docs.sparkSession)
    items = save(benchmark.mapInArrow(_emit([], None, True), _WINDOWS).distinct(), folder, "items")
    kinds = items.select("hash").distinct().limit(sent_hashes + 1).toArrow().column("hash").to_numpy()
    wanted = np.sort(kinds.view(np.uint64)) if len(kinds) <= sent_hashes else None  # 16 MB at most
    sizes = [r[0] for r in items.select("size").distinct().orderBy("size").collect()]  # at most WINDOW + 1 numbers
    found = docs.mapInArrow(_emit(sizes, wanted, False), _WINDOWS).distinct()
    per_item = items.groupBy("id").agg(F.count("*").alias("item_windows"), F.count_if(~F.col("exact")).alias("item_template")).withColumnRenamed("id", "item_id")
    item = items.select(F.col("id").alias("item_id"), "hash", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    hits = found.join(item, "hash").withColumn("shift", F.col("at") - F.col("item_at")).withColumnRenamed("id", "doc_id")
    hits = save(hits.select("doc_id", "item_id", "shift", "at", "word", "exact", "slots", "item_slots"), folder, "hits")
    keys = ["doc_id", "item_id", "shift"]
    counted = hits.groupBy(*keys).agg(F.countDistinct("at").alias("matched_windows"), F.countDistinct(F.when(~F.col("exact"), F.col("at"))).alias("matched_template"), F.min("word").alias("at_word"))
    matches = counted.join(per_item, "item_id")
    matches = matches.filter(f"matched_windows >= {run} or matched_windows >= {cover} * item_windows or (item_template > 0 and matched_template >= {cover} * item_template)")
    pairs = hits.select(*keys, F.explode(F.arrays_zip("slots", "item_slots")).alias("p")).select(*keys, F.col("p.slots").alias("d"), F.col("p.item_slots").alias("i")).distinct()
    one = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("i").alias("ni"), F.sum((F.col("d") != F.col("i")).cast("int")).alias("changed_slots"))
    judged = matches.join(one, keys, "left").filter("n is null or n = ni")  # one value of the document for each of the item
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched_windows", (-F.col("at_word")).alias("early"), "at_word", "item_windows", F.coalesce("n", F.lit(0)).alias("n_slots"), F.coalesce("changed_slots", F.lit(0)).alias("changed_slots"))).alias("m"))
    return best.select("doc_id", "item_id", "m.at_word", "m.matched_windows", "m.item_windows", "m.n_slots", "m.changed_slots")
