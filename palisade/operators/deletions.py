"""Strings within two edits of a watch-list value: keys of the spellings with letters left out, and the distance, for many strings at once.

An edit is a letter more, less or other, or a swap of neighbours. Two strings within k edits share a spelling with at most k letters left out; so do their first HEAD
letters, and their last ones. Few distinct heads and tails of values make bit tables, against which the words of a text are tested in its row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from palisade.operators.bits import BitTable
from palisade.operators.spellings import ATOMS, CLASSES, HELD, POWERS, at_once, code_points, fold, letter_classes, pieces, strings_of, to_cyrillic, whole_hashes

HEAD = 7
BITS = 256  # of the tables of heads and tails for each key, since a word has many keys and passes by any of them
ROWS, KEYS = 4096, 1 << 19  # strings whose keys are made at once, and about how many keys these may have
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def edits_allowed(length: int) -> int:
    return 2 if length >= 8 else 1 if length >= 5 else 0


def limits_of(length: int) -> list[int]:
    """The numbers of edits allowed to values that a string of this length can be near."""
    return [k for k, ok in enumerate((length < 5, 4 <= length <= 8, length >= 6)) if ok]


def left_out(points: np.ndarray, limit: int) -> np.ndarray:
    """One row of keys for every row of letters: the row and all spellings with up to `limit` letters left out.

    Keys of different limits do not meet. The hash of a spelling is read from running sums, each part of it moved down by the letters left out before.
    """
    n = points.shape[1]
    up, down = POWERS.upto(n + 3)
    mixed = (points.astype(np.uint64) + np.uint64(1)) * _P
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros((len(points), n + 1), np.uint64)
    np.cumsum(mixed * up[:n], axis=1, out=sums[:, 1:])
    once, twice = sums * down[1], sums * down[2]
    out, sizes = [sums[:, n:]], [n]
    if limit >= 1 and n > 1:
        out.append(sums[:, :n] + (once[:, n:] - once[:, 1:]))
        sizes += [n - 1] * n
    if limit >= 2 and n > 2:
        for i in range(n - 1):
            out.append(sums[:, i : i + 1] + (once[:, i + 1 : n] - once[:, i + 1 : i + 2]) + (twice[:, n:] - twice[:, i + 2 :]))
            sizes += [n - 2] * (n - 1 - i)
    keys = (np.concatenate(out, axis=1) ^ (np.array(sizes, np.uint64) + np.uint64(limit << 32))) * _Q
    return keys ^ (keys >> np.uint64(31))


def by_length(strings: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their letters) of a bounded number of strings each; empty strings are passed over."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    for n in np.unique(lengths[lengths > 0]).tolist():
        rows, step = np.flatnonzero(lengths == n), max(1, min(ROWS, 2 * KEYS // (n * n + n + 2)))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            yield n, part, code_points("".join([strings[i] for i in part.tolist()])).reshape(len(part), n)


def keyed(name: str, of_value: bool, table: BitTable | None = None):
    """Map over batches -> the batch and `key`, a row for every spelling of the column `name` (no nulls) that passes the table.

    A value has those of the edits allowed to it, another string those of every value that it can be near.
    """

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(s, ROWS) for s in range(0, whole.num_rows, ROWS)):  # a batch leaves the task before the next is made
                for n, rows, points in by_length(strings_of(batch.column(name))):
                    for limit in [edits_allowed(n)] if of_value else limits_of(n):
                        keys = left_out(points, limit)
                        at, column = np.nonzero(np.ones(keys.shape, bool) if table is None else table.holds(keys))
                        picked = batch.take(pa.array(rows[at]))
                        yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(keys[at, column].view(np.int64))], names=[*batch.schema.names, "key"])

    return run


def end_keys(batches):
    """Map over batches (first or last letters of values, edits allowed) -> the keys of their spellings."""
    for batch in batches:
        strings, limits = strings_of(batch.column(0)), strings_of(batch.column(1))
        for limit in sorted(set(limits)):
            for _, _, points in by_length([s for s, of in zip(strings, limits, strict=True) if of == limit]):
                yield pa.RecordBatch.from_arrays([pa.array(left_out(points, limit).ravel().view(np.int64))], names=["h"])


def opening_codes(columns: list[np.ndarray]) -> Iterator[np.ndarray]:
    """With the letters left out that `limits_of` its length allows, a string has three letters at least and begins with three of its first five: the codes
    of all such three, from the classes of its letters by position."""
    for i, j, k in combinations(range(len(columns[:5])), 3):
        yield (columns[i] * CLASSES + columns[j]) * CLASSES + columns[k]


def openings(batches):
    """Map over batches (first letters of values) -> the codes with which their spellings begin."""
    for batch in batches:
        for n, _, points in by_length(strings_of(batch.column(0))):
            if n >= 3:
                codes = np.unique(np.concatenate(list(opening_codes(list(letter_classes(points).T)))))
                yield pa.RecordBatch.from_arrays([pa.array(codes)], names=["code"])


class Nearby:
    """Which words and runs of words of a text may be near a value, or fold to one; never False for one that is.

    `heads` and `tails`: keys of the first and last letters of values; `codes`: those of their openings; `folds`: hashes of folded values; `firsts`: of their first
    words; `counts`: word counts above one that values have; `lo` and `hi`: lengths of values.
    """

    def __init__(self, heads: BitTable, tails: BitTable, codes: np.ndarray, folds: BitTable, firsts: BitTable, counts: list[int], lo: int, hi: int):
        self.heads, self.tails, self.folds, self.firsts, self.counts, self.lo, self.hi = heads, tails, folds, firsts, counts, lo, hi
        self.opens = np.zeros(CLASSES**3, bool)
        self.opens[codes] = True
        self.known: set[str] = set()
        self.near: set[str] = set()  # words that pass
        self.begins: set[str] = set()  # words with which a folded value of several words may begin
        self.hollow: set[str] = set()  # words that fold to nothing

    def opening_passes(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of strings by the classes of their first five letters; those of letters behind the string let more pass, never fewer."""
        out = np.zeros(len(columns[0]), bool)
        for codes in opening_codes(columns):
            out |= self.opens[codes]
        return out

    def ends_pass(self, n: int, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Of strings of n letters by their first and last HEAD ones."""
        out = np.zeros(len(heads), bool)
        if not self.lo - 2 <= n <= self.hi + 2:
            return out
        open_to = np.flatnonzero(self.opening_passes(list(letter_classes(heads[:, :5]).T)))
        for limit in limits_of(n):
            for start in range(0, len(open_to), ROWS):
                part = open_to[start : start + ROWS]
                part = part[~out[part]]
                part = part[self.heads.holds(left_out(heads[part], limit)).any(axis=1)]
                out[part[self.tails.holds(left_out(tails[part], limit)).any(axis=1)]] = True
        return out

    def passing(self, strings: list[str]) -> np.ndarray:
        out = np.zeros(len(strings), bool)
        for n, rows, points in by_length(strings):
            if n >= 3:
                out[rows] = self.ends_pass(n, points[:, :HEAD], points[:, -HEAD:])
        return out

    def learn(self, words: set[str]) -> None:
        new = list(words - self.known)
        if len(self.known) + len(new) > HELD:
            for held in (self.known, self.near, self.begins, self.hollow):
                held.clear()
            new = list(words)
        if not new:
            return
        cyr = at_once(to_cyrillic, new)
        folded = at_once(fold, new)
        hashes = whole_hashes(folded)
        ok = self.passing(new) | self.passing(cyr) | self.folds.holds(hashes) | self.folds.holds(whole_hashes(at_once(fold, cyr)))
        ok &= np.fromiter(map(len, new), np.int64, len(new)) >= 3
        self.known.update(new)
        self.near.update([new[i] for i in np.flatnonzero(ok)])
        self.begins.update([new[i] for i in np.flatnonzero(self.firsts.holds(hashes))])
        self.hollow.update([w for w, f in zip(new, folded, strict=True) if not f])

    def near_runs(self, lists: list[list[str]]) -> list[set[str]]:
        """The runs of every list whose ends pass. All lists stand one behind the other, so their runs are tested at once."""
        found: list[set[str]] = [set() for _ in lists]
        words = [w for x in lists for w in x]
        if not words:
            return found
        points = np.concatenate([code_points(" ".join(words)), np.zeros(HEAD, np.uint64)])
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        classes = letter_classes(points)
        opens = self.opening_passes([classes[np.minimum(starts + i, len(points) - 1)] for i in range(5)])
        for count in self.counts:
            last = len(words) - count + 1
            if last <= 0:
                continue
            lengths = ends[count - 1 :] - starts[:last]
            fit = (owner[count - 1 :] == owner[:last]) & (lengths >= max(3, self.lo - 2)) & (lengths <= self.hi + 2) & opens[:last]
            for n in np.unique(lengths[fit]).tolist():
                rows = np.flatnonzero(fit & (lengths == n))
                letters = points[starts[rows, None] + np.arange(n)]
                for i in rows[self.ends_pass(n, letters[:, :HEAD], letters[:, -HEAD:])].tolist():
                    found[owner[i]].add(" ".join(words[i : i + count]))
        return found

    def folded_runs(self, raw: list[str]) -> set[str]:
        """Runs that fold to what a value folds to. A word that folds to nothing hides where a run begins, so all runs with such a word are folded."""
        at = {(i, n) for i, w in enumerate(raw) if w in self.begins for n in self.counts}
        at |= {(i, n) for h, w in enumerate(raw) if w in self.hollow for n in self.counts for i in range(max(0, h - n + 1), h + 1)}
        runs = list({" ".join(raw[i : i + n]) for i, n in at if i + n <= len(raw)})
        if not runs:
            return set()
        return {runs[i] for i in np.flatnonzero(self.folds.holds(whole_hashes([fold(r) for r in runs])))}

    def texts(self, texts: list[str | None]) -> list[set[str]]:
        """`texts`: in lower case."""
        lists = [[w for w in ATOMS.split(t or "") if w] for t in texts]
        seen = [set(x) for x in lists]
        self.learn(set().union(*seen))
        found = [s & self.near for s in seen]
        if self.counts:
            for f, near in zip(found, self.near_runs(lists), strict=True):
                f |= near
            special = self.begins | self.hollow
            for f, x, s in zip(found, lists, seen, strict=True):
                if not special.isdisjoint(s):
                    f |= self.folded_runs(x)
        return found


def nearby(*of):
    """Map over batches (key, text in lower case) -> (key, word): the distinct words and runs of a text that pass; `of` as in `Nearby`."""

    def run(batches):
        near = Nearby(*of)
        for batch in batches:
            texts = strings_of(batch.column(1))
            for start, end in pieces(texts):
                found = near.texts(texts[start:end])
                rows = start + np.repeat(np.arange(len(found)), [len(f) for f in found])
                words = pa.array([w for f in found for w in f], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), words], names=[batch.schema.names[0], "word"])

    return run


FAR = np.int8(9)


def distances(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Edits (with swaps of neighbours, optimal string alignment) between the strings of two columns row by row, FAR above two."""

    def letters(column: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray]:
        coded = column.dictionary_encode()
        strings, rows = strings_of(coded.dictionary), coded.indices.to_numpy()
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        grid = np.full((len(strings), int(lengths.max(initial=0)) + 6), pad, np.uint32)
        grid[:, 3:-3][np.arange(grid.shape[1] - 6) < lengths[:, None]] = code_points("".join(strings))
        return np.ascontiguousarray(grid[rows].T), lengths[rows]

    if not len(a):
        return np.zeros(0, np.int8)
    (x, la), (y, lb) = letters(a, 0x110001), letters(b, 0x110002)  # letter i stands in row i + 2, so rows around it exist
    if len(y) < len(x) + 3:
        y = np.vstack([y, np.full((len(x) + 3 - len(y), y.shape[1]), 0x110002, np.uint32)])
    far, size = np.full(len(la), FAR), len(la)
    out = np.full(size, FAR)

    def row_end(i: int, row: list[np.ndarray]) -> None:
        at = np.flatnonzero((la == i) & (np.abs(lb - la) <= 2))
        out[at] = np.stack([r[at] for r in row])[(lb - la)[at] + 2, np.arange(len(at))]

    # Row i holds the distance of the first i letters of a from the first i + d of b, for d from -2 to 2.
    older, row = None, [far, far, *(np.full(size, d, np.int8) for d in range(3))]
    row_end(0, row)
    same_before = None
    for i in range(1, int(la.max()) + 1):
        same = [x[i + 2] == y[i + 2 + d] if i + d >= 1 else np.zeros(size, bool) for d in range(-3, 4)]
        now: list[np.ndarray] = []
        for d in range(-2, 3):
            j = i + d
            if j <= 0:
                now.append(np.full(size, i, np.int8) if j == 0 else far)
                continue
            best = row[d + 2] + (~same[d + 3])
            if d > -2:
                best = np.minimum(best, now[-1] + np.int8(1))
            if d < 2:
                best = np.minimum(best, row[d + 3] + np.int8(1))
            if older is not None and j > 1:
                swap = same[d + 2] & same_before[d + 4]
                best = np.where(swap, np.minimum(best, older[d + 2] + np.int8(1)), best)
            now.append(np.minimum(best, FAR))
        older, row, same_before = row, now, same
        row_end(i, row)
    return np.where(out <= 2, out, FAR)


def near_pairs(batches):
    """Map over batches (word, form, secret) -> (word, secret, d): the pairs within the edits allowed to the secret, once a batch."""
    for batch in batches:
        word, form, secret = batch.columns
        d = distances(form, secret)
        allowed = np.array([edits_allowed(n) for n in range(9)])[np.minimum(pc.utf8_length(secret).to_numpy(), 8)]
        rows = pa.array(np.flatnonzero(d <= allowed))
        out = pa.table({"word": word.take(rows), "secret": secret.take(rows), "d": pa.array(d.astype(np.int32)).take(rows)})
        yield from out.group_by(["word", "secret"]).aggregate([("d", "min")]).rename_columns(["word", "secret", "d"]).cast(out.schema).to_batches()
