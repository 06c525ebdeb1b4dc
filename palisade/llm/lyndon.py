"""Suffix sorting by linear grouping (Baier's two-phase construction, public literature), on a text of small integers.

Phase 1 groups suffixes by their longest Lyndon prefix: groups are taken in descending order; every suffix of a group extends the
Lyndon prefix of its previous smaller suffix, which moves to a new group right above its old one. Phase 2 walks the order from
the smallest suffix and puts every waiting suffix at the front of its group. No renaming, no recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in ascending order. The last symbol must be smaller than all others."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    lengths = np.diff(np.concatenate([starts, [n]]))
    first = np.repeat(starts, lengths)
    group_np = np.empty(n, np.int64)
    group_np[order] = first
    place_np = np.empty(n, np.int64)
    place_np[order] = np.arange(n)
    size_np = np.zeros(n, np.int64)
    size_np[starts] = lengths
    line, group, place, size = order.tolist(), group_np.tolist(), place_np.tolist(), size_np.tolist()
    smaller = [-1] * n  # previous suffix of a lower group

    end = n - 1
    while end >= 0:
        low = group[line[end]]
        members = line[low : end + 1]
        if len(members) > 1:
            members.sort()
        count: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            tops = set(count.values())
            for times in sorted(tops, reverse=True):
                moved = [p for p, c in count.items() if c == times] if len(tops) > 1 else list(count)
                for p in moved:
                    g = group[p]
                    size[g] -= 1
                    at, last = place[p], g + size[g]
                    other = line[last]
                    line[at], line[last] = other, p
                    place[other], place[p] = at, last
                new: dict[int, int] = {}
                for p in moved:
                    g = group[p]
                    if g not in new:
                        new[g] = g + size[g]
                for p in moved:
                    group[p] = new[group[p]]
                for p in moved:
                    size[group[p]] += 1
        end = low - 1

    free = list(range(n))  # next free place of the group that starts here
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = smaller[s]
    return np.array(out)
