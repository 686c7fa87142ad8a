"""Suffix array by linear grouping (Baier 2016): suffixes grouped by their Lyndon prefixes, then emitted in order."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Starts of the suffixes of symbols (any integers) in lexicographic order; a prefix comes before what it begins.

    First phase: groups start as equal first symbols and are processed in descending order. When a group is
    processed, each of its suffixes finds its previous smaller suffix: the last start before it that lies in a
    lower group, reached through the pointers of higher groups already processed. Such a start's known prefix grows
    by the group's prefix, once for each suffix of the group that points to it, so these starts leave their groups
    upwards, more repetitions further. In the end suffixes share a group if they share their longest Lyndon prefix.
    Second phase: in ascending order, each suffix at j places those whose next smaller suffix it is: j - 1 and on
    along the pointers, until one that has its place. No suffixes are compared and no symbols are renamed."""
    n = len(symbols)
    if not n:
        return []
    by_symbol = np.argsort(symbols, kind="stable")
    ordered = np.asarray(symbols)[by_symbol]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    sizes = np.diff(np.append(starts, n))
    group_at = np.empty(n, np.int64)
    group_at[by_symbol] = np.repeat(starts, sizes)
    place_at = np.empty(n, np.int64)
    place_at[by_symbol] = np.arange(n)
    suffixes, place, group = by_symbol.tolist(), place_at.tolist(), group_at.tolist()
    size = [0] * n  # of the group that starts at an index
    for s, z in zip(starts.tolist(), sizes.tolist(), strict=True):
        size[s] = z
    smaller = [-1] * n

    end = n
    while end:
        start = group[suffixes[end - 1]]
        members = suffixes[start:end]
        if len(members) == 1:
            s = members[0]
            p = s - 1
            while p >= 0 and group[p] > start:
                p = smaller[p]
            smaller[s] = p
            levels = ((p,),) if p >= 0 else ()
        else:
            members.sort()
            times: dict[int, int] = {}
            for s in members:
                p = s - 1
                while p >= 0 and group[p] >= start:
                    p = smaller[p]
                smaller[s] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            most = max(times.values(), default=0)
            if most <= 1:
                levels = (tuple(times),) if times else ()
            else:
                by_times: dict[int, list[int]] = {}
                for p, t in times.items():
                    by_times.setdefault(t, []).append(p)
                levels = tuple(by_times[t] for t in sorted(by_times, reverse=True))
        for level in levels:
            for p in level:  # to the end of its group, which gets shorter
                g = group[p]
                size[g] = left = size[g] - 1
                here, there = place[p], g + left
                if here != there:
                    other = suffixes[there]
                    suffixes[here], suffixes[there] = other, p
                    place[other], place[p] = here, there
            for p in level:
                g = group[p]
                g += size[g]
                group[p] = g
            for p in level:
                size[group[p]] += 1
        end = start

    placed = [False] * n
    free = list(range(n))  # next index of the group that starts at an index
    j = n
    for i in range(-1, n):
        if i >= 0:
            j = suffixes[i]
        s = j - 1
        while s >= 0 and not placed[s]:
            placed[s] = True
            g = group[s]
            suffixes[free[g]] = s
            free[g] += 1
            s = smaller[s]
    return suffixes
