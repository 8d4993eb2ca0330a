"""Suffix array by linear grouping: Lyndon-prefix groups in descending order, then emission from the smallest suffix.

The Lyndon prefix of a suffix is what it has before the next smaller suffix begins.  Suffixes with the same Lyndon
prefix form a group, and groups are ordered as their prefixes are.  Both facts are found without sorting or renaming:

* Start with one group per symbol, in the order of the symbols, and take the groups from the highest down.
* All suffixes of the group in hand have their final Lyndon prefix.  Each one's *previous smaller* suffix is found by
  walking left over suffixes of this or higher groups by their own pointers.  The prefix in hand is a continuation of
  the Lyndon prefix of that previous smaller suffix, so within its group that suffix moves up: once for each
  continuation, above those that have fewer.
* When all groups are taken, suffixes are emitted in ascending order: whoever has suffix ``s`` as its next smaller
  suffix (``s - 1`` and, from there, along previous-smaller pointers until one is already out) takes the next free
  place of its group."""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Group number of each position, number of each group from the lowest up, and the previous smaller suffix of
    each position (-1: none)."""
    rank = {c: k for k, c in enumerate(sorted(set(text)))}
    of = [rank[c] for c in text]
    members: list[set[int]] = [set() for _ in rank]
    for i, k in enumerate(of):
        members[k].add(i)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    taken = [False] * len(members)
    prev = [-1] * len(text)
    order: list[int] = []
    g = len(members) - 1
    while g >= 0:
        order.append(g)
        taken[g] = True
        continued: dict[int, int] = {}
        for s in sorted(members[g]):
            p = s - 1
            while p >= 0 and taken[of[p]]:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                continued[p] = continued.get(p, 0) + 1
        moves: dict[int, dict[int, list[int]]] = {}
        for p, n in continued.items():
            moves.setdefault(of[p], {}).setdefault(n, []).append(p)
        for h, by_count in moves.items():
            left = len(members[h]) - sum(map(len, by_count.values()))
            low = h
            for n in sorted(by_count):
                if not left:  # none has fewer continuations: these stay in the group
                    left = len(by_count[n])
                    continue
                who, new, over = by_count[n], len(members), above[low]
                members[h].difference_update(who)
                members.append(set(who))
                taken.append(False)
                below.append(low)
                above.append(over)
                above[low] = below[over] = new
                for p in who:
                    of[p] = new
                low = new
        g = below[g]
    return of, order[::-1], prev


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order."""
    n = len(text)
    of, order, prev = lyndon_groups(text)
    size = [0] * len(order)
    for k in of:
        size[k] += 1
    free, at = [0] * len(order), 0
    for k in order:
        free[k], at = at, at + size[k]
    out, done = [0] * n, [False] * n
    for i in range(-1, n):
        j = (n if i < 0 else out[i]) - 1
        while j >= 0 and not done[j]:
            out[free[of[j]]] = j
            free[of[j]] += 1
            done[j] = True
            j = prev[j]
    return out


def common_prefixes(text: Sequence[int], order: Sequence[int]) -> list[int]:
    """Length of the common prefix of each suffix in ``order`` with the one before it (0 for the first)."""
    n = len(text)
    place, out, h = [0] * n, [0] * n, 0
    for k, i in enumerate(order):
        place[i] = k
    for i in range(n):
        if place[i]:
            j = order[place[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[place[i]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return out
