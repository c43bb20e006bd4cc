"""Suffix arrays by linear grouping.

Phase 1 sorts suffixes into groups by their longest Lyndon prefix. Groups are taken in descending
order. Each member points to the nearest earlier suffix of a lower group; the targets of ``k``
pointers from one group have that group's prefix ``k`` times behind their own, so they move to a new
group right above their old one, more copies further up. Phase 2 goes through the suffixes in
ascending order: every suffix whose Lyndon prefix ends where the current one begins takes the next
place of its group. No level of recursion, no renaming.
"""

from __future__ import annotations


def suffix_array(codes: list[int]) -> list[int]:
    """Starts of the suffixes of ``codes`` (positive numbers) in ascending order."""
    text = [*codes, 0]
    n = len(text)
    members: list[list[int]] = []
    named: dict[int, int] = {}
    for symbol in sorted(set(text)):
        named[symbol] = len(members)
        members.append([])
    group = [named[s] for s in text]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    pointer = [-1] * n
    done = bytearray(n)

    g = len(members) - 1
    while g >= 0:
        met: dict[int, int] = {}
        for s in members[g]:
            if group[s] != g:
                continue
            p = s - 1
            while p >= 0 and done[p]:
                p = pointer[p]
            pointer[s] = p
            done[s] = 1
            if p >= 0:
                met[p] = met.get(p, 0) + 1
        if met:
            moves: dict[tuple[int, int], list[int]] = {}
            for p, k in met.items():
                moves.setdefault((k, group[p]), []).append(p)
            for (_, old), those in sorted(moves.items(), reverse=True):
                new = len(members)
                members.append(those)
                for p in those:
                    group[p] = new
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                if up >= 0:
                    below[up] = new
        g = below[g]

    size = [0] * len(members)
    for g in group:
        size[g] += 1
    free, at, g = [0] * len(members), 0, 0  # group 0 is the end marker's, always the lowest
    while g >= 0:
        free[g] = at
        at += size[g]
        g = above[g]
    order = [0] * n
    order[0] = n - 1
    for i in range(n):
        s = order[i]
        j, stop = s - 1, pointer[s]
        while j != stop:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            j = pointer[j]
    return order[1:]


def common_prefixes(codes: list[int], order: list[int]) -> list[int]:
    """Length of the common prefix of each suffix with the one before it in ``order``."""
    n = len(codes)
    rank = [0] * n
    for i, s in enumerate(order):
        rank[s] = i
    out, length = [0] * n, 0
    for s in range(n):
        r = rank[s]
        if r == 0:
            length = 0
            continue
        t = order[r - 1]
        while s + length < n and t + length < n and codes[s + length] == codes[t + length]:
            length += 1
        out[r] = length
        length = max(0, length - 1)
    return out
