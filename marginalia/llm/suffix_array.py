"""Suffix array by linear grouping, without recursion or renaming.

First the suffixes are grouped by their longest Lyndon prefix: groups are taken in
descending order; every member finds the nearest earlier suffix of a lower group (its
previous-smaller pointer), whose own group then splits off the suffixes found, those
found more often behind those found less often. Second, the order inside the groups
is emitted by one ascending scan that follows the same pointers.
"""

from __future__ import annotations

from array import array


def suffix_array(text: list[int]) -> array:
    """Suffix array of ``text``, whose last symbol must be a unique least one."""
    n = len(text)
    sizes: dict[int, int] = {}
    for c in text:
        sizes[c] = sizes.get(c, 0) + 1
    at, start = {}, 0
    for c in sorted(sizes):
        at[c] = start
        start += sizes[c]
    size = array("i", bytes(4 * n))
    for c, g in at.items():
        size[g] = sizes[c]
    group = array("i", [at[c] for c in text])
    order = array("i", bytes(4 * n))
    place = array("i", bytes(4 * n))
    fill = dict(at)
    for i, c in enumerate(text):
        k = fill[c]
        order[k] = i
        place[i] = k
        fill[c] = k + 1
    before = array("i", [-1]) * n

    end = n
    while end:
        low = group[order[end - 1]]
        if end - low == 1:
            s = order[low]
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[s] = p
            end = low
            if p >= 0:
                g = group[p]
                k = size[g] - 1
                if k:
                    last = g + k
                    other, here = order[last], place[p]
                    order[here], place[other] = other, here
                    order[last], place[p] = p, last
                    size[g] = k
                    group[p] = last
                    size[last] = 1
            continue
        found: dict[int, int] = {}
        for s in sorted(order[low:end]):
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[s] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        end = low
        if not found:
            continue
        levels: dict[int, list[int]] = {}
        for p, times in found.items():
            levels.setdefault(times, []).append(p)
        for times in sorted(levels, reverse=True):
            moved = levels[times]
            for p in moved:
                g = group[p]
                k = size[g] - 1
                last = g + k
                other, here = order[last], place[p]
                order[here], place[other] = other, here
                order[last], place[p] = p, last
                size[g] = k
            new = [group[p] + size[group[p]] for p in moved]
            for p, g in zip(moved, new):
                group[p] = g
                size[g] += 1

    head = array("i", range(n))
    done = bytearray(n)
    order[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            order[head[g]] = s
            head[g] += 1
            done[s] = 1
            s = before[s]
    return order
