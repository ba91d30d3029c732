"""Suffix arrays by linear grouping construction.

Suffixes that start with the same Lyndon word form a group. Groups lie in one array in ascending
order and start as those of equal first symbols. They are taken in descending order; each suffix of
the group points to the nearest earlier suffix of a smaller group, whose Lyndon prefix is thereby
extended, so that it moves to a new group just above its old one (the further up, the more of the
group point to it). Then the order within the groups is read off in one ascending sweep: the suffixes
whose next smaller suffix is the one at hand are those before it along the pointers, and each goes to
the next free place of its group. Nothing is renamed or sorted again.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of `text` in ascending order; a suffix sorts before what it is a prefix of."""
    n = len(text)
    if not n:
        return []
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    start = [0] * n  # of the group of each suffix
    end = [0] * (n + 1)  # of the group that starts here
    first = 0
    for at, suffix in enumerate(order):
        place[suffix] = at
        if at and text[order[at - 1]] != text[suffix]:
            end[first] = at
            first = at
        start[suffix] = first
    end[first] = n

    smaller = [-1] * n
    top = n
    while top:
        bottom = start[order[top - 1]]
        times: dict[int, int] = {}
        for suffix in sorted(order[bottom:top]):
            at = suffix - 1
            while at >= 0 and start[at] >= bottom:
                at = smaller[at]
            smaller[suffix] = at
            if at >= 0:
                times[at] = times.get(at, 0) + 1
        by_times: dict[int, dict[int, list[int]]] = {}
        for suffix, n_times in times.items():
            by_times.setdefault(n_times, {}).setdefault(start[suffix], []).append(suffix)
        for n_times in sorted(by_times, reverse=True):
            for group, moved in by_times[n_times].items():
                tail = end[group]
                for suffix in moved:
                    tail -= 1
                    other, hole = order[tail], place[suffix]
                    order[hole], order[tail] = other, suffix
                    place[other], place[suffix] = hole, tail
                if tail > group:
                    end[tail], end[group] = end[group], tail
                    for suffix in moved:
                        start[suffix] = tail
        top = bottom

    free = list(range(n))  # next place of the group that starts here
    done = [False] * n
    found = [0] * n

    def put(at: int) -> None:
        while at >= 0 and not done[at]:
            group = start[at]
            found[free[group]] = at
            free[group] += 1
            done[at] = True
            at = smaller[at]

    put(n - 1)
    for rank in range(n):
        put(found[rank] - 1)
    return found
