"""Linear grouping construction of suffix arrays.

Phase 1 groups suffixes by their Lyndon prefix: groups start as first symbols
and are taken in descending order; every suffix of a group points to the
nearest suffix before it in a lower group (its previous smaller one), whose
prefix grows by the group's.  Suffixes with equally many pointers move
together to a new group right above their old one, more pointers higher.
Phase 2 emits the order inside the groups from left to right along the same
pointers.  No symbols are renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``symbols`` (integers); a suffix that ends is smaller than one that goes on."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    first = np.ones(n, bool)
    first[1:] = sorted_symbols[1:] != sorted_symbols[:-1]
    starts = np.flatnonzero(first)
    group = np.empty(n, np.int64)
    group[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    start, prev = _groups(order.tolist(), group.tolist(), dict(zip(starts.tolist(), np.append(starts[1:], n).tolist(), strict=True)))
    return np.array(_emit(start, prev), np.int64)


def _groups(slots: list[int], start: list[int], ends: dict[int, int]) -> tuple[list[int], list[int]]:
    """Phase 1.  ``slots``: suffixes, group after group; ``start``: the first
    slot of each suffix's group; ``ends``: the slot after each group, by its
    first slot.  Returns the final ``start`` and the pointers (-1: none)."""
    n = len(slots)
    place = [0] * n
    for k, s in enumerate(slots):
        place[s] = k
    prev = [-1] * n
    jump = list(range(-1, n - 1))  # everything between jump[p] and p is in no lower group than the current one
    hi = n
    while hi:
        lo = start[slots[hi - 1]]
        pointed: dict[int, int] = {}
        for s in slots[lo:hi]:
            p = jump[s]
            if p >= 0 and start[p] >= lo:
                seen = [s]
                while p >= 0 and start[p] >= lo:
                    seen.append(p)
                    p = jump[p]
                for q in seen:
                    jump[q] = p
            prev[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        hi = lo
        if not pointed:
            continue
        if len(pointed) == 1:  # one suffix moves: to the end of its group
            (p, _), = pointed.items()
            old = start[p]
            end = ends[old]
            if end - old > 1:
                _move(p, end - 1, slots, place)
                ends[old] = end - 1
                start[p] = end - 1
                ends[end - 1] = end
            continue
        moved: dict[int, dict[int, list[int]]] = {}
        for p, times in pointed.items():
            moved.setdefault(start[p], {}).setdefault(times, []).append(p)
        for old, by_times in moved.items():
            end = ends[old]
            for times in sorted(by_times, reverse=True):
                rows = by_times[times]
                new = end - len(rows)
                if new == old:  # the whole rest of the group: it stays
                    break
                for k, p in enumerate(rows, 1):
                    _move(p, end - k, slots, place)
                    start[p] = new
                ends[new] = end
                end = new
            ends[old] = end
    return start, prev


def _move(p: int, to: int, slots: list[int], place: list[int]) -> None:
    at = place[p]
    if at != to:
        other = slots[to]
        slots[at], slots[to] = other, p
        place[other], place[p] = at, to


def _emit(start: list[int], prev: list[int]) -> list[int]:
    """Phase 2: each suffix emitted places those whose prefix it follows."""
    n = len(start)
    out = [-1] * n
    free = list(range(n))  # by a group's first slot: its next free one
    placed = bytearray(n)

    def place_chain(j: int) -> None:
        while j >= 0 and not placed[j]:
            g = start[j]
            k = free[g]
            out[k] = j
            free[g] = k + 1
            placed[j] = 1
            j = prev[j]

    place_chain(n - 1)  # what the end of the text, the smallest suffix, follows
    for i in range(n):
        place_chain(out[i] - 1)
    return out
