"""Karmarkar-Karp differencing of numbers into k near-equal windows."""

from __future__ import annotations

import heapq

import numpy as np


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window of each size, so that the k windows' sums are nearly equal.

    Each size starts as a partial partition of its own: one window with it, the others
    empty. The two partial partitions with the largest spread between their fullest and
    emptiest window are merged again and again, the fullest windows of one with the
    emptiest of the other, until one is left. Windows are chains of members: ``head`` and
    ``tail`` of each window, ``after`` of each member.
    """
    n = len(sizes)
    label = np.zeros(n, np.int64)
    if n == 0 or k == 1:
        return label
    order = np.argsort(-sizes, kind="stable")
    # The first k merges only lay the k largest side by side: done at once.
    first = order[:k]
    sums = np.zeros(k, np.int64)
    head = np.full(k, -1, np.int64)
    sums[: len(first)] = sizes[first]
    head[: len(first)] = first
    tail = head.copy()
    after = np.full(n, -1, np.int64)
    full: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {0: (sums, head, tail)}
    heap = [(-int(sums[0] - sums[-1]), 0)]
    rest = order[k:]
    at, made = 0, 1
    while len(heap) + len(rest) - at > 1:
        taken = []
        for _ in range(2):
            if at < len(rest) and (not heap or int(sizes[rest[at]]) > -heap[0][0]):
                taken.append(int(rest[at]))
                at += 1
            else:
                taken.append(full.pop(heapq.heappop(heap)[1]))
        a, b = taken
        if isinstance(a, int) and isinstance(b, int):
            # Two single sizes: gather all that would be merged beside each other.
            members = [a, b]
            while at < len(rest) and len(members) < k and int(sizes[rest[at]]) > (-heap[0][0] if heap else -1):
                members.append(int(rest[at]))
                at += 1
            sums = np.zeros(k, np.int64)
            head = np.full(k, -1, np.int64)
            sums[: len(members)] = sizes[members]
            head[: len(members)] = members
            tail = head.copy()
        elif isinstance(a, int) or isinstance(b, int):
            member, (sums, head, tail) = (a, b) if isinstance(a, int) else (b, a)
            sums[-1] += sizes[member]
            if head[-1] < 0:
                head[-1] = member
            else:
                after[tail[-1]] = member
            tail[-1] = member
            move = int(np.searchsorted(-sums[:-1], -sums[-1], side="right"))
            if move < k - 1:
                for column in (sums, head, tail):
                    last = column[-1]
                    column[move + 1 :] = column[move:-1]
                    column[move] = last
        else:
            (s1, h1, t1), (s2, h2, t2) = a, b
            s2, h2, t2 = s2[::-1], h2[::-1], t2[::-1]
            both = (h1 >= 0) & (h2 >= 0)
            after[t1[both]] = h2[both]
            sums = s1 + s2
            head = np.where(h1 >= 0, h1, h2)
            tail = np.where(h2 >= 0, t2, t1)
            by = np.argsort(-sums, kind="stable")
            sums, head, tail = sums[by], head[by], tail[by]
        full[made] = (sums, head, tail)
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), made))
        made += 1
    (_, head, _) = full.popitem()[1]
    window, current = np.arange(k)[head >= 0], head[head >= 0]
    while len(current):
        label[current] = window
        current = after[current]
        window, current = window[current >= 0], current[current >= 0]
    return label


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size so that no window's sum exceeds ``capacity``.

    Starts at the least possible number of windows; while one is too full, the number
    rises by what is too much, one at least. Ends at the latest with a window for each.
    """
    if len(sizes) == 0:
        return np.zeros(0, np.int64)
    if int(sizes.max()) > capacity:
        raise ValueError("a piece exceeds the capacity")
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        label = difference(sizes, k)
        over = np.bincount(label, weights=sizes, minlength=k) - capacity
        excess = int(over[over > 0].sum())
        if not excess:
            return label
        k = min(len(sizes), k + max(1, excess // capacity))
