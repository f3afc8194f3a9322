"""Bin packing of token lengths by histogram.

Packing depends on lengths alone, and lengths are at most the capacity, so an
instance of any number of documents is a histogram of at most ``capacity`` counts.
Bins of equal content are handled together as (pattern, how many), which gives the
packing that item-by-item best-fit would, in steps bounded by the capacity.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np


class CapacityTree:
    """Segment tree over capacities that finds the smallest one at least x with open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.open[i] += n
            i >>= 1

    def at_least(self, x: int) -> int | None:
        i = x + self.size
        if x < self.size and self.open[i]:
            return x
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:
            i = 2 * i + (not self.open[2 * i])
        return i - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Bins as (((length, how many), ...), number of such bins), longest lengths placed first."""
    tree = CapacityTree(capacity)
    rooms: dict[int, list] = defaultdict(list)  # free room: [pattern, number of bins]

    def put(room, pattern, n):
        if n:
            rooms[room].append((pattern, n))
            tree.add(room, n)

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        left = counts[length]
        while left:
            room = tree.at_least(length)
            if room is None:
                room, pattern, n = capacity, (), -(-left // (capacity // length))
            else:
                pattern, n = rooms[room].pop()
                tree.add(room, -n)
            # Best fit fills a bin as far as the length goes before it takes the next.
            per = room // length
            full = min(n, left // per)
            put(room - per * length, (*pattern, (length, per)), full)
            left -= full * per
            if full < n and left:
                put(room - left * length, (*pattern, (length, left)), 1)
                left, full = 0, full + 1
            if pattern:
                put(room, pattern, n - full)
    return [entry for room in rooms.values() for entry in room]


class _Counts:
    """A histogram with the searches that the reduction needs."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 2, np.int64)
        for x, c in counts.items():
            self.n[x] += c

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest lengths, one item of ``without`` left out."""
        out = []
        for x in np.flatnonzero(self.n):
            c = int(self.n[x]) - (x == without)
            out += [int(x)] * min(c, k - len(out))
            if len(out) == k:
                break
        return out

    def largest_upto(self, room: int, without: int) -> int | None:
        have = self.n[: room + 1] > 0
        if without <= room and self.n[without] == 1:
            have[without] = False
        at = np.flatnonzero(have)
        return int(at[-1]) if len(at) else None


def dominance_reduction(counts: dict[int, int], capacity: int):
    """Martello and Toth's reduction: (fixed bins, histogram of the items left).

    For an item j, longest first, a set is fixed if it dominates every feasible set
    with j: j alone if nothing fits beside it; j with the longest item that fits
    (b*), if no two others fit together or if b* fills the bin or weighs no less than any pair that
    fits where no three do; or j with the heaviest pair, if no three fit, its larger
    item is b* and no pair of items both heavier than its smaller one fits. Equal
    items are fixed together, as often as the items last and the test stays the same.
    """
    h = _Counts(counts, capacity)
    fixed: dict[tuple, int] = defaultdict(int)

    def fix(items, times):
        pattern = defaultdict(int)
        for x in items:
            pattern[x] += 1
        for x, c in pattern.items():
            h.n[x] -= c * times
        fixed[tuple(sorted(pattern.items(), reverse=True))] += times

    def as_often(items):
        need = defaultdict(int)
        for x in items:
            need[x] += 1
        return min(int(h.n[x]) // c for x, c in need.items())

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while h.n[j] > 0:
                room = capacity - j
                best = h.largest_upto(room, j)
                if best is None:
                    # Alone: true for all items of this length at once, or for the last.
                    fix([j], int(h.n[j]) if 2 * j > capacity else 1)
                    changed = True
                    continue
                if best == room:
                    fix([j, best], as_often([j, best]))
                    changed = True
                    continue
                low = h.smallest(3, j)
                if len(low) < 2 or sum(low[:2]) > room:
                    fix([j, best], as_often([j, best]))
                    changed = True
                    continue
                if len(low) == 3 and sum(low) <= room:
                    break
                # At most two items fit beside j: find the heaviest such pair.
                pair = _heaviest_pair(h, room, j)
                if best >= sum(pair):
                    fix([j, best], as_often([j, best]))
                    changed = True
                    continue
                a, b = pair
                if a == best and not _pair_above(h, b, room, j):
                    fix([j, a, b], as_often([j, a, b]))
                    changed = True
                    continue
                break
    return [(p, n) for p, n in fixed.items()], {int(x): int(h.n[x]) for x in np.flatnonzero(h.n)}


def _heaviest_pair(h: _Counts, room: int, j: int) -> tuple[int, int]:
    n = h.n.copy()
    n[j] -= 1
    items = np.flatnonzero(n[: room + 1] > 0)
    best = (0, 0)
    hi = len(items) - 1
    for lo in range(len(items)):
        while hi >= lo and (items[lo] + items[hi] > room or (lo == hi and n[items[lo]] < 2)):
            hi -= 1
        if hi < lo:
            break
        if items[lo] + items[hi] > sum(best):
            best = (int(items[hi]), int(items[lo]))
    return best


def _pair_above(h: _Counts, b: int, room: int, j: int) -> bool:
    """Whether two items heavier than b fit together beside j."""
    n = h.n[b + 1 :].copy()
    if j > b:
        n[j - b - 1] -= 1
    at = np.flatnonzero(n > 0)[:2]
    if not len(at):
        return False
    x = int(at[0])
    y = x if n[x] > 1 else (int(at[1]) if len(at) > 1 else None)
    return y is not None and x + y + 2 * (b + 1) <= room


def pack(counts: dict[int, int], capacity: int, reduce: bool = True):
    """Bins of all items: the reduction's sets, then best-fit-decreasing of the rest."""
    fixed, rest = dominance_reduction(counts, capacity) if reduce else ([], counts)
    return fixed + best_fit_decreasing(rest, capacity)


class Placement:
    """Where the r-th item of a length goes: (sequence, offset), from a list of bins."""

    def __init__(self, bins):
        rows = defaultdict(list)
        first = 0
        for pattern, n in bins:
            base = 0
            for length, per in pattern:
                rows[length].append((per * n, per, first, base))
                base += length * per
            first += n
        self.n_sequences = first
        self.table = {}
        for length, entries in rows.items():
            t = np.array(entries, np.int64)
            self.table[length] = (np.cumsum(t[:, 0]) - t[:, 0], t[:, 1], t[:, 2], t[:, 3])

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, per, first, base = self.table[length]
        i = np.searchsorted(start, rank, "right") - 1
        k = rank - start[i]
        return first[i] + k // per[i], base[i] + (k % per[i]) * length
