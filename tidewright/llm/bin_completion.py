"""Bin completion by branch and bound.

A bin starts from the largest piece left; its fillings are enumerated, those that another one dominates left out, and
tried from the least waste up. The packing sought has one bin less than the incumbent, so the waste it may have in all is
known, and a filling that wastes more than what is left of it is not enumerated at all. Best-fit decreasing is the first
incumbent; best fit of what is left is tried at every node with few pieces left, and a packing found becomes the incumbent.

A filling is dominated where one piece that is left could take the place of one, two or three of its pieces (they fit in
it, and it fits in the bin), or where a piece that is left still fits.

`nodes` bounds the pieces placed in the whole search; None lifts the bound, which makes the result exact. Within the
bound, the result is never worse than best-fit decreasing, and optimal where it meets `least_bins`.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

#: With so many pieces left, best fit of them is tried at a node.
FEW = 64


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        k = bisect_left(rooms, (x, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(x)
        if room > x:
            insort(rooms, (room - x, b))
    return bins


def least_bins(lengths: list[int], capacity: int) -> int:
    """A lower bound: pieces above half of the capacity stand apart, and pieces from a bound on need what room these leave them."""
    ordered = sorted(lengths)
    sums = [0]
    for x in ordered:
        sums.append(sums[-1] + x)
    half, n = bisect_right(ordered, capacity // 2), len(ordered)
    best = -(-sums[-1] // capacity)
    for least in [0, *sorted(set(ordered[:half]))]:
        a, c = bisect_left(ordered, least), bisect_right(ordered, capacity - least)
        c = max(c, half)
        room = (c - half) * capacity - (sums[c] - sums[half])
        best = max(best, n - half + max(0, -(-(sums[half] - sums[a] - room) // capacity)))
    return best


class _OutOfNodes(Exception):
    pass


class Search:
    """A packing of the pieces into `bins` bins, if one is found."""

    def __init__(self, lengths: list[int], capacity: int, nodes: int | None):
        self.capacity, self.nodes = capacity, nodes
        self.count = Counter(lengths)
        self.left = sorted(self.count)  # the lengths of which a piece is left
        self.pieces = len(lengths)

    def _spend(self, n: int = 1) -> None:
        if self.nodes is not None:
            self.nodes -= n
            if self.nodes < 0:
                raise _OutOfNodes

    def take(self, x: int) -> None:
        self.count[x] -= 1
        self.pieces -= 1
        if not self.count[x]:
            del self.left[bisect_left(self.left, x)]

    def put_back(self, x: int) -> None:
        self.count[x] += 1
        self.pieces += 1
        if self.count[x] == 1:
            insort(self.left, x)

    def dominated(self, filling: list[int], room: int) -> bool:
        if self.left and self.left[0] <= room:
            return True
        subsets = {sum(c) for k in (2, 3) for c in combinations(filling, k)} if len(filling) <= 8 else {a + b for a, b in zip(filling, filling[1:])}
        for size, more in [*((x, 1) for x in set(filling)), *((s, 0) for s in subsets)]:
            k = bisect_left(self.left, size + more)
            if k < len(self.left) and self.left[k] <= size + room:
                return True
        return False

    def fillings(self, room: int, least_waste: int, most_waste: int, last: int, own: list[int], quota: list[int]) -> Iterator[list[int]]:
        """Undominated fillings of the room with pieces of up to `last`; `own` are taken while it runs. Ends with its quota."""
        k = bisect_right(self.left, min(room, last)) - 1
        if least_waste <= room <= most_waste and not self.dominated(own, room):
            yield own[:]
        while k >= 0 and quota[0] > 0:
            x = self.left[k]
            if x * self.pieces < room - most_waste:  # not even all pieces that are left would do
                return
            self._spend()
            quota[0] -= 1
            self.take(x)
            own.append(x)
            yield from self.fillings(room - x, least_waste, most_waste, x, own, quota)
            own.pop()
            self.put_back(x)
            k = bisect_left(self.left, x) - 1

    def ordered(self, room: int, slack: int, bins: int) -> Iterator[list[int]]:
        """Fillings from the least waste up, in widening bands; each band is complete unless the search is bounded."""
        band = [0]
        while band[-1] < slack:
            band.append(min(slack, max(2 * band[-1], slack // max(bins, 1), 1)))
        low = 0
        for high in band:
            quota = [1 << 62 if self.nodes is None else max(200, self.nodes // 50)]
            found = self.fillings(room, low, high, room, [], quota)
            if self.pieces > FEW:  # the first of a band will do for the dive; the rest follow if it comes back
                for filling in found:
                    kept = filling[:]
                    for x in kept:  # the generator holds them while it is suspended
                        self.put_back(x)
                    yield kept
                    for x in kept:
                        self.take(x)
            else:
                yield from sorted((f for f in found), key=lambda f: (room - sum(f), [-x for x in f]))
            low = high + 1

    def run(self, bins: int) -> list[list[int]] | None:
        slack = bins * self.capacity - sum(x * n for x, n in self.count.items())
        made: list[list[int]] = []
        waste: list[int] = []
        open_: list[Iterator[list[int]]] = []

        def finished() -> list[list[int]] | None:
            if not self.pieces:
                return [list(b) for b in made]
            if self.pieces <= FEW:
                self._spend(self.pieces)
                rest = best_fit_decreasing(list(self.count.elements()), self.capacity)
                if len(made) + len(rest) <= bins:
                    return [*made, *rest]
            return None

        def enter() -> None:
            x = self.left[-1]
            self.take(x)
            made.append([x])
            open_.append(self.ordered(self.capacity - x, slack - sum(waste), bins - len(made) + 1))

        try:
            if found := finished():
                return found
            enter()
            while open_:
                if len(waste) == len(open_):  # back at this bin: its filling failed
                    waste.pop()
                    for x in made[-1][1:]:
                        self.put_back(x)
                    del made[-1][1:]
                filling = next(open_[-1], None)
                if filling is None:
                    open_.pop()
                    self.put_back(made.pop()[0])
                    continue
                for x in filling:
                    self.take(x)
                made[-1] += filling
                waste.append(self.capacity - sum(made[-1]))
                if found := finished():
                    return found
                if self.pieces and len(made) < bins:
                    enter()
        except _OutOfNodes:
            pass
        return None


def bin_completion(lengths: list[int], capacity: int, nodes: int | None = 200_000) -> list[list[int]]:
    """The lengths in each bin."""
    best = best_fit_decreasing(lengths, capacity)
    bound = least_bins(lengths, capacity)
    while len(best) > bound:
        search = Search(lengths, capacity, nodes)
        found = search.run(len(best) - 1)
        if nodes is not None:
            nodes = max(0, search.nodes)
        if found is None:
            break
        best = found
    return best
