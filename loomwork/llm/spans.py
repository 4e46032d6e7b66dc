"""Spans of a text that don't overlap."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Sequence


class Spans:
    """A sorted set of disjoint spans."""

    def __init__(self) -> None:
        self._held: list[tuple[int, int]] = []

    def free(self, start: int, end: int) -> bool:
        """Whether start..end overlaps none."""
        i = bisect_right(self._held, (start, end))
        return (i == 0 or self._held[i - 1][1] <= start) and (i == len(self._held) or self._held[i][0] >= end)

    def add(self, start: int, end: int) -> bool:
        """Add a span unless it overlaps one; whether it was added."""
        if not self.free(start, end):
            return False
        insort(self._held, (start, end))
        return True


def heaviest(spans: Sequence[tuple[int, int]], weights: Sequence[tuple]) -> list[int]:
    """Indices, in order of place, of the disjoint spans whose weights (tuples of numbers, added up by place) have the largest sum; exact.

    Picking the largest weight first would be wrong: between 'Anna Schmidt' and 'Jan Kowalski', 'Schmidt, Jan' may weigh most."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][1], spans[i][0]))
    ends = [spans[i][1] for i in order]
    best: list[tuple] = [tuple(0 for _ in weights[0])] if spans else []
    before: list[int] = []
    for k, i in enumerate(order):
        before.append(bisect_right(ends, spans[i][0], 0, k))
        best.append(max(best[k], tuple(x + y for x, y in zip(best[before[k]], weights[i]))))
    kept, k = [], len(order)
    while k:
        if best[k] == best[k - 1]:
            k -= 1
        else:
            kept.append(order[k - 1])
            k = before[k - 1]
    return kept[::-1]
