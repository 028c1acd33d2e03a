"""Geometry by rows: unions of rectangles and windows within a token budget."""

from __future__ import annotations

import numpy as np


class _Cover:
    """Lengths of a line that are covered at least once, and at least twice, while intervals come and go: a segment tree
    over the places where they end."""

    def __init__(self, places: np.ndarray):
        self.places = places.tolist()
        size = 4 * len(self.places)
        self.times, self.once, self.twice = [0] * size, [0] * size, [0] * size

    def add(self, first: int, last: int, by: int, node: int = 1, low: int = 0, high: int | None = None) -> None:
        high = len(self.places) - 1 if high is None else high
        if first <= low and high <= last:
            self.times[node] += by
        else:
            middle = (low + high) // 2
            if first < middle:
                self.add(first, last, by, 2 * node, low, middle)
            if last > middle:
                self.add(first, last, by, 2 * node + 1, middle, high)
        length, leaf, times = self.places[high] - self.places[low], high - low == 1, self.times[node]
        below = (0, 0) if leaf else (self.once[2 * node] + self.once[2 * node + 1], self.twice[2 * node] + self.twice[2 * node + 1])
        self.once[node] = length if times else below[0]
        self.twice[node] = length if times > 1 else below[0] if times else below[1]


def union_and_overlap(boxes: list[tuple[int, int, int, int]]) -> tuple[int, int]:
    """Area covered by at least one, and by at least two, of the boxes (x0, y0, x1, y1), by a sweep along x over the
    intervals of y: n boxes take n log n steps and n places of memory."""
    held = [b for b in boxes if b[2] > b[0] and b[3] > b[1]]
    if not held:
        return 0, 0
    ys = np.unique([v for b in held for v in (b[1], b[3])])
    cover, place = _Cover(ys), {int(y): k for k, y in enumerate(ys)}
    events = sorted([(b[0], 1, b[1], b[3]) for b in held] + [(b[2], -1, b[1], b[3]) for b in held])
    once = twice = 0
    before = events[0][0]
    for x, by, y0, y1 in events:
        once, twice = once + (x - before) * cover.once[1], twice + (x - before) * cover.twice[1]
        before = x
        cover.add(place[int(y0)], place[int(y1)], by)
    return int(once), int(twice)


def window_plan(width: int, height: int, patch: int, budget: int, limit: int = 4096) -> list[tuple[int, int, int, int]]:
    """Windows (x0, y0, x1, y1) of an image, each of at most `budget` patches: the largest is halved along its longer side,
    at a multiple of the patch size, until all fit. Sorted by place; more than `limit` windows raise."""
    cost = lambda b: -(-(b[2] - b[0]) // patch) * -(-(b[3] - b[1]) // patch)
    done, open_ = [], [(0, 0, width, height)]
    while open_:
        box = open_.pop()
        if cost(box) <= budget:
            done.append(box)
        else:
            x0, y0, x1, y1 = box
            across = x1 - x0 >= y1 - y0
            low, high = (x0, x1) if across else (y0, y1)
            middle = low + max((high - low) // 2 // patch, 1) * patch
            if middle >= high:
                raise ValueError("a single patch exceeds the budget")
            open_ += [(x0, y0, middle, y1), (middle, y0, x1, y1)] if across else [(x0, y0, x1, middle), (x0, middle, x1, y1)]
        if len(done) + len(open_) > limit:
            raise ValueError(f"more than {limit} windows")
    return sorted(done, key=lambda b: (b[1], b[0]))
