"""difflib's ratio of two texts in fewer steps, with the same value for every pair of texts.

difflib takes the longest common passage of a window (of those, the first on the left, then on the right), and goes on with the windows before and after it; each window is read character by character. Here long passages are
found by pieces of theirs, and what is left is done for all windows at once: passages of one length from left to right, longest first, as windows do not touch one another, and before a passage taken there is none of its length
left. In right texts of 200 characters or more, difflib has passages begin only at characters that are not frequent there; those around join a passage once it is chosen.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from functools import lru_cache

#: Length of the pieces that long passages are found by: every passage of LONG characters has one that begins at a multiple of it, counted from where its window begins.
PIECE = 8
LONG = 2 * PIECE - 1

Window = tuple[int, int, int, int]


class Passages:
    """What passages of each length a right text has, without its frequent characters."""

    def __init__(self, text: str):
        self.frequent = {c for c, k in Counter(text).items() if k > len(text) // 100 + 1} if len(text) >= 200 else set()
        mark = next(iter(self.frequent), "")
        self.runs = [x for x in text.translate(dict.fromkeys(map(ord, self.frequent), mark)).split(mark) if x] if mark else [text]
        self.known: dict[int, set[str]] = {}

    def of(self, k: int) -> set[str]:
        if k not in self.known:
            self.known[k] = {x[j : j + k] for x in self.runs for j in range(len(x) - k + 1)}
        return self.known[k]


#: A few right texts' passages are kept, as a text is held against several in a row.
passages = lru_cache(maxsize=16)(Passages)


def extended(a: str, b: str, i: int, j: int, size: int, window: Window, but: set[str]) -> tuple[int, int, int]:
    """A passage with the like characters before and after it, up to one of those."""
    low, high, start, end = window
    while i > low and j > start and a[i - 1] == b[j - 1] and a[i - 1] not in but:
        i, j, size = i - 1, j - 1, size + 1
    while i + size < high and j + size < end and a[i + size] == b[j + size] and a[i + size] not in but:
        size += 1
    return i, j, size


def long_passage(a: str, b: str, window: Window, frequent: set[str]) -> tuple[int, int, int] | None:
    """The longest passage of a window, if that has LONG characters."""
    low, high, start, end = window
    best, reach = (1 - LONG, 0, 0), {}  # the size is negative, so that the least is the longest and first
    for i in range(low, high - PIECE + 1, PIECE):
        piece = a[i : i + PIECE]
        j = b.find(piece, start, end) if frequent.isdisjoint(piece) else -1
        while j >= 0:
            if reach.get(i - j, low) <= i:  # else it is a part of one that was seen
                p, q, size = extended(a, b, i, j, PIECE, window, frequent)
                reach[i - j] = p + size
                best = min(best, (-size, p, q))
            j = b.find(piece, j + 1, end)
    return (best[1], best[2], -best[0]) if best[0] <= -LONG else None


def matched(a: str, b: str) -> int:
    """How many characters difflib matches."""
    right = passages(b)
    total, windows, waiting = 0, [], [(0, len(a), 0, len(b))]
    while waiting:
        window = waiting.pop()
        found = long_passage(a, b, window, right.frequent)
        if not found:
            windows.append(window)
            continue
        i, j, size = extended(a, b, *found, window, set())
        total += size
        low, high, start, end = window
        waiting += [x for x in ((i + size, high, j + size, end), (low, i, start, j)) if x[0] < x[1] and x[2] < x[3]]  # the one before is next
    known = right.of(1)
    levels, at = [], [i for low, high, _, _ in windows for i, c in enumerate(a[low:high], low) if c in known]  # where passages of 1, 2, ... characters begin in a
    while at and len(levels) < LONG - 1:
        levels.append(at)
        k = len(levels) + 1
        known = right.of(k)
        at = [i for i in at if a[i : i + k] in known]
    for k in range(len(levels), 0, -1):
        at, left = levels[k - 1], []
        for low, high, start, end in windows:
            for i in at[bisect_left(at, low) : bisect_left(at, high - k + 1)]:
                if i < low or (j := b.find(a[i : i + k], start, end)) < 0:
                    continue
                size = k
                if right.frequent:
                    i, j, size = extended(a, b, i, j, k, (low, high, start, end), set())
                total += size
                if low < i and start < j:
                    left.append((low, i, start, j))
                low, start = i + size, j + size
                if end - start < k:
                    break
            if low < high and start < end:
                left.append((low, high, start, end))
        windows = left
    if right.frequent:  # where no passage begins, what both begin with
        total += sum(extended(a, b, low, start, 0, (low, high, start, end), set())[2] for low, high, start, end in windows)
    return total


def ratio(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio(); the order of the arguments matters."""
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0
