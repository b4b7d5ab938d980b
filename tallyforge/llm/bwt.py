"""Repeated strings of a block of texts from its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

_SYMBOLS = 257  # bytes and the sign between texts


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of all suffixes by their first ``depth`` symbols at least (prefix doubling)."""
    size = len(text)
    width = 7
    key = np.zeros(size, np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(width, np.int64)])
    for k in range(width):
        key = key * _SYMBOLS + padded[k : k + size]
    order = np.argsort(key, kind="stable")
    rank = np.empty(size, np.int64)

    def regroup(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rank the suffixes in these slots by the first slot of their keys; the slots still shared."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(new)
        rank[order[slots]] = np.repeat(slots[starts], np.diff(np.append(starts, len(keys))))
        alone = new & np.append(new[1:], True)
        return slots[~alone]

    slots = regroup(np.arange(size), key[order])
    while width < depth and len(slots):
        held = order[slots]
        after = held + width
        keys = rank[held] * (size + 1) + np.where(after < size, rank[np.minimum(after, size - 1)] + 1, 0)
        by_key = np.argsort(keys, kind="stable")
        order[slots] = held[by_key]
        slots = regroup(slots, keys[by_key])
        width *= 2
    return order


def long_prefix_boundaries(order: np.ndarray, text: np.ndarray, least: int) -> np.ndarray:
    """Flags of the boundaries between neighbours in ``order`` that share ``least`` symbols or more.

    Intervals of the transform are extended to the left breadth first: a boundary first met by
    the interval of a string of length l + 1 has the common prefix l. After ``least`` levels what is not
    met is longer. Each interval that goes on has met a new boundary, so there are no more of them than suffixes.
    """
    size = len(order)
    last = text[order - 1]  # the symbol before each suffix; the text starts after a sign
    by_last = np.argsort(last, kind="stable")
    onto = np.empty(size, np.int64)  # where each suffix stands with that symbol put before it
    onto[by_last] = np.arange(size)
    first = last[by_last]
    open_end = np.ones(size + 1, bool)
    open_end[[0, size]] = False
    low, high = np.array([0]), np.array([size])
    owner = np.empty(size, np.int64)
    for _ in range(least):
        lengths = high - low
        total = int(lengths.sum())
        if not total:
            break
        which = np.repeat(np.arange(len(low)), lengths)
        places = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + low[which]
        moved = onto[places]
        owner[moved] = which
        moved.sort()
        new = np.ones(total, bool)
        new[1:] = (owner[moved[1:]] != owner[moved[:-1]]) | (first[moved[1:]] != first[moved[:-1]])
        starts = np.flatnonzero(new)
        low = moved[starts]
        high = moved[np.append(starts[1:], total) - 1] + 1
        fresh = open_end[high]
        low, high = low[fresh], high[fresh]
        open_end[high] = False
    return open_end


def repeated_runs(texts: list[bytes], least: int) -> list[list[tuple[int, int]]]:
    """For each text the merged byte runs covered by strings of ``least`` bytes that start anywhere else too."""
    sizes = np.array([len(text) for text in texts], np.int64)
    joined = np.zeros(int(sizes.sum()) + len(texts) + 1, np.uint16)
    begins = np.cumsum(sizes + 1) - sizes
    for begin, text in zip(begins.tolist(), texts):
        joined[begin : begin + len(text)] = np.frombuffer(text, np.uint8)
        joined[begin : begin + len(text)] += 1
    order = suffix_order(joined, least)
    long = long_prefix_boundaries(order, joined, least)
    again = np.zeros(len(joined), bool)
    again[order] = long[:-1] | long[1:]
    out = []
    for begin, size in zip(begins.tolist(), sizes.tolist()):
        at = np.flatnonzero(again[begin : begin + max(0, size - least + 1)])
        cuts = np.flatnonzero(np.diff(at) > least) + 1
        out.append([(int(run[0]), int(run[-1]) + least) for run in np.split(at, cuts) if len(run)])
    return out
