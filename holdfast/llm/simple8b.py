"""Simple-8b: whole numbers packed into 64-bit words, coded and decoded by columns.

The top four bits of a word select how many values it holds and their width.
Selector 0 is an escape: the value is too wide for any word and stands in a list
beside the words, the payload is its place there. Selector 1 is a run of zeros.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
# Fixed values of the format: (values, bits each) by selector; 0 is the escape.
SELECTORS = [
    (1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
]
BLOCK = 4096  # values per block; blocks begin at a word, whose place is stored


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    if not len(values) or values.max() < len(_NARROW):
        return _NARROW[values]
    limits = U64(1) << np.arange(64, dtype=U64)
    return np.searchsorted(limits, values, side="right").astype(np.uint8)


_NARROW = np.array([int(v).bit_length() for v in range(1 << 16)], dtype=np.uint8)
_COUNTS = np.array([c for c, _ in SELECTORS])


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escaped values, and the word at which each block of values begins.

    Greedy: a word takes as many of the next values of its block as any selector
    allows. All blocks are walked side by side.
    """
    n = len(values)
    values = values.astype(U64)
    blocks = -(-n // BLOCK)
    widest = np.zeros((blocks, BLOCK + 120), dtype=np.uint8)  # of the next ``have`` values
    filled = np.zeros(blocks * BLOCK, dtype=np.uint8)
    filled[:n] = _widths(values)
    widest[:, :BLOCK] = filled.reshape(blocks, BLOCK)
    choice = np.zeros((blocks, BLOCK), dtype=np.uint8)  # escape, unless something fits
    have = 1
    for selector in range(15, 0, -1):  # the last that fits holds most values
        count, width = SELECTORS[selector]
        while have < count:
            step = min(have, count - have)
            widest = np.maximum(widest[:, :-step], widest[:, step:])
            have += step
        np.copyto(choice, np.uint8(selector), where=widest[:, :BLOCK] <= width)
    choice = choice.reshape(-1)
    begins = np.zeros(blocks * BLOCK, dtype=bool)
    ends = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    place = np.arange(blocks) * BLOCK
    while len(place):
        begins[place] = True
        place = place + _COUNTS[choice[place]]
        inside = place < ends
        if not inside.all():
            place, ends = place[inside], ends[inside]
    starts = np.flatnonzero(begins)
    chosen = choice[starts]
    words = chosen.astype(U64) << U64(60)
    padded = np.concatenate([values, np.zeros(120, U64)])
    room = np.minimum((starts // BLOCK + 1) * BLOCK, n) - starts  # values of the block from here on
    for selector in np.unique(chosen):
        at = np.flatnonzero(chosen == selector)
        if selector == 0:
            words[at] |= np.arange(len(at), dtype=U64)
            continue
        count, width = SELECTORS[selector]
        packed, first, left = words[at], starts[at], room[at]
        whole = bool((left >= count).all())
        for i in range(count if width else 0):
            value = padded[first + i] << U64(i * width)
            packed |= value if whole else np.where(left > i, value, U64(0))
        words[at] = packed
    return words, values[starts[chosen == 0]], np.searchsorted(starts, np.arange(blocks) * BLOCK)


def _unpack(words: np.ndarray, escapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the words, padding too, and where each word's begin."""
    chosen = (words >> U64(60)).astype(np.int64)
    counts = _COUNTS[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=U64)
    payload = words & U64((1 << 60) - 1)
    for selector in np.unique(chosen):
        count, width = SELECTORS[selector]
        at = np.flatnonzero(chosen == selector)
        if selector == 0:
            out[starts[at]] = escapes[payload[at]]
            continue
        for i in range(count if width else 0):
            out[starts[at] + i] = (payload[at] >> U64(i * width)) & U64((1 << width) - 1)
    return out, starts


def decode(words: np.ndarray, escapes: np.ndarray, blocks: np.ndarray, low: int, high: int) -> np.ndarray:
    """Values low..high - 1; only the blocks that hold them are unpacked."""
    if high <= low:
        return np.zeros(0, dtype=U64)
    first, last = low // BLOCK, -(-high // BLOCK)
    begin = int(blocks[first])
    end = int(blocks[last]) if last < len(blocks) else len(words)
    out, starts = _unpack(words[begin:end], escapes)
    place = np.arange(low, high)
    return out[starts[blocks[first:last] - begin][place // BLOCK - first] + place % BLOCK]
