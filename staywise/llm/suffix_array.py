"""Suffix array of one shard by the difference-cover method, in numpy.

The suffixes that start at positions 1 and 2 modulo 3 are the sample.  Their
leading triples are sorted and named; while names repeat, the string of names
is sorted by the same method.  The remaining suffixes are sorted by their
first symbol and the rank of the sampled suffix behind it, and both orders are
merged by comparing at most two symbols and a rank.
"""

from __future__ import annotations

import numpy as np


def _order(*keys: np.ndarray) -> np.ndarray:
    """Order by non-negative integer keys, the first one leading; equal rows in any order."""
    packed, bits = None, 0
    # Keys are packed into as few 63-bit words as they need.
    words = []
    for key in reversed(keys):
        need = max(1, int(key.max(initial=0)).bit_length())
        if packed is None or bits + need > 63:
            if packed is not None:
                words.append(packed)
            packed, bits = key.astype(np.int64), need
        else:
            packed, bits = packed | (key.astype(np.int64) << bits), bits + need
    words.append(packed)
    if len(words) == 1:
        return np.argsort(words[0])
    return np.lexsort(words)


def _names(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 along a sorted order, equal keys sharing one."""
    new = np.zeros(len(order), dtype=bool)
    if len(order):
        new[0] = True
    for key in keys:
        along = key[order]
        new[1:] |= along[1:] != along[:-1]
    names = np.empty(len(order), dtype=np.int64)
    names[order] = np.cumsum(new)
    return names


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in lexicographic order; symbols are integers from 0."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), dtype=np.int64)
    # Symbols from 1, so that the padding is smaller than any of them.
    s = np.zeros(n + 3, dtype=np.int64)
    s[:n] = text
    s[:n] += 1
    # Position n joins the sample if n = 1 mod 3, so that every remaining suffix has a sampled one behind it.
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    first, second, third = s[sample], s[sample + 1], s[sample + 2]
    order = _order(first, second, third)
    names = _names(order, first, second, third)
    if names.max(initial=0) < len(sample):
        # A smaller name than any other ends the first half, padding the second.
        order = suffix_array(names)
        names = np.empty(len(sample), dtype=np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sample] = names
    ordered = sample[order]
    ordered = ordered[ordered < n]
    rest = np.arange(0, n, 3)
    rest = rest[_order(s[rest], rank[rest + 1])]

    top = int(rank.max()) + 1
    wide = int(s.max()) + 1
    one, two = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    before = np.searchsorted(s[one] * top + rank[one + 1], s[rest] * top + rank[rest + 1])
    if wide * wide * top < 1 << 62:
        pair = lambda at: (s[at] * wide + s[at + 1]) * top + rank[at + 2]
    else:  # symbols are names of a deep recursion: name the pairs first
        both = np.concatenate([two, rest])
        pairs = _names(_order(s[both], s[both + 1]), s[both], s[both + 1])
        named = np.zeros(n, dtype=np.int64)
        named[both] = pairs
        pair = lambda at: named[at] * top + rank[at + 2]
    before += np.searchsorted(pair(two), pair(rest))
    merged = np.empty(n, dtype=np.int64)
    places = before + np.arange(len(rest))
    merged[places] = rest
    free = np.ones(n, dtype=bool)
    free[places] = False
    merged[free] = ordered
    return merged
