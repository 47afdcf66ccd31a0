"""Joining neighbours of lowest rank in many words at a time, as numpy columns.

A word is a column of tokens with, beside each, the rank of its join with the next token. A step finds every column's lowest rank, the leftmost of
equals, joins there and refreshes the two ranks around it; it goes on until no column has a rank. Used by both byte-pair coders.
"""
from itertools import chain, filterfalse

import numpy as np

LONGEST = 62  # tokens of a word here: a rank and its place share 32 bits
COLUMNS = 4096
GROUP_CHARS = 1 << 19
MOST_RANKS = 1 << 25
_PLACES = 64
_NONE = np.iinfo(np.int32).max


class Joins:
    """``pairs`` holds (left token, right token, rank); ``joined`` the token made at each rank."""

    def __init__(self, pairs, joined, n_tokens):
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        key = left * (n_tokens + 1) + right
        order = np.argsort(key)
        self.keys, self.ranks = np.append(key[order], np.iinfo(np.int64).max), np.append(rank[order] * _PLACES, 0).astype(np.int32)
        self.joined, self.no_token = np.asarray(joined, np.int64), n_tokens

    def _near(self, left, right, place):
        key = left * (self.no_token + 1) + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at] + place, _NONE).astype(np.int32)

    def words(self, tokens, sizes):
        """The joined tokens of words given one after the other, and how many each word has; no word is longer than LONGEST."""
        starts = np.cumsum(sizes) - sizes
        counts, parts = np.zeros(len(sizes), np.int64), []
        order = np.argsort(sizes, kind="stable")
        for a in range(0, len(order), COLUMNS):
            some = order[a:a + COLUMNS]
            ids, counts[some] = self._columns(tokens, starts[some], sizes[some])
            parts.append(ids)
        flat, to = np.concatenate(parts) if parts else tokens[:0], np.cumsum(counts) - counts
        ordered = np.empty_like(flat)
        n = counts[order]
        ordered[np.repeat(to[order] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
        return ordered, counts

    def _columns(self, tokens, starts, sizes):
        n, width = len(sizes), int(sizes.max())
        place = np.arange(1, width + 1)[:, None]
        inside = place <= sizes
        token = np.full((width + 2, n), self.no_token, np.int64)  # a row without tokens on either side
        token[1:-1][inside] = tokens[(starts + place - 1)[inside]]
        near = np.full((width + 2, n), _NONE, np.int32)
        near[1:-1] = self._near(token[1:-1], token[2:], place)
        after = np.repeat(np.arange(1, width + 3)[:, None], n, axis=1)
        before = after - 2
        here = np.zeros(token.shape, bool)
        here[1:-1] = inside
        t, r, nxt, prev, alive = token.ravel(), near.ravel(), after.ravel(), before.ravel(), here.ravel()
        while True:
            low = near.min(axis=0)
            col = np.flatnonzero(low != _NONE)
            if not len(col):
                break
            low = low[col]
            i = low % _PLACES
            at = i * n + col
            gone = nxt[at] * n + col
            stop = nxt[gone]
            made = self.joined[low // _PLACES]
            t[at], nxt[at], alive[gone], r[gone] = made, stop, False, _NONE
            stop_at = stop * n + col
            prev[stop_at] = i
            r[at] = self._near(made, t[stop_at], i)
            j = prev[at]
            j_at = j * n + col
            r[j_at] = self._near(t[j_at], made, j)
        return token.T[here.T], here.sum(axis=0)


def grouped(texts, chars=GROUP_CHARS):
    """Runs of whole texts of about ``chars`` characters, null as empty, so that the words at hand stay few."""
    group, size = [], 0
    for t in texts:
        group.append(t or "")
        size += len(group[-1])
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def looked_up(memory, lists, make, keep, length):
    """What ``memory`` holds for lists of keys, after ``make`` gave the values of new ones.

    A memory that would pass ``keep`` entries forgets what these lists do not use; keys of more than ``length`` are forgotten at once.
    """
    new = list(set(filterfalse(memory.__contains__, chain.from_iterable(lists))))
    if len(memory) + len(new) > keep:
        stay = {k: memory[k] for k in set().union(*lists).difference(new)}
        memory.clear()
        memory.update(stay)
    memory.update(zip(new, make(new)))
    out = [list(map(memory.__getitem__, keys)) for keys in lists]
    for k in new:
        if len(k) > length:
            del memory[k]
    return out
