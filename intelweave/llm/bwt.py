"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

The strings of a collection are laid on a grid of columns.  Each round goes one
column to the left and inserts, for every string that has a symbol there, the
suffix that begins with it.  Where it belongs follows from the transform so far:
the suffix ``cY`` stands among those that begin with c where Y stands among the
suffixes that c precedes, so its place is a count of c in the transform before
Y.  The common prefix of two neighbours ``cY`` and ``cV`` is one more than the
least common prefix between Y and V.  A round reads the transform and the
prefixes as streams from front to back and writes them anew with the insertions
merged in; nothing is ever compared symbol by symbol.

Rounds are gathered in bands.  A band starts from the strings' suffixes in
order, as ranked end marks with the common prefixes of neighbours, builds the
transform over its columns, and hands on the order and the common prefixes of
the longest suffixes.  Suffixes that begin in different columns are therefore
ordered by the columns of a band only; the collections built here are aligned, and
suffixes of one column are what is compared.  It keeps a round's streams at a
band's width times the number of strings, however long the strings are.

Streams are buffers in memory: a collection is what one task takes at a time,
and its size is bounded by the caller.
"""

from __future__ import annotations

import numpy as np

from .common import spans_of

BAND = 16
_PLACE = np.uint32(23)  # bits of a place in the transform; the symbol stands above
_MASK = np.uint32((1 << 23) - 1)
#: strings that a collection may have, so that places of a band fit
MOST_STRINGS = (1 << 23) // (BAND + 2)


def grid(flat: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by column and string (0: none), and the first column of each string.

    The strings lie end to end in ``flat``; byte ``before[j]`` of string j stands
    in the column that all strings share.
    """
    first = int(before.max(initial=0)) - before
    width = int((first + lengths).max(initial=0))
    used = np.bincount(flat, minlength=256) > 0
    symbol = np.cumsum(used).astype(np.uint16)  # dense, from 1
    cells = np.zeros((width, len(lengths)), np.uint8 if symbol[-1] < 256 else np.uint16)
    owner, place = spans_of(lengths)
    cells[first[owner] + place, owner] = symbol[flat]
    return cells, first


class Band:
    """The transform and the common prefixes of the suffixes of one band."""

    def __init__(self, ends: int, symbols: np.ndarray, prefixes: np.ndarray, most: int):
        self.ends, self.most = ends, most
        self.symbols, self.prefixes = symbols, prefixes

    def insert(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """One suffix for each place in ``at`` (of the suffix it extends); ``left`` are the symbols before the new ones.

        Returns the places of the new suffixes in the transform as it then is.
        """
        symbols, prefixes = self.symbols, self.prefixes
        n = len(symbols)
        keys = np.sort((symbols.astype(np.uint32) << _PLACE) | np.arange(n, dtype=np.uint32))
        key = (symbols[at].astype(np.uint32) << _PLACE) | at.astype(np.uint32)
        nth = np.searchsorted(keys, key)
        idle = int(np.searchsorted(keys, np.uint32(1) << _PLACE))  # suffixes that nothing precedes
        places = self.ends + nth - idle
        # the nearest suffixes around that the same symbol precedes
        before = keys[np.maximum(nth - 1, 0)]
        has_before = ((before >> _PLACE) == (key >> _PLACE)) & (nth > 0)
        after = keys[np.minimum(nth + 1, n - 1)]
        has_after = ((after >> _PLACE) == (key >> _PLACE)) & (nth + 1 < n)
        low = self._least((before & _MASK)[has_before].astype(np.int64), at[has_before])
        high = self._least(at[has_after], (after & _MASK)[has_after].astype(np.int64))
        fresh = np.zeros(n + len(at), bool)
        fresh[places] = True
        old = ~fresh
        merged, shared = np.empty(n + len(at), symbols.dtype), np.empty(n + len(at), prefixes.dtype)
        merged[old], shared[old] = symbols, prefixes
        merged[places] = left
        shared[places[has_after] + 1] = high
        shared[places] = 0
        shared[places[has_before]] = low
        self.symbols, self.prefixes = merged, shared
        return places

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """One more than the least prefix after place low up to place high."""
        if not len(low):
            return np.zeros(0, self.prefixes.dtype)
        cuts = np.empty(2 * len(low), np.int64)
        cuts[::2], cuts[1::2] = low + 1, high + 1
        least = np.minimum.reduceat(np.append(self.prefixes, self.prefixes.dtype.type(0)), cuts)[::2]
        return np.minimum(least.astype(np.int64) + 1, self.most).astype(self.prefixes.dtype)


def shared_windows(flat: np.ndarray, lengths: np.ndarray, before: np.ndarray, span: int, band: int = BAND) -> np.ndarray:
    """For each place of each string, end to end: whether the ``span`` bytes from there are also those of another string.

    Bytes of the same column are compared, as ``span`` is more than a band has columns.
    """
    if span <= band:
        raise ValueError("a span must be longer than a band")
    cells, first = grid(flat, lengths, before)
    last = first + lengths - 1
    kind = np.uint8 if span < 255 else np.uint16
    width, m = cells.shape
    hits = np.zeros(cells.shape, bool)
    order, prefixes = np.zeros(0, np.int64), np.zeros(0, kind)
    for top in range(width - 1, -1, -band):
        bottom = max(top - band + 1, 0)
        # strings that begin (at their right end) in this band: empty ends, before all others
        fresh = np.flatnonzero((last >= bottom) & (last <= top))
        ids = np.concatenate([fresh, order])
        if not len(ids):
            continue
        begun = np.concatenate([last[fresh] == top, np.ones(len(order), bool)])
        state = Band(len(ids), np.where(begun, cells[top, ids], 0).astype(cells.dtype), np.concatenate([np.zeros(len(fresh), kind), prefixes]), span)
        places = np.arange(len(ids))
        for column in range(top, bottom - 1, -1):
            active = np.flatnonzero(cells[column, ids] > 0)
            if len(active):
                left = cells[column - 1, ids[active]] if column else np.zeros(len(active), cells.dtype)
                places[active] = state.insert(places[active], left)
                at = places[active]
                whole = last[ids[active]] - column + 1 >= span
                if whole.any():
                    following = np.append(state.prefixes[1:], state.prefixes.dtype.type(0))
                    hit = (state.prefixes[at] >= span) | (following[at] >= span)
                    hits[column, ids[active]] = hit & whole
            if column > bottom:  # strings whose last symbol stands in the next column
                start = np.flatnonzero(last[ids] == column - 1)
                state.symbols[places[start]] = cells[column - 1, ids[start]]
        on = np.flatnonzero(first[ids] < bottom)
        on = on[np.argsort(places[on])]
        order = ids[on]
        if len(on):
            cuts = places[on] + 1
            prefixes = np.concatenate([[0], np.minimum.reduceat(np.append(state.prefixes, kind(0)), cuts)[:-1]]).astype(kind)
    owner, place = spans_of(lengths)
    return hits[first[owner] + place, owner]
