"""Counting many terms in Arrow batches of texts, without a Python step per hit.

The bytes of a batch lie end to end.  A term is filed under its first bytes
(four, or all of a shorter one).  A table of 64k flags over a hash of the bytes
at each place leaves the places where a term may begin; these are looked up
among the filed prefixes, paired with the terms of the prefix, and a pair holds
if a hash of as many bytes as the term has, from one running sum over the batch,
is the term's and the bytes then are, too.  All of it is array arithmetic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # places worked on at a time
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1
_SPREAD = np.uint32(0x9E3779B1)
_WIDEST = 4  # bytes of a prefix


def _places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs laid end to end: the run of each entry, and its place in the run."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _runs(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of neighbours whose sizes sum to at most ``most``, or that are one entry."""
    ends, out, a = np.cumsum(sizes), [], 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + most, "right")))
        out.append((a, b))
        a = b
    return out


def slices_of(batch: pa.RecordBatch, column: int, most: int = CHUNK):
    """The batch in slices whose texts hold at most ``most`` bytes, or that are one row.

    What a scan keeps grows with the hits of the texts it is given, so it is
    given little at a time, however many rows a batch has.
    """
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in _runs(sizes, most):
        yield batch.slice(a, b - a)


def _prefixes(flat: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each place as a number, zero behind the end."""
    out = flat.astype(np.uint32)
    padded = np.concatenate([flat, np.zeros(width, np.uint8)])
    for k in range(1, width):
        out |= padded[k : k + len(flat)].astype(np.uint32) << np.uint32(8 * k)
    return out


def _spread(x: np.ndarray) -> np.ndarray:
    return (x * _SPREAD) >> np.uint32(16)


def _overlaps_itself(term: bytes) -> bool:
    return any(term.startswith(term[k:]) for k in range(1, len(term)))


class TermScan:
    """Finds a list of distinct, not empty terms."""

    def __init__(self, terms: list[str]):
        data = [t.encode() for t in terms]
        self.terms = terms
        self.lengths = np.array([len(t) for t in data], np.int64)
        self.longest = int(self.lengths.max(initial=1))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(data), np.uint8)
        self.bordered = np.array([_overlaps_itself(t) for t in data], bool)
        self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(CHUNK + self.longest, _BASE, np.uint64)]))
        self.sums = self._hashes(self.flat, self.starts, self.lengths)
        # by width of the prefix: flags, the sorted prefixes, and which terms each has
        self.groups = []
        for width in range(1, _WIDEST + 1):
            some = np.flatnonzero(self.lengths >= width if width == _WIDEST else self.lengths == width)
            if not len(some):
                continue
            first = _prefixes(self.flat, width)[self.starts[some]]
            some = some[np.argsort(first, kind="stable")]
            prefixes, counts = np.unique(np.sort(first), return_counts=True)
            flags = np.zeros(1 << 16, bool)
            flags[_spread(prefixes)] = True
            self.groups.append((width, flags, prefixes, np.cumsum(counts) - counts, counts, some))

    def _hashes(self, flat: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A hash of ``lengths[i]`` bytes from place ``at[i]``, for all i."""
        out = np.empty(len(at), np.uint64)
        most = len(self.powers) - 1
        if len(flat) <= most:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[flat] * self.powers[: len(flat)])])
            # brought to one power, so that equal bytes have equal hashes wherever they stand
            out[:] = (sums[at + lengths] - sums[at]) * self.powers[most - at]
            return out
        for a in range(0, len(at), 1000):
            part = slice(a, a + 1000)
            begin, end = int(at[part].min()), int((at[part] + lengths[part]).max())
            for b in range(a, min(a + 1000, len(at))) if end - begin > most else ():
                out[b] = self._hashes(flat[at[b] : at[b] + lengths[b]], np.zeros(1, np.int64), lengths[b : b + 1])[0]
            if end - begin <= most:
                out[part] = self._hashes(flat[begin:end], at[part] - begin, lengths[part])
        return out

    def _pairs(self, flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places among the first n of ``flat`` and the terms that begin there."""
        places, terms = [], []
        for width, flags, prefixes, firsts, counts, some in self.groups:
            values = _prefixes(flat, width)[:n]
            at = np.flatnonzero(flags[_spread(values)])
            found = np.searchsorted(prefixes, values[at])
            known = found < len(prefixes)
            known[known] = prefixes[found[known]] == values[at][known]
            at, found = at[known], found[known]
            owner, nth = _places(counts[found])
            places.append(at[owner])
            terms.append(some[firsts[found][owner] + nth])
        at, term = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, terms))
        inside = at + self.lengths[term] <= len(flat)
        at, term = at[inside], term[inside]
        same = self._hashes(flat, at, self.lengths[term]) == self.sums[term]
        at, term = at[same], term[same]
        if not len(at):
            return at, term
        same = np.empty(len(at), bool)
        for a, b in _runs(self.lengths[term], CHUNK):
            some, lengths = term[a:b], self.lengths[term[a:b]]
            owner, nth = _places(lengths)
            equal = flat[at[a:b][owner] + nth] == self.flat[self.starts[some][owner] + nth]
            same[a:b] = np.logical_and.reduceat(equal, np.cumsum(lengths) - lengths)
        return at[same], term[same]

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and how often the text has the term, occurrences of one term not overlapping."""
        column = texts.cast(pa.large_binary())
        starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        flat = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data else np.zeros(0, np.uint8)
        starts = starts - starts[0]
        found = []
        for a in range(0, len(flat), CHUNK):
            at, term = self._pairs(flat[a : a + CHUNK + self.longest - 1], min(CHUNK, len(flat) - a))
            at = at + a
            row = np.searchsorted(starts, at, "right") - 1
            inside = at + self.lengths[term] <= starts[row + 1]
            found.append((row[inside], term[inside], at[inside]))
        row, term, at = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
        kept = ~self.bordered[term]
        loose = np.flatnonzero(~kept)
        kept[loose[self._apart(row[loose], term[loose], at[loose])]] = True
        pairs, counts = np.unique(row[kept] * len(self.terms) + term[kept], return_counts=True)
        return pairs // len(self.terms), pairs % len(self.terms), counts

    def _apart(self, row: np.ndarray, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which occurrences stay if each begins behind the one kept before it in its text."""
        order = np.lexsort((at, row, term))
        row, term, at = row[order], term[order], at[order]
        n = len(order)
        if not n:
            return order
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])
        group = np.cumsum(fresh) - 1
        # the next one to keep after each, were it kept; n stands for none
        scale = int(at.max()) + self.longest + 1
        keys = group * scale + at
        following = np.searchsorted(keys, keys + self.lengths[term])
        ends = np.append(np.flatnonzero(fresh)[1:], n)[group]
        following = np.append(np.where(following < ends, following, n), n)
        kept = np.append(fresh, False)
        for _ in range(max(1, int(n).bit_length())):  # reached in 1, 2, 4 ... steps
            kept[following[kept]] = True
            following = following[following]
        return order[kept[:n]]
