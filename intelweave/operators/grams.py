"""Byte grams and word runs of texts, by array arithmetic over Arrow batches.

Texts and terms are compared as UTF-8, where one contains the other exactly if
its bytes do.  A gram is up to eight bytes in one whole number.  Every kernel
works on the bytes of a column laid end to end, a bounded run of places at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WIDEST = 8
# bits of a counter: the sketches have one entry per counter, however many grams there are
BITS = 20
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def flat_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column laid end to end, and where each text starts (one more at the end)."""
    column = column.cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data and len(column) else np.zeros(0, np.uint8)
    return flat, starts - starts[0]


def counters(codes: np.ndarray, width: int) -> np.ndarray:
    """The counter of each gram of a width."""
    mixed = (codes ^ np.uint64(width)) * _ODD
    return (((mixed ^ (mixed >> np.uint64(32))) * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def _codes(flat: np.ndarray, a: int, b: int) -> np.ndarray:
    """The eight bytes from each of the places a to b, zero behind the end."""
    part = np.zeros(b - a + WIDEST - 1, np.uint64)
    some = flat[a : b + WIDEST - 1]
    part[: len(some)] = some
    out = part[: b - a].copy()
    for k in range(1, WIDEST):
        out |= part[k : k + b - a] << np.uint64(8 * k)
    return out


def places_of(column: pa.Array, widths, flags: np.ndarray | None = None):
    """Runs of (text, width, gram, counter, place) of the column; with ``flags`` those whose counter is flagged."""
    flat, starts = flat_of(column)
    for a in range(0, len(flat), CHUNK):
        b = min(a + CHUNK, len(flat))
        whole = _codes(flat, a, b)
        for width in widths:
            codes = whole & np.uint64((1 << (8 * width)) - 1)
            counter = counters(codes, width)
            at = np.flatnonzero(flags[counter]) if flags is not None else np.arange(b - a)
            row = np.searchsorted(starts, at + a, "right") - 1
            inside = at + a + width <= starts[row + 1]
            at, row = at[inside], row[inside]
            yield row, width, codes[at], counter[at], at + a


def texts_with(column: pa.Array, widths, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flagged counters and how many texts have each; a text that is in two runs of places counts once."""
    size = np.int64(1 << BITS)
    pairs = [np.unique(row * size + counter) for row, _, _, counter, _ in places_of(column, widths, flags)]
    pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return np.unique(pairs % size, return_counts=True)


def grams_met(column: pa.Array, widths, flags: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (text, width, gram) whose counter is flagged, the counters, and how often the text has the gram.

    The last is zero where two places of a gram overlap, which are not counted here.
    """
    runs = [(row, np.full(len(row), width), code.view(np.int64), counter, at) for row, width, code, counter, at in places_of(column, widths, flags)]
    row, width, code, counter, at = (np.concatenate([r[k] for r in runs]) if runs else np.zeros(0, np.int64) for k in range(5))
    order = np.lexsort((at, code, width, row))
    row, width, code, counter, at = row[order], width[order], code[order], counter[order], at[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (width[1:] != width[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(fresh)
    n = np.diff(np.append(first, len(row)))
    close = np.zeros(len(row), bool)
    close[1:] = ~fresh[1:] & (at[1:] - at[:-1] < width[1:])
    n[(np.cumsum(fresh) - 1)[close]] = 0
    return row[first], width[first], code[first], counter[first], n


def own_grams(terms: pa.Array):
    """(term, width, gram, counter) of a column of terms: their grams of the widest width they have."""
    lengths = np.diff(flat_of(terms)[1])
    for width in range(1, WIDEST + 1):
        some = np.flatnonzero(lengths >= width if width == WIDEST else lengths == width)
        if len(some):
            for row, _, code, counter, _ in places_of(terms.take(pa.array(some)), [width]):
                yield some[row], width, code.view(np.int64), counter


def rarest(terms: pa.Array, texts: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each term the gram that the fewest texts have by the sketch: (term, width, gram, counter)."""
    runs = [(row, np.full(len(row), width), code, counter) for row, width, code, counter in own_grams(terms)]
    row, width, code, counter = (np.concatenate([r[k] for r in runs]) if runs else np.zeros(0, np.int64) for k in range(4))
    order = np.lexsort((code, texts[counter], row))
    row, width, code, counter = row[order], width[order], code[order], counter[order]
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    return row[first], width[first], code[first], counter[first]


def word_runs(column: pa.Array, most: int) -> tuple[np.ndarray, ...]:
    """Runs of one to ``most`` words of texts whose words are joined by one blank: (text, begin, end, counter).

    Begin and end are places among the bytes of the column.
    """
    flat, starts = flat_of(column)
    blank = flat == 32
    first = np.ones(len(flat), bool)
    first[1:] = blank[:-1]
    first[starts[:-1][starts[:-1] < len(flat)]] = True
    begin = np.flatnonzero(first & ~blank)
    row = np.searchsorted(starts, begin, "right") - 1
    # a word ends before the next blank or where its text ends
    gaps = np.flatnonzero(blank)
    nth = np.searchsorted(gaps, begin)
    end = np.minimum(np.append(gaps, len(flat))[nth], starts[row + 1])
    # running sums of weighted bytes, brought to one power: equal runs have equal hashes wherever they stand
    powers, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(flat), x, np.uint64)])) for x in (_ODD, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
    out = []
    for n in range(most):
        some = np.arange(max(len(begin) - n, 0))
        some = some[row[some] == row[some + n]]
        b, e = begin[some], end[some + n]
        hashed = (sums[e] - sums[b]) * back[b]
        out.append((row[some], b, e, counters(hashed, 0)))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


def strings_at(column: pa.Array, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts between places of a column."""
    flat, lengths = flat_of(column)[0], end - begin
    ends = np.cumsum(lengths)
    nth = np.arange(int(lengths.sum())) - np.repeat(ends - lengths, lengths)
    data = flat[np.repeat(begin, lengths) + nth]
    offsets = np.concatenate([np.zeros(1, np.int64), ends])
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def heads_met(column: pa.Array, most: int, flags: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(text, run): distinct runs of one to ``most`` words whose counter is flagged."""
    row, begin, end, counter = word_runs(column, most)
    some = np.flatnonzero(flags[counter])
    found = strings_at(column, begin[some], end[some]).dictionary_encode()
    size = max(len(found.dictionary), 1)
    pairs = np.unique(row[some] * size + found.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    return pairs // size, found.dictionary.take(pa.array(pairs % size))


def whole_counters(heads: pa.Array, most: int) -> np.ndarray:
    """The counters of whole texts of at most ``most`` words."""
    starts = flat_of(heads)[1]
    row, begin, end, counter = word_runs(heads, most)
    return np.unique(counter[(begin == starts[row]) & (end == starts[row + 1])])
