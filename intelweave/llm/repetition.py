"""Quality rules on repetition inside a text, from a suffix array over its words.

The suffixes of all texts of a batch are sorted together by prefix doubling:
level k ranks the 2^k words from each position, by text, so equal ranks mean
equal words.  Suffixes that share their first ``min_repeat`` words are the only
ones that can take part in a repeat; they alone are sorted on, and the longest
common prefix of neighbours in the suffix array is read off the levels.  The
LCP interval of greatest depth around a suffix gives the longest repeat that
starts there; it is maximal if the suffix before it does not carry the same
repeat one word longer.  The union of the spans of these repeats is what the
text says more than once.

A text is kept unless a base rule fails, that union covers more than
``max_covered`` of its words, or its longest repeat is over ``max_longest``
words.

Defined results: null and empty texts have no words and fail the base rule;
repeated rows and null ids each keep their own row; columns other than doc_id
and text are ignored; an empty table gives no rows.  Texts of any length are read whole.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, codes_of, list_array, spans_of, task

MIN_REPEAT = 8  # words; a power of two, shorter repeats are the language's own
MAX_COVERED = 0.3
MAX_LONGEST = 50

MIN_WORDS = 50
MAX_REPEAT_WORDS = 0.5

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: words sorted together; longer texts make a batch of their own
BATCH_WORDS = 1_000_000

COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered double, longest_repeat long, span_starts array<int>, span_ends array<int>"
)


def rank(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1; equal keys share one."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.empty(len(keys), np.int64)
    new[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]])) if len(keys) else 0
    return new


def _doubled(ranks: np.ndarray, step: int, ends: np.ndarray) -> np.ndarray:
    """Keys of twice the length: the rank here and the one ``step`` words on, 0 past the text."""
    at = np.arange(len(ranks)) + step
    beyond = at >= ends
    at[beyond] = 0
    return ranks * (len(ranks) + 1) + np.where(beyond, 0, ranks[at])


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def repeats(words: list[str], lengths: np.ndarray, min_repeat: int = MIN_REPEAT):
    """For texts laid end to end: in a repeated 3-word window, longest repeat from each position (0: none)."""
    n = len(words)
    text, _ = spans_of(lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    left = ends - np.arange(n)  # words to the end of the text
    codes, distinct = codes_of(words)
    levels = [rank(text * (len(distinct) + 1) + codes)]
    while 2 ** (len(levels) - 1) < min_repeat:
        k = len(levels) - 1
        levels.append(rank(_doubled(levels[k], 2**k, ends)))
    # windows of three words: the first two, and the two from the second on
    pairs = levels[1]
    whole = np.flatnonzero(left >= 3)
    triple = pairs[whole] * (n + 1) + (pairs[whole + 1] if n else 0)
    _, group, size = np.unique(triple, return_inverse=True, return_counts=True)
    twice = whole[size[group] > 1] if n else whole
    in_triple = _covered(twice, np.full(len(twice), 3), n)

    # suffixes that share their first min_repeat words with another one of the text
    top = levels[-1]
    counts = np.bincount(top) if n else np.zeros(1, int)
    active = np.flatnonzero((counts[top] > 1) & (left >= min_repeat)) if n else np.zeros(0, np.int64)
    longest = np.zeros(n, np.int64)
    if not len(active):
        return in_triple, longest
    # sort on: ranks of the active ones double their length until all differ
    step, place = min_repeat, top.copy()
    deep = [(min_repeat, place)]
    tied = active
    while len(tied):
        at = tied + step
        beyond = at >= ends[tied]
        at[beyond] = 0
        follow = np.where(beyond, 0, place[at])
        order = np.lexsort((follow, place[tied]))
        p, f = place[tied][order], follow[order]
        starts = np.concatenate([[True], p[1:] != p[:-1]])
        changes = np.concatenate([[True], (p[1:] != p[:-1]) | (f[1:] != f[:-1])])
        # a group's members move up by the number of smaller ones in the group
        first = np.maximum.accumulate(np.where(starts, np.arange(len(p)), 0))
        lead = np.maximum.accumulate(np.where(changes, np.arange(len(p)), 0))
        place = place * (n + 1) if step == min_repeat else place
        moved = place[tied][order] + (lead - first)
        place = place.copy()
        place[tied[order]] = moved
        step *= 2
        deep.append((step, place))
        _, group, size = np.unique(moved, return_inverse=True, return_counts=True)
        tied = tied[order][size[group] > 1]
    array = active[np.argsort(place[active], kind="stable")]  # the suffix array of the active ones
    a, b = array[:-1], array[1:]
    lcp = np.zeros(len(a), np.int64)
    shared = top[a] == top[b]
    for size, ranks in reversed(deep):
        x, y = a + lcp, b + lcp
        inside = shared & (x < ends[a]) & (y < ends[b])
        inside &= np.minimum(ends[a] - x, ends[b] - y) >= size
        inside[inside] = ranks[x[inside]] == ranks[y[inside]]
        lcp[inside] += size
    for k in range(len(levels) - 2, -1, -1):
        x, y = a + lcp, b + lcp
        inside = shared & (np.minimum(ends[a] - x, ends[b] - y) >= 2**k)
        inside[inside] = levels[k][x[inside]] == levels[k][y[inside]]
        lcp[inside] += 2**k
    np.maximum.at(longest, a, lcp)
    np.maximum.at(longest, b, lcp)
    return in_triple, longest


def _rules(min_repeat: int, max_covered: float, max_longest: int):
    def judged(ids, texts, words, lengths):
        n_docs = len(lengths)
        text, _ = spans_of(lengths)
        in_triple, longest = repeats(words, lengths, min_repeat)
        n = len(words)
        spans = np.flatnonzero(longest)
        inside = _covered(spans, longest[spans], n)
        n_repeat = np.bincount(text, weights=in_triple, minlength=n_docs).astype(np.int64)
        n_inside = np.bincount(text, weights=inside, minlength=n_docs)
        most = np.zeros(n_docs, np.int64)
        np.maximum.at(most, text, longest)
        covered = n_inside / np.maximum(lengths, 1)
        failed = (lengths < MIN_WORDS) | (n_repeat > MAX_REPEAT_WORDS * lengths)
        # the union as spans, in words of the text
        first = np.cumsum(lengths) - lengths
        edge = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]) | (inside & (np.arange(n) == first[text])))
        close = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | (np.arange(n) + 1 == (first + lengths)[text])))
        per_doc = np.bincount(text[edge], minlength=n_docs)
        dup_lines = []
        for t in texts:
            lines = [x for x in t.split("\n") if WORD.search(x)]
            dup_lines.append(len(lines) - len(set(lines)))
        return {
            "doc_id": ids, "n_words": lengths,
            "word_chars": np.array([sum(map(len, words[a : a + k])) for a, k in zip(first, lengths)], np.int64),
            "n_symbols": [len(SYMBOLS.findall(t)) for t in texts],
            "n_dup_lines": dup_lines, "n_repeat_words": n_repeat, "base_failed": failed,
            "kept": ~failed & (n_inside <= max_covered * lengths) & (most <= max_longest),
            "covered": covered, "longest_repeat": most,
            "span_starts": list_array((edge - first[text[edge]]).astype(np.int32), per_doc),
            "span_ends": list_array((close + 1 - first[text[close]]).astype(np.int32), per_doc),
        }

    def run(batches):
        schema = arrow_schema(COLUMNS)
        for batch in batches:
            ids, texts, words, lengths = [], [], [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                w = WORD.findall(t or "")
                if words and len(words) + len(w) > BATCH_WORDS:
                    yield as_batch(judged(ids, texts, words, np.array(lengths, np.int64)), schema)
                    ids, texts, words, lengths = [], [], [], []
                ids.append(i)
                texts.append(t or "")
                words += w
                lengths.append(len(w))
            if ids:
                yield as_batch(judged(ids, texts, words, np.array(lengths, np.int64)), schema)

    return run


def repetition_rules(
    docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """One row per document with its counts, its repeated spans (in words) and the verdict."""
    if min_repeat < 4 or min_repeat & (min_repeat - 1):
        raise ValueError("min_repeat is a power of two, 4 at least")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task(_rules(min_repeat, max_covered, max_longest), 1000), COLUMNS)
