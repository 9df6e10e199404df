"""Personal data: base patterns, and a semi-Markov conditional random field that adds to them.

The base finds e-mail and IP addresses, card and phone numbers by fixed
patterns.  The field reads the places that hold a digit, an @ or a written-out
or bracketed dot (a *cluster*: such tokens and ``CONTEXT`` more on both sides),
scores whole candidate spans of up to ``MAX_TOKENS`` tokens and ``MAX_DIGITS``
digits within a line by features of the entire span (its shape, groups of
digits, check sum, the words beside a written-out "at", the length of its last
part, what stands beside it), and chooses boundaries and kinds together by
dynamic programming: a cluster is cut into single outside tokens and entities.
Entities of the best cut whose marginal probability is ``MIN_MARGIN`` or more
and that touch no base span are added.

It is trained by the exact gradient (forward-backward over
segments) on a bounded sample: TRAIN_CLUSTERS documents with a digit or an @,
those with the smallest hash, and as many clusters of theirs, labelled by the base patterns, and once more with each base span written
the ways people hide them (no country code, "at" and "dot", bracketed dots),
which is what the patterns alone miss.  MADE_UP lines of words of
the sample show hidden forms of all kinds with random values and host endings,
and dates, versions, ranges, order numbers, failed check sums and plain words
that only look like one ("look at that dot there").  No list of host endings is
used anywhere.

A span's features follow from its shape and a few facts, so they are made once
per shape and kept (``KEPT`` shapes a worker), and so are their scores: text
that is all numbers costs a lookup for each candidate.

Offsets are in code points.  Defined results: null and empty texts have no
spans; repeated rows and null ids each keep their own row; extra columns are
ignored; an empty table gives no rows; texts of any length are read whole, in
time linear in their length; ties between cuts go to the one found first.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, bounded_sample, task

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 18
MAX_DIGITS = 20
CONTEXT = 4
MIN_MARGIN = 0.95
BLOCK = 400  # tokens whose candidates are held at a time
KEPT = 1 << 15  # shapes whose features and scores a worker keeps
TRAIN_CLUSTERS = 800
MADE_UP = 2400
EPOCHS = 20
RARE = 6  # features of fewer training clusters get no weight, so that words never seen are judged by the rest

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match that fails at the start of digits fails inside them
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|\d")
TRIGGER = re.compile(r"[0-9@]|\b[dD][oO][tT]\b|[\[(]\.[\])]")
INNER = frozenset(".-()[]@+_%/")  # signs that may stand inside an entity
GOES_ON = re.compile(r"[\x20\[(]{1,3}dot\b|\.\w", re.IGNORECASE)  # after a span
COMES_FROM = re.compile(r"\b(?:dot|at)[\x20\])]{1,3}$", re.IGNORECASE)  # before one
AT_SIGN, DOT_SIGN = re.compile(r" ?[\[(]? ?[A@] ?[\])]? ?"), re.compile(r" ?[\[(]? ?D ?[\])]? ?|[\[(]\.[\])]")
LABEL, ADDRESS = re.compile("[a9_%+-]+"), re.compile(r"a(?:\.a)*@a(?:\.a)+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind, in the order of KINDS and then of place."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # e-mail: the local part is the run before an @, the same matches as the plain pattern in linear time
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for kind, pattern, low, high in (("card", CARD, 13, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = "".join(DIGIT.findall(m.group()))
            if low <= len(digits) <= high and (kind != "card" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def clusters(text: str) -> list[list[tuple[int, int]]]:
    """Token spans around every trigger, as long as the triggers go on."""
    out: list[list[tuple[int, int]]] = []
    end = -1
    for m in TRIGGER.finditer(text):
        if m.start() < end:
            continue  # inside the cluster before
        left = [t.span() for t in TOKEN.finditer(text, max(0, m.start() - 160, end), m.start())][-3 * CONTEXT :]
        tokens, quiet = left, 0
        for t in TOKEN.finditer(text, m.start()):
            tokens.append(t.span())
            quiet = 0 if TRIGGER.search(t.group()) else quiet + 1
            if quiet > 2 * CONTEXT:
                break
        end = tokens[-1][1]
        out.append(tokens)
    return out


def joined(text: str, parts: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Clusters with no token between them are one, so that no span stands across an end."""
    out: list[list[tuple[int, int]]] = []
    for part in parts:
        if out and TOKEN.search(text, out[-1][-1][1], part[0][0]) is None:
            out[-1] += part
        else:
            out.append(part)
    return out


@lru_cache(maxsize=KEPT)
def span_features(shape: str, before: str, after: str, check: str, words: tuple) -> tuple[str, ...]:
    """Features of a whole span, from its shape: a word is a, "at" is A, "dot" is D, each digit 9.

    ``check`` says whether its digits pass the check sum or are four octets; ``words`` are those
    beside an "at" and the length of the last part, where there are any.
    """
    numbers = re.findall("9+", shape)
    n, letters = sum(map(len, numbers)), "a" in shape
    hidden_at, hidden_dot = "A" in shape, "D" in shape or bool(re.search(r"[\[(]\.[\])]", shape))
    canon = DOT_SIGN.sub(".", AT_SIGN.sub("@", shape))
    canon = LABEL.sub("a", canon) if letters or "@" in canon else re.sub("9+", "9", canon)
    out = [
        f"shape={canon[:24]}", f"digits={n}", f"parts={min(len(numbers), 6)}", f"at={min(canon.count('@'), 2)}",
        f"dots={min(canon.count('.'), 4)}", f"plus={shape[0] == '+'}", f"paren={shape[0] == '('}", f"letters={letters}",
        f"spaces={min(shape.count(' '), 4)}", f"before={before}", f"after={after}", f"last={shape[-1]}", f"first={shape[0]}",
        f"hidden={hidden_at}{hidden_dot}", f"shape={canon[:24]} hidden={hidden_at or hidden_dot}", f"check={check}",
    ]
    if "@" in canon:
        out.append(f"address={bool(ADDRESS.fullmatch(canon))}")
        out += [f"{name}={w}" for name, w in zip(("name", "host", "top"), words) if w]
        out.append(f"address={bool(ADDRESS.fullmatch(canon))} after={after}")
    if not letters and "@" not in canon:
        groups = "-".join(str(len(x)) for x in numbers[:6])
        out += [f"groups={groups}", f"signs={''.join(sorted(set(canon) - {'9'}))}", f"number={shape[:24]}", f"shape={canon[:24]} check={check}"]
    if 9 <= n <= 12 and not letters:
        out.append("phone-length")
    if re.fullmatch(r"\(?999\)?[ .-]999[ .-]9999", shape):
        out.append("three-three-four")
    return tuple(out)


def _sums(number: str) -> tuple[int, int]:
    """Check sums of a number's digits with every second one doubled, from its first digit and from its second."""
    plain = [ord(c) - 48 for c in number]
    doubled = [2 * d - 9 * (d > 4) for d in plain]
    return sum(doubled[::2]) + sum(plain[1::2]), sum(plain[::2]) + sum(doubled[1::2])


def _words(word: list[str], mark: list[str], i: int, j: int) -> tuple:
    """Short words before and after the span's one "at", and the length of its last part."""
    ats = [k for k in range(i, j + 1) if mark[k] in "A@"]
    if len(ats) != 1:
        return ()
    around = ([k for k in range(i, ats[0]) if mark[k] == "a"][-1:], [k for k in range(ats[0] + 1, j + 1) if mark[k] == "a"][:1])
    short = (word[k[0]].lower() if k and len(word[k[0]]) <= 5 else "" for k in around)
    return (*short, min(len(word[j]), 8))


def candidates(text: str, tokens: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[str, ...]]:
    """Features of the token ranges that may be entities.

    These stay within a line, hold no sign that entities are not made of, and are
    either one "at" with a dot, or no word at all and as many digits as a kind
    has: four numbers between three dots, or 9 and more with at most three dots.
    Brackets that they open they close.
    """
    out: dict[tuple[int, int], tuple[str, ...]] = {}
    word = [text[a:b] for a, b in tokens]
    mark, before, after, gap, sums, octet = [], [], [], [], [], []
    for k, (w, (a, b)) in enumerate(zip(word, tokens)):
        number = "0" <= w[0] <= "9"
        mark.append("9" * min(len(w), MAX_DIGITS + 1) if number else {"at": "A", "dot": "D"}.get(w.lower(), "a") if w[0].isalnum() else w)
        sums.append(_sums(w) if number and len(w) <= MAX_DIGITS else (0, 0))
        octet.append(number and len(w) <= 3 and int(w) <= 255)
        left, right = text[a - 1 : a], text[b : b + 1]
        comes = left in (" ", "]", ")") and COMES_FROM.search(text[max(0, a - 7) : a])
        before.append("w" if left.isalnum() else left if left and left in ".@+-_/:$#" else "on" if comes else "-")
        after.append("w" if right.isalnum() else right if right and right in "@-_/:%" else "on" if GOES_ON.match(text, b) else "-")
        space = text[tokens[k - 1][1] : a] if k else ""
        gap.append(None if len(space) > 2 or "\n" in space or "\r" in space else " " if space else "")
    for i in range(len(tokens)):
        if not (mark[i] in "a+(" or mark[i][0] == "9"):
            continue
        shape, digits, numbers, octets, letters, at, dots, even, odd, brackets = "", 0, 0, True, False, False, 0, 0, 0, 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            m = mark[j]
            number = m[0] == "9"
            if j > i:
                if gap[j] is None or not (number or m in INNER or m in "aAD"):
                    break  # another line, or a sign that ends every entity
                shape += gap[j]
            shape += m
            if number:
                x, y = sums[j]
                even, odd = (even + y, odd + x) if digits % 2 else (even + x, odd + y)
                digits += len(m)
                numbers += 1
                octets &= octet[j]
                if digits > MAX_DIGITS:
                    break
            elif m == "a":
                letters = True
            else:  # a sign, written out or not: no entity ends here
                if m in "A@":
                    if at:
                        break  # none has two
                    at = True
                elif m in ".D":
                    dots += 1
                elif m in "([":
                    brackets += 1
                elif m in ")]":
                    brackets -= 1
                continue
            if brackets:
                continue
            if (at and dots) or (not letters and not at and dots <= 3 and (digits >= 9 or (dots == 3 and numbers == 4))):
                check, words = "-", ()
                if at:
                    words = _words(word, mark, i, j)
                elif 13 <= digits <= 19:
                    check = f"luhn-{(odd if digits % 2 else even) % 10 == 0}"
                elif numbers == 4:
                    check = f"octets-{octets}"
                out[i, j + 1] = span_features(shape, before[i], after[j], check, words)
    return out


def candidates_from(text: str, tokens: list[tuple[int, int]], a: int, b: int) -> dict[tuple[int, int], tuple[str, ...]]:
    """The candidates that start at tokens a to b - 1."""
    found = candidates(text, tokens[a : b + MAX_TOKENS])
    return {(a + i, a + j): features for (i, j), features in found.items() if a + i < b}


class SemiMarkovField:
    """Weights of (feature, kind); outside tokens score zero."""

    def __init__(self, weights: dict[str, list[float]] | None = None):
        self.weights = weights or {}
        self.known: dict[int, tuple] = {}  # by the identity of a feature list, which is held beside its score

    def score(self, features) -> list[float]:
        total = [0.0] * len(KINDS)
        for f in features:
            w = self.weights.get(f)
            if w:
                for k in range(len(KINDS)):
                    total[k] += w[k]
        return total

    def scores(self, spans) -> dict[tuple[int, int], list[float]]:
        return {ij: self.score(features) for ij, features in spans.items()}

    def weighed(self, features) -> tuple:
        """(features, scores, their log-sum, the best one, its kind); made once for each feature list."""
        got = self.known.get(id(features))
        if got is None:
            s = self.score(features)
            if len(self.known) >= KEPT:
                self.known.clear()
            got = self.known[id(features)] = (features, s, _log_sum(s), max(s), s.index(max(s)))
        return got

    @staticmethod
    def _by_end(scores, n):
        by_end = [[] for _ in range(n + 1)]
        for (i, j), s in scores.items():
            by_end[j].append((i, s))
        return by_end

    def marginals(self, scores, n: int):
        """Probability of each (range, kind) over all cuts, by forward-backward."""
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        by_end = self._by_end(scores, n)
        by_start = [[] for _ in range(n + 1)]
        for (i, j), s in scores.items():
            by_start[i].append((j, s))
        for j in range(1, n + 1):
            alpha[j] = _log_sum([alpha[j - 1], *(alpha[i] + x for i, s in by_end[j] for x in s)])
        for i in range(n - 1, -1, -1):
            beta[i] = _log_sum([beta[i + 1], *(beta[j] + x for j, s in by_start[i] for x in s)])
        total = alpha[n]
        return {ij: [math.exp(min(0.0, alpha[ij[0]] + x + beta[ij[1]] - total)) for x in s] for ij, s in scores.items()}

    def best_cut(self, scores, n: int) -> list[tuple[int, int, int]]:
        """The entities (from, to, kind) of the best cut."""
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        by_end = self._by_end(scores, n)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, s in by_end[j]:
                for k, x in enumerate(s):
                    if best[i] + x > best[j]:
                        best[j], back[j] = best[i] + x, (i, k)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((i, j, k))
                j = i
        return out[::-1]

    def read(self, spans_from, n: int, block: int) -> list[tuple[int, int, int, float]]:
        """The entities of the best cut with their marginals: the same as the two above, over blocks.

        ``spans_from(a, b)`` gives the features of the ranges that start in [a, b).
        They are held for one block, and made again for the way back, so memory
        beside a few numbers per token does not grow with n.
        """
        alpha, best, back = [0.0] * (n + 1), [0.0] * (n + 1), [None] * (n + 1)
        ahead: dict[int, list] = defaultdict(list)  # ranges that end at a later place

        def by_start(a):
            starts = defaultdict(list)
            for (i, j), features in spans_from(a, min(n, a + block)).items():
                starts[i].append((j, self.weighed(features)))
            return starts

        starts: dict[int, list] = {}
        for a in range(0, n, block):
            starts = by_start(a)
            for i in range(a, min(n, a + block)):
                for j, s in starts.get(i, ()):
                    ahead[j].append((i, s))
                j = i + 1
                best[j], terms = best[i], [alpha[i]]
                for start, (_, _, total, top, k) in ahead.pop(j, ()):
                    terms.append(alpha[start] + total)
                    if best[start] + top > best[j]:
                        best[j], back[j] = best[start] + top, (start, k)
                alpha[j] = _log_sum(terms) if len(terms) > 1 else terms[0]
        cut, j = {}, n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                cut[i] = (j, k)
                j = i
        if not cut:
            return []
        beta, out, last = [0.0] * (n + 1), [], (n - 1) // block * block
        for a in range(last, -1, -block):
            starts = starts if a == last else by_start(a)
            for i in range(min(n, a + block) - 1, a - 1, -1):
                here = starts.get(i, ())
                beta[i] = _log_sum([beta[i + 1], *(beta[j] + s[2] for j, s in here)]) if here else beta[i + 1]
                if i in cut:
                    j, k = cut[i]
                    x = next(s[1][k] for to, s in here if to == j)
                    out.append((i, j, k, math.exp(min(0.0, alpha[i] + x + beta[j] - alpha[n]))))
        return out[::-1]

    def fit(self, examples, epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-4) -> SemiMarkovField:
        """Stochastic ascent of the log-likelihood with AdaGrad; examples: (spans, n, gold ranges with kinds)."""
        squares: dict[str, list[float]] = defaultdict(lambda: [1e-6] * len(KINDS))
        seen: Counter = Counter()
        for spans, _, _ in examples:
            seen.update({f for features in spans.values() for f in features})
        order = list(range(len(examples)))
        rng = random.Random(11)
        for _ in range(epochs):
            rng.shuffle(order)
            for e in order:
                spans, n, gold = examples[e]
                gradient: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(KINDS))
                for ij, p in self.marginals(self.scores(spans), n).items():
                    want = gold.get(ij)
                    delta = [(1.0 if k == want else 0.0) - x for k, x in enumerate(p)]
                    if max(map(abs, delta)) < 1e-4:
                        continue
                    for f in spans[ij]:
                        g = gradient[f]
                        for k, d in enumerate(delta):
                            g[k] += d
                for f, g in gradient.items():
                    if seen[f] < RARE:
                        continue
                    w, q = self.weights.setdefault(f, [0.0] * len(KINDS)), squares[f]
                    for k, x in enumerate(g):
                        x -= decay * w[k]
                        q[k] += x * x
                        w[k] += rate * x / math.sqrt(q[k])
        return self


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def hidden_form(kind: str, s: str, rng: random.Random) -> str | None:
    """A base span as people write it to hide it; None where there is no such form."""
    if kind == "email":
        at, dot = rng.choice(HIDDEN_SIGNS)
        name, _, host = s.partition("@")
        return f"{name}{at}{host.replace('.', dot)}"
    if kind == "ip":
        return s.replace(".", rng.choice(HIDDEN_DOTS))
    if kind == "phone":
        short = re.sub(r"^\+[0-9]+[\x20.-]+", "", s)
        return short if short != s and len(DIGIT.findall(short)) >= 9 else None
    if kind == "card":
        groups = re.findall("[0-9]+", s)
        return rng.choice(CARD_SIGNS).join(groups) if len(groups) > 1 else None
    return None


def example(text: str, tokens: list[tuple[int, int]], base) -> tuple | None:
    """Candidates and gold ranges of a cluster; None if a gold span is no range of tokens."""
    starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: j + 1 for j, (_, b) in enumerate(tokens)}
    spans, gold = candidates(text, tokens), {}
    low, high = tokens[0][0], tokens[-1][1]
    for kind, a, b in base:
        if b <= low or a >= high:
            continue
        if (starts.get(a), ends.get(b)) not in spans:
            return None
        gold[starts[a], ends[b]] = KINDS.index(kind)
    taken = sorted(gold)
    if any(x[1] > y[0] for x, y in zip(taken, taken[1:])):
        return None  # spans of two kinds overlap: a cut has no place for both
    return (spans, len(tokens), gold) if spans else None


#: how people write signs so that patterns miss them
HIDDEN_SIGNS = (*[(" at ", " dot ")] * 4, (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("@", " dot "), ("@", "[.]"))
HIDDEN_DOTS = ("[.]", " dot ", "(.)", " [dot] ", " (dot) ", "[dot]")
CARD_SIGNS = (".", "/", " - ", ". ")
PHONE_FORMS = ("{}-{}-{}", "({}) {} {}", "({}) {}-{}", "{}.{}.{}", "{} {} {}", "({}){}-{}")
#: words that stand before a noun, so that "at" after them names a place and no host
DETERMINERS = ("the", "a", "an", "this", "that", "my", "your", "our", "his", "her", "its", "their", "each", "every", "one", "some")
#: things that are nobody's data; {0}, {1}, {2} are words, # any digit and ~ one above 2
PLAIN_WORDS = ("{0} at {det} dot {1}", "{0} at {det} dot {1}", "{0} at {det} {1} dot {2}", "the dot {0} at {1}", "{0} dot {1}", "{0} at {det} dot {1} at {det} {2} dot")
PLAIN_NUMBERS = (
    "####-##-##", "##/##/####", "####.##.## ##:##:##", "####-##-## ##:##", "####-##-##T##:##:##", "#.#.#", "v#.##.#", "# dot #", "# dot # dot #",
    "~~~ dot # dot ## dot #", "~~~[.]#[.]##[.]#", "###-####", "#####-####", "##-##", "####-####", "978-#-###-#####-#", "#,###,###", "## ### ###",
    "#### ####", "####", "##########", "###########", "#############", "$#,###.##", "#.## %", "## ## ## ##", "# # # # # #", "{0} {1} ####",
    "{0}-####-###", "no. #####", "###.###", "###-##-####", "##.####, -##.####", "### ###", "#### - ####", "#-#-#-#", "http://{0}.{1}/###/###",
    "{0}#{1}##", "#.#.#-##", "{0} at ##:##", "{0} at # dot", "####.####.####", "#### #### #### ####",
)


def card_number(rng: random.Random, good: bool = True) -> str:
    """Sixteen random digits that pass the check sum, or that do not."""
    head = f"{rng.randint(3, 6)}" + "".join(rng.choice("0123456789") for _ in range(14))
    return head + rng.choice([c for c in "0123456789" if luhn(head + c) == good])


def made_up_lines(words: list[str], n: int, seed: int, kinds=("email", "ip", "email", "phone", "email", "card")) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Lines of the given words with hidden entities of each kind in turn, every other one with things that only look like one."""
    rng, plainest = random.Random(seed), [w for w in words if w.lower() not in {*DETERMINERS, "at", "dot"}] or ["node"]
    word = lambda: rng.choice(plainest)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    ending = lambda: rng.choice((word().lower(), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice((2, 2, 3, 3, 4, 6))))))
    around = lambda: [word() + rng.choice(("", "", "", ",", ".")) for _ in range(rng.randint(0, 6))]

    def entity(kind):
        if kind == "email":
            at, dot = rng.choice(HIDDEN_SIGNS)
            name = rng.choice(("{}", "{}", "{}.{}", "{}_{}", "{}" + dot + "{}")).format(word(), word()) + rng.choice(("", "", digits(2)))
            return name + at + dot.join([*(word() for _ in range(rng.choice((1, 1, 2)))), ending(), *([ending()] if rng.random() < 0.2 else [])])
        if kind == "ip":
            return rng.choice(HIDDEN_DOTS).join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "phone":
            return rng.choice(PHONE_FORMS).format(rng.randint(200, 999), digits(3), digits(4))
        number = card_number(rng)
        return rng.choice(CARD_SIGNS).join(number[i : i + 4] for i in range(0, 16, 4))

    def plain():
        if rng.random() < 0.2:
            number = card_number(rng, good=False)
            return rng.choice(CARD_SIGNS + (" ", "-")).join(number[i : i + 4] for i in range(0, 16, 4))
        form = rng.choice(PLAIN_WORDS if rng.random() < 0.4 else PLAIN_NUMBERS).format(word(), word(), word(), det=rng.choice(DETERMINERS))
        return re.sub("[#~]", lambda m: rng.choice("0123456789" if m.group() == "#" else "3456789"), form)

    out = []
    for i in range(n):
        text, gold = " ".join([*around(), ""]), []
        for k in range(rng.choice((1, 1, 2))):
            text += rng.choice((", ", " or ", "\n", "; ")) if k else ""
            if i % 2:
                text += plain()
                continue
            kind = kinds[i // 2 % len(kinds)]
            form = entity(kind)
            gold.append((kind, len(text), len(text) + len(form)))
            text += form
        out.append((text + rng.choice((" ", " ", ". ", ", ")) + " ".join(around()), gold))
    return out


def sample_words(pieces: list[str]) -> list[str]:
    return sorted({w for p in pieces for w in re.findall(r"[^\W\d_]{2,}", p)})


def made_up_examples(pieces: list[str], n: int = MADE_UP) -> list[tuple]:
    found = [example(t, [m.span() for m in TOKEN.finditer(t)], gold) for t, gold in made_up_lines(sample_words(pieces), n, 12)]
    return [x for x in found if x]


def hidden_example(text: str, base) -> tuple | None:
    """The same with every base span in a hidden form."""
    rng = random.Random(text)
    out, at, marks = [], 0, []
    shift = 0
    for kind, a, b in sorted(base, key=lambda x: x[1]):
        form = hidden_form(kind, text[a:b], rng)
        if a < at or form is None:
            return None
        out += [text[at:a], form]
        marks.append((kind, a + shift, a + shift + len(form)))
        shift += len(form) - (b - a)
        at = b
    changed = "".join([*out, text[at:]])
    return example(changed, [t.span() for t in TOKEN.finditer(changed)], marks)


def training_pieces(docs: DataFrame, clusters_wanted: int = TRAIN_CLUSTERS) -> list[str]:
    """Pieces of text, one for each sampled cluster: a bounded number of bounded length."""
    with_digits = bounded_sample(docs.select("text").filter(F.col("text").rlike("[0-9@]")), "text", clusters_wanted)

    def run(batches):
        schema = arrow_schema("piece string, h long")
        for batch in batches:
            pieces = []
            for t in batch.column("text").to_pylist():
                for c in clusters(t)[:20]:
                    if len(c) <= 60:
                        pieces.append(t[c[0][0] : c[-1][1]])
            h = [int.from_bytes(hashlib.md5(p.encode("utf-8", "replace")).digest()[:7], "big") for p in pieces]
            yield as_batch({"piece": pieces, "h": h}, schema)

    sample = with_digits.mapInArrow(task(run), "piece string, h long")
    return [r.piece for r in sample.distinct().orderBy("h", "piece").limit(clusters_wanted).collect()]


def train(docs: DataFrame) -> SemiMarkovField:
    pieces = training_pieces(docs)
    examples = made_up_examples(pieces)
    for piece in pieces:
        base = base_spans(piece)
        got = [example(piece, [t.span() for t in TOKEN.finditer(piece)], base)]
        if base:
            got.append(hidden_example(piece, base))
        examples += [x for x in got if x]
    return SemiMarkovField().fit(examples)


def found_spans(text: str, field: SemiMarkovField) -> list[tuple[str, int, int]]:
    """Spans that the field adds to the base ones."""
    base = sorted(base_spans(text), key=lambda x: x[1])
    starts = [a for _, a, _ in base]
    ends = list(accumulate((b for _, _, b in base), max))
    out: list[tuple[str, int, int]] = []

    def free(a: int, b: int) -> bool:
        """Whether no base span and no added one, which come in order, overlaps the range."""
        before = bisect_left(starts, b)
        return not (before and ends[before - 1] > a) and not (out and out[-1][2] > a)

    for tokens in joined(text, clusters(text)):
        for i, j, k, p in field.read(lambda a, b: candidates_from(text, tokens, a, b), len(tokens), BLOCK):
            a, b = tokens[i][0], tokens[j - 1][1]
            if p >= MIN_MARGIN and free(a, b):
                out.append((KINDS[k], a, b))
    return out


COLUMNS = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
)


def write_spans(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def personal_data(docs: DataFrame, field: SemiMarkovField | None = None) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    weights = (field or train(docs)).weights

    def run(batches):
        schema = arrow_schema(COLUMNS)
        model = SemiMarkovField(weights)
        for batch in batches:
            out = {k: [] for k in schema.names}
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                t = t or ""
                base = base_spans(t)
                added = found_spans(t, model) if TRIGGER.search(t) else []
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                digest = hashlib.sha256(write_spans(base).encode()).hexdigest()
                for name, v in zip(schema.names, (doc_id, *counts, digest, write_spans([*base, *added]), len(added))):
                    out[name].append(v)
            yield as_batch(out, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task(run, 1000), COLUMNS)
