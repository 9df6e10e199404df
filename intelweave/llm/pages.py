"""Main text of web pages by differencing with the nearest page of the host.

1. A page is read into lines, one for each block of text, with where it stands:
   in the article (an ``article`` or ``main`` element), in a part that mark-up
   names as furniture (menus, headers, footers, asides, forms, adverts,
   notices, comments), or neither.
2. Within each host pages are ordered by URL path; a page's pair is the
   neighbour that shares the longer path prefix.  The order is made by range
   partitions whose ends are then joined up, so a host with very many pages is
   not sorted by one task.
3. The two pages' lines are aligned by longest common subsequence, as hashes,
   and the shared ones are deleted as the host's template.  A line of an article
   goes only if the host shows it to be template: at least ``TEMPLATE_PAGES`` of
   its pages (all, where it has fewer) and ``TEMPLATE_SHARE`` of them have the
   line.  A title or a sentence that two articles have in common stays.
4. Text is put together from what is left, inside an article or not.

Two things differencing cannot decide are read from the mark-up, as the last
step: furniture that is new on every page goes though no pair shares it, and an
article of which the pair shares ``COPIED`` or more of the characters is a copy,
whose lines all come back.

Defined results: null or empty html gives an empty text; a page without host or
alone on its host has no pair; repeated rows and null ids each keep their own
row; unclosed elements end with the element around them, a tag that never ends
is text, a quote that nothing closes is a character; an empty table gives an
empty one; extra columns are ignored.  Pages of any length are read whole, in
time that grows with their length.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from os.path import commonprefix

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, materialize, task

NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"[<>\"']")
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
ARTICLE = frozenset(("article", "main"))
FURNITURE = frozenset("nav footer aside form header button select menu dialog template svg head figure-nav".split())
#: whole words of class, id and role that mark furniture
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header menu nav navbar navigation newsletter notice popup promo related reply share sharing sidebar social "
    "sponsor sponsored subscribe toolbar widget complementary contentinfo".split()
)
NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NEITHER, IN_ARTICLE, IN_FURNITURE = 0, 1, 2
COPIED = 0.8
#: an article's line is the host's template if so many of its pages (or all, if it has fewer) have it, and this share of them
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.2


def _is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in FURNITURE and not (name == "header" and in_article):
        return True
    for m in NAMED.finditer(attributes):
        value = next(x for x in m.groups() if x is not None)
        if FURNITURE_WORDS.intersection(re.split(r"[\s_-]+", value.lower())):
            return True
    return False


class Markup:
    """Tags of a page from front to back; every search moves on, so malformed pages take no longer."""

    def __init__(self, html: str):
        self.html, self.last = html, {x: html.rfind(x) for x in (">", '"', "'")}

    def tag_end(self, at: int) -> int:
        """The place behind the ``>`` that ends the tag whose name ends at ``at``; -1 where a ``<`` or the page's end comes first.

        A quote that nothing closes is a character like any other.
        """
        html = self.html
        while at <= self.last[">"]:
            m = STOP.search(html, at)
            ch, at = html[m.start()], m.end()
            if ch == ">":
                return at
            if ch == "<":
                return -1
            if m.start() < self.last[ch]:
                at = html.find(ch, at) + 1
        return -1

    def next_tag(self, at: int) -> tuple[int, int, bool, str | None, str]:
        """Begin and end of the next mark-up, whether it closes, its name (None: comment, declaration) and attributes; (-1, ...) if there is none."""
        html = self.html
        while (begin := html.find("<", at)) >= 0:
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 4)
                return begin, len(html) if end < 0 else end + 3, False, None, ""
            if html[begin + 1 : begin + 2] in ("!", "?") and begin < self.last[">"]:
                return begin, html.find(">", begin) + 1, False, None, ""
            if m := NAME.match(html, begin + 1):
                end = self.tag_end(m.end())
                if end >= 0:
                    return begin, end, html[begin + 1] == "/", m[1], html[m.end() : end - 1]
            at = begin + 1
        return -1, -1, False, None, ""


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """(text, where) of every block of text, in page order; white space inside is one space."""
    if not html:
        return []
    lines: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements with where their text stands
    opened: Counter[str] = Counter()  # and how many of each name
    where, at, markup = NEITHER, 0, Markup(html)

    def flush():
        line = " ".join("".join(text).split())
        if line:
            lines.append((line, where))
        text.clear()

    while at < len(html):
        begin, end, closing, name, attributes = markup.next_tag(at)
        text.append(entities.unescape(html[at : begin if begin >= 0 else len(html)]))
        if begin < 0:
            break
        at = end
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not closing:
            end = RAW[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in INLINE and not closing and (name != "a" or not stack) and not NAMED.search(attributes):
            continue
        if closing:
            if name in INLINE and all(n != name for n, _ in stack[-8:]):
                continue
            flush() if name not in INLINE else None
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if name in INLINE and stack[k][1] != (stack[k - 1][1] if k else NEITHER):
                    flush()
                opened.subtract(n for n, _ in stack[k:])
                del stack[k:]
                where = stack[-1][1] if stack else NEITHER
            continue
        inner = where
        if where != IN_FURNITURE:
            if _is_furniture(name, attributes, where == IN_ARTICLE):
                inner = IN_FURNITURE
            elif name in ARTICLE or re.search(r"role\s*=\s*[\"']?main\b", attributes):
                inner = IN_ARTICLE
        if name not in INLINE or inner != where:
            flush()
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()  # a paragraph ends where the next begins
            opened["p"] -= 1
        stack.append((name, inner))
        opened[name] += 1
        where = inner
    flush()
    return lines


def shared_lines(own: np.ndarray, other: np.ndarray) -> list[int]:
    """Places in ``own`` of a longest common subsequence with ``other``."""
    head = 0
    while head < min(len(own), len(other)) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    a, b = own[head : len(own) - tail], other[head : len(other) - tail]
    return [*range(head), *(head + i for i in _subsequence(a, b)), *range(len(own) - tail, len(own))]


def _subsequence(a, b, cells: int = 1 << 31) -> list[int]:
    """Bit-parallel longest common subsequence; very long sides are halved first, which keeps memory bounded."""
    if not len(a) or not len(b):
        return []
    if len(a) * len(b) > cells and len(a) > 1:
        half = len(a) // 2
        first = _row_lengths(a[:half], b)
        last = _row_lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int(np.argmax(first + last))
        return [*_subsequence(a[:half], b[:cut], cells), *(half + i for i in _subsequence(a[half:], b[cut:], cells))]
    rows = list(_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            out.append(i)
            j -= 1
    return out[::-1]


def _rows(a, b):
    """After each item of a, bit j is 0 where the common subsequence grows with item j of b."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        up = row & masks.get(x, 0)
        row = ((row + up) | (row - up)) & full
        yield row


def _row_lengths(a, b) -> np.ndarray:
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.xxhash64("page_id", "url", "html").alias("page"), F.col("page_id").cast("long"), "url", "html",
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
    )


def nearest_pages(keyed: DataFrame) -> DataFrame:
    """page and near: the neighbour in the host's path order that shares the longer path prefix."""
    places = keyed.filter("host <> ''").select("host", "path", "page").distinct()
    places = materialize(places.repartitionByRange("host", "path", "page").withColumn("part", F.spark_partition_id()), "page-order")
    here = Window.partitionBy("host", "part").orderBy("path", "page")
    me = F.struct("path", "page")
    ordered = places.select("*", F.lag(me).over(here).alias("before"), F.lead(me).over(here).alias("after"))
    ends = places.groupBy("host", "part").agg(F.min(me).alias("first"), F.max(me).alias("last"))
    parts = Window.partitionBy("host").orderBy("part")  # one row for each partition the host reaches into
    ends = ends.select("host", "part", F.lag("last").over(parts).alias("last"), F.lead("first").over(parts).alias("first"))
    ordered = ordered.join(ends, ["host", "part"]).select(
        "page", "path", F.coalesce("before", "last").alias("before"), F.coalesce("after", "first").alias("after")
    )
    flat = ordered.select(
        "page", "path", F.col("before.path").alias("path_b"), F.col("before.page").alias("page_b"),
        F.col("after.path").alias("path_a"), F.col("after.page").alias("page_a"),
    )

    def run(batches):
        schema = arrow_schema("page long, near long")
        for batch in batches:
            near = []
            for path, pb, b, pa_, a in zip(*(batch.column(c).to_pylist() for c in ("path", "path_b", "page_b", "path_a", "page_a"))):
                if b is None or a is None:
                    near.append(a if b is None else b)
                else:
                    near.append(b if len(commonprefix((path, pb))) >= len(commonprefix((path, pa_))) else a)
            yield as_batch({"page": batch.column("page"), "near": near}, schema)

    return flat.mapInArrow(task(run, 1000), "page long, near long").filter("near IS NOT NULL")


def line_hashes(keyed: DataFrame) -> DataFrame:
    """page, host (a hash), and of each line its hash and whether it stands in the article."""
    columns = "page long, host long, hashes array<long>, inside array<boolean>"

    def run(batches):
        from xxhash import xxh64_intdigest

        schema = arrow_schema(columns)
        for batch in batches:
            lines = [page_lines(h) for h in batch.column("html").to_pylist()]
            hashes = [[xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t, _ in p] for p in lines]
            inside = [[w == IN_ARTICLE for _, w in p] for p in lines]
            yield as_batch({"page": batch.column("page"), "host": batch.column("host"), "hashes": hashes, "inside": inside}, schema)

    return keyed.select("page", F.xxhash64("host").alias("host"), "html").mapInArrow(task(run, 1000), columns)


def template_lines(keyed: DataFrame) -> DataFrame:
    """page, shared (for each line, whether the nearest page has it too) and common (places of those that are the host's)."""
    hashes = materialize(line_hashes(keyed).dropDuplicates(["page"]), "page-lines")
    pairs = (
        nearest_pages(keyed).join(hashes, "page")
        .join(hashes.select(F.col("page").alias("near"), F.col("hashes").alias("other")), "near")
        .select("page", "host", "inside", "hashes", "other")
    )
    columns = "page long, host long, shared array<boolean>, places array<int>, lines array<long>"

    def run(batches):
        schema = arrow_schema(columns)
        for batch in batches:
            shared, places, lines = [], [], []
            for a, b, inside in zip(*(batch.column(c).to_pylist() for c in ("hashes", "other", "inside"))):
                flags = np.zeros(len(a), bool)
                flags[shared_lines(a, b)] = True
                shared.append(flags)
                places.append(np.flatnonzero(flags & np.array(inside, bool)))
                lines.append([a[i] for i in places[-1]])
            yield as_batch({"page": batch.column("page"), "host": batch.column("host"), "shared": shared, "places": places, "lines": lines}, schema)

    found = pairs.mapInArrow(task(run, 1000), columns).filter(F.array_contains("shared", True))
    found = materialize(found, "page-shared")
    # a line that an article shares with the nearest page is the host's if many of its pages have it
    asked = found.select("page", "host", F.inline(F.arrays_zip("places", "lines"))).withColumnRenamed("lines", "line")
    each = hashes.select("host", F.explode(F.array_distinct("hashes")).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = hashes.groupBy("host").agg(F.count("*").alias("pages"))
    enough = F.greatest(F.least(F.lit(TEMPLATE_PAGES), F.col("pages")), TEMPLATE_SHARE * F.col("pages"))
    often = counts.join(sizes, "host").filter(F.col("n") >= enough).select("host", "line")
    common = asked.join(often, ["host", "line"]).groupBy("page").agg(F.collect_set("places").alias("common"))
    return found.select("page", "shared").join(common, "page", "left")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    keyed = _keyed(pages)
    shared = materialize(template_lines(keyed), "page-templates")
    columns = "page long, page_id long, url string, lines array<string>, wheres array<int>, places array<int>"

    def read(batches):
        schema = arrow_schema(columns)
        for batch in batches:
            # furniture is not carried on: nothing can bring it back
            lines = [[(t, w, i) for i, (t, w) in enumerate(page_lines(h)) if w != IN_FURNITURE] for h in batch.column("html").to_pylist()]
            out = {k: batch.column(k) for k in ("page", "page_id", "url")}
            out |= {k: [[x[j] for x in p] for p in lines] for j, k in enumerate(("lines", "wheres", "places"))}
            yield as_batch(out, schema)

    lines = keyed.select("page", "page_id", "url", "html").mapInArrow(task(read, 1000), columns)
    rows = F.arrays_zip("lines", "wheres", "places")
    article = lambda x: x["wheres"] == IN_ARTICLE
    hosts = lambda x: F.coalesce(F.array_contains("common", x["places"]), F.lit(False))
    template = lambda x: F.coalesce(F.get("shared", x["places"]), F.lit(False)) & (~article(x) | hosts(x))
    chars = lambda of: F.aggregate(
        rows, F.lit(0).cast("long"), lambda n, x: n + F.when(of(x), F.length(x["lines"])).otherwise(0)
    )
    # differencing decides; an article that the nearest page holds a copy of comes back
    copied = chars(lambda x: article(x) & template(x)) >= COPIED * chars(article)
    chosen = F.filter(rows, lambda x: ~template(x) | (article(x) & F.col("copied")))
    text = F.array_join(F.transform(chosen, lambda x: x["lines"]), " ")
    return (
        lines.join(shared, "page", "left").withColumn("copied", copied).select("page_id", "url", text.alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
