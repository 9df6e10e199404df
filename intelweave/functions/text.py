"""Text clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a reader sees it (ASCII controls, NBSP, the Unicode spaces).
WS_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)


def strip(c: Column) -> Column:
    """Drop white space at both ends (``trim`` alone only drops the blank)."""
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def squash_ws(c: Column) -> Column:
    """Collapse runs of white space to one blank and trim."""
    return F.trim(F.regexp_replace(c, WS_CLASS + "+", " "))


def non_blank(c: Column) -> Column:
    """The stripped value, NULL where nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def fold_key(c: Column) -> Column:
    """Case-insensitive comparison key."""
    return F.lower(strip(c))


def title_case(c: Column) -> Column:
    """Upper-case the first letter after every non-letter, lower-case the rest.

    ``initcap`` only looks at blanks, so ``e-commerce`` would come out wrong.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))),
        "",
    )


def clean_list(values: Column) -> Column:
    """Strip the entries, drop blanks, keep the first casing of each; NULL gives []."""
    stripped = F.filter(
        F.transform(F.coalesce(values, F.array().cast("array<string>")), strip),
        lambda v: v != "",
    )
    keys = F.transform(stripped, F.lower)
    # an entry survives when it is the first one with its key
    return F.filter(
        stripped, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1
    )


def strip_md_links(c: Column) -> Column:
    """``[label](url)`` becomes ``label``; a bare leading ``(url)`` goes."""
    labels = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return strip(
        F.regexp_replace(labels, rf"^{WS_CLASS}*\(https?://[^)]+\){WS_CLASS}*", "")
    )


def truncate(c: Column, limit: int) -> Column:
    """Cut at ``limit`` characters, right-trim, mark the cut with an ellipsis."""
    return F.when(
        F.length(c) > limit, F.concat(rstrip(F.left(c, F.lit(limit))), F.lit("…"))
    ).otherwise(c)


def strip_html(c: Column) -> Column:
    """Replace tags by blanks; entities, script and style text stay."""
    return squash_ws(F.regexp_replace(c, "<[^>]+>", " "))


def slugify(c: Column, mode: str = "alnum", limit: int | None = None) -> Column:
    """File-name form of a name.

    ``alnum`` turns everything but letters and digits into ``_``, ``word`` also
    keeps ``_``, ``path`` only replaces blanks and slashes.
    """
    low = F.lower(c)
    if mode == "alnum":
        out = F.regexp_replace(low, "[^a-z0-9]", "_")
    elif mode == "word":
        out = F.regexp_replace(low, "[^a-z0-9_]", "_")
    elif mode == "path":
        out = F.translate(low, " /", "__")
    else:
        raise ValueError(f"unknown slug mode {mode!r}")
    return F.left(out, F.lit(limit)) if limit else out


def condition_summary(c: Column, limit: int = 80) -> Column:
    flat = squash_ws(c)
    return F.when(
        F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 3)), F.lit("..."))
    ).otherwise(flat)


def shorten(c: Column, width: int) -> Column:
    """Collapse white space and cut at a word end so that cut + ellipsis fit."""
    flat = squash_ws(c)
    # a cut may fall before a blank, or after a hyphen inside a compound word
    cut = F.regexp_extract(
        flat,
        rf"(?U)^(.{{0,{width - 1}}})(?:(?= )|(?<=\w[^\W\d]-)(?=\w+[^\W\d]))",
        1,
    )
    return F.when(F.length(flat) > width, F.concat(cut, F.lit("…"))).otherwise(flat)


def first_label(values: Column, default: str) -> Column:
    """First entry of a list, a default when there is none."""
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(default))


def join_non_empty(values: Column, sep: str) -> Column:
    return F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), sep)


def string_or_list(raw_json: Column) -> Column:
    """A JSON value that is either one string or a list of strings, as a list.

    Empty strings and any other JSON type give the empty list.
    """
    as_list = F.from_json(raw_json, "array<string>")
    as_text = F.get_json_object(F.concat(F.lit('{"v":'), raw_json, F.lit("}")), "$.v")
    first = F.left(F.ltrim(raw_json), F.lit(1))
    empty = F.array().cast("array<string>")
    return F.coalesce(
        F.filter(
            F.when(first == "[", as_list).when(first == '"', F.array(as_text)),
            lambda v: v.isNotNull() & (v != ""),
        ),
        empty,
    )


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """Value of a small fixed table; ``default`` (or NULL) where the key is absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    value = F.create_map(*pairs)[key]
    return value if default is None else F.coalesce(value, default)


def first_contained(text: Column, hints: dict, default: Column | None = None) -> Column:
    """Value of the first hint (in table order) that occurs in the text."""
    out = None
    for hint, value in hints.items():
        cond = F.contains(text, F.lit(hint))
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out if default is None else out.otherwise(default)


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping, left-to-right occurrences of a non-empty term."""
    return F.when(
        F.octet_length(term) > 0,
        # bytes, whose number a text knows; characters would be counted
        ((F.octet_length(text) - F.octet_length(F.replace(text, term, F.lit("")))) / F.octet_length(term)).cast("int"),
    ).otherwise(F.lit(0))
