"""Indicator expressions: types, extraction, defanging, patterns, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import lookup, strip, title_case

_W = "[A-Za-z0-9_]"
# One left-to-right pass over a text finds every indicator.  Word edges are
# spelled out for ASCII so that accented letters never count as word characters.
URL = r"https?://[^\t-\r \"'<>`]+"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"(?:\d{1,3}\.){3}\d{1,3}"
HEX = r"(?:[0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32})"
ANY_IOC = rf"(?<!{_W})((?:{URL})|(?:(?:{EMAIL})|(?:{IPV4})|(?:{HEX}))(?!{_W}))"


def canonical_type(raw: Column) -> Column:
    """Canonical spelling of an indicator type; unknown types pass through."""
    low = F.lower(strip(raw))
    return lookup(low, vocab.IOC_TYPE_ALIASES, low)


def is_canonical(ioc_type: Column, value: Column) -> Column:
    """A known type with a non-blank value."""
    return ioc_type.isin(vocab.INDICATOR_TYPES) & (F.coalesce(strip(value), F.lit("")) != "")


def is_exportable(ioc_type: Column) -> Column:
    return ioc_type.isin(vocab.EXPORT_TYPE_ORDER)


def pulse_type(raw: Column) -> Column:
    return lookup(raw, vocab.PULSE_IOC_TYPES)


def family_type(raw: Column) -> Column:
    return lookup(F.lower(raw), vocab.FAMILY_IOC_TYPES)


def strip_port(value: Column) -> Column:
    """Text before the first colon, NULL when that is blank."""
    return F.nullif(strip(F.substring_index(value, ":", 1)), F.lit(""))


def threat_label(threat_type: Column) -> Column:
    low = F.lower(F.coalesce(threat_type, F.lit("")))
    return lookup(low, vocab.THREAT_LABELS, title_case(F.replace(low, F.lit("_"), F.lit(" "))))


def threat_priority(threat_type: Column) -> Column:
    return lookup(F.lower(threat_type), vocab.THREAT_PRIORITY, F.lit(99))


def type_rank(ioc_type: Column, order, default: int = 99) -> Column:
    """Position of a type in an order given as a list or a type -> rank table."""
    table = order if isinstance(order, dict) else {t: i for i, t in enumerate(order)}
    return lookup(ioc_type, table, F.lit(default))


def url_host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)", 1), F.lit(""))


def indicators_in(text: Column) -> Column:
    """Every indicator named in a text, in order: array of (type, value)."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(ANY_IOC), F.lit(1)),
        lambda v: F.struct(token_type(v).alias("type"), v.alias("value")),
    )


def token_type(token: Column) -> Column:
    """Type of one extracted token."""
    return (
        F.when(token.rlike("^https?://"), "url")
        .when(F.contains(token, F.lit("@")), "email")
        .when(F.contains(token, F.lit(".")), "ip")
        .when(F.length(token) == 32, "hash_md5")
        .when(F.length(token) == 40, "hash_sha1")
        .otherwise("hash_sha256")
    )


def defang(ioc_type: Column, value: Column) -> Column:
    """Make URLs, domains and addresses unclickable.

    ``http`` becomes ``hxxp``; dots are bracketed in the host when there is a
    scheme, everywhere otherwise.
    """
    v = F.replace(
        F.replace(value, F.lit("https://"), F.lit("hxxps://")), F.lit("http://"), F.lit("hxxp://")
    )
    dots = lambda c: F.replace(c, F.lit("."), F.lit("[.]"))
    sep = F.instr(v, "://")
    scheme = F.left(v, sep + 2)
    rest = F.substr(v, sep + 3)
    host = F.substring_index(rest, "/", 1)
    path = F.substr(rest, F.length(host) + 1)
    return (
        F.when(~ioc_type.isin("url", "domain", "ip"), value)
        .when(sep > 0, F.concat(scheme, dots(host), path))
        .otherwise(dots(v))
    )


def stix_pattern(ioc_type: Column, value: Column) -> Column:
    """Match pattern of an indicator, NULL for types without one.

    Addresses with a colon are written as IPv6.
    """
    before = lookup(ioc_type, {t: p[0] for t, p in vocab.PATTERN_PARTS.items()})
    after = lookup(ioc_type, {t: p[1] for t, p in vocab.PATTERN_PARTS.items()})
    v6 = (ioc_type == "ip") & F.contains(value, F.lit(":"))
    before = F.when(v6, F.lit(vocab.IPV6_PATTERN_START)).otherwise(before)
    return F.concat(before, F.replace(value, F.lit("'"), F.lit("\\'")), after)


def stix_indicator_type(ioc_type: Column, label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    named = lambda w: F.contains(low, F.lit(w))
    return (
        F.when(named("c2") | named("botnet") | named("command"), "malicious-activity,compromised")
        .when(named("payload"), "malicious-activity")
        .when(ioc_type == "cve", "compromised")
        .when(ioc_type.isin(vocab.INDICATOR_TYPES), "malicious-activity")
        .otherwise("unknown")
    )


def score_label(score: Column) -> Column:
    """Display label of a 0-100 score."""
    return (
        F.when(score == 100, "HIGH").when(score >= 75, "MED").when(score != 0, "LOW").otherwise("")
    )
