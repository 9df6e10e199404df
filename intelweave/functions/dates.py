"""Dates and timestamps.  "Now" is always the ``as_of`` argument."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, strip

# Free-form spellings accepted besides ISO 8601, month before day.
FREE_FORMS = [
    "M/d/yyyy", "M/d/yyyy HH:mm:ss", "yyyy/MM/dd",
    "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
    "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z",
]
WEEKDAY = r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s*"


def as_ts(as_of) -> Column:
    """A timestamp column from a datetime, an ISO string or a column."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, (datetime, date)):
        as_of = as_of.isoformat()
    return F.lit(as_of).cast("timestamp")


def parsed_ts(c: Column) -> Column:
    """Timestamp of an ISO or free-form text, naive means UTC; NULL if neither."""
    text = F.regexp_replace(strip(c), WEEKDAY, "")
    return F.coalesce(
        text.try_cast("timestamp"),
        *[F.try_to_timestamp(text, F.lit(fmt)) for fmt in FREE_FORMS],
    )


def parse_ts(c: Column, as_of) -> Column:
    """Like :func:`parsed_ts`, with ``as_of`` for blank or unreadable text."""
    return F.coalesce(parsed_ts(c), as_ts(as_of))


def parse_epoch(c: Column) -> Column:
    """Timestamp of a numeric epoch in seconds."""
    return F.timestamp_seconds(c)


def iso_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def parse_ts_lenient(c: Column, as_of) -> Column:
    """Text form: blank stays blank, a bare year stays as it is, the rest is ISO."""
    text = F.coalesce(strip(c), F.lit(""))
    return F.when((text == "") | text.rlike(r"^\d{4}$"), text).otherwise(iso_ts(parse_ts(text, as_of)))


def article_date(c: Column) -> Column:
    """``yyyy-MM-dd`` of an article date.

    Mail-style dates keep the day of their own zone; then ISO; then a date
    inside the text; else the first ten characters.
    """
    text = F.coalesce(strip(c), F.lit(""))
    mail = F.regexp_replace(text, WEEKDAY, "")
    mail_day = F.regexp_extract(mail, r"^(\d{1,2}\s+[A-Za-z]{3})[A-Za-z]*\s+\d{4}\s+\d{1,2}:\d{2}", 1)
    mail_year = F.regexp_extract(mail, r"^\d{1,2}\s+[A-Za-z]{3}[A-Za-z]*\s+(\d{4})\s+\d{1,2}:\d{2}", 1)
    day = F.concat_ws(" ", F.regexp_replace(mail_day, r"\s+", " "), mail_year)
    by_mail = F.date_format(F.try_to_timestamp(day, F.lit("d MMM yyyy")), "yyyy-MM-dd")
    embedded = F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.coalesce(by_mail, embedded, F.left(text, F.lit(10)))


def first_year(c: Column) -> Column:
    """Earliest year 1900-2099 named in a text, '' when none is."""
    years = F.regexp_extract_all(c, F.lit(r"(?<![0-9A-Za-z_])((?:19|20)\d{2})(?![0-9A-Za-z_])"), F.lit(1))
    return F.coalesce(F.array_min(years), F.lit(""))


def leading_year(c: Column) -> Column:
    """The four digits a text starts with, NULL otherwise."""
    return F.nullif(F.regexp_extract(c, r"^(\d{4})", 1), F.lit(""))


def seen_date(last_seen: Column, first_seen: Column) -> Column:
    """Day an indicator was last seen, else first seen; NULL if unreadable."""
    raw = F.coalesce(F.nullif(strip(last_seen), F.lit("")), F.nullif(strip(first_seen), F.lit("")))
    day = F.left(raw, F.lit(10))
    return F.when(day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), day.try_cast("date"))


def freshness(
    last_seen: Column, first_seen: Column, as_of, fresh_days=30, aging_days=90, unknown: str | None = None
) -> Column:
    """FRESH / AGING / STALE by age in days; ``unknown`` for unreadable dates.

    The blocklist leaves undated indicators out (``unknown=None``), the page
    counts them as STALE.
    """
    age = F.datediff(as_ts(as_of).cast("date"), seen_date(last_seen, first_seen))
    label = (
        F.when(age <= fresh_days, "FRESH").when(age <= aging_days, "AGING").when(age > aging_days, "STALE")
    )
    return F.coalesce(label, F.lit(unknown)) if unknown else label


def within_lookback(c: Column, as_of, days: int) -> Column:
    """True for articles inside the window; undated or unreadable ones stay."""
    ts = F.when(strip(c).rlike(r"^\d{4}-\d{2}-\d{2}"), strip(c).try_cast("timestamp"))
    cutoff = as_ts(as_of) - F.make_dt_interval(F.lit(days))
    return ts.isNull() | (ts >= cutoff)


def stix_timestamp(c: Column, as_of) -> Column:
    """Midnight UTC of a day or a year, otherwise ``as_of``."""
    now = F.date_format(as_ts(as_of), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    return (
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(c, F.lit("T00:00:00.000Z")))
        .when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01T00:00:00.000Z")))
        .otherwise(now)
    )


def campaign_period(first: Column, last: Column) -> Column:
    """``first – last`` with ``?`` for a missing end, '' when both miss."""
    q = lambda c: F.when(is_blank(c), F.lit("?")).otherwise(c)
    return F.when(is_blank(first) & is_blank(last), F.lit("")).otherwise(
        F.concat(q(first), F.lit(" – "), q(last))
    )
