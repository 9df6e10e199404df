"""Tunable thresholds and caps, passed explicitly to the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    """One immutable bundle of the numbers an operator may need.

    The request limits are those of one client of a feed; landed data has none,
    so they are ``None`` unless a caller wants that client's view.  The list
    lengths below them are report features (top-k lists) and never feed a stored
    table.  ``score_chars`` is the number of body characters an article is
    scored on; ``None`` scores the whole text.
    """

    # Advisory records appear under two ids in the wild; both count as official.
    high_provenance: tuple[str, ...] = ("mitre_attack", "cisa_advisories", "cisa")
    min_relevance: int = 15
    historical_relevance: int = 50
    lookback_days: int = 365
    snapshot_ttl_hours: int = 24
    synthesis_ttl_hours: int = 7 * 24
    fresh_days: int = 30
    aging_days: int = 90
    articles_per_feed: int | None = None
    iocs_per_type: int | None = None
    iocs_per_family: int | None = None
    pulses_per_actor: int | None = None
    families_per_actor: int | None = None
    reports_per_folder: int | None = None
    rules_per_technique: int = 10
    evidence_articles: int = 15
    repos_per_actor: int = 6
    playbook_rows: int = 50
    page_rows: int = 100
    score_chars: int | None = None

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


DEFAULTS = Settings()
