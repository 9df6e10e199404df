"""Report tables: dossier sections, playbook, page and coverage rows.

A report is a long table (group, section_no, section, key, fields...).  The
order inside a section is the order of ``key``; rows are not numbered, because
a running number over one actor would put the whole actor into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import dates, ioc, labels, text
from ..operators import BY
from ..operators import freshness as fresh
from ..operators.merge import confidence_summary
from ..operators.ordering import order_text, top_n

SECTIONS = [
    "overview", "techniques", "detection", "indicators", "families", "repositories", "sectors",
    "cves", "advisories", "malware", "articles", "campaigns",
]
PLAYBOOK_SECTIONS = ["confidence", "block", "checklist", "malware", "references"]


def _rank(n: Column, width: int = 6) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def section_rows(df: DataFrame, section: str, key: Column, fields: list[Column], names, *, by=BY) -> DataFrame:
    """Rows of one section; fields fill c1, c2, ... in order."""
    return df.select(
        *by, F.lit(names.index(section)).alias("section_no"), F.lit(section).alias("section"),
        key.cast("string").alias("key"),
        *[
            (F.coalesce(fields[i].cast("string"), F.lit("")) if i < len(fields) else F.lit("")).alias(f"c{i + 1}")
            for i in range(5)
        ],
    )


def merged_order(df: DataFrame, order=None) -> Column:
    """Sort key of rows that keep the order they were merged in."""
    names = order or (["first_at"] if "first_at" in df.columns else ["source_rank", "pos"])
    return F.concat_ws("\u0001", *[order_text(df, n) for n in names])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overview_rows(
    profile: DataFrame, motivations: DataFrame | None = None, aliases: DataFrame | None = None,
    sources: DataFrame | None = None, origins: DataFrame | None = None, *, by=BY,
) -> DataFrame:
    """Facts of the header, then one row per motivation, alias, cited source and origin of indicators, in order.

    profile: (group, mitre_group_id, origin, first_seen, description).  The lists
    are long tables (value, first_at); a group without any has one row that says so.
    origins: (group, source, indicators).
    """
    c = F.col
    unknown = lambda e, word: F.coalesce(text.non_blank(e), F.lit(word))
    have = lambda n: c(n) if n in profile.columns else F.lit("")
    fact = lambda k, n, v: F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), v.alias("v"))
    facts = F.array(
        fact("0", "Group ID", F.coalesce(have("mitre_group_id"), F.lit(""))), fact("1", "Origin", unknown(c("origin"), "Unknown")),
        fact("2", "First Seen", unknown(c("first_seen"), "Unknown")), fact("5", "Description", F.coalesce(have("description"), F.lit(""))),
    )
    rows = profile.select(*by, F.inline(facts)).filter((F.col("v") != "") | F.col("k").isin("1", "2"))
    for k, name, listed, word in (("3", "Motivations", motivations, "Unknown"), ("4", "Also Known As", aliases, "—"), ("6", "Sources", sources, "unknown")):
        some = profile.select(*by)
        if listed is None:
            rows = rows.unionByName(some.select(*by, F.lit(k).alias("k"), F.lit(name).alias("n"), F.lit(word).alias("v")))
            continue
        each = listed.select(*by, F.concat(F.lit(k), order_text(listed, "first_at")).alias("k"), F.lit(name).alias("n"), c("value").alias("v"))
        none = some.join(listed.select(*by).distinct(), list(by), "left_anti")
        rows = rows.unionByName(each.join(some, list(by), "leftsemi"))
        rows = rows.unionByName(none.select(*by, F.lit(k).alias("k"), F.lit(name).alias("n"), F.lit(word).alias("v")))
    out = section_rows(rows, "overview", c("k"), [c("n"), c("v")], SECTIONS, by=by)
    if origins is not None:
        counts = origins.select(*by, F.concat(F.lit("7"), "source").alias("k"), c("source"), c("indicators"))
        out = out.unionByName(section_rows(counts, "overview", c("k"), [F.lit("Indicators"), c("source"), c("indicators")], SECTIONS, by=by))
    return out


def technique_rows(techniques: DataFrame, *, by=BY) -> DataFrame:
    c = F.col
    fields = [c("technique_id"), c("tactic"), c("name"), F.upper(F.coalesce("confidence", F.lit("low")))]
    return section_rows(techniques, "techniques", c("technique_id"), fields, SECTIONS, by=by)


def detection_rows(techniques: DataFrame, matched: DataFrame, *, by=BY) -> DataFrame:
    """Rules per technique; the detection text only where there is no rule."""
    c = F.col
    key = F.concat_ws("\u0001", "technique_id", _rank(c("rule_rank"), 3))
    rules = section_rows(
        matched, "detection", key, [c("technique_id"), c("title"), F.upper("level"), c("logsource"), c("condition_summary")],
        SECTIONS, by=by,
    )
    bare = techniques.filter(F.coalesce("detection", F.lit("")) != "").join(
        matched.select(*by, "technique_id").distinct(), [*by, "technique_id"], "left_anti"
    )
    return rules.unionByName(
        section_rows(bare, "detection", c("technique_id"), [c("technique_id"), c("detection")], SECTIONS, by=by)
    )


def shown_indicators(indicators: DataFrame, *, by=BY) -> DataFrame:
    """Indicators with the fields that their rows show; ``first_at`` becomes a text to sort by."""
    c = F.col
    have = lambda n: c(n) if n in indicators.columns else F.lit("")
    label = F.coalesce(text.non_blank(have("threat_label")), text.non_blank(have("description")), F.lit(""))
    score = ioc.score_label(c("confidence_score")) if "confidence_score" in indicators.columns else have("confidence")
    return indicators.select(
        *by, "type", "value", merged_order(indicators).alias("first_at"), ioc.defang(c("type"), c("value")).alias("defanged"),
        score.alias("score_label"), label.alias("label"), have("malware_family").alias("malware_family"), have("first_seen").alias("first_seen"),
    )


def indicator_rows(indicators: DataFrame, *, by=BY) -> DataFrame:
    """Rows of indicators, or of what :func:`shown_indicators` made of them."""
    c = F.col
    shown = indicators if "defanged" in indicators.columns else shown_indicators(indicators, by=by)
    fields = [c("defanged"), c("score_label"), c("label"), c("malware_family"), c("first_seen")]
    key = F.concat_ws("\u0001", c("type"), c("first_at"), c("value"))
    return section_rows(shown, "indicators", key, fields, SECTIONS, by=by)


def family_rows(hits: DataFrame, n: int = 8, *, by=BY) -> DataFrame:
    rows = top_n(hits, n, by, [F.desc("hits"), F.asc("family_pos")], rank="_r")
    return section_rows(rows, "families", _rank(F.col("_r"), 3), [F.col("family"), F.col("hits")], SECTIONS, by=by)


def repo_rows(matched: DataFrame, *, by=BY) -> DataFrame:
    c = F.col
    tier = F.when(c("tier") == 1, "Official").otherwise("Community")
    fields = [c("name"), text.title_case(F.coalesce("platform", F.lit(""))), tier, c("url")]
    return section_rows(matched, "repositories", _rank(c("repo_rank"), 3), fields, SECTIONS, by=by)


def sector_rows(sectors: DataFrame, *, by=BY) -> DataFrame:
    return section_rows(sectors, "sectors", merged_order(sectors), [F.col("value")], SECTIONS, by=by)


def cve_rows(cves: DataFrame, *, by=BY) -> DataFrame:
    c = F.col
    return section_rows(
        cves, "cves", merged_order(cves), [c("cve_id"), c("product"), c("vendor"), c("date_added")], SECTIONS, by=by
    )


def advisory_rows(advisories: DataFrame, *, by=BY) -> DataFrame:
    c = F.col
    return section_rows(
        advisories, "advisories", merged_order(advisories), [c("date"), c("title"), c("url")], SECTIONS, by=by
    )


def malware_rows(malware: DataFrame, width: int = 120, *, by=BY, section="malware", names=None) -> DataFrame:
    c = F.col
    fields = [c("name"), c("type"), text.shorten(F.coalesce("description", F.lit("")), width)]
    return section_rows(malware, section, merged_order(malware), fields, names or SECTIONS, by=by)


def article_rows(articles: DataFrame, *, by=BY) -> DataFrame:
    c = F.col
    key = F.concat_ws("\u0001", _rank(F.lit(1000) - c("relevance"), 4), order_text(articles, "pos"))
    fields = [c("source"), c("date"), labels.relevance_label(c("relevance")), c("title"), c("url")]
    return section_rows(articles, "articles", key, fields, SECTIONS, by=by)


def campaign_rows(campaigns: DataFrame, *, by=BY) -> DataFrame:
    c = F.col
    link = c("url") if "url" in campaigns.columns else F.lit("")
    fields = [c("name"), dates.campaign_period(c("first_seen"), c("last_seen")), c("description"), link]
    return section_rows(campaigns, "campaigns", merged_order(campaigns), fields, SECTIONS, by=by)


def report_rows(parts: dict[str, DataFrame], *, by=BY) -> DataFrame:
    """All sections of the dossier that are given (see ``SECTIONS`` for the names)."""
    build = {
        "overview": lambda d: overview_rows(
            d, parts.get("motivations"), parts.get("aliases"), parts.get("sources"), parts.get("origins"), by=by
        ),
        "techniques": lambda d: technique_rows(d, by=by),
        "indicators": lambda d: indicator_rows(d, by=by),
        "families": lambda d: family_rows(d, by=by),
        "repositories": lambda d: repo_rows(d, by=by),
        "sectors": lambda d: sector_rows(d, by=by),
        "cves": lambda d: cve_rows(d, by=by),
        "advisories": lambda d: advisory_rows(d, by=by),
        "malware": lambda d: malware_rows(d, by=by),
        "articles": lambda d: article_rows(d, by=by),
        "campaigns": lambda d: campaign_rows(d, by=by),
    }
    rows = [build[name](parts[name]) for name in SECTIONS if name in parts and name in build]
    if "detection" in parts:
        rows.append(detection_rows(parts["techniques"], parts["detection"], by=by))
    return _union(rows)


# --- playbook ------------------------------------------------------------------


def checklist(techniques: DataFrame, lead: DataFrame, *, by=BY) -> DataFrame:
    """Techniques by tactic then id; a blank tactic sorts first and shows as Unknown."""
    rules = lead.select(*by, "technique_id", "rule_count", "summary", "level", "logsource", F.col("url").alias("rule_url"))
    rows = techniques.join(rules, [*by, "technique_id"], "left")
    raw = F.coalesce("tactic", F.lit(""))
    hint = F.coalesce(
        F.col("summary"), text.shorten(text.non_blank(F.col("detection")), 100), F.lit("")
    )
    return rows.select(
        *by, raw.alias("tactic_key"),
        F.when(raw == "", "Unknown").otherwise(raw).alias("tactic"),
        "technique_id", F.coalesce("name", F.lit("")).alias("name"), F.upper("confidence").alias("confidence"),
        labels.technique_url(F.col("technique_id")).alias("url"), hint.alias("hint"),
    )


def playbook_rows(
    techniques: DataFrame, lead: DataFrame, indicators: DataFrame, malware: DataFrame, ledger: DataFrame,
    campaigns: DataFrame, as_of, settings: Settings = DEFAULTS, *, by=BY,
) -> DataFrame:
    """Confidence counts, FRESH/AGING blocks, checklist, malware, references."""
    c = F.col
    row = lambda df, s, key, fields: section_rows(df, s, key, fields, PLAYBOOK_SECTIONS, by=by)
    counts = row(confidence_summary(techniques, by=by), "confidence", F.lit(""), [c("high"), c("medium"), c("low")])
    block = fresh.blocklist(indicators, as_of, settings, by=by)
    seen = F.coalesce(text.non_blank(c("last_seen")), text.non_blank(c("first_seen")), F.lit(""))
    family = c("malware_family") if "malware_family" in block.columns else F.lit("")
    age = F.when(c("bucket") == "FRESH", "0").otherwise("1")
    blocks = row(
        block, "block", F.concat_ws("|", age, _rank(c("row_no"), 4)),
        [c("bucket"), c("type"), ioc.defang(c("type"), c("value")), family, seen],
    )
    todo = checklist(techniques, lead, by=by)
    todo = row(
        todo, "checklist", F.concat_ws("|", "tactic_key", "technique_id"),
        [c("tactic"), c("technique_id"), c("name"), c("confidence"), c("hint")],
    )
    mal = malware_rows(malware, 100, by=by, section="malware", names=PLAYBOOK_SECTIONS)
    cite = F.coalesce(text.non_blank(c("source_citation")), c("source_id"))
    refs = row(
        ledger.filter((F.coalesce("source_url", F.lit("")) != "") | (F.coalesce(cite, F.lit("")) != "")),
        "references", F.concat_ws("|", F.lit("0"), cite, "source_url"), [cite, c("source_url")],
    )
    links = row(
        campaigns.filter(F.coalesce("url", F.lit("")) != ""),
        "references", F.concat_ws("|", F.lit("1"), "name"), [c("name"), c("url")],
    )
    return _union([counts, blocks, todo, mal, refs, links])


# --- page ----------------------------------------------------------------------


def freshness_rows(indicators: DataFrame, as_of, settings: Settings = DEFAULTS, *, by=BY) -> DataFrame:
    """FRESH, AGING and STALE rows of the page, defanged, capped per block."""
    c = F.col
    rows = fresh.page_rows(indicators, as_of, settings, by=by)
    seen = F.coalesce(text.non_blank(c("last_seen")), text.non_blank(c("first_seen")), F.lit(""))
    return rows.select(
        *by, "bucket", "row_no", "type", ioc.defang(c("type"), c("value")).alias("value"), seen.alias("seen")
    )


# --- coverage ---------------------------------------------------------------------


def coverage_report(flagged: DataFrame, *, by=BY) -> DataFrame:
    """Gap and covered rows with the percentage of their group; gaps sort HIGH first."""
    from ..operators.rules import coverage_pct, gap_rank

    pct = coverage_pct(flagged, by=by).select(*by, "pct", "total")
    rank = F.when(F.col("covered"), F.lit(9)).otherwise(gap_rank(F.col("confidence")))
    return flagged.join(pct, list(by)).select(
        *by, F.when(F.col("covered"), "covered").otherwise("gap").alias("status"),
        rank.alias("gap_rank"), "technique_id", "name", "tactic",
        F.upper(F.coalesce(F.nullif("confidence", F.lit("")), F.lit("LOW"))).alias("confidence"), "pct", "total",
    )


