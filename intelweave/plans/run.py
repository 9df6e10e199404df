"""One run over landed tables: every section of the profiles, over tables written once.

A section is merged from landed tables and feeds several outputs: the report,
the nested profile, the matrix layer, the graph.  ``ProfileRun`` builds each
section on the first ask.  What more than one section or output reads goes
through the run's base (see ``RunBase``), so each landed table is read once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..operators import BY
from ..operators import families as fam
from ..operators import merge as m
from ..operators import profile as prof
from ..operators import repos as rep
from ..operators import rules as rul
from ..operators.ordering import order_text
from ..sources.runbase import RunBase
from . import layers, reports

#: facts of a profile's header that are merged from the records
SCALARS = ("actor_name", "mitre_group_id", "origin", "first_seen", "description")
#: list fields of the records
LISTS = ("aliases", "motivations", "sectors")
#: the sections of a nested profile, in order, after its header
PROFILE_SECTIONS = (
    "aliases", "motivations", "sectors", "techniques", "malware", "indicators", "cves", "advisories", "campaigns",
    "rules", "articles", "families", "sources_cited", "sources",
)


class ProfileRun:
    """Sections of the profiles of all groups.

    landed: name to a function that gives the landed table: records, techniques,
    malware, families (group, name, pos), family_feed (parsed), campaigns, cves,
    advisories, articles (group, scored), rules (parsed), repos.  A table that is
    not needed for what is asked is not read.
    """

    def __init__(self, landed: dict[str, Callable[[], DataFrame]], base: RunBase, settings: Settings = DEFAULTS, *, by=BY):
        self.landed, self.base, self.settings, self.by = landed, base, settings, by
        self._prepared: set[str] = set()

    def _merged(self, name: str, merge) -> DataFrame:
        """A merged table, written once; its groups are dealt out by the merge itself."""
        return self.base.once(name, lambda: merge(self.landed[name]()))

    # --- merged tables that several sections read ---

    @cached_property
    def records(self) -> DataFrame:
        return self.base.once("records", self.landed["records"])

    @cached_property
    def techniques(self) -> DataFrame:
        return self._merged("techniques", lambda df: m.merge_techniques(df, by=self.by, settings=self.settings))

    @cached_property
    def malware(self) -> DataFrame:
        return self._merged("malware", lambda df: m.merge_malware(df, by=self.by))

    @cached_property
    def families(self) -> DataFrame:
        return self.base.once("families", self.landed["families"])

    @cached_property
    def parsed_feed(self) -> DataFrame:
        return self.base.once("parsed_feed", self.landed["family_feed"])

    @cached_property
    def family_feed(self) -> DataFrame:
        """The feed's rows by family and value, with the class of each value."""
        # the parsed rows are written only where the hits of the families count them, too
        parsed = lambda: self.parsed_feed if "family_hits" in self._prepared else self.landed["family_feed"]()
        return self.base.once("family_feed", lambda: fam.value_classes(parsed(), self.settings.iocs_per_family))

    @cached_property
    def owners(self) -> DataFrame:
        """Which family of a group the values of a class belong to."""
        return self.base.once("owners", lambda: fam.class_owners(self.families, self.family_feed, by=self.by))

    @cached_property
    def lists(self) -> DataFrame:
        """(group, section, value, first_at): aliases, motivations, sectors and cited sources; first_at is a text to sort by."""

        def build():
            merged = m.merge_lists(self.records, LISTS, by=self.by)
            cited = self.records.filter(F.coalesce("source_id", F.lit("")) != "")
            cited = cited.select(*self.by, F.lit("sources_cited").alias("section"), F.col("source_id").alias("value")).distinct()
            merged = merged.select(*self.by, "section", "value", order_text(merged, "first_at").alias("first_at"))
            return merged.unionByName(cited.withColumn("first_at", F.col("value")))

        return self.base.once("lists", build)

    @cached_property
    def matched_rules(self) -> DataFrame:
        """The best rules of every technique id, then of every group that uses it."""
        # the best and the total are both taken from the parsed rules
        parsed = lambda: self.base.once("parsed_rules", self.landed["rules"])
        best = self.base.once("rules", lambda: rul.top_rules(parsed(), self.settings.rules_per_technique))
        wanted = self.techniques.select(*self.by, "technique_id")
        return self.base.once("matched_rules", lambda: wanted.join(best, "technique_id"))

    @cached_property
    def lead_rules(self) -> DataFrame:
        return rul.lead_rules(self.matched_rules, by=self.by)

    # --- sections ---

    def listed(self, section: str) -> DataFrame:
        return self.lists.filter(F.col("section") == section).drop("section")

    @cached_property
    def indicators(self) -> DataFrame:
        """Indicators of the families, with their merge order and source."""
        rows = fam.owned_iocs(self.owners, self.family_feed)
        return rows.withColumns({"first_at": F.struct("family_pos", "pos"), "sources": F.array(F.lit("family_feed"))})

    def indicators_as(self, shape: Callable[[DataFrame, tuple], DataFrame], name: str | None = None) -> DataFrame:
        """What ``shape(rows, by)`` makes of each group's indicators, made before the groups join.

        A group's values are of several classes, and a class of one family of the
        group, so no two rows of a group are of one type and value (ignoring case).
        ``shape`` picks among rows of one type and value, so it does the same by
        class and family as by group, over the feed instead of every group's copy of it.
        The place among a group's families, which only the groups know, is left out.
        With a name, what is made is written once for all that read it.  The feed is the
        side that is passed over, so a class with many values is never held in a task.
        """
        key = ("class_id", "family")
        feed = self.family_feed.withColumns({"first_at": F.col("pos"), "malware_family": F.col("family")})
        shaped = self.base.once(name, lambda: shape(feed, key)) if name else shape(feed, key)
        return shaped.join(self.owners.drop("family_pos"), list(key)).drop(*key)

    def placed_indicators(self, name: str, shape: Callable[[DataFrame, tuple], DataFrame], key: str) -> DataFrame:
        """What ``shape(rows, by)`` makes of each row of each group's indicators, made and written before the groups join.

        ``key`` is the text that ``shape`` sorts rows by, from their place in the feed (``first_at``) on.  The place of
        the family among those of its group goes before it, so the order is that of ``indicators``.  The feed is the
        side that is passed over, so a class with many values is never held in a task.
        """
        of = ["class_id", "family"]
        feed = self.family_feed.withColumns(
            {"first_at": F.col("pos"), "malware_family": F.col("family"), "sources": F.array(F.lit("family_feed"))}
        )
        owners = self.owners.select(*self.by, *of, order_text(self.owners, "family_pos").alias("_place"))
        shaped = self.base.once(name, lambda: shape(feed, of))
        return shaped.join(owners, of).withColumn(key, F.concat_ws("\u0001", "_place", key)).drop("_place", *of)

    def indicator_counts(self) -> DataFrame:
        """Indicators of each group, counted by class and family before groups join."""
        per = self.family_feed.groupBy("class_id", "family").agg(F.count("*").alias("n"))
        return self.owners.join(per, ["class_id", "family"]).groupBy(*self.by).agg(F.sum("n").alias("indicators"))

    @cached_property
    def family_hits(self) -> DataFrame:
        hits = lambda: fam.family_hits(self.families, self.parsed_feed, self.settings.iocs_per_family, by=self.by)
        return self.base.once("family_hits", hits)

    @cached_property
    def repositories(self) -> DataFrame:
        def build():
            sectors = self.listed("sectors").withColumnRenamed("value", "sector")
            tags = rep.profile_tags(sectors, self.techniques, self.malware, by=self.by)
            return rep.match_repos(tags, self.landed["repos"](), by=self.by)

        return self.base.once("repositories", build)

    @cached_property
    def campaigns(self) -> DataFrame:
        return m.merge_campaigns(self.landed["campaigns"](), by=self.by)

    @cached_property
    def cves(self) -> DataFrame:
        return m.merge_cves(self.landed["cves"](), by=self.by)

    @cached_property
    def advisories(self) -> DataFrame:
        return m.merge_advisories(self.landed["advisories"](), by=self.by)

    @cached_property
    def articles(self) -> DataFrame:
        return self.landed["articles"]()

    @cached_property
    def header(self) -> DataFrame:
        """One row per group of ``records``: its facts, and the totals of its rules, indicators and articles."""

        def build():
            head = m.merge_scalars(self.records, SCALARS, by=self.by).withColumn("suspected_origin", F.col("origin"))
            totals = {
                "rule_count": rul.rule_total(self.matched_rules, by=self.by),
                "family_ioc_count": self.indicator_counts().withColumnRenamed("indicators", "family_ioc_count"),
                "article_count": self.articles.groupBy(*self.by).agg(F.count("*").alias("article_count")),
            }
            for name, total in totals.items():
                head = head.join(total, list(self.by), "left").withColumn(name, F.coalesce(name, F.lit(0)))
            return head

        return self.base.once("header", build)

    # --- outputs ---

    def prepare(self, *names: str) -> None:
        """Write the tables of these names, and what they start from, at the same time where they can be."""
        self._prepared.update(names)
        self.base.together(*[lambda n=n: getattr(self, n) for n in names])

    def keep(self, *names: str) -> None:
        """Write sections that an export reads more than once, and read them from there."""
        ask = lambda n: lambda: self.__dict__.update({n: self.base.once(f"section-{n}", lambda: getattr(self, n))})
        self.base.together(*[ask(n) for n in names])

    def report(self) -> DataFrame:
        """All sections of the report as one long table."""
        self.prepare("techniques", "malware", "owners", "family_hits", "lists", "matched_rules", "header", "repositories")
        origins = self.header.filter("family_ioc_count > 0")
        origins = origins.select(*self.by, F.lit("family feed").alias("source"), F.col("family_ioc_count").alias("indicators"))
        return reports.report_rows(
            {
                "overview": self.header, "motivations": self.listed("motivations"), "aliases": self.listed("aliases"),
                "sources": self.listed("sources_cited"), "origins": origins,
                "techniques": self.techniques, "detection": self.matched_rules,
                "indicators": self.placed_indicators("shown_indicators", lambda rows, by: reports.shown_indicators(rows, by=by), "first_at"),
                "families": self.family_hits, "repositories": self.repositories,
                "sectors": self.listed("sectors"), "cves": self.cves, "advisories": self.advisories,
                "malware": self.malware, "articles": self.articles, "campaigns": self.campaigns,
            },
            by=self.by,
        )

    def layer(self) -> DataFrame:
        self.prepare("techniques", "matched_rules")
        return layers.matrix_layer(self.techniques, self.lead_rules, by=self.by)

    def profile(self) -> DataFrame:
        """Nested profiles: a header row, then one JSON item per row, in the order of (section_no, item_key)."""
        self.prepare("techniques", "malware", "owners", "family_hits", "lists", "matched_rules", "header")
        c = F.col
        one = lambda name: lambda df: order_text(df, name)
        joined = lambda *parts: lambda df: F.concat_ws("\u0001", *[order_text(df, p) for p in parts])
        sections: dict[str, tuple[DataFrame, list, Callable[[DataFrame], Column]]] = {
            "techniques": (
                self.techniques, ["technique_id", "name", "tactic", "description", "detection", "sources", "confidence"], one("first_at")
            ),
            "malware": (self.malware, ["name", "type", "description", "aliases", "yara_count", "sources"], one("first_at")),
            "cves": (self.cves, ["cve_id", "product", "vendor", "date_added"], joined("source_rank", "pos")),
            "advisories": (self.advisories, ["title", "url", "date", "summary"], joined("source_rank", "pos")),
            "campaigns": (self.campaigns, ["name", "description", "url", "reference", "first_seen", "last_seen", "sources"], one("first_at")),
            "rules": (
                self.matched_rules, ["technique_id", "title", "level", "status", "logsource", "condition_summary", "path", "url", "technique_rules"],
                joined("technique_id", "rule_rank"),
            ),
            "articles": (self.articles, ["title", "source", "date", "url", "relevance"], one("pos")),
            "families": (self.family_hits, ["family", "hits"], joined("family_pos", "family")),
            "sources": (
                self.records.filter(F.coalesce("source_id", F.lit("")) != ""),
                ["source_id", *[F.coalesce(c(x), F.lit("")).alias(x) for x in ("source_citation", "source_url", "retrieved_at")]],
                joined("source_rank", "pos"),
            ),
        }
        found = ["type", "value", "confidence_score", "threat_type", "threat_label", "malware_family", "first_seen", "last_seen", "description", "sources"]
        indicators = lambda rows, by: prof.section_items(rows, "indicators", found, joined("first_at", "type", "value")(rows), by=by)
        items = prof.section_items(self.lists, c("section"), ["value"], c("first_at"), by=self.by)
        items = items.unionByName(self.placed_indicators("indicator_items", indicators, "item_key"))
        for name, (df, fields, key) in sections.items():
            items = items.unionByName(prof.section_items(df, F.lit(name), fields, key(df), by=self.by))
        return prof.assemble_profiles(self.header, items, by=self.by, sections=PROFILE_SECTIONS)
