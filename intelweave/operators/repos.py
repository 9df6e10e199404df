"""Matching detection repositories to actors by shared tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.labels import tactic_slug
from . import BY
from .ordering import top_n

# Marks the repositories every actor may get on their tier alone.
_ANY = "\u0000any"


def profile_tags(sectors: DataFrame, techniques: DataFrame, malware: DataFrame, *, by=BY) -> DataFrame:
    """Distinct (group, tag) from sectors, tactics and malware types, plus ``universal``."""
    dashed = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("-"))
    parts = [
        sectors.select(*by, dashed("sector").alias("tag")),
        techniques.select(*by, tactic_slug(F.col("tactic")).alias("tag")),
        malware.select(*by, F.lower("type").alias("tag")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return _with_tag(rows, "universal", by).filter(F.coalesce("tag", F.lit("")) != "").distinct()


def _with_tag(rows: DataFrame, tag: str, by) -> DataFrame:
    """Give every group one more tag, in the same pass over the rows."""
    return rows.select(*by, F.explode(F.array("tag", F.lit(tag))).alias("tag"))


def tag_overlap(a, b):
    """Number of tags two arrays share."""
    return F.size(F.array_intersect(a, b))


def match_repos(tags: DataFrame, repos: DataFrame, k: int = DEFAULTS.repos_per_actor, *, by=BY) -> DataFrame:
    """The k best repositories: one point per shared tag, two more for tier 1.

    Repositories with the same tags and tier score alike, so the k earliest of
    each such class are all that can be listed, and groups with the same tags
    get the same list.  The match is therefore between distinct tag sets on
    both sides, whose number does not grow with groups or repositories.  A
    tier-1 repository scores without any shared tag, but only the first k of
    them can reach the top k that way; their sets carry a weightless tag that
    every set of tags has, which keeps the match an equi-join.
    """
    bonus = F.when(F.col("tier") == 1, 2).otherwise(0)
    dims = repos.select(
        "name", "url", "platform", "tier", "pos", F.sort_array(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))).alias("offer")
    )
    listed = top_n(dims, k, ["offer", "tier"], ["pos"])
    leaders = listed.filter("tier = 1").orderBy("pos").limit(k).select("offer").distinct()
    offers = listed.select("offer").distinct().select("offer", F.explode("offer").alias("tag"), F.lit(1).alias("w"))
    offers = offers.unionByName(leaders.select("offer", F.lit(_ANY).alias("tag"), F.lit(0).alias("w")))
    # a group's tags come from fixed vocabularies (sectors, tactics, types)
    wanted = tags.groupBy(*by).agg(F.sort_array(F.collect_set("tag")).alias("profile"))
    profiles = wanted.select("profile").distinct()
    shared = (
        profiles.select("profile", F.explode(F.array_append("profile", _ANY)).alias("tag"))
        .join(offers, "tag").groupBy("profile", "offer").agg(F.sum("w").alias("shared"))
    )
    scored = shared.join(listed, "offer").withColumn("score", (F.col("shared") + bonus).cast("int")).filter("score > 0")
    best = top_n(scored.drop("offer"), k, ["profile"], [F.desc("score"), F.asc("pos")], rank="repo_rank")
    return wanted.join(best, "profile").drop("profile")
