"""Actor names: alias table, resolution, search terms.

Joins against the alias table carry no hint: a curated table stays under the
broadcast threshold and Spark broadcasts it on measured size; a bigger one is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import file_slug, is_search_term
from ..functions.text import fold_key, strip
from .ordering import latest_by


def alias_rows(actors: DataFrame) -> DataFrame:
    """Flatten (actor_pos, canonical, aliases, origin, motivation).

    Aliases are lower-cased and trimmed, blanks dropped.  The lower-cased
    canonical name is added as an unlisted row that outranks listed ones.
    """
    base = ["actor_pos", "canonical", "origin", "motivation"]
    listed = (
        actors.select(*base, F.explode("aliases").alias("alias"))
        .withColumn("alias", fold_key(F.col("alias")))
        .filter("alias <> ''")
        .distinct()
        .withColumn("listed", F.lit(True))
    )
    own = actors.select(*base, F.lower("canonical").alias("alias"), F.lit(False).alias("listed"))
    return listed.unionByName(own)


def resolution_index(aliases: DataFrame) -> DataFrame:
    """alias -> canonical; the last definition wins, a canonical name over a list entry."""
    ranked = aliases.withColumn("_own", (~F.col("listed")).cast("int"))
    return latest_by(ranked, ["alias"], ["actor_pos", "_own"]).select("alias", "canonical")


def resolve_canonical(df: DataFrame, index: DataFrame, name: str, out: str = "canonical") -> DataFrame:
    """Canonical name of every row; an unknown name stays as it is, trimmed."""
    idx = index.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    joined = df.join(idx, fold_key(F.col(name)) == F.col("_alias"), "left")
    return joined.withColumn(out, F.coalesce("_canonical", strip(F.col(name)))).drop("_alias", "_canonical")


def alias_sets(aliases: DataFrame) -> DataFrame:
    """Listed aliases per canonical name as a sorted array (curated, hence small)."""
    return aliases.groupBy("canonical").agg(
        F.sort_array(F.collect_set(F.when(F.col("listed"), F.col("alias")))).alias("aliases")
    )


def aliases_for(df: DataFrame, aliases: DataFrame, index: DataFrame, name: str) -> DataFrame:
    """All aliases of a name; an unknown name is its own only alias."""
    resolved = resolve_canonical(df, index, name)
    return resolved.join(alias_sets(aliases), "canonical", "left").withColumn(
        "aliases", F.coalesce("aliases", F.array(F.lower(name)))
    )


def search_set(df: DataFrame, aliases: DataFrame, index: DataFrame, name: str) -> DataFrame:
    """Names to search for (aliases and the name) and those to report (without the canonical)."""
    out = aliases_for(df, aliases, index, name)
    everything = F.array_union("aliases", F.array(F.lower(name)))
    return out.withColumn("search_set", F.sort_array(everything)).withColumn(
        "reported", F.sort_array(F.array_except(everything, F.array(F.lower("canonical"))))
    )


def search_terms(names: DataFrame, rule: str = "article", strict_ids: bool = False) -> DataFrame:
    """(actor, term) rows from (actor, aliases): the name itself plus distinctive aliases."""
    own = names.select("actor", F.lower("actor").alias("term"))
    others = names.select("actor", F.explode("aliases").alias("term")).filter(
        is_search_term(F.col("term"), rule, strict_ids)
    )
    return own.unionByName(others.withColumn("term", fold_key(F.col("term")))).distinct()


def alias_stats(aliases: DataFrame) -> DataFrame:
    """Alias count and the first four aliases of each actor, ``+n more`` after them."""
    stats = aliases.groupBy("canonical").agg(
        F.count_if("listed").alias("alias_count"),
        F.sort_array(F.collect_set(F.when(F.col("listed"), F.col("alias")))).alias("_all"),
    )
    more = F.when(
        F.col("alias_count") > 4,
        F.concat(F.lit(" +"), (F.col("alias_count") - 4).cast("string"), F.lit(" more")),
    ).otherwise("")
    return stats.select(
        "canonical", "alias_count", F.concat(F.array_join(F.slice("_all", 1, 4), ", "), more).alias("sample")
    )


def list_actors(aliases: DataFrame) -> DataFrame:
    return alias_stats(aliases).orderBy("canonical")


def alias_conflicts(aliases: DataFrame) -> DataFrame:
    """Aliases claimed by more than one actor; empty on a sound table."""
    return (
        aliases.groupBy("alias")
        .agg(F.sort_array(F.collect_set("canonical")).alias("claimed_by"))
        .filter(F.size("claimed_by") > 1)
    )


def with_canonical_slug(df: DataFrame, index: DataFrame, name: str, out: str = "actor_slug") -> DataFrame:
    """File-name slug of the canonical name, whatever spelling the row carries."""
    return resolve_canonical(df, index, name, "_c").withColumn(out, file_slug(F.col("_c"))).drop("_c")


# User rows rank after the curated ones, so they win over them.
USER_POS = 1_000_000_000


def extend_actors(actors: DataFrame, extra: DataFrame) -> DataFrame:
    """Add user-defined actors; check the result with :func:`alias_conflicts`."""
    return actors.unionByName(extra.withColumn("actor_pos", F.col("actor_pos") + USER_POS))
