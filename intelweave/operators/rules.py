"""Detection rules per technique and detection coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..config import DEFAULTS
from ..functions.text import lookup
from . import BY
from .ordering import top_n

TAG = r"^attack\.(t\d{4}(?:\.\d{3})?)$"


def covers_exactly(tags: Column, technique_id: Column) -> Column:
    """A rule covers a technique when it carries the very tag; parents do not count."""
    return F.array_contains(tags, F.concat(F.lit("attack."), F.lower(technique_id)))


def level_rank(level: Column) -> Column:
    return lookup(level, vocab.RULE_LEVEL_ORDER, F.lit(99))


def tagged_rules(rules: DataFrame) -> DataFrame:
    """One row per rule and technique tag, with the technique id."""
    rows = rules.withColumn("_tag", F.explode(F.array_distinct("tags")))
    tid = F.upper(F.regexp_extract("_tag", TAG, 1))
    return rows.withColumn("technique_id", tid).filter("technique_id <> ''").drop("_tag")


def top_rules(rules: DataFrame, n: int = DEFAULTS.rules_per_technique) -> DataFrame:
    """The n best rules of each technique: by level, then title, then path.

    ``technique_rules`` is the number of all rules of the technique.
    """
    tagged = tagged_rules(rules)
    best = top_n(
        tagged, n, ["technique_id"], [level_rank(F.col("level")), F.col("title"), F.col("path")], rank="rule_rank"
    )
    totals = tagged.groupBy("technique_id").agg(F.count("*").alias("technique_rules"))
    return best.join(totals, "technique_id")


def rules_for_techniques(
    techniques: DataFrame, rules: DataFrame, n: int = DEFAULTS.rules_per_technique, *, by=BY
) -> DataFrame:
    """Best rules of every technique of a group.

    Rules are cut to the best n per technique before the join, so a tag that
    very many rules carry cannot blow it up.
    """
    wanted = techniques.select(*by, "technique_id").distinct()
    return wanted.join(top_rules(rules, n), "technique_id")


def rule_counts(matched: DataFrame, *, by=BY) -> DataFrame:
    """All rules of each technique, listed or not."""
    return matched.groupBy(*by, "technique_id").agg(F.max("technique_rules").alias("rule_count"))


def rule_total(matched: DataFrame, *, by=BY) -> DataFrame:
    """Rules of a group; a rule counts once per technique it covers."""
    return rule_counts(matched, by=by).groupBy(*by).agg(F.sum("rule_count").alias("rule_count"))


def lead_rules(matched: DataFrame, *, by=BY) -> DataFrame:
    """First rule of a technique, with ``(+n more)`` for the others."""
    out = matched.groupBy(*by, "technique_id").agg(
        F.max("technique_rules").alias("rule_count"),
        F.min_by(F.struct("title", "level", "logsource", "url"), F.col("rule_rank")).alias("lead"),
    )
    more = F.when(
        F.col("rule_count") > 1, F.concat(F.lit(" (+"), (F.col("rule_count") - 1).cast("string"), F.lit(" more)"))
    ).otherwise("")
    return out.select(*by, "technique_id", "rule_count", "lead.*", F.concat("lead.title", more).alias("summary"))


# --- coverage --------------------------------------------------------------


def corpus_ids(corpus: DataFrame, field: str = "content", mode: str = "exact") -> DataFrame:
    """Technique ids a rule corpus covers.

    ``exact`` takes whole ids only.  ``mention`` takes every place where the
    lower-case id occurs in the text, so a sub-technique also covers its parent
    and any character may stand for the dot.
    """
    if mode == "exact":
        pattern = r"(?<![0-9A-Za-z_])(t\d{4}(?:\.\d{3})?)(?![0-9A-Za-z_])"
        found = F.regexp_extract_all(field, F.lit(pattern), F.lit(1))
        ids = F.transform(found, F.upper)
    elif mode == "mention":
        found = F.regexp_extract_all(field, F.lit(r"(?=(t\d{4}(?:.\d{3})?))"), F.lit(1))
        full = F.transform(
            F.filter(found, lambda t: F.length(t) > 5),
            lambda t: F.concat(F.upper(F.left(t, F.lit(5))), F.lit("."), F.right(t, F.lit(3))),
        )
        ids = F.concat(F.transform(found, lambda t: F.upper(F.left(t, F.lit(5)))), full)
    else:
        raise ValueError(f"unknown coverage mode {mode!r}")
    return corpus.select(F.explode(F.array_distinct(ids)).alias("technique_id")).distinct()


def covered(techniques: DataFrame, ids: DataFrame) -> DataFrame:
    return techniques.join(ids, "technique_id", "left_semi")


def gaps(techniques: DataFrame, ids: DataFrame) -> DataFrame:
    return techniques.join(ids, "technique_id", "left_anti")


def coverage(techniques: DataFrame, ids: DataFrame) -> DataFrame:
    """Every technique with a ``covered`` flag."""
    flag = ids.select("technique_id", F.lit(True).alias("covered"))
    return techniques.join(flag, "technique_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def coverage_pct(flagged: DataFrame, *, by=BY) -> DataFrame:
    """Covered, total and the percentage, halves rounded to even."""
    out = flagged.groupBy(*by).agg(
        F.count_if("covered").alias("covered"), F.count("*").alias("total")
    )
    return out.withColumn("pct", F.bround(100.0 * F.col("covered") / F.col("total")).cast("int"))


def gap_rank(confidence: Column) -> Column:
    return lookup(F.upper(confidence), vocab.CONFIDENCE_ORDER, F.lit(3))


def gap_order() -> list[Column]:
    return [gap_rank(F.col("confidence")), F.col("technique_id")]


