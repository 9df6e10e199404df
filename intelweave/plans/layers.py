"""Technique matrix layer rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import BY
from ..operators.ordering import keep_first


def matrix_layer(techniques: DataFrame, lead_rules: DataFrame, *, by=BY, order=("first_at",)) -> DataFrame:
    """One entry per (technique, tactic slug): colour, score, comment, flags."""
    c = F.col
    rules = lead_rules.select(*by, "technique_id", "rule_count", F.col("title").alias("lead_rule"))
    rows = techniques.withColumn("technique_id", F.upper(text.strip(c("technique_id")))).filter("technique_id <> ''")
    rows = rows.join(rules, [*by, "technique_id"], "left").withColumns(
        {
            "rule_count": F.coalesce("rule_count", F.lit(0)),
            "confidence": F.upper(F.coalesce(F.nullif("confidence", F.lit("")), F.lit("LOW"))),
            "tactic": F.coalesce(labels.tactic_slug(c("tactic")), F.lit("")),
        }
    )
    rows = keep_first(rows, [*by, "technique_id", "tactic"], list(order))
    parent = ~F.contains("technique_id", F.lit("."))
    return rows.select(
        *by, "technique_id", "tactic",
        labels.layer_colour(c("confidence")).alias("color"),
        labels.layer_score(c("confidence")).alias("score"),
        labels.layer_comment(c("confidence"), c("rule_count"), c("lead_rule"), c("detection")).alias("comment"),
        F.lit(True).alias("enabled"),
        F.when((c("rule_count") > 0) & parent, True).alias("show_subtechniques"),
    )


def layer_entries(layer: DataFrame, *, by=BY) -> DataFrame:
    """Layer rows as JSON entries; a blank tactic and an unset flag are left out."""
    entry = F.struct(
        F.col("technique_id").alias("techniqueID"), "color", "score", "comment", "enabled",
        F.nullif("tactic", F.lit("")).alias("tactic"), F.col("show_subtechniques").alias("showSubtechniques"),
    )
    return layer.select(*by, F.to_json(entry).alias("entry"))
