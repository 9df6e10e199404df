"""Community pulses: details, indicators, roll-ups.

A pulse row has actor, pulse_pos, pulse_id, name, description, created,
subscriber_count, tags, attack_ids, malware_families and indicators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..config import DEFAULTS
from ..functions import dates, ioc, labels, text
from . import BY
from .ordering import distinct_values, keep_first, top_n


def cap_pulses(pulses: DataFrame, n: int | None = DEFAULTS.pulses_per_actor, *, by=BY) -> DataFrame:
    return top_n(pulses, n, by, ["pulse_pos", "pulse_id"])


def with_fallback(primary: DataFrame, fallback: DataFrame, *, by=BY) -> DataFrame:
    """Primary rows; fallback rows only for groups without any primary row."""
    answered = primary.select(*by).distinct()
    return primary.unionByName(fallback.join(answered, list(by), "left_anti"), allowMissingColumns=True)


def pulse_details(stubs: DataFrame, details: DataFrame, n: int | None = DEFAULTS.pulses_per_actor, *, by=BY) -> DataFrame:
    """Stubs of several searches, unique by id and capped, with their details.

    Stubs without details are dropped.
    """
    unique = keep_first(stubs.filter(F.coalesce("pulse_id", F.lit("")) != ""), [*by, "pulse_id"], ["search_pos", "pulse_pos"])
    kept = top_n(unique, n, by, ["search_pos", "pulse_pos"]).select(*by, "pulse_id", "search_pos", "pulse_pos")
    return kept.join(details, "pulse_id")


def pulse_indicator_rows(pulses: DataFrame, *, by=BY) -> DataFrame:
    rows = pulses.select(*by, "pulse_pos", F.posexplode("indicators").alias("ind_pos", "i"))
    return rows.select(
        *by, "pulse_pos", "ind_pos",
        ioc.pulse_type(F.col("i.type")).alias("type"),
        text.strip(F.col("i.indicator")).alias("value"),
    ).filter(F.col("type").isNotNull() & (F.coalesce("value", F.lit("")) != ""))


def pulse_iocs(pulses: DataFrame, n: int | None = DEFAULTS.iocs_per_type, *, by=BY) -> DataFrame:
    """First n indicators of each type; a value counts once, whatever its type."""
    order = ["pulse_pos", "ind_pos"]
    unique = keep_first(pulse_indicator_rows(pulses, by=by), [*by, "value"], order)
    return cap_per_type(unique, n, by=by, order=order)


def cap_per_type(indicators: DataFrame, n: int | None = DEFAULTS.iocs_per_type, *, by=BY, order=("pos",)) -> DataFrame:
    return top_n(indicators, n, [*by, "type"], list(order))


def pulse_techniques(pulses: DataFrame, *, by=BY) -> DataFrame:
    """Distinct technique ids: those in prose and tags first, then the declared ones.

    Declared ids carry their display name.
    """
    prose = F.concat_ws(
        " ", F.coalesce("description", F.lit("")), F.array_join("tags", " "),
        F.array_join(F.transform("attack_ids", lambda a: F.coalesce(a["external_id"], F.lit(""))), " "),
    )
    in_text = pulses.select(
        *by, F.lit(0).alias("phase"), "pulse_pos",
        F.posexplode(labels.technique_ids_in(prose)).alias("item_pos", "technique_id"),
    ).withColumn("technique_name", F.lit(""))
    declared = (
        pulses.select(*by, F.lit(1).alias("phase"), "pulse_pos", F.posexplode("attack_ids").alias("item_pos", "a"))
        .withColumn(
            "technique_id", labels.technique_id(F.coalesce(F.nullif("a.id", F.lit("")), F.col("a.external_id")))
        )
        .withColumn("technique_name", F.coalesce("a.display_name", F.lit("")))
        .filter("technique_id is not null")
        .drop("a")
    )
    return keep_first(
        in_text.unionByName(declared), [*by, "technique_id"], ["phase", "pulse_pos", "item_pos"]
    )


def pulse_sectors(pulses: DataFrame, *, by=BY) -> DataFrame:
    """Distinct sectors whose keyword occurs in a tag."""
    rows = pulses.select(*by, "pulse_pos", F.posexplode("tags").alias("tag_pos", "tag"))
    rows = rows.select(
        *by, "pulse_pos", "tag_pos",
        F.posexplode(labels.keywords_in(F.col("tag"), vocab.PULSE_SECTOR_KEYWORDS)).alias("kw_pos", "sector"),
    )
    return distinct_values(rows, F.col("sector"), by, ["pulse_pos", "tag_pos", "kw_pos"], name="sector")


def pulse_malware(pulses: DataFrame, *, by=BY) -> DataFrame:
    """Distinct malware names, first spelling kept."""
    rows = pulses.select(*by, "pulse_pos", F.posexplode("malware_families").alias("item_pos", "m"))
    name = text.strip(F.coalesce(F.nullif("m.display_name", F.lit("")), F.col("m.id")))
    return distinct_values(rows, name, by, ["pulse_pos", "item_pos"], name="name")


def pulse_stats(pulses: DataFrame, *, by=BY) -> DataFrame:
    """Number of pulses and the first year any of them was created."""
    return pulses.groupBy(*by).agg(
        F.count("*").alias("pulse_count"),
        F.coalesce(F.min(dates.leading_year(F.col("created"))), F.lit("")).alias("first_seen"),
    )


def best_description(pulses: DataFrame, limit: int | None = None, *, by=BY) -> DataFrame:
    """Description of the pulse with the most subscribers, the first one on a tie; ``limit`` cuts it for display."""
    rank = F.struct(F.negative(F.coalesce("subscriber_count", F.lit(0))), F.col("pulse_pos"))
    best = F.min_by(F.coalesce("description", F.lit("")), rank)
    return pulses.groupBy(*by).agg((text.truncate(best, limit) if limit else best).alias("description"))
