"""End-to-end indicator list: extract, merge, label, defang, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import ioc
from .common import MERGED_INDICATORS, case_sql, defang_sql, joined, merged_indicators
from .registry import query

_rank = case_sql("type", {t: i for i, t in enumerate(vocab.EXPORT_TYPE_ORDER)}, "99")


@query(
    "actor_indicators",
    f""", {MERGED_INDICATORS}
    SELECT actor, type, value, {defang_sql('type', 'value')} AS defanged, array_to_string(sources, '|') AS sources,
           confidence, first_seen, {_rank} AS export_rank FROM merged_i""",
    uses=["indicators"],
)
def actor_indicators(t):
    rows = merged_indicators(t).filter(ioc.is_exportable(F.col("type")))
    return rows.select(
        "actor", "type", "value", ioc.defang(F.col("type"), F.col("value")).alias("defanged"),
        joined("sources").alias("sources"), "confidence", "first_seen",
        ioc.type_rank(F.col("type"), vocab.EXPORT_TYPE_ORDER).alias("export_rank"),
    )
