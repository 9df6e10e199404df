"""A corpus through five of the training-text operators, each stage written and read again.

Language id drops what it cannot place; fuzzy line deduplication removes
repeated lines, and documents left without any; SimHash keeps one document of
each group; decontamination drops documents that hold a benchmark item; packing
puts the rest into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intelweave.llm import langid, lines, packing, simhash, tiling
from intelweave.llm.common import materialize, table, unused

MIN_SCORE = 0.3  # of the predicted language; four labels that the network leaves open have 0.25 each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found: any text with a letter that the network does not leave open."""
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    lang, score = unused(docs, "lang_pred"), unused(docs, "lang_score")
    labelled = langid.with_language(docs, model, lang, score)
    return labelled.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: neither the network, nor MinHash components, tiling and packing can be written in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
