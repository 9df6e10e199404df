"""Source plug-ins: a reader and a mapper per source, checked against the common schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import union_records

REQUIRED = ("actor_name", "source_id")


@dataclass(frozen=True)
class Source:
    name: str
    rank: int
    read: Callable[[SparkSession], DataFrame]
    map: Callable[[DataFrame], DataFrame]
    enrich_only: bool = False


class Registry:
    """Known sources by name."""

    def __init__(self) -> None:
        self._sources: dict[str, Source] = {}

    def register(self, name: str, rank: int, reader, mapper=lambda df: df, enrich_only: bool = False) -> Source:
        if name in self._sources:
            raise ValueError(f"source {name!r} is already registered")
        source = Source(name, rank, reader, mapper, enrich_only)
        self._sources[name] = source
        return source

    def select(self, names) -> tuple[list[Source], list[Source]]:
        """(collect, enrich) sources in the requested order; an unknown name is an error."""
        unknown = [n for n in names if n not in self._sources]
        if unknown:
            raise ValueError(f"unknown sources: {', '.join(unknown)}")
        picked = [self._sources[n] for n in names]
        return [s for s in picked if not s.enrich_only], [s for s in picked if s.enrich_only]

    def records(self, spark: SparkSession, names) -> DataFrame:
        """Records of the requested collect sources; list position is the merge rank."""
        collect, _ = self.select(names)
        frames = []
        for rank, source in enumerate(collect):
            df = source.map(source.read(spark))
            missing = [c for c in REQUIRED if c not in df.columns]
            if missing:
                raise ValueError(f"source {source.name!r} lacks {', '.join(missing)}")
            frames.append(df.withColumn("source_rank", F.lit(rank)))
        if not frames:
            raise ValueError("no collect source requested")
        return union_records(*frames)
