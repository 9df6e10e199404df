"""SQL fragments and small helpers shared by the bound queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bindings import AS_OF

NOW = AS_OF
HIGH = "('mitre_attack', 'cisa_advisories', 'cisa', 'src0', 'src1')"
HIGH_SOURCES = ("mitre_attack", "cisa_advisories", "cisa", "src0", "src1")


def joined(c, sep: str = "|"):
    return F.array_join(c, sep)


def confidence_sql(sources_list: str) -> str:
    return (
        f"CASE WHEN len({sources_list}) >= 2 THEN 'HIGH' WHEN {sources_list}[1] IN {HIGH} THEN 'MEDIUM' ELSE 'LOW' END"
    )


def title_sql(expr: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({expr}, '([\\p{{L}}]+|[^\\p{{L}}]+)'), "
        "lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def squash_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{WS}+', ' ', 'g'))"


def defang_sql(t: str, v: str) -> str:
    x = f"replace(replace({v}, 'https://', 'hxxps://'), 'http://', 'hxxp://')"
    return (
        f"CASE WHEN {t} NOT IN ('url', 'domain', 'ip') THEN {v} WHEN contains({x}, '://') THEN "
        f"split_part({x}, '://', 1) || '://' || replace(regexp_extract({x}, '://([^/]*)', 1), '.', '[.]') || "
        f"regexp_extract({x}, '://[^/]*(/.*)$', 1, 's') ELSE replace({x}, '.', '[.]') END"
    )


def case_sql(expr: str, table: dict, default: str = "NULL") -> str:
    quote = lambda v: v if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {default} END"


# merged techniques with sources and confidence
MERGED_TECHNIQUES = f"""
merged_t AS (
  SELECT f.*, s.sources, {confidence_sql('s.sources')} AS confidence FROM (
    SELECT actor, technique_id,
           first(name ORDER BY source_rank, pos) FILTER (WHERE name <> '') AS name,
           first(tactic ORDER BY source_rank, pos) FILTER (WHERE tactic <> '') AS tactic,
           first(description ORDER BY source_rank, pos) FILTER (WHERE description <> '') AS description,
           first(detection ORDER BY source_rank, pos) FILTER (WHERE detection <> '') AS detection,
           min(row(source_rank, pos)) AS first_at
    FROM techniques GROUP BY actor, technique_id) f
  JOIN (SELECT actor, technique_id, list(source_id ORDER BY source_rank) AS sources
        FROM (SELECT DISTINCT actor, technique_id, source_id, source_rank FROM techniques) d
        GROUP BY actor, technique_id) s USING (actor, technique_id))"""

# merged indicators (per actor) with sources and confidence
MERGED_INDICATORS = f"""
canon AS (SELECT * FROM indicators WHERE type IN ('domain','ip','hash_md5','hash_sha256','hash_sha1','url','email') AND trim(value) <> ''),
merged_i AS (
  SELECT f.*, s.sources, {confidence_sql('s.sources')} AS confidence FROM (
    SELECT actor, type, lower(value) AS vk, first(value ORDER BY source_rank, doc, item) AS value,
           first(first_seen ORDER BY source_rank, doc, item) AS first_seen,
           first(last_seen ORDER BY source_rank, doc, item) AS last_seen,
           min(row(source_rank, doc, item)) AS first_at
    FROM canon GROUP BY actor, type, lower(value)) f
  JOIN (SELECT actor, type, vk, list(source_id ORDER BY source_rank) AS sources
        FROM (SELECT DISTINCT actor, type, lower(value) AS vk, source_id, source_rank FROM canon) d
        GROUP BY actor, type, vk) s USING (actor, type, vk))"""

MERGED_MALWARE = """
merged_m AS (
  SELECT actor, lower(trim(name)) AS name_key, first(name ORDER BY source_rank, pos) AS name,
         first(description ORDER BY source_rank, pos) FILTER (WHERE description <> '') AS description,
         first(type ORDER BY source_rank, pos) FILTER (WHERE type <> '') AS type,
         first(aliases ORDER BY source_rank, pos) FILTER (WHERE len(aliases) > 0) AS aliases,
         first(yara_count ORDER BY source_rank, pos) FILTER (WHERE yara_count <> 0) AS yara_count,
         min(row(source_rank, pos)) AS first_at
  FROM malware WHERE trim(name) <> '' GROUP BY actor, lower(trim(name)))"""

MERGED_CAMPAIGNS = """
merged_c AS (
  SELECT actor, trim(name) AS name,
         first(description ORDER BY source_rank, pos) FILTER (WHERE description <> '') AS description,
         first(url ORDER BY source_rank, pos) FILTER (WHERE url <> '') AS url,
         first(first_seen ORDER BY source_rank, pos) FILTER (WHERE first_seen <> '') AS first_seen,
         first(last_seen ORDER BY source_rank, pos) FILTER (WHERE last_seen <> '') AS last_seen,
         min(row(source_rank, pos)) AS first_at
  FROM campaigns WHERE trim(name) <> '' GROUP BY actor, trim(name))"""


def merged_techniques(t) -> DataFrame:
    from ..operators.merge import merge_techniques

    return merge_techniques(t.techniques, settings=settings())


def merged_indicators(t, **changes) -> DataFrame:
    from ..operators.merge import merge_indicators
    from ..operators.normalize import map_indicators
    from ..functions.ioc import is_canonical

    rows = map_indicators(t.indicators).filter(is_canonical(F.col("type"), F.col("value")))
    return merge_indicators(rows, settings=settings(**changes))


def settings(**changes):
    """The settings the bound queries run under, with some of them changed."""
    from ..config import DEFAULTS

    return DEFAULTS.with_(**{"high_provenance": HIGH_SOURCES, **changes})


def merged_malware(t) -> DataFrame:
    from ..operators.merge import merge_malware

    return merge_malware(t.malware)


def merged_campaigns(t) -> DataFrame:
    from ..operators.merge import merge_campaigns

    return merge_campaigns(t.campaigns)
