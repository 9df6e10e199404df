"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import dates, ioc, labels, text
from . import common as k
from .registry import query

c = F.col


def scalar(name: str, table: str, keys: str, columns, sql: dict):
    """Register column expressions over one table next to their SQL.

    ``columns`` is a function, so that nothing needs a session at import.
    """
    from .bindings import BASE

    cols = ", ".join([*keys.split(), *[f"{e} AS {n}" for n, e in sql.items()]])
    uses = [] if table in BASE else [table]

    @query(name, f"SELECT {cols} FROM {table}", uses=uses)
    def run(t):
        return getattr(t, table).select(*keys.split(), *[e.alias(n) for n, e in columns().items()])


scalar(
    "squash_ws", "documents", "doc_id",
    lambda: {"flat": F.md5(text.squash_ws(c("text")))}, {"flat": f"md5({k.squash_sql('text')})"},
)
scalar(
    "clean_list", "records", "actor pos",
    lambda: {"aliases": k.joined(text.clean_list(c("aliases")))},
    {"aliases": "array_to_string(list_transform(list_filter(list_filter(list_transform(aliases, lambda v: trim(v)), lambda v: v <> ''), "
                "lambda v, i: list_position(list_transform(list_filter(list_transform(aliases, lambda w: trim(w)), lambda w: w <> ''), lambda w: lower(w)), lower(v)) = i), lambda v: v), '|')"},
)
_parsed_sql = (
    "CASE pos % 5 WHEN 0 THEN '2024-03-01T10:00:00+00:00' WHEN 1 THEN '2024-03-04T00:00:00+00:00' "
    "WHEN 2 THEN '2024-02-05T08:30:00+00:00' ELSE '2024-05-01T00:00:00+00:00' END"
)
scalar(
    "parse_ts", "records", "actor pos",
    lambda: {"at": dates.iso_ts(dates.parse_ts(c("retrieved_at"), k.NOW))}, {"at": _parsed_sql},
)
scalar(
    "parse_ts_lenient", "records", "actor pos",
    lambda: {"seen": dates.parse_ts_lenient(c("first_seen"), k.NOW)},
    {"seen": "CASE pos % 4 WHEN 0 THEN '2009' WHEN 2 THEN '2015-06-07T00:00:00+00:00' ELSE '' END"},
)
scalar(
    "parse_epoch", "events", "event_id",
    lambda: {"at": dates.iso_ts(dates.parse_epoch(c("event_id") * 60))},
    {"at": "strftime(make_timestamp(event_id * 60 * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"},
)
scalar(
    "canonical_sector", "records", "actor pos",
    lambda: {"sectors": k.joined(labels.canonical_sectors(c("sectors")))},
    {"sectors": "array_to_string(list_filter([CASE pos % 6 WHEN 0 THEN 'Finance' WHEN 1 THEN 'Government' WHEN 2 THEN 'E-Sports Arena' WHEN 3 THEN 'Energy' WHEN 4 THEN 'Telecommunications' ELSE 'Finance' END, "
                "CASE WHEN pos % 3 = 0 THEN CASE WHEN pos % 6 = 0 THEN NULL ELSE 'Finance' END ELSE 'Mining' END], lambda s: s IS NOT NULL), '|')"},
)
scalar(
    "canonical_motivation", "records", "actor pos",
    lambda: {"motivations": k.joined(labels.canonical_motivations(c("motivations")))},
    {"motivations": "CASE pos % 5 WHEN 0 THEN 'financial|espionage' WHEN 1 THEN 'espionage' WHEN 2 THEN 'unknown|espionage' WHEN 3 THEN 'hacktivism|espionage' ELSE 'unknown|espionage' END"},
)
scalar(
    "technique_id", "part", "p_partkey",
    lambda: {"tid": labels.technique_id(F.concat(F.lit(" t"), (c("p_partkey") % 3000).cast("string"), F.when(c("p_size") % 2 == 0, ".00").otherwise(""), (c("p_size") % 10).cast("string")))},
    {"tid": "nullif(regexp_extract(upper(trim(' t' || CAST(p_partkey % 3000 AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN '.00' ELSE '' END || CAST(p_size % 10 AS VARCHAR))), '^T\\d{4}(\\.\\d{3})?$'), '')"},
)
_spell = lambda: F.when(c("p_size") % 4 == 0, F.lit("FileHash-MD5")).when(c("p_size") % 4 == 1, F.lit("Hostname")).when(c("p_size") % 4 == 2, F.lit(" URI ")).otherwise(c("p_type"))
scalar(
    "ioc_type_alias", "part", "p_partkey",
    lambda: {"type": ioc.canonical_type(_spell())},
    {"type": "CASE p_size % 4 WHEN 0 THEN 'hash_md5' WHEN 1 THEN 'domain' WHEN 2 THEN 'url' ELSE lower(p_type) END"},
)
_pulse_types = list(vocab.PULSE_IOC_TYPES)
scalar(
    "pulse_ioc_type", "part", "p_partkey",
    lambda: {"type": ioc.pulse_type(F.element_at(F.array(*[F.lit(x) for x in [*_pulse_types, "url"]]), (c("p_size") % 11 + 1).cast("int")))},
    {"type": k.case_sql("p_size % 11", {i: vocab.PULSE_IOC_TYPES[x] for i, x in enumerate(_pulse_types)})},
)
scalar(
    "family_ioc_type", "family_feed_raw", "family ioc ioc_type",
    lambda: {"type": ioc.family_type(c("ioc_type"))},
    {"type": k.case_sql("lower(ioc_type)", vocab.FAMILY_IOC_TYPES)},
)
scalar(
    "strip_port", "family_feed_raw", "family ioc ioc_type",
    lambda: {"host": ioc.strip_port(c("ioc"))}, {"host": "nullif(trim(split_part(ioc, ':', 1)), '')"},
)
scalar(
    "threat_label", "events", "event_id",
    lambda: {"label": ioc.threat_label(F.when(c("event_id") % 3 == 0, F.lit("botnet_cc")).when(c("event_id") % 3 == 1, F.concat(c("event_type"), F.lit("_x1y kind"))).otherwise(F.lit("CC")))},
    {"label": f"CASE event_id % 3 WHEN 0 THEN 'Botnet C2' WHEN 1 THEN {k.title_sql(chr(39)+chr(39)+' || event_type || '+chr(39)+' x1y kind'+chr(39))} ELSE 'Command & Control' END"},
)
scalar(
    "threat_priority", "events", "event_id",
    lambda: {"priority": ioc.threat_priority(F.when(c("event_id") % 3 == 0, F.lit("Botnet_CC")).when(c("event_id") % 3 == 1, F.lit("payload")).otherwise(c("event_type")))},
    {"priority": "CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 99 END"},
)
scalar(
    "defang", "pages", "page_id",
    lambda: {"url": ioc.defang(F.lit("url"), c("url")), "host": ioc.defang(F.lit("domain"), ioc.url_host(c("url"))), "other": ioc.defang(F.lit("email"), c("url"))},
    {"url": k.defang_sql("'url'", "url"), "host": "replace(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1), '.', '[.]')", "other": "url"},
)
scalar(
    "strip_md_links", "groups", "id",
    lambda: {"plain": text.strip_md_links(F.concat(F.lit(" (https://e.org/bare) "), c("description")))},
    {"plain": "trim(regexp_replace(description, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'))"},
)
scalar(
    "truncate", "documents", "doc_id",
    lambda: {"cut": text.truncate(c("text"), 400)},
    {"cut": f"CASE WHEN length(text) > 400 THEN regexp_replace(text[1:400], '{k.WS}+$', '') || '…' ELSE text END"},
)
scalar(
    "strip_html", "pages", "page_id",
    lambda: {"plain": F.md5(text.strip_html(c("html")))},
    {"plain": "md5(" + k.squash_sql("regexp_replace(html, '<[^>]+>', ' ', 'g')") + ")"},
)
_d = lambda: F.date_add(F.lit("2024-01-01").cast("date"), (c("doc_id") % 300).cast("int"))
scalar(
    "article_date", "documents", "doc_id",
    lambda: {"day": dates.article_date(
        F.when(c("doc_id") % 5 == 0, F.concat(F.lit("Mon, "), F.date_format(_d(), "d MMM yyyy"), F.lit(" 23:30:00 -0500")))
        .when(c("doc_id") % 5 == 1, F.concat(_d().cast("string"), F.lit("T23:00:00Z")))
        .when(c("doc_id") % 5 == 2, F.concat(F.lit("posted on "), _d().cast("string"), F.lit(" late")))
        .when(c("doc_id") % 5 == 3, F.lit("some day in spring")).otherwise(F.lit("")))},
    {"day": "CASE WHEN doc_id % 5 < 3 THEN CAST(date '2024-01-01' + CAST(doc_id % 300 AS INT) AS VARCHAR) WHEN doc_id % 5 = 3 THEN 'some day i' ELSE '' END"},
)
scalar(
    "extract_technique_ids", "advisories", "pos",
    lambda: {"ids": k.joined(labels.technique_ids_in(F.concat(c("summary"), F.lit(" "), c("body"))))},
    {"ids": "(SELECT array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|') FROM (SELECT regexp_extract_all(summary || ' ' || body, '\\b(T\\d{4}(?:\\.\\d{3})?)\\b', 1) AS l) q)"},
)
_kw = "list_filter([" + ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w, s in vocab.ADVISORY_SECTOR_KEYWORDS.items() if s == sector) + f" THEN '{sector}' END"
    for sector in sorted(set(vocab.ADVISORY_SECTOR_KEYWORDS.values()))
) + "], lambda s: s IS NOT NULL)"
scalar(
    "extract_sectors", "documents", "doc_id",
    lambda: {"sectors": k.joined(F.sort_array(labels.advisory_sectors(c("text"))))}, {"sectors": f"array_to_string({_kw}, '|')"},
)
scalar(
    "infer_origin", "groups", "id",
    lambda: {"origin": labels.infer_origin(c("x_mitre_contributors"), c("description"))},
    {"origin": "CASE WHEN pos % 5 = 0 THEN 'Iran' WHEN pos % 6 = 0 THEN 'Russia' WHEN pos % 6 = 1 THEN 'China' WHEN pos % 6 = 2 THEN 'North Korea' ELSE '' END"},
)
scalar(
    "first_year", "groups", "id",
    lambda: {"year": dates.first_year(c("description"))}, {"year": "CAST(1990 + pos % 30 AS VARCHAR)"},
)
scalar(
    "tactic_label", "techniques", "actor technique_id tactic",
    lambda: {"label": labels.tactic_label(F.concat(F.lit(" "), c("tactic"), F.when(c("pos.l_suppkey") % 2 == 0, " xtra-step").otherwise("")))},
    {"label": "CASE WHEN pos[4] % 2 = 0 THEN " + k.title_sql("trim(tactic || ' xtra-step')") + " ELSE " + k.case_sql("tactic", {t.lower(): t for t in vocab.TACTICS}, "''") + " END"},
)
scalar(
    "tactic_slug", "techniques", "actor technique_id tactic",
    lambda: {"slug": labels.tactic_slug(c("tactic"))}, {"slug": "replace(lower(tactic), ' ', '-')"},
)
scalar(
    "slugify", "customer", "c_custkey",
    lambda: {"alnum": text.slugify(c("c_name")), "cut": text.slugify(c("c_name"), "alnum", 10), "word": text.slugify(F.concat(c("c_mktsegment"), F.lit("_/ b")), "word", 80), "path": text.slugify(F.concat(c("c_name"), F.lit("/ x.y")), "path")},
    {"alnum": "regexp_replace(lower(c_name), '[^a-z0-9]', '_', 'g')", "cut": "regexp_replace(lower(c_name), '[^a-z0-9]', '_', 'g')[1:10]", "word": "lower(c_mktsegment) || '___b'", "path": "lower(c_name) || '__x.y'"},
)
scalar(
    "stix_pattern", "indicators", "actor type value",
    lambda: {"pattern": ioc.stix_pattern(c("type"), F.concat(c("value"), F.lit("'")))},
    {"pattern": "CASE type WHEN 'ip' THEN '[ipv4-addr:value = ''' WHEN 'domain' THEN '[domain-name:value = ''' WHEN 'url' THEN '[url:value = ''' WHEN 'email' THEN '[email-addr:value = ''' "
                "WHEN 'hash_md5' THEN '[file:hashes.''MD5'' = ''' WHEN 'hash_sha1' THEN '[file:hashes.''SHA-1'' = ''' WHEN 'hash_sha256' THEN '[file:hashes.''SHA-256'' = ''' END "
                "|| replace(value, '''', '\\''') || '\\'''']'"},
)
scalar(
    "stix_motivation", "customer", "c_custkey",
    lambda: {"m": labels.stix_motivation(F.when(c("c_custkey") % 3 == 0, "Financial crime").when(c("c_custkey") % 3 == 1, F.concat(F.lit("for DESTRUCTION of "), c("c_mktsegment"))).otherwise(c("c_mktsegment")))},
    {"m": "CASE c_custkey % 3 WHEN 0 THEN 'financial-gain' WHEN 1 THEN 'dominance' ELSE 'unknown' END"},
)
_mt = list(vocab.STIX_MALWARE_TYPES)
scalar(
    "stix_malware_type", "part", "p_partkey",
    lambda: {"m": labels.stix_malware_type(F.element_at(F.array(*[F.upper(F.lit(x)) for x in [*_mt, "odd"]]), (c("p_size") % 10 + 1).cast("int")))},
    {"m": k.case_sql("p_size % 10", {i: vocab.STIX_MALWARE_TYPES[x] for i, x in enumerate(_mt)}, "'malware'")},
)
scalar(
    "stix_indicator_type", "events", "event_id",
    lambda: {"kinds": ioc.stix_indicator_type(
        F.when(c("user_id") % 3 == 0, "ip").when(c("user_id") % 3 == 1, "cve").otherwise("mutex"),
        F.when(c("event_id") % 4 == 0, "Botnet C2").when(c("event_id") % 4 == 1, "Payload Delivery").when(c("event_id") % 4 == 2, F.lit(None)).otherwise(c("event_type")))},
    {"kinds": "CASE event_id % 4 WHEN 0 THEN 'malicious-activity,compromised' WHEN 1 THEN 'malicious-activity' ELSE CASE user_id % 3 WHEN 0 THEN 'malicious-activity' WHEN 1 THEN 'compromised' ELSE 'unknown' END END"},
)
scalar(
    "stix_timestamp", "campaigns", "actor pos",
    lambda: {"a": dates.stix_timestamp(c("first_seen"), k.NOW), "b": dates.stix_timestamp(c("last_seen"), k.NOW)},
    {"a": "CASE WHEN first_seen = '' THEN '2024-05-01T00:00:00.000Z' ELSE first_seen || 'T00:00:00.000Z' END",
     "b": "CASE WHEN last_seen = '' THEN '2024-05-01T00:00:00.000Z' ELSE last_seen || '-01-01T00:00:00.000Z' END"},
)
scalar(
    "family_class", "part", "p_partkey",
    lambda: {"kind": labels.family_class(F.array(c("p_name"), F.when(c("p_size") % 4 == 0, "Stealer").when(c("p_size") % 4 == 1, "utility").otherwise("x"), F.when(c("p_size") % 3 == 0, "RAT").otherwise("y")))},
    {"kind": "CASE WHEN p_size % 4 = 0 THEN 'infostealer' WHEN p_size % 3 = 0 THEN 'rat' WHEN p_size % 4 = 1 THEN 'tool' ELSE 'malware' END"},
)
scalar(
    "display_slug", "part", "p_partkey",
    lambda: {"name": labels.display_slug(F.concat(F.lit("win."), F.replace(c("p_name"), F.lit(" "), F.lit("_"))))}, {"name": k.title_sql("p_name")},
)
scalar(
    "country_name", "nation", "n_nationkey",
    lambda: {"country": labels.country_name(F.when(c("n_nationkey") % 3 == 0, "ru").when(c("n_nationkey") % 3 == 1, "VN").otherwise(c("n_name")))},
    {"country": "CASE n_nationkey % 3 WHEN 0 THEN 'Russia' WHEN 1 THEN 'Vietnam' ELSE n_name END"},
)
scalar(
    "relevance_label", "part", "p_partkey",
    lambda: {"label": labels.relevance_label(c("p_size") * 2)},
    {"label": "CASE WHEN p_size * 2 >= 70 THEN 'HIGH' WHEN p_size * 2 >= 40 THEN 'MEDIUM' ELSE 'LOW' END"},
)
scalar(
    "article_key", "articles", "article_id",
    lambda: {"key": labels.article_key(c("url"), c("title")), "per_actor": labels.article_key(c("url"), c("title"), c("source"))},
    {"key": "sha256(url || title)[1:16]", "per_actor": "sha256(url || title || source)[1:16]"},
)
scalar(
    "freshness", "lineitem", "l_orderkey l_linenumber l_partkey l_suppkey",
    lambda: {"strict": dates.freshness(F.when(c("l_linenumber") == 7, "").otherwise(c("l_shipdate").cast("date").cast("string")), F.when(c("l_suppkey") % 2 == 0, "1998-08-01 x").otherwise("soon"), "1998-09-02"),
     "page": dates.freshness(F.when(c("l_linenumber") == 7, "").otherwise(c("l_shipdate").cast("date").cast("string")), F.when(c("l_suppkey") % 2 == 0, "1998-08-01 x").otherwise("soon"), "1998-09-02", unknown="STALE")},
    (lambda day: {
        "strict": f"CASE WHEN date '1998-09-02' - {day} <= 30 THEN 'FRESH' WHEN date '1998-09-02' - {day} <= 90 THEN 'AGING' WHEN date '1998-09-02' - {day} > 90 THEN 'STALE' END",
        "page": f"CASE WHEN date '1998-09-02' - {day} <= 30 THEN 'FRESH' WHEN date '1998-09-02' - {day} <= 90 THEN 'AGING' ELSE 'STALE' END",
    })("CASE WHEN l_linenumber = 7 THEN CASE WHEN l_suppkey % 2 = 0 THEN date '1998-08-01' END ELSE CAST(l_shipdate AS DATE) END"),
)
scalar(
    "score_label", "events", "event_id",
    lambda: {"label": ioc.score_label(F.when(c("event_id") % 4 == 0, 100).when(c("event_id") % 4 == 1, 0).otherwise((c("event_id") % 100).cast("int")))},
    {"label": "CASE event_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN '' ELSE CASE WHEN event_id % 100 >= 75 THEN 'MED' WHEN event_id % 100 <> 0 THEN 'LOW' ELSE '' END END"},
)
scalar(
    "confidence_style", "part", "p_partkey",
    lambda: {"colour": labels.layer_colour(F.when(c("p_size") % 3 == 0, "high").when(c("p_size") % 3 == 1, "MEDIUM").otherwise("odd")), "score": labels.layer_score(F.when(c("p_size") % 3 == 0, "high").when(c("p_size") % 3 == 1, "MEDIUM").otherwise("odd")),
     "number": labels.confidence_number(F.when(c("p_size") % 3 == 0, "high").when(c("p_size") % 3 == 1, "LOW"))},
    {"colour": "CASE p_size % 3 WHEN 0 THEN '#ff6666' WHEN 1 THEN '#ffaa00' ELSE '#ffe680' END", "score": "CASE p_size % 3 WHEN 0 THEN 100 WHEN 1 THEN 60 ELSE 30 END", "number": "CASE p_size % 3 WHEN 0 THEN 85 WHEN 1 THEN 15 ELSE 50 END"},
)
scalar(
    "condition_summary", "documents", "doc_id",
    lambda: {"short": text.condition_summary(c("text"))},
    {"short": f"CASE WHEN length({k.squash_sql('text')}) > 80 THEN {k.squash_sql('text')}[1:77] || '...' ELSE {k.squash_sql('text')} END"},
)
scalar(
    "technique_url", "techniques", "actor technique_id tactic",
    lambda: {"url": labels.technique_url(c("technique_id"))}, {"url": "'https://attack.mitre.org/techniques/' || replace(technique_id, '.', '/') || '/'"},
)
scalar(
    "join_sources", "records", "actor pos",
    lambda: {"sources": text.join_non_empty(F.array(c("source_id"), F.lit(None).cast("string"), F.lit("x")), "|")},
    {"sources": "CASE WHEN source_id = '' THEN 'x' ELSE source_id || '|x' END"},
)
scalar(
    "shorten", "documents", "doc_id",
    lambda: {"short": text.shorten(F.replace(c("text"), F.lit("-"), F.lit(" ")), 120)},
    {"short": (lambda s: f"CASE WHEN length({s}) > 120 THEN regexp_replace(({s})[1:120], '(^| )[^ ]*$', '') || '…' ELSE {s} END")(k.squash_sql("replace(text, '-', ' ')"))},
)
scalar(
    "stable_id", "part", "p_partkey",
    lambda: {"id": labels.stable_id("malware", c("p_name"), c("p_partkey"))},
    {"id": (lambda h: f"'malware--' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32]")("sha256('malware' || chr(1) || p_name || chr(1) || CAST(p_partkey AS VARCHAR))")},
)
scalar(
    "campaign_period", "campaigns", "actor pos",
    lambda: {"period": dates.campaign_period(c("first_seen"), c("last_seen"))},
    {"period": "CASE WHEN first_seen = '' AND last_seen = '' THEN '' ELSE coalesce(nullif(first_seen, ''), '?') || ' – ' || coalesce(nullif(last_seen, ''), '?') END"},
)
scalar(
    "extract_tactics", "arsenal", "id",
    lambda: {"tactics": k.joined(labels.phase_tactics(F.array(c("phase"), F.lit("lateral-movement"), F.lit(None).cast("string"))))},
    {"tactics": "CASE WHEN phase = '' THEN 'Lateral Movement' ELSE " + k.title_sql("replace(phase, '-', ' ')") + " || '|Lateral Movement' END"},
)
_json = lambda: F.when(c("p_size") % 4 == 0, F.concat(F.lit('"'), c("p_name"), F.lit('"'))).when(c("p_size") % 4 == 1, F.concat(F.lit('["'), c("p_type"), F.lit('", "", "z"]'))).when(c("p_size") % 4 == 2, F.lit('{"a": 1}')).otherwise(F.lit('""'))
scalar(
    "string_or_list", "part", "p_partkey",
    lambda: {"items": k.joined(text.string_or_list(_json()))},
    {"items": "CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type || '|z' ELSE '' END"},
)
scalar(
    "json_props", "events", "event_id",
    lambda: {"k": F.get_json_object("props", "$.k").try_cast("bigint")}, {"k": "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"},
)
_named = lambda: F.when(c("c_custkey") % 3 == 0, F.element_at(F.array(*[F.lit(a) for a in ["APT34", "Volt Typhoon", "FIN8"]]), (c("c_custkey") % 2 + 1).cast("int"))).otherwise(F.concat(c("c_mktsegment"), F.lit(" the-Bear")))
scalar(
    "source_slug", "customer", "c_custkey",
    lambda: {"family": labels.source_slug(_named(), "family"), "pulse": labels.source_slug(_named(), "pulse")},
    {"family": "CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'apt34' ELSE 'volt_typhoon' END ELSE lower(c_mktsegment) || '_the_bear' END",
     "pulse": "CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'OilRig' ELSE 'Volt+Typhoon' END ELSE c_mktsegment || ' the-Bear' END"},
)


@query(
    "primary_and_secondary",
    """SELECT id, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|') AS motivations FROM (
         SELECT id, list_concat(CASE WHEN primary_motivation = '' THEN [] ELSE [primary_motivation] END, coalesce(secondary_motivations, [])) AS l FROM groups) x""",
    uses=["groups"],
)
def _(t):
    from ..operators.graph import primary_and_secondary

    return t.groups.select("id", k.joined(primary_and_secondary(c("primary_motivation"), c("secondary_motivations"))).alias("motivations"))


@query(
    "first_external_id",
    "SELECT id, CASE WHEN regexp_full_match(gid, 'G\\d{4}') THEN gid ELSE '' END AS mitre_id FROM groups",
    uses=["groups"],
)
def _(t):
    from ..operators.graph import external_id

    return t.groups.select("id", external_id(group_refs(), r"G\d{4}").alias("mitre_id"))


def group_refs():
    ref = lambda s, i: F.struct(F.lit(s).alias("source_name"), i.alias("external_id"), F.concat(F.lit("https://e.org/"), c("id")).alias("url"))
    return F.array(ref("blog", F.lit(None).cast("string")), ref("other", F.lit("T1001")), ref("mitre-attack", c("gid")))


@query(
    "extract_iocs",
    "SELECT source_id, type, value, count(*) AS n FROM indicators GROUP BY source_id, type, value",
    uses=["indicators"],
)
def _(t):
    return t.indicators.groupBy("source_id", "type", "value").agg(F.count("*").alias("n"))


@query(
    "search_terms",
    """SELECT DISTINCT canonical AS actor, term FROM (
         SELECT canonical, lower(canonical) AS term FROM actors
         UNION ALL SELECT canonical, lower(trim(a)) FROM (SELECT canonical, unnest(aliases) AS a FROM actors) x
           WHERE length(lower(trim(a))) > 4 AND NOT regexp_full_match(lower(trim(a)), '[gtu][a-z]?\\d+')) y""",
    uses=["actors"],
)
def _(t):
    from ..operators.aliases import search_terms

    return search_terms(t.actors.withColumnRenamed("canonical", "actor"))


@query(
    "canonical_slug",
    """, idx AS (SELECT alias, arg_max(canonical, actor_pos * 2 + own) AS canonical FROM (
         SELECT actor_pos, canonical, lower(trim(a)) AS alias, 0 AS own FROM (SELECT actor_pos, canonical, unnest(aliases) AS a FROM actors) x WHERE trim(a) <> ''
         UNION ALL SELECT actor_pos, canonical, lower(canonical), 1 FROM actors) y GROUP BY alias)
       SELECT n.pos, regexp_replace(lower(coalesce(i.canonical, trim(n.name))), '[^a-z0-9]', '_', 'g') AS actor_slug FROM names n LEFT JOIN idx i ON lower(trim(n.name)) = i.alias""",
    uses=["actors", "names"],
)
def _(t):
    from ..operators.aliases import alias_rows, resolution_index, with_canonical_slug

    return with_canonical_slug(t.names, resolution_index(alias_rows(t.actors)), "name").select("pos", "actor_slug")


@query(
    "layer_comment",
    f""", {k.MERGED_TECHNIQUES}
    SELECT actor, technique_id, 'Confidence: ' || confidence || CASE WHEN length(technique_id) = 5 THEN ' | Sigma: ' || (1 + length(coalesce(name, '')) % 2)::VARCHAR || CASE WHEN length(coalesce(name, '')) % 2 = 1 THEN ' rules' ELSE ' rule' END || coalesce(' — ' || nullif(name, ''), '')
       ELSE coalesce(' | Detection: ' || nullif(detection, ''), '') END AS comment FROM merged_t""",
    uses=["techniques"],
)
def _(t):
    n = F.when(F.length("technique_id") == 5, 1 + F.length(F.coalesce("name", F.lit(""))) % 2).otherwise(0)
    return k.merged_techniques(t).select(
        "actor", "technique_id", labels.layer_comment(c("confidence"), n, c("name"), c("detection")).alias("comment")
    )


@query(
    "relevance_score",
    """SELECT event_id, least(100, CASE WHEN user_id % 4 >= 2 THEN 55 WHEN user_id % 4 = 1 THEN 40 ELSE 0 END
         + CASE WHEN event_id % 7 >= 5 THEN 35 WHEN event_id % 7 >= 3 THEN 25 WHEN event_id % 7 >= 2 THEN 18 WHEN event_id % 7 >= 1 THEN 10 ELSE 0 END
         + CASE WHEN event_type = 'click' AND (user_id % 4 > 0 OR event_id % 7 > 0) THEN 10 ELSE 0 END) AS score FROM events""",
)
def _(t):
    from ..operators.articles import relevance_score

    return t.events.select("event_id", relevance_score(c("user_id") % 4, c("event_id") % 7, c("event_type") == "click").alias("score"))
