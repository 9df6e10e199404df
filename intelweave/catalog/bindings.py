"""Threat-intelligence tables derived from the given tables.

Most bindings are one SQL text that Spark and the checking engine both run;
``ARRAY(`` and ``ROW(`` stand for the list and struct constructors, ``{name}``
for another binding or a given table.  Every binding covers whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import ioc
from ..session import scratch_path
from ..sources.runbase import RunBase

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

AS_OF = "2024-05-01T00:00:00"

# order lines that one task joins and merges
TASK_ROWS = 500_000



def _case(expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


_tactic_case = _case("p_size % 14", [f"'{t.lower()}'" for t in vocab.TACTICS])

SQL: dict[str, str] = {
    # an order with its customer's country, the actor
    "placed": """
        SELECT n_name AS actor, o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority, c_mktsegment
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    # one sighting per order line: which actor used which part, as told by which source
    "intel": """
        SELECT actor,
               CASE l_returnflag WHEN 'A' THEN 'mitre_attack' WHEN 'N' THEN 'malpedia' ELSE 'alienvault_otx' END AS source_id,
               CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS source_rank,
               ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos,
               l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_shipdate,
               p_name, p_brand, p_type, p_size
        FROM {lineitem} JOIN {placed} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "techniques": f"""
        SELECT actor, source_id, source_rank, pos,
               'T' || CAST(1000 + l_partkey % 400 AS STRING)
                 || CASE WHEN l_suppkey % 3 = 0 THEN '.00' || CAST(1 + l_partkey % 3 AS STRING) ELSE '' END AS technique_id,
               CASE WHEN l_linenumber = 1 THEN '' ELSE 'tech ' || CAST(l_partkey % 400 AS STRING) || ' v' || CAST(l_suppkey % 4 AS STRING) END AS name,
               CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE {_tactic_case} END AS tactic,
               CASE WHEN l_quantity < 25 THEN '' ELSE 'desc ' || CAST(l_suppkey AS STRING) END AS description,
               CASE WHEN l_discount < 0.05 THEN '' ELSE 'watch ' || CAST(l_partkey AS STRING) END AS detection,
               ARRAY('rec ' || CAST(l_suppkey % 5 AS STRING), 'rec ' || CAST(l_linenumber % 4 AS STRING)) AS detection_recs
        FROM {{intel}}""",
    "malware": """
        SELECT actor, source_id, source_rank, pos,
               CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name END AS name,
               CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE lower(p_type) END AS type,
               CASE WHEN l_quantity < 40 THEN '' ELSE 'about ' || p_name || ' from ' || p_brand || ' seen in lot ' || CAST(l_suppkey AS STRING) END AS description,
               CASE WHEN l_linenumber < 4 THEN ARRAY() ELSE ARRAY('alt ' || p_brand, p_brand) END AS aliases,
               CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE p_size END AS yara_count
        FROM {intel}""",
    # malware named like the families of the feed, most of them
    "family_malware": """
        SELECT actor, source_id, source_rank, pos, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_brand) ELSE p_brand || ' ' END AS name,
               CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE 'loader' END AS type, CASE WHEN l_quantity < 25 THEN '' ELSE 'seen with ' || p_brand END AS description
        FROM {intel} WHERE p_brand NOT LIKE '%3'""",
    # the brands an actor uses are its malware families
    "families_used": """
        SELECT actor, p_brand AS name, min(ROW(source_rank, pos)) AS pos FROM {intel} GROUP BY actor, p_brand""",
    "family_feed_raw": """
        SELECT p_brand AS family, ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos,
               CASE WHEN l_linenumber IN (1, 7) THEN '10.' || CAST(l_partkey % 200 AS STRING) || '.' || CAST(l_suppkey % 200 AS STRING) || '.7:' || CAST(1000 + l_linenumber AS STRING)
                    WHEN l_linenumber = 2 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'H' ELSE 'h' END || CAST(l_partkey AS STRING) || '.example.com'
                    WHEN l_linenumber = 3 THEN 'https://h' || CAST(l_partkey AS STRING) || '.example.org/a.b'
                    WHEN l_linenumber = 4 THEN md5(CAST(l_partkey AS STRING))
                    WHEN l_linenumber = 5 THEN '  '
                    ELSE 'x' || CAST(l_partkey AS STRING) END AS ioc,
               CASE l_linenumber WHEN 1 THEN 'ip:port' WHEN 7 THEN 'IP:PORT' WHEN 2 THEN 'domain' WHEN 3 THEN 'url'
                    WHEN 4 THEN 'md5_hash' WHEN 5 THEN 'sha256_hash' ELSE 'strange' END AS ioc_type,
               CASE l_returnflag WHEN 'A' THEN 'botnet_cc' WHEN 'N' THEN 'payload' ELSE 'odd_kind' END AS threat_type,
               CASE WHEN l_quantity < 10 THEN '100' WHEN l_quantity < 25 THEN '75' WHEN l_quantity < 40 THEN '50' ELSE NULL END AS confidence_level,
               CAST(CAST(l_shipdate AS DATE) AS STRING) || ' 00:00:00 UTC' AS first_seen,
               CASE WHEN l_linestatus = 'O' THEN CAST(CAST(l_shipdate AS DATE) AS STRING) ELSE NULL END AS last_seen,
               CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'win.' || lower(p_type) END AS malware,
               p_type AS malware_printable
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "campaigns": """
        SELECT actor,
               CASE o_orderstatus WHEN 'F' THEN 'mitre_attack' WHEN 'O' THEN 'cisa' ELSE 'vendor' END AS source_id,
               CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS source_rank,
               o_orderkey AS pos,
               CASE WHEN o_orderkey % 3 = 0 THEN 'OP ' ELSE 'Op ' END || CAST(o_custkey % 40 AS STRING) || CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE '' END AS name,
               CASE WHEN o_orderstatus = 'P' THEN '' ELSE lower(o_orderpriority) END AS description,
               CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'https://example.org/c/' || CAST(o_orderkey AS STRING) END AS url,
               CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'ref ' || CAST(o_custkey AS STRING) END AS reference,
               CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS first_seen,
               CASE WHEN o_orderkey % 11 < 5 THEN '' ELSE CAST(year(o_orderdate) + 1 AS STRING) END AS last_seen
        FROM {placed}""",
    "cves": """
        SELECT actor, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS source_rank, o_orderkey AS pos,
               CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'CVE-' || CAST(year(o_orderdate) AS STRING) || '-' || lpad(CAST(o_custkey % 300 AS STRING), 4, '0') END AS cve_id,
               lower(o_orderpriority) AS product, c_mktsegment AS vendor,
               CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_added
        FROM {placed}""",
    # one record per customer; its country is the actor, its segment the source
    "records": """
        SELECT n_name AS actor,
               CASE WHEN c_custkey % 40 = 0 THEN '' WHEN c_custkey % 41 = 0 THEN NULL ELSE ' ' || lower(n_name) || '   x' || CAST(c_custkey % 3 AS STRING) END AS actor_name,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'mitre_attack' WHEN 'MACHINERY' THEN 'cisa' WHEN 'HOUSEHOLD' THEN 'malpedia'
                    WHEN 'FURNITURE' THEN '' ELSE 'alienvault_otx' END AS source_id,
               CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 2 ELSE 3 END AS source_rank,
               c_custkey AS pos,
               ARRAY('Bear ' || CAST(c_custkey % 9 AS STRING), 'BEAR ' || CAST(c_custkey % 7 AS STRING), '', c_mktsegment || ' ') AS aliases,
               CASE WHEN c_custkey % 3 = 0 THEN 'https://example.org/' || CAST(c_custkey AS STRING) ELSE NULL END AS source_url,
               CASE c_custkey % 5 WHEN 0 THEN '2024-03-01T10:00:00Z' WHEN 1 THEN '03/04/2024' WHEN 2 THEN 'Mon, 05 Feb 2024 08:30:00 +0000' WHEN 3 THEN '' ELSE 'not a date' END AS retrieved_at,
               CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'origin ' || CAST(c_custkey % 6 AS STRING) END AS origin,
               ARRAY(CASE c_custkey % 5 WHEN 0 THEN ' Financial' WHEN 1 THEN 'espionage' WHEN 2 THEN 'greed' WHEN 3 THEN 'hacktivism' ELSE 'fame' END, 'Espionage') AS motivations,
               CASE c_custkey % 4 WHEN 0 THEN '2009' WHEN 1 THEN '' WHEN 2 THEN '2015-06-07' ELSE NULL END AS first_seen,
               CAST(NULL AS STRING) AS sponsorship,
               ARRAY(CASE c_custkey % 6 WHEN 0 THEN 'bank' WHEN 1 THEN ' Gov ' WHEN 2 THEN 'e-sports arena' WHEN 3 THEN 'oil' WHEN 4 THEN 'telco' ELSE 'financial' END,
                     CASE c_custkey % 3 WHEN 0 THEN 'insurance' ELSE 'mining' END) AS sectors,
               ARRAY('us', 'US ', 'de') AS countries,
               CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS source_citation,
               CASE WHEN c_acctbal < 0 THEN '' ELSE 'balance ' || CAST(c_custkey AS STRING) END AS description,
               CASE WHEN c_custkey % 10 = 3 THEN 'G' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') ELSE NULL END AS mitre_group_id
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "actors": """
        SELECT CAST(n_nationkey AS BIGINT) AS actor_pos, n_name AS canonical,
               ARRAY(' Team ' || CAST(n_nationkey AS STRING), lower(n_name), 'g' || lpad(CAST(n_nationkey AS STRING), 4, '0'),
                     'shared ' || CAST(n_nationkey % 20 AS STRING), '', lower(r_name) || ' group ' || CAST(n_nationkey AS STRING)) AS aliases,
               r_name AS origin, 'espionage' AS motivation
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    # names as they turn up in records, to be resolved
    "names": """
        SELECT c_custkey AS pos,
               CASE c_custkey % 6 WHEN 0 THEN n_name WHEN 1 THEN ' TEAM ' || CAST(c_nationkey AS STRING) || ' ' WHEN 2 THEN 'G' || lpad(CAST(c_nationkey AS STRING), 4, '0')
                    WHEN 3 THEN 'Shared ' || CAST(c_nationkey % 20 AS STRING) WHEN 4 THEN lower(n_name) ELSE ' ' || c_name END AS name
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "feeds": """
        SELECT CAST(substr(source, 4) AS BIGINT) AS feed_pos, source AS name, 'https://' || source || '.example' AS url,
               CASE WHEN CAST(substr(source, 4) AS INT) % 7 = 6 THEN NULL ELSE 1 + CAST(substr(source, 4) AS INT) % 3 END AS tier,
               CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END AS apt_focus,
               ARRAY('feed', 'n' || substr(source, 4)) AS tags,
               CASE CAST(substr(source, 4) AS INT) % 5 WHEN 4 THEN false WHEN 3 THEN NULL ELSE true END AS enabled
        FROM (SELECT DISTINCT source FROM {documents}) d""",
    # the first line of a document is its title
    "articles": """
        SELECT doc_id AS article_id, doc_id AS pos, source, split_part(text, chr(10), 1) AS title, text AS summary,
               CASE WHEN doc_id % 90 = 0 THEN '' ELSE 'https://' || source || '.example/' || CAST(doc_id % 701 AS STRING) END AS url,
               CASE doc_id % 13 WHEN 0 THEN '' WHEN 1 THEN 'soon' ELSE CAST(date '2024-05-01' - CAST(doc_id % 500 AS INT) AS STRING) END AS date
        FROM {documents}""",
    # search terms: the opening words of each benchmark passage
    "terms": """
        SELECT DISTINCT 'ITEM_' || CAST(item_id AS STRING) AS actor, lower(term) AS term FROM (
            SELECT item_id, split_part(text, ' ', 1) AS term FROM {benchmark}
            UNION ALL SELECT item_id, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) FROM {benchmark}
            UNION ALL SELECT item_id, split_part(text, ' ', 3) FROM {benchmark}
            UNION ALL SELECT item_id, text FROM {benchmark}) t
        WHERE term <> ''""",
    "snapshots": """
        SELECT CAST(user_id AS STRING) AS key, ts AS fetched_at, event_id, event_type, value, props AS payload FROM {events}""",
    "rules": """
        SELECT 'rules/' || p_brand || '/r' || CAST(p_partkey AS STRING) || '.yml' AS path,
               CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_name || ' on ' || lower(p_type) || ' ' || CAST(p_partkey % 9 AS STRING) END AS title,
               CASE p_type WHEN 'STANDARD' THEN 'critical' WHEN 'SMALL' THEN 'high' WHEN 'MEDIUM' THEN 'medium' WHEN 'LARGE' THEN 'low' WHEN 'PROMO' THEN 'informational' ELSE 'odd' END AS level,
               CASE WHEN p_size > 25 THEN 'stable' ELSE 'experimental' END AS status,
               't' || CAST(1000 + p_partkey % 150 AS STRING) || CASE WHEN p_partkey % 4 = 0 THEN '.00' || CAST(1 + p_partkey % 3 AS STRING) ELSE '' END AS tag_id,
               CASE WHEN p_size % 2 = 0 THEN 'process_creation' ELSE '' END AS category,
               CASE WHEN p_size % 3 = 0 THEN 'windows' ELSE '' END AS product,
               CASE WHEN p_size % 5 = 0 THEN 'all   of sel_* and not 1 of filter_' || p_name || '_that_is_long_enough_to_be_cut and more of ' || p_name ELSE 'sel and  not filter' END AS condition
        FROM {part}""",
    "rule_files": """
        SELECT path, 'title: ' || title || chr(10) || 'status: ' || upper(status) || chr(10) || 'description: about ' || path || chr(10)
               || 'tags:' || chr(10) || '    - attack.execution' || chr(10) || '    - attack.' || upper(tag_id) || chr(10)
               || 'logsource:' || chr(10)
               || CASE WHEN category <> '' THEN '    category: ' || category || chr(10) ELSE '' END
               || CASE WHEN product <> '' THEN '    product: ' || product || chr(10) ELSE '' END
               || '    definition: none' || chr(10)
               || 'detection:' || chr(10) || '    sel:' || chr(10) || '        Image: x' || chr(10)
               || '    condition: ' || condition || chr(10) || 'level: ' || level || chr(10) AS content
        FROM {rules}""",
    "repos": """
        SELECT p_partkey AS pos, 'repo ' || CAST(p_partkey AS STRING) AS name, 'https://example.org/r/' || CAST(p_partkey AS STRING) AS url,
               lower(p_brand) AS platform, 1 + p_size % 3 AS tier,
               CASE WHEN p_size % 7 = 0 THEN ARRAY('universal', lower(p_type)) ELSE ARRAY('siem', lower(p_type), replace(""" + _tactic_case + """, ' ', '-'), lower(p_type)) END AS tags
        FROM {part} WHERE p_retailprice >= 0""",
    # object graph: customers are groups, parts are techniques and software, orders are campaigns
    "groups": """
        SELECT 'intrusion-set--' || CAST(c_custkey AS STRING) AS id, 'intrusion-set' AS type,
               CASE WHEN c_custkey % 8 = 0 THEN 'Group ' || CAST(c_custkey % 64 AS STRING) ELSE c_name END AS name,
               CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE ARRAY('alias ' || CAST(c_custkey % 200 AS STRING), 'ALT ' || CAST(c_custkey AS STRING), c_name) END AS aliases,
               c_custkey % 13 = 0 AS revoked, c_custkey AS pos,
               'Seen in ' || CAST(1990 + c_custkey % 30 AS STRING) || ' near ' || CASE c_custkey % 6 WHEN 0 THEN 'Russia' WHEN 1 THEN 'the PRC' WHEN 2 THEN 'North Korea' ELSE '[home](https://e.org/x)' END || ' by [X](https://e.org) until 2021.' AS description,
               CASE WHEN c_custkey % 5 = 0 THEN ARRAY('a friend', 'CERT Iran') ELSE NULL END AS x_mitre_contributors,
               CASE WHEN c_custkey % 50 = 1 THEN 'G0032' WHEN c_custkey % 50 = 2 THEN 'bad' ELSE 'G' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') END AS gid,
               CASE WHEN c_custkey % 4 = 0 THEN '' ELSE lower(c_mktsegment) END AS primary_motivation,
               CASE WHEN c_custkey % 3 = 0 THEN ARRAY('fame', lower(c_mktsegment)) ELSE NULL END AS secondary_motivations
        FROM {customer}""",
    "arsenal": """
        SELECT CASE WHEN p_type IN ('STANDARD', 'MEDIUM') THEN 'attack-pattern' WHEN p_type IN ('SMALL', 'LARGE') THEN 'malware' WHEN p_type = 'ECONOMY' THEN 'tool' ELSE 'course-of-action' END AS type,
               'object--' || CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 77 = 0 THEN '' ELSE p_name || ' ' || CAST(p_partkey AS STRING) END AS name,
               p_size % 10 = 0 AS revoked, p_partkey AS pos,
               '[' || p_name || '](https://e.org/p) ' || p_brand || repeat(' does things', p_size) AS description,
               CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'T' || CAST(1000 + p_partkey % 900 AS STRING) END AS tid,
               CASE WHEN p_size % 4 = 0 THEN '' ELSE 'look at ' || p_brand END AS x_mitre_detection, 'old ' || p_brand AS detection,
               CASE WHEN p_size % 6 = 0 THEN '' ELSE replace(""" + _tactic_case + """, ' ', '-') END AS phase,
               CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE NULL END AS label
        FROM {part}""",
    "uses_edges": """
        SELECT 'intrusion-set--' || CAST(o_custkey AS STRING) AS source_ref, CASE WHEN l_linenumber = 7 THEN 'mentions' ELSE 'uses' END AS relationship_type,
               'object--' || CAST(l_partkey AS STRING) AS target_ref, ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pos
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "campaign_objects": """
        SELECT 'campaign--' || CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderstatus = 'P' THEN 'grouping' ELSE 'campaign' END AS type,
               'Campaign ' || CAST(o_orderkey AS STRING) AS name, o_orderkey % 9 = 0 AS revoked, o_orderkey AS pos,
               lower(o_orderpriority) || ' see [here](https://e.org/x)' AS description,
               CASE WHEN o_orderkey % 2 = 0 THEN 'mitre-attack' ELSE 'other' END AS ref_source, 'https://e.org/c/' || CAST(o_orderkey AS STRING) AS ref_url
        FROM {orders}""",
    "attributed_edges": """
        SELECT 'campaign--' || CAST(o_orderkey AS STRING) AS source_ref, 'attributed-to' AS relationship_type,
               'intrusion-set--' || CAST(o_custkey AS STRING) AS target_ref, o_orderkey AS pos
        FROM {orders}""",
    # community pulses: one per document
    "pulses": """
        SELECT lang AS actor, doc_id AS pulse_pos, 'p' || CAST(doc_id AS STRING) AS pulse_id, split_part(text, chr(10), 1) AS name,
               text || ' seen T' || CAST(1000 + doc_id % 300 AS STRING) || ' and T' || CAST(1000 + doc_id % 17 AS STRING) || '.001, not XT1234' AS description,
               CASE WHEN doc_id % 12 = 0 THEN 'unknown' ELSE CAST(2008 + doc_id % 15 AS STRING) || '-02-03T00:00:00' END AS created,
               CAST(n_chars % 1000 AS INT) AS subscriber_count,
               ARRAY(source, CASE doc_id % 6 WHEN 0 THEN 'Oil and Gas' WHEN 1 THEN 'government' WHEN 2 THEN 'banking' ELSE 'misc T' || CAST(1000 + doc_id % 40 AS STRING) END) AS tags,
               ' t' || CAST(1000 + doc_id % 50 AS STRING) || CASE WHEN doc_id % 3 = 0 THEN '.0' ELSE '' END AS attack_id, 'name ' || CAST(doc_id % 50 AS STRING) AS attack_name,
               CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN ' Fam ' || CAST(doc_id % 60 AS STRING) ELSE 'FAM ' || CAST(doc_id % 30 AS STRING) END AS family_name, 'fid ' || CAST(doc_id % 11 AS STRING) AS family_id
        FROM {documents}""",
    "advisories": """
        SELECT page_id AS pos, CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END AS source_rank, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS actor,
               regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
               CASE WHEN page_id % 9 = 0 THEN '' ELSE split_part(url, '?', 1) END AS url, html AS body,
               CASE page_id % 5 WHEN 0 THEN 'energy bank' WHEN 1 THEN 'Critical Infrastructure' WHEN 2 THEN 'water, Oil' ELSE '' END AS tags,
               'uses T' || CAST(1000 + page_id % 30 AS STRING) || ' then T' || CAST(1000 + page_id % 7 AS STRING) || '.002 and T' || CAST(1000 + page_id % 30 AS STRING) AS summary,
               CAST(date '2024-01-01' + CAST(page_id % 300 AS INT) AS STRING) AS date
        FROM {pages}""",
}

# Indicators named in texts.  The checking engine has no look-around; its word
# boundary is ASCII, which is what the look-arounds of the library spell out.
_RE2 = (
    r"\b((?:" + ioc.URL + r")|(?:(?:" + ioc.EMAIL + r")|(?:" + ioc.IPV4 + r")|(?:" + ioc.HEX + r"))\b)"
).replace("'", "''")

_TOKEN_TYPE = (
    "CASE WHEN regexp_matches(value, '^https?://') THEN 'url' WHEN contains(value, '@') THEN 'email' "
    "WHEN contains(value, '.') THEN 'ip' WHEN length(value) = 32 THEN 'hash_md5' "
    "WHEN length(value) = 40 THEN 'hash_sha1' ELSE 'hash_sha256' END"
)

ORACLE_ONLY: dict[str, str] = {
    "indicators": f"""
        SELECT actor, source_id, source_rank, doc, item, {_TOKEN_TYPE} AS type, value, first_seen, last_seen FROM (
            SELECT lang AS actor, source AS source_id, CAST(substr(source, 4) AS INT) AS source_rank, doc_id AS doc,
                   unnest(found) AS value, generate_subscripts(found, 1) - 1 AS item,
                   CAST(date '2024-01-01' + CAST(doc_id % 150 AS INT) AS STRING) AS first_seen, CAST(NULL AS STRING) AS last_seen
            FROM (SELECT *, regexp_extract_all(text, '{_RE2}', 1) AS found FROM {{documents}}) d) t
        UNION ALL
        SELECT actor, source_id, source_rank, doc, item,
               CASE WHEN is_host THEN 'domain' ELSE {_TOKEN_TYPE} END AS type, value, first_seen, last_seen FROM (
            SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS actor, 'pages' AS source_id, 1000 AS source_rank, page_id AS doc,
                   unnest(found) AS value, generate_subscripts(found, 1) - 1 AS item, generate_subscripts(found, 1) = 1 AS is_host,
                   '' AS first_seen, CAST(date '2024-01-01' + CAST(page_id % 150 AS INT) AS STRING) AS last_seen
            FROM (SELECT *, list_concat([regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)', 1), url],
                         regexp_extract_all(html, '{_RE2}', 1)) AS found FROM {{pages}}) p) t""",
}



def _check_text(name: str) -> str:
    return ORACLE_ONLY[name] if name in ORACLE_ONLY else SQL[name]


def with_clause(names) -> str:
    """WITH clause over the named bindings and all they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in ordered:
            return
        for dep in re.findall(r"\{([a-z_]+)\}", _check_text(name)):
            visit(dep)
        ordered.append(name)

    for n in names:
        visit(n)
    if not ordered:
        return ""
    parts = []
    for n in ordered:
        text = re.sub(r"\{([a-z_]+)\}", r"\1", _check_text(n))
        parts.append(f"{n} AS ({text.replace('ARRAY(', 'list_value(').replace('ROW(', 'row(').strip()})")
    return "WITH " + ",\n".join(parts) + "\n"


class Tables:
    """The given tables and the bindings as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        # naive timestamps in the payloads are UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}
        self._base: RunBase | None = None

    @property
    def base(self) -> RunBase:
        """The written tables of this run; they go when the driver ends, as results are read later."""
        if self._base is None:
            self._base = RunBase(self.spark, scratch_path(self.spark, "base")).close_with_session()
        return self._base

    def write_once(self, **keys) -> Tables:
        """From now on read these bindings from the run's base, dealt out by the given key columns."""
        for name, by in keys.items():
            build = lambda name=name: getattr(self, name)
            self._made[name] = self.base.once(f"binding-{name}", build, by)
        return self

    def release(self, *names: str) -> None:
        """Remove written bindings once all that starts from them is written; asked for again, bindings are built anew."""
        self._made = {n: df for n, df in self._made.items() if n in BASE}
        self.base.drop(*[f"binding-{n}" for n in names])

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._build(name)
        return self._made[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "indicators":
            return self._indicators()
        text = SQL[name]
        deps = {d: getattr(self, d) for d in dict.fromkeys(re.findall(r"\{([a-z_]+)\}", text))}
        if name == "intel":
            deps["lineitem"] = self._dealt(deps["lineitem"], "l_orderkey")
        return self.spark.sql(text.replace("ARRAY(", "array(").replace("ROW(", "struct("), **deps)

    def _dealt(self, df: DataFrame, key: str) -> DataFrame:
        """A large table by the key it is joined on next, so that a task's rows stay few however large it is.

        Merges sort the rows of a task; the session's number of partitions does not grow with the input.
        """
        n = -(-df.count() // TASK_ROWS)
        usual = min(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return df.repartition(n, key) if n > usual else df

    def _indicators(self) -> DataFrame:
        c = F.col
        day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (c(n) % 150).cast("int")).cast("string")
        docs = self.documents.select(
            c("lang").alias("actor"), c("source").alias("source_id"),
            F.substring("source", 4, 9).cast("int").alias("source_rank"), c("doc_id").alias("doc"),
            day("doc_id").alias("first_seen"), F.lit(None).cast("string").alias("last_seen"),
            F.posexplode(ioc.indicators_in(c("text"))).alias("item", "i"),
        )
        host = F.struct(F.lit("domain").alias("type"), F.coalesce(ioc.url_host(c("url")), F.lit("")).alias("value"))
        link = F.struct(F.lit("url").alias("type"), c("url").alias("value"))
        pages = self.pages.select(
            F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("actor"), F.lit("pages").alias("source_id"),
            F.lit(1000).alias("source_rank"), c("page_id").alias("doc"),
            F.lit("").alias("first_seen"), day("page_id").alias("last_seen"),
            F.posexplode(F.concat(F.array(host, link), ioc.indicators_in(c("html")))).alias("item", "i"),
        )
        rows = docs.unionByName(pages)
        return rows.select(
            "actor", "source_id", "source_rank", F.struct("doc", "item").alias("pos"),
            c("i.type").alias("type"), c("i.value").alias("value"), "first_seen", "last_seen",
        )
