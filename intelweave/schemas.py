"""Explicit schemas of landed data.  Nothing is inferred."""

from __future__ import annotations

ACTORS = "actor_pos bigint, canonical string, aliases array<string>, origin string, motivation string"

FEEDS = (
    "feed_pos bigint, name string, url string, rss string, type string, tier int, "
    "apt_focus boolean, tags array<string>, enabled boolean"
)

REPOS = "pos bigint, name string, url string, platform string, tags array<string>, tier int"

GRAPH_OBJECT = (
    "id string, type string, name string, description string, aliases array<string>, revoked boolean, "
    "labels array<string>, external_references array<struct<source_name:string,external_id:string,url:string>>, "
    "kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>, "
    "x_mitre_detection string, detection string, x_mitre_contributors array<string>, "
    "primary_motivation string, secondary_motivations array<string>, first_seen string, last_seen string, "
    "relationship_type string, source_ref string, target_ref string"
)
GRAPH_BUNDLE = "objects array<struct<{}>>".format(
    ",".join(f.strip().replace(" ", ":", 1) for f in GRAPH_OBJECT.split(", "))
)

VULNERABILITIES = (
    "vulnerabilities array<struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,"
    "shortDescription:string,notes:string,dateAdded:string,dueDate:string>>"
)

PULSE = (
    "pulse_id string, name string, description string, created string, subscriber_count int, tags array<string>, "
    "attack_ids array<struct<id:string,external_id:string,display_name:string>>, "
    "malware_families array<struct<id:string,display_name:string>>, "
    "indicators array<struct<type:string,indicator:string,description:string,created:string>>"
)

FAMILY_FEED = (
    "query_status string, data array<struct<id:string,ioc:string,ioc_type:string,threat_type:string,malware:string,"
    "malware_printable:string,confidence_level:string,first_seen:string,last_seen:string,tags:array<string>>>"
)

FAMILY_DETAIL = (
    "slug string, common_name string, description string, tags array<string>, "
    "alt_names array<string>, yara array<string>"
)

# Feed documents.  RSS items sit in a channel or, in older feeds, beside it.
_RSS_ITEM = (
    "struct<title:string,link:string,guid:string,pubDate:string,`dc:date`:string,description:string,"
    "`content:encoded`:string,category:array<string>>"
)
_ATOM_ENTRY = (
    "struct<title:string,link:array<struct<_href:string>>,published:string,updated:string,"
    "summary:string,content:string>"
)
FEED_DOCUMENT = f"channel struct<item:array<{_RSS_ITEM}>>, item array<{_RSS_ITEM}>, entry array<{_ATOM_ENTRY}>"

SNAPSHOT = "key string, fetched_at timestamp, payload string"

# Common record: one row per (actor, source); entries live in tables of their own.
RECORD = (
    "actor_name string, source_id string, source_rank int, aliases array<string>, source_url string, "
    "retrieved_at string, origin string, motivations array<string>, first_seen string, sponsorship string, "
    "sectors array<string>, countries array<string>, source_citation string, description string, mitre_group_id string"
)
TECHNIQUE = (
    "actor string, source_id string, source_rank int, pos bigint, technique_id string, name string, tactic string, "
    "description string, detection string, detection_recs array<string>"
)
INDICATOR = (
    "actor string, source_id string, source_rank int, pos bigint, type string, value string, context string, "
    "first_seen string, sources array<string>"
)
